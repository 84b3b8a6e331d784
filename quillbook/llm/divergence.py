"""Audit of how far the sources of a language differ in their terms.

A first pass counts in how many documents of its language a term stands; those
with enough are kept. The kept terms, sorted and cut into ranges, become
minimal acyclic transducers, each built in a task of its own. A second pass
streams the texts through them and counts by ordinal, so a term is a number
from there on, in the order of its bytes. Transducers travel in groups of
bounded bytes, each with a pass of its own over the texts of its languages.
Blocks of ordinals then hold every group's counts side by side.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillbook.llm.common import or_empty
from quillbook.llm.transducer import Transducer
from quillbook.session import materialize

#: Documents of a language in which a kept term stands, at least.
LEAST_DOCUMENTS = 10
#: Ranks of the part ``term``.
TOP_TERMS = 10
#: Terms in a transducer, about.
TERMS_A_SHARD = 40_000
#: Bytes of transducers that are sent to the tasks for one pass over the texts, unless one alone is larger.
PASS_BYTES = 48 << 20
#: Counts that a task holds before it hands them on; only memory depends on it.
COUNTS_AT_ONCE = 1_000_000
#: Ordinals whose counts in all groups of a language lie in one task.
BLOCK_TERMS = 4096
SCALE = 1_000_000_000
#: A-Z to a-z; bytes below 0x80 that are no letters end a term.
LETTERS = bytes(c | 0x20 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms_of(text: str) -> list[bytes]:
    """A text's terms in order: runs of letters and of characters from U+0080 on, A-Z in lower case."""
    return text.encode().translate(LETTERS).split()


def shares(counts: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * counts / total) for counts up to total < 2^53, without a product beyond 63 bits."""
    out, rest = np.divmod(counts, total)
    for _ in range(3):  # three decimal digits at a time
        more, rest = np.divmod(rest * 1000, total)
        out = out * 1000 + more
    return out + 1


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


@dataclass
class Shards:
    """Transducers of consecutive ranges of one language's terms."""

    firsts: np.ndarray
    bases: list[int]
    parts: list[Transducer]

    def ordinals(self, terms: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(position in ``terms``, ordinal) of those that are kept."""
        depth = max(part.depth for part in self.parts)
        short = np.array([i for i, t in enumerate(terms) if len(t) <= depth], np.int64)
        words = np.array([terms[i] for i in short.tolist()], f"S{depth}")
        which = np.searchsorted(self.firsts, words, "right") - 1
        out = np.full(len(words), -1, np.int64)
        for number, part in enumerate(self.parts):
            mine = np.flatnonzero(which == number)
            found = part.ordinals(words[mine])
            out[mine] = np.where(found < 0, -1, found + self.bases[number])
        return short[out >= 0], out[out >= 0]


def kept_terms(docs: DataFrame, least: int) -> DataFrame:
    """(lang, term, documents) of the terms that stand in at least ``least`` rows of their language."""

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        by_lang: dict[str, Counter] = {}

        def handed_on() -> pd.DataFrame:
            out = pd.DataFrame([(lang, t.decode(), n) for lang, c in by_lang.items() for t, n in c.items()], columns=["lang", "term", "n"])
            by_lang.clear()
            return out

        held = 0
        for batch in batches:
            for lang, text in zip(batch.lang, batch.text, strict=True):
                counter = by_lang.setdefault(lang, Counter())
                before = len(counter)
                counter.update(set(terms_of(text)))
                held += len(counter) - before
                if held > COUNTS_AT_ONCE:
                    yield handed_on()
                    held = 0
        yield handed_on()

    counted = docs.select("lang", "text").mapInPandas(found, "lang string, term string, n long")
    return counted.groupBy("lang", "term").agg(F.sum("n").alias("documents")).filter(F.col("documents") >= least)


def transducers(kept: DataFrame) -> DataFrame:
    """(lang, first, terms, base, root, depth, edges, targets, passed, final): a row for each range of sorted terms.

    base is how many of the language's terms precede the range.
    """

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["lang", "first", "terms", "root", "depth", "edges", "targets", "passed", "final"]
        lang, terms = None, []

        def row() -> pd.DataFrame:
            made = Transducer.of([t.encode() for t in terms])
            return pd.DataFrame([[lang, terms[0], terms, *made.pack()]], columns=columns)

        for batch in batches:
            for of, term in zip(batch.lang, batch.term, strict=True):
                if terms and (of != lang or len(terms) >= 2 * TERMS_A_SHARD):
                    yield row()
                    terms = []
                lang = of
                terms.append(term)
        if terms:
            yield row()

    ranges = max(1, -(-kept.count() // TERMS_A_SHARD))
    ordered = kept.select("lang", "term").repartitionByRange(ranges, "lang", "term").sortWithinPartitions("lang", "term")
    made = materialize(ordered.mapInPandas(
        build, "lang string, first string, terms array<string>, root int, depth int, edges binary, targets binary, passed binary, final binary"))
    # one row for tens of thousands of terms
    before = Window.partitionBy("lang").orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    bases = made.select("lang", "first", F.size("terms").cast("long").alias("n"))
    bases = bases.select("lang", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return made.join(F.broadcast(bases), ["lang", "first"])


def passes(shards: DataFrame) -> Iterator[list]:
    """Keys (lang, first) of transducers, in groups of bounded bytes."""
    size = F.octet_length("edges") + F.octet_length("targets") + F.octet_length("passed") + F.octet_length("final")
    group, held = [], 0
    for row in shards.select("lang", "first", size.alias("size")).orderBy("lang", "first").toLocalIterator():
        if group and held + row["size"] > PASS_BYTES:
            yield group
            group, held = [], 0
        group.append((row["lang"], row["first"]))
        held += row["size"]
    if group:
        yield group


def recount(docs: DataFrame, shards: DataFrame, group: list) -> DataFrame:
    """(lang, source, ordinal, n) of the terms of one group of transducers, part sums."""
    spark = docs.sparkSession
    keys = spark.createDataFrame(group, "lang string, first string")
    by_lang: dict[str, list] = {}
    for row in sorted(shards.drop("terms").join(F.broadcast(keys), ["lang", "first"], "left_semi").collect(), key=lambda r: r["base"]):
        by_lang.setdefault(row["lang"], []).append(row.asDict())
    sent = spark.sparkContext.broadcast(by_lang)

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ready = {lang: Shards(np.array([r["first"].encode() for r in rows]), [r["base"] for r in rows], [
            Transducer.unpack(r["root"], r["depth"], r["edges"], r["targets"], r["passed"], r["final"]) for r in rows])
            for lang, rows in sent.value.items()}
        counts: dict[tuple, Counter] = {}
        held = 0

        def handed_on() -> Iterator[pd.DataFrame]:
            for (lang, source), counter in counts.items():
                terms = list(counter)
                at, ordinals = ready[lang].ordinals(terms)
                n = np.fromiter(counter.values(), np.int64, len(terms))[at]
                yield pd.DataFrame({"lang": [lang], "source": [source], "ordinals": [ordinals], "n": [n]})
            counts.clear()

        for batch in batches:
            for lang, source, text in zip(batch.lang, batch.source, batch.text, strict=True):
                counter = counts.setdefault((lang, source), Counter())
                before = len(counter)
                counter.update(terms_of(text))
                held += len(counter) - before
                if held > COUNTS_AT_ONCE:
                    yield from handed_on()
                    held = 0
        yield from handed_on()

    wanted = docs.filter(F.col("lang").isin(list(by_lang))) if len(by_lang) < 1000 else docs.join(
        F.broadcast(keys.select("lang").distinct()), "lang", "left_semi")
    made = wanted.select("lang", "source", "text").mapInPandas(stream, "lang string, source string, ordinals array<long>, n array<long>")
    return made.select("lang", "source", F.explode(F.arrays_zip("ordinals", "n")).alias("c")).select(
        "lang", "source", F.col("c.ordinals").alias("ordinal"), F.col("c.n").alias("n"))


def block_rows(counts: pd.DataFrame, groups: pd.DataFrame, block_terms: int) -> pd.DataFrame:
    """Part results of one block of ordinals: pairs of sources with their sums over the block, and each source's first terms."""
    groups = groups.sort_values("source", ignore_index=True)
    lang, block, kept = groups.lang[0], int(groups.block[0]), int(groups.kept[0])
    width = min(block_terms, kept - block * block_terms)
    n = np.zeros((len(groups), max(width, 0)), np.int64)
    n[np.searchsorted(groups.source.to_numpy(), counts.source.to_numpy()), counts.ordinal.to_numpy() - block * block_terms] = counts.n
    totals = groups.total.to_numpy()
    # without kept terms there is nothing to divide, and nothing to sum
    p = shares(n + 2, np.maximum(totals + 2 * kept, 1)[:, None])
    q = shares(n.sum(0) + 2, np.int64(max(groups.lang_total[0] + 2 * kept, 1))) if width > 0 else np.zeros(0, np.int64)
    out = []
    for i, source in enumerate(groups.source):
        for k, value in enumerate(distance(p[i], p[i + 1:]).sum(1).tolist(), i + 1):
            out += [("pair", source, groups.source[k], None, value), ("pair", groups.source[k], source, None, value)]
        here = np.flatnonzero((n[i] > 0) & (p[i] > q))
        values = distance(p[i, here], q[here])
        for j in np.lexsort((here, -values))[:TOP_TERMS].tolist():
            out.append(("term", source, None, block * block_terms + int(here[j]), int(values[j])))
    made = pd.DataFrame(out, columns=["part", "source", "item", "ordinal", "value"])
    return made.assign(lang=lang, ordinal=made.ordinal.astype("Int64"))


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
          least: int = LEAST_DOCUMENTS) -> DataFrame:
    """(lang, source, part, item, value, rank) for every pair of language and source in ``docs``.

    Part ``pair`` has every other source of the language and how far its term
    shares are from this one's; part ``term`` has the ten kept terms whose share
    here exceeds the language's most. Nulls count as ''. A source alone in its
    language has no pairs; a language without kept terms has pairs of value 0
    and no terms. Each row of ``docs`` is a document, repeated or not; an empty
    table gives no rows. Other columns, whatever their names, play no part.
    """
    slim = docs.select(or_empty(lang_col).alias("lang"), or_empty(source_col).alias("source"), or_empty(text_col).alias("text"))
    kept = materialize(kept_terms(slim, least))
    shards = materialize(transducers(kept))
    counts = None
    for group in passes(shards):
        counted = recount(slim, shards, group)
        counted = materialize(counted.groupBy("lang", "source", "ordinal").agg(F.sum("n").alias("n")))
        counts = counted if counts is None else counts.unionByName(counted)
    if counts is None:
        counts = slim.sparkSession.createDataFrame([], "lang string, source string, ordinal long, n long")

    sizes = shards.groupBy("lang").agg(F.sum(F.size("terms")).alias("kept"))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = slim.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(sizes, "lang", "left").na.fill(0, ["total", "kept"])
    groups = materialize(groups)
    langs = groups.groupBy("lang").agg(F.sum("total").alias("lang_total"))
    width = BLOCK_TERMS
    last_block = F.floor(F.greatest(F.col("kept") - 1, F.lit(0)) / BLOCK_TERMS)
    placed = groups.join(langs, "lang").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), last_block)))
    counts = counts.withColumn("block", F.floor(F.col("ordinal") / BLOCK_TERMS))
    made = materialize(counts.groupBy("lang", "block").cogroup(placed.groupBy("lang", "block")).applyInPandas(
        lambda counts, groups: block_rows(counts, groups, width), "part string, source string, item string, ordinal long, value long, lang string"))

    def ranked(rows: DataFrame, *ties: str) -> Column:
        return F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), *ties))

    pairs = made.filter("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    pairs = pairs.withColumn("rank", ranked(pairs, "item"))
    terms = made.filter("part = 'term'")
    terms = terms.withColumn("rank", ranked(terms, "ordinal")).filter(F.col("rank") <= TOP_TERMS)
    names = shards.select("lang", "base", F.posexplode("terms").alias("at", "item")).select("lang", (F.col("base") + F.col("at")).alias("ordinal"), "item")
    named = terms.drop("item").join(names.hint("merge"), ["lang", "ordinal"])  # a vocabulary is no side to broadcast
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.select(*columns).unionByName(named.select(*columns))


def expected_sql(least: int = LEAST_DOCUMENTS, top: int = TOP_TERMS) -> str:
    """The audit of ``documents`` in DuckDB."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return rf"""
    WITH docs AS (
      SELECT row_number() OVER () AS no, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
    words AS (
      SELECT no, lang, source, unnest(regexp_extract_all(translate(text, '{upper}', '{lower}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
    kept AS (SELECT lang, term FROM words GROUP BY lang, term HAVING count(DISTINCT no) >= {least}),
    sizes AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
    counts AS (SELECT lang, source, term, count(*) AS n FROM words JOIN kept USING (lang, term) GROUP BY lang, source, term),
    grp AS (SELECT DISTINCT lang, source FROM docs),
    totals AS (SELECT lang, source, sum(n) AS total FROM counts GROUP BY lang, source),
    here AS (
      SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
        1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (coalesce(t.total, 0) + 2 * s.v)::HUGEINT AS p
      FROM grp g JOIN kept k USING (lang) JOIN sizes s USING (lang)
      LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
      LEFT JOIN totals t ON t.lang = g.lang AND t.source = g.source),
    whole AS (
      SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(n) + 2)) // (sum(sum(n)) OVER (PARTITION BY lang) + 2 * any_value(v))::HUGEINT AS q
      FROM here JOIN sizes USING (lang) GROUP BY lang, term),
    sums AS (
      SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
      FROM here a JOIN here b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
    pairs AS (
      SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
      FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
      LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
    terms AS (
      SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // (p + q) AS value FROM here JOIN whole USING (lang, term) WHERE n > 0 AND p > q),
    ranked AS (
      SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
    SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= {top}
    """
