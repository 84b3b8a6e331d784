"""Near-duplicates by SimHash fingerprints that meet at the code words of a covering code.

Two Golay codes of 23 bits cover the lowest 46 bits of a fingerprint: every
point lies within 3 bits of exactly one code word of each, so within
``RADIUS`` = 6 bits of one pair of code words, its home anchor. Two
fingerprints that differ in ``threshold`` bits differ in at most as many of
those 46, so each lies within ``RADIUS + threshold`` of the other's home. A
fingerprint is stored at every anchor within that reach and looked up at its
home alone, and a link is taken from its smaller end: each is found once, and
none is lost. An anchor's rows meet in an equi-join, which Spark may split; it
is always shuffled, since Spark doesn't know how many anchors a fingerprint has.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillbook.llm.common import fresh, numbered, or_empty, row_key
from quillbook.session import materialize, shuffled

CODE_BITS = 23
RADIUS = 6
#: Fixed value: generator polynomial of the binary Golay code, x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GOLAY = 0b101011100011
MASK = (1 << CODE_BITS) - 1
#: Hashes whose bits are counted at once; only memory depends on it.
HASHES_AT_ONCE = 1 << 15
#: Distinct fingerprints in a task that lays them out over anchors, about.
PRINTS_A_TASK = 10_000


def fingerprint(text: str, shingle_words: int = 3) -> int:
    """Majority bits of the XXH64 values of a text's word shingles, repeats included."""
    words = text.encode().lower().split()  # bytes: only A-Z change, only ASCII white space divides
    if not words:
        return 0
    n = max(1, len(words) - shingle_words + 1)
    votes = np.zeros(64, np.int64)
    for at in range(0, n, HASHES_AT_ONCE):
        some = range(at, min(n, at + HASHES_AT_ONCE))
        hashes = np.array([xxhash.xxh64_intdigest(b" ".join(words[i:i + shingle_words]), 42) for i in some], np.uint64)
        votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * votes > n, bitorder="little").view(np.uint64)[0])


def fingerprints(text: Column, shingle_words: int = 3) -> Column:
    """Fingerprint of each text as a signed long; null counts as empty."""

    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, shingle_words) for t in texts], np.uint64).view(np.int64))

    return F.pandas_udf(of, "long")(F.coalesce(text, F.lit("")))


def syndromes(words: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit words modulo the generator polynomial."""
    rest = words.astype(np.int64)
    for bit in range(CODE_BITS - 1, 10, -1):
        rest = np.where((rest >> bit) & 1, rest ^ (GOLAY << (bit - 11)), rest)
    return rest


@lru_cache(2)
def error_patterns(reach: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """By syndrome: the bit patterns of weight up to ``reach`` that lead to a code word, and their weights."""
    every = np.arange(1 << CODE_BITS, dtype=np.int64)
    weights = np.bitwise_count(every)
    every, weights = every[weights <= reach], weights[weights <= reach]
    order = np.lexsort((weights, found := syndromes(every)))
    bounds = np.searchsorted(found[order], np.arange((1 << 11) + 1))
    return [(every[order[a:b]], weights[order[a:b]]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def halves(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two 23-bit words of each signed fingerprint."""
    return values & MASK, values >> CODE_BITS & MASK


def anchors_of(values: np.ndarray, reach: int) -> list[np.ndarray]:
    """For each fingerprint, all anchors within ``reach`` bits of its lowest 46."""
    table, out = error_patterns(reach), []
    low, high = halves(values)
    for x, y, s, t in zip(low.tolist(), high.tolist(), syndromes(low).tolist(), syndromes(high).tolist(), strict=True):
        (a, a_weights), (b, b_weights) = table[s], table[t]
        # ascending weights: what the other half's nearest code word leaves over
        n = np.searchsorted(a_weights, reach - b_weights[0], "right")
        m = np.searchsorted(b_weights, reach - a_weights[0], "right")
        i, j = np.nonzero(a_weights[:n, None] + b_weights[None, :m] <= reach)
        out.append((x ^ a[i]) | (y ^ b[j]) << CODE_BITS)
    return out


def homes_of(values: np.ndarray) -> np.ndarray:
    """The one anchor within 3 bits of each fingerprint in both codes."""
    nearest = np.array([patterns[0] for patterns, _ in error_patterns(RADIUS // 2)], np.int64)
    low, high = halves(values)
    return (low ^ nearest[syndromes(low)]) | (high ^ nearest[syndromes(high)]) << CODE_BITS


def links(prints: DataFrame, threshold: int = 2) -> DataFrame:
    """Pairs (a, b), a < b, of distinct fingerprints that differ in at most ``threshold`` bits, each once."""
    reach = RADIUS + threshold

    def at_home(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"anchor": homes_of(batch.fp.to_numpy()), "a": batch.fp})

    def at_anchors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 4096):
                some = batch.fp.to_numpy()[at:at + 4096]
                near = anchors_of(some, reach)
                yield pd.DataFrame({"anchor": np.concatenate(near), "b": np.repeat(some, [len(n) for n in near])})

    prints = prints.repartition(max(1, -(-prints.count() // PRINTS_A_TASK)), "fp")
    homes = prints.select("fp").mapInPandas(at_home, "anchor long, a long")
    met = homes.join(shuffled(prints.select("fp").mapInPandas(at_anchors, "anchor long, b long")), "anchor")
    return met.filter((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= threshold)).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the smallest node reachable.

    Alternates two rewritings that keep connectivity: each node hands its
    larger neighbours, then its smaller ones, to the smallest it knows. Every
    round is written to the checkpoint folder; it ends when all edges point to
    roots. Neighbours are never gathered into a list.
    """
    edges = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")))
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = materialize(
            both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        )
        edges = materialize(small)
        inner = edges.select(F.col("v").alias("u")).join(edges.select("u"), "u", "left_semi")
        twice = edges.groupBy("u").count().filter("count > 1")
        if inner.isEmpty() and twice.isEmpty():
            break
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def grouped(docs: DataFrame, id_col: str, text_col: str, shingle_words: int, threshold: int) -> DataFrame:
    """(row_no, id, key, fp, component_id, first) per row of ``docs``, without its texts."""
    rows = numbered(docs.select(
        F.col(id_col).alias("id"), row_key(id_col, text_col).alias("key"),
        fingerprints(or_empty(text_col), shingle_words).alias("fp")), "row_no")
    least = F.min(F.struct(F.col("id").isNull(), "id", "row_no"))
    prints = materialize(rows.groupBy("fp").agg(least.alias("least")))
    roots = components(links(prints, threshold))
    joined = prints.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    smallest = joined.groupBy("root").agg(F.min("least").alias("least"))
    by_print = joined.select("fp", "root").join(smallest, "root").select(
        "fp", F.col("least.id").alias("component_id"), F.col("least.row_no").alias("first_row"))
    return rows.join(by_print, "fp").select("row_no", "id", "key", "fp", "component_id", (F.col("row_no") == F.col("first_row")).alias("first"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3,
                    threshold: int = 2) -> DataFrame:
    """Fingerprint and group of every row of ``docs``: (id, fp long, component_id, first boolean).

    component_id is the smallest id of the group; ``first`` holds for exactly one
    row of each group, a row with that id. Rows without text or without words
    have fingerprint zero and form a group like any other. Repeated rows, and rows
    that repeat an id, are rows of their own; a null id is never the smallest,
    unless the group has no other. An empty table gives an empty result. Columns
    of ``docs`` may have any name.
    """
    return grouped(docs, id_col, text_col, shingle_words, threshold).select(F.col("id").alias(id_col), "fp", "component_id", "first")


def one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3,
                  threshold: int = 2) -> DataFrame:
    """``docs`` with one row of each near-duplicate group, one with the smallest id; same columns.

    The chosen rows are named by id and text, so texts are shuffled once and
    written nowhere. Of rows that share both, any one stays.
    """
    return first_rows(docs, grouped(docs, id_col, text_col, shingle_words, threshold), id_col, text_col)


def first_rows(docs: DataFrame, rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``docs`` that ``rows`` (key, first) marks as the first of their groups; of equal ones any."""
    (key,) = fresh(docs, "row_key")
    kept = materialize(rows.groupBy("key").agg(F.max("first").alias("first"), F.count("*").alias("n")).filter("first"))
    keyed = docs.withColumn(key, row_key(id_col, text_col))

    def rows_of(condition: str) -> DataFrame:
        return keyed.join(kept.filter(condition).select(F.col("key").alias(key)), key, "left_semi")

    out = rows_of("n = 1").select(*docs.columns)
    if not kept.filter("n > 1").isEmpty():
        out = out.unionByName(rows_of("n > 1").dropDuplicates([key]).select(*docs.columns))
    return out
