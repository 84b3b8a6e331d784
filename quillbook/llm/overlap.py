"""Near-duplicates by the share of common word shingles: SimHash and MinHash find candidates, the sets themselves decide.

Texts whose fingerprints, the majority bits of their shingles, are linked at
``BITS`` or fewer differing bits share a bucket. Similar texts further apart
meet by MinHash: texts whose shingle sets have a Jaccard similarity s share a band of ``ROWS``
minima with probability s^ROWS. There are as many bands as it takes for a pair
at the threshold to share none with a probability of at most ``MISSED``.

The texts of a bucket are not compared in pairs. Each is compared with the
bucket's leader alone, the text that meets most others, and is known from then
on by its edits: shingles that it adds to the leader's and those it lacks. Two
texts that are not both similar to their leader can only be similar to each
other if they share many of their edits, so these are what they meet by: the
rarest of them, as many as leave out fewer than such a pair must share (prefix
and position filters). Edits shared by very many texts make buckets of
their own, with leaders of their own.

Bands, edits and sets of shingles are always joined by shuffle: near copies
compress so well, and a text has so many of them, that Spark would take them
for small tables.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillbook.llm.common import fresh, numbered, or_empty, row_key
from quillbook.llm.simhash import components, first_rows, links
from quillbook.session import materialize, shuffled

ROWS = 5
#: Bits in which fingerprints differ that are linked, at most.
BITS = 2
#: Probability that two texts just at the threshold share no band, at most.
MISSED = 1e-5
#: Pairs that may meet by one edit; where there would be more, the texts with that edit get a leader.
PAIRS_AN_EDIT = 1 << 16
#: Rounds with leaders; what is crowded after them meets in pairs.
ROUNDS = 6
#: Shingles whose minima are taken at once; only memory depends on it.
SHINGLES_AT_ONCE = 1 << 10
#: Fixed value: odd multiplier of the polynomial over word hashes.
STEP = np.uint64(0x9E3779B97F4A7C15)


def mixed(values: np.ndarray) -> np.ndarray:
    """Finalizer of MurmurHash3 over 64-bit values."""
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        values = (values ^ values >> np.uint64(33)) * np.uint64(factor)
    return values ^ values >> np.uint64(33)


def shingles(text: str, words: int) -> np.ndarray:
    """Distinct 64-bit hashes of a text's runs of ``words`` words; a shorter text is one run, one without words has none."""
    each = text.encode().lower().split()  # as in simhash.fingerprint
    if not each:
        return np.zeros(0, np.uint64)
    hashes = np.array([xxhash.xxh64_intdigest(w) for w in each], np.uint64)
    width = min(words, len(each))
    n = len(each) - width + 1
    runs = np.full(n, width, np.uint64)
    for at in range(width):
        runs = runs * STEP + hashes[at:at + n]
    return np.unique(mixed(runs))


def bands_for(similarity: float) -> int:
    return 1 if similarity >= 1 else math.ceil(math.log(MISSED) / math.log(1 - similarity ** ROWS))


def bands_of(found: np.ndarray, bands: int) -> np.ndarray:
    """A signed long for each band of minima of a set of hashes; none for an empty set."""
    if not len(found):
        return np.zeros(0, np.int64)
    draw = np.random.default_rng(11)
    factor = draw.integers(0, 1 << 32, bands * ROWS, np.uint32) | np.uint32(1)
    shift = draw.integers(0, 1 << 32, bands * ROWS, np.uint32)
    high = (found >> np.uint64(32)).astype(np.uint32)
    least = np.full(bands * ROWS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(high), SHINGLES_AT_ONCE):
        np.minimum(least, (high[at:at + SHINGLES_AT_ONCE, None] * factor + shift).min(0), out=least)
    out = np.arange(bands, dtype=np.uint64)
    for column in least.reshape(bands, ROWS).T:
        out = mixed(out * STEP + column)
    return out.view(np.int64)


def fingerprint_of(found: np.ndarray) -> int:
    """Majority bits of a set of hashes, as a signed number; zero for an empty set."""
    votes = np.zeros(64, np.int64)
    for at in range(0, len(found), SHINGLES_AT_ONCE):
        votes += np.unpackbits(found[at:at + SHINGLES_AT_ONCE].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(found), bitorder="little").view(np.int64)[0])


def by_fingerprint(nodes: DataFrame) -> DataFrame:
    """(node, band): a bucket for each chain of fingerprints (node, fp) that differ in at most ``BITS`` bits."""
    prints = materialize(nodes.select("fp").distinct())
    roots = components(links(prints, BITS)).withColumnRenamed("node", "fp")
    return nodes.select("node", "fp").join(roots, "fp", "left").select(
        "node", F.xxhash64(F.lit("fingerprint"), F.coalesce("root", "fp")).alias("band"))


def with_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``pairs`` (a, b, ...) with both sets of shingles, a_set and b_set."""
    for end in ("a", "b"):
        pairs = pairs.join(shuffled(sets.select(F.col("node").alias(end), F.col("shingles").alias(f"{end}_set"))), end)
    return pairs


def similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of ``pairs`` (a, b) whose sets (node, shingles) have at least this Jaccard similarity."""
    common = F.size(F.array_intersect("a_set", "b_set"))
    return with_sets(pairs, sets).filter(common / (F.size("a_set") + F.size("b_set") - common) >= similarity).select("a", "b")


def against_leaders(members: DataFrame, sets: DataFrame) -> DataFrame:
    """(node, leader, size, lacks, adds) of every text of a bucket (band, node) and its leader, each two once.

    size is the leader's; lacks and adds count the shingles that the text lacks and has beside them. The leader is the
    text whose buckets hold most texts: that from which copies were made, rather than one of the copies.
    """
    crowds = members.groupBy("band").agg(F.count("*").alias("crowd")).filter("crowd > 1")
    placed = materialize(members.join(shuffled(crowds), "band"))
    weights = placed.groupBy("node").agg(F.sum("crowd").alias("weight"))
    leaders = placed.join(shuffled(weights), "node").groupBy("band").agg(F.max(F.struct("weight", "node"))["node"].alias("b"))
    pairs = placed.join(shuffled(leaders), "band").select(F.col("node").alias("a"), "b").filter("a <> b").distinct()
    common = F.size(F.array_intersect("a_set", "b_set"))
    return materialize(with_sets(pairs, sets).withColumn("common", common).select(
        F.col("a").alias("node"), F.col("b").alias("leader"), F.size("b_set").alias("size"),
        (F.size("b_set") - F.col("common")).alias("lacks"), (F.size("a_set") - F.col("common")).alias("adds")))


def edits_of(compared: DataFrame, roots: DataFrame, sets: DataFrame, similarity: float) -> DataFrame | None:
    """Texts by the edits that they may meet by, where a leader's texts are not yet decided; None where all are.

    Rows are (leader, edit, node, root, size, n, cost, at, tells, asks): the edit at place ``at`` of the text's n, the
    rarest first. With cost = lacks + t * adds, two texts have similarity t or more if and only if they
    share (cost + cost' - (1 - t) * size) / (1 + t) edits or more. A text that is not similar to the leader, whose cost
    is beyond (1 - t) * size, asks; the partner has no higher cost.
    """
    t = similarity
    rooted = compared.join(roots, "node", "left").withColumns({
        "root": F.coalesce("root", "node"), "cost": F.col("lacks") + t * F.col("adds"), "n": F.col("lacks") + F.col("adds")})
    rooted = rooted.withColumn("beyond", F.col("cost") - (1 - t) * F.col("size"))
    undecided = rooted.groupBy("leader").agg(F.max("beyond").alias("b"), F.min("root").alias("low"), F.max("root").alias("high"))
    undecided = materialize(undecided.filter("b > 0 AND low < high").select("leader"))
    if undecided.isEmpty():
        return None

    def first(shared: Column) -> Column:
        """Places among which one must be shared, if ``shared`` edits or more are."""
        return F.greatest(F.col("n") - F.greatest(F.ceil(shared - 1e-6), F.lit(1)) + 1, F.lit(0))

    told = first(F.greatest("cost", F.col("cost") + F.col("beyond")) / (1 + t))
    asked = F.when(F.col("beyond") > 0, first(F.col("beyond"))).otherwise(0)
    open_ = rooted.join(undecided, "leader", "left_semi").withColumns({"told": told, "asked": asked}).withColumn("reach", F.greatest("told", "asked"))
    open_ = with_sets(open_.filter("reach > 0").withColumnsRenamed({"node": "a", "leader": "b"}), sets)
    edits = F.concat(F.array_except("a_set", "b_set"), F.array_except("b_set", "a_set"))
    each = materialize(open_.select(F.col("b").alias("leader"), F.col("a").alias("node"), "root", "size", "n", "cost", "told", "asked",
                                    "reach", F.explode(edits).alias("edit")))
    times = each.groupBy("leader", "edit").agg(F.count("*").alias("times"))
    rarest = Window.partitionBy("leader", "node").orderBy("times", "edit")
    placed = each.join(shuffled(times), ["leader", "edit"]).withColumn("at", F.row_number().over(rarest) - 1).filter("at < reach")
    return placed.select("leader", "edit", "node", "root", "size", "n", "cost", "at",
                         (F.col("at") < F.col("told")).alias("tells"), (F.col("at") < F.col("asked")).alias("asks"))


def meeting(edits: DataFrame, similarity: float) -> DataFrame:
    """Distinct pairs (a, b) of texts, not yet in one group, that meet by an edit and may share enough of them."""
    names = ("node", "root", "n", "cost", "at")
    asks, tells = (edits.filter(role).select("leader", "edit", *["size"] * (role == "asks"), *[F.col(c).alias(f"{c}_{role[0]}") for c in names])
                   for role in ("asks", "tells"))
    needed = (F.col("cost_a") + F.col("cost_t") - (1 - similarity) * F.col("size")) / (1 + similarity)
    left = F.least(F.col("n_a") - F.col("at_a"), F.col("n_t") - F.col("at_t"))  # as the first edit that both have
    lower = (F.col("cost_t") < F.col("cost_a")) | ((F.col("cost_t") == F.col("cost_a")) & (F.col("node_t") < F.col("node_a")))
    met = asks.join(shuffled(tells), ["leader", "edit"]).filter(lower & (F.col("root_a") != F.col("root_t")) & (left >= needed - 1e-6))
    return met.select(F.least("node_a", "node_t").alias("a"), F.greatest("node_a", "node_t").alias("b")).distinct()


def linked(members: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(node, root) of the texts linked by chains of similar pairs that share a bucket (band, node); root is the smallest of them."""
    found_links, roots = None, None
    for number in range(ROUNDS):
        compared = against_leaders(members, sets)
        common = F.col("size") - F.col("lacks")
        found = compared.filter(common / (F.col("size") + F.col("adds")) >= similarity).select(F.col("node").alias("a"), F.col("leader").alias("b"))
        found_links = found if found_links is None else found_links.unionByName(found)
        roots = components(found_links)
        edits = edits_of(compared, roots, sets, similarity)
        if edits is None:
            break
        edits = materialize(edits)
        crowds = edits.groupBy("leader", "edit").agg(
            F.count_if("asks").alias("x"), F.count_if("tells").alias("y"), F.min("root").alias("low"), F.max("root").alias("high"))
        crowds = materialize(crowds.filter("x > 0 AND y > 0 AND low < high").select("leader", "edit", (F.col("x") * F.col("y")).alias("pairs")))
        crowded = F.col("pairs") > (PAIRS_AN_EDIT if number < ROUNDS - 1 else (1 << 62))
        light = edits.join(shuffled(crowds.filter(~crowded)), ["leader", "edit"], "left_semi")
        more = materialize(similar(meeting(light, similarity), sets, similarity))
        if not more.isEmpty():
            found_links = found_links.unionByName(more)
            roots = components(found_links)
        if crowds.filter(crowded).isEmpty():
            break
        members = edits.join(crowds.filter(crowded), ["leader", "edit"], "left_semi").select(
            F.xxhash64("leader", "edit").alias("band"), "node").distinct()
    return roots


def one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5,
                  similarity: float = 0.8) -> DataFrame:
    """``docs`` with one row, one with the smallest id, of each group of texts linked at ``similarity`` or more; same columns.

    Similarity is the Jaccard similarity of the sets of word shingles, without
    regard to the case of A-Z; groups are what chains of such pairs connect.
    Equal sets are one group; so are all rows without words. A null id is never
    the smallest, unless the group has no other. Of rows that share id and text,
    any one stays. An empty table gives no rows.
    """
    bands = bands_for(similarity)

    def signatures(texts: pd.Series) -> pd.DataFrame:
        found = [shingles(t, shingle_words) for t in texts]
        return pd.DataFrame({"digest": [xxhash.xxh3_128_hexdigest(f.tobytes()) for f in found], "bands": [bands_of(f, bands) for f in found],
                             "fp": np.array([fingerprint_of(f) for f in found], np.int64)})

    def sets_of(texts: pd.Series) -> pd.Series:
        return pd.Series([shingles(t, shingle_words).view(np.int64) for t in texts])

    signed = F.pandas_udf(signatures, "digest string, bands array<long>, fp long")(or_empty(text_col))
    rows = numbered(docs.select(F.col(id_col).alias("id"), row_key(id_col, text_col).alias("key"), signed.alias("s"))
                    .select("id", "key", "s.*"), "row_no")
    least = F.min(F.struct(F.col("id").isNull(), "id", "row_no", "key"))
    # a node for each distinct set: the number of its first row
    nodes = materialize(rows.groupBy("digest").agg(least.alias("least"), F.first("bands").alias("bands"), F.first("fp").alias("fp"))
                        .select("digest", "least", F.col("least.row_no").alias("node"), F.col("least.key").alias("key"), "bands", "fp"))
    placed = nodes.select("node", F.explode("bands").alias("band")).unionByName(by_fingerprint(nodes))
    shared = placed.groupBy("band").count().filter("count > 1")
    members = materialize(placed.join(shuffled(shared), "band").select("band", "node"))

    (key,) = fresh(docs, "row_key")
    candidates = members.select("node").distinct().join(nodes.select("node", F.col("key").alias(key)), "node")
    texts = docs.select(row_key(id_col, text_col).alias(key), or_empty(text_col).alias("text")).join(candidates, key).dropDuplicates([key])
    sets = materialize(texts.select("node", F.pandas_udf(sets_of, "array<long>")("text").alias("shingles")))

    roots = linked(members, sets, similarity)

    joined = nodes.join(roots, "node", "left").select("digest", "least", F.coalesce("root", "node").alias("root"))
    smallest = joined.groupBy("root").agg(F.min("least").alias("least"))
    by_digest = joined.select("digest", "root").join(smallest, "root").select("digest", F.col("least.row_no").alias("first_row"))
    firsts = rows.select("key", "digest", "row_no").join(by_digest, "digest").select("key", (F.col("row_no") == F.col("first_row")).alias("first"))
    return first_rows(docs, firsts, id_col, text_col)
