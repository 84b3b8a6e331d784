"""Sharding as vector bin packing: bytes, tokens and rows of the shards are balanced jointly.

Groups of equal texts are placed from the largest down, each in the shard whose
residual capacity has the highest dot product with the group's sizes. Groups
above ``1 / GRAIN`` of a shard are few, whatever the data, and are placed first,
over all shards. The others are dealt by hash into cells of bounded size; each
cell is packed in a task of its own against its share of the capacity left.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillbook.llm.common import ROW_BYTES, file_places, fresh, numbered, or_empty, row_key
from quillbook.operators.blocks import ordered
from quillbook.session import materialize

GRAIN = 64
#: Groups in a cell, about.
CELL_GROUPS = 20_000
SIZES = ("size", "tokens", "n_rows")
#: A repeated row that is more than one in so many rows is joined without shuffling its copies.
HOT_KEYS = 1000
#: Rows of a file that are numbered together, as a power of two.
PART_BITS = 17


def place(items: np.ndarray, residual: np.ndarray) -> np.ndarray:
    """Shard of each item, given sizes (items x 3) and residual capacities (shards x 3) in units of a shard.

    Items are taken in the order given; ``residual`` is updated.
    """
    out = np.empty(len(items), np.int64)
    for at, item in enumerate(items):
        out[at] = best = int(np.argmax(residual @ item))
        residual[best] -= item
    return out


def largest_first(groups: pd.DataFrame, capacity: np.ndarray) -> tuple[pd.DataFrame, np.ndarray]:
    """Groups from the largest down, and their sizes in units of a shard's capacity."""
    sizes = groups[list(SIZES)].to_numpy(float) / capacity
    order = np.lexsort((groups.piece, groups.digest, -sizes.max(1)))
    return groups.iloc[order], sizes[order]


def pack(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, shard, slot) for every row of ``docs``.

    size is the text's UTF-8 bytes plus 16, null counting as empty; slots run from
    0 without gaps in every shard, in the order of the input; that of Parquet files
    is the order of their names, and of the rows in them. Rows with equal
    texts share a shard, unless they exceed a shard's capacity in bytes, tokens or
    rows: such a group is cut by row number into pieces of about half a shard.
    Repeated rows are rows of their own; null ids are values like others. An empty
    table gives no rows.
    """
    rows = assigned(docs, shards, id_col, text_col)
    return rows.select(F.col("id").alias(id_col), "size", "text_crc32", "shard", "slot")


def packed(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with size, text_crc32, shard and slot; an added column whose name is taken gets an underscore.

    Rows find their slots by id and text, so texts are shuffled once and written
    nowhere. Rows that share both are interchangeable; they are numbered, and the
    slots of such rows dealt out by number.
    """
    key, nth, row, *names = fresh(docs, "row_key", "nth", "whole_row", "size", "text_crc32", "shard", "slot")
    rows = materialize(assigned(docs, shards, id_col, text_col))
    keyed = docs.withColumn(key, row_key(id_col, text_col))
    values = [F.col(c).alias(n) for c, n in zip(("size", "text_crc32", "shard", "slot"), names, strict=True)]
    times = materialize(
        rows.groupBy("key").agg(F.count("*").alias("n"), *[F.min(c).alias(c) for c in ("size", "text_crc32", "shard", "slot")]))
    repeated = times.filter("n > 1").withColumnRenamed("key", key)
    if repeated.isEmpty():
        return keyed.join(times.select(F.col("key").alias(key), *values), key).select(*docs.columns, *names)

    # fewer than HOT_KEYS keys: their rows stay where they are, all others are dealt by key
    hot = materialize(repeated.filter(F.col("n") > rows.count() / HOT_KEYS).select(key))
    cold = repeated.select(key).join(F.broadcast(hot), key, "left_anti")

    def copies(df: DataFrame) -> DataFrame:
        """Rows of repeated keys, numbered key by key in blocks: no task gets all of a key."""
        some = df.join(F.broadcast(hot), key, "left_semi").unionByName(
            df.join(F.broadcast(hot), key, "left_anti").join(cold, key, "left_semi"))
        return ordered(numbered(some, "copy_no"), [key], "copy_no", running={nth: F.lit(1)})

    once = times.filter("n = 1").select(F.col("key").alias(key), *values)
    out = keyed.join(F.broadcast(hot), key, "left_anti").join(once, key).select(*docs.columns, *names)
    slots = copies(rows.select(F.col("key").alias(key), *values)).select(key, nth, *names)
    again = copies(keyed.select(key, F.struct(*docs.columns).alias(row)))  # as one column, so that no name of theirs clashes
    return out.unionByName(again.join(slots, [key, nth]).select(f"{row}.*", *names))


def assigned(docs: DataFrame, shards: int, id_col: str, text_col: str) -> DataFrame:
    """(id, key, size, text_crc32, shard, slot) per row of ``docs``, without its texts."""
    text = or_empty(text_col)
    docs, path, index = file_places(docs) or (docs, F.lit(None).cast("string"), F.lit(None).cast("long"))
    base = numbered(docs.select(
        path.alias("path"), index.alias("index"), F.col(id_col).alias("id"), row_key(id_col, text_col).alias("key"),
        (F.octet_length(text).cast("long") + ROW_BYTES).alias("size"), F.regexp_count(text, F.lit(r"\S+")).cast("long").alias("tokens"),
        F.crc32(text).alias("text_crc32"), F.md5(text).alias("digest")), "row_no")
    narrow = base.select("row_no", "path", "index", "size", "tokens", "digest")
    sums = [F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count("*").alias("n_rows")]
    total = narrow.agg(*sums).first()
    capacity = np.maximum([float(total[c] or 0) / shards for c in SIZES], 1e-9)
    share = F.greatest(*[F.col(c) / float(x) for c, x in zip(SIZES, capacity, strict=True)])
    spark = docs.sparkSession

    # groups beyond a shard's capacity: at most 3 x shards
    hot = narrow.groupBy("digest").agg(*sums).filter(share > 1).select("digest", F.ceil(2 * share).alias("pieces")).collect()
    cut = spark.createDataFrame([tuple(r) for r in hot], "digest string, pieces long")
    pieces = narrow.join(F.broadcast(cut), "digest", "left").select(
        "row_no", "path", "index", "size", "tokens", "digest",
        F.coalesce(F.pmod(F.xxhash64("row_no"), F.col("pieces")), F.lit(0)).alias("piece"))
    groups = materialize(pieces.groupBy("digest", "piece").agg(*sums))

    # groups above 1 / GRAIN of a shard: at most 3 x GRAIN x shards, and the cut ones' pieces
    large, large_sizes = largest_first(groups.filter(share >= 1 / GRAIN).toPandas(), capacity)
    residual = np.ones((shards, 3))
    large_rows = list(zip(large.digest, large.piece.tolist(), place(large_sizes, residual).tolist(), strict=True))
    small = groups.filter(share < 1 / GRAIN)
    rest = small.agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in SIZES]).first()
    cells = max(1, math.ceil(rest.n / CELL_GROUPS))
    whole = np.maximum([float(rest[c] or 0) for c in SIZES], 1e-9)

    def pack_cell(cell: pd.DataFrame) -> pd.DataFrame:
        cell, sizes = largest_first(cell, capacity)
        part = cell[list(SIZES)].to_numpy(float).sum(0) / whole
        return pd.DataFrame({"digest": cell.digest, "piece": cell.piece, "shard": place(sizes, residual * part)})

    placed_small = small.withColumn("cell", F.pmod(F.xxhash64("digest"), F.lit(cells))).groupBy("cell").applyInPandas(
        pack_cell, "digest string, piece long, shard int")
    placed_large = F.broadcast(spark.createDataFrame(large_rows, "digest string, piece long, shard int"))
    # rows of large groups stay where they are; a small group is less than 1 / GRAIN of a shard, so no key of the shuffle is hot
    both = pieces.join(placed_large, ["digest", "piece"]).unionByName(
        pieces.join(placed_large, ["digest", "piece"], "left_anti").join(placed_small, ["digest", "piece"]))

    # slots: the rows of a shard from one part of a file, or from one written partition, then those of the next
    rows = materialize(both.select(
        "row_no", "shard", "path", "index",
        F.coalesce(F.shiftright("index", PART_BITS), F.shiftright("row_no", 33)).alias("part")))
    # names of part files: a longer number is a larger one
    name = F.element_at(F.split("path", "/"), -1)
    folder = F.expr("left(path, length(path) - length(element_at(split(path, '/'), -1)))")
    earlier = Window.partitionBy("shard").orderBy(folder, F.length(name), name, "part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("shard", "path", "part").agg(F.count("*").alias("n")).select(
        "shard", F.coalesce("path", F.lit("")).alias("path"), "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    rows = rows.withColumn("path", F.coalesce("path", F.lit("")))
    within = Window.partitionBy("shard", "path", "part").orderBy("index", "row_no")
    slots = rows.join(offsets, ["shard", "path", "part"]).select(
        "row_no", "shard", (F.col("offset") + F.row_number().over(within) - 1).alias("slot"))
    return base.join(slots, "row_no").select("id", "key", "size", "text_crc32", "shard", "slot")
