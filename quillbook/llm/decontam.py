"""Benchmark decontamination by greedy string tiling.

A document and a benchmark item that share a seed, a run of ``LEAST`` words
with equal Karp-Rabin hash and equal words, are tiled: the longest match whose
words are still free on both sides is marked, again and again, down to matches
of ``LEAST`` words. The share of the item's words under tiles decides, so
passages count in any order. Items are held in blocks of bounded size, sent to
every task, and each block is laid against all documents; nothing is shuffled.
"""

from __future__ import annotations

import heapq
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillbook.llm.common import fresh, or_empty

WORD = re.compile(r"\w+")
LEAST = 5
COVERED = 0.4
#: Words of benchmark items in a block, about.
BLOCK_WORDS = 1_000_000
BASE = np.uint64(1_000_003)


def window_hashes(ids: np.ndarray, width: int = LEAST) -> np.ndarray:
    """Karp-Rabin hashes, modulo 2^64, of all windows of word numbers."""
    if len(ids) < width:
        return np.zeros(0, np.uint64)
    numbers, n = ids.astype(np.uint64), len(ids) - width + 1
    out = np.zeros(n, np.uint64)
    for at in range(width):
        out = out * BASE + numbers[at:at + n]
    return out


@dataclass
class Block:
    """Benchmark items by position, their words' numbers from 1, and the seeds sorted by hash."""

    items: list
    words: list[np.ndarray]
    number: dict[str, int]
    hashes: np.ndarray
    item_of: np.ndarray

    @classmethod
    def of(cls, items: list, texts: list[str]) -> Block:
        number: dict[str, int] = {}
        words = [np.array([number.setdefault(w, len(number) + 1) for w in WORD.findall(t.lower())], np.int64) for t in texts]
        hashes = [window_hashes(w) for w in words]
        every = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(words)), [len(h) for h in hashes])
        order = np.argsort(every, kind="stable")
        return cls(items, words, number, every[order], owner[order])

    def matches(self, text: str, covered: float) -> list[dict]:
        """Items of which ``covered`` or more lies under tiles of the text."""
        known = self.number.get
        ids = np.array([known(w, 0) for w in WORD.findall(text.lower())], np.int64)
        hashes = window_hashes(ids)
        if not len(hashes) or not len(self.hashes):
            return []
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        where = np.flatnonzero(self.hashes[at] == hashes)
        if not len(where):
            return []
        where = where[np.argsort(hashes[where], kind="stable")]
        shared = hashes[where]
        distinct = np.unique(shared)
        low, high = np.searchsorted(self.hashes, distinct), np.searchsorted(self.hashes, distinct, "right")
        near = np.unique(np.concatenate([self.item_of[a:b] for a, b in zip(low, high, strict=True)]))
        out = []
        for item in near.tolist():
            marked, longest, tiles = tile(ids, self.words[item], shared, where)
            if tiles and marked >= covered * len(self.words[item]):
                out.append({"item_id": self.items[item], "coverage": marked / len(self.words[item]), "tiles": tiles, "longest": longest})
        return out


def runs(ids: np.ndarray, item: np.ndarray, shared: np.ndarray, where: np.ndarray) -> list[tuple[int, int, int]]:
    """Maximal equal runs (minus length, start in the document, start in the item) of ``LEAST`` words or more.

    Seeds are followed word by word of the item, and only the ends of runs are kept, so periodic texts take no
    more room than their runs.
    """
    hashes = window_hashes(item)
    low, high = np.searchsorted(shared, hashes), np.searchsorted(shared, hashes, "right")
    starts, ends, before = [], [], np.zeros(0, np.int64)
    for i in range(len(hashes) + 1):
        here = np.zeros(0, np.int64)
        if i < len(hashes):
            here = where[low[i]:high[i]]  # ascending: the sort by hash was stable
            for k in range(LEAST):
                here = here[ids[here + k] == item[i + k]]
        if len(before) or len(here):
            ends += [(p - i + 1, p, i - 1) for p in before[~np.isin(before + 1, here)].tolist()]
            starts += [(p - i, p, i) for p in here[~np.isin(here, before + 1)].tolist()]
        before = here
    starts.sort()
    ends.sort()
    return [(a[1] - b[1] - LEAST, a[1], a[2]) for a, b in zip(starts, ends, strict=True)]


def tile(ids: np.ndarray, item: np.ndarray, shared: np.ndarray, where: np.ndarray) -> tuple[int, int, int]:
    """Words of the item under tiles, length of the longest tile, number of tiles."""
    queue = runs(ids, item, shared, where)
    heapq.heapify(queue)
    in_text, in_item = np.zeros(len(ids), bool), np.zeros(len(item), bool)
    longest = tiles = 0
    while queue and not in_item.all():
        length, p, i = heapq.heappop(queue)
        taken = in_text[p:p - length] | in_item[i:i - length]
        if not taken.any():
            in_text[p:p - length] = in_item[i:i - length] = True
            longest, tiles = max(longest, -length), tiles + 1
            continue
        edges = np.flatnonzero(np.diff(np.concatenate([[1], taken.view(np.int8), [1]])))
        for a, b in edges.reshape(-1, 2).tolist():
            if b - a >= LEAST:
                heapq.heappush(queue, (a - b, p + a, i + a))
    return int(in_item.sum()), longest, tiles


def blocks(benchmark: DataFrame, item_col: str, text_col: str, block_words: int) -> Iterator[Block]:
    """Benchmark items in blocks dealt by hash, one at a time on the driver.

    Null texts count as empty. Items of fewer than ``LEAST`` words cannot match.
    """
    items = benchmark.select(F.col(item_col).alias("item"), or_empty(text_col).alias("text"))
    total = items.agg(F.sum(F.length("text") / 4 + 1)).first()[0] or 0
    n = max(1, math.ceil(total / block_words))
    for k in range(n):
        rows = items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k).distinct().collect()
        rows.sort(key=lambda r: (r.item is None, r.item, r.text))
        if rows:
            yield Block.of([r.item for r in rows], [r.text for r in rows])


def too_short(benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """One row: items (long), and too_short (long), those of fewer than ``LEAST`` words, which no document can match. Null texts have none."""
    words = F.size(F.regexp_extract_all(F.lower(or_empty(text_col)), F.lit(r"(?U)\w+"), F.lit(0)))
    return benchmark.agg(F.count("*").alias("items"), F.count_if(words < LEAST).alias("too_short"))


def matches(text: Column, block: Block, item_type: str, spark, covered: float) -> Column:
    sent = spark.sparkContext.broadcast(block)

    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([sent.value.matches(t, covered) for t in texts], dtype=object)

    return F.pandas_udf(of, f"array<struct<item_id: {item_type}, coverage: double, tiles: int, longest: int>>")(text)


def contaminations(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   item_col: str = "item_id", item_text: str = "text", covered: float = COVERED,
                   block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row (id, item_id, coverage, tiles, longest) per document and item of which ``covered`` lies under tiles.

    Documents without a match give no row; null and empty texts match nothing.
    Repeated documents give a row each; a repeated benchmark row counts once, and
    an id with several texts gives a row per text. An empty benchmark, or no
    documents, gives no rows. Items of fewer than ``LEAST`` words never match: so
    short a run stands in clean documents too; ``too_short`` counts them.
    """
    kind = benchmark.schema[item_col].dataType.simpleString()
    ids = docs.select(F.col(id_col), or_empty(text_col).alias("tiled_text"))
    out = None
    for block in blocks(benchmark, item_col, item_text, block_words):
        found = ids.select(id_col, F.explode(matches(F.col("tiled_text"), block, kind, docs.sparkSession, covered)).alias("m"))
        found = found.select(id_col, "m.*")
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = ids.limit(0).select(id_col, *[F.lit(None).cast(t).alias(n) for n, t in (
            ("item_id", kind), ("coverage", "double"), ("tiles", "int"), ("longest", "int"))])
    return out


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
          item_text: str = "text", covered: float = COVERED, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of ``docs`` that cover no benchmark item; same columns, no shuffle.

    Items of fewer than ``LEAST`` words take no rows away; ``too_short`` counts them.
    """
    kind = benchmark.schema[item_col].dataType.simpleString()
    (found,) = fresh(docs, "found")
    kept = docs
    for block in blocks(benchmark, item_col, item_text, block_words):
        kept = kept.withColumn(found, matches(or_empty(text_col), block, kind, docs.sparkSession, covered))
        kept = kept.filter(F.size(found) == 0).select(*docs.columns)
    return kept
