"""Alignment of two tokenizers' tokens over the same texts.

Both tokenizers encode a blank and the text; a token's end is a byte offset.
The shorter list of ends drives a galloping search into the longer one: steps
double from the last place found, then a binary search closes in. Ends on both
sides cut the tokens into groups, and the difference of a token's rank and that
of the token before it is the range of the other side's tokens it overlaps.

Texts are encoded once. Rows lie in blocks of bounded bytes; a block's distinct
id pairs are counted beside its rows, so a pair that every text holds is one row
a block. The sums over all blocks go back to those that hold the pair, and each
row adds up what its links find there.
"""

from __future__ import annotations

import hashlib
import json
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache
from itertools import repeat
from operator import itemgetter

import numpy as np
import pandas as pd
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillbook.llm.common import file_places, or_empty
from quillbook.llm.token_counts import PATTERN
from quillbook.session import materialize

BYTE_LEVEL = "/opt/tokenizers/byte_bpe_50k.json"
PIECES = "/opt/tokenizers/piece_bpe_32k.model"
#: Text bytes in a block, about: what one task holds at a time.
BLOCK_BYTES = 8 << 20
#: Links that are handed on at once; only memory depends on it.
LINKS_AT_ONCE = 1 << 20
#: Chunks of text whose tokens a Python worker remembers.
REMEMBERED = 300_000
LONGEST_REMEMBERED = 64
#: A pre-token ends here in both vocabularies: after a character that is no white space, before a blank.
CUT = re.compile(r"(?<=\S)(?= )")
#: Where this occurs, not every blank is a cut.
BLANKS = re.compile(r"(?:^|\s) ")
COUNTS = ("n_a", "n_b", "n_groups", "n_links")


def gallop(shorter: list[int], longer: list[int]) -> list[int]:
    """For each of ``shorter``, how many of ``longer`` are smaller; both ascend, and no value is above the last of ``longer``."""
    ranks, at, last = [], 0, len(longer) - 1
    for end in shorter:
        top, step = at, 1
        while longer[top] < end:
            at, top, step = top + 1, min(top + step, last), 2 * step
        if at < top:
            at = bisect_left(longer, end, at, top)
        ranks.append(at)
    return ranks


@dataclass
class Alignment:
    """Two texts' tokens over the same bytes: which ends they share and which tokens overlap."""

    a_common: np.ndarray
    b_common: np.ndarray
    a_link: np.ndarray
    b_link: np.ndarray

    @classmethod
    def of(cls, a_ends: np.ndarray, b_ends: np.ndarray) -> Alignment:
        """Of ascending byte ends, both with the same last one; two empty arrays share nothing."""
        if len(a_ends) > len(b_ends):
            other = cls.of(b_ends, a_ends)
            return cls(other.b_common, other.a_common, other.b_link, other.a_link)
        ranks = np.array(gallop(a_ends.tolist(), b_ends.tolist()), np.int64)
        shared = b_ends[ranks] == a_ends
        # the first token of the longer side that a token overlaps follows all that end where it begins, or before
        first = np.concatenate([np.zeros(1, np.int64), (ranks + shared)[:-1]])[:len(ranks)]
        width = ranks - first + 1
        driver = np.repeat(np.arange(len(ranks)), width)
        before = np.cumsum(width) - width
        return cls(np.flatnonzero(shared), ranks[shared], driver, np.arange(len(driver)) + (first - before)[driver])


def byte_of_character() -> dict[str, int]:
    """Byte-level vocabularies write a printable byte as itself and the others as characters from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class Pair:
    """The two tokenizers, their tokens' bytes, and the tokens of the chunks met last."""

    def __init__(self, byte_level: bytes, pieces: bytes):
        model = json.loads(byte_level)["model"]
        table = byte_of_character()
        self.a_bytes = {i: bytes(table[c] for c in token) for token, i in model["vocab"].items() if all(c in table for c in token)}
        merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        if [model["vocab"][m] for m in merged] != list(range(256, 256 + len(merged))):
            raise ValueError("the vocabulary's ids don't follow its merges")
        ranks = {self.a_bytes[i]: i for i in range(256 + len(merged))}
        self.a = tiktoken.Encoding("byte level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_proto=pieces)
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = {i: bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)}
        #: chunks stand alone where no piece goes over a cut
        self.cuts = not any("▁" in p.lstrip("▁") for p in names)
        self.remembered: dict[str, tuple | None] = {}

    @cached_property
    def lengths(self) -> tuple[np.ndarray, np.ndarray]:
        return tuple(np.array([len(t.get(i, b"")) for i in range(max(t) + 1)], np.int64) for t in (self.a_bytes, self.b_bytes))

    @cached_property
    def names(self) -> tuple[np.ndarray, ...]:
        """Decimal ids with what may follow them: a comma inside a group, a bar or a semicolon at the end of its side."""
        (a, b) = self.lengths
        return tuple(np.array([f"{i}{c}" for i in range(n)], object) for n, c in ((len(a), ","), (len(a), "|"), (len(b), ","), (len(b), ";")))

    def learn(self, chunks: list[str]) -> dict[str, tuple | None]:
        """Tokens of a blank and each of the chunks, as bytes of their ids; None where the bytes of the second's differ from these."""
        out = {}
        for chunk, b in zip(chunks, map(self.b.encode, chunks), strict=True):
            b = b or [self.b.piece_to_id("▁")]  # it puts no blank before an empty text
            chunk_and_blank = " " + chunk
            same = b"".join(map(self.b_bytes.__getitem__, b)) == chunk_and_blank.encode()
            out[chunk] = tuple(np.array(x, np.int32).tobytes() for x in (self.a.encode_ordinary(chunk_and_blank), b)) if same else None
        return out

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of a blank and the text by both; None for an empty text, and where joined bytes differ from it.

        A byte-level vocabulary has a token for every byte, so the first one's bytes never differ.
        """
        if not text:
            return None
        if not self.cuts:
            chunks = [text]
        elif BLANKS.search(text):
            chunks = [c[1:] for c in CUT.split(" " + text)]
        else:
            chunks = text.split(" ")
        entries = list(map(self.remembered.get, chunks, repeat(False)))
        if False in entries:
            new = self.learn(list({c for c, e in zip(chunks, entries, strict=True) if e is False}))
            entries = [new[c] if e is False else e for c, e in zip(chunks, entries, strict=True)]
            if len(self.remembered) < REMEMBERED:
                self.remembered.update((c, e) for c, e in new.items() if len(c) <= LONGEST_REMEMBERED)
        if None in entries:
            return None
        return tuple(np.frombuffer(b"".join(map(itemgetter(side), entries)), np.int32).astype(np.int64) for side in (0, 1))

    def align(self, ids: tuple[np.ndarray, np.ndarray]) -> Alignment:
        return Alignment.of(*(np.cumsum(length[i]) for length, i in zip(self.lengths, ids, strict=True)))

    def codes(self, ids: tuple[np.ndarray, np.ndarray], found: Alignment) -> np.ndarray:
        """One number for the two ids of each link, below the product of the vocabularies' sizes."""
        return ids[0][found.a_link] * len(self.lengths[1]) + ids[1][found.b_link]

    def groups(self, ids: tuple[np.ndarray, np.ndarray], found: Alignment) -> str:
        """``a1,a2|b1;a3|b2,b3``: the ids of each group, the first tokenizer's before the second's."""
        a, b = ids
        a_comma, a_bar, b_comma, b_semicolon = self.names
        out = np.empty(len(a) + len(b), object)
        b_before = np.concatenate([[0], found.b_common[:-1] + 1])  # tokens of the other side that come first, by group
        a_before = found.a_common + 1
        sizes = np.diff(found.a_common, prepend=-1), np.diff(found.b_common, prepend=-1)
        a_at = np.arange(len(a)) + np.repeat(b_before, sizes[0])
        b_at = np.arange(len(b)) + np.repeat(a_before, sizes[1])
        out[a_at], out[b_at] = a_comma[a], b_comma[b]
        out[a_at[found.a_common]] = a_bar[a[found.a_common]]
        out[b_at[found.b_common]] = b_semicolon[b[found.b_common]]
        return "".join(out.tolist())[:-1]


@lru_cache(1)
def pair_of(byte_level: bytes, pieces: bytes) -> Pair:
    return Pair(byte_level, pieces)


def in_blocks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(block, id, text) of every row: neighbours in a file share a block, the same in every pass over the table."""
    slim = docs.select(F.col(id_col).cast("string").alias("id"), or_empty(text_col).alias("text"))
    placed = file_places(slim)
    if placed is None:
        slim = materialize(slim)
        placed = file_places(slim)
    found, path, index = placed
    total = slim.agg(F.sum(F.octet_length("text") + 64).alias("bytes"), F.count("*").alias("rows")).first()
    rows = max(1, BLOCK_BYTES * total["rows"] // max(total["bytes"] or 0, 1))
    return found.select(F.xxhash64(path, F.floor(index / rows)).alias("block"), "id", "text")


def align(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", byte_level: str = BYTE_LEVEL,
          pieces: str = PIECES, with_groups: bool = False) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) per row of ``docs``.

    groups_sha256 is the digest of ``Pair.groups``, that text follows as groups
    if asked for; count_sum adds up, over the row's
    links, how many links of the whole table hold the same two ids, and n_best
    counts those links whose pair has the highest count of its second id, ties
    included. A null or empty text, and one whose tokens' bytes are not a blank
    and its own, has zeros and '' for both. Repeated rows count as often as
    they occur; a null id is a row like any other; an empty table gives no rows.
    Other columns of ``docs``, whatever their names, play no part.
    """
    files = []
    for path in (byte_level, pieces):
        with open(path, "rb") as file:  # on the driver; the tasks get the bytes
            files.append(file.read())
    sent = docs.sparkSession.sparkContext.broadcast(tuple(files))  # two files of about a megabyte
    sizes = [len(x) for x in pair_of(*files).lengths]
    number = np.int32 if sizes[0] * sizes[1] < 1 << 31 else np.int64
    columns = ["block", "id", *COUNTS, "groups_sha256", "groups", "links", "times"]

    def encoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A row for each text; behind the rows of a block its distinct links, and how often each occurs."""
        pair, block, links, out, held = pair_of(*sent.value), None, [], [], 0

        def block_row() -> list:
            found, times = np.unique(np.concatenate(links), return_counts=True)
            return [(block, None, 0, 0, 0, 0, None, None, found.astype(number), times)]

        for batch in batches:
            for at, key, text in zip(batch.block.tolist(), batch.id, batch.text, strict=True):
                if links and (at != block or held > LINKS_AT_ONCE):
                    yield pd.DataFrame(out + block_row(), columns=columns)
                    links, out, held = [], [], 0
                block = at
                if ids := pair.encode(text):
                    found = pair.align(ids)
                    groups, codes = pair.groups(ids, found), pair.codes(ids, found).astype(number)
                    counts = len(ids[0]), len(ids[1]), len(found.a_common), len(codes)
                    digest = hashlib.sha256(groups.encode()).hexdigest()
                else:
                    groups, digest, codes, counts = "", "", np.zeros(0, number), (0, 0, 0, 0)
                out.append((block, key, *counts, digest, groups if with_groups else None, codes, None))
                links.append(codes)
                held += len(codes) + 16
        yield pd.DataFrame(out + block_row() if links else out, columns=columns)

    kind = "int" if number is np.int32 else "long"
    schema = (f"block long, id string, {', '.join(f'{c} long' for c in COUNTS)}, groups_sha256 string, groups string, "
              f"links array<{kind}>, times array<long>")
    made = materialize(in_blocks(docs, id_col, text_col).mapInPandas(encoded, schema))
    met = made.filter("times IS NOT NULL").select("block", F.explode(F.arrays_zip("links", "times")).alias("m")).select(
        "block", F.col("m.links").alias("pair"), F.col("m.times").alias("n"))
    sums = met.groupBy("pair").agg(F.sum("n").alias("count")).withColumn("second", F.col("pair") % sizes[1])
    best = sums.groupBy("second").agg(F.max("count").alias("highest"))
    known = sums.join(best, "second").select("pair", "count", (F.col("count") == F.col("highest")).alias("best"))
    asked = met.select(F.col("block").alias("holder"), "pair").join(known, "pair").select("holder", "pair", "count", "best")

    def judge(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        asked = asked.sort_values("pair")
        pairs, counts, best = (asked[c].to_numpy() for c in ("pair", "count", "best"))
        at = [np.searchsorted(pairs, links) for links in rows.links]
        return rows.drop(columns=["block", "links"]).assign(n_best=[int(best[x].sum()) for x in at], count_sum=[int(counts[x].sum()) for x in at])

    texts = made.filter("times IS NULL").drop("times")
    result = [*COUNTS, "n_best", "count_sum", "groups_sha256"]
    judged = texts.groupBy("block").cogroup(asked.groupBy("holder")).applyInPandas(
        judge, f"id string, {', '.join(f'{c} long' for c in COUNTS)}, groups_sha256 string, groups string, n_best long, count_sum long")
    return judged.select(F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), *result, *["groups"] * with_groups)
