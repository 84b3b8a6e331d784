"""Token counts that follow edits.

A document's text is cut into leaves at places where a pre-token always ends: a
character that is no white space, followed by a blank. A byte-pair encoder
never merges over such a place, so a text's count is the sum over its leaves. A
binary tree over the leaves holds characters and tokens of every subtree. An
edit is found by descending the character sums; only the leaves that it
touches are encoded again, and their neighbours where it touches a cut, and
the sums above them are renewed.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillbook.llm.common import fresh, or_empty

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pre-tokens of the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters after which a leaf ends at the next cut.
LEAF_CHARS = 256
LEAF = re.compile(rf"(?s).{{{LEAF_CHARS - 1}}}.*?\S(?= )|.+")
EDITS = "array<struct<start: int, length: int, text: string>>"


@lru_cache(4)
def encoder(ranks: bytes, pattern: str) -> tiktoken.Encoding:
    merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("counts", pat_str=pattern, mergeable_ranks=merges, special_tokens={})


@dataclass
class Vocabulary:
    """A vocabulary file's bytes: they travel to the tasks, which need no file."""

    ranks: bytes
    pattern: str = PATTERN

    @classmethod
    def load(cls, path: str = VOCABULARY, pattern: str = PATTERN) -> Vocabulary:
        with open(path, "rb") as file:
            return cls(file.read(), pattern)

    def count(self, text: str) -> int:
        return len(encoder(self.ranks, self.pattern).encode_ordinary(text))


def sums(leaves: list[int]) -> list[int]:
    """Tree over the leaves: node i has children 2i and 2i + 1, the root is 1, leaves stand in the last half."""
    width = 1
    while width < len(leaves):
        width *= 2
    tree = np.zeros(2 * width, np.int64)
    tree[width:width + len(leaves)] = leaves
    while width > 1:
        tree[width // 2:width] = tree[width:2 * width].reshape(-1, 2).sum(1)
        width //= 2
    return tree.tolist()


class Tree:
    """A text with the character and token sums of its leaves."""

    def __init__(self, text: str, chars: list[int], tokens: list[int]):
        self.chars, self.tokens = list(chars), list(tokens)
        self.texts, at = [], 0
        for n in self.chars[len(self.chars) // 2:]:
            self.texts.append(text[at:at + n])
            at += n

    @staticmethod
    def sums(text: str, vocabulary: Vocabulary) -> tuple[list[int], list[int]]:
        leaves = LEAF.findall(text)
        return sums([len(x) for x in leaves]), sums([vocabulary.count(x) for x in leaves])

    def find(self, at: int) -> tuple[int, int]:
        """Leaf that holds the character ``at``, and where the leaf begins; the last character's leaf at the end."""
        node, start, at = 1, 0, max(0, min(at, self.chars[1] - 1))
        while node < len(self.texts):
            node *= 2
            if at >= start + self.chars[node]:
                start += self.chars[node]
                node += 1
        return node - len(self.texts), start

    def put(self, leaf: int, text: str, vocabulary: Vocabulary) -> None:
        node = leaf + len(self.texts)
        more = len(text) - self.chars[node], (vocabulary.count(text) if text else 0) - self.tokens[node]
        self.texts[leaf] = text
        while node:
            self.chars[node] += more[0]
            self.tokens[node] += more[1]
            node //= 2

    def edit(self, start: int, length: int, new: str, vocabulary: Vocabulary) -> int:
        """Replace ``length`` characters at ``start``; returns the characters encoded again."""
        start = max(0, min(start, self.chars[1]))
        end = min(start + max(0, length), self.chars[1])
        # a cut stays one if the characters on both sides of it do: those beside the edit count as touched
        first, begin = self.find(start - 1)
        last, at = self.find(end)
        region = "".join(self.texts[first:last + 1])
        region = region[:start - begin] + new + region[end - begin:]
        parts, slots = LEAF.findall(region), last - first + 1
        if len(parts) <= slots:
            for i in range(slots):
                self.put(first + i, parts[i] if i < len(parts) else "", vocabulary)
        else:  # more leaves than there were: the sums are laid out anew, nothing else is encoded
            half = len(self.texts)
            counts = self.tokens[half:]
            kept = [(t, n) for t, n in zip(self.texts[:first], counts[:first], strict=True) if t]
            kept += [(p, vocabulary.count(p)) for p in parts]
            kept += [(t, n) for t, n in zip(self.texts[last + 1:], counts[last + 1:], strict=True) if t]
            self.chars, self.tokens = sums([len(t) for t, _ in kept]), sums([n for _, n in kept])
            self.texts = [t for t, _ in kept] + [""] * (len(self.chars) // 2 - len(kept))
        return len(region)

    def text(self) -> str:
        return "".join(self.texts)


def whole(number: float | None) -> int:
    """A number as Arrow's arrays hand it over, beside nulls as a float; null is 0."""
    return 0 if number is None or number != number else int(number)


def with_trees(docs: DataFrame, text_col: str = "text", vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """``docs`` with n_tokens and the trees tree_chars and tree_tokens of each text.

    A null or empty text has no tokens and a tree of one empty leaf. Repeated rows
    have trees of their own. An added column whose name is taken gets an
    underscore at its end.
    """
    tree, *names = fresh(docs, "tree", "n_tokens", "tree_chars", "tree_tokens")
    sent = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(vocabulary, pattern))  # a file of about a megabyte

    def build(texts: pd.Series) -> pd.DataFrame:
        made = [Tree.sums(t, sent.value) for t in texts]
        return pd.DataFrame({"n": [t[1][1] for t in made], "c": [t[0] for t in made], "t": [t[1] for t in made]})

    found = F.pandas_udf(build, "n long, c array<int>, t array<int>")(or_empty(text_col))
    return docs.withColumn(tree, found).select(*docs.columns, *[F.col(tree)[c].alias(n) for c, n in zip("nct", names, strict=True)])


def recount(trees: DataFrame, edits_col: str, text_col: str = "text", chars_col: str = "tree_chars", tokens_col: str = "tree_tokens",
            vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """``trees`` with new_tokens, new_chars and encoded_chars after the edits of each row, in a column of type ``EDITS``.

    Edits apply in order, each to the text that the one before left. start
    counts characters from 0; one beyond the text means its end, a negative one
    its start; a length beyond the text ends with it. A null list has no edits,
    and a null edit or replacement inserts nothing. encoded_chars counts what was
    encoded again.
    """
    out, *names = fresh(trees, "recounted", "new_tokens", "new_chars", "encoded_chars")
    sent = trees.sparkSession.sparkContext.broadcast(Vocabulary.load(vocabulary, pattern))

    def apply(texts: pd.Series, chars: pd.Series, tokens: pd.Series, edits: pd.Series) -> pd.DataFrame:
        rows = []
        for text, c, t, todo in zip(texts, chars, tokens, edits, strict=True):
            tree, encoded = Tree(text, c, t), 0
            for e in todo if todo is not None else ():
                if e is not None:
                    encoded += tree.edit(whole(e["start"]), whole(e["length"]), e["text"] or "", sent.value)
            rows.append((tree.tokens[1], tree.chars[1], encoded))
        return pd.DataFrame(rows, columns=["a", "b", "c"], dtype="int64")

    found = F.pandas_udf(apply, "a long, b long, c long")(
        or_empty(text_col), F.col(chars_col), F.col(tokens_col), F.col(edits_col).cast(EDITS))
    return trees.withColumn(out, found).select(*trees.columns, *[F.col(out)[c].alias(n) for c, n in zip("abc", names, strict=True)])


def apply_edits(docs: DataFrame, edits: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY,
                pattern: str = PATTERN) -> DataFrame:
    """(id, n_tokens, new_tokens, n_edits, encoded_chars) per row of ``docs``, for a table of edits (id, seq, start, length, text).

    A document and its edits stream through one task in the order of seq, so a
    document with very many edits is never gathered. Ids must not repeat in
    ``docs``; of rows that share one, each counts, and the last by text takes the
    edits. Edits of an unknown or null id are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(vocabulary, pattern))
    kind = docs.schema[id_col].dataType.simpleString()
    none = F.lit(None)
    rows = docs.select(
        F.col(id_col).cast("string").alias("key"), F.lit(0).alias("kind"), none.cast("long").alias("seq"), none.cast("int").alias("start"),
        none.cast("int").alias("length"), or_empty(text_col).alias("text"))
    todo = edits.select(
        F.col(id_col).cast("string").alias("key"), F.lit(1).alias("kind"), F.col("seq").cast("long").alias("seq"),
        F.coalesce(F.col("start").cast("int"), F.lit(0)).alias("start"), F.coalesce(F.col("length").cast("int"), F.lit(0)).alias("length"),
        or_empty("text").alias("text")).filter("key IS NOT NULL")
    ordered = rows.unionByName(todo).repartition("key").sortWithinPartitions("key", "kind", "seq", "start", "length", "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, tree, before, edited, encoded = None, None, 0, 0, 0
        columns = ["key", "n_tokens", "new_tokens", "n_edits", "encoded_chars"]
        for batch in batches:
            out = []
            for k, kind_, start, length, text in zip(batch.key, batch.kind, batch.start, batch.length, batch.text, strict=True):
                if kind_ == 0:
                    if tree:
                        out.append((key, before, tree.tokens[1], edited, encoded))
                    tree = Tree(text, *Tree.sums(text, sent.value))
                    key, before, edited, encoded = k, tree.tokens[1], 0, 0
                elif tree and k == key:
                    encoded += tree.edit(int(start), int(length), text, sent.value)
                    edited += 1
            yield pd.DataFrame(out, columns=columns)
        if tree:
            yield pd.DataFrame([(key, before, tree.tokens[1], edited, encoded)], columns=columns)

    schema = "key string, n_tokens long, new_tokens long, n_edits long, encoded_chars long"
    return ordered.mapInPandas(run, schema).select(F.col("key").cast(kind).alias(id_col), "n_tokens", "new_tokens", "n_edits", "encoded_chars")
