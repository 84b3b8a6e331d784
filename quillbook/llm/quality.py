"""Quality rules judged by an isolation forest over rule statistics.

Each document's text is reduced to a few statistics. A forest of random split
trees is grown on the labelled rows, each tree on a random draw of its own from
all of them; a document that few splits isolate is unlike the good ones. The
verdict's threshold comes from the scores of all labelled rows: it is set where
a stated share of the good ones stays.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillbook.llm.common import fresh, or_empty
from quillbook.llm.overlap import mixed
from quillbook.session import materialize

SYMBOLS = re.compile(r"[#*$%&|<>]")
WORD = re.compile(r"[^\x20\x09-\x0D]")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("words", "word_length", "symbols", "repeats", "dup_lines", "upper", "distinct", "top_word")
MAX_DEPTH = 10
#: Trees of the forest, and rows that each of them draws from all good ones.
TREES, DRAWN = 128, 256
#: Cells in which scores are counted at once in search of a rank.
CELLS = 1024


def statistics(text: str) -> tuple[list[int], list[float]]:
    """Rule counts of a text (``COUNTS``) and the forest's features (``FEATURES``)."""
    words = text.encode().split()  # bytes: only ASCII white space divides
    n = len(words)
    if not n:
        return [0, 0, len(SYMBOLS.findall(text)), 0, 0], [0.0] * len(FEATURES)
    chars = len(b"".join(words).decode())
    symbols = len(SYMBOLS.findall(text))
    lines = [line for line in text.split("\n") if WORD.search(line)]
    dups = len(lines) - len(set(lines))
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    ids = np.fromiter(map(number.__getitem__, words), np.int64, n)
    repeats = 0
    if n > 3:
        pairs = ids[:-1] * len(number) + ids[1:]
        pairs = np.unique(pairs, return_inverse=True)[1]
        windows = pairs[:-1] * len(number) + ids[2:]
        _, which, times = np.unique(windows, return_inverse=True, return_counts=True)
        again = times[which] > 1
        covered = np.zeros(n, bool)
        for shift in range(3):
            covered[shift:n - 2 + shift] |= again
        repeats = int(covered.sum())
    upper = sum(map(str.isupper, text))
    features = [
        np.log1p(n), min(chars / n, 40.0), min(symbols / n, 4.0), repeats / n, dups / len(lines), upper / chars,
        np.log1p(len(number)) / np.log1p(n), int(np.bincount(ids).max()) / n,
    ]
    return [n, chars, symbols, dups, repeats], [float(x) for x in features]


def base_failed(counts: np.ndarray) -> np.ndarray:
    """Fewer than 50 words, or more than half of them in repeated three-word windows."""
    return (counts[:, 0] < 50) | (100 * counts[:, 4] > 50 * counts[:, 0])


@dataclass
class Forest:
    """Trees as flat arrays: node i has children 2i+1 and 2i+2; a leaf has feature -1 and holds its path length."""

    feature: np.ndarray
    split: np.ndarray
    length: np.ndarray
    sample: int
    threshold: float = np.inf

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Anomaly scores in (0, 1): 2 to the power of minus mean path length over that of a random tree."""
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for feature, split, length in zip(self.feature, self.split, self.length, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(MAX_DEPTH):
                at = feature[node]
                node = np.where(at < 0, node, 2 * node + 1 + (x[rows, np.maximum(at, 0)] >= split[node]))
            total += length[node]
        return 2.0 ** (-total / (len(self.feature) * max(float(mean_path(np.array([self.sample]))[0]), 1e-9)))


def mean_path(n: np.ndarray) -> np.ndarray:
    """Mean path length of an unsuccessful search in a random binary tree of n rows."""
    n = np.maximum(np.asarray(n, float), 1)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + np.euler_gamma) - 2 * (n - 1) / n, n - 1)


def grow(x: np.ndarray | list[np.ndarray], low: np.ndarray, high: np.ndarray, trees: int = TREES, sample: int = DRAWN, seed: int = 7) -> Forest:
    """Isolation trees over random subsamples of the rows of ``x``, or over those of a list, one for each tree.

    A node stands for a box of the feature space, at first from ``low`` to
    ``high``, and is cut at a random place of a random side; so a value that no
    row of ``x`` has, such as symbols where good documents have none, is cut off
    early too.
    """
    random, nodes = np.random.default_rng(seed), (1 << (MAX_DEPTH + 1)) - 1
    feature = np.full((trees, nodes), -1, np.int16)
    split, length = np.zeros((trees, nodes)), np.zeros((trees, nodes))
    drawn = isinstance(x, list)
    size, usable = len(x[0]) if drawn else min(sample, len(x)), np.flatnonzero(high > low)
    for tree in range(trees):
        waiting = [(0, 0, x[tree] if drawn else x[random.choice(len(x), size, replace=False)], low, high)]
        while waiting:
            node, depth, rows, start, end = waiting.pop()
            if depth == MAX_DEPTH or len(rows) < 2 or not len(usable):
                length[tree, node] = depth + mean_path(np.array([len(rows)]))[0]
                continue
            at = int(random.choice(usable))
            cut = random.uniform(start[at], end[at])
            right = rows[:, at] >= cut
            feature[tree, node], split[tree, node] = at, cut
            inner = np.arange(len(low)) == at
            waiting += [(2 * node + 1, depth + 1, rows[~right], start, np.where(inner, cut, end)),
                        (2 * node + 2, depth + 1, rows[right], np.where(inner, cut, start), end)]
    return Forest(feature, split, length, size)


def draws(good: DataFrame, n_good: int, columns: list[str], trees: int = TREES, size: int = DRAWN) -> list[np.ndarray]:
    """For each tree its own random ``size`` rows of ``good`` (id, columns), all where there are fewer.

    A row has a random number for each tree, made from the hash of its id; a tree takes the smallest. Only numbers
    below a bound that leaves about 200 rows more than needed reach the driver, whatever the number of rows.
    """
    size = min(size, n_good)
    seeds = mixed(np.arange(1, trees + 1, dtype=np.uint64))

    def drawn(share: float) -> list[np.ndarray]:
        bound = np.uint64(min(share * 2.0 ** 64, 2.0 ** 64 - 2048))

        def lots(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                lot = mixed(batch.hash.to_numpy().view(np.uint64)[:, None] ^ seeds)
                row, tree = np.nonzero(lot <= bound if share < 1 else np.ones_like(lot, bool))
                yield batch[columns].iloc[row].assign(tree=tree, lot=(lot[row, tree] >> np.uint64(1)).astype(np.int64))

        schema = ", ".join(f"{c} double" for c in columns) + ", tree long, lot long"
        found = good.select(F.xxhash64("id").alias("hash"), *columns).mapInPandas(lots, schema).toPandas()
        found = found.sort_values(["tree", "lot", *columns]).groupby("tree").head(size)
        return [some[columns].to_numpy() for _, some in found.groupby("tree")]

    share = (size + 200) / n_good
    some = drawn(share)
    if len(some) < trees or min(map(len, some)) < size:
        some = drawn(min(1.0, 4 * share))
    return some


def value_at(scores: DataFrame, rank: int) -> float:
    """The value of the given rank, from 0, of the column ``score``, by counts in ever smaller cells."""
    low, high = scores.agg(F.min("score"), F.max("score")).first()
    while low < high:
        width = (high - low) / CELLS
        cell = F.least(F.floor((F.col("score") - low) / width), F.lit(CELLS - 1)) if width > 0 else F.col("score")
        cells = scores.filter(F.col("score").between(low, high)).groupBy(cell.alias("cell")).agg(
            F.count("*").alias("n"), F.min("score").alias("low"), F.max("score").alias("high")).orderBy("low").collect()
        for found in cells:
            if rank < found.n:
                low, high = found.low, found.high
                break
            rank -= found.n
    return low


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        good_share: float = 0.998) -> Forest | None:
    """Forest and threshold from all labelled rows, or None without good ones.

    Trees grow on rows labelled good that pass the base rules; every such row
    may be drawn by each tree. The threshold leaves ``good_share`` of them all,
    and moves outwards to the middle of the gap up to the next score of a row
    labelled bad, so good documents a little outside stay too. Texts are not
    shuffled: their statistics meet the labels.
    """
    usable = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
    marked = usable.groupBy(F.col("doc_id").cast("string").alias("id")).agg(F.min("quality").cast("int").alias("label"))
    columns = [f"x{i}" for i in range(len(FEATURES))]

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [statistics(t) for t in batch.text]
            counts = np.array([f[0] for f in found], np.int64).reshape(-1, len(COUNTS))
            out = pd.DataFrame(np.array([f[1] for f in found], float).reshape(-1, len(columns)), columns=columns)
            yield out.assign(failed=base_failed(counts), id=batch.id.to_numpy())

    schema = ", ".join(f"{c} double" for c in columns) + ", failed boolean, id string"
    texts = docs.select(F.col(id_col).cast("string").alias("id"), or_empty(text_col).alias("text")).filter("id IS NOT NULL")
    rows = texts.mapInPandas(measure, schema).join(marked, "id")
    # an id may occur on many rows: one row of each is enough
    rows = rows.groupBy("id").agg(F.min(F.struct(*columns, "label", "failed")).alias("row")).select("id", "row.*")
    rows = materialize(rows.filter("NOT failed AND label IN (0, 1)"))
    good = rows.filter("label = 1")
    n_good = good.count()
    if n_good < 2:
        return None
    ends = rows.agg(*[f(c) for f in (F.min, F.max) for c in columns]).first()
    low, high = np.array(ends, float).reshape(2, -1)
    forest = grow(draws(good, n_good, columns), low, high)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"label": batch.label, "score": forest.scores(batch[columns].to_numpy())})

    scores = materialize(rows.select("label", *columns).mapInPandas(score, "label int, score double"))
    edge = value_at(scores.filter("label = 1"), min(n_good - 1, int(np.ceil(good_share * n_good)) - 1))
    beyond = scores.filter((F.col("label") == 0) & (F.col("score") > edge)).agg(F.min("score")).first()[0]
    forest.threshold = float((edge + (1 if beyond is None else beyond)) / 2)
    return forest


def judge(docs: DataFrame, forest: Forest | None, text_col: str = "text") -> DataFrame:
    """``docs`` with the rule counts, base_failed, score and kept, in one pass without a shuffle.

    A null or empty text has zero counts and fails the base rules. Without a
    forest (no labelled rows) the base rules alone decide. Repeated rows are
    judged alike. Columns of ``docs`` may have any name: an added column whose
    name is taken gets an underscore at its end.
    """
    added = fresh(docs, *COUNTS, "base_failed", "score", "kept")
    (text,) = fresh(docs, "judged_text")

    def verdicts(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            found = [statistics(t) for t in texts]
            counts = np.array([f[0] for f in found], np.int64).reshape(-1, len(COUNTS))
            features = np.array([f[1] for f in found], float).reshape(-1, len(FEATURES))
            failed = base_failed(counts)
            scores = forest.scores(features) if forest else np.zeros(len(failed))
            out = pd.DataFrame(counts, columns=list(COUNTS))
            yield out.assign(base_failed=failed, score=scores, kept=~failed & (scores <= (forest.threshold if forest else 1)))

    schema = ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, score double, kept boolean"

    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        yield from verdicts(batches)

    of.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    found = F.pandas_udf(of, schema)(or_empty(text_col))
    return docs.withColumn(text, found).select(
        *docs.columns, *[F.col(text)[c].alias(n) for c, n in zip((*COUNTS, "base_failed", "score", "kept"), added, strict=True)])


def passing(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the rules and the forest keep; same columns."""
    judged = judge(docs, fit(docs, labels, id_col, text_col), text_col)
    return judged.filter(F.col(judged.columns[-1])).select(*docs.columns)
