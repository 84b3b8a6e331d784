"""SimHash groups and string tiling against brute force."""

import random
from collections import defaultdict

import numpy as np
import xxhash
from pyspark.sql import functions as F

from quillbook.llm import decontam, simhash

FOLDER = "/root/testdata/sf0.001"


def plain_fingerprint(text):
    words, word = [], b""
    for b in (text or "").encode():
        if b in b" \t\n\x0b\x0c\r":
            words, word = words + ([word] if word else []), b""
        else:
            word += bytes([b + 32 if 65 <= b <= 90 else b])
    words += [word] if word else []
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(prints):
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    every = sorted(set(prints))
    for i, a in enumerate(every):
        for b in every[i + 1:]:
            if (a ^ b).bit_count() <= 2:
                root[find(a)] = find(b)
    return {p: find(p) for p in every}


def test_fingerprints_match_spark(spark):
    texts = ["one two three four five Six É é", "a b", "", None, " \t\n", "x " * 70_000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = [r[0] % (1 << 64) for r in df.orderBy("i").select(simhash.fingerprints(F.col("text"))).collect()]
    assert got[:5] == [plain_fingerprint(t) for t in texts[:5]]
    assert got[5] == plain_fingerprint("x x x x")
    same = spark.range(1).select(F.xxhash64(F.lit("one two three"))).first()[0]
    assert same % (1 << 64) == xxhash.xxh64_intdigest(b"one two three", 42)


def test_near_duplicates_of_given_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = docs.collect()
    prints = {r.doc_id: plain_fingerprint(r.text) for r in rows}
    groups = plain_groups(prints.values())
    least = {}
    for i, p in prints.items():
        least[groups[p]] = min(i, least.get(groups[p], i))
    found = simhash.near_duplicates(docs).collect()
    assert len(found) == len(rows)
    assert {r.doc_id: (r.fp % (1 << 64), r.component_id) for r in found} == {i: (p, least[groups[p]]) for i, p in prints.items()}
    assert sum(r.first for r in found) == len(least)


def test_fingerprints_at_their_anchors_are_never_broadcast(spark):
    """A table of fingerprints that is small for Spark lies at a hundred times as many anchors."""
    prints = spark.range(100).selectExpr("shiftleft(id, 20) AS fp")
    plan = simhash.links(prints)._jdf.queryExecution().executedPlan().toString()
    assert "MapInPandas" in plan and "BroadcastExchange" not in plan


def test_links_lose_none(spark):
    draw = random.Random(1)
    prints = set()
    for _ in range(150):
        base = draw.getrandbits(64)
        for _ in range(6):
            prints.add(base ^ sum(1 << b for b in draw.sample(range(64), draw.randint(0, 3))))
    prints = sorted(np.array(sorted(prints), np.uint64).view(np.int64).tolist())
    df = spark.createDataFrame([(p,) for p in prints], "fp long")
    wanted = {(a, b) for i, a in enumerate(prints) for b in prints[i + 1:] if ((a ^ b) & (1 << 64) - 1).bit_count() <= 2}
    found = [tuple(r) for r in simhash.links(df).collect()]
    assert len(found) == len(set(found)) and set(found) == wanted


def test_code_covers():
    values = np.random.default_rng(3).integers(-(1 << 63), (1 << 63) - 1, 40)
    low = (1 << 46) - 1
    for value, home, anchors in zip(values.tolist(), simhash.homes_of(values).tolist(), simhash.anchors_of(values, 8), strict=True):
        assert home in anchors.tolist() and len(set(anchors.tolist())) == len(anchors)
        assert all(((a ^ value) & low).bit_count() <= 8 for a in anchors.tolist())
        assert ((home ^ value) & low).bit_count() <= 6


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 102), (101, 102), (100, 101)] + [(200, k) for k in range(201, 260)]
    found = dict(tuple(r) for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert found == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, 102: 100, **{k: 200 for k in range(200, 260)}}


def test_near_duplicates_odd_rows(spark):
    text = " ".join(f"word{i}" for i in range(300))
    rows = [(9, text, 1, "q"), (3, text, 2, "q"), (3, text, 2, "q"), (None, text, 3, None), (7, None, 4, None), (8, "", 5, None),
            (None, "other words stand here", 6, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, FP int, row_key string")
    got = [(str(r.doc_id), str(r.component_id)) for r in simhash.near_duplicates(docs).collect()]
    assert sorted(got) == [("3", "3"), ("3", "3"), ("7", "7"), ("8", "7"), ("9", "3"), ("None", "3"), ("None", "None")]
    kept = simhash.one_per_group(docs)
    assert kept.columns == docs.columns and sorted(map(str, (r.doc_id for r in kept.collect()))) == ["3", "7", "None"]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def plain_tiling(text, item):
    """Greedy string tiling by trying every pair of places."""
    a_free, b_free = [True] * len(text), [True] * len(item)
    longest = tiles = 0
    while True:
        best = (0, 0, 0)
        for p in range(len(text)):
            for i in range(len(item)):
                n = 0
                while p + n < len(text) and i + n < len(item) and text[p + n] == item[i + n] and a_free[p + n] and b_free[i + n]:
                    n += 1
                if n > best[0]:
                    best = (n, p, i)
        n, p, i = best
        if n < decontam.LEAST:
            return b_free.count(False), longest, tiles
        longest, tiles = max(longest, n), tiles + 1
        for k in range(n):
            a_free[p + k] = b_free[i + k] = False


def test_tiling_matches_brute_force():
    draw = random.Random(5)
    for trial in range(60):
        words = "abc" if trial % 2 else "abcdefghij"
        item = [draw.choice(words) for _ in range(draw.randint(5, 40))]
        text = [draw.choice(words) for _ in range(draw.randint(5, 60))]
        if trial % 3:
            cut = draw.randint(0, len(item))
            text[3:3] = item[cut:] + ["z"] + item[:cut]
        block = decontam.Block.of([0], [" ".join(item)])
        found = block.matches(" ".join(text), 0.0)
        covered, longest, tiles = plain_tiling(text, item)
        if not tiles:
            assert not found
            continue
        # equally long matches may be marked in another order: the longest tile is the same, the cover may differ by short tiles
        assert found[0]["longest"] == longest
        if len(words) > 3:
            assert abs(found[0]["coverage"] * len(item) - covered) <= decontam.LEAST


def test_periodic_texts():
    block = decontam.Block.of([1], ["a b " * 100])
    assert block.matches("b a " * 3000, 0.4)[0]["coverage"] > 0.98
    assert decontam.Block.of([1], ["a " * 300]).matches("a " * 50_000, 0.4)[0] == {"item_id": 1, "coverage": 1.0, "tiles": 1, "longest": 300}


def test_contaminations(spark):
    item = [f"q{i}" for i in range(40)]
    parts = item[20:] + ["noise"] * 9 + item[:20]
    rows = [(1, "start " + " ".join(item).upper() + " end", 0), (2, " ".join(parts), 0), (3, " ".join(item[:12]), 0), (4, None, 0), (5, "", 0),
            (6, "clean words " * 2000, 0), (6, "clean words " * 2000, 0), (None, " ".join(item), 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, found int")
    bench = spark.createDataFrame(
        [(10, " ".join(item)), (10, " ".join(item)), (11, None), (12, "too short"), (13, "something else that nobody ever wrote down")],
        "item_id int, text string")
    for words in (1_000_000, 30):  # one block, several
        found = decontam.contaminations(docs, bench, block_words=words).collect()
        assert sorted((str(r.doc_id), r.item_id, r.coverage, r.tiles) for r in found) == [
            ("1", 10, 1.0, 1), ("2", 10, 1.0, 2), ("None", 10, 1.0, 1)]
        kept = decontam.clean(docs, bench, block_words=words)
        assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [3, 4, 5, 6, 6]
    assert decontam.contaminations(docs, bench.limit(0)).count() == 0 == decontam.contaminations(docs.limit(0), bench).count()
    short = spark.createDataFrame([(1, "four words, no more"), (2, None), (3, "Größe zählt hier als Wort")], "item_id long, text string")
    assert tuple(decontam.too_short(short).first()) == (3, 2) and tuple(decontam.too_short(short.limit(0)).first()) == (0, 0)
    whole = spark.createDataFrame([(1, "it has four words, no more than that")], "doc_id long, text string")
    assert decontam.contaminations(whole, short).count() == 0
    assert decontam.clean(docs, bench.limit(0)).count() == len(rows)


def test_given_leaks(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    bench = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    items = {r.item_id: decontam.WORD.findall(r.text.lower()) for r in bench.collect()}
    holding = defaultdict(set)
    for r in docs.collect():
        text = " " + " ".join(decontam.WORD.findall((r.text or "").lower())) + " "
        for i, words in items.items():
            if len(words) >= decontam.LEAST and " " + " ".join(words) + " " in text:
                holding[r.doc_id].add(i)
    found = defaultdict(set)
    for r in decontam.contaminations(docs, bench).collect():
        found[r.doc_id].add(r.item_id)
    assert found == holding
