"""Near copies at five-word Jaccard 0.8 against brute force."""

import random
import re

import corpus_pipeline
import pytest

from quillbook.llm import overlap

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def plain_set(text, words=5):
    each = (text or "").encode().lower().split()
    return frozenset(tuple(each[i:i + words]) for i in range(max(1, len(each) - words + 1))) if each else frozenset()


def plain_kept(rows):
    """Smallest id of each component of all pairs at 0.8 or more."""
    sets, root = {i: plain_set(t) for i, t in rows}, {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            x, y = sets[a], sets[b]
            if x == y or 5 * len(x & y) >= 4 * len(x | y) and x & y:
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {find(i) for i in ids}


def edited(draw, words, changes):
    words = list(words)
    for _ in range(changes):
        words[draw.randrange(len(words))] = f"new{draw.randrange(10 ** 9)}"
    return " ".join(words)


@pytest.mark.parametrize("pairs", [1 << 16, 4])
def test_near_copies_against_brute_force(spark, monkeypatch, pairs):
    monkeypatch.setattr(overlap, "PAIRS_AN_EDIT", pairs)
    draw = random.Random(2)
    texts = ["", None, " \n", "One two", "one  TWO", "one three"]
    for n in (6, 20, 60, 200, 1500):
        for _ in range(8):
            base = [f"w{draw.randrange(5000)}" for _ in range(n)]
            texts += [edited(draw, base, draw.randint(0, max(1, n // 25))) for _ in range(6)]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = overlap.one_per_group(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(plain_kept(rows))


def test_copies_of_copies_against_brute_force(spark, monkeypatch):
    """Half of the copies are too far from the text they were made of; some of these have near copies of their own."""
    monkeypatch.setattr(overlap, "PAIRS_AN_EDIT", 30)
    draw = random.Random(8)
    base = [f"w{i}" for i in range(120)]
    texts = [edited(draw, base, draw.randint(0, 7)) for _ in range(150)]
    for _ in range(4):
        far = edited(draw, base, 9).split(" ")
        texts += [edited(draw, far, draw.randint(0, 5)) for _ in range(30)]
    rows = list(enumerate(texts))
    kept = overlap.one_per_group(spark.createDataFrame(rows, "doc_id long, text string"))
    wanted = plain_kept(rows)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(wanted) and 5 < len(wanted) < 200


def test_met_pairs_follow_the_number_of_copies(spark):
    counts = []
    for n in (250, 1000):
        draw = random.Random(9)
        base = [f"w{i}" for i in range(120)]
        sets = [overlap.shingles(edited(draw, base, draw.randint(2, 8)), 5) for _ in range(n)]
        rows = [(i, x.view("int64").tolist()) for i, x in enumerate(sets)]
        stored = spark.createDataFrame(rows, "node long, shingles array<long>")
        compared = overlap.against_leaders(stored.selectExpr("1L AS band", "node"), stored)
        assert compared.count() == n - 1
        alone = compared.select("node", "node").toDF("node", "root")
        counts.append(overlap.meeting(overlap.edits_of(compared, alone, stored, 0.8), 0.8).count())
    assert counts[0] < 3 * 250 and counts[1] < 3 * 1000  # of 31,125 and 499,500 pairs


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    wanted = plain_kept([(r.doc_id, r.text) for r in docs.collect()])
    assert sorted(r.doc_id for r in overlap.one_per_group(docs).collect()) == sorted(wanted)


def test_stage_takes_copies_with_words_changed(spark):
    draw = random.Random(4)
    base = [f"word{i}" for i in range(300)]
    rows = [(i, edited(draw, base, 4 if i else 0), "en", "src0", 0) for i in range(12)] + [(50, " ".join(base[::-1]), "en", "src1", 0)]
    out = corpus_pipeline.simhash_near_dedup(spark, spark.createDataFrame(rows, SCHEMA), "")
    assert sorted(r.doc_id for r in out.collect()) == [0, 50]


def test_odd_rows(spark):
    text = " ".join(f"word{i}" for i in range(300))
    rows = [(9, text, 1, "q"), (3, text, 2, "q"), (3, text, 2, "q"), (None, text, 3, None), (7, None, 4, None), (8, "", 5, None),
            (None, "other words stand here", 6, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, NODE int, row_key string")
    kept = overlap.one_per_group(docs)
    assert kept.columns == docs.columns and sorted(map(str, (r.doc_id for r in kept.collect()))) == ["3", "7", "None"]
    assert overlap.one_per_group(docs.limit(0)).count() == 0


def test_fingerprints_within_two_bits_share_a_bucket_of_the_pipelines_stage(spark, monkeypatch):
    import corpus_pipeline
    from quillbook.llm import overlap

    nodes = spark.createDataFrame([(1, 0), (2, 0b11), (3, 0b1111), (4, -1), (5, 0)], "node long, fp long")
    bands = {}
    for r in overlap.by_fingerprint(nodes).collect():
        bands.setdefault(r.band, set()).add(r.node)
    assert sorted(map(sorted, bands.values())) == [[1, 2, 3, 5], [4]]
    asked, links = [], overlap.links
    monkeypatch.setattr(overlap, "links", lambda prints, bits: asked.append(bits) or links(prints, bits))
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(words), " ".join(words[:-1] + ["x"]), " ".join(reversed(words)), ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = corpus_pipeline.simhash_near_dedup(spark, docs, "")
    assert sorted(r.doc_id for r in kept.collect()) == [0, 2, 3] and asked == [2]


def test_bands_edits_and_sets_are_never_broadcast(spark, monkeypatch):
    """However small Spark takes them for."""
    plans, materialize = [], overlap.materialize
    monkeypatch.setattr(overlap, "materialize", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or materialize(df))
    draw = random.Random(8)
    base = [f"w{i}" for i in range(120)]
    texts = [edited(draw, base, draw.randint(0, 8)) for _ in range(60)]
    overlap.one_per_group(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    joins = {kind: set(re.findall(rf"{kind} \[([^]]*)\]", re.sub(r"#\d+L?", "", "\n".join(plans)))) for kind in ("SortMergeJoin", "BroadcastHashJoin")}
    growing = {"band", "node", "a", "b", "leader, edit"}
    assert growing <= joins["SortMergeJoin"] and not {"band", "a", "b", "leader, edit"} & joins["BroadcastHashJoin"]
