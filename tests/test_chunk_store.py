"""Deletion vectors against a plain list of what was added and deleted."""

import random

import pytest
from pyspark.sql import functions as F

from quillbook.operators.chunk_store import ChunkStore

SCHEMA = "chunk_id string, document_id long, text string, embedding array<float>"


def parts(spark, rows):
    chunks = spark.createDataFrame([r[:3] for r in rows], "chunk_id string, document_id long, text string")
    return chunks, chunks.select("chunk_id", F.array(F.lit(1.0).cast("float")).alias("embedding"))


def ids(spark, documents):
    return spark.createDataFrame([(d,) for d in documents], "document_id long")


def seen(df):
    return sorted((r.chunk_id, r.document_id, r.text) for r in df.collect())


def test_rows_equal_a_plain_list(spark, tmp_path):
    draw = random.Random(3)
    store, plain = ChunkStore(spark, f"{tmp_path}/store", SCHEMA, buckets=4), []
    assert seen(store.read()) == [] and store.compact() == []
    for n in range(3):
        # a document may be added again after its delete, and one has most of the rows
        rows = [(f"{n}-{i}", draw.choice([7, 7, *range(10)]), "x") for i in range(30)]
        for _ in range(2):  # a batch that is repeated changes nothing
            assert store.add(*parts(spark, rows), f"add {n}") == (_ == 0)
        plain += rows
        gone = {draw.randrange(12), 7 if n == 1 else 11}
        assert store.delete(ids(spark, [*gone, None, *gone]), f"delete {n}") and not store.delete(ids(spark, [0]), f"delete {n}")
        plain = [r for r in plain if r[1] not in gone]
        assert seen(store.read()) == sorted(plain)
        some = ids(spark, [1, 7, None, 50, 7])
        assert seen(store.read(some)) == sorted(r for r in plain if r[1] in (1, 7))
        if n == 1:
            assert store.compact(0.0) and store.compact(0.0) == [] and store.vacuum() > 0
            assert seen(store.read()) == sorted(plain)
    assert store.read().columns == ["chunk_id", "document_id", "text", "embedding"]


def test_compaction_rewrites_only_buckets_above_the_share(spark, tmp_path):
    store = ChunkStore(spark, f"{tmp_path}/store", SCHEMA, buckets=4)
    store.add(*parts(spark, [(f"{d}-{i}", d, "x") for d in range(40) for i in range(3)]), "all")
    of = {r.document_id: str(r.b) for r in ids(spark, range(40)).select("document_id", store._bucket().alias("b")).collect()}
    crowded, thin = "0", "1"
    gone = [d for d in of if of[d] == crowded] + [d for d in of if of[d] == thin][:1] + [1000]
    store.delete(ids(spark, gone), "some")
    before = store._manifest()[1]["runs"]
    counts = {str(r.bucket): (r.n_rows, r.n_dead) for r in store.dead_shares().collect()}
    assert counts[crowded][0] == counts[crowded][1] > 0 and counts[thin][1] == 3
    wanted = [r for r in seen(store.read())]
    assert store.compact(0.5) == [int(crowded)]
    after = store._manifest()[1]
    assert set(after["deletes"]) == {thin} and crowded not in after["runs"]
    assert all(after["runs"][b] == before[b] for b in after["runs"]) and seen(store.read()) == wanted
    assert {d for _, d, _ in wanted} == set(of) - set(gone)


def test_failed_and_concurrent_changes_are_invisible(spark, tmp_path):
    store = ChunkStore(spark, f"{tmp_path}/store", SCHEMA, buckets=2)
    chunks, vectors = parts(spark, [("a", 1, "x"), ("b", 2, None)])
    for bad in ((chunks, vectors.limit(1)), (chunks.unionByName(chunks), vectors), parts(spark, [("c", None, "x")])):
        with pytest.raises(ValueError):
            store.add(*bad, "bad")
    number, manifest = store._manifest()
    assert store.add(chunks, vectors, "good") and store.add(*parts(spark, []), "empty") and store.delete(ids(spark, []), "none")
    with pytest.raises(RuntimeError, match="another writer"):
        store._swap(number, manifest)
    assert seen(store.read()) == [("a", 1, "x"), ("b", 2, None)]


def test_buckets_without_vectors_are_not_joined(spark, tmp_path):
    store = ChunkStore(spark, f"{tmp_path}/store", SCHEMA, buckets=2)
    store.add(*parts(spark, [(str(i), i, "x") for i in range(20)]), "all")
    plan = store.read()._jdf.queryExecution().optimizedPlan().toString()
    store.delete(ids(spark, range(5)), "some")
    assert "Join" not in plan and store.read().count() == 15
