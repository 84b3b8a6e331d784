"""Stores that take batches, deletes and compactions against the full log in memory."""

import random

import pytest
from pyspark.sql import functions as F

from quillbook.operators import documents
from quillbook.operators.keyed_store import KeyedStore

SCHEMA = "id long, at long, part int, v string"


def plain_state(batches):
    """{(id, part, v)} after (rows, deletes) batches in order."""
    newest, state = {}, {}
    for number, (rows, deletes) in enumerate(batches):
        for key, at in [*((r[0], r[1]) for r in rows), *deletes]:
            newest[key] = max(newest.get(key, (-1, -1)), (at, number))
        for r in rows:
            state.setdefault((r[0], r[1], number), set()).add((r[0], r[2], r[3]))
    gone = {(key, at, number) for number, (_, deletes) in enumerate(batches) for key, at in deletes}
    return {x for (key, at, number), some in state.items() if newest[key] == (at, number) and (key, at, number) not in gone for x in some}


def test_state_equals_the_full_log(spark, tmp_path):
    draw = random.Random(2)
    store = KeyedStore(spark, f"{tmp_path}/store", SCHEMA, "id", "at", buckets=4)
    assert store.read().count() == 0
    batches = []
    for number in range(4):
        rows = [(key, at, part, f"{number}-{part}") for key in draw.sample(range(12), 6) for at in [draw.randrange(10)] for part in range(draw.randint(1, 3))]
        deletes = [(key, draw.randrange(12)) for key in draw.sample(range(12), 3)] + [rows[0][:2]]
        batches.append((rows, deletes))
        frame, dead = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(deletes, "id long, at long")
        assert store.merge(frame, f"b{number}", dead) and not store.merge(frame, f"b{number}", dead)
        assert {(r.id, r.part, r.v) for r in store.read().collect()} == plain_state(batches)
        if number == 2:
            assert store.compact() and store.compact() == [] and store.vacuum() > 0
            assert {(r.id, r.part, r.v) for r in store.read().collect()} == plain_state(batches)
    some = spark.createDataFrame([(1,), (2,), (99,)], "id long")
    assert {(r.id, r.part, r.v) for r in store.read(some).collect()} == {x for x in plain_state(batches) if x[0] in (1, 2)}


def test_compaction_leaves_other_buckets_alone(spark, tmp_path):
    store = KeyedStore(spark, f"{tmp_path}/store", SCHEMA, "id", "at", buckets=8)
    store.merge(spark.createDataFrame([(i, 1, 0, "x") for i in range(100)], SCHEMA), "all")
    before = store._manifest()[1]["runs"]
    store.merge(spark.createDataFrame([(5, 2, 0, "y")], SCHEMA), "one")
    (changed,) = store.compact()
    after = store._manifest()[1]["runs"]
    assert {b for b in after if after[b] != before[b]} == {str(changed)}
    assert store.read().filter("v = 'y'").count() == 1 and store.read().count() == 100


def test_failed_and_concurrent_batches_change_nothing(spark, tmp_path):
    store = KeyedStore(spark, f"{tmp_path}/store", SCHEMA, "id", "at", buckets=2)
    with pytest.raises(Exception, match="must not be null"):
        store.merge(spark.createDataFrame([(None, 1, 0, "x"), (1, 1, 0, "x")], SCHEMA), "bad")
    assert store.read().count() == 0
    number, manifest = store._manifest()
    store.merge(spark.createDataFrame([(1, 1, 0, "x")], SCHEMA), "good")
    with pytest.raises(RuntimeError, match="another writer"):
        store._swap(number, manifest)
    assert store.read().count() == 1


def test_known_texts_are_not_worked_on_again(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def work(new):
        def size(text):
            seen.add(1)
            return len(text)

        return new.select("content_hash", F.udf(size, "int")("text").alias("n"))

    store = KeyedStore(spark, f"{tmp_path}/store", "content_hash string, n int, work_version int", "content_hash", "work_version", buckets=2)
    first = spark.createDataFrame([(1, "a"), (2, "bb"), (3, "a")], "id long, text string")
    second = spark.createDataFrame([(4, "bb"), (5, "ccc"), (6, "ccc")], "id long, text string")
    assert {(r.id, r.n) for r in documents.once_ever(first, work, store, "x").collect()} == {(1, 1), (2, 2), (3, 1)} and seen.value == 2
    assert {(r.id, r.n) for r in documents.once_ever(second, work, store, "y").collect()} == {(4, 2), (5, 3), (6, 3)} and seen.value == 3
    assert documents.once_ever(second, work, store, "y").count() == 3 and seen.value == 3
    assert documents.once_ever(second, work, store, "y", work_version=2).count() == 3 and seen.value == 5
