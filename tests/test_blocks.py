import random

import pytest
from pyspark.sql import functions as F

from quillbook.operators.blocks import KEY, _cut, following, ordered


def fixture_rows():
    rng = random.Random(4)
    rows = []
    for key, count in (("hot", 90), ("warm", 7), ("one", 1)):
        at = 0
        for _ in range(count):
            at += rng.randint(1, 4)
            rows.append((key, at, rng.choice([None, rng.randint(-5, 5)])))
    rng.shuffle(rows)
    return rows


def test_rows_with_a_null_key_stay(spark):
    df = spark.createDataFrame([(None, 1, 5), (None, 4, 6), ("a", 1, 7)], "k string, at long, v int")
    got = ordered(df, ["k"], "at", running={"total": F.col("v").cast("long")}, previous={"prev": F.col("v")}, rows_per_block=1)
    assert sorted((str(r.k), r.at, r.total, r.prev) for r in got.collect()) == [("None", 1, 5, None), ("None", 4, 11, 5), ("a", 1, 7, None)]
    ahead = following(df, ["k"], "at", "v", 2, rows_per_block=1)
    assert sorted((str(r.k), r.at, list(r.following)) for r in ahead.collect()) == [("None", 1, [6]), ("None", 4, []), ("a", 1, [])]


@pytest.mark.parametrize("rows_per_block", [1, 3, 1 << 16])
def test_ordered_equals_a_plain_fold(spark, rows_per_block):
    rows = fixture_rows()
    df = spark.createDataFrame(rows, "k string, at long, v int")
    got = ordered(
        df, ["k"], "at",
        running={"total": F.coalesce("v", F.lit(0)).cast("long")},
        latest={"last": F.col("v")}, before={"above": F.col("v")}, previous={"prev": F.col("v")},
        smallest={"least": F.col("v")}, rows_per_block=rows_per_block,
    ).collect()
    found = {(r.k, r.at): (r.total, r["last"], r.above, r.prev, r.least) for r in got}
    assert len(found) == len(rows)
    for key in {r[0] for r in rows}:
        mine = sorted(r for r in rows if r[0] == key)
        least = min((v for _, _, v in mine if v is not None), default=None)
        total, last, prev = 0, None, None
        for _, at, v in mine:
            above = last
            total += v or 0
            last = v if v is not None else last
            assert found[(key, at)] == (total, last, above, prev, least)
            prev = v


@pytest.mark.parametrize("rows_per_block", [2, 1 << 16])
def test_following_crosses_blocks(spark, rows_per_block):
    df = spark.createDataFrame([("a", i * 2, f"t{i}") for i in range(9)], "k string, at long, t string")
    got = following(df, ["k"], "at", "t", 3, rows_per_block=rows_per_block).orderBy("at").collect()
    assert [r.following for r in got] == [[f"t{j}" for j in range(i + 1, min(i + 4, 9))] for i in range(9)]


def test_only_keys_with_more_rows_than_a_block_are_cut(spark):
    # ten rows each, as far apart as the parts of a statement
    df = spark.range(30).select(F.concat(F.lit("f"), F.col("id") % 3).alias("k"), (F.col("id") * (1 << 40)).alias("at"))
    block = F.expr("at div 65536")
    whole, large = _cut(df, ["k"], block, [F.col("k"), F.col("at")], 10)
    assert whole.select(KEY).distinct().count() == 3 and large.isEmpty()
    whole, large = _cut(df.union(spark.sql("SELECT 'f0', -1L")), ["k"], block, [F.col("k"), F.col("at")], 10)
    assert whole.select(KEY).distinct().count() == 2 + 10 and {r.k for r in large.select("k").collect()} == {"f0"}
