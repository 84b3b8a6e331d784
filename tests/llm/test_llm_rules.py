"""The rule ensemble: held-out accuracy, compiled columns against numpy, odd tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillbook.llm import rule_ensemble

FOLDER = "/root/testdata/sf0.01"


def tables(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet")


@pytest.fixture(scope="module")
def fitted(spark):
    return rule_ensemble.fit(*tables(spark))


def test_held_out_accuracy(spark, fitted):
    docs, labels = tables(spark)
    scored = rule_ensemble.score(docs, fitted).join(labels, "doc_id").filter(rule_ensemble.remainder("doc_id") == 0).collect()
    y, score = (np.array([r[c] for r in scored], float) for c in ("quality", "score"))
    assert len(y) > 50 and 0 < y.mean() < 1
    ranks = score.argsort().argsort()
    assert (ranks[y == 1].mean() - (y == 1).sum() / 2) / (y == 0).sum() > 0.9
    assert np.mean((score >= 0.3) == y) > 0.95


def test_rules_are_few_and_compile_to_what_they_say(spark, fitted):
    assert 3 <= len(fitted.rules) <= 120 and all(1 <= len(r.bounds) <= rule_ensemble.DEPTH for r in fitted.rules)
    docs, _ = tables(spark)
    rows = rule_ensemble.score(docs, fitted).select("text", "score", "predicted").collect()
    x = np.array([rule_ensemble.statistics(r.text or "")[1] for r in rows])
    assert np.allclose([r.score for r in rows], fitted.scores(x), atol=1e-12)
    assert all(r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in rows)


def test_held_out_labels_and_other_columns_teach_nothing(spark, fitted):
    docs, labels = tables(spark)
    turned = labels.withColumn("quality", F.when(rule_ensemble.remainder("doc_id") == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    again = rule_ensemble.fit(docs.withColumn("lang", F.lit("x")).withColumn("source", F.lit(None)).repartition(5), turned.orderBy(F.rand(3)))
    assert again.rules == fitted.rules and np.allclose(again.weights, fitted.weights) and again.intercept == pytest.approx(fitted.intercept)


def test_weights_minimise_the_penalised_loss():
    draw = np.random.default_rng(0)
    held = draw.random((400, 12)) < 0.4
    y = (draw.random(400) < rule_ensemble.logistic(2.0 * held[:, 0] - 3.0 * held[:, 1])).astype(float)
    intercept, weights = rule_ensemble.weigh(held, y, 0.03)
    scale = np.maximum(np.sqrt(held.mean(0) * (1 - held.mean(0))), 0.05)

    def loss(b, w):
        z = b + held @ w
        return np.mean(np.logaddexp(0, z) - y * z) + 0.03 * np.abs(w * scale).sum()

    best = loss(intercept, weights)
    for _ in range(300):
        assert loss(intercept + draw.normal(0, 0.02), weights + draw.normal(0, 0.02, 12)) >= best - 1e-7
    assert weights[0] > 0.5 and weights[1] < -0.5 and (weights[2:] == 0).sum() >= 5


def test_odd_tables(spark):
    schema = "doc_id long, text string, score string, statistics int"
    docs = spark.createDataFrame([(None, None, "a", 1), (1, "", None, 2), (1, "x " * 50000, "b", 3), (1, "", None, 2)], schema)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    some = spark.createDataFrame([(None, 1, 0), (1, None, 0), (2, 0, 0), (1, 1, 0)], none.schema)
    for labels in (none, some):
        out = rule_ensemble.score(docs, rule_ensemble.fit(docs, labels))
        assert out.columns == [*docs.columns, "score_", "predicted"] and out.count() == 4
        assert out.filter("score_ between 0 and 1 and predicted in (0, 1)").count() == 4
    assert rule_ensemble.score(docs.limit(0), rule_ensemble.fit(docs.limit(0), none)).count() == 0
