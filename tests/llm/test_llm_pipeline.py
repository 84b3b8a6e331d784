"""The pipeline's stages on the smallest tables, each against a plain version."""

from collections import defaultdict

import corpus_pipeline
from pyspark.sql import functions as F
from test_llm_overlap import plain_kept
from test_llm_text import plain_counts

from quillbook.llm import decontam, mixing, quality

FOLDER = "/root/testdata/sf0.001"


def test_stages_against_plain_versions(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    bench = spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()
    forest = quality.fit(docs, spark.read.parquet(f"{FOLDER}/labels.parquet"))
    before = {r.doc_id: r for r in docs.collect()}
    columns = docs.columns
    assert len(corpus_pipeline.STAGES) == 5
    kept = []
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, FOLDER)
        assert out.columns[:5] == columns and (out.columns == columns or number == 4)
        out.write.parquet(f"{tmp_path}/{number}")
        docs = spark.read.parquet(f"{tmp_path}/{number}")
        kept.append({r.doc_id: r for r in docs.collect()})
        assert all(tuple(r)[:5] == tuple(before[i]) for i, r in kept[-1].items()) and len(kept[-1]) == docs.count()

    wanted = set()
    for i, r in before.items():
        n, _, _, _, repeats = counts = plain_counts(r.text) if len(r.text) < 15_000 else quality.statistics(r.text)[0]
        assert tuple(quality.statistics(r.text)[0]) == tuple(counts)
        if n >= 50 and 100 * repeats <= 50 * n:
            score = forest.scores(__import__("numpy").array([quality.statistics(r.text)[1]]))[0]
            wanted |= {i} if score <= forest.threshold else set()
    assert set(kept[0]) == wanted

    assert set(kept[1]) == plain_kept([(i, r.text) for i, r in kept[0].items()])

    items = [decontam.WORD.findall(b.text.lower()) for b in bench]
    leaks = {i for i, r in kept[1].items() if any(
        " " + " ".join(w) + " " in " " + " ".join(decontam.WORD.findall(r.text.lower())) + " " for w in items if len(w) > 4)}
    assert set(kept[2]) == set(kept[1]) - leaks
    assert set(kept[3]) == set(kept[2]) == set(kept[4])

    slots = defaultdict(list)
    for r in kept[4].values():
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_mixed_files_follow_the_mix(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    corpus_pipeline.mixing_to_weights(spark, docs, FOLDER).write.parquet(f"{tmp_path}/mixed")
    slot = {r.doc_id: r.slot for r in mixing.mix(docs, corpus_pipeline.MIX_WEIGHTS).collect()}
    files = spark.read.parquet(f"{tmp_path}/mixed").select("doc_id", F.col("_metadata.file_name").alias("f"), F.col("_metadata.row_index").alias("k"))
    read = [slot[r.doc_id] for r in files.orderBy("f", "k").collect()]
    assert read == sorted(read)


def test_odd_and_empty_documents(spark, tmp_path):
    text = " ".join(f"word{i}" for i in range(80))
    rows = [(None, None, None, None, None), (1, text, "en", None, 5), (1, text, "en", None, 5), (2, "", "en", "src0", 0), (3, text.replace("word", "other"), None, "src1", None)]
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, None), (None, "")], "item_id long, text string")
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for name, docs in (("some", spark.createDataFrame(rows, schema)), ("none", spark.createDataFrame([], schema))):
        folder = f"{tmp_path}/{name}"
        docs.write.parquet(f"{folder}/documents.parquet")
        labels.write.parquet(f"{folder}/labels.parquet")
        bench.write.parquet(f"{folder}/benchmark.parquet")
        assert sorted(r.doc_id for r in corpus_pipeline.run(spark, folder).collect()) == ([1, 3] if name == "some" else [])
