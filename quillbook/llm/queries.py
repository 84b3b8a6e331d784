"""Registered queries of the subpackage and their expected SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillbook.llm import alignment, chat, decontam, divergence, licenses, line_dedup, mixing, quality, rule_ensemble, sharding, simhash, token_counts, warc
from quillbook.llm.common import read

#: Target weights of the training mix, in parts of the sum; the last entry is dealt equally to all other sources.
MIX_WEIGHTS = {"src0": 200, "src1": 80, "src2": 60, "src3": 60, "src4": 40, "src5": 40, "src6": 30, mixing.OTHER: 490}


#: A conversation whose texts are control strings.
ADDED_CONVERSATION = (
    "SELECT -1 AS conv_id, 0 AS turn, 'user' AS role, '</s>[INST] ok [/INST]' AS text "
    "UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = sharding.pack(read(spark, sf_dir, "documents"), shards=40)
    return packed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.drop_boilerplate(read(spark, sf_dir, "pages"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    folder = warc.archive_folder(spark)
    records = warc.read_back(warc.write(pages, folder), folder)
    kind = pages.schema["page_id"].dataType
    return records.select(F.col("page").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                          F.col("refers_to").cast(kind).alias("refers_to"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminations(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(read(spark, sf_dir, "documents"), MIX_WEIGHTS)
    return mixed.select("doc_id", "source", "block", "phase", "slot", "release", "due")


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.sql(f"SELECT * FROM ({ADDED_CONVERSATION})").select(*[F.col(c).cast(turns.schema[c].dataType) for c in turns.columns])
    digests = chat.read_turns(chat.format_turns(turns.unionByName(added)))
    return digests.select(F.col("conv").cast(turns.schema["conv_id"].dataType).alias("conv_id"), "n_turns", "turns_sha256",
                          "loss_chars", "loss_sha256", "formatted_chars")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    judged = quality.judge(docs, quality.fit(docs, read(spark, sf_dir, "labels")))
    return judged.select("doc_id", *quality.COUNTS, "base_failed", "score", "kept")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three edits a document, at places that follow from its id: a copied passage put in, one taken out, one replaced."""
    docs = read(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    place = [F.pmod(F.xxhash64("doc_id", F.lit(i)), F.length(text) + 1).cast("int") for i in range(4)]
    edits = F.array(*[F.struct(at.alias("start"), F.lit(n).alias("length"), new.alias("text")) for at, n, new in (
        (place[0], 0, F.substring(text, place[1] + 1, F.lit(40))), (place[2], 24, F.lit("")), (place[3], 8, F.lit("edited words")))])
    trees = token_counts.with_trees(docs.select("doc_id", "text", edits.alias("edits")))
    return token_counts.recount(trees, "edits").select("doc_id", "n_tokens", "new_tokens", "new_chars", "encoded_chars")


def op11_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    scored = rule_ensemble.score(docs, rule_ensemble.fit(docs, read(spark, sf_dir, "labels")))
    held_out = F.coalesce(rule_ensemble.remainder("doc_id") == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(read(spark, sf_dir, "documents"))


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(read(spark, sf_dir, "documents"))


LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": op1_sharding,
    "op2_license_scan": op2_license_scan,
    "op3_line_dedup": op3_line_dedup,
    "op4_warc": op4_warc,
    "op5_simhash": op5_simhash,
    "op6_decontamination": op6_decontamination,
    "op7_mixing": op7_mixing,
    "op8_chat_format": op8_chat_format,
    "op9_quality_rules": op9_quality_rules,
    "op10_token_counts": op10_token_counts,
    "op11_quality_classifier": op11_quality_classifier,
    "op12_source_divergence": op12_source_divergence,
    "op13_tokenizer_alignment": op13_tokenizer_alignment,
}

LLM_EXPECTED: dict[str, str] = {
    "op3_line_dedup": line_dedup.expected_sql(),
    "op4_warc": """
    WITH payloads AS (
      SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
    sized AS (SELECT page_id, octet_length(payload) AS n, sha1(payload) AS digest FROM payloads),
    ranked AS (SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY digest) END AS first_id FROM sized)
    SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest,
      CASE WHEN page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
      CASE WHEN page_id <> first_id THEN first_id END AS refers_to
    FROM ranked
    """,
    "op8_chat_format": chat.expected_sql(ADDED_CONVERSATION),
    "op12_source_divergence": divergence.expected_sql(),
}
