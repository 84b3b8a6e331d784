"""The document job: uploads to routed, chunked, embedded, searchable tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillbook.operators import documents as d
from quillbook.operators import registry, retrieval
from quillbook.session import materialize


@dataclass
class CorpusTables:
    rejected: DataFrame
    """uploads that break an upload rule, with the error"""
    routed: DataFrame
    """the others, with their route"""
    chunks: DataFrame
    """stored chunks with vectors"""
    registry_log: DataFrame
    """a processing entry per document, then an indexed or an error one"""


def index_documents(uploads: DataFrame, embed_fn: Callable, store: str, run: str | None = None) -> CorpusTables:
    """``uploads``: document_id, filename, text, size, ts. Validated, routed,
    chunked, embedded, stored, and only then logged as indexed.

    Equal texts are chunked and embedded once. A document of which a chunk
    cannot be embedded is stored nowhere and logged as an error with the
    model's message; so is an empty one.
    """
    checked = uploads.withColumn("error", d.upload_error("filename", "size"))
    routed = checked.filter("error IS NULL").withColumn("route", d.route_document("filename"))
    general = routed.filter("route.strategy <> 'bank_statement'").select("document_id", "filename", "text", "ts")
    good, log = index_texts(general, embed_fn, store, run)
    return CorpusTables(checked.filter("error IS NOT NULL"), routed, good, log)


def index_texts(general: DataFrame, embed_fn: Callable, store: str, run: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(stored chunks, log) of documents that are to be indexed: document_id, filename, text, ts."""

    def embedded(distinct: DataFrame) -> DataFrame:
        elements = d.elements_of_text(distinct.select(F.col("content_hash").alias("document_id"), "text"))
        pieces = d.chunk_structured(elements).withColumnRenamed("document_id", "content_hash").drop("chunk_id")
        return retrieval.embed_or_error(pieces, embed_fn)

    every = d.once_per_content(general, embedded)
    chunk_id = F.sha2(F.concat_ws("|", F.col("document_id").cast("string"), F.col("chunk_index").cast("string")), 256)
    every = materialize(every.select(
        "document_id", "filename", "ts", "content_hash", chunk_id.alias("chunk_id"), "element_no", "chunk_index", "text",
        F.lit("text").alias("element_type"), F.lit(None).cast("int").alias("page_number"), F.lit(None).cast("string").alias("section"),
        "embedding", "embedding_error"))
    outcome = every.groupBy("document_id", "ts").agg(
        F.count("chunk_index").alias("chunk_count"), F.min("embedding_error").alias("failed"))
    broken = F.when(F.col("chunk_count") == 0, "The uploaded document is empty.").otherwise(F.col("failed"))
    outcome = materialize(outcome.withColumn("error_message", broken))
    good = every.join(outcome.filter("error_message IS NULL").select("document_id"), "document_id", "left_semi").drop("ts", "embedding_error")
    registry.add_chunks(good.drop("embedding"), good.select("chunk_id", "embedding"), store, run=run)
    entry = lambda number, status, count, message: outcome.select(
        "document_id", "ts", F.lit(number).cast("long").alias("event_id"), status.alias("status"), count.cast("long").alias("chunk_count"),
        message.cast("string").alias("error_message"))
    done = F.col("error_message").isNull()
    log = entry(0, F.lit("processing"), F.lit(None), F.lit(None)).unionByName(entry(
        1, F.when(done, "indexed").otherwise("error"), F.when(done, F.col("chunk_count")), F.col("error_message")))
    return good, log


def answer_questions(
    questions: DataFrame, chunks: DataFrame, embed_fn: Callable, generate_fn: Callable, top_k: int = 5
) -> DataFrame:
    """Batch of questions (query_id, question) to cited contexts and answers.

    ``chunks``: chunk_id, text, filename, page_number, section, embedding.
    Questions without a result get the fixed refusal.
    """
    queries = retrieval.embed(questions, embed_fn, "question")
    hits = retrieval.vector_top_k(chunks, queries, top_k)
    found = hits.join(chunks.drop("embedding"), "chunk_id")
    contexts = retrieval.cited_context(found)
    joined = questions.join(contexts, "query_id", "left")
    prompt = F.concat(
        F.lit("Answer only from the context and cite sources.\n\nContext:\n"), "context", F.lit("\n\nQuestion: "), "question"
    )
    asked = retrieval.generate(joined.filter("context IS NOT NULL").withColumn("prompt", prompt), generate_fn)
    refused = joined.filter("context IS NULL").withColumns(
        {"prompt": F.lit(None).cast("string"), "answer": F.lit(retrieval.REFUSAL), "answer_error": F.lit(None).cast("string")}
    )
    return asked.unionByName(refused)
