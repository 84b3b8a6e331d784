"""A batch of uploaded files: statements to checked tables, everything else to the index."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillbook.operators import documents as d
from quillbook.plans.corpus import index_texts
from quillbook.plans.statement import StatementTables, process_statements
from quillbook.session import materialize
from quillbook.sources import files


@dataclass
class UploadTables:
    rejected: DataFrame
    """document_id, filename, error of uploads that break a rule"""
    statements: StatementTables
    """tables of the statements; file_name is the document_id as text"""
    chunks: DataFrame
    """stored chunks of the other documents"""
    registry_log: DataFrame
    """a processing entry per accepted upload, then an indexed or an error one"""


def process_uploads(uploads: DataFrame, embed_fn: Callable, store: str, run: str | None = None) -> UploadTables:
    """``uploads``: document_id, filename, content, size, ts.

    Every upload is checked and routed. Statements are parsed; one without a
    single row is indexed like any document. An upload ends as rejected, as
    indexed (with its rows or chunks) or as an error.
    """
    checked = materialize(uploads.withColumn("error", d.upload_error("filename", "size")).withColumn(
        "strategy", d.route_document("filename")["strategy"]).withColumn("text", files.decoded("content")))
    accepted = checked.filter("error IS NULL")
    as_statement = accepted.filter("strategy = 'bank_statement'")
    lines, _ = files.text_statements(as_statement.select(F.col("document_id").cast("string").alias("file_name"), "size", "content"))
    tables = process_statements(lines)
    found = materialize(tables.transactions.groupBy("file_name").agg(F.count("*").alias("n")).select(
        F.expr("file_name").alias("key"), "n"))
    keyed = accepted.withColumn("key", F.col("document_id").cast("string"))
    texts = lambda df: df.select("key", "document_id", "filename", "text", "ts")
    general = d.reroute(
        texts(keyed.filter("strategy = 'bank_statement'")), found, texts(keyed.filter("strategy <> 'bank_statement'")), "key")
    chunks, log = index_texts(general.drop("key"), embed_fn, store, run)
    parsed = keyed.join(found, "key")
    entry = lambda number, status, count: parsed.select(
        "document_id", "ts", F.lit(number).cast("long").alias("event_id"), F.lit(status).alias("status"), count.cast("long").alias("chunk_count"),
        F.lit(None).cast("string").alias("error_message"))
    return UploadTables(
        rejected=checked.filter("error IS NOT NULL").select("document_id", "filename", "error"),
        statements=tables,
        chunks=chunks,
        registry_log=log.unionByName(entry(0, "processing", F.lit(None))).unionByName(entry(1, "indexed", F.col("n"))),
    )
