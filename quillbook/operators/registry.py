"""Keyed tables: document registry, conversations, chunk store, structured queries."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillbook.operators.retrieval import check_bound

STORE_BUCKETS = 64


def latest_by_key(log: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Last version of every key, combined before the shuffle."""
    rest = [c for c in log.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return log.groupBy(*keys).agg(newest).select(*keys, "_row.*").select(log.columns)


def registry_state(log: DataFrame) -> DataFrame:
    """Current registry row of each document from its status log.

    ``log``: document_id, ts, event_id, status, chunk_count, error_message. A
    missing chunk_count keeps the old one, indexed_at is the last indexing, and
    indexing clears the error.
    """
    at = F.struct("ts", "event_id")
    known = F.when(F.col("chunk_count").isNotNull(), at)
    state = log.groupBy("document_id").agg(
        F.max_by("status", at).alias("status"),
        F.coalesce(F.max_by("chunk_count", known), F.lit(0)).alias("chunk_count"),
        F.max(F.when(F.col("status") == "indexed", F.col("ts"))).alias("indexed_at"),
        F.max_by("error_message", at).alias("error_message"),
        F.min("ts").alias("created_at"),
        F.max("ts").alias("updated_at"),
    )
    cleared = F.when(F.col("status") != "indexed", F.col("error_message"))
    return state.withColumn("error_message", cleared)


def session_documents(registry: DataFrame, session_id: str) -> DataFrame:
    return registry.filter(F.col("session_id") == session_id).orderBy(F.desc("created_at"))


def document(registry: DataFrame, document_id: object) -> DataFrame:
    return registry.filter(F.col("document_id") == document_id)


def delete_keys(table: DataFrame, deletes: DataFrame, key: str) -> DataFrame:
    return table.join(deletes.select(key).distinct(), key, "left_anti")


def delete_conversations(conversations: DataFrame, messages: DataFrame, deletes: DataFrame) -> tuple[DataFrame, DataFrame]:
    return tuple(delete_keys(t, deletes, "conversation_id") for t in (conversations, messages))


def conversation_messages(messages: DataFrame, limit: int = 50) -> DataFrame:
    """The first ``limit`` messages of each conversation, oldest first, ranked."""
    check_bound("limit", limit, 1, 50)
    oldest = Window.partitionBy("conversation_id").orderBy("created_at", "message_id")
    return messages.withColumn("rank", F.row_number().over(oldest)).filter(F.col("rank") <= limit)


def conversation_history(messages: DataFrame, limit: int = 10) -> DataFrame:
    """conversation_id, history: 'role: content' lines joined by blank lines."""
    kept = conversation_messages(messages, limit)
    line = F.concat("role", F.lit(": "), "content").alias("line")
    listed = F.array_sort(F.collect_list(F.struct("rank", line)))
    return kept.groupBy("conversation_id").agg(
        F.array_join(F.transform(listed, lambda m: m["line"]), "\n\n").alias("history")
    )


def touch_conversations(conversations: DataFrame, messages: DataFrame) -> DataFrame:
    """Conversations with updated_at raised to their newest message."""
    newest = messages.groupBy("conversation_id").agg(F.max("created_at").alias("_newest"))
    joined = conversations.join(newest, "conversation_id", "left")
    return joined.withColumn("updated_at", F.greatest("updated_at", "_newest")).drop("_newest")


def list_conversations(
    conversations: DataFrame, session_id: str | None = None, user_id: str | None = None, limit: int = 50
) -> DataFrame:
    """Newest first: of the session, else of the user, else the top ``limit``."""
    newest = [F.desc("updated_at"), F.asc("conversation_id")]
    if session_id:
        return conversations.filter(F.col("session_id") == session_id).orderBy(*newest)
    if user_id:
        return conversations.filter(F.col("user_id") == user_id).orderBy(*newest)
    return conversations.orderBy(*newest).limit(limit)


def chunk_counts(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("document_id").agg(F.count("*").alias("chunk_count"))


def store_bucket() -> Column:
    return F.pmod(F.xxhash64("document_id"), F.lit(STORE_BUCKETS)).cast("int").alias("bucket")


def add_chunks(chunks: DataFrame, embeddings: DataFrame, path: str, scalars: Column | None = None, run: str | None = None) -> None:
    """Add chunks with their vectors to the store at ``path``.

    Both sides must have the same chunk ids, each once, else nothing is written.
    Empty metadata values are dropped. A ``run`` that is written again replaces
    itself, so a retry adds nothing twice. Buckets of document_id are the
    partitions; their rows are dealt out before the write, a bucket to a few
    tasks, so files are few and a large document is not one task.
    """
    sides = chunks.select("chunk_id", F.lit(1).alias("c"), F.lit(0).alias("e")).unionByName(
        embeddings.select("chunk_id", F.lit(0).alias("c"), F.lit(1).alias("e")))
    odd = sides.groupBy("chunk_id").agg(F.sum("c").alias("c"), F.sum("e").alias("e")).filter("c <> 1 OR e <> 1")
    if not odd.isEmpty():
        raise ValueError("Chunks and embeddings must have the same ids, each once")
    joined = chunks.join(embeddings, "chunk_id")
    if scalars is not None:
        joined = joined.withColumn("metadata", F.map_filter(scalars, lambda _, v: v.isNotNull()))
    dealt = joined.withColumn("bucket", store_bucket()).repartition("bucket", F.pmod(F.xxhash64("chunk_id"), F.lit(8)))
    dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/run={run or uuid.uuid4().hex}")


def stored_chunks(spark: SparkSession, path: str, document_ids: DataFrame | None = None) -> DataFrame:
    """Chunks of the store; those of given documents are read from their buckets alone."""
    stored = spark.read.parquet(path)
    if document_ids is None:
        return stored
    wanted = document_ids.select("document_id").distinct().withColumn("bucket", store_bucket())
    buckets = [r.bucket for r in wanted.select("bucket").distinct().collect()]  # 64 at most
    return stored.filter(F.col("bucket").isin(buckets)).join(wanted.select("document_id"), "document_id", "left_semi")


# --- structured queries --------------------------------------------------------
COMPARISONS = {
    "=": lambda c, v: c == v, "!=": lambda c, v: c != v, "<": lambda c, v: c < v, "<=": lambda c, v: c <= v,
    ">": lambda c, v: c > v, ">=": lambda c, v: c >= v, "in": lambda c, v: c.isin(list(v)),
    "contains": lambda c, v: c.contains(v),
}
AGGREGATES = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "count": F.count}


def _column(df: DataFrame, name: str) -> Column:
    if name not in df.columns:
        raise ValueError(f"unknown column: {name}")
    return F.col(name)


def _measures(df: DataFrame, wanted: dict[str, tuple[str, str]]) -> list[Column]:
    measures = []
    for alias, (function, column) in wanted.items():
        if function not in AGGREGATES:
            raise ValueError(f"unknown aggregate: {function}")
        measures.append(AGGREGATES[function](_column(df, column)).alias(alias))
    return measures


def structured_query(df: DataFrame, operation: str, parameters: dict) -> DataFrame:
    """filter, aggregate, group or compare over a table, by named columns only.

    where     [(column, comparison, value), …] for every operation
    measures  {name: (aggregate, column)}
    by        [column, …] for group and compare
    across    (column, [left, right]) for compare: one measure set per value
    """
    for name, comparison, value in parameters.get("where", ()):
        if comparison not in COMPARISONS:
            raise ValueError(f"unknown comparison: {comparison}")
        df = df.filter(COMPARISONS[comparison](_column(df, name), value))
    if operation == "filter":
        return df
    if operation == "aggregate":
        return df.agg(*_measures(df, parameters["measures"]))
    keys = [_column(df, name) for name in parameters.get("by", ())]
    if operation == "group":
        return df.groupBy(*keys).agg(*_measures(df, parameters["measures"]))
    if operation == "compare":
        column, values = parameters["across"]
        sides = df.filter(_column(df, column).isin(list(values)))
        return sides.groupBy(*keys).pivot(column, list(values)).agg(*_measures(df, parameters["measures"]))
    raise ValueError(f"unknown operation: {operation}")


def spending_by_category(rows: DataFrame) -> DataFrame:
    return rows.groupBy("category").agg(
        F.sum("debit_amount").alias("total_debit"),
        F.sum("credit_amount").alias("total_credit"),
        F.avg("debit_amount").alias("average_debit"),
        F.count("*").alias("n"),
    )
