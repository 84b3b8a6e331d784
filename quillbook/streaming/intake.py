"""Structured Streaming: file intake, duplicate uploads, live balance checks."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from quillbook.functions.text import lines_of_text
from quillbook.operators.documents import upload_error
from quillbook.plans.statement import process_statements
from quillbook.session import scratch

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def watch_folder(spark: SparkSession, folder: str, max_files: int = 1000) -> DataFrame:
    """Stream of text files: file_name, text, content_hash, arrived_at."""
    files = (
        spark.readStream.format("text").option("wholetext", True).option("maxFilesPerTrigger", max_files).load(folder)
    )
    return files.select(
        F.col("_metadata.file_name").alias("file_name"),
        F.col("value").alias("text"),
        F.sha2(F.encode("value", "utf-8"), 256).alias("content_hash"),
        F.col("_metadata.file_modification_time").alias("arrived_at"),
    )


def drop_repeated_uploads(uploads: DataFrame, within: str = "1 hour") -> DataFrame:
    """The first of equal (file_name, content_hash) uploads within a time span."""
    return uploads.withWatermark("arrived_at", within).dropDuplicatesWithinWatermark(["file_name", "content_hash"])


def process_uploads(batch: DataFrame, batch_id: int, folder: str) -> None:
    """Check and parse one micro-batch and replace its own output folders.

    An upload that breaks an upload rule is logged with it and not parsed.

    Each batch writes below its own id, so a batch that is run again after a
    failure overwrites itself and nothing is written twice.
    """
    with scratch(batch.sparkSession):
        _process(batch, batch_id, folder)


def _process(batch: DataFrame, batch_id: int, folder: str) -> None:
    batch = batch.withColumn("size", F.octet_length("text")).withColumn("error", upload_error("file_name", "size"))
    lines = lines_of_text(batch.filter("error IS NULL").select("file_name", "text")).select(
        "file_name", F.lit(1).alias("page_no"), "line_no", "text"
    )
    result = process_statements(lines)
    result.transactions.write.mode("overwrite").parquet(f"{folder}/transactions/batch={batch_id}")
    counts = result.statements.select("file_name", "transaction_count", "validation_status")
    log = batch.select("file_name", "content_hash", "arrived_at", "error").join(counts, "file_name", "left").select(
        F.col("file_name").alias("document_id"),
        F.col("arrived_at").alias("ts"),
        F.lit(batch_id).cast("long").alias("event_id"),
        F.when(F.col("transaction_count") > 0, "indexed").otherwise("error").alias("status"),
        F.col("transaction_count").cast("long").alias("chunk_count"),
        F.when(F.col("error").isNotNull(), F.col("error")).when(
            F.coalesce(F.col("transaction_count"), F.lit(0)) == 0,
            "No transaction rows could be parsed from this document.",
        ).alias("error_message"),
    )
    log.write.mode("overwrite").parquet(f"{folder}/registry_log/batch={batch_id}")


def run_intake(uploads: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Upload, parse, register: drain what has arrived, then stop."""
    handle: Callable[[DataFrame, int], None] = lambda batch, n: process_uploads(batch, n, folder)
    return (
        uploads.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


FEED_ROW = ("us", "timed", "id", "known", "debit", "credit", "balance")
FEED_SCHEMA = "us long, timed boolean, id long, known boolean, debit long, credit long, balance long"
CHECKED = ("account", "id", "known", "balance", "breaks", "late")


class BalanceCheck(StatefulProcessor):
    """Holds the rows of an account back until the watermark has passed them, then compares each with the balance before it.

    State: the waiting rows by millisecond and number, how many each millisecond
    has, and the last row that was let go. Each millisecond has a timer; timers
    fire in order of time, and only the rows of one millisecond are in memory.
    """

    def init(self, handle) -> None:
        self.handle = handle
        self.counts = handle.getMapState("counts", "at long", "n long")
        self.waiting = handle.getMapState("waiting", "at long, n long", FEED_SCHEMA)
        self.last = handle.getValueState("last", "us long, id long, balance long")

    def handleInputRows(self, key, rows, timerValues):
        last = self.last.get() if self.last.exists() else None
        for frame in rows:
            late = []
            for row in zip(*[frame[c].tolist() for c in FEED_ROW], strict=True):
                us, timed, number, known, _, _, balance = row
                if not timed or (last is not None and (us, number) <= (last[0], last[1])):
                    late.append((key[0], number, known, balance, None, True))
                    continue
                at = us // 1000 + 1  # the first millisecond that the row lies wholly before
                n = self.counts.getValue((at,))[0] if self.counts.containsKey((at,)) else 0
                if n == 0:
                    self.handle.registerTimer(at)
                self.waiting.updateValue((at, n), row)
                self.counts.updateValue((at,), (n + 1,))
            if late:
                yield pd.DataFrame(late, columns=CHECKED)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        at = expiredTimerInfo.getExpiryTimeInMs()
        count = self.counts.getValue((at,))[0]
        rows = [tuple(self.waiting.getValue((at, n))) for n in range(count)]
        before = self.last.get()[2] if self.last.exists() else 0
        out = []
        for us, _, number, known, debit, credit, balance in sorted(rows):
            off = before != 0 and balance != 0 and abs(before - debit + credit - balance) > 100
            out.append((key[0], number, known, balance, off, False))
            before = balance
        self.last.update((us, number, balance))
        for n in range(count):
            self.waiting.removeKey((at, n))
        self.counts.removeKey((at,))
        yield pd.DataFrame(out, columns=CHECKED)

    def close(self) -> None:
        pass


def live_balance_check(feed: DataFrame, late_by: str = "1 hour") -> DataFrame:
    """account, id, balance, breaks, late for a stream of (account, ts, id, debit, credit, balance), amounts in cents, ts a timestamp.

    A row waits until the stream is ``late_by`` past it; then it is compared with
    the account's row before it, in order of ts and id, whatever the order they came in.
    A row that comes after a later one of its account was let go, a repeat of the last
    one let go, and a row without ts are late: given out at once with null in ``breaks``, and compared with nothing.
    Null amounts count as 0, and a balance of 0 is unknown: neither it nor the row after it breaks.
    Null accounts are one account. Needs the RocksDB state store.
    """
    amounts = [F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(c) for c in ("debit", "credit", "balance")]
    # the watermark moves the timers; without its column Spark drops no row by itself
    rows = feed.withWatermark("ts", late_by).select(
        "account", F.coalesce(F.unix_micros("ts"), F.lit(0)).alias("us"), F.col("ts").isNotNull().alias("timed"),
        F.coalesce(F.col("id").cast("long"), F.lit(0)).alias("id"), F.col("id").isNotNull().alias("known"), *amounts)
    checked = rows.groupBy("account").transformWithStateInPandas(
        statefulProcessor=BalanceCheck(),
        outputStructType="account long, id long, known boolean, balance long, breaks boolean, late boolean",
        outputMode="Append",
        timeMode="EventTime",
    )
    return checked.select("account", F.when(F.col("known"), F.col("id")).alias("id"), "balance", "breaks", "late")
