"""A statement as JSON, in one text or in numbered parts, and back.

``statement_payload`` gathers a statement's rows into one value. Statements of
any length are written in parts: each holds a bounded number of rows, and the
texts of a statement's parts, laid end to end, are that one value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillbook.functions import patterns as p
from quillbook.operators.blocks import ROWS_PER_BLOCK, ordered

RECORD = (
    "struct<date: string, description: string, debit_amount: decimal(18,2), credit_amount: decimal(18,2), balance: decimal(18,2), "
    "category: string, confidence: double>"
)
RECORDS = f"array<{RECORD}>"
#: Rows of a statement in a part, about 2 MB of text.
ROWS_PER_PART = 10_000


def _record():
    return F.struct(*[F.round(c, 3).alias(c) if c == "confidence" else F.col(c) for c in p.EXPORT_FIELDS])


def statement_payload(statements: DataFrame, transactions: DataFrame, summary: list[str]) -> DataFrame:
    """file_name, payload: summary, warnings and transactions of each statement.

    ``statements``: file_name, warnings and the ``summary`` columns;
    ``transactions``: file_name, pos, sub and the exported record. A statement's
    rows stand in one text, as its reader wants them; without rows the list is empty.
    For statements of up to ``ROWS_PER_PART`` rows; ``payload_parts`` takes any.
    """
    listed = F.array_sort(F.collect_list(F.struct("pos", "sub", _record().alias("r"))))
    rows = transactions.groupBy("file_name").agg(F.transform(listed, lambda x: x["r"]).cast(RECORDS).alias("transactions"))
    written = F.struct(
        F.struct(*summary).alias("summary"), "warnings", F.coalesce("transactions", F.array().cast(RECORDS)).alias("transactions"))
    return statements.join(rows, "file_name", "left").select("file_name", F.to_json(written).alias("payload"))


def payload_rows(payloads: DataFrame) -> DataFrame:
    """file_name, row_no (from 0) and the record of every transaction in the payloads."""
    read = F.from_json("payload", f"transactions {RECORDS}")
    return payloads.select("file_name", F.posexplode(read["transactions"]).alias("row_no", "r")).select("file_name", "row_no", "r.*")


def payload_parts(
    statements: DataFrame,
    transactions: DataFrame,
    summary: list[str],
    rows_per_part: int = ROWS_PER_PART,
    rows_per_block: int = ROWS_PER_BLOCK,
) -> DataFrame:
    """file_name, part, parts, first_row, text: the payload of each statement in parts of ``rows_per_part`` rows.

    Parts count from 0 and rows from 0; ``parts`` is their number. The texts of
    a statement in the order of its parts are what ``statement_payload`` gives,
    but no value holds more rows than a part. A statement without rows is one
    part. ``pos`` and ``sub`` name a row of a statement; file names are not null
    and name one statement.
    """
    rows = transactions.select("file_name", "pos", "sub", F.to_json(_record().cast(RECORD)).alias("text"))
    rows = rows.withColumn("run", F.expr(f"cast(pos as bigint) div {int(rows_per_block)}"))
    counted = ordered(rows, ["file_name"], ["pos", "sub"], running={"nth": F.lit(1).cast("long")}, block="run")
    part = F.expr(f"(nth - 1) div {int(rows_per_part)}")
    listed = F.array_sort(F.collect_list(F.struct("nth", "text")))
    bodies = counted.groupBy("file_name", part.alias("part")).agg(
        F.array_join(F.transform(listed, lambda x: x["text"]), ",").alias("body"))
    sizes = counted.groupBy("file_name").agg(F.expr(f"(count(*) - 1) div {int(rows_per_part)} + 1").alias("parts"))
    opening = F.regexp_replace(F.to_json(F.struct(F.struct(*summary).alias("summary"), "warnings")), r"\}$", ',"transactions":[')
    heads = statements.select("file_name", opening.alias("head")).join(sizes, "file_name", "left")
    heads = heads.select("file_name", "head", F.coalesce("parts", F.lit(1).cast("long")).alias("parts"))
    joined = heads.join(bodies, "file_name", "left").withColumn("part", F.coalesce("part", F.lit(0).cast("long")))
    before = F.when(F.col("part") == 0, F.col("head")).otherwise(",")
    after = F.when(F.col("part") == F.col("parts") - 1, "]}").otherwise("")
    return joined.select(
        "file_name", "part", "parts", (F.col("part") * rows_per_part).alias("first_row"),
        F.concat(before, F.coalesce("body", F.lit("")), after).alias("text"))


def part_rows(parts: DataFrame) -> DataFrame:
    """file_name, row_no (long, from 0) and the record of every transaction; each part is read by itself."""
    opened = F.when(F.col("part") == 0, F.col("text")).otherwise(F.concat(F.lit('{"transactions":['), F.expr("substring(text, 2)")))
    whole = F.when(F.col("part") == F.col("parts") - 1, opened).otherwise(F.concat(opened, F.lit("]}")))
    read = F.from_json(whole, f"transactions {RECORDS}")
    return parts.select("file_name", "first_row", F.posexplode(read["transactions"]).alias("nth", "r")).select(
        "file_name", (F.col("first_row") + F.col("nth")).alias("row_no"), "r.*")
