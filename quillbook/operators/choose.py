"""Choice between extraction strategies by the quality of their rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillbook.functions import patterns as p
from quillbook.operators.blocks import ROWS_PER_BLOCK, apart
from quillbook.operators.checks import ORDER, checked, running_balance, with_breaks
from quillbook.session import materialize

# --- fixed values: strategies in order of preference ---------------------------
STRATEGIES = ("line_window", "box_columns", "pdf_tables")


def score_candidates(candidates: DataFrame, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """file_name, strategy, row_count, valid_count, dropped, duplicates, score.

    Valid rows are worth 9 by construction (dates, amounts, descriptions all
    hold); consistent balances add up to 5; dropped, duplicate and suspicious
    rows cost 2, 1.5 and 1. No valid row scores minus infinity.
    """
    keys = ["file_name", "strategy"]
    small, large = apart(candidates, keys, rows_per_block)
    # a candidate of few rows stays in one task from its duplicates to its counts
    seen = checked(small.repartition(*keys), keys, "copies")
    valid = F.size("issues") == 0
    above = Window.partitionBy(*keys).orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, -1)
    known = F.last(F.when(valid, F.struct("balance")), ignorenulls=True).over(above)
    joined = _counts(with_breaks(seen.withColumn("previous_balance", known["balance"])), keys)
    cut = materialize(checked(large, keys, "copies"))
    walked = running_balance(cut.filter(valid), keys, rows_per_block)
    none = F.lit(None).cast("decimal(18,2)")
    dropped = cut.filter(~valid).withColumns({"previous_balance": none, "expected_balance": none, "breaks": F.lit(False)})
    joined = joined.unionByName(_counts(walked.unionByName(dropped), keys))
    duplicates = F.col("row_count") - F.col("distinct_count")
    score = (
        9.0
        + 5.0 * F.col("balanced") / F.greatest(F.col("valid_count") - 1, F.lit(1))
        - 2.0 * F.col("dropped")
        - 1.5 * duplicates
        - F.col("suspicious")
    )
    return joined.select(
        *keys,
        "row_count",
        "valid_count",
        "dropped",
        duplicates.alias("duplicates"),
        F.when(F.col("valid_count") > 0, score).otherwise(F.lit(float("-inf"))).alias("score"),
    )


def _counts(seen: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: all rows, the distinct ones, the dropped, the valid, and of these the balanced and the suspicious."""
    valid = F.size("issues") == 0
    large = (F.col("debit_amount") > p.SUSPICIOUS_AMOUNT) | (F.col("credit_amount") > p.SUSPICIOUS_AMOUNT)
    return seen.groupBy(*keys).agg(
        F.sum("copies").alias("row_count"),
        F.count("*").alias("distinct_count"),
        F.count_if(~valid).alias("dropped"),
        F.count_if(valid).alias("valid_count"),
        F.count_if(valid & F.col("expected_balance").isNotNull() & ~F.col("breaks")).alias("balanced"),
        F.count_if(valid & large).alias("suspicious"),
    )


def pick_strategy(scores: DataFrame) -> DataFrame:
    """file_name, strategy of the best score, then row count, then preference."""
    rank = F.array_position(F.array(*map(F.lit, STRATEGIES)), F.col("strategy"))
    best = F.max_by("strategy", F.struct("score", "row_count", (-rank).alias("rank")))
    return scores.groupBy("file_name").agg(best.alias("strategy"))


def retry_pick(counts: DataFrame) -> DataFrame:
    """Source of each file's rows, from counts (file_name, source, n).

    Native text that gave fewer than two rows yields to recognised text, but
    only to more rows.
    """
    native = F.coalesce(F.max(F.when(F.col("source") == "native", F.col("n"))), F.lit(0))
    recognised = F.coalesce(F.max(F.when(F.col("source") == "ocr", F.col("n"))), F.lit(0))
    use_ocr = (native < 2) & (recognised > native)
    return counts.groupBy("file_name").agg(F.when(use_ocr, "ocr").otherwise("native").alias("source")).withColumns(
        {
            "document_type": F.when(F.col("source") == "ocr", "image").otherwise("text"),
            "warning": F.when(
                F.col("source") == "ocr", "Image-based PDF detected; text was recovered with OCR."
            ),
        }
    )
