"""What the plans of the statement steps look like."""

from decimal import Decimal

import pytest

from pyspark.sql import functions as F

from quillbook.functions import text
from quillbook.operators import choose, lines, metadata, rows
from quillbook.plans import queries
from quillbook.sources import derived

FILES = [("a", 1, i, t) for i, t in enumerate((
    "UNION BANK", "Opening Balance: 100.00", "Date Description Debit Credit Balance",
    "01/02/2024 RENT PAYMENT 10.00 90.00", "late night order", "02/02/2024 SALARY 20.00 110.00"))]


@pytest.fixture
def statement(spark):
    return spark.createDataFrame(FILES, "file_name string, page_no int, line_no long, text string")


def largest_method(df) -> int:
    """Bytes of the largest method generated for a frame; the JVM interprets those above 8,000."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        stages = df._jdf.queryExecution().debug().codegenToSeq()
        return max(stages.apply(i)._3().maxMethodCodeSize() for i in range(stages.size()))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def shuffles(df) -> int:
    """Shuffles by hash of the plan that was run in the end."""
    df.collect()
    ran = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return ran.count("Exchange hashpartitioning")


def test_letterhead_code_is_compiled(statement):
    assert largest_method(metadata.statement_metadata(statement)) < 8000


def test_date_and_amount_code_is_compiled(spark):
    chunks = spark.createDataFrame([("a", 1, 0, "01/02/2024 RENT 10.00")], "file_name string, pos long, sub int, chunk string")
    assert largest_method(lines.count_bad_dates(chunks, ["file_name"])) < 8000
    assert largest_method(rows.parse_chunks(chunks, ["file_name"])) < 8000


def test_chunks_of_small_files_are_joined_where_their_lines_are(statement):
    parts = lines.split_parts(statement).filter(F.col("part") == lines.PRIMARY).localCheckpoint()
    chunks = lines.line_chunks(parts, ["file_name"])
    assert shuffles(chunks) == 1
    assert {r.chunk for r in chunks.collect()} == {"01/02/2024 RENT PAYMENT 10.00 90.00 late night order", "02/02/2024 SALARY 20.00 110.00"}


def test_fields_of_small_files_are_read_where_their_lines_are(statement):
    read = metadata.statement_metadata(statement.localCheckpoint())
    assert shuffles(read) == 1
    row = read.first()
    assert (row.file_name, row.bank_name, row.opening_balance) == ("a", "UNION BANK", Decimal("100.00"))


def test_candidates_of_few_rows_are_scored_in_one_task(spark):
    rows_ = [("f", i, 0, "2024-01-0%d" % i, "A", "5.00", "0.00", "95.00", "pdf_tables") for i in (1, 2, 2)]
    df = spark.createDataFrame(rows_, "file_name string, pos long, sub int, date string, description string, debit_amount string, credit_amount string, balance string, strategy string")
    scores = choose.score_candidates(df.withColumns({c: F.col(c).cast("decimal(18,2)") for c in ("debit_amount", "credit_amount", "balance")}).localCheckpoint())
    assert shuffles(scores) <= 2
    row = scores.first()
    assert (row.row_count, row.valid_count, row.dropped, row.duplicates) == (3, 2, 0, 1)


def test_lines_are_cleaned_and_lowered_once(spark):
    df = spark.createDataFrame([("a", "x\ny")], "file_name string, text string")
    plan = lines.line_flags(text.lines_of_text(df))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("trim(replace(") == 1 and plan.count("lower(") == 1


def test_candidates_read_the_transactions_once(spark, monkeypatch):
    calls, real = [], derived.transactions
    monkeypatch.setattr(derived, "transactions", lambda *a: calls.append(a) or real(*a))
    queries._candidates(spark, "/root/testdata/sf0.001")
    assert len(calls) == 1
