"""Checks on transactions: row issues, running balance, repair, totals.

Rows: file_name, pos, sub, date, description, debit_amount, credit_amount,
balance. Order within a file: (pos, sub).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillbook.functions import dates
from quillbook.functions import patterns as p
from quillbook.operators.blocks import ROWS_PER_BLOCK, ordered
from quillbook.operators.lets import let
from quillbook.operators.lines import _matches
from quillbook.operators.rows import keep_first

FILE = ["file_name"]
ORDER = ["pos", "sub"]
ISSUES = (
    "invalid or incomplete date",
    "missing description",
    "description contains header/section text",
    "negative amount",
    "zero amount",
    "both debit and credit present",
    "suspicious amount magnitude",
)


def issues() -> Column:
    """What is wrong with a row, in a fixed order; empty for a valid row."""
    debit, credit = F.col("debit_amount"), F.col("credit_amount")
    missing = F.coalesce(F.trim("description") == "", F.lit(True))
    found = (
        F.expr(dates.normalize_date(dates.squeezed("date"))).isNull(),
        missing,
        ~missing & ((F.length("description") > 300) | F.col("description").rlike(p.SECONDARY_TEXT)),
        (debit < 0) | (credit < 0),
        (debit == 0) & (credit == 0),
        (debit > 0) & (credit > 0),
        (debit > p.MAX_AMOUNT) | (credit > p.MAX_AMOUNT),
    )
    return F.filter(F.array(*[F.when(c, F.lit(n)) for c, n in zip(found, ISSUES)]), lambda x: x.isNotNull())


def _sound() -> Column:
    """Whether a row is seen to be valid without a closer look: true of most valid rows and of no other."""
    debit, credit = F.col("debit_amount"), F.col("credit_amount")
    described = (F.trim("description") != "") & (F.length("description") <= 300)
    one_side = ((debit == 0) & (credit > 0)) | ((credit == 0) & (debit > 0))
    return F.coalesce(
        F.expr(dates.is_iso_day("date")) & one_side & (debit <= p.MAX_AMOUNT) & (credit <= p.MAX_AMOUNT)
        & described & ~_matches(p.SECONDARY_TEXT, p.SECONDARY_WORDS, "description"),
        F.lit(False),
    )


def with_issues(rows: DataFrame) -> DataFrame:
    """Add the issues of every row; the lambdas that read dates of any form run only on rows that may have one."""
    none = F.array().cast("array<string>")
    return let(let(rows, _sound=_sound()), issues=F.when(F.col("_sound"), none).otherwise(issues())).drop("_sound")


def checked(rows: DataFrame, keys: list[str] = FILE, count: str | None = None) -> DataFrame:
    """Distinct rows with their issues, and the number of rows that each stands for if ``count`` names it."""
    return with_issues(keep_first(rows, keys, ORDER, count))


def issue_counts(rows: DataFrame, keys: list[str]) -> DataFrame:
    """How often each issue occurs among the distinct rows."""
    return checked(rows).select(*keys, F.explode("issues").alias("issue")).groupBy(*keys, "issue").agg(
        F.count("*").alias("n")
    )


def running_balance(rows: DataFrame, keys: list[str] = FILE, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """Add previous_balance, expected_balance and breaks (off by more than 1.00).

    Only pairs of known (non-zero) balances are compared.
    """
    return with_breaks(
        ordered(rows, keys, ORDER, previous={"previous_balance": F.col("balance")}, rows_per_block=rows_per_block)
    )


def with_breaks(seen: DataFrame) -> DataFrame:
    """Add expected_balance and breaks to rows that know their previous_balance."""
    comparable = (F.col("previous_balance") != 0) & (F.col("balance") != 0)
    expected = F.when(comparable, F.col("previous_balance") - F.col("debit_amount") + F.col("credit_amount"))
    seen = seen.withColumn("expected_balance", expected.cast("decimal(18,2)"))
    return seen.withColumn(
        "breaks", F.coalesce(F.abs(F.col("expected_balance") - F.col("balance")) > p.TOLERANCE, F.lit(False))
    )


def repair_amounts(rows: DataFrame, details: DataFrame, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """Adopt the detail-section amount that mends a broken running balance.

    The first detail amount of the same file, date and side that differs from
    the row's and restores the arithmetic within 1.00 is taken; ``misread``
    keeps the printed amount. Amounts are matched by whole units around the
    one amount that would fit, so no row meets all details of its day.
    """
    seen = running_balance(rows, rows_per_block=rows_per_block)
    is_debit = F.col("debit_amount") > 0
    printed = F.when(is_debit, F.col("debit_amount")).otherwise(F.col("credit_amount"))
    other = F.when(is_debit, F.col("credit_amount")).otherwise(F.col("debit_amount"))
    drop = F.col("previous_balance") - F.col("balance")
    fitting = F.when(is_debit, drop + other).otherwise(other - drop)
    broken = seen.filter("breaks").select(
        "file_name", "pos", "sub", "date", is_debit.alias("is_debit"), printed.alias("printed"), fitting.alias("fitting")
    )
    unit = F.floor("fitting").cast("long")
    broken = broken.withColumn("unit", F.explode(F.sequence(unit - 1, unit + 1)))
    rank = F.coalesce(*[F.when(F.col("part") == s, i) for i, s in enumerate(("withdrawals", "fees", "checks", "deposits"))])
    amount = F.explode(F.filter(F.array("debit_amount", "credit_amount"), lambda a: a != 0))
    offered = (
        details.select("file_name", "date", (F.col("part") != "deposits").alias("is_debit"), rank.alias("rank"), "pos", "sub", amount.alias("amount"))
        .groupBy("file_name", "date", "is_debit", "amount")
        .agg(F.min(F.struct("rank", "pos", "sub")).alias("place"))
        .withColumn("unit", F.floor("amount").cast("long"))
    )
    matches = (
        broken.join(offered, ["file_name", "date", "is_debit", "unit"])
        .filter("abs(fitting - amount) <= 1 AND amount <> printed")
        .groupBy("file_name", "pos", "sub")
        .agg(F.min_by("amount", "place").alias("_amount"), F.first("printed").alias("misread"))
    )
    mended = rows.join(matches, ["file_name", "pos", "sub"], "left")
    found = F.col("_amount").isNotNull()
    return mended.withColumns(
        {
            "debit_amount": F.when(found & is_debit, F.col("_amount")).otherwise(F.col("debit_amount")),
            "credit_amount": F.when(found & ~is_debit, F.col("_amount")).otherwise(F.col("credit_amount")),
        }
    ).drop("_amount")


def repair_notes(repaired: DataFrame) -> DataFrame:
    """One note per repaired row: file_name, pos, sub, text."""
    amount = F.greatest("debit_amount", "credit_amount")
    text = F.concat(
        F.col("date"), F.lit(": "), F.format_number(amount, 2),
        F.lit(" was read from the statement's detail section (OCR misread "), F.format_number("misread", 2),
        F.lit("); the running balance now reconciles."),
    )
    return repaired.filter("misread IS NOT NULL").select("file_name", "pos", "sub", text.alias("text"))


def _sum_if(condition: Column, value: Column | str) -> Column:
    return F.sum(F.when(condition, F.col(value) if isinstance(value, str) else value).otherwise(0)).cast("decimal(18,2)")


def statement_totals(rows: DataFrame, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """Per file: count, sums, balance breaks, last balance, and the debit
    sums that detail sections are held against."""
    described = F.col("description")
    debit = F.col("debit_amount")
    return running_balance(rows, rows_per_block=rows_per_block).groupBy("file_name").agg(
        F.count("*").alias("transaction_count"),
        F.sum("debit_amount").cast("decimal(18,2)").alias("total_debit"),
        F.sum("credit_amount").cast("decimal(18,2)").alias("total_credit"),
        F.count_if("breaks").alias("balance_mismatches"),
        F.max_by("balance", F.struct(*ORDER)).alias("last_balance"),
        _sum_if(described.rlike(p.CHECK_WORD), debit).alias("check_debits"),
        _sum_if(described.rlike(p.CASH_WORD), debit).alias("cash_debits"),
        _sum_if(~described.rlike(p.FEE_WORD), debit).alias("other_debits"),
        _sum_if(~described.rlike(p.CHECK_OR_FEE_WORD), debit).alias("plain_debits"),
        _sum_if(described.rlike(p.FEE_WORD), debit).alias("fee_debits"),
    )


def section_totals(details: DataFrame) -> DataFrame:
    """Per file: sums of each detail section, null where it has no valid row."""
    both = F.col("debit_amount") + F.col("credit_amount")

    def total(part: str, value: Column) -> Column:
        return F.sum(F.when(F.col("part") == part, value)).cast("decimal(18,2)")

    return details.groupBy("file_name").agg(
        total("checks", both).alias("checks_total"),
        total("deposits", F.col("credit_amount")).alias("deposits_total"),
        total("withdrawals", F.col("debit_amount")).alias("withdrawals_total"),
        total("fees", both).alias("fees_total"),
    )


def _off(a: str, b: str) -> Column:
    return F.abs(F.col(a) - F.col(b)) > p.TOLERANCE


def _money(name: str) -> Column:
    return F.format_number(F.col(name), 2)


def reconciliation_warnings() -> list[Column]:
    """Text of each section that disagrees with the primary table, else null."""
    return [
        F.when(
            _off("check_debits", "checks_total"),
            F.concat(F.lit("Checks Paid totals ("), _money("checks_total"),
                     F.lit(") do not match check debits in the primary table ("), _money("check_debits"), F.lit(").")),
        ),
        F.when(
            _off("total_credit", "deposits_total"),
            F.concat(F.lit("Deposits and Other Credits totals ("), _money("deposits_total"),
                     F.lit(") do not match credits in the primary table ("), _money("total_credit"), F.lit(").")),
        ),
        F.when(
            _off("cash_debits", "withdrawals_total") & _off("other_debits", "withdrawals_total")
            & _off("plain_debits", "withdrawals_total"),
            F.concat(F.lit("Withdrawals and Other Debits totals ("), _money("withdrawals_total"),
                     F.lit(") do not match primary-table debits ("), _money("cash_debits"),
                     F.lit(" cash withdrawals / "), _money("plain_debits"), F.lit(" non-check debits).")),
        ),
        F.when(
            _off("fee_debits", "fees_total"),
            F.concat(F.lit("Account Service Charges totals ("), _money("fees_total"),
                     F.lit(") do not match primary-table fee debits ("), _money("fee_debits"), F.lit(").")),
        ),
    ]


def dropped_summary(dropped: DataFrame) -> DataFrame:
    """Per file: rows discarded and their issues, most frequent first."""
    each = dropped.select("file_name", "pos", "sub", F.posexplode("issues").alias("at", "issue"))
    counted = each.groupBy("file_name", "issue").agg(
        F.count("*").alias("n"), F.min(F.struct("pos", "sub", "at")).alias("place")
    )
    listed = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "place", "issue")))
    names = F.array_join(F.transform(listed, lambda x: F.concat((-x["n"]).cast("string"), F.lit("× "), x["issue"])), ", ")
    texts = counted.groupBy("file_name").agg(names.alias("dropped_issues"))
    counts = dropped.groupBy("file_name").agg(F.count("*").alias("dropped_rows"))
    return counts.join(texts, "file_name")


def statement_validation(
    files: DataFrame, totals: DataFrame, sections: DataFrame, header: DataFrame, dropped: DataFrame, bad_dates: DataFrame
) -> DataFrame:
    """One row per file of ``files``: totals, balances, warnings, status.

    ``header``: file_name, opening_balance, closing_balance, statement_period, …
    """
    zero = F.lit(0).cast("decimal(18,2)")
    sums = ("total_debit", "total_credit", "check_debits", "cash_debits", "other_debits", "plain_debits", "fee_debits")
    joined = files
    for side in (totals, sections, header, dropped, bad_dates):
        joined = joined.join(side, "file_name", "left")
    joined = joined.withColumns(
        {name: F.coalesce(F.col(name), zero) for name in sums}
        | {name: F.coalesce(F.col(name), F.lit(0)) for name in ("transaction_count", "balance_mismatches", "dropped_rows", "bad_dates")}
    )
    expected = (F.col("opening_balance") + F.col("total_credit") - F.col("total_debit")).cast("decimal(18,2)")
    reported = F.coalesce("closing_balance", F.when(F.col("last_balance") != 0, F.col("last_balance")))
    joined = joined.withColumns(
        {"expected_closing_balance": expected, "reported_closing_balance": reported, "fees": F.col("fees_total")}
    )
    off = F.coalesce(_off("expected_closing_balance", "reported_closing_balance"), F.lit(False))
    texts = [
        F.when(
            F.col("dropped_rows") > 0,
            F.concat("dropped_rows", F.lit(" OCR row(s) were discarded during validation ("), "dropped_issues", F.lit(").")),
        ),
        F.when(
            F.col("bad_dates") > 0,
            F.concat("bad_dates", F.lit(" row(s) with invalid or unreadable transaction dates were skipped.")),
        ),
        F.when(
            F.col("balance_mismatches") > 0,
            F.concat("balance_mismatches", F.lit(
                " transaction(s) do not follow running-balance arithmetic; OCR or layout gaps are likely.")),
        ),
        F.when(
            off,
            F.concat(
                F.lit("Reported closing balance "), _money("reported_closing_balance"),
                F.lit(" differs from the reconciled balance "), _money("expected_closing_balance"),
                F.lit(" (opening "), _money("opening_balance"), F.lit(" + credits "), _money("total_credit"),
                F.lit(" - debits "), _money("total_debit"), F.lit(")."),
            ),
        ),
        *reconciliation_warnings(),
    ]
    joined = joined.withColumn("warnings", F.filter(F.array(*texts), lambda w: w.isNotNull())).withColumn("closing_off", off)
    status = F.when(F.col("transaction_count") == 0, "error").when(F.size("warnings") > 0, "warning").otherwise("ok")
    return joined.withColumn("validation_status", status)


def validation_checks(validated: DataFrame) -> DataFrame:
    """The five checks of every statement: check, expected, actual, status, message."""
    text = lambda c: F.col(c).cast("string")
    ok = F.lit("ok")
    count, breaks = F.col("transaction_count"), F.col("balance_mismatches")

    def row(check: str, expected: Column, actual: Column, status: Column, message: Column) -> Column:
        return F.struct(
            F.lit(check).alias("check"), expected.alias("expected"), actual.alias("actual"),
            status.alias("status"), message.alias("message"),
        )

    rows = F.array(
        row("transaction_count", F.lit(">= 1"), text("transaction_count"),
            F.when(count > 0, "ok").otherwise("error"),
            F.when(count > 0, "").otherwise("No validated transactions were extracted.")),
        row("valid_dates", F.lit("all rows"), text("transaction_count"), ok, F.lit("")),
        row("no_duplicates", F.lit("0"), F.lit("0"), ok, F.lit("")),
        row("running_balance", F.lit("0"), text("balance_mismatches"), F.when(breaks > 0, "warning").otherwise("ok"),
            F.concat("balance_mismatches", F.lit(" rows deviate from running-balance arithmetic."))),
        row("closing_balance", text("expected_closing_balance"), text("reported_closing_balance"),
            F.when(F.col("closing_off"), "warning").otherwise("ok"), F.lit("")),
    )
    return validated.select("file_name", F.inline(rows))


SUMMARY_FIELDS = (
    "file_name", "document_type", "bank_name", "account_holder_name", "account_number", "ifsc_code",
    "transaction_count", "total_debit", "total_credit", "opening_balance", "closing_balance", "statement_period",
    "extraction_method", "validation_status", "fees",
)


def statement_summary(validated: DataFrame) -> DataFrame:
    return validated.select(*SUMMARY_FIELDS)
