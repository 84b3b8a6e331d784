import random
import re
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from quillbook.functions import patterns as p
from quillbook.operators import categorize, checks, choose, lines, metadata, rows, tables
from quillbook.plans.statement import process_statements

US_LAYOUT = """NORTHERN SAVINGS BANK
JANE Q. PUBLIC
12 MAIN STREET
Account
Number:
98-765432
Beginning balance on March 1 $100.00
Ending balance on March 31 $ 130.26 Avg Collected Balance $643.24
Account transactions by date with daily balance
Date Description Debit Credit Balance
03/02 DEPOSIT CREDIT 0.00 50.00 150.00
03/05 CHECK 1001 20.00 0.00 130.00
03/09 INTEREST CREDIT 0.00 26.00 130.26
Deposits and other credits
Date Description Amount
03/02 DEPOSIT CREDIT 50.00
03/09 INTEREST CREDIT 0.26
Checks paid
Check # Date Amount Check # Date Amount
1001 03/05 $20.00 1002* 02/29 $7.00
"""
FAULTY = """Date Particulars Amount Balance
01/02/2024 SHOP 450.00 DR 12000.00
paid at night
01/02/2024 SHOP 450.00 DR 12000.00
paid at night
00-00-00 GHOST 5.00 11995.00
02/02/2024 AT 12:30 TERMINAL 24349201 REF 77 10.00 11990.00
03/02/2024 BOTH 5.00 6.00 11991.00
Total 1,000.00
Page 1
"""


def read(df, *columns):
    return [tuple(r) for r in df.orderBy("file_name", "pos", "sub").select(*columns).collect()]


@pytest.fixture(scope="module")
def us_tables(spark):
    from quillbook.functions.text import lines_of_text

    df = spark.createDataFrame([("us.txt", US_LAYOUT), ("odd.txt", FAULTY), ("none.txt", "hello\nworld")], "file_name string, text string")
    page = lines_of_text(df).select("file_name", F.lit(1).alias("page_no"), "line_no", "text")
    return process_statements(page, rows_per_block=4)


def test_us_layout(us_tables):
    found = read(us_tables.transactions.filter("file_name = 'us.txt'"), "date", "description", "debit_amount", "credit_amount")
    assert found == [
        ("03/02", "DEPOSIT CREDIT", Decimal("0.00"), Decimal("50.00")),
        ("03/05", "CHECK 1001", Decimal("20.00"), Decimal("0.00")),
        ("03/09", "INTEREST CREDIT", Decimal("0.00"), Decimal("0.26")),
    ]
    note = us_tables.notes.collect()
    assert len(note) == 1 and note[0].text.startswith("03/09: 0.26 was read from the statement's detail section (OCR misread 26.00)")
    row = us_tables.statements.filter("file_name = 'us.txt'").first()
    assert (row.bank_name, row.account_holder_name, row.account_number) == ("NORTHERN SAVINGS BANK", "JANE Q. PUBLIC", None)
    assert (row.opening_balance, row.closing_balance, row.statement_period) == (Decimal("100.00"), Decimal("130.26"), "March 1 to March 31")
    assert (row.validation_status, row.warnings, row.extraction_method) == ("ok", [], "line_window")
    section = read(us_tables.sections, "part", "date", "debit_amount", "credit_amount")
    assert ("checks", "03/05", Decimal("20.00"), Decimal("0.00")) in section and len(section) == 3


def test_faulty_rows(us_tables):
    found = read(us_tables.transactions.filter("file_name = 'odd.txt'"), "description", "debit_amount", "balance")
    assert found == [
        ("SHOP paid at night", Decimal("450.00"), Decimal("12000.00")),
        ("AT 12:30 TERMINAL 24349201 REF 77", Decimal("10.00"), Decimal("11990.00")),
    ]
    rejected = us_tables.rejected.collect()
    assert [(r.description, r.issues) for r in rejected] == [("BOTH", ["both debit and credit present"])]
    row = us_tables.statements.filter("file_name = 'odd.txt'").first()
    assert row.warnings == [
        "1 OCR row(s) were discarded during validation (1× both debit and credit present).",
        "1 row(s) with invalid or unreadable transaction dates were skipped.",
    ]


def test_file_without_rows(us_tables):
    row = us_tables.statements.filter("file_name = 'none.txt'").first()
    assert (row.validation_status, row.transaction_count) == ("error", 0)
    assert row.warnings == ["No transaction rows could be parsed from this document."]
    checked = {r.check: r.status for r in us_tables.checks.filter("file_name = 'none.txt'").collect()}
    assert checked["transaction_count"] == "error" and len(checked) == 5


def test_section_roles_equal_a_plain_fold(spark):
    rng = random.Random(11)
    words = [
        "Checks Paid", "Deposits and Other Credits", "Deposits and other credits 5.00", "Account Summary",
        "Date Description Amount Balance", "01/02/2024 ROW 5.00", "letter", "Account Service Charges and Fees",
    ]
    files = [(f"f{n}", 1 + i // 9, i, rng.choice(words)) for n in range(25) for i in range(rng.randint(1, 20))]
    df = spark.createDataFrame(files, "file_name string, page_no int, line_no long, text string")
    got = {(r.file_name, r.line_no): r.region for r in lines.section_roles(df, rows_per_block=3).collect()}
    wanted, state = {}, {}
    for name, page, at, line in files:
        state.setdefault((name, page), None)
        title = None
        if not re.search(r"\d", line):
            title = next((k for k, pat in p.SECTION_TITLES if re.search(pat, line)), None)
        if title:
            state[(name, page)] = title
        elif re.search(p.SUMMARY_TITLE, line):
            state[(name, page)] = None
        else:
            if re.search(p.TABLE_HEADER, line) and state[(name, page)] in (None, "table"):
                state[(name, page)] = "table"
            wanted[(name, at)] = state[(name, page)]
    assert got == wanted


@pytest.mark.parametrize("rows_per_block", [2, 1 << 16])
def test_text_without_header_falls_back(to_lines, rows_per_block):
    page = to_lines(a="intro 01/02/2024 ABC 5.00 77.00 more 02/02/2024 DEF 6.00\nPage 1\nCoffee 12\nChecks Paid\n03/02/2024 X 1.00")
    parts = lines.split_parts(page, rows_per_block)
    parsed = rows.parse_parts(parts, rows_per_block=rows_per_block).filter("part = 'primary'")
    assert read(parsed, "date", "description", "debit_amount", "balance") == [
        ("2024-02-01", "ABC more", Decimal("5.00"), Decimal("77.00")),
        ("2024-02-02", "DEF Coffee 12", Decimal("6.00"), Decimal("0.00")),
        ("2024-02-03", "X", Decimal("1.00"), Decimal("0.00")),
    ]


@pytest.mark.parametrize(
    "line, number",
    [("Account Number: 12-3456", None), ("A/C No. 1234567XXXX", "1234567"), ("Account No: TIVITYX", None),
     ("Acct No 00112233", "00112233"), ("Account Number: xxxxxx", None)],
)
def test_account_numbers(to_lines, line, number):
    assert metadata.statement_metadata(to_lines(a=line)).first().account_number == number


def test_labels_over_two_lines(to_lines):
    row = metadata.statement_metadata(
        to_lines(a="Account\nNumber:\n12345678\nIFSC CODE\nabcd0123456\nCustomer Name: Jo Doe  Branch X\nOpening Balance 5.00 of 7.25")
    ).first()
    assert (row.account_number, row.ifsc_code, row.account_holder_name, row.opening_balance) == (
        "12345678", "ABCD0123456", "Jo Doe", Decimal("7.25"),
    )


def cells(spark, *rows_):
    return spark.createDataFrame([("t.csv", i, list(r)) for i, r in enumerate(rows_)], "file_name string, row_no long, cells array<string>")


def test_single_amount_column(spark):
    header, shop, pay = ["Date", "Description", "Amount"], ["01/02/2024", "SUBSCRIPTION", "5.00"], ["02/02/2024", "SALARY", "9.00"]
    table = cells(spark, header, shop, ["", "night", ""], pay)
    sides = ("description", "debit_amount", "credit_amount")
    assert read(tables.table_transactions(table), *sides) == [
        ("SUBSCRIPTION night", Decimal("5.00"), Decimal("0.00")), ("SALARY", Decimal("0.00"), Decimal("9.00")),
    ]
    parity = read(tables.table_transactions(table, strict_parity=True), *sides)
    assert parity[1] == ("SALARY", Decimal("9.00"), Decimal("0.00"))
    withbal = cells(spark, header + ["Balance"], shop + ["70.00"])
    assert read(tables.table_transactions(withbal, strict_parity=True), *sides) == [("SUBSCRIPTION", Decimal("0.00"), Decimal("5.00"))]
    assert read(tables.table_transactions(withbal), *sides) == [("SUBSCRIPTION", Decimal("5.00"), Decimal("0.00"))]


def test_headerless_table_is_read_as_text(spark):
    table = cells(spark, ["01/02/2024", "SHOP", "5.00", "95.00"], ["Total", "5.00"])
    assert read(tables.table_transactions(table), "date", "description", "debit_amount", "balance") == [
        ("2024-02-01", "SHOP", Decimal("5.00"), Decimal("95.00"))
    ]


def test_quality_beats_row_count(spark):
    row = ("f", 1, 0, "2024-01-01", "A", 5.0, 0.0, 95.0)
    good = [(*row, "pdf_tables"), ("f", 2, 0, "2024-01-02", "B", 5.0, 0.0, 90.0, "pdf_tables")]
    many = [("f", i, 0, "2024-01-01", f"x{i}", 5.0, 5.0 * (i % 2), 0.0, "line_window") for i in range(9)]
    df = spark.createDataFrame(
        good + many,
        "file_name string, pos long, sub int, date string, description string, debit_amount double, credit_amount double, balance double, strategy string",
    ).withColumns({c: F.col(c).cast("decimal(18,2)") for c in ("debit_amount", "credit_amount", "balance")})
    assert choose.pick_strategy(choose.score_candidates(df)).first().strategy == "pdf_tables"


def test_retry_pick(spark):
    df = spark.createDataFrame([("a", "native", 1), ("a", "ocr", 5), ("b", "native", 1), ("b", "ocr", 1), ("c", "native", 3)], "file_name string, source string, n long")
    assert {r.file_name: r.source for r in choose.retry_pick(df).collect()} == {"a": "ocr", "b": "native", "c": "native"}


def test_rules(spark):
    rows_ = [("PAYROLL", 0.0, 5.0), ("PAYROLL RENT", 5.0, 0.0), ("COFFEE", 5.0, 0.0), ("UPI X", 5.0, 0.0), ("?", 0.0, 5.0), ("?", 0.0, 0.0)]
    df = spark.createDataFrame(rows_, "description string, debit_amount double, credit_amount double")
    got = [(r.rule_category, r.rule_confidence) for r in categorize.with_rules(df).collect()]
    assert got == [("Salary", 0.93), ("Housing", 0.93), ("Bank Charges", 0.93), ("Transfer", 0.7), ("Income", 0.4), ("Unknown", 0.2)]
    own = spark.createDataFrame([(2, "B", "x"), (1, "A", "off"), (1, "A", "z")], "priority int, category string, keyword string")
    by_table = {(r.description, float(r.credit_amount)): r.rule_category for r in categorize.with_rule_table(df, own).collect()}
    assert by_table[("COFFEE", 0.0)] == "A" and by_table[("UPI X", 0.0)] == "B" and by_table[("?", 5.0)] == "Income"


def test_repair_offers_are_pre_aggregated(spark):
    """Thousands of equal details for one date meet a broken row once."""
    rows_ = spark.createDataFrame(
        [("f", 1, 0, "d", "A", "5.00", "0.00", "100.00"), ("f", 2, 0, "d", "B", "900.00", "0.00", "91.00")],
        "file_name string, pos long, sub int, date string, description string, debit_amount string, credit_amount string, balance string",
    )
    details = spark.range(3000).selectExpr("'f' file_name", "'withdrawals' part", "id pos", "0 sub", "'d' date", "'x' description",
                                           "'9.00' debit_amount", "'0.00' credit_amount", "'0.00' balance")
    decimals = {c: F.col(c).cast("decimal(18,2)") for c in ("debit_amount", "credit_amount", "balance")}
    fixed = checks.repair_amounts(rows_.withColumns(decimals), details.withColumns(decimals)).orderBy("pos").collect()
    assert [(r.debit_amount, r.misread) for r in fixed] == [(Decimal("5.00"), None), (Decimal("9.00"), Decimal("900.00"))]


def test_letterheads_of_large_customer_keys_have_balances(spark, tmp_path):
    from quillbook.sources import derived

    spark.sql("SELECT explode(array(4L, 10000000000000000L)) AS c_custkey").write.parquet(f"{tmp_path}/customer.parquet")
    found = {r.text for r in derived.letterheads(spark, str(tmp_path)).filter("text LIKE 'Opening%'").collect()}
    assert found == {"Opening Balance: 4,000.50", "Opening Balance: 10,000,000,000,000,000,000.50"}


def test_pattern_words_leave_no_match_out(spark):
    from quillbook.operators.lines import _matches

    texts = [
        "BEGINNING  Balance", "ending balance", "Brought Forward", "carried\tforward", "Sub TOTAL", "Page 3", "Statement Summary",
        "This is a Computer printed page", "B/F 10", "c/f", "Transaction Count", "No. of Transactions", "ledger balance", "Summary of your ACCOUNT",
        "Account Activity", "Statement of account", "Deposits and other Credits", "WITHDRAWAL and other debit", "Account service charges and fees",
        "CHECKS PAID", "Txn Date Narration Debit", "Val Date Details Balance", "plain words",
    ]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    titles = [(pattern, (p.TITLE_WORDS[key],)) for key, pattern in p.SECTION_TITLES]
    for pattern, words in [(p.NOISE_LINE, p.NOISE_WORDS), (p.BALANCE_LABEL, p.BALANCE_WORDS), (p.SUMMARY_TITLE, p.SUMMARY_WORDS), (p.TABLE_HEADER, p.HEADER_WORDS), *titles]:
        assert df.filter(F.col("text").rlike(pattern)).count() == df.filter(_matches(pattern, words)).count() > 0


@pytest.mark.parametrize("rows_per_block", [2, 1 << 16])
def test_large_and_small_files_have_the_same_fields(to_lines, rows_per_block):
    page = to_lines(
        a="UNION BANK\nAda Stone\n12 Elm Street\nAccount\nNumber:\n12345678\nOpening Balance 7.25\nx\ny\nClosing\nbalance\nas of\nJanuary 31\n9.00",
        b="nothing here", c="\n".join(["line"] * 19) + "\nAda Stone\n12 Elm Street\nIFSC abcd0123456",
    )
    got = {r.file_name: tuple(r)[2:6] for r in metadata.statement_metadata(page, rows_per_block).collect()}
    assert got == {
        "a": ("Ada Stone", "12345678", None, Decimal("7.25")), "b": (None,) * 4, "c": (None, None, "ABCD0123456", None),
    }


@pytest.mark.parametrize("rows_per_block", [1, 1 << 16])
def test_scores_do_not_depend_on_the_size_of_a_candidate(spark, rows_per_block):
    """A dropped row between two valid ones is no row before; copies count; an unknown balance is compared with none."""
    rows_ = [
        (1, "2024-01-01", "A", "5.00", "0.00", "95.00"), (2, "00-00-00", "B", "5.00", "0.00", "1.00"), (3, "2024-01-02", "C", "5.00", "0.00", "90.00"),
        (4, "2024-01-02", "c", "5.00", "0.00", "90.00"), (5, "2024-01-03", "D", "20000000.00", "0.00", None), (6, "2024-01-04", "E", "1.00", "0.00", "89.00"),
        (7, "01/02/2024", "Page 3", "1.00", "0.00", "89.00"), (8, "5 Jan 2024", "F", "0.00", "1.00", "90.00"),
    ]
    df = spark.createDataFrame([("f", *r) for r in rows_], "file_name string, pos long, date string, description string, debit_amount string, credit_amount string, balance string")
    df = df.withColumns({c: F.col(c).cast("decimal(18,2)") for c in ("debit_amount", "credit_amount", "balance")}).withColumn("sub", F.lit(0))
    both = df.withColumn("strategy", F.lit("pdf_tables")).unionByName(df.filter("pos = 2").withColumn("strategy", F.lit("box_columns")))
    got = {r.strategy: tuple(r)[2:] for r in choose.score_candidates(both, rows_per_block).collect()}
    assert got == {"pdf_tables": (8, 5, 2, 1, 9.0 + 5.0 * 2 / 4 - 4.0 - 1.5 - 1.0), "box_columns": (1, 0, 1, 0, float("-inf"))}


def test_sound_rows_are_the_ones_without_issues(spark):
    days = ["2024-01-01", "2024-02-30", "0000-01-01", "2024-1-1", " 2024-01-01", "01/02/2024", "00-00-00", "", None, "-001-01-01", "+202-01-01", "2024-01-0\u0661"]
    words = ["A", "", "  ", None, "x" * 301, "Sub TOTAL debits", "Other", "Deposits and Other Credits", "Closing  BALANCE"]
    sides = [("1", "0"), ("0", "1"), ("1", "1"), ("0", "0"), ("-1", "0"), ("1000000001", "0"), (None, "1"), (None, None)]
    every = [(d, w, *s) for d in days for w in words for s in sides]
    df = spark.createDataFrame(every, "date string, description string, debit_amount string, credit_amount string")
    df = df.withColumns({c: F.col(c).cast("decimal(18,2)") for c in ("debit_amount", "credit_amount")})
    full = checks.issues()
    told = checks.with_issues(df.select("*", full.alias("wanted")).localCheckpoint()).collect()
    assert all(r.issues == r.wanted for r in told) and len(told) == len(every)


def test_secondary_words_leave_no_match_out(spark):
    texts = [
        "Opening  balance", "CLOSING BALANCE", "brought forward", "Carried\tForward", "Statement of Account", "summary of your account", "ACCOUNT summary",
        "Deposit and other credit", "WITHDRAWALS and Other Debits", "account service charge and fees", "Checks Paid", "Account transactions by type",
        "page 3", "Statement Summary", "TOTAL debits", "total charges", "plain",
    ]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    found = lines._matches(p.SECONDARY_TEXT, p.SECONDARY_WORDS)
    assert df.filter(F.col("text").rlike(p.SECONDARY_TEXT)).count() == df.filter(found).count() == len(texts) - 1
