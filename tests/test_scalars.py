from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from quillbook.functions import dates, money, text
from quillbook.functions.register import register_sql_functions
from quillbook.operators.documents import unique_names


def values(spark, expr, inputs):
    rows = [(i, x) for i, x in enumerate(inputs)]
    df = spark.createDataFrame(rows, "i int, x string")
    return [r.y for r in df.select("i", F.expr(expr).alias("y")).orderBy("i").collect()]


def test_dates(spark):
    cases = {
        "03/09/2024": "2024-09-03", "12/31/2024": "2024-12-31", "31/12/24": "2024-12-31", "12/31/24": None,
        "02-09-69": "1969-09-02", "02-09-68": "2068-09-02", "2024-02-30": None, "00-00-00": None,
        "19-Sep-2024": "2024-09-19", "10 sept 2024": None, "10 September 2024": "2024-09-10", "3.9.24": None,
        "29/02": None, "10/12": "10/12", "13/25": None, "10 Feb": "10 Feb", "2024-13": None, "09/2024": "09/2024",
    }
    assert values(spark, dates.normalize_date("x"), cases) == list(cases.values())


def test_date_tokens(spark):
    cases = {
        "on 03/09/2024 x": "03/09/2024", "12 CHECK 1236": "", "09/2024": "09/20", "5 May 2020, 6": "5 May 2020",
        "ref 2024-1-2": "2024-1-2", "19-Sep": "19-Sep",
    }
    assert values(spark, dates.date_token("x"), cases) == list(cases.values())


def test_money_strength(spark):
    cases = {
        "1,234.50": "strong", "1,234": "weak", "(1000)": "weak", "500CR": "weak", "500.00DR": "strong", "$5.00": "",
        "-5.00": "", "INR500": "", "12:30": "", "123456789": "", "12345678": "weak", "PAY": "",
    }
    assert values(spark, money.money_strength("x"), cases) == list(cases.values())


@pytest.mark.parametrize(
    "token, default, parity",
    [("INR500.00", "500.00", "0.00"), ("Rs.500.00", "500.00", "500.00"), ("rs.500.00", "500.00", "0.00"),
     ("(12.50)", "-12.50", "-12.50"), ("1,000.00 CR", "1000.00", "1000.00"), ("x", "0.00", "0.00")],
)
def test_amounts(spark, token, default, parity):
    assert values(spark, money.to_amount("x"), [token]) == [Decimal(default)]
    assert values(spark, money.to_amount("x", True), [token]) == [Decimal(parity)]


def test_cells_of_nine_digits(spark):
    cells = ["1000000.00", "999999.00", "", "12345678901", "-7.00"]
    assert values(spark, money.cell_amount("x"), cells) == [Decimal(v) for v in ("1000000", "999999", "0", "0", "7")]
    assert values(spark, money.cell_amount("x", True), cells)[0] == 0


def test_descriptions_and_lines(spark):
    assert values(spark, text.clean_description("x"), ["10/04  POS   BUY", "  ", "A 10/04"]) == ["POS BUY", "Transaction", "A 10/04"]
    df = spark.createDataFrame([(1, " a \r\n\r\n\tb\fc  ")], "k int, text string")
    assert [(r.line_no, r.text) for r in text.lines_of_text(df).orderBy("line_no").collect()] == [(0, "a"), (2, "b"), (3, "c")]


def test_model_output(spark):
    df = spark.createDataFrame([('[{"text":" a "},"b",{}]',), ('{"text":"c"}',), ('"d "',), ("e",)], "x string")
    assert [r.y for r in df.select(text.content_text("x").alias("y")).collect()] == ["a\nb", "c", "d", "e"]
    replies = ['Sure: {"document_type":"bill","risks":["r"]} end {', "none", '{"key_findings":"text"}', '{"a":']
    df = spark.createDataFrame([(r,) for r in replies], "x string").select(text.parse_analysis("x").alias("y"))
    first, *rest = [r.y for r in df.collect()]
    assert (first.document_type, first.risks, first.classification, first.key_findings) == ("bill", ["r"], "unknown", [])
    assert rest == [None, None, None]


def test_titles(spark):
    df = spark.createDataFrame([("x" * 60,), ("short",), ("",)], "t string")
    titled = df.select(text.conversation_title("t").alias("a"), text.list_label("t").alias("b")).collect()
    assert [r.a for r in titled] == ["x" * 50 + "...", "short", ""]
    assert [r.b for r in titled] == ["x" * 25 + "...", "short", "New Chat"]


def test_sql_functions(spark):
    register_sql_functions(spark)
    row = spark.sql("SELECT qb_normalize_date(' 3/9/2024 ') d, qb_to_amount('(5.00)') a, qb_word_tokens('INT.PD x') w").first()
    assert (row.d, row.a, row.w) == ("2024-09-03", Decimal("-5.00"), ["int", "pd"])


def test_unique_names(spark):
    df = spark.createDataFrame([(["a", None, " a", "nan", "a", ""],), ([],), (None,)], "n array<string>")
    got = [r.names for r in df.select(unique_names(F.col("n")).alias("names")).collect()]
    assert got == [["a", "Column", "a_2", "Column_2", "a_3", "Column_3"], [], None]


def test_large_cell_amounts(spark):
    cells = ["123,456,789.00", "123456789.00", "1,00,00,00,000.50", "(987654321.25)", "123456789", "12345678", "Rs. 999999999999.99", "TXN 1234567890123", "x"]
    got = spark.createDataFrame([(c,) for c in cells], "x string").select(F.expr(money.cell_amount("x")), F.expr(money.cell_amount("x", True))).collect()
    assert [float(r[0]) for r in got] == [123456789.0, 123456789.0, 1000000000.5, -987654321.25, 0, 12345678, 999999999999.99, 0, 0]
    assert [float(r[1]) for r in got][4:6] == [12345678, 12345678]  # the first eight digits, as a parity reading
