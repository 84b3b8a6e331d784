"""SQL-callable forms of the scalar functions (inlined by the optimizer)."""

from __future__ import annotations

from pyspark.sql import SparkSession

from quillbook.functions import dates, money, text

SQL_FUNCTIONS = {
    "qb_date_token": ("x STRING", "STRING", dates.date_token("x")),
    "qb_normalize_date": ("x STRING", "STRING", dates.normalize_date(dates.squeezed("x"))),
    "qb_money_strength": ("x STRING", "STRING", money.money_strength("x")),
    "qb_to_amount": ("x STRING", "DECIMAL(18,2)", money.to_amount("x")),
    "qb_cell_amount": ("x STRING", "DECIMAL(18,2)", money.cell_amount("x")),
    "qb_clean_description": ("x STRING", "STRING", text.clean_description("x")),
    "qb_word_tokens": ("x STRING", "ARRAY<STRING>", text.word_tokens("x")),
}


def register_sql_functions(spark: SparkSession) -> None:
    for name, (arguments, result, body) in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {result} RETURN {body}")
