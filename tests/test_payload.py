import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from quillbook.operators import payload

TXN = ("file_name string, pos long, sub int, date string, description string, debit_amount decimal(18,2), credit_amount decimal(18,2), "
       "balance decimal(18,2), category string, confidence double")
HEAD = "file_name string, transaction_count long, warnings array<string>"


def rows(name, n):
    made = [(name, 7 * (i // 2), i % 2, "2024-01-02", f'"transactions":[ {{row}} ]}}, {i}', Decimal("1.10"), Decimal("0.00"), None if i % 3 else Decimal(i),
             None if i % 4 else "Fees", 0.12345) for i in range(n)]
    return made[::-1]


@pytest.mark.parametrize("per_part, per_block", [(1, 1), (3, 4), (10, 9), (1000, 1 << 16)])
def test_parts_laid_end_to_end_are_the_payload(spark, per_part, per_block):
    transactions = spark.createDataFrame(rows("a", 30) + rows("b", 1) + rows("nobody", 2), TXN)
    heads = spark.createDataFrame([("a", 30, ['quote " }', "]"]), ("b", 1, None), ("none", 0, []), ("nulls", None, None)], HEAD)
    whole = {r.file_name: r.payload for r in payload.statement_payload(heads, transactions, ["transaction_count"]).collect()}
    parts = payload.payload_parts(heads, transactions, ["transaction_count"], per_part, per_block)
    found = {}
    for r in sorted(parts.collect(), key=lambda r: (r.file_name, r.part)):
        assert r.part == len(found.setdefault(r.file_name, [])) and r.first_row == r.part * per_part
        found[r.file_name].append(r)
    assert {n: "".join(r.text for r in p) for n, p in found.items()} == whole
    assert all(p[0].parts == len(p) for p in found.values()) and len(found["a"]) == -(-30 // per_part)
    assert all(json.loads(t) is not None for t in whole.values())
    one_value = payload.payload_rows(payload.statement_payload(heads, transactions, ["transaction_count"]))
    assert sorted(map(str, payload.part_rows(parts).collect())) == sorted(map(str, one_value.withColumn("row_no", F.col("row_no").cast("long")).collect()))


def test_no_statements(spark):
    heads, transactions = spark.createDataFrame([], HEAD), spark.createDataFrame([], TXN)
    assert payload.payload_parts(heads, transactions, ["transaction_count"]).count() == 0
