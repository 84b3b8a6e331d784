"""Transactions from table rows: header labels, mapped cells, continuations.

Input ``cells``: keys, row_no, cells (array of strings).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillbook.functions import dates, money, text
from quillbook.functions import patterns as p
from quillbook.operators.blocks import ROWS_PER_BLOCK, ordered
from quillbook.operators.lets import let
from quillbook.operators.rows import parse_chunks
from quillbook.session import materialize

ROLES = ("date", "description", "debit", "credit", "balance", "amount")


def header_mapping(cells: str) -> str:
    """SQL text: struct of zero-based column numbers by role, null when the row
    is no header (it needs a date and one of debit, credit, amount).

    Each label takes the first role it fits. Date, debit and credit keep their
    first column, the others their last.
    """
    label = "lower(c)"
    fits = {
        "date": f"{label} like '%date%' AND s.date IS NULL",
        "description": f"{label} rlike 'narration|particular|description|details|remarks'",
        "debit": f"{label} rlike 'withdraw|debit|dr' AND s.debit IS NULL",
        "credit": f"{label} rlike 'deposit|credit|cr' AND s.credit IS NULL",
        "balance": f"{label} like '%balance%'",
        "amount": f"trim({label}) IN ('amount', 'txn amount', 'transaction amount')",
    }
    chosen = "CASE " + " ".join(f"WHEN {test} THEN '{role}'" for role, test in fits.items()) + " END"
    start = ", ".join(f"'{role}', cast(NULL as int)" for role in ROLES)
    step = ", ".join(f"'{role}', if(r = '{role}', s.i, s.{role})" for role in ROLES)
    # the role of a label is bound once per label by a one-element transform
    fold = f"""aggregate({cells}, named_struct('i', 0, {start}),
        (s, c) -> get(transform(array(coalesce({chosen}, '')), r -> named_struct('i', s.i + 1, {step})), 0),
        s -> named_struct({", ".join(f"'{role}', s.{role}" for role in ROLES)}))"""
    return f"""get(filter(array({fold}), m -> m.date IS NOT NULL
        AND (m.debit IS NOT NULL OR m.credit IS NOT NULL OR m.amount IS NOT NULL)), 0)"""


def with_mapping(rows: DataFrame, cells: str = "cells") -> DataFrame:
    """Add ``mapping`` to rows that could be headers (a cell names a date)."""
    maybe = f"exists({cells}, c -> c rlike '(?i)date')"
    return let(rows, mapping=F.expr(f"CASE WHEN {maybe} THEN {header_mapping(cells)} END"))


def clean_cells(rows: DataFrame) -> DataFrame:
    """Squeeze every cell; drop rows that are empty throughout."""
    cleaned = F.expr(f"transform(cells, c -> {text.render_cell('c')})")
    return rows.filter("exists(cells, c -> c <> '')").withColumn("cells", cleaned)


def _at(role: str) -> str:
    return f"get(cells, _header.mapping.{role})"


def mapped_rows(rows: DataFrame, keys: list[str], strict_parity: bool = False) -> DataFrame:
    """Transactions of rows whose ``_header`` names their columns.

    A lone amount column is a credit when its cell says CR or the description
    has a credit word. ``strict_parity`` looks for CR in the whole row, and
    reads every amount without a balance as a debit.
    """
    rows = let(
        rows,
        _when=F.expr(dates.date_token(f"coalesce(nullif({_at('date')}, ''), _joined)")),
        _words=F.expr(f"if(_header.mapping.description < size(cells), {_at('description')}, _joined)"),
        _debit=F.expr(f"abs({money.cell_amount(_at('debit'), strict_parity)})"),
        _credit=F.expr(f"abs({money.cell_amount(_at('credit'), strict_parity)})"),
        _amount=F.expr(money.cell_amount(_at("amount"), strict_parity)),
        _balance=F.expr(money.cell_amount(_at("balance"), strict_parity)),
    )
    rows = let(
        rows,
        _words=F.coalesce("_words", "_joined"),
        date=F.expr(dates.normalize_date("_when")),
        _values=F.expr("array(_amount, _balance)" if strict_parity else
                       "if(_balance = 0, array(_amount), array(_amount, _balance))"),
        _mark=F.expr("_joined" if strict_parity else f"upper({_at('amount')})"),
    )
    single = "coalesce(_amount, 0) <> 0 AND coalesce(_debit, 0) = 0 AND coalesce(_credit, 0) = 0"
    columns = "named_struct('debit_amount', coalesce(_debit, 0), 'credit_amount', coalesce(_credit, 0), 'balance', _balance)"
    rows = let(
        rows,
        _sides=F.expr(f"CASE WHEN {single} THEN {money.split_amounts('_words', '_values', '_mark')} ELSE {columns} END"),
        description=F.expr(text.clean_description("_words")),
    )
    return rows.filter("date IS NOT NULL").select(
        *keys, F.col("row_no").alias("pos"), F.lit(0).alias("sub"), "date", "description", "_sides.*"
    ).filter("debit_amount <> 0 OR credit_amount <> 0").select(
        *keys, "pos", "sub", "date", "description",
        *[F.col(c).cast(money.MONEY_TYPE).alias(c) for c in ("debit_amount", "credit_amount", "balance")],
    )


def append_continuations(
    parsed: DataFrame, body: DataFrame, keys: list[str], rows_per_block: int = ROWS_PER_BLOCK
) -> DataFrame:
    """Add the text of undated rows to the transaction above them.

    ``body``: keys, row_no, extra (the row's text) of all rows read, parsed or not.
    """
    marked = body.join(
        parsed.select(*keys, F.col("pos").alias("row_no"), F.lit(True).alias("_parsed")), [*keys, "row_no"], "left"
    )
    placed = ordered(
        marked, keys, "row_no", latest={"_above": F.when(F.col("_parsed"), F.col("row_no"))}, rows_per_block=rows_per_block
    )
    extra = (
        placed.filter("_parsed IS NULL AND _above IS NOT NULL AND extra <> ''")
        .filter(~F.expr(dates.has_date("extra")))
        .groupBy(*keys, F.col("_above").alias("pos"))
        .agg(F.array_sort(F.collect_list(F.struct("row_no", "extra"))).alias("_more"))
        .select(*keys, "pos", F.array_join(F.transform("_more", lambda m: m["extra"]), " ").alias("_more"))
    )
    joined = parsed.join(extra, [*keys, "pos"], "left")
    return joined.withColumn("description", F.concat_ws(" ", "description", "_more")).select(parsed.columns)


def table_transactions(
    cells: DataFrame,
    keys: list[str] | None = None,
    strict_parity: bool = False,
    rows_per_block: int = ROWS_PER_BLOCK,
) -> DataFrame:
    """Transactions of delimited rows. Rows below the first header row are read
    by column; without any header each row is read as text."""
    keys = keys or ["file_name"]
    rows = with_mapping(clean_cells(cells))
    rows = ordered(
        rows,
        keys,
        "row_no",
        smallest={"_header": F.when(F.col("mapping").isNotNull(), F.struct("row_no", "mapping"))},
        rows_per_block=rows_per_block,
    ).filter("_header IS NULL OR row_no > _header.row_no")
    rows = let(rows, _joined=F.array_join("cells", " "), extra=F.array_join(F.filter("cells", lambda c: c != ""), " "))
    rows = rows.filter(~(F.col("_joined").rlike(p.NOISE_LINE) & ~F.expr(dates.has_date("_joined"))))
    rows = materialize(rows.select(*keys, "row_no", "cells", "_header", "_joined", "extra"))
    by_column = mapped_rows(rows.filter("_header IS NOT NULL"), keys, strict_parity)
    as_text = rows.filter("_header IS NULL").select(
        *keys, F.col("row_no").alias("pos"), F.lit(0).alias("sub"), F.col("_joined").alias("chunk")
    )
    parsed = by_column.unionByName(parse_chunks(as_text, keys, strict_parity).select(by_column.columns))
    parsed = materialize(parsed)
    return append_continuations(parsed, rows.select(*keys, "row_no", "extra"), keys, rows_per_block)


def row_chunks(cells: DataFrame, section: Column) -> DataFrame:
    """One text chunk per row: non-null cells joined by ' | ', with its section
    and an excerpt. Rows count from 1; empty ones are dropped."""
    body = text.clean_line(F.array_join("cells", " | "))
    place = F.concat(section, F.lit(", row "), F.col("row_no"))
    return (
        cells.select("file_name", "row_no", body.alias("text"), place.alias("section"))
        .filter("text <> ''")
        .withColumn("excerpt", F.substring("text", 1, 300))
    )


