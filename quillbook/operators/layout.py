"""Word boxes to lines and table columns.

Tokens: file_name, page_no, token_no, text, x0, x1, y0, y1, cx, cy. A printed
page is the unit of work; a file of many pages spreads over many tasks.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillbook.functions import dates
from quillbook.functions import patterns as p
from quillbook.operators.blocks import ROWS_PER_BLOCK
from quillbook.operators.lets import let
from quillbook.operators.lines import PAGE_STRIDE, section_roles
from quillbook.operators.rows import keep_first
from quillbook.operators.tables import append_continuations, header_mapping, mapped_rows
from quillbook.session import materialize

# --- fixed values: how far a glyph may sit from its line's centre -------------
TOLERANCE_RATIO, TOLERANCE_MIN, TOLERANCE_MAX = 0.4, 3.0, 12.0
WORD_BUCKET = 4.0
PAGE = ["file_name", "page_no"]


def token_lines(tokens: DataFrame) -> DataFrame:
    """Reading-order lines: file_name, page_no, line_no, text, tokens (left to right).

    Tokens by height join the line while they stay within a tolerance of its
    running mean centre; the tolerance follows the page's median glyph height.
    """
    token = F.struct("cy", "cx", "token_no", "text")
    height = F.when(F.col("y1") > F.col("y0"), F.col("y1") - F.col("y0"))
    pages = tokens.filter("trim(text) <> ''").groupBy(*PAGE).agg(
        F.array_sort(F.collect_list(token)).alias("t"), F.array_sort(F.collect_list(height)).alias("h")
    )
    tolerance = f"""coalesce(least({TOLERANCE_MAX}D, greatest({TOLERANCE_MIN}D,
        {TOLERANCE_RATIO}D * get(h, cast(size(h) div 2 as int)))), {TOLERANCE_MAX}D)"""
    numbered = pages.select(*PAGE, "t", _line_numbers(F.col("t.cy"), F.expr(tolerance)).alias("n"))
    each = numbered.select(*PAGE, F.explode(F.arrays_zip("t", "n")).alias("z")).select(
        *PAGE, F.col("z.n").alias("line_no"), F.struct("z.t.cx", "z.t.cy", "z.t.token_no", "z.t.text").alias("token"))
    return (
        each.groupBy(*PAGE, "line_no").agg(F.array_sort(F.collect_list("token")).alias("tokens"))
        .select(
            *PAGE,
            F.col("line_no").cast("long").alias("line_no"),
            F.array_join(F.transform("tokens", lambda t: t["text"]), " ").alias("text"),
            "tokens",
        )
    )


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _line_numbers(centres: pd.Series, tolerance: pd.Series) -> pd.Series:
    """Line of each of a page's tokens, given their centres from the top down."""

    def walk(page: list[float], reach: float) -> list[int]:
        numbers, line, n, mean = [], -1, 0, 0.0
        for y in page:
            if n and abs(y - mean) <= reach:
                n += 1
                mean += (y - mean) / n
            else:
                line, n, mean = line + 1, 1, y
            numbers.append(line)
        return numbers

    return pd.Series([walk(c.tolist(), r) for c, r in zip(centres, tolerance, strict=True)])


def word_lines(words: DataFrame) -> DataFrame:
    """Lines of native words: vertical buckets of four units, left to right."""
    bucket = F.bround(F.col("y0") / WORD_BUCKET).cast("long")
    ordered_words = F.array_sort(F.collect_list(F.struct("x0", "token_no", F.trim("text").alias("text"))))
    return (
        words.filter("trim(text) <> ''")
        .groupBy(*PAGE, bucket.alias("line_no"))
        .agg(F.array_join(F.transform(ordered_words, lambda w: w["text"]), " ").alias("text"))
    )


def find_headers(table_lines: DataFrame) -> DataFrame:
    """First header line of each page: its column mapping and column bounds.

    Bounds are the midpoints between neighbouring header centres.
    """
    named = let(
        table_lines.filter(F.col("text").rlike(p.TABLE_HEADER)),
        tokens=F.col("tokens"),
        labels=F.transform("tokens", lambda t: t["text"]),
    )
    mapped = let(named, tokens=F.col("tokens"), mapping=F.expr(header_mapping("labels"))).filter("mapping IS NOT NULL")
    bounds = F.expr("transform(slice(tokens, 1, size(tokens) - 1), (t, i) -> (t.cx + get(tokens, i + 1).cx) / 2)")
    first = F.min(F.struct(F.col("line_no").alias("row_no"), "mapping", bounds.alias("bounds"), F.size("tokens").alias("width")))
    return mapped.groupBy(*PAGE).agg(first.alias("_header"))


def snap_to_columns(lines: DataFrame) -> DataFrame:
    """Add ``cells``: the texts of a line's tokens by the column they fall in."""
    column = "size(filter(_header.bounds, b -> b <= t.cx))"
    cells = f"""transform(sequence(0, _header.width - 1), k ->
        array_join(transform(filter(tokens, t -> {column} = k), t -> t.text), ' '))"""
    return lines.withColumn("cells", F.expr(cells))


def primary_table_lines(lines: DataFrame, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """Token lines of the primary table with their page's header attached."""
    roles = section_roles(lines, rows_per_block).filter("region = 'table'")
    return roles.join(find_headers(roles), PAGE)


def box_transactions(
    tokens: DataFrame, strict_parity: bool = False, rows_per_block: int = ROWS_PER_BLOCK
) -> DataFrame:
    """Transactions read by column position from word boxes."""
    lines = materialize(token_lines(tokens))
    body = primary_table_lines(lines, rows_per_block).filter("line_no > _header.row_no")
    body = snap_to_columns(body.filter(~(F.col("text").rlike(p.NOISE_LINE) & ~F.expr(dates.has_date("text")))))
    body = let(
        body.withColumn("row_no", F.col("line_no")),
        cells=F.col("cells"),
        _joined=F.array_join("cells", " "),
        extra=F.array_join(F.filter("cells", lambda c: c != ""), " "),
    )
    body = materialize(body.select(*PAGE, "row_no", "cells", "_header", "_joined", "extra"))
    parsed = materialize(mapped_rows(body, PAGE, strict_parity))
    whole = append_continuations(parsed, body.select(*PAGE, "row_no", "extra"), PAGE, rows_per_block)
    placed = whole.withColumn("pos", F.col("page_no").cast("long") * PAGE_STRIDE + F.col("pos")).drop("page_no")
    return keep_first(placed, ["file_name"], ["pos", "sub"])
