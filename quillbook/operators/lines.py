"""Statement lines: flags, sections, the primary table, row chunks.

Input ``lines``: file_name, page_no, line_no, text (trimmed, non-blank).
``pos`` = page and line in one sortable number.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillbook.functions import dates, money
from quillbook.functions import patterns as p
from quillbook.operators.blocks import ROWS_PER_BLOCK, apart, ordered
from quillbook.operators.lets import let
from quillbook.session import materialize

PAGE_STRIDE = 1 << 44
PRIMARY = "primary"
SECTIONS = ("deposits", "withdrawals", "fees", "checks")


def position(page: str = "page_no", line: str = "line_no") -> Column:
    return (F.col(page).cast("long") * PAGE_STRIDE + F.col(line)).alias("pos")


def _matches(pattern: str, words: tuple[str, ...], text: str = "text", lowered: Column | None = None) -> Column:
    """Whether a text matches; the pattern runs only where one of the words that it needs occurs."""
    lowered = F.lower(text) if lowered is None else lowered
    return reduce(lambda a, b: a | b, [F.contains(lowered, F.lit(w)) for w in words]) & F.col(text).rlike(pattern)


FLAGS = ("has_date", "is_noise", "is_balance_label")


def line_flags(lines: DataFrame) -> DataFrame:
    """Add has_date, is_noise (no date) and is_balance_label, once per line."""
    if set(FLAGS) <= set(lines.columns):
        return lines
    dated = let(lines, has_date=F.expr(dates.has_date("text")), _lowered=F.lower("text"))
    lowered = F.col("_lowered")
    return let(
        dated,
        is_noise=~F.col("has_date") & _matches(p.NOISE_LINE, p.NOISE_WORDS, lowered=lowered),
        is_balance_label=_matches(p.BALANCE_LABEL, p.BALANCE_WORDS, lowered=lowered),
    ).drop("_lowered")


def _matched_title(text: str = "text") -> Column:
    found = [F.when(_matches(pattern, (p.TITLE_WORDS[key],), text), F.lit(key)) for key, pattern in p.SECTION_TITLES]
    return F.coalesce(*found)


def section_roles(lines: DataFrame, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """Region of every line: 'table', a section key, or null.

    A title opens its section and a summary title closes any; both are
    consumed. A column-header line opens the table unless a section is open.
    A line with a date or a digit is never a title. Pages start afresh.
    """
    carried = ordered(
        lines, ["file_name", "page_no"], "line_no", latest=_marks(), prepare=_with_marks, rows_per_block=rows_per_block
    )
    return _with_region(carried, lines.columns)


def _with_marks(lines: DataFrame) -> DataFrame:
    """Add the flags, ``_switch`` (a section that opens, '' where any ends) and ``_header`` (a column-header line)."""
    flagged = line_flags(lines)
    title = F.when(~F.col("has_date") & ~F.expr(money.has_money("text")), _matched_title())
    flagged = let(flagged, _switch=F.coalesce(title, F.when(_matches(p.SUMMARY_TITLE, p.SUMMARY_WORDS), F.lit(""))))
    return let(
        flagged, _header=F.when(F.col("_switch").isNull() & _matches(p.TABLE_HEADER, p.HEADER_WORDS), F.col("line_no"))
    )


def _marks() -> dict[str, Column]:
    opened = F.struct(F.col("_switch").alias("kind"), F.col("line_no").alias("at"))
    return {"_open": F.when(F.col("_switch").isNotNull(), opened), "_head_at": F.col("_header")}


def _with_region(carried: DataFrame, columns: list[str]) -> DataFrame:
    region = (
        F.when(F.col("_open.kind") != "", F.col("_open.kind"))
        .when(F.col("_head_at") > F.coalesce(F.col("_open.at"), F.lit(-1)), F.lit("table"))
    )
    return (
        carried.filter("_switch IS NULL")
        .withColumn("region", region)
        .select(*columns, "region", *[f for f in FLAGS if f not in columns])
    )


def split_parts(lines: DataFrame, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """Lines to parse, by part: 'primary' or a section key.

    The primary part is the table without noise. A file with no table line at
    all falls back to every line that is neither noise nor any kind of title.
    """
    in_table = (F.col("region") == "table") & ~F.col("is_noise")
    columns = ["file_name", position(), "text", "region", *FLAGS]
    small, large = apart(lines, ["file_name"], rows_per_block)
    # a file of few lines stays in one task from its titles to its parts
    small = _with_marks(small.repartition("file_name"))
    page = Window.partitionBy("file_name", "page_no").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = small.select("*", *[F.last(m, ignorenulls=True).over(page).alias(n) for n, m in _marks().items()])
    file = Window.partitionBy("file_name")
    whole = _with_region(carried, lines.columns).select(
        *columns, F.coalesce(F.max(in_table).over(file), F.lit(False)).alias("_has_table")
    )
    roles = materialize(section_roles(large, rows_per_block).select(*columns))  # read twice
    tables = roles.groupBy(F.col("file_name").alias("_file")).agg(F.coalesce(F.max(in_table), F.lit(False)).alias("_has_table"))
    roles = whole.unionByName(roles.join(tables, F.col("file_name").eqNullSafe(F.col("_file"))).drop("_file"))
    part = (
        F.when(in_table, PRIMARY)
        .when(F.col("region").isin(*SECTIONS), F.col("region"))
        .when(
            ~F.col("_has_table") & ~F.col("is_noise") & ~_matches(p.SUMMARY_TITLE, p.SUMMARY_WORDS) & _matched_title().isNull(),
            PRIMARY,
        )
    )
    # a section line of a table-less file is read twice: with its section and with the rest
    also_primary = F.col("region").isin(*SECTIONS) & ~F.col("_has_table") & ~F.col("is_noise") & (
        ~_matches(p.SUMMARY_TITLE, p.SUMMARY_WORDS) & _matched_title().isNull()
    )
    placed = roles.select(
        "file_name",
        F.explode(F.array(part, F.when(also_primary, PRIMARY))).alias("part"),
        "pos",
        "text",
        *FLAGS,
    )
    return placed.filter("part IS NOT NULL")


def text_chunks(
    parts: DataFrame, keys: list[str], ways: tuple[int, ...] = (0, 1), rows_per_block: int = ROWS_PER_BLOCK
) -> DataFrame:
    """Chunks of text that may be one row each: keys, way, pos, sub, chunk.

    way 0, by line: a dated line and the undated lines below it. Lines up to
    the first header line, balance labels and noise are left out.
    way 1, by date: the text from each date token to the next, across lines.

    Both need one pass: every line learns the dated line it follows, is cut
    into pieces that name the line they belong to, and pieces are joined.
    """
    is_header = F.contains(F.lower("text"), F.lit("date")) & F.col("text").rlike("(?iu)" + "|".join(p.HEADER_LABELS))
    kept = ~F.col("is_balance_label") & ~F.col("is_noise")
    placed = ordered(
        line_flags(parts),
        keys,
        "pos",
        smallest={"_head": F.when(is_header, F.col("pos"))},
        latest={"_row": F.when(kept & F.col("has_date"), F.col("pos"))},
        before={"_dated": F.when(F.col("has_date"), F.col("pos"))},
        rows_per_block=rows_per_block,
    )
    shape = "named_struct('way', {0}, 'start', {1}, 'back', {2}, 'sub', {3}, 'text', {4})"
    line_piece = shape.format("0", "if(_row > coalesce(_head, -1), _row, NULL)", "0", "0", "text")
    by_line = f"if(is_balance_label OR is_noise, array(), array({line_piece}))"
    # 'back' counts date tokens from the end of their line: later lines join token 0
    date_piece = shape.format("1", "if(i = 0, _dated, pos)", "if(i = 0, 0, size(_cut) - 1 - i)", "i", "s")
    by_date = f"transform(_cut, (s, i) -> {date_piece})"
    cut = F.when(F.col("has_date"), F.split(F.regexp_replace("text", p.DATE, "\u0001$1"), "\u0001")).otherwise(
        F.array("text")
    )
    chosen = {(0, 1): f"concat({by_line}, {by_date})", (0,): by_line, (1,): by_date}[tuple(ways)]
    if 1 in ways:
        placed = let(placed, _cut=cut, **{c: F.col(c) for c in ("text", "_row", "_head", "_dated")})
    pieces = placed.select(*keys, "pos", F.inline(F.expr(chosen))).filter("start IS NOT NULL AND text <> ''")
    listed = F.array_sort(F.collect_list(F.struct("pos", "sub", "text")))
    joined = F.array_join(F.transform(listed, lambda c: c["text"]), " ")
    return (
        pieces.groupBy(*keys, "way", "start", "back")
        .agg(
            F.max(F.when(F.col("pos") == F.col("start"), F.col("sub"))).alias("sub"),
            F.trim(F.regexp_replace(joined, r"\s+", " ")).alias("chunk"),
        )
        .select(*keys, "way", F.col("start").alias("pos"), "sub", "chunk")
    )


def line_chunks(parts: DataFrame, keys: list[str], rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """Row chunks by line: keys, pos, sub, chunk."""
    return text_chunks(parts, keys, (0,), rows_per_block).drop("way")


def date_windows(parts: DataFrame, keys: list[str], rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """Row chunks by date token: keys, pos, sub, chunk."""
    return text_chunks(parts, keys, (1,), rows_per_block).drop("way")


def count_bad_dates(windows: DataFrame, keys: list[str]) -> DataFrame:
    """Date-shaped tokens per key that are no calendar dates, balance lines aside."""
    token = windows.withColumn("_token", F.expr(dates.date_token("chunk")))
    return (
        token.filter(~F.col("chunk").rlike(p.BAD_DATE_SKIP))
        .groupBy(*keys)
        .agg(F.count_if(F.expr(dates.normalize_date("_token")).isNull()).alias("bad_dates"))
    )
