"""Letterhead fields of a statement, read from all of its lines.

A label may be broken over several lines, so each line is read together with
as many that follow it as the longest label has places to break; the earliest
line that matches decides.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillbook.functions import money
from quillbook.functions import patterns as p
from quillbook.operators.blocks import ROWS_PER_BLOCK, apart, following
from quillbook.operators.lets import let
from quillbook.operators.lines import position

#: Lines are trimmed and never blank, so a label breaks at each of its blanks once at most: a dated balance
#: ("closing / balance / as / of / January / 31 / , / 2025 amount") spans the most lines, eight.
LOOK_AHEAD = 7
#: Every pattern begins on the line itself, with one of these words or an IFSC code: no other line has a field.
HOLDER_WORDS, ACCOUNT_WORDS = ("account", "customer", "name", "primary"), ("account", "a/c", "acct")
OPENING_WORDS, CLOSING_WORDS = tuple(p.OPENING_KINDS.split("|")), tuple(p.CLOSING_KINDS.split("|"))
CANDIDATE_WORDS = ("bank", "ifsc", "statement", *HOLDER_WORDS, *ACCOUNT_WORDS[1:], *OPENING_WORDS, *CLOSING_WORDS)


def _has(*words: str) -> Column:
    """Whether the line itself has one of the words, in any case."""
    return reduce(lambda a, b: a | b, [F.contains("lowered", F.lit(w)) for w in words])


def _here(pattern: str, flags: str = "(?i)") -> str:
    """A match that begins on the first line of the context."""
    return rf"{flags}^[^\n]*?{pattern}"


def _labelled_balance(label: str) -> Column:
    line = F.regexp_extract("context", rf"(?i)^[^\n]*?\b{label}\s+balance\b[^\n]*", 0)
    return F.when(_has(label), F.try_element_at(F.regexp_extract_all(line, F.lit(p.BALANCE_NUMBER), F.lit(0)), F.lit(-1)))


def _first(value: Column, name: str) -> Column:
    """Value of the earliest line where it is known."""
    return F.min_by(value, F.when(value.isNotNull(), F.col("pos"))).alias(name)


def _found(words: tuple[str, ...], pattern: str, group: int = 1) -> Column:
    """Group of a pattern that begins on the line itself, with one of the words; '' if there is none."""
    return F.when(_has(*words), F.regexp_extract("context", _here(pattern), group))


def _dated(words: tuple[str, ...], pattern: str) -> Column:
    """Value behind a dated balance of the given kinds that begins on the line itself: its context holds all of it."""
    return _found(words, pattern.replace(p.BALANCE_KINDS, "|".join(words)), 2)


def statement_metadata(lines: DataFrame, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """One row per file: bank_name, account_holder_name, account_number,
    ifsc_code, opening_balance, closing_balance, statement_period."""
    placed = lines.select("file_name", position(), "text")
    small, large = apart(placed, ["file_name"], rows_per_block)
    at = Window.partitionBy("file_name").orderBy("pos")
    # a file of few lines stays in one task from its lines to its fields; its first line is kept, so that it has a row
    near = small.repartition("file_name").select(
        "*",
        F.row_number().over(at).alias("_n"),
        F.collect_list("text").over(at.rowsBetween(1, LOOK_AHEAD)).alias("following"),
        F.lead("text").over(at).alias("_below"),
    )
    holder = (F.col("_n") < p.NAME_BLOCK_LINES) & _above_address()
    near = let(near, lowered=F.lower("text")).filter(_candidate() | holder | (F.col("_n") == 1))
    found = _fields(near.withColumn("block", F.when(holder, F.col("text"))).drop("_n", "_below"))
    ahead = following(large, ["file_name"], "pos", "text", LOOK_AHEAD, rows_per_block=rows_per_block)
    ahead = let(ahead, lowered=F.lower("text")).filter(_candidate())
    blocks = address_holders(large)
    parted = _fields(ahead.withColumn("block", F.lit(None).cast("string"))).drop("block")
    parted = large.select("file_name").distinct().join(parted, "file_name", "left").join(blocks, "file_name", "left")
    fields = found.unionByName(parted.withColumnRenamed("block_holder", "block"))
    squeezed = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    from_days = F.concat(squeezed("first_day"), F.lit(" to "), squeezed("last_day"))
    number = F.expr(r"regexp_replace(regexp_replace(upper(trim(account)), r'[\s\-]+', ''), r'(?:X|\*)+$', '')")
    holder = F.trim(
        F.split(F.regexp_replace("holder", r"^[ :\-]+|[ :\-]+$", ""), p.HOLDER_CUT)[0]
    )
    return fields.select(
        "file_name",
        F.col("bank").alias("bank_name"),
        F.coalesce(F.nullif(holder, F.lit("")), "block").alias("account_holder_name"),
        F.when(number.rlike(r"\d") & F.length(number).between(4, 30), number).alias("account_number"),
        F.coalesce("ifsc_named", "ifsc_any").alias("ifsc_code"),
        F.coalesce(
            F.expr(f"if(opening IS NULL, NULL, {money.to_amount('opening')})"),
            F.expr(f"if(dated_opening IS NULL, NULL, {money.to_amount('dated_opening')})"),
        ).alias("opening_balance"),
        F.coalesce(
            F.expr(f"if(closing IS NULL, NULL, {money.to_amount('closing')})"),
            F.expr(f"if(dated_closing IS NULL, NULL, {money.to_amount('dated_closing')})"),
        ).alias("closing_balance"),
        F.substring(F.coalesce("period", from_days), 1, 80).alias("statement_period"),
    )


def _has_code() -> Column:
    return F.contains("text", F.lit("0")) & F.upper("text").rlike(p.IFSC)


def _candidate() -> Column:
    """Whether a field may begin on the line."""
    return _has(*CANDIDATE_WORDS) | _has_code()


def _fields(read: DataFrame) -> DataFrame:
    """One row per file: the earliest known value of every field, as printed."""
    read = let(read, lowered=F.col("lowered"), text=F.col("text"), context=F.concat_ws("\n", "text", "following"))
    period = _here(p.PERIOD)
    read = let(
        read,
        bank=F.when(_has("bank") & F.col("text").rlike(p.BANK_LINE), F.substring(F.trim(F.regexp_replace("text", r"\s+", " ")), 1, 80)),
        holder=_found(HOLDER_WORDS, p.HOLDER_LABEL),
        account=_found(ACCOUNT_WORDS, p.ACCOUNT_LABEL),
        ifsc_named=F.upper(_found(("ifsc",), p.IFSC_LABEL)),
        ifsc_any=F.when(F.contains("text", F.lit("0")), F.regexp_extract(F.upper("text"), p.IFSC, 1)),
        opening=_labelled_balance("opening"),
        closing=_labelled_balance("closing"),
        dated_opening=_dated(OPENING_WORDS, p.DATED_BALANCE),
        dated_closing=_dated(CLOSING_WORDS, p.DATED_BALANCE),
        period=F.when(
            _has("statement") & F.col("context").rlike(period),
            F.concat(
                F.trim(F.regexp_extract("context", period, 1)), F.lit(" to "), F.trim(F.regexp_extract("context", period, 2))
            ),
        ),
        first_day=_dated(OPENING_WORDS, p.DATED_BALANCE_DAY),
        last_day=_dated(CLOSING_WORDS, p.DATED_BALANCE_DAY),
    )
    names = [c for c in read.columns if c not in {"file_name", "pos", "text", "context", "following", "lowered"}]
    # a group that is found is never empty: '' is a line without the field
    unread = {"holder", "account", "ifsc_named", "ifsc_any", "dated_opening", "dated_closing", "first_day", "last_day"}
    values = {n: F.when(F.col(n) != "", F.col(n)) if n in unread else F.col(n) for n in names}
    return read.groupBy("file_name").agg(*[_first(v, n) for n, v in values.items()])


def _above_address() -> Column:
    return (
        F.col("text").rlike(p.HOLDER_NAME) & ~F.col("text").rlike(p.HOLDER_BLOCKLIST) & F.col("_below").rlike(p.ADDRESS_LINE)
    )


def address_holders(lines: DataFrame) -> DataFrame:
    """Holder printed without a label: two to four capitalised words among the
    first twenty lines, right above a line that looks like an address."""
    per_file = Window.partitionBy("file_name").orderBy("pos")
    top = lines.withColumn("_n", F.row_number().over(per_file)).filter(F.col("_n") <= p.NAME_BLOCK_LINES)
    named = top.withColumn("_below", F.lead("text").over(per_file)).filter(_above_address())
    return named.groupBy("file_name").agg(F.min_by("text", "_n").alias("block_holder"))
