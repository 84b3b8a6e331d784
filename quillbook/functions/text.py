"""Text helpers: line splitting, tokens, descriptions, model output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillbook.functions.patterns import ANALYSIS_MISSING, DATE_AT_START, SECONDARY_TEXT
from quillbook.operators.lets import let

LINE_BREAK = "\\r\\n|[\\n\\r\\f\\u000b\\u001c-\\u001e\\u0085\\u2028\\u2029]"
EDGE_MARKS = "^[ \\-|:/]+|[ \\-|:/]+$"


WHITE_SPACE = " \t\n\r\f\u000b\u001c\u001d\u001e\u001f\u0085\u2028\u2029\u3000"


def clean_line(col: Column | str) -> Column:
    """Trim all white space; no-break spaces count as spaces."""
    return F.btrim(F.replace(col, F.lit("\u00a0"), F.lit(" ")), F.lit(WHITE_SPACE))


def lines_of_text(df: DataFrame, text: str = "text") -> DataFrame:
    """One row per non-blank line: every column but ``text``, plus line_no, text."""
    keep = [c for c in df.columns if c != text]
    exploded = df.select(*keep, F.posexplode(F.split(F.col(text), LINE_BREAK)).alias("line_no", "_raw"))
    # cleaned once: a filter on a plain projection would clean every piece a second time
    cleaned = let(exploded, text=clean_line("_raw")).filter("text <> ''")
    return cleaned.select(*keep, F.col("line_no").cast("long").alias("line_no"), "text")


def described(x: str) -> str:
    """SQL text: squeezed text without a leading date token, never empty."""
    return rf"""coalesce(nullif(CASE
      WHEN {x} rlike r'{DATE_AT_START}'
        THEN regexp_replace(regexp_replace({x}, r'{DATE_AT_START}', ''), r'^[ \-|:]+|[ \-|:]+$', '')
      ELSE {x} END, ''), 'Transaction')"""


def clean_description(x: str) -> str:
    """SQL text: the same for text that is not squeezed yet."""
    return described(rf"trim(regexp_replace({x}, r'\s+', ' '))")


def word_tokens(x: str) -> str:
    """SQL text: lower-case words of two or more letters or digits."""
    return f"regexp_extract_all(lower({x}), r'[a-z0-9]{{2,}}', 0)"


def render_cell(x: str) -> str:
    return rf"trim(regexp_replace(coalesce({x}, ''), r'\s+', ' '))"


def description_ok(x: str) -> str:
    """SQL text: a description that is there, of sensible length, and no secondary text."""
    return (
        f"({x} IS NOT NULL AND trim({x}) <> '' AND length({x}) <= 300 "
        f"AND NOT {x} rlike r'{SECONDARY_TEXT}')"
    )


def content_text(x: str) -> Column:
    """Text of model content given as JSON: a string, {text}, or a list of both.

    Blocks are trimmed and joined by a line break; anything else is its own text.
    """
    blocks = F.from_json(F.col(x), "array<string>")

    def text_of(block: Column) -> Column:
        shape = F.substring(F.ltrim(block), 1, 1)
        return clean_line(
            F.when(shape == "{", F.coalesce(F.get_json_object(block, "$.text"), F.lit(""))).otherwise(block)
        )

    shape = F.substring(F.ltrim(F.col(x)), 1, 1)
    plain = F.when(shape == '"', F.get_json_object(F.concat(F.lit("["), F.col(x), F.lit("]")), "$[0]")).otherwise(
        F.col(x)
    )
    joined = F.array_join(F.filter(F.transform(blocks, text_of), lambda b: b != ""), "\n")
    return F.when(shape == "[", clean_line(joined)).when(shape == "{", text_of(F.col(x))).otherwise(clean_line(plain))


ANALYSIS_SCHEMA = (
    "document_type string, executive_summary string, detailed_summary string, key_findings array<string>, "
    "important_entities array<string>, dates_and_amounts array<string>, action_items array<string>, "
    "risks array<string>, classification string, "
    "source_references array<struct<section:string,excerpt:string>>"
)


def parse_analysis(x: str) -> Column:
    """Struct of the first JSON object inside prose, defaults filled in; null
    when there is no object or it cannot be read."""
    start = F.locate("{", F.col(x))
    body = F.when(start > 0, F.substring(F.col(x), start, F.length(x)))
    parsed = F.from_json(body, f"{ANALYSIS_SCHEMA}, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    texts = {
        "document_type": "unknown",
        "executive_summary": ANALYSIS_MISSING,
        "detailed_summary": ANALYSIS_MISSING,
        "classification": "unknown",
    }
    fields = []
    for part in ANALYSIS_SCHEMA.split(", "):
        name, kind = part.split(" ", 1)
        value = parsed[name]
        fallback = F.lit(texts[name]) if name in texts else F.from_json(F.lit("[]"), kind)
        fields.append(F.coalesce(value, fallback).alias(name))
    return F.when(body.isNotNull() & parsed["_bad"].isNull(), F.struct(*fields))


def conversation_title(x: str) -> Column:
    """First 50 characters of the first message, dots when it is longer."""
    head = clean_line(F.substring(F.col(x), 1, 50))
    return F.when(F.length(x) > 50, F.concat(head, F.lit("..."))).otherwise(head)


def list_label(x: str) -> Column:
    """Sidebar label: over 28 characters is cut to 25 and dots."""
    title = F.trim(F.coalesce(F.nullif(F.col(x), F.lit("")), F.lit("New Chat")))
    return F.when(F.length(title) > 28, F.concat(F.substring(title, 1, 25), F.lit("..."))).otherwise(title)


def upload_title(file_name: str) -> Column:
    """Title of a conversation that begins with an upload and no words."""
    return F.substring(F.concat(F.lit("Chat about "), F.col(file_name)), 1, 50)
