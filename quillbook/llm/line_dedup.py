"""Boilerplate lines by their frequency on a site.

Pages are grouped by host. A line that stands on more than a stated share of
the host's pages is boilerplate there and is dropped from all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillbook.llm.common import or_empty
from quillbook.session import materialize

RATIO = 0.5
#: Pages a host needs before its lines are judged: a single page repeats nothing.
LEAST_PAGES = 2

#: What ends a line of a page, and what holds no text of it.
HIDDEN = r"(?is)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>"
BREAKS = (r"(?i)</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|p|pre"
          r"|section|table|td|th|title|tr|ul)\b[^>]*>")
TAGS = r"<[^>]*>"
SPACES = r"[ \t\r\f\x0B]+"
HOST = r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"


def page_lines(html: Column) -> Column:
    """Lines of a page's text without markup, blanks squeezed, empty lines left out."""
    text = F.regexp_replace(html, HIDDEN, "")
    text = F.regexp_replace(text, BREAKS, "\n")
    text = F.regexp_replace(F.regexp_replace(text, TAGS, ""), SPACES, " ")
    return F.filter(F.transform(F.split(text, "\n"), lambda line: F.trim(line)), lambda line: line != "")


def host_of(url: Column) -> Column:
    """Host in lower case; empty where the url names none."""
    return F.coalesce(F.regexp_extract(F.lower(url), HOST, 1), F.lit(""))


def drop_boilerplate(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                     ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """(id, host, n_lines, n_dropped, text) per row of ``pages``.

    A line is dropped if the pages of its host that contain it, divided by all
    pages of the host, exceed ``ratio``. Hosts of fewer than ``least_pages``
    pages, and pages whose url names no host, keep all lines. A row is a page: a
    repeated row counts twice. Null html gives no lines and an empty text; a page
    whose lines all go has an empty text too. A line counts once per page but is
    dropped wherever it stands. An empty table gives no rows.

    A host's boilerplate lines are at most its lines per page divided by
    ``ratio``, however many pages it has, so they travel as one array. They are
    written once: Spark then knows their size, and may split the pages of a large
    host when it joins them.
    """
    lined = pages.select(
        F.col(id_col).alias("page"), host_of(F.col(url_col)).alias("host"), page_lines(or_empty(html_col)).alias("lines"))
    totals = lined.filter("host != ''").groupBy("host").agg(F.count("*").alias("pages")).filter(F.col("pages") >= least_pages)
    common = materialize(
        lined.filter("host != ''").select("host", F.explode(F.array_distinct("lines")).alias("line"))
        .groupBy("host", "line").agg(F.count("*").alias("holding")).filter(F.col("holding") > ratio * least_pages)
        .join(totals, "host").filter(F.col("holding") > ratio * F.col("pages"))
        .groupBy("host").agg(F.collect_set("line").alias("boilerplate"))
    )
    kept = F.filter("lines", lambda line: ~F.coalesce(F.array_contains("boilerplate", line), F.lit(False)))
    return lined.join(common, "host", "left").select("page", "host", "lines", kept.alias("kept")).select(
        F.col("page").alias(id_col), "host", F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size("kept")).cast("long").alias("n_dropped"), F.array_join("kept", "\n").alias("text"))


def expected_sql(ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> str:
    """DuckDB SQL for ``drop_boilerplate`` over ``pages``."""
    def quoted(pattern: str) -> str:
        return "'" + pattern.replace("'", "''") + "'"

    text = "coalesce(html, '')"
    for pattern, into in ((HIDDEN, "''"), (BREAKS, "chr(10)"), (TAGS, "''"), (SPACES, "' '")):
        text = f"regexp_replace({text}, {quoted(pattern)}, {into}, 'g')"
    return f"""
    WITH lined AS (
      SELECT page_id, coalesce(regexp_extract(lower(url), {quoted(HOST)}, 1), '') AS host,
        list_filter(list_transform(string_split({text}, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '') AS lines
      FROM pages),
    totals AS (SELECT host, count(*) AS n FROM lined WHERE host <> '' GROUP BY host HAVING count(*) >= {least_pages}),
    holding AS (
      SELECT host, line, count(*) AS n FROM (SELECT host, unnest(list_distinct(lines)) AS line FROM lined) GROUP BY host, line),
    common AS (
      SELECT h.host, list(h.line) AS boilerplate FROM holding h JOIN totals t ON h.host = t.host
      WHERE h.n > {ratio} * t.n GROUP BY h.host),
    cut AS (
      SELECT page_id, l.host, lines, list_filter(lines, lambda x: NOT list_contains(coalesce(boilerplate, []), x)) AS kept
      FROM lined l LEFT JOIN common c ON l.host = c.host)
    SELECT page_id, host, len(lines)::BIGINT AS n_lines, (len(lines) - len(kept))::BIGINT AS n_dropped,
      coalesce(array_to_string(kept, chr(10)), '') AS text
    FROM cut
    """
