"""Readers for statement files and sinks for the checked tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillbook.functions import patterns as p
from quillbook.functions.text import lines_of_text
from quillbook.operators.blocks import ordered
from quillbook.operators.checks import statement_summary, with_issues
from quillbook.operators.documents import file_extension, loader, looks_like_statement, upload_error
from quillbook.operators.lets import let
from quillbook.session import materialize

# a quoted field may hold line breaks and doubled quotes. A quote opens only at the start of a field;
# an unclosed one runs to the end, and what follows a closing one is text
CSV_VALUE = r'(?:"[^"]*+(?:""[^"]*+)*+(?:"[^,\r\n]*+|\z)|[^",\r\n][^,\r\n]*+|)'
CSV_RECORD = rf"({CSV_VALUE}(?:,{CSV_VALUE})*+)(?:\r\n|\r|\n|\z)"
CSV_FIELD = rf",({CSV_VALUE})"
# a line, or several ended by carriage returns, after which no quoted field is open
CSV_CLOSED_VALUE = r'(?:"[^"]*+(?:""[^"]*+)*+"[^,\r\n]*+|[^",\r\n][^,\r\n]*+|)'
CSV_CLOSED = rf"\A{CSV_CLOSED_VALUE}(?:[,\r]{CSV_CLOSED_VALUE})*+\z"
CSV_QUOTED = r'(?s)^"([^"]*+(?:""[^"]*+)*+)"?(.*)$'


# the largest value that a binary column holds
LARGEST_FILE = (1 << 31) - 1


def read_files(spark: SparkSession, path: str, max_bytes: int = LARGEST_FILE) -> DataFrame:
    """file_name, size, content (null when over ``max_bytes``, which is not read).

    Uploads have a limit of their own (``documents.upload_error``); a batch
    reads files of any size that a column can hold. Every file ends in the rows
    or in the rejects of ``text_statements`` and ``delimited_rows``.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1).alias("file_name")
    kept = files.filter(F.col("length") <= max_bytes).select(name, F.col("length").alias("size"), "content")
    large = files.filter(F.col("length") > max_bytes).select(
        name, F.col("length").alias("size"), F.lit(None).cast("binary").alias("content")
    )
    return kept.unionByName(large)


def file_inventory(files: DataFrame) -> DataFrame:
    """Extension, size, content hash, upload error, statement look and loader."""
    return files.select(
        "file_name",
        file_extension("file_name").alias("extension"),
        "size",
        F.sha2("content", 256).alias("content_hash"),
        upload_error("file_name", "size").alias("error"),
        looks_like_statement("file_name", "content").alias("looks_like_statement"),
        loader("file_name", "content").alias("loader"),
    )


def decoded(content: str, bad_bytes: str = "drop") -> Column:
    """UTF-8 text without byte-order mark; undecodable bytes dropped or marked."""
    text = F.expr(f"make_valid_utf8(cast({content} as string))")
    if bad_bytes == "drop":
        text = F.translate(text, "�", "")
    return F.regexp_replace(text, "^﻿", "")


def text_statements(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lines, rejects) of plain-text files. A text file is one page: form
    feeds break lines, not pages. Files without a line are rejects."""
    texts = files.filter("content IS NOT NULL").select("file_name", decoded("content").alias("text"))
    lines = lines_of_text(texts).select("file_name", F.lit(1).alias("page_no"), "line_no", "text")
    return lines, unread(files).unionByName(_blank(texts))


def unread(files: DataFrame) -> DataFrame:
    """file_name, error of the files whose content was left out for their size."""
    error = F.concat(F.lit("File exceeds size limit ("), "size", F.lit(" bytes)"))
    return files.filter("content IS NULL").select("file_name", error.alias("error"))


def _blank(texts: DataFrame) -> DataFrame:
    blank = ~F.col("text").rlike(r"[^\s ]")
    return texts.filter(blank).select("file_name", F.lit("The uploaded bank statement is empty.").alias("error"))


def delimited_rows(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects): file_name, row_no (from 1, blank rows counted), cells of
    ragged CSV files; files over the limit or without a character are rejects."""
    texts = files.filter("content IS NOT NULL").select("file_name", decoded("content", "mark").alias("text"))
    records = texts.select(
        "file_name", F.posexplode(F.regexp_extract_all("text", F.lit(CSV_RECORD), F.lit(1))).alias("at", "record")
    )
    rows = records.filter("record <> ''").select(
        "file_name", (F.col("at") + 1).cast("long").alias("row_no"), _cells("record").alias("cells")
    )
    return rows, unread(files).unionByName(_blank(texts))


def _cells(record: str) -> Column:
    """Fields of a record, without their quotes."""
    fields = F.regexp_extract_all(F.concat(F.lit(","), record), F.lit(CSV_FIELD), F.lit(1))
    inner = lambda f: F.replace(F.regexp_extract(f, CSV_QUOTED, 1), F.lit('""'), F.lit('"'))
    return F.transform(
        fields,
        lambda f: F.when(f.startswith('"'), F.concat(inner(f), F.regexp_extract(f, CSV_QUOTED, 2))).otherwise(f),
    )


def _file_lines(spark: SparkSession, path: str) -> DataFrame:
    """path, split (first byte of the range it was read in), at (order inside it), value: the lines of files, read by ranges."""
    source = spark.read.option("recursiveFileLookup", "true").option("lineSep", "\n").text(path)
    lines = materialize(source.select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("split"),
        F.col("_metadata.file_size").alias("size"), F.monotonically_increasing_id().alias("at"), "value"))
    # a byte-order mark belongs to the first line of a file alone
    marked = F.col("value").startswith("\ufeff")
    firsts = lines.groupBy("path").agg(F.min(F.struct("split", "at")).alias("first")).select("path", "first.*")
    heads = lines.filter(marked).join(firsts.withColumn("first", F.lit(True)), ["path", "split", "at"], "left").select(
        "path", "split", "size", "at", F.expr("if(first, substring(value, 2), value)").alias("value"))
    return lines.filter(~marked).unionByName(heads)


def delimited_scan(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) like ``delimited_rows`` for files of any size below ``path``, each read by as many tasks as it has ranges.

    Rows are path, file_name, row_no, cells; rejects path, file_name, error.
    Spark cuts a file into ranges of bytes at line breaks. Whether a line begins
    inside a quoted field follows from the lines above it: a line leads from
    outside to one side and from inside to one, so it either turns the side
    around, or leaves it, or ends on one side whatever was before. Turns are
    counted per range and carried from range to range. A record whose quotes
    hold line breaks is put together from its lines; one that is never closed is
    the rest of its file, by its definition. Lines end at line feeds: a file
    that has none is one line.
    """
    lines = _file_lines(spark, path)
    text = F.expr("make_valid_utf8(value)")
    opens = lambda line: (~line.rlike(CSV_CLOSED)).cast("int")
    lines = let(lines.withColumn("text", text), text=F.col("text")).drop("value").withColumns({
        "from_outside": opens(F.col("text")), "from_inside": opens(F.concat(F.lit('"'), "text"))})
    order = dict(keys=["path"], order=["split", "at"], block="split")
    turns = ((F.col("from_outside") == 1) & (F.col("from_inside") == 0)).cast("int")
    lines = ordered(lines.withColumn("turns", turns), running={"turned": F.col("turns")}, **order)
    ends_anyway = F.when(F.col("from_outside") == F.col("from_inside"), (F.col("from_outside") + F.col("turned")) % 2)
    lines = ordered(materialize(lines), before={"base": ends_anyway}, **order)
    inside = (F.coalesce("base", F.lit(0)) + F.col("turned") - F.col("turns")) % 2
    lines = lines.withColumn("inside", inside).withColumn("left_open", F.when(F.col("inside") == 1, F.col("from_inside")).otherwise(F.col("from_outside")))
    # a line may hold several records, divided by carriage returns; after the last match there is an empty one
    whole = F.concat(F.when(F.col("inside") == 1, '"').otherwise(""), "text", F.when(F.col("left_open") == 0, "\n").otherwise(""))
    found = F.regexp_extract_all(whole, F.lit(CSV_RECORD), F.lit(1))
    lines = let(lines, pieces=F.slice(found, 1, F.size(found) - 1), **{c: F.col(c) for c in ("inside", "left_open")})
    lines = ordered(materialize(lines.withColumn("ended", F.size("pieces") - F.col("left_open"))), running={"so_far": F.col("ended")}, **order)
    pieces = lines.select("path", "split", "at", "size", "inside", "left_open", (F.col("so_far") - F.col("ended")).alias("above"),
                          F.size("pieces").alias("n"), F.posexplode("pieces").alias("nth", "piece")).select(
        "path", "split", "at", (F.col("above") + F.col("nth") + 1).cast("long").alias("row_no"),
        ((F.col("inside") == 1) & (F.col("nth") == 0)).alias("goes_on"), ((F.col("left_open") == 1) & (F.col("nth") == F.col("n") - 1)).alias("open"),
        F.expr("if(inside = 1 AND nth = 0, substring(piece, 2), piece)").alias("piece"))
    pieces = materialize(pieces)
    alone = pieces.filter("NOT goes_on AND NOT open").select("path", "row_no", F.col("piece").alias("record"))
    parts = F.array_sort(F.collect_list(F.struct("split", "at", "piece")))
    broken = pieces.filter("goes_on OR open").groupBy("path", "row_no").agg(
        F.array_join(F.transform(parts, lambda x: x["piece"]), "\n").alias("record"), F.max_by("open", F.struct("split", "at")).alias("open"))
    # a record open at the end of its file holds the line feed there, if there is one
    ends = lines.groupBy("path").agg((F.sum(F.octet_length("text") + 1) <= F.max("size")).alias("fed"))
    closed = broken.filter("NOT open").drop("open").unionByName(
        broken.filter("open").join(ends, "path", "left").select("path", "row_no", F.concat("record", F.when(F.col("fed"), "\n").otherwise("")).alias("record")))
    name = F.element_at(F.split("path", "/"), -1).alias("file_name")
    rows = alone.unionByName(closed).filter("record <> ''").select("path", name, "row_no", _cells("record").alias("cells"))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.col("_metadata.file_path").alias("path"))
    written = lines.filter(F.col("text").rlike(r"[^\s\u00a0]")).select("path").distinct()
    blank = files.join(written, "path", "left_anti")
    return rows, blank.select("path", name, F.lit("The uploaded bank statement is empty.").alias("error"))


def export_rows(transactions: DataFrame) -> DataFrame:
    """The exported record: valid rows only, seven columns, confidence to 3 places."""
    valid = with_issues(transactions).filter("size(issues) = 0")
    return valid.select(
        *[F.round(c, 3).alias(c) if c == "confidence" else F.col(c) for c in p.EXPORT_FIELDS]
    )


def write_transactions(transactions: DataFrame, path: str, fmt: str = "csv") -> None:
    """Write exported records as csv or parquet; other formats are an error."""
    if fmt not in {"csv", "parquet"}:
        raise ValueError("Unsupported export format. Use csv or parquet.")
    writer = export_rows(transactions).write.mode("overwrite")
    (writer.option("header", True).csv(path) if fmt == "csv" else writer.parquet(path))


def write_statement_export(tables, path: str, fmt: str = "parquet") -> None:
    """summary/, transactions/ and validation/ of a statement run."""
    write_transactions(tables.transactions, f"{path}/transactions", fmt)
    for name, df in (("summary", statement_summary(tables.statements)), ("validation", tables.checks)):
        writer = df.write.mode("overwrite")
        (writer.option("header", True).csv(f"{path}/{name}") if fmt == "csv" else writer.parquet(f"{path}/{name}"))
