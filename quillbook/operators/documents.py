"""Documents: upload rules, routing, elements, chunks, work per distinct content."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillbook.functions import dates, money
from quillbook.functions import patterns as p
from quillbook.functions.text import WHITE_SPACE, clean_line
from quillbook.operators.blocks import ROWS_PER_BLOCK, ordered
from quillbook.session import materialize
from quillbook.operators.keyed_store import KeyedStore

# --- fixed values: loaders and breaks -----------------------------------------
STATEMENT_EXTENSIONS = ("pdf", "txt", "csv", "xlsx", "png", "jpg", "jpeg", "webp")
LOADER_IMAGES = ("png", "jpg", "jpeg", "webp")
BREAKS = ("\n\n", ". ", "\n", " ")
CHUNK_SIZE, CHUNK_OVERLAP = 1000, 200
PANEL_CHUNK_SIZE, PANEL_CHUNK_OVERLAP = 6000, 400


def file_extension(name: str) -> Column:
    return F.when(F.col(name).contains("."), F.lower(F.substring_index(name, ".", -1))).otherwise("")


def upload_error(name: str, size: str, limit: int = p.UPLOAD_LIMIT_BYTES) -> Column:
    """First rule an upload breaks, null when it is fine."""
    extension = file_extension(name)
    return (
        F.when(F.coalesce(F.col(name) == "", F.lit(True)), "Missing filename")
        .when(F.coalesce(F.col(size) == 0, F.lit(True)), "Empty file")
        .when(~extension.isin(*p.SUPPORTED_EXTENSIONS), F.concat(F.lit("Unsupported file type: ."), extension))
        .when(F.col(size) > limit, f"File exceeds size limit ({limit // (1024 * 1024)} MB)")
    )


def panel_upload_error(name: str, size: str) -> Column:
    """The analysis panel's single rule."""
    bad = F.coalesce(F.col(name) == "", F.lit(True)) | (F.col(size) > p.PANEL_LIMIT_BYTES)
    return F.when(bad, "Upload is missing or exceeds the 20 MB limit.")


def route_document(name: str) -> Column:
    """struct(strategy, use_converter, use_specialized, reason) from the file name."""
    extension, lowered = file_extension(name), F.lower(name)
    hinted = lowered.rlike("|".join(p.STATEMENT_HINTS))
    statement_like = extension.isin("pdf", "txt", *p.IMAGE_EXTENSIONS, *p.SPREADSHEET_EXTENSIONS)

    def route(strategy: str, converter: bool, specialized: bool, reason: str) -> Column:
        return F.struct(
            F.lit(strategy).alias("strategy"), F.lit(converter).alias("use_converter"),
            F.lit(specialized).alias("use_specialized"), F.lit(reason).alias("reason"),
        )

    return (
        F.when(
            statement_like & hinted,
            route("bank_statement", False, True, "Bank statement detected - using specialized processor"),
        )
        .when(extension.isin(*p.IMAGE_EXTENSIONS), route("image_ocr", True, False, "Image file"))
        .when(
            extension.isin(*p.SPREADSHEET_EXTENSIONS),
            route("spreadsheet", True, False, "Spreadsheet - can use Docling or direct parsers"),
        )
        .when(
            extension.isin("docx", "pptx", "pdf"),
            route("document", True, False, "Document suitable for Docling conversion"),
        )
        .when(extension.isin("txt", "md", "markdown"), route("text", True, False, "Text document"))
        .otherwise(route("unknown", False, False, "Unknown type"))
    )


def _pdf_mark(content: str) -> Column:
    head = F.decode(F.substring(F.col(content), 1, 1024), "iso-8859-1")
    return F.coalesce(F.contains(head, F.lit("%PDF")), F.lit(False))


def looks_like_statement(name: str, content: str) -> Column:
    return file_extension(name).isin(*STATEMENT_EXTENSIONS) | _pdf_mark(content)


def loader(name: str, content: str) -> Column:
    extension = file_extension(name)
    return (
        F.when((extension == "pdf") | _pdf_mark(content), "pdf")
        .when(extension.isin(*p.SPREADSHEET_EXTENSIONS), "tabular")
        .when(extension.isin(*LOADER_IMAGES), "image")
        .otherwise("text")
    )


def text_useful(pages: DataFrame, key: str = "file_name") -> DataFrame:
    """key, useful, pdf_type: at least 40 characters and a date or a digit
    over all pages joined by line breaks. Pages are never concatenated."""
    token = F.expr(f"{dates.has_date('text')} OR {money.has_money('text')}")
    sizes = F.sum(F.length("text")) + F.count("*") - 1
    return pages.groupBy(key).agg(((sizes >= 40) & F.max(token)).alias("useful")).withColumn(
        "pdf_type", F.when(F.col("useful"), "text").otherwise("image")
    )


def elements_of_text(documents: DataFrame) -> DataFrame:
    """Elements: every column but ``text``, element_no, text (trimmed, non-empty)."""
    keep = [c for c in documents.columns if c != "text"]
    split = documents.select(*keep, F.posexplode(F.split("text", "\n")).alias("element_no", "raw"))
    return split.select(*keep, F.col("element_no").cast("long").alias("element_no"), clean_line("raw").alias("text")).filter(
        "text <> ''"
    )


def _stride_pattern(size: str, overlap: str) -> str:
    """SQL text of a regex whose matches are the strides from one window's start to the next.

    A window with more text behind it ends after the last break of the first
    kind that occurs beyond its middle; the stride is the window less the
    overlap, so the break is looked for that much further on.
    """
    kinds = []
    for mark in BREAKS:
        n = len(mark)
        least, most = f"({size} div 2 + 1)", f"({size} - {n})"
        behind = f"format_string('.{{%d,%d}}(?=.{{%d}}%s)', {least} + {n} - {overlap}, {size} - {overlap}, {overlap} - {n}, {_quoted(mark)})"
        for inside in range(n):  # an overlap shorter than the mark: the stride takes in the mark's beginning
            head, tail = mark[:n - inside], mark[n - inside:]
            cut = f"format_string('.{{%d,%d}}%s(?=%s)', {least}, {most}, {_quoted(head)}, {_quoted(tail)})"
            behind = f"if({overlap} = {inside}, {cut}, {behind})"
        kinds.append(f"if({least} > {most}, '(?!)', {behind})")
    broken = f"concat_ws('|', {', '.join(kinds)})"
    return f"concat(format_string('(?s)(?:(?=.{{%d}})(?:', {size} + 1), {broken}, format_string(')|.{{1,%d}})', {size} - {overlap}))"


def _quoted(text: str) -> str:
    return "'" + text.replace(".", "[.]").replace("\n", "\\n") + "'"


def windows(text: str, size: str, overlap: str) -> str:
    """SQL text of the array of a text's windows: each ends after the last
    paragraph, sentence, line or word break beyond its middle; the next starts
    ``overlap`` earlier. White space at both ends is cut off.

    The text is cut into strides once, and each is extended by the characters
    that follow, so the cost is linear in its length.
    """
    shortest = f"greatest({size} div 2 + 2 - {overlap}, 1)"
    behind = f"left(array_join(slice(strides, i + 2, {overlap} div {shortest} + 2), ''), {overlap})"
    strides = f"regexp_extract_all({text}, {_stride_pattern(size, overlap)}, 0)"
    blanks = WHITE_SPACE.translate({ord(c): f"\\u{ord(c):04x}" for c in WHITE_SPACE}) + "\\u00a0"
    extended = f"transform(strides, (s, i) -> btrim(concat(s, {behind}), '{blanks}'))"
    return f"transform(array({strides}), strides -> {extended})[0]"


def chunk_structured(
    elements: DataFrame,
    size: int = CHUNK_SIZE,
    overlap: int = CHUNK_OVERLAP,
    rows_per_block: int = ROWS_PER_BLOCK,
) -> DataFrame:
    """Chunks of elements (document_id, element_no, text, …): short elements
    stay whole, long ones are windowed. chunk_index runs through the document;
    chunk_id is derived from both.
    """
    if not 0 <= overlap < size / 2:
        raise ValueError("overlap must be less than half the chunk size")
    keep = [c for c in elements.columns if c != "text"]
    cut = F.when(F.length("text") > size, F.expr(windows("text", str(int(size)), str(int(overlap))))).otherwise(F.array("text"))
    pieces = materialize(elements.select(*keep, cut.alias("_pieces")))
    placed = ordered(
        pieces, ["document_id"], "element_no",
        running={"_upto": F.size("_pieces").cast("long")}, rows_per_block=rows_per_block,
    )
    chunks = placed.select(
        *keep, (F.col("_upto") - F.size("_pieces")).alias("_base"), F.posexplode("_pieces").alias("_n", "text")
    )
    index = (F.col("_base") + F.col("_n")).cast("long")
    return chunks.select(
        F.sha2(F.concat_ws("|", F.col("document_id").cast("string"), index.cast("string")), 256).alias("chunk_id"),
        *keep, index.alias("chunk_index"), "text",
    )


def chunk_fixed(
    documents: DataFrame, size: int = PANEL_CHUNK_SIZE, overlap: int = PANEL_CHUNK_OVERLAP
) -> DataFrame:
    """Fixed windows of ``size`` every ``size - overlap`` characters: every
    column but ``text``, chunk_no, text, excerpt. Blank windows are dropped.

    The text is cut once into strides and each stride is extended by the start
    of the next, so the cost is linear in its length.
    """
    stride = size - overlap
    if not 0 <= overlap <= stride:
        raise ValueError("overlap must not exceed the stride")
    keep = [c for c in documents.columns if c != "text"]
    strides = documents.select(
        *keep, F.regexp_extract_all("text", F.lit(f"(?s).{{1,{stride}}}"), F.lit(0)).alias("_strides")
    )
    window = F.expr(f"transform(_strides, (s, i) -> concat(s, coalesce(substr(get(_strides, i + 1), 1, {overlap}), '')))")
    cut = strides.select(*keep, F.posexplode(window).alias("chunk_no", "_raw"))
    return (
        cut.select(*keep, F.col("chunk_no").cast("long").alias("chunk_no"), clean_line("_raw").alias("text"))
        .filter("text <> ''")
        .withColumn("excerpt", F.substring("text", 1, 300))
    )


def unchunked(documents: DataFrame, chunks: DataFrame, key: str = "document_id") -> DataFrame:
    """Documents that gave no chunk, with the error they are rejected with."""
    return documents.join(chunks.select(key).distinct(), key, "left_anti").select(
        key, F.lit("The uploaded document is empty.").alias("error")
    )


def once_per_content(uploads: DataFrame, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Run ``work`` on each distinct text and give every upload its result.

    ``work`` gets content_hash, text and returns content_hash and results.
    """
    hashed = uploads.withColumn("content_hash", F.sha2(F.encode("text", "utf-8"), 256))
    distinct = hashed.groupBy("content_hash").agg(F.first("text").alias("text"))
    return hashed.drop("text").join(work(distinct), "content_hash", "left")


def once_ever(uploads: DataFrame, work: Callable[[DataFrame], DataFrame], store: KeyedStore, batch: str, work_version: int = 1) -> DataFrame:
    """Like ``once_per_content``, with results that outlive the batch: only texts that the store doesn't know are worked on.

    The store's key is content_hash and its version work_version: results of an
    older version are made anew and replaced. A batch that is run again finds
    its own results.
    """
    hashed = uploads.withColumn("content_hash", F.sha2(F.encode("text", "utf-8"), 256))
    distinct = materialize(hashed.groupBy("content_hash").agg(F.first("text").alias("text")))
    known = store.read(distinct).filter(F.col("work_version") >= work_version)
    new = distinct.join(known.select("content_hash").distinct(), "content_hash", "left_anti")
    made = materialize(work(new).withColumn("work_version", F.lit(work_version)))
    if not made.isEmpty():
        store.merge(made, f"{batch}-{work_version}")
    return hashed.drop("text").join(store.read(distinct).drop("work_version"), "content_hash", "left")


def unique_names(names: Column) -> Column:
    """Column names made distinct: blanks become Column, repeats get _2, _3.

    The rank of a name among its equals so far is its suffix.
    """
    plain = F.transform(names, lambda n: F.trim(F.coalesce(n, F.lit(""))))
    filled = F.transform(plain, lambda n: F.when(F.lower(n).isin("", "nan"), "Column").otherwise(n))

    def ranked(name: Column, at: Column) -> Column:
        rank = F.size(F.filter(F.slice(filled, 1, at + 1), lambda other: other == name))
        return F.when(rank > 1, F.concat(name, F.lit("_"), rank)).otherwise(name)

    return F.transform(filled, ranked)


def reroute(statements: DataFrame, parsed: DataFrame, documents: DataFrame, key: str = "file_name") -> DataFrame:
    """Documents to index: the given ones and the statements without any row."""
    left = statements.join(parsed.select(key).distinct(), key, "left_anti")
    return documents.unionByName(left)


def register_chunk_function(spark: SparkSession) -> None:
    """SQL table function chunk_text(text, size, overlap): chunk_no, text."""
    body = windows("coalesce(chunk_text.text, '')", "chunk_text.size", "chunk_text.overlap")
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION chunk_text(text STRING, size INT, overlap INT)
        RETURNS TABLE(chunk_no INT, text STRING) RETURN SELECT pos, col FROM (SELECT posexplode({body}))""")
