"""Registered queries: each reads the driver tables whole and returns a frame.

Amounts are decimals inside and doubles in the result.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillbook.functions import dates, money, text
from quillbook.functions.patterns import CATEGORY_KEYWORDS
from quillbook.functions.register import register_sql_functions
from quillbook.operators import categorize, checks, choose, documents, layout, lines, metadata, payload, registry, retrieval, rows, tables
from quillbook.operators.chunk_store import ChunkStore
from quillbook.operators.keyed_store import KeyedStore
from quillbook.plans import corpus
from quillbook.plans.statement import StatementTables, process_statements
from quillbook.session import ensure_checkpoint_dir, materialize
from quillbook.sources import derived, files

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
AMOUNTS = ("debit_amount", "credit_amount", "balance")


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def doubles(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c in columns})


def _numbered(txns: DataFrame) -> DataFrame:
    return txns.select("file_name", F.col("seq").alias("pos"), F.lit(0).alias("sub"), *rows.VALUES)


def _faulty(txns: DataFrame) -> DataFrame:
    return derived.with_faults(txns).select("file_name", "pos", F.lit(0).alias("sub"), *rows.VALUES)


def _txn_rows(spark: SparkSession, sf: str) -> DataFrame:
    return _numbered(derived.transactions(spark, sf))


def _bad_rows(spark: SparkSession, sf: str) -> DataFrame:
    return _faulty(derived.transactions(spark, sf))


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    return materialize(derived.statement_lines(spark, sf))


def _parts(spark: SparkSession, sf: str) -> DataFrame:
    return materialize(lines.split_parts(_lines(spark, sf)))


def _statements(spark: SparkSession, sf: str) -> StatementTables:
    return process_statements(derived.statement_lines(spark, sf))


# --- transactions -------------------------------------------------------------
@query
def spend_by_category(spark, sf):
    ruled = categorize.with_rules(derived.transactions(spark, sf)).withColumn("category", F.col("rule_category"))
    spent = registry.spending_by_category(ruled)
    return doubles(spent, "total_debit", "total_credit").select(
        "category", "total_debit", "total_credit", (F.col("total_debit") / F.col("n")).alias("average_debit"), "n"
    )


@query
def classify_rules(spark, sf):
    ruled = categorize.with_rules(derived.transactions(spark, sf))
    return ruled.select("file_name", "seq", "description", "rule_category", "rule_confidence")


@query
def classify_rule_table(spark, sf):
    rules = [(n, category, word) for n, (category, words) in enumerate(CATEGORY_KEYWORDS) for word in words]
    table = spark.createDataFrame(rules, "priority int, category string, keyword string")
    ruled = categorize.with_rule_table(derived.transactions(spark, sf), table)
    return ruled.select("file_name", "seq", "description", "rule_category", "rule_confidence")


@query
def running_balance(spark, sf):
    seen = checks.running_balance(_bad_rows(spark, sf))
    return doubles(seen, "previous_balance", "expected_balance").select(
        "file_name", "pos", "previous_balance", "expected_balance", "breaks"
    )


@query
def txn_validate(spark, sf):
    return checks.with_issues(_bad_rows(spark, sf)).select(
        "file_name", "pos", F.array_join("issues", "; ").alias("issues"), (F.size("issues") == 0).alias("is_valid")
    )


@query
def txn_dedupe(spark, sf):
    kept = rows.keep_first(_bad_rows(spark, sf), checks.FILE, checks.ORDER)
    return doubles(kept.drop("sub"), *AMOUNTS)


@query
def issue_counts(spark, sf):
    return checks.issue_counts(_bad_rows(spark, sf), ["file_name"])


@query
def stmt_summary(spark, sf):
    totals = checks.statement_totals(_txn_rows(spark, sf))
    return doubles(totals, "total_debit", "total_credit", "last_balance").select(
        "file_name", "transaction_count", "total_debit", "total_credit", "last_balance", "balance_mismatches"
    )


# --- scalars ------------------------------------------------------------------
@query
def date_tokens(spark, sf):
    printed = derived.statement_rows(spark, sf).select(
        "o_orderkey", F.concat(F.lit("paid on "), "printed_date", F.lit(" at desk 7, "), "words").alias("line")
    )
    return printed.select("o_orderkey", F.expr(dates.date_token("line")).alias("token"))


DATE_STYLES = (
    "dd/MM/yyyy", "dd-MM-yyyy", "dd/MM/yy", "dd-MM-yy", "MM/dd/yyyy", "yyyy-MM-dd", "dd.MM.yyyy", "dd-MMM-yyyy",
    "dd-MMM-yy", "dd MMM yyyy", "dd MMMM yyyy", "dd/MMM/yyyy", "dd/MM", "dd MMM", "yyyy-MM", "MM/yyyy",
)


@query
def date_normalize(spark, sf):
    order = derived.order_rows(spark, sf)
    style = F.col("o_orderkey") % len(DATE_STYLES)
    shown = F.coalesce(*[F.when(style == i, F.date_format("txn_date", s)) for i, s in enumerate(DATE_STYLES)])
    spelled = order.select("o_orderkey", shown.alias("shown"))
    return spelled.select("o_orderkey", "shown", F.expr(dates.normalize_date("shown")).alias("normalized"))


@query
def date_windows(spark, sf):
    detail = _parts(spark, sf).filter("part IN ('deposits', 'withdrawals', 'fees')")
    return lines.date_windows(detail, ["file_name", "part"]).select("file_name", "part", "chunk")


@query
def money_tokens(spark, sf):
    order = derived.order_rows(spark, sf)
    amount = F.col("debit_amount") + F.col("credit_amount")
    plain = amount.cast("string")
    forms = (
        F.format_number(amount, 2), F.concat(F.lit("₹"), plain), F.concat(F.lit("("), plain, F.lit(")")),
        F.concat(plain, F.lit("CR")), F.concat(F.lit("Rs."), plain), plain, (amount * 100).cast("long").cast("string"),
    )
    shown = F.coalesce(*[F.when(F.col("o_orderkey") % len(forms) == i, f) for i, f in enumerate(forms)])
    spelled = order.select("o_orderkey", shown.alias("shown"))
    read = spelled.select(
        "o_orderkey",
        F.expr(money.money_strength("shown")).alias("strength"),
        F.expr(money.to_amount("shown")).alias("amount"),
        F.expr(money.cell_amount("shown")).alias("cell"),
    )
    return doubles(read, "amount", "cell")


# --- text statements ------------------------------------------------------------
@query
def stmt_lines(spark, sf):
    raw = derived.statement_lines(spark, sf).withColumnRenamed("line_no", "segment").withColumn(
        "text", F.concat(F.lit("  "), "text", F.lit(" \t\r\n \r\n\f"))
    )
    flagged = lines.line_flags(text.lines_of_text(raw))
    return flagged.select("file_name", F.col("segment").alias("line_no"), "text", "has_date", "is_noise", "is_balance_label")


@query
def section_roles(spark, sf):
    roles = lines.section_roles(_lines(spark, sf))
    return roles.select("file_name", "line_no", F.coalesce("region", F.lit("none")).alias("region"))


@query
def line_chunks(spark, sf):
    primary = _parts(spark, sf).filter(F.col("part") == lines.PRIMARY)
    return lines.line_chunks(primary, ["file_name"]).select("file_name", "chunk")


@query
def bad_dates(spark, sf):
    primary = _parts(spark, sf).filter(F.col("part") == lines.PRIMARY)
    return lines.count_bad_dates(lines.date_windows(primary, ["file_name"]), ["file_name"])


@query
def txn_parse(spark, sf):
    parsed = rows.parse_parts(_parts(spark, sf))
    return doubles(parsed.select("file_name", "part", *rows.VALUES), *AMOUNTS)


@query
def check_ledger(spark, sf):
    ledger = _parts(spark, sf).filter("part = 'checks'")
    parsed = rows.parse_parts(ledger)
    return doubles(parsed, "debit_amount").select("file_name", "date", "description", "debit_amount")


@query
def plain_parse(spark, sf):
    """Statements whose lines stand under no heading."""
    parts = materialize(lines.split_parts(materialize(derived.plain_statements(spark, sf))))
    parsed = rows.primary_only(rows.parse_parts(parts))
    return doubles(parsed, *AMOUNTS).select("file_name", "date", "description", *AMOUNTS)


@query
def letterhead_fields(spark, sf):
    return doubles(metadata.statement_metadata(derived.letterheads(spark, sf)), "opening_balance", "closing_balance")


@query
def stmt_metadata(spark, sf):
    return doubles(metadata.statement_metadata(_lines(spark, sf)), "opening_balance", "closing_balance")


def _parsed_sides(spark, sf) -> tuple[DataFrame, DataFrame]:
    parsed = materialize(rows.parse_parts(_parts(spark, sf)))
    valid = checks.checked(rows.primary_only(parsed)).filter("size(issues) = 0").drop("issues")
    details = checks.checked(parsed.filter(F.col("part") != lines.PRIMARY), ["file_name", "part"])
    return valid, details.filter("size(issues) = 0").drop("issues")


@query
def repair_amounts(spark, sf):
    valid, details = _parsed_sides(spark, sf)
    repaired = checks.repair_amounts(materialize(valid), materialize(details)).filter("misread IS NOT NULL")
    return doubles(repaired, "debit_amount", "credit_amount", "misread").select(
        "file_name", "date", "description", "debit_amount", "credit_amount", "misread"
    )


@query
def section_recon(spark, sf):
    valid, details = _parsed_sides(spark, sf)
    totals = checks.statement_totals(valid).join(checks.section_totals(details), "file_name", "left")
    warned = totals.withColumn(
        "warnings", F.array_join(F.filter(F.array(*checks.reconciliation_warnings()), lambda w: w.isNotNull()), " | ")
    )
    sums = ("checks_total", "deposits_total", "withdrawals_total", "fees_total")
    return doubles(warned, *sums).select("file_name", *sums, "warnings")


@query
def stmt_parse(spark, sf):
    found = _statements(spark, sf).transactions
    return doubles(found.select("file_name", *rows.VALUES, "category"), *AMOUNTS)


@query
def stmt_validation(spark, sf):
    statements = _statements(spark, sf).statements
    sums = ("total_debit", "total_credit", "expected_closing_balance", "reported_closing_balance")
    return doubles(statements, *sums).select(
        "file_name", "transaction_count", *sums, "balance_mismatches", "bad_dates", "validation_status",
        F.array_join("warnings", " | ").alias("warnings"),
    )


@query
def validation_checks(spark, sf):
    return _statements(spark, sf).checks


# --- tables and tokens ------------------------------------------------------------
@query
def header_map(spark, sf):
    mapped = tables.with_mapping(tables.clean_cells(derived.table_cells(spark, sf))).filter("mapping IS NOT NULL")
    first = mapped.groupBy("file_name").agg(F.min_by("mapping", "row_no").alias("m"))
    return first.select("file_name", *[F.coalesce(f"m.{r}", F.lit(-1)).cast("long").alias(r) for r in tables.ROLES])


@query
def tabular_parse(spark, sf):
    parsed = tables.table_transactions(materialize(derived.table_cells(spark, sf)))
    return doubles(parsed.drop("sub"), *AMOUNTS)


@query
def tabular_parse_parity(spark, sf):
    parsed = tables.table_transactions(materialize(derived.table_cells(spark, sf)), strict_parity=True)
    return doubles(parsed.drop("sub"), *AMOUNTS)


@query
def row_chunks(spark, sf):
    return tables.row_chunks(derived.table_cells(spark, sf), F.lit("CSV"))


@query
def word_lines(spark, sf):
    words = derived.page_tokens(spark, sf)
    level = words.withColumn("y0", F.col("y0") - F.col("token_no") % 5 % 3 + 9)
    return layout.word_lines(level)


@query
def token_lines(spark, sf):
    return layout.token_lines(derived.page_tokens(spark, sf)).select("file_name", "page_no", "line_no", "text")


@query
def token_columns(spark, sf):
    placed = materialize(layout.token_lines(derived.page_tokens(spark, sf)))
    snapped = layout.snap_to_columns(layout.primary_table_lines(placed))
    return snapped.select("file_name", "page_no", "line_no", F.array_join("cells", "|").alias("cells"))


@query
def token_txns(spark, sf):
    return doubles(layout.box_transactions(derived.page_tokens(spark, sf)).drop("pos", "sub"), *AMOUNTS)


def _candidates(spark, sf) -> DataFrame:
    txns = materialize(derived.transactions(spark, sf).drop("account", "txn_date"))  # read three times
    faulty, true = _faulty(txns), _numbered(txns)
    blind = true.withColumn("balance", F.lit(0).cast("decimal(18,2)"))
    named = [(faulty, "line_window"), (blind, "box_columns"), (true, "pdf_tables")]
    frames = [df.withColumn("strategy", F.lit(name)) for df, name in named]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


@query
def strategy_score(spark, sf):
    scores = choose.score_candidates(_candidates(spark, sf))
    return scores.withColumn("score", F.round("score", 6))


@query
def strategy_pick(spark, sf):
    return choose.pick_strategy(choose.score_candidates(_candidates(spark, sf)))


# --- categories and exports ---------------------------------------------------------
@query
def nb_train(spark, sf):
    docs = derived.table(spark, sf, "documents").select("doc_id", "text")
    labelled = derived.table(spark, sf, "labels").join(docs, "doc_id").select(
        F.col("quality").cast("string").alias("label"), F.col("quality").cast("int").alias("class_order"), "text"
    )
    model = categorize.NaiveBayesTables(labelled)
    size = model.vocabulary.scalar()
    return model.classes.select("label", "docs", "token_total", "distinct_tokens", size.alias("vocabulary"))


def _built_in_model(spark) -> categorize.NaiveBayesTables:
    return categorize.NaiveBayesTables(categorize.training_texts(spark))


@query
def classify_nb(spark, sf):
    scored = categorize.score_descriptions(derived.transactions(spark, sf), _built_in_model(spark))
    return scored.withColumn("nb_confidence", F.round("nb_confidence", 6))


@query
def classify_hybrid(spark, sf):
    classified = categorize.classify(materialize(derived.transactions(spark, sf)), _built_in_model(spark))
    return classified.select(
        "file_name", "seq", "description", "category", "classification_method", F.round("confidence", 6).alias("confidence")
    )


def _categorized(spark, sf) -> DataFrame:
    ruled = categorize.with_rules(_bad_rows(spark, sf))
    return ruled.withColumnsRenamed({"rule_category": "category", "rule_confidence": "confidence"})


@query
def export_rows(spark, sf):
    return doubles(files.export_rows(_categorized(spark, sf)), *AMOUNTS)


@query
def export_summary(spark, sf):
    seen = checks.checked(_bad_rows(spark, sf))
    totals = checks.statement_totals(seen.filter("size(issues) = 0").drop("issues"))
    summary = totals.withColumns({"document_type": F.lit("tabular"), "extraction_method": F.lit("pdf_tables")})
    return doubles(summary, "total_debit", "total_credit").select(
        "file_name", "document_type", "transaction_count", "total_debit", "total_credit", "extraction_method"
    )


@query
def stmt_payload(spark, sf):
    record = F.struct(*checks_fields(), F.col("category"), F.round("confidence", 3).alias("confidence"))
    written = _categorized(spark, sf).select("file_name", "pos", F.to_json(record).alias("payload"))
    schema = "date string, description string, debit_amount double, credit_amount double, balance double, category string, confidence double"
    return written.select("file_name", "pos", F.from_json("payload", schema).alias("r")).select("file_name", "pos", "r.*")


def checks_fields():
    return [F.col(c) for c in rows.VALUES]


# --- documents ----------------------------------------------------------------------
def _files(spark, sf) -> DataFrame:
    return derived.documents(spark, sf).select(
        F.col("filename").alias("file_name"), "size", F.encode("text", "utf-8").alias("content")
    )


@query
def file_inventory(spark, sf):
    found = files.file_inventory(_files(spark, sf))
    return found.withColumn("error", F.coalesce("error", F.lit("")))


@query
def upload_validate(spark, sf):
    docs = derived.documents(spark, sf)
    return docs.select(
        "document_id", "filename", F.coalesce(documents.upload_error("filename", "size", 8192), F.lit("ok")).alias("error")
    )


@query
def doc_route(spark, sf):
    docs = derived.documents(spark, sf)
    return docs.select("document_id", documents.route_document("filename").alias("r")).select("document_id", "r.*")


@query
def text_useful(spark, sf):
    pages = documents.elements_of_text(derived.documents(spark, sf)).select(F.col("filename").alias("file_name"), "text")
    return documents.text_useful(pages)


def _elements(spark, sf) -> DataFrame:
    docs = derived.documents(spark, sf).select("document_id", "filename", "text")
    return documents.elements_of_text(docs)


@query
def chunk_structured(spark, sf):
    return documents.chunk_structured(_elements(spark, sf))


@query
def chunk_fixed(spark, sf):
    return documents.chunk_fixed(derived.documents(spark, sf).select("document_id", "text"))


@query
def chunk_counts(spark, sf):
    return registry.chunk_counts(documents.chunk_fixed(derived.documents(spark, sf).select("document_id", "text")))


@query
def content_cache(spark, sf):
    def count_elements(distinct: DataFrame) -> DataFrame:
        elements = documents.elements_of_text(distinct)
        return elements.groupBy("content_hash").agg(
            F.count("*").alias("element_count"), F.sum(F.length("text")).alias("element_chars")
        )

    uploads = derived.documents(spark, sf).select("document_id", "filename", "text")
    return documents.once_per_content(uploads, count_elements)


@query
def reroute_docs(spark, sf):
    """Documents without a digit, an eighth of them named as statements, and statements with rows."""
    docs = derived.documents(spark, sf).withColumn("text", F.regexp_replace("text", "[0-9]", ""))
    docs = docs.withColumn("route", documents.route_document("filename"))
    prose = docs.filter("route.strategy = 'bank_statement'").select(F.col("filename").alias("file_name"), "text")
    # a printed page is a file: forty rows at most
    printed = derived.plain_statements(spark, sf).withColumn("file_name", F.concat_ws("-", "file_name", F.col("page_no").cast("string")))
    printed = materialize(printed)
    page = text.lines_of_text(prose).select("file_name", F.lit(1).alias("page_no"), "line_no", "text").unionByName(printed)
    parsed = materialize(rows.primary_only(rows.parse_parts(materialize(lines.split_parts(page)))))
    listed = F.array_sort(F.collect_list(F.struct("line_no", "text")))
    whole = printed.groupBy("file_name").agg(F.array_join(F.transform(listed, lambda x: x["text"]), "\n").alias("text"))
    general = docs.filter("route.strategy <> 'bank_statement'").select(F.col("filename").alias("file_name"), "text")
    return documents.reroute(prose.unionByName(whole), parsed, general).select("file_name", F.length("text").cast("long").alias("n_chars"))


# --- retrieval ------------------------------------------------------------------------
def _vectors(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Chunks are all vectors; every row whose id is divisible by 20 is a question."""
    stored = derived.table(spark, sf, "embeddings")
    chunks = stored.select(F.col("vec_id").alias("chunk_id"), F.col("vec_id").alias("document_id"), "embedding")
    asked = stored.filter("vec_id % 20 = 0").select(F.col("vec_id").cast("long").alias("query_id"), "embedding")
    return chunks, asked


def _ranked(hits: DataFrame) -> DataFrame:
    return hits.select("query_id", "chunk_id", F.round("distance", 6).alias("distance"), F.col("rank").cast("long").alias("rank"))


@query
def vec_topk(spark, sf):
    return _ranked(retrieval.vector_top_k(*_vectors(spark, sf)))


@query
def vec_topk_filtered(spark, sf):
    chunks, asked = _vectors(spark, sf)
    good = derived.table(spark, sf, "labels").filter("quality = 1").select(F.col("doc_id").alias("document_id"))
    return _ranked(retrieval.vector_top_k(chunks, asked, 10, min_score=0.1, document_ids=good))


@query
def vec_topk_lsh(spark, sf):
    """By question, the mean vector of each label and every row whose id is divisible by 20: hits of the index, whose cells hold
    about four chunks; and whether nine tenths of the exact hits of all questions are among them."""
    chunks, rows_ = _vectors(spark, sf)
    each = derived.table(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    means = each.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    labels = means.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("v"))
    # even numbers are rows, odd ones labels
    asked = materialize(rows_.select((F.col("query_id") * 2).alias("query_id"), F.col("embedding").cast("array<double>").alias("embedding")).unionByName(
        labels.select((F.col("label").cast("long") * 2 + 1).alias("query_id"), F.transform("v", lambda p: p["m"]).alias("embedding"))))
    found = retrieval.vector_top_k_lsh(chunks, asked, 10, in_bucket=4).select("query_id", "chunk_id", F.lit(1).alias("found"))
    both = retrieval.vector_top_k(chunks, asked, 10).select("query_id", "chunk_id", F.lit(1).alias("exact")).join(
        found, ["query_id", "chunk_id"], "full")
    by_question = materialize(both.groupBy("query_id").agg(
        F.count("found").alias("n_hits"), F.expr("count_if(found = 1 AND exact = 1)").alias("met"), F.count("exact").alias("n_exact")))
    recalled = by_question.agg((F.sum("met") >= 0.9 * F.sum("n_exact")).alias("recalled"))
    return by_question.crossJoin(F.broadcast(recalled)).select(
        F.when(F.col("query_id") % 2 == 0, "row").otherwise("label").alias("kind"),
        F.expr("shiftright(query_id, 1)").alias("query_id"), "n_hits", "recalled")


def _asked_chunks(spark, sf) -> DataFrame:
    """Two questions for every document: its first line and its last, often the same."""
    docs = derived.documents(spark, sf)
    lines_ = F.split("text", "\n")
    asked = docs.select("document_id", F.posexplode(F.array(F.get(lines_, F.lit(0)), F.element_at(lines_, -1))).alias("n", "question")).select(
        (F.col("document_id") * 2 + F.col("n")).alias("query_id"), "document_id", "question")
    chunks = documents.chunk_fixed(docs.select("document_id", "filename", "text"))
    return retrieval.keyword_top(chunks, asked)


@query
def keyword_top4(spark, sf):
    return _asked_chunks(spark, sf).select(
        "query_id", "document_id", "chunk_no", F.col("score").cast("long").alias("score"), F.col("rank").cast("long").alias("rank")
    )


@query
def context_build(spark, sf):
    hits = _asked_chunks(spark, sf).select(
        "query_id", "rank", F.col("chunk_no").alias("chunk_id"), "text", "filename",
        (F.col("chunk_no") + 1).alias("page_number"), F.lit("body").alias("section"),
    )
    built = retrieval.cited_context(hits)
    return built.select("query_id", "context", F.size("sources").cast("long").alias("n_sources"))


@query
def agent_context(spark, sf):
    history = registry.conversation_history(_messages(spark, sf)).select(
        F.col("conversation_id").alias("query_id"), F.col("history").alias("text")
    )
    found = _asked_chunks(spark, sf).select("query_id", "rank", "text")
    web = derived.table(spark, sf, "pages").select(
        F.col("page_id").alias("query_id"), F.lit(1).alias("rank"), F.col("url").alias("title"), F.col("html").alias("content"))
    return retrieval.agent_context(history, found, web)


@query
def section_context(spark, sf):
    return retrieval.section_context(
        tables.row_chunks(derived.table_cells(spark, sf), F.lit("CSV")).withColumnRenamed("file_name", "document_id"), "row_no"
    )


def _statement_contexts(spark, sf) -> DataFrame:
    ruled = categorize.with_rules(_txn_rows(spark, sf)).withColumn("category", F.col("rule_category"))
    heads = ruled.groupBy("file_name").agg(F.count("*").alias("transaction_count")).select(
        "file_name", F.lit("FIRST NATIONAL BANK").alias("bank_name"), F.lit(None).cast("string").alias("account_holder_name"),
        F.regexp_extract("file_name", r"\d+", 0).alias("account_number"), F.lit(None).cast("string").alias("ifsc_code"),
        F.lit("text").alias("document_type"), "transaction_count",
    )
    return retrieval.statement_context(heads, ruled)


@query
def stmt_context(spark, sf):
    return _statement_contexts(spark, sf)


PROMPT_BASE = "Answer clearly and concisely. Ground answers in the given rows or text."


@query
def prompt_build(spark, sf):
    contexts = _statement_contexts(spark, sf).select(
        F.regexp_extract("file_name", r"\d+", 0).cast("long").alias("conv_id"), F.col("context").alias("statement")
    )
    asked = derived.questions(spark, sf).join(contexts, "conv_id", "left")
    chunks = documents.chunk_fixed(derived.documents(spark, sf).select("document_id", "text")).withColumn("section", F.lit("body"))
    docs = retrieval.section_context(chunks, "chunk_no").select(F.col("document_id").alias("conv_id"), F.col("context").alias("document"))
    asked = asked.join(docs, "conv_id", "left")
    prompt = retrieval.build_prompt(PROMPT_BASE, F.col("statement"), F.col("document"), F.col("question"))
    return asked.select("conv_id", "turn", prompt.alias("prompt"))


@query
def question_route(spark, sf):
    asked = derived.questions(spark, sf)
    has_documents, has_statement = F.col("conv_id") % 4 != 3, F.col("conv_id") % 5 == 0
    return asked.select(
        "conv_id", "turn", retrieval.route_question("question", has_documents, has_statement).alias("r")
    ).select("conv_id", "turn", "r.*")


@query
def content_text(spark, sf):
    turns = derived.table(spark, sf, "conversations")
    block = F.struct(F.lit("text").alias("type"), F.concat(F.lit(" "), "text", F.lit("\n")).alias("text"))
    blank = F.struct(F.lit("text").alias("type"), F.lit(" ").alias("text"))
    content = (
        F.when(F.col("role") == "user", F.to_json(F.array(block, blank, block)))
        .when(F.col("role") == "assistant", F.to_json(block))
        .otherwise(F.col("text"))
    )
    built = turns.select("conv_id", "turn", content.alias("content"))
    return built.select("conv_id", "turn", text.content_text("content").alias("text"))


@query
def analysis_json(spark, sf):
    docs = derived.table(spark, sf, "documents")
    reply = F.struct(
        F.col("source").alias("document_type"), F.col("text").alias("detailed_summary"),
        F.array("lang", "source").alias("key_findings"), F.col("lang").alias("classification"),
    )
    prose = F.concat(F.lit("Here is the analysis:\n```json\n"), F.to_json(reply), F.lit("\n```\nDone {ok}."))
    bare = F.concat(F.lit("no object here: "), F.translate("text", "{}", ""))
    said = docs.select("doc_id", F.when(F.col("doc_id") % 5 != 4, prose).otherwise(bare).alias("reply"))
    parsed = said.select("doc_id", text.parse_analysis("reply").alias("a"))
    return parsed.select(
        "doc_id", F.col("a").isNotNull().alias("parsed"), "a.document_type", "a.executive_summary", "a.detailed_summary",
        F.array_join("a.key_findings", ",").alias("key_findings"), "a.classification",
        F.size("a.risks").cast("long").alias("n_risks"),
    )


# --- stores ---------------------------------------------------------------------------
@query
def registry_latest(spark, sf):
    state = registry.registry_state(derived.registry_log(spark, sf))
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c)
    return state.select(
        "document_id", "status", "chunk_count", "error_message", stamp("indexed_at"), stamp("created_at"), stamp("updated_at")
    )


def _messages(spark, sf) -> DataFrame:
    turns = derived.table(spark, sf, "conversations")
    return turns.select(
        F.col("conv_id").alias("conversation_id"), F.col("turn").alias("message_id"), F.col("turn").alias("created_at"),
        "role", F.col("text").alias("content"),
    )


@query
def conv_messages(spark, sf):
    return registry.conversation_history(_messages(spark, sf))


@query
def conv_list(spark, sf):
    messages = _messages(spark, sf)
    conversations = messages.groupBy("conversation_id").agg(
        F.min("created_at").alias("created_at"),
        F.min("created_at").alias("updated_at"),
        F.min_by("content", F.when(F.col("role") == "user", F.col("created_at"))).alias("first"),
    )
    titled = conversations.withColumn("title", F.coalesce(text.conversation_title("first"), F.lit("")))
    listed = registry.list_conversations(registry.touch_conversations(titled, messages))
    return listed.select("conversation_id", "updated_at", "title", text.list_label("title").alias("label"))


def _two_numbers(texts: list[str]) -> list[list[float]]:
    """Stands for an embedding model; it has no vector for a text with a bar."""
    if any("|" in t for t in texts):
        raise ValueError("no vector")
    return [[float(len(t)), float(t.count(" "))] for t in texts]


@query
def index_log(spark, sf):
    uploads = derived.documents(spark, sf).withColumn("ts", F.lit(1).cast("long"))
    store = f"{ensure_checkpoint_dir(spark)}/store/{uuid.uuid4().hex}"
    state = registry.registry_state(corpus.index_documents(uploads, _two_numbers, store).registry_log)
    return state.select("document_id", "status", "chunk_count", "error_message")


@query
def text_read(spark, sf):
    """Every file's lines, or its place among the rejects."""
    read, rejects = files.text_statements(derived.text_files(spark, sf))
    kept = read.select("file_name", "line_no", "text", F.lit("").alias("error"))
    return kept.unionByName(rejects.select("file_name", F.lit(-1).cast("long").alias("line_no"), F.lit("").alias("text"), "error"))


@query
def csv_read(spark, sf):
    read, rejects = files.delimited_rows(derived.csv_files(spark, sf))
    kept = read.select("file_name", "row_no", F.array_join("cells", "|").alias("cells"))
    return kept.unionByName(rejects.select("file_name", F.lit(0).cast("long").alias("row_no"), F.col("error").alias("cells")))


@query
def csv_scan(spark, sf):
    """Table rows written as a few large CSV files, with breaks and quotes in fields, and read again by ranges of bytes."""
    folder = f"{ensure_checkpoint_dir(spark)}/csv_scan/{uuid.uuid4().hex}"
    derived.csv_lines(spark, sf).write.text(folder)
    read, _ = files.delimited_scan(spark, folder)
    return read.select(F.col("cells")[0].alias("file_name"), F.col("cells")[1].cast("long").alias("row_no"),
                       F.array_join(F.slice("cells", 3, F.size("cells") - 2), "|").alias("cells"))


@query
def payload_round_trip(spark, sf):
    """Statements written as JSON and read again: their rows beside their summary."""
    ruled = categorize.with_rules(_txn_rows(spark, sf)).withColumns({"category": F.col("rule_category"), "confidence": F.col("rule_confidence")})
    heads = ruled.groupBy("file_name").agg(F.count("*").alias("transaction_count"), F.sum("debit_amount").alias("total_debit"))
    heads = heads.withColumn("warnings", F.array(F.concat(F.lit('read "'), "file_name", F.lit('"'))))
    written = payload.statement_payload(heads, ruled, ["file_name", "transaction_count", "total_debit"])
    head = F.from_json("payload", "summary struct<transaction_count: long, total_debit: double>, warnings array<string>")
    read = written.select("file_name", head.alias("h")).select("file_name", "h.summary.*", F.array_join("h.warnings", ";").alias("warnings"))
    return doubles(payload.payload_rows(written), *AMOUNTS).join(read, "file_name").drop("confidence")


@query
def payload_parts_round_trip(spark, sf):
    """Statements written as JSON in parts of 100 rows and read again part by part."""
    ruled = categorize.with_rules(_txn_rows(spark, sf)).withColumns({"category": F.col("rule_category"), "confidence": F.col("rule_confidence")})
    heads = ruled.groupBy("file_name").agg(F.count("*").alias("transaction_count"), F.lit(None).cast("array<string>").alias("warnings"))
    parts = payload.payload_parts(heads, materialize(ruled), ["file_name", "transaction_count"], rows_per_part=100)
    return doubles(payload.part_rows(materialize(parts)), *AMOUNTS).drop("confidence")


@query
def upload_titles(spark, sf):
    long_name = derived.documents(spark, sf).withColumn("name", F.concat(F.repeat(F.lit("long "), F.lit(8)), "filename"))
    return long_name.select("document_id", text.upload_title("name").alias("title"))


@query
def analysis_sources(spark, sf):
    chunks = documents.chunk_fixed(derived.documents(spark, sf).select("document_id", "filename", "text"), 600, 40)
    source = F.concat("filename", F.lit(", part "), (F.col("chunk_no") + 1).cast("string"))
    return retrieval.leading_sources(chunks, "chunk_no", source).select("document_id", F.array_join("sources", "; ").alias("sources"))


@query
def embed_texts(spark, sf):
    docs = derived.table(spark, sf, "documents").select("doc_id", "text")
    found = retrieval.embed_or_error(docs, _two_numbers)
    number = lambda i: F.get("embedding", F.lit(i)).cast("double")
    return found.select("doc_id", number(0).alias("n_chars"), number(1).alias("n_blanks"), F.coalesce("embedding_error", F.lit("")).alias("error"))


def _length_reply(prompts: list[str]) -> list[str]:
    """Stands for a model: says a prompt's length, nothing to every seventh length, and fails on a bar."""
    if any("|" in p for p in prompts):
        raise ValueError("no answer")
    return [f" {len(p)} " if len(p) % 7 else "" for p in prompts]


@query
def generate_answers(spark, sf):
    prompts = derived.table(spark, sf, "documents").select("doc_id", F.col("text").alias("prompt"))
    return retrieval.generate(prompts, _length_reply).select("doc_id", "answer", "answer_error")


@query
def retry_picked(spark, sf):
    """Files by account: rows of native text and of recognised text, and the source that is kept."""
    rows_ = derived.order_rows(spark, sf).select(F.concat(F.lit("scan_"), "account").alias("file_name"), "o_orderkey")
    source = F.when(F.col("o_orderkey") % 5 == 0, "native").otherwise("ocr")
    counts = rows_.groupBy("file_name", source.alias("source")).agg(F.count("*").alias("n"))
    return choose.retry_pick(counts).withColumn("warning", F.coalesce("warning", F.lit("")))


@query
def sql_functions(spark, sf):
    register_sql_functions(spark)
    order = derived.statement_rows(spark, sf).select(
        "o_orderkey", "printed_date", F.concat("printed_date", F.lit(" "), "words").alias("line"),
        F.concat(F.lit("("), F.format_number(F.col("debit_amount") + F.col("credit_amount"), 2), F.lit(")")).alias("money"))
    return order.selectExpr(
        "o_orderkey", "qb_date_token(line) AS token", "qb_normalize_date(printed_date) AS day", "qb_money_strength(money) AS strength",
        "cast(qb_to_amount(money) AS double) AS amount", "qb_clean_description(line) AS description", "array_join(qb_word_tokens(line), ' ') AS words")


@query
def structured_filter(spark, sf):
    rows_ = derived.transactions(spark, sf)
    kept = registry.structured_query(rows_, "filter", {"where": [("description", "contains", "STORE"), ("debit_amount", ">=", 1000)]})
    return doubles(kept, "debit_amount").select("file_name", "seq", "description", "debit_amount")


@query
def session_docs(spark, sf):
    docs = derived.table(spark, sf, "documents").select(
        F.col("doc_id").alias("document_id"), F.col("source").alias("session_id"), F.col("doc_id").alias("created_at"))
    return registry.session_documents(docs, "src1").select("document_id", "created_at")


@query
def doc_lookup(spark, sf):
    state = registry.registry_state(derived.registry_log(spark, sf))
    return registry.document(state, 7).select("document_id", "status", "chunk_count", "error_message")


@query
def latest_events(spark, sf):
    log = derived.table(spark, sf, "events").select("user_id", "event_type", "ts", "event_id")
    return registry.latest_by_key(log, ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id")


def _store(spark, schema: str, key: str, version: str) -> KeyedStore:
    return KeyedStore(spark, f"{ensure_checkpoint_dir(spark)}/stores/{uuid.uuid4().hex}", schema, key, version, buckets=8)


@query
def stored_events(spark, sf):
    """A user's latest event from a store that got all events in three batches, one of them twice, late ones among them, and deletes."""
    log = derived.table(spark, sf, "events").select("user_id", "event_type", "event_id", F.struct("ts", "event_id").alias("at"))
    schema = ", ".join(f"{c} {kind}" for c, kind in log.dtypes)
    store = _store(spark, schema, "user_id", "at")
    for n in (2, 0, 1, 0):
        store.merge(log.filter(F.col("event_id") % 3 == n), f"batch {n}")
    store.compact()
    gone = log.filter("user_id % 7 = 0").groupBy("user_id").agg(F.max("at").alias("at"))
    store.merge(log.filter("event_id % 3 = 1"), "again", deletes=gone)
    return store.read().select("user_id", "event_type", "event_id").distinct()


@query
def stored_lengths(spark, sf):
    """Lengths of all documents, worked out once for each text over two batches that share some."""
    docs = derived.table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    store = _store(spark, "content_hash string, n_chars int, work_version int", "content_hash", "work_version")
    work = lambda new: new.select("content_hash", F.length("text").alias("n_chars"))
    first = documents.once_ever(docs.filter("doc_id % 2 = 0"), work, store, "even")
    return materialize(first).unionByName(documents.once_ever(docs.filter("doc_id % 2 <> 0"), work, store, "odd")).select(
        "doc_id", "content_hash", F.col("n_chars").cast("long").alias("n_chars"))


@query
def delete_convs(spark, sf):
    messages = _messages(spark, sf)
    conversations = messages.groupBy("conversation_id").agg(F.count("*").alias("n"))
    gone = messages.filter("role = 'system'").select("conversation_id")
    left, said = registry.delete_conversations(conversations, messages, gone)
    counted = said.groupBy("conversation_id").agg(F.count("*").alias("kept"))
    return left.join(counted, "conversation_id", "full").select("conversation_id", "n", "kept")


@query
def panel_upload(spark, sf):
    sized = derived.documents(spark, sf).withColumn("size", F.col("size") * 4096)
    return sized.select("document_id", F.coalesce(documents.panel_upload_error("filename", "size"), F.lit("ok")).alias("error"))


@query
def description_quality(spark, sf):
    rows_ = derived.table(spark, sf, "documents").select("doc_id", F.get(F.split("text", "\n"), F.lit(0)).alias("line"))
    return rows_.select("doc_id", F.expr(text.description_ok("line")).alias("ok"))


@query
def delete_docs(spark, sf):
    chunks = documents.chunk_fixed(derived.documents(spark, sf).select("document_id", "text"))
    failed = registry.registry_state(derived.registry_log(spark, sf)).filter("status = 'error'")
    return registry.delete_keys(chunks, failed, "document_id").select("document_id", "chunk_no", F.length("text").cast("long").alias("n_chars"))


@query
def forgotten_docs(spark, sf):
    """Chunks of all documents in a store with deletes between its batches: failed documents, then every seventh, half of which come back."""
    parts = documents.chunk_fixed(derived.documents(spark, sf).select("document_id", "text"))
    parts = materialize(parts.select(
        F.concat_ws("-", "document_id", "chunk_no").alias("chunk_id"), "document_id", "chunk_no", "text"))
    schema = ", ".join(f"{c} {kind}" for c, kind in parts.dtypes) + ", embedding array<float>"
    store = ChunkStore(spark, f"{ensure_checkpoint_dir(spark)}/stores/{uuid.uuid4().hex}", schema, buckets=8)

    def add(wanted: str) -> None:
        rows_ = parts.filter(wanted)
        store.add(rows_, rows_.select("chunk_id", F.array(F.length("text").cast("float")).alias("embedding")), wanted)

    add("document_id % 2 = 0")
    store.delete(registry.registry_state(derived.registry_log(spark, sf)).filter("status = 'error'"), "failed")
    add("document_id % 2 = 1")
    store.compact()
    store.delete(parts.filter("document_id % 7 = 0"), "sevenths")
    add("document_id % 14 = 0")
    return store.read().select("document_id", "chunk_no", F.length("text").cast("long").alias("n_chars"))


@query
def structured_group(spark, sf):
    rows_ = derived.transactions(spark, sf)
    grouped = registry.structured_query(
        rows_,
        "group",
        {
            "where": [("debit_amount", ">", 0)],
            "by": ["description"],
            "measures": {"spent": ("sum", "debit_amount"), "n": ("count", "debit_amount"), "most": ("max", "debit_amount")},
        },
    )
    return doubles(grouped, "spent", "most")


@query
def structured_compare(spark, sf):
    rows_ = derived.transactions(spark, sf).withColumn("year", F.year("txn_date"))
    compared = registry.structured_query(
        rows_,
        "compare",
        {
            "by": ["description"],
            "across": ("year", [1996, 1997]),
            "measures": {"spent": ("sum", "debit_amount"), "n": ("count", "debit_amount")},
        },
    )
    return doubles(compared, "1996_spent", "1997_spent").withColumnsRenamed(
        {"1996_spent": "spent_1996", "1997_spent": "spent_1997", "1996_n": "n_1996", "1997_n": "n_1997"}
    )
