"""The whole statement job: lines, boxes or table rows in, checked tables out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillbook.operators import categorize, checks, choose, layout, lines, metadata, rows, tables
from quillbook.operators.blocks import ROWS_PER_BLOCK
from quillbook.session import materialize

COLUMNS = ("file_name", "pos", "sub", *rows.VALUES)


@dataclass
class StatementTables:
    transactions: DataFrame
    """valid, repaired, classified rows in (pos, sub) order per file"""
    rejected: DataFrame
    """discarded rows with their issues"""
    sections: DataFrame
    """valid rows of the detail sections, by part"""
    statements: DataFrame
    """one row per file: letterhead, totals, warnings, validation_status"""
    checks: DataFrame
    """five checks per file"""
    notes: DataFrame
    """one line per repaired amount"""


def process_statements(
    text_lines: DataFrame,
    boxes: DataFrame | None = None,
    cells: DataFrame | None = None,
    document_type: str = "text",
    strict_parity: bool = False,
    rows_per_block: int = ROWS_PER_BLOCK,
) -> StatementTables:
    """Parse, choose, validate, repair, classify and check statements.

    ``text_lines``: file_name, page_no, line_no, text. ``boxes`` are word boxes
    and ``cells`` table rows of the same files; both are optional candidates.
    Rows and parts are written to the checkpoint folder once; every later step
    reads them from there.
    """
    text_lines = materialize(text_lines)
    parts = materialize(lines.split_parts(text_lines, rows_per_block))
    parsed = materialize(rows.parse_parts(parts, strict_parity, rows_per_block))
    candidates = parsed.filter(F.col("part") == lines.PRIMARY).select(*COLUMNS, F.lit("line_window").alias("strategy"))
    if boxes is not None:
        by_box = layout.box_transactions(boxes, strict_parity, rows_per_block)
        candidates = candidates.unionByName(by_box.select(*COLUMNS, F.lit("box_columns").alias("strategy")))
    if cells is not None:
        by_cell = tables.table_transactions(cells, None, strict_parity, rows_per_block)
        candidates = candidates.unionByName(by_cell.select(*COLUMNS, F.lit("pdf_tables").alias("strategy")))
    if boxes is None and cells is None:
        chosen = candidates
        picked = candidates.select("file_name", "strategy").distinct()
    else:
        candidates = materialize(candidates)
        picked = materialize(choose.pick_strategy(choose.score_candidates(candidates, rows_per_block)))
        chosen = candidates.join(picked, ["file_name", "strategy"], "left_semi")

    seen = checks.checked(chosen.drop("strategy"))
    seen = materialize(seen)
    valid = seen.filter("size(issues) = 0").drop("issues")
    dropped = seen.filter("size(issues) > 0")
    details = checks.checked(parsed.filter(F.col("part") != lines.PRIMARY), ["file_name", "part"])
    details = materialize(details.filter("size(issues) = 0").drop("issues"))
    repaired = checks.repair_amounts(valid, details, rows_per_block)
    model = categorize.NaiveBayesTables(categorize.training_texts(text_lines.sparkSession))
    classified = materialize(categorize.classify(repaired, model))

    primary = parts.filter(F.col("part") == lines.PRIMARY)
    bad_dates = lines.count_bad_dates(lines.date_windows(primary, ["file_name"], rows_per_block), ["file_name"])
    header = metadata.statement_metadata(text_lines, rows_per_block)
    files = text_lines.select("file_name").distinct()
    validated = checks.statement_validation(
        files.join(picked.withColumnRenamed("strategy", "extraction_method"), "file_name", "left"),
        checks.statement_totals(classified, rows_per_block),
        checks.section_totals(details),
        header,
        checks.dropped_summary(dropped),
        bad_dates,
    )
    missing = F.when(F.col("transaction_count") == 0, F.array(F.lit("No transaction rows could be parsed from this document.")))
    validated = validated.withColumns(
        {
            "document_type": F.lit(document_type),
            "extraction_method": F.coalesce("extraction_method", F.lit("line_window")),
            "warnings": F.concat(F.coalesce(missing, F.array().cast("array<string>")), "warnings"),
        }
    )
    return StatementTables(
        transactions=classified.drop("misread"),
        rejected=dropped,
        sections=details,
        statements=validated,
        checks=checks.validation_checks(validated),
        notes=checks.repair_notes(classified),
    )
