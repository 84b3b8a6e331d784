"""Headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; one JSON line.

Each query is planned and run to the end once; its rows go to a sink that
drops them. Statement text and table rows are rendered outside the clock.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from quillbook.operators import rows, lines, tables  # noqa: E402
from quillbook.plans.queries import QUERIES  # noqa: E402
from quillbook.plans.statement import process_statements  # noqa: E402
from quillbook.session import local_session, scratch  # noqa: E402
from quillbook.sources import derived  # noqa: E402

NAMES = (
    "spend_by_category", "classify_hybrid", "running_balance", "txn_dedupe", "strategy_pick", "date_normalize",
    "chunk_structured", "chunk_fixed", "content_cache", "keyword_top4", "vec_topk", "nb_train", "registry_latest",
    "structured_compare", "token_lines",
)


def drain(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), app="quillbook-bench")
    rendered = tempfile.mkdtemp(prefix="quillbook-bench-")
    derived.statement_lines(spark, folder).write.parquet(f"{rendered}/lines")
    derived.table_cells(spark, folder).write.parquet(f"{rendered}/cells")
    stored_lines, stored_cells = (spark.read.parquet(f"{rendered}/{n}") for n in ("lines", "cells"))

    runs = {name: (lambda q=QUERIES[name]: q(spark, folder)) for name in NAMES}
    runs["txn_parse"] = lambda: rows.parse_parts(lines.split_parts(stored_lines))
    runs["stmt_parse"] = lambda: process_statements(stored_lines).transactions
    runs["tabular_parse"] = lambda: tables.table_transactions(stored_cells)
    seconds = {}
    for name, build in runs.items():
        start = time.perf_counter()
        with scratch(spark):
            drain(build())
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total_query_seconds",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
