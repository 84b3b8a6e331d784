"""Ordered operators that stay balanced when one key holds most of the rows.

A window over ``file_name`` alone puts a whole file into one task. Here the
rows of a key with more than ``ROWS_PER_BLOCK`` rows are cut into blocks of its
order column: windows run inside a block, one summary row per block is carried
across the blocks of the key, and the two are joined on (key, block). The keys
with fewer rows take a plain window over the key and need none of it; what
follows and works by key keeps their partitioning. The unit of work is a block,
whatever the size of the key; a large key has a summary row for each
``ROWS_PER_BLOCK`` positions that it uses, a page of a statement being one at
least. There are at most as many large keys as there are rows over
``ROWS_PER_BLOCK``, so their names are broadcast.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_BLOCK = 1 << 16
BLOCK = "_block"
#: Key and block in one value that is never null: rows whose key is null keep together like others.
KEY = "_key"


def _block_of(order: str, rows_per_block: int) -> Column:
    return F.expr(f"cast({order} as bigint) div {int(rows_per_block)}")


def apart(df: DataFrame, keys: Sequence[str], rows_per_block: int = ROWS_PER_BLOCK) -> tuple[DataFrame, DataFrame]:
    """The rows of ``df`` whose key has up to ``rows_per_block`` rows, and the others."""
    named = [F.col(k).alias(f"_large_{i}") for i, k in enumerate(keys)]
    counts = df.groupBy(*named).agg(F.count("*").alias("_large_n")).filter(F.col("_large_n") > rows_per_block)
    large = F.broadcast(counts.drop("_large_n"))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_large_{i}")) for i, k in enumerate(keys)])
    return df.join(large, same, "left_anti"), df.join(large, same, "left_semi")


def _cut(df: DataFrame, keys: Sequence[str], block: Column, columns: Sequence[Column], rows_per_block: int) -> tuple[DataFrame, DataFrame]:
    """``columns`` and ``KEY`` of the rows of ``df``, and of those alone whose key has more than ``rows_per_block`` rows."""
    key = lambda at: F.struct(*[F.col(k) for k in keys], at.alias(BLOCK)).alias(KEY)
    small, large = apart(df, keys, rows_per_block)
    small, large = small.select(*columns, key(F.lit(0).cast("long"))), large.select(*columns, key(block))
    return small.unionByName(large), large


def ordered(
    df: DataFrame,
    keys: Sequence[str],
    order: str | Sequence[str],
    *,
    running: Mapping[str, Column] | None = None,
    latest: Mapping[str, Column] | None = None,
    before: Mapping[str, Column] | None = None,
    previous: Mapping[str, Column] | None = None,
    smallest: Mapping[str, Column] | None = None,
    block: str | None = None,
    prepare: Callable[[DataFrame], DataFrame] | None = None,
    rows_per_block: int = ROWS_PER_BLOCK,
) -> DataFrame:
    """Add ordered columns per key, block by block.

    running   sum of the values up to and including the row
    latest    last non-null value up to and including the row
    before    last non-null value above the row
    previous  value of the row before (null on the first row)
    smallest  least value over the whole key
    block     an existing column that is non-decreasing in ``order``, by which
              large keys are cut; by default ``order`` (one integer column) is
              cut into equal blocks
    prepare   adds columns that the values use, row by row, after the keys
              have been counted, so that counting does not work them out

    ``order`` must be unique within a key.
    """
    keys = list(keys)
    orders = [order] if isinstance(order, str) else list(order)
    running, latest, before, previous, smallest = (
        dict(m or {}) for m in (running, latest, before, previous, smallest)
    )
    cut = _block_of(orders[0], rows_per_block) if block is None else F.col(block)
    small, _ = apart(df, keys, rows_per_block)
    _, large = _cut(df, keys, cut, [F.col(c) for c in df.columns], rows_per_block)
    small, large = (prepare(d) if prepare else d for d in (small, large))
    names = [*small.columns]
    inputs = {f"_in_{k}": v for m in (running, latest, before, previous, smallest) for k, v in m.items()}
    columns = [*map(F.col, names), *[v.alias(k) for k, v in inputs.items()]]
    small, large = small.select(*columns), large.select(*columns, KEY)

    def seen(partition: Sequence[str]) -> dict[str, Column]:
        """The columns as far as the rows of one partition tell."""
        own = Window.partitionBy(*partition)
        inside = own.orderBy(*orders)
        so_far = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        above = inside.rowsBetween(Window.unboundedPreceding, -1)
        return (
            {k: F.sum(f"_in_{k}").over(so_far) for k in running}
            | {k: F.last(f"_in_{k}", ignorenulls=True).over(so_far) for k in latest}
            | {k: F.last(f"_in_{k}", ignorenulls=True).over(above) for k in before}
            | {k: F.lag(F.struct(F.col(f"_in_{k}").alias("v"))).over(inside) for k in previous}
            | {k: F.min(f"_in_{k}").over(own) for k in smallest}
        )

    position = F.col(orders[0]) if len(orders) == 1 else F.struct(*orders)

    summary = []
    for name in running:
        summary.append(F.sum(f"_in_{name}").alias(f"_s_{name}"))
    for name in (*latest, *before):
        known = F.when(F.col(f"_in_{name}").isNotNull(), position)
        summary.append(F.max_by(f"_in_{name}", known).alias(f"_s_{name}"))
    for name in previous:
        summary.append(F.max_by(F.struct(F.col(f"_in_{name}").alias("v")), position).alias(f"_s_{name}"))
    for name in smallest:
        summary.append(F.min(f"_in_{name}").alias(f"_s_{name}"))

    everything = Window.partitionBy(*[F.col(KEY)[k] for k in keys])
    across = everything.orderBy(F.col(KEY)[BLOCK])
    earlier = across.rowsBetween(Window.unboundedPreceding, -1)
    carry = []
    for name in running:
        carry.append(F.sum(f"_s_{name}").over(earlier).alias(f"_c_{name}"))
    for name in (*latest, *before):
        carry.append(F.last(f"_s_{name}", ignorenulls=True).over(earlier).alias(f"_c_{name}"))
    for name in previous:
        carry.append(F.lag(f"_s_{name}").over(across).alias(f"_c_{name}"))
    for name in smallest:
        carry.append(F.min(f"_s_{name}").over(everything).alias(f"_c_{name}"))
    carried = large.groupBy(KEY).agg(*summary).select(KEY, *carry)

    columns = seen([KEY])
    for name in running:
        columns[name] = F.when(F.col(f"_c_{name}").isNull(), columns[name]).otherwise(
            F.coalesce(columns[name], F.lit(0)) + F.col(f"_c_{name}")
        )
    for name in (*latest, *before, *previous):
        columns[name] = F.coalesce(columns[name], F.col(f"_c_{name}"))
    for name in smallest:
        columns[name] = F.col(f"_c_{name}")

    def result(rows: DataFrame, columns: dict[str, Column]) -> DataFrame:
        values = {n: c["v"] if n in previous else c for n, c in columns.items()}
        return rows.select(*[n for n in names if n not in values], *[c.alias(n) for n, c in values.items()])

    return result(small, seen(keys)).unionByName(result(large.join(carried, KEY), columns))


def following(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    value: str,
    count: int,
    name: str = "following",
    rows_per_block: int = ROWS_PER_BLOCK,
) -> DataFrame:
    """Add ``name``: array of the next ``count`` values of ``value`` after each row."""
    keys = list(keys)
    names = list(df.columns)
    small, _ = apart(df, keys, rows_per_block)
    _, large = _cut(df, keys, _block_of(order, rows_per_block), [F.col(n) for n in names], rows_per_block)
    inside = Window.partitionBy(KEY).orderBy(order)
    across = Window.partitionBy(*[F.col(KEY)[k] for k in keys]).orderBy(F.col(KEY)[BLOCK])

    heads = (
        large.select(KEY, order, value)
        .withColumn("_rank", F.row_number().over(inside))
        .filter(F.col("_rank") <= count)
        .groupBy(KEY)
        .agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v")))).alias("_head"))
        .withColumn("_later", F.flatten(F.collect_list("_head").over(across.rowsBetween(1, count))))
        .select(KEY, F.slice(F.transform("_later", lambda h: h["v"]), 1, count).alias("_later"))
    )
    ahead = lambda *partition: F.collect_list(value).over(Window.partitionBy(*partition).orderBy(order).rowsBetween(1, count))
    cut = large.join(heads, KEY).withColumn("_own", ahead(KEY)).withColumn(name, F.slice(F.concat("_own", "_later"), 1, count))
    return small.select(*names, ahead(*keys).alias(name)).unionByName(cut.select(*names, name))
