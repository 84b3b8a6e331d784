"""Evaluate-once columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that later expressions and filters refer to by value.

    A plain projection is inlined into every use above it, and a filter on it
    is pushed below it as one more copy; a regex over tokens would then run
    dozens of times per row. A one-row generator is a boundary for both.
    """
    once = F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))).alias("_let")
    keep = [c for c in df.columns if c not in columns]
    return df.select(*keep, once).select(*keep, "_let.*")
