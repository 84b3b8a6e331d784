"""Small helpers of the subpackage: table reads, free column names, row numbers."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillbook.session import materialize

#: Constant under which a row with a text, and a row without one, counts in sizes.
ROW_BYTES = 16


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like the given ones that no column of ``df`` has, in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"{name}_"
        taken.add(name.lower())
        out.append(name)
    return out


def numbered(df: DataFrame, name: str) -> DataFrame:
    """``df`` with a row number, written once so that every later read sees the same number.

    The upper bits are the writing partition, so the numbers follow the order of the input.
    """
    return materialize(df.withColumn(name, F.monotonically_increasing_id()))


def file_places(df: DataFrame) -> tuple[DataFrame, Column, Column] | None:
    """``df`` with (file, index in it) per row, and columns that put the rows in the order of file names and of rows in them.

    Spark reads files by size and cuts them, so neither partitions nor row
    numbers follow their names. None where ``df`` is no plain scan of Parquet
    files, with columns and rows taken from it at most.
    """
    plan = df._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.child()
    if not plan.nodeName().startswith("LogicalRelation"):
        return None
    path, index = fresh(df, "file_path", "row_index")
    try:
        placed = df.withColumns({path: F.col("_metadata.file_path"), index: F.col("_metadata.row_index")})
        placed.schema  # noqa: B018 - resolves the names
    except AnalysisException:
        return None
    return placed, F.col(path), F.col(index)


def row_key(id_col: str, text_col: str) -> Column:
    """A digest of a row's id and text, equal for rows that share both and never null."""
    return F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("\u0001")), F.lit("\u0002"), or_empty(text_col)))


def or_empty(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))
