"""Session settings and lineage cuts."""

from __future__ import annotations

import contextlib
import os
import tempfile
import threading
import uuid
import zipfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", app: str = "quillbook", shuffle_partitions: int = 8) -> SparkSession:
    """Session for tests and the benchmark; a cluster brings its own.

    The split sizes are lowered so that a few megabytes still use every core.
    """
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64KB")
        .config("spark.sql.files.openCostInBytes", "131072")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("QUILLBOOK_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_shipped: dict[str, tempfile.TemporaryDirectory] = {}


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once per application.

    Their Python workers then import it wherever the driver was started.
    """
    application = spark.sparkContext.applicationId
    if application in _shipped:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    # the driver's own folder: executors fetch the archive from the driver, for as long as it runs
    folder = _shipped[application] = tempfile.TemporaryDirectory(prefix="quillbook-")
    archive = f"{folder.name}/{os.path.basename(package)}.zip"
    with zipfile.ZipFile(archive, "w") as file:
        for top, _, names in os.walk(package):
            for name in sorted(n for n in names if n.endswith(".py")):
                path = os.path.join(top, name)
                file.write(path, os.path.relpath(path, os.path.dirname(package)))
    spark.sparkContext.addPyFile(archive)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Checkpoint folder of the session: the cluster's setting first.

    A scratch folder of this machine is used only in local mode, where the
    driver and the executors are one process.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that every executor can reach")
        folder = tempfile.mkdtemp(prefix="quillbook-checkpoint-")
    context.setCheckpointDir(folder)
    return folder


_scopes = threading.local()


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that ``materialize`` writes inside are deleted at the end.

    For a job that writes its results inside too: a batch, a run, a benchmark.
    """
    _scopes.open = [*getattr(_scopes, "open", []), []]
    try:
        yield
    finally:
        *_scopes.open, folders = _scopes.open
        for folder in folders:
            delete_folder(spark, folder)


def delete_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder that this job has written, on whatever file system it lies."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once as a table in the checkpoint folder and read it back.

    Branches that follow scan only the columns they need, know the size of what
    they join, and do not parse again; the table outlives lost executors.
    """
    folder = f"{ensure_checkpoint_dir(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    for folders in getattr(_scopes, "open", [])[-1:]:
        folders.append(folder)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` for a join that shuffles both sides, whatever their estimated sizes.

    Spark sizes a table by its compressed files and doesn't count the rows that
    an explode or a batch function adds. Where that comes out below its
    threshold, the whole table is gathered on the driver to be broadcast, however large it is.
    """
    return df.hint("merge")
