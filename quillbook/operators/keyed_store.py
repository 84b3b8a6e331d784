"""Stored tables that take upserts and deletes by key.

A store is a folder of Parquet runs, cut into buckets of the key, and of
numbered manifests. A batch adds a run with the rows of the buckets that it
touches and reads nothing; a manifest that names it makes it visible at once.
The manifest is created under the next number and never overwritten, so of two
writers one fails and nothing is half there. A batch whose id the manifest
already has changes nothing. Compaction folds the runs of those buckets that
have several into one, drops what was replaced, keeps a delete as one row, and leaves all other
buckets alone.

Rows of a key belong together: those with the key's highest version hold, and
all others are gone, so a document's chunks are replaced as one. A delete is a
row without values under a version of its own; a late row with an older version
changes nothing.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillbook.operators.manifests import Manifested
from quillbook.session import delete_folder

BUCKETS = 64
#: Runs of a bucket that a compaction leaves as they are, at most.
RUNS_KEPT = 1
BATCH, DELETED, BUCKET = "_batch", "_deleted", "_bucket"


@dataclass
class KeyedStore(Manifested):
    """The rows of ``schema`` under ``path``; ``version`` is a column whose highest value wins, of equal ones that of the later batch."""

    spark: SparkSession
    path: str
    schema: str
    key: str
    version: str
    buckets: int = BUCKETS
    EMPTY = '{"batches": [], "runs": {}, "folded": []}'

    def merge(self, rows: DataFrame, batch: str, deletes: DataFrame | None = None) -> bool:
        """Add rows and deletes (key, version) as one batch; False where the store has the batch already.

        A null key or version is an error, and nothing is added. Of the rows of one key in a batch, those with the highest version count;
        a delete of the same version wins over them.
        """
        number, manifest = self._manifest()
        if batch in manifest["batches"]:
            return False
        columns = self.columns()
        every = rows.select(*columns, F.lit(False).alias(DELETED))  # a missing key fails the write below, before anything is visible
        if deletes is not None:
            none = [c if c in (self.key, self.version) else F.lit(None).alias(c) for c in columns]
            every = every.unionByName(deletes.select(*none, F.lit(True).alias(DELETED)))
        run = uuid.uuid4().hex  # a run that no manifest names is invisible
        self._write(every.withColumn(BATCH, F.lit(number)), run)
        for bucket in self._buckets_of(run):
            manifest["runs"].setdefault(str(bucket), []).append(run)
        manifest["batches"].append(batch)
        self._swap(number, manifest)
        return True

    def read(self, keys: DataFrame | None = None) -> DataFrame:
        """Current rows; with ``keys``, those of these keys alone."""
        manifest = self._manifest()[1]
        folded = set(manifest["folded"])
        single = {b: runs for b, runs in manifest["runs"].items() if len(runs) == 1 and runs[0] in folded}
        others = {b: runs for b, runs in manifest["runs"].items() if b not in single}
        found = self._rows(single, keys).unionByName(self._folded(others, keys))
        return found.filter(~F.col(DELETED)).select(*self.columns())

    def compact(self, runs_kept: int = RUNS_KEPT) -> list[int]:
        """Fold the buckets that have more runs than ``runs_kept`` into one each; returns these buckets."""
        number, manifest = self._manifest()
        crowded = {b: runs for b, runs in manifest["runs"].items() if len(runs) > runs_kept}
        if crowded:
            run = uuid.uuid4().hex
            # deletes stay: a late row with an older version must not bring its key back
            self._write(self._folded(crowded), run)
            for bucket in crowded:
                manifest["runs"][bucket] = [run]
            manifest["folded"] = sorted({*manifest["folded"], run} & {r for runs in manifest["runs"].values() for r in runs})
            self._swap(number, manifest)
        return sorted(map(int, crowded))

    def vacuum(self) -> int:
        """Delete runs that the newest manifest doesn't name; for times without readers of older ones. Returns their number."""
        named = {run for runs in self._manifest()[1]["runs"].values() for run in runs}
        old = [name for name in self._names("runs") if name not in named]
        for name in old:
            delete_folder(self.spark, f"{self.path}/runs/{name}")
        return len(old)

    def columns(self) -> list[str]:
        return self.spark.createDataFrame([], self.schema).columns

    def _folded(self, runs: dict[str, list[str]], keys: DataFrame | None = None) -> DataFrame:
        """Rows of these buckets with the highest version of their key, deletes among them."""
        rows = self._rows(runs, keys)
        state = F.struct(self.version, BATCH, DELETED)  # true is above false: a delete wins over rows of its version and batch
        newest = rows.groupBy(self.key).agg(F.max(state).alias("_newest"))
        return rows.join(newest, self.key).filter(state == F.col("_newest")).drop("_newest")

    def _rows(self, runs: dict[str, list[str]], keys: DataFrame | None = None) -> DataFrame:
        paths = [f"{self.path}/runs/{run}/{BUCKET}={bucket}" for bucket, names in sorted(runs.items()) for run in names]
        stored = f"{self.schema}, {DELETED} boolean, {BATCH} long"
        if not paths:
            return self.spark.createDataFrame([], stored)
        rows = self.spark.read.schema(stored).parquet(*paths)
        return rows if keys is None else rows.join(keys.select(self.key).distinct(), self.key, "left_semi")

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key).cast("string")), F.lit(self.buckets)).cast("int")

    def _write(self, rows: DataFrame, run: str) -> None:
        # a bucket goes to a few tasks, so that files are few and a large key is not one task
        missing = F.raise_error(F.lit(f"{self.key} and {self.version} must not be null"))
        rows = rows.withColumns({c: F.coalesce(F.col(c), missing) for c in (self.key, self.version)})
        slot = F.pmod(F.xxhash64(*rows.columns), F.lit(4))
        dealt = rows.withColumn(BUCKET, self._bucket()).repartition(BUCKET, slot)
        dealt.write.partitionBy(BUCKET).parquet(f"{self.path}/runs/{run}")

    def _buckets_of(self, run: str) -> list[int]:
        return sorted(int(n.split("=")[1]) for n in self._names(f"runs/{run}") if n.startswith(f"{BUCKET}="))
