"""Chunks with their vectors in a store that forgets documents without rewriting them.

A run holds added chunks, cut into buckets of document_id. A delete writes only
the ids of its documents, bucket by bucket: its deletion vectors. They hide the
rows of these documents that the store had by then; what is added afterwards is
seen. Readers take buckets without vectors as they are and drop hidden rows from
the others by a join with the vectors, so a delete costs as much as its ids.
Compaction counts hidden rows by reading two narrow columns of the buckets with
vectors, rewrites those where too many are hidden, and leaves the others alone.
All changes become visible by a manifest.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillbook.operators.manifests import Manifested
from quillbook.session import delete_folder

KEY, BUCKET, VERSION = "document_id", "_bucket", "_version"
BUCKETS = 64
#: Share of hidden rows above which a bucket is rewritten.
DEAD_SHARE = 0.2
#: Tasks that write a bucket, so that a large document is not one task.
WRITERS = 8


@dataclass
class ChunkStore(Manifested):
    """Chunks of ``schema``, document_id and chunk_id among its columns, under ``path``."""

    spark: SparkSession
    path: str
    schema: str
    buckets: int = BUCKETS
    EMPTY = '{"batches": [], "runs": {}, "deletes": {}}'

    def add(self, chunks: DataFrame, embeddings: DataFrame, batch: str) -> bool:
        """Add chunks with their vectors as one batch; False where the store has the batch already.

        Both sides must have the same chunk ids, each once, and every chunk a
        document, else ValueError, and nothing is added. An empty batch is a batch.
        """
        number, manifest = self._manifest()
        if batch in manifest["batches"]:
            return False
        sides = chunks.select("chunk_id", F.lit(1).alias("c"), F.lit(0).alias("e"), F.col(KEY).isNull().cast("int").alias("lost")).unionByName(
            embeddings.select("chunk_id", F.lit(0).alias("c"), F.lit(1).alias("e"), F.lit(0).alias("lost")))
        counts = sides.groupBy("chunk_id").agg(*[F.sum(n).alias(n) for n in ("c", "e", "lost")])
        if not counts.filter("c <> 1 OR e <> 1 OR lost > 0 OR chunk_id IS NULL").isEmpty():
            raise ValueError("Chunks and embeddings must have the same ids, each once, and chunks a document")
        rows = chunks.join(embeddings, "chunk_id").select(*self._columns(), F.lit(number).cast("long").alias(VERSION))
        run = self._write(rows, "runs")
        self._list(manifest["runs"], "runs", run)
        manifest["batches"].append(batch)
        self._swap(number, manifest)
        return True

    def delete(self, documents: DataFrame, batch: str) -> bool:
        """Hide all chunks that the store has of ``documents`` (document_id); False where the store has the batch already.

        Null ids and documents that the store doesn't have hide nothing.
        """
        number, manifest = self._manifest()
        if batch in manifest["batches"]:
            return False
        ids = documents.select(KEY).filter(F.col(KEY).isNotNull()).distinct()
        run = self._write(ids.withColumn(VERSION, F.lit(number).cast("long")), "deletes")
        self._list(manifest["deletes"], "deletes", run, only=manifest["runs"])
        manifest["batches"].append(batch)
        self._swap(number, manifest)
        return True

    def read(self, documents: DataFrame | None = None) -> DataFrame:
        """The chunks that are not hidden; with ``documents`` (document_id), theirs alone, from their buckets."""
        manifest = self._manifest()[1]
        runs = manifest["runs"]
        if documents is not None:
            documents = documents.select(KEY).distinct()
            wanted = {str(r[BUCKET]) for r in documents.select(self._bucket().alias(BUCKET)).distinct().collect()}  # ``buckets`` at most
            runs = {b: names for b, names in runs.items() if b in wanted}
        whole = self._rows({b: names for b, names in runs.items() if b not in manifest["deletes"]})
        thinned = {b: names for b, names in runs.items() if b in manifest["deletes"]}
        if thinned:
            whole = whole.unionByName(self._alive(self._rows(thinned), self._vectors({b: manifest["deletes"][b] for b in thinned})))
        found = whole.select(*self._columns())
        return found if documents is None else found.join(documents, KEY, "left_semi")

    def dead_shares(self) -> DataFrame:
        """bucket, n_rows, n_dead of every bucket with deletion vectors and rows; document ids and versions alone are read."""
        manifest = self._manifest()[1]
        rows = self._rows({b: names for b, names in manifest["runs"].items() if b in manifest["deletes"]}).select(KEY, VERSION)
        gone = self._vectors(manifest["deletes"])
        # runs of a document have few versions: counted before the join, so a large document is a few rows in it
        counted = rows.groupBy(KEY, VERSION).agg(F.count("*").alias("n"))
        dead = F.when(F.col(VERSION) < F.col("_gone"), F.col("n")).otherwise(0)
        joined = counted.join(gone, KEY, "left").withColumn("bucket", self._bucket())
        return joined.groupBy("bucket").agg(F.sum("n").alias("n_rows"), F.sum(dead).alias("n_dead"))

    def compact(self, share: float = DEAD_SHARE) -> list[int]:
        """Rewrite the buckets in which more than ``share`` of the rows are hidden, without these rows; returns the buckets.

        Their vectors are dropped; vectors that hide nothing are dropped too, with no rewriting.
        """
        number, manifest = self._manifest()
        shares = {str(r.bucket): (r.n_rows, r.n_dead) for r in self.dead_shares().collect()}  # ``buckets`` at most
        idle = [b for b in manifest["deletes"] if shares.get(b, (0, 0))[1] == 0]
        full = sorted((b for b, (n, dead) in shares.items() if dead > share * n), key=int)
        if full:
            vectors = self._vectors({b: manifest["deletes"][b] for b in full})
            run = self._write(self._alive(self._rows({b: manifest["runs"][b] for b in full}), vectors), "runs")
            for bucket in full:
                del manifest["runs"][bucket]
            self._list(manifest["runs"], "runs", run)
        for bucket in {*idle, *full}:
            del manifest["deletes"][bucket]
        if idle or full:
            self._swap(number, manifest)
        return [int(b) for b in full]

    def vacuum(self) -> int:
        """Delete folders that the newest manifest doesn't name; for times without other readers or writers. Returns their number."""
        manifest, deleted = self._manifest()[1], 0
        for kind in ("runs", "deletes"):
            named = {name for names in manifest[kind].values() for name in names}
            for name in self._names(kind):
                if name not in named:
                    delete_folder(self.spark, f"{self.path}/{kind}/{name}")
                    deleted += 1
        return deleted

    def _columns(self) -> list[str]:
        return self.spark.createDataFrame([], self.schema).columns

    def _alive(self, rows: DataFrame, vectors: DataFrame) -> DataFrame:
        """Rows that no later delete hides; the vectors are joined by broadcast where Spark finds them small."""
        return rows.join(vectors, KEY, "left").filter(F.col("_gone").isNull() | (F.col(VERSION) > F.col("_gone"))).drop("_gone")

    def _rows(self, runs: dict[str, list[str]]) -> DataFrame:
        return self._read("runs", f"{self.schema}, {VERSION} long", runs)

    def _vectors(self, deletes: dict[str, list[str]]) -> DataFrame:
        """(document_id, _gone): the version of a document's last delete."""
        kind = dict(self.spark.createDataFrame([], self.schema).dtypes)[KEY]
        return self._read("deletes", f"{KEY} {kind}, {VERSION} long", deletes).groupBy(KEY).agg(F.max(VERSION).alias("_gone"))

    def _read(self, kind: str, schema: str, listed: dict[str, list[str]]) -> DataFrame:
        paths = [f"{self.path}/{kind}/{name}/{BUCKET}={b}" for b, names in sorted(listed.items()) for name in names]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col(KEY).cast("string")), F.lit(self.buckets)).cast("int")

    def _write(self, rows: DataFrame, kind: str) -> str:
        """Write rows by bucket to a new folder, which no manifest names yet; returns its name."""
        name = uuid.uuid4().hex
        slot = F.pmod(F.xxhash64(F.col("chunk_id" if kind == "runs" else KEY)), F.lit(WRITERS))
        dealt = rows.withColumn(BUCKET, self._bucket()).repartition(BUCKET, slot)
        dealt.write.partitionBy(BUCKET).parquet(f"{self.path}/{kind}/{name}")
        return name

    def _list(self, listed: dict[str, list[str]], kind: str, name: str, only: dict | None = None) -> None:
        """Add a written folder to the buckets it has rows for; with ``only``, to those of these buckets."""
        for folder in self._names(f"{kind}/{name}"):
            bucket = folder.removeprefix(f"{BUCKET}=")
            if bucket != folder and (only is None or bucket in only):
                listed.setdefault(bucket, []).append(name)
