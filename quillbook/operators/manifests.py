"""Numbered manifests of a stored table: the newest one says which files are in it.

A manifest is complete before it gets its name, and a name is never given
twice, so a change is visible at once or not at all, and of two writers one fails.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class Manifested:
    """A stored table at ``path``; ``EMPTY`` is the manifest of one that has none yet."""

    spark: SparkSession
    path: str
    EMPTY = "{}"

    def _file(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _names(self, folder: str) -> list[str]:
        system, path = self._file(folder)
        return [s.getPath().getName() for s in system.listStatus(path)] if system.exists(path) else []

    def _manifest(self) -> tuple[int, dict]:
        """The next manifest's number, and the content of the newest one."""
        numbers = [int(n.removesuffix(".json")) for n in self._names("manifests") if n.endswith(".json")]
        if not numbers:
            return 1, json.loads(self.EMPTY)
        (row,) = self.spark.read.text(f"{self.path}/manifests/{max(numbers):012d}.json", wholetext=True).collect()
        return max(numbers) + 1, json.loads(row["value"])

    def _swap(self, number: int, manifest: dict) -> None:
        """Make ``manifest`` the newest one, unless another writer was faster: its file is complete before it gets its name, and a rename doesn't overwrite."""
        system, made = self._file(f"manifests/.{uuid.uuid4().hex}")
        out = system.create(made, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        _, named = self._file(f"manifests/{number:012d}.json")
        if system.exists(named) or not system.rename(made, named):
            system.delete(made, False)
            raise RuntimeError(f"the store at {self.path} was changed by another writer; read it again and repeat the batch")
