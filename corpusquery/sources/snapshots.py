"""Versions of a table that a stream keeps: which folders make it up, replaced as a whole.

A snapshot is one small file that names the live folders.  It appears under its
final name only when it is complete, so a reader sees the folders of one version
and never a half-written one.  Folders that a version no longer names are
removed one version later, when readers of the version before have moved on.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


class Snapshots:
    """The snapshots below ``path``, through the file system that the session uses."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(conf)
        self._text = jvm.org.apache.commons.io.IOUtils

    def _versions(self) -> list[int]:
        folder = self._path(f"{self.path}/_snapshots")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n[2:-5]) for n in names if n.startswith("v-") and n.endswith(".json"))

    def _file(self, version: int):
        return self._path(f"{self.path}/_snapshots/v-{version:012d}.json")

    def latest(self, before: int | None = None) -> dict | None:
        """The newest snapshot, or the newest below a version; ``None`` without any."""
        versions = [v for v in self._versions() if before is None or v < before]
        return self.read(versions[-1]) if versions else None

    def read(self, version: int) -> dict:
        source = self._fs.open(self._file(version))
        try:
            return json.loads(self._text.toString(source, "UTF-8"))
        finally:
            source.close()

    def publish(self, version: int, snapshot: dict, gone: list[str] = ()) -> None:
        """Make a snapshot the newest one; a repeated batch replaces its own.

        ``gone`` are folders that this version no longer names.  Those that the
        version before had given up are removed now.
        """
        before = self.latest(version) or {}
        body = snapshot | {"version": version, "gone": sorted(gone)}
        part = self._path(f"{self.path}/_snapshots/_{uuid.uuid4().hex}")
        out = self._fs.create(part, True)
        out.write(bytearray(json.dumps(body).encode()))
        out.close()
        final = self._file(version)
        if self._fs.exists(final):
            self._fs.delete(final, False)
        if not self._fs.rename(part, final):
            raise OSError(f"cannot publish {final}")
        for folder in before.get("gone", []):
            self._fs.delete(self._path(f"{self.path}/{folder}"), True)
        # Versions that nobody starts from any more.
        for old in [v for v in self._versions() if v < version][:-2]:
            self._fs.delete(self._file(old), False)

    def exists(self, folder: str) -> bool:
        return self._fs.exists(self._path(f"{self.path}/{folder}"))

    def table(self, folders: list[str], schema: StructType | str) -> DataFrame:
        """The rows of some folders."""
        if not folders:
            return self.spark.createDataFrame([], schema)
        parts = [self.spark.read.schema(schema).parquet(f"{self.path}/{f}") for f in folders]
        return reduce(DataFrame.unionByName, parts)
