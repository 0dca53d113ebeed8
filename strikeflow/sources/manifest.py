"""Numbered manifests in a folder that executors and the driver share.

Data is written first, under names of its own, and a small JSON file that
names it comes last; readers only follow the latest manifest.  A run that is
lost half way leaves files that no manifest names, and the state before it
readable.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class ConcurrentWriteError(RuntimeError):
    pass


class Manifests:
    """The manifests of ``root``, on any file system that Spark reaches."""

    FOLDER = "_manifests"

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        folder = self._path(self.FOLDER)
        self._fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def names(self, folder: str) -> list[str]:
        """Names in a folder, sorted; none if it is missing."""
        path = self._path(folder)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(path)) if self._fs.exists(path) else []

    def numbers(self) -> list[int]:
        return [int(n.removesuffix(".json")) for n in self.names(self.FOLDER) if n.endswith(".json") and n[0] != "."]

    def read(self, number: int | None = None) -> tuple[int, dict | None]:
        """(number, content) of a manifest, by default the latest; (0, None) if there is none."""
        number = number or max(self.numbers(), default=0)
        if not number:
            return 0, None
        stream = self._fs.open(self._path(f"{self.FOLDER}/{number:08d}.json"))
        try:
            return number, json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def publish(self, after: int, content: dict) -> int:
        """Adds the manifest that follows number ``after``; raises if another writer has been there."""
        final = self._path(f"{self.FOLDER}/{after + 1:08d}.json")
        draft = self._path(f"{self.FOLDER}/.{uuid.uuid4().hex}")
        out = self._fs.create(draft)
        out.write(bytearray(json.dumps(content).encode()))
        out.close()
        if self._fs.exists(final) or not self._fs.rename(draft, final):
            self._fs.delete(draft, False)
            raise ConcurrentWriteError(f"{final} was written by another run")
        return after + 1

    def remove(self, name: str) -> None:
        self._fs.delete(self._path(name), True)
