"""A commit log: one small file for each version, in a folder that all writers share.

A version's file is written under a name of its own and then renamed to the version's number, which fails if that number is
taken. So of two writers that start from one version one wins, and the other is told so (LostRace) and may start again
from what is there now. Readers see whole files only. That holds wherever a rename fails on an existing target in one step,
as in HDFS; local folders test and rename in two, which leaves a moment between."""

from __future__ import annotations

import json
import uuid
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class LostRace(RuntimeError):
    """Another writer has committed since the version that this one started from."""


class Journal:
    """Entries, as objects of JSON, numbered from 1 without gaps."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _place(self, name: str = ""):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _system(self):
        return self._place().getFileSystem(self._conf)

    def versions(self) -> list[int]:
        """Numbers of all versions, from one listing of the folder."""
        system = self._system()
        if not system.exists(self._place()):
            return []
        names = [s.getPath().getName() for s in system.listStatus(self._place())]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))

    def last(self) -> int:
        return max(self.versions(), default=0)

    def entry(self, version: int) -> dict[str, Any]:
        stream = self._system().open(self._place(f"{version:020d}.json"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def append(self, entry: dict[str, Any], after: int) -> int:
        """Commits ``entry`` as the version after ``after``; LostRace if ``after`` isn't the last one any more."""
        if self.last() != after:
            raise LostRace(f"{self.path} has gone on to version {self.last()} since {after}")
        system, version = self._system(), after + 1
        draft, target = self._place(f".draft-{uuid.uuid4().hex}"), self._place(f"{version:020d}.json")
        stream = system.create(draft, False)
        stream.write(bytearray(json.dumps(entry, sort_keys=True).encode()))
        stream.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(system.getUri(), self._conf)
        none = self._jvm.org.apache.hadoop.fs.Options.Rename.NONE
        how = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        how[0] = none
        try:
            context.rename(draft, target, how)
        except Py4JJavaError as error:
            system.delete(draft, False)
            if "FileAlreadyExists" in str(error.java_exception):
                raise LostRace(f"version {version} of {self.path} is taken") from error
            raise
        return version
