"""Folders listed level by level, by tasks: ignored folders are never listed, links never followed."""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import globs as G
from ..session import checkpointed

ENTRIES = "folder string, name string, kind string, size long, modified_ms long"
#: Bytes of contents that a task hands on at a time.
HELD = 8_000_000


def placed(root: str) -> tuple[fs.FileSystem | None, str]:
    """The file system of a root and the path in it; None for folders of this machine or mounted on all."""
    scheme, colon, rest = root.partition(":")
    if not colon or scheme == "file":
        return None, "/" + (rest if colon else root).lstrip("/").rstrip("/")
    system, inner = fs.FileSystem.from_uri(root.replace("s3a:", "s3:", 1).replace("s3n:", "s3:", 1))
    return system, inner.rstrip("/")


def entries(root: str, folder: str) -> Iterator[tuple[str, str, int, int]]:
    """(name, kind, size, modified_ms) of a folder's files and folders; a folder that can't be read has none."""
    system, base = placed(root)
    path = f"{base}/{folder}" if folder else base
    try:
        if system is None:
            for e in os.scandir(path):
                if e.is_symlink():
                    continue
                if e.is_dir(follow_symlinks=False):
                    yield e.name, "folder", 0, 0
                elif e.is_file(follow_symlinks=False):
                    told = e.stat(follow_symlinks=False)
                    yield e.name, "file", told.st_size, int(told.st_mtime * 1000)
            return
        for e in system.get_file_info(fs.FileSelector(path)):
            if e.type == fs.FileType.Directory:
                yield e.base_name, "folder", 0, 0
            elif e.is_file:
                yield e.base_name, "file", e.size, int(e.mtime_ns // 1_000_000)
    except OSError:
        return


def walked(spark: SparkSession, root: str, ignore: Iterable[str]) -> tuple[DataFrame, DataFrame]:
    """(files (rel_path, path, size, modified), folders listed (folder)) below ``root``. A level of folders is one job, whose tasks list them."""
    ignored = list(ignore)
    level, parts = spark.createDataFrame([("",)], "folder string"), []

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                rows = [(folder, None, "listed", 0, 0), *((folder, *e) for e in entries(root, folder))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=[x.split()[0] for x in ENTRIES.split(", ")])

    rel = F.when(F.col("folder") == "", F.col("name")).otherwise(F.concat_ws("/", "folder", "name"))
    while True:
        found = checkpointed(level.repartition("folder").mapInArrow(run, ENTRIES).withColumn("rel_path", rel))
        parts.append(found)
        level = found.where((F.col("kind") == "folder") & ~G.matches_any(F.col("rel_path"), ignored)).select(F.col("rel_path").alias("folder"))
        if not level.limit(1).count():
            break
    every = parts[0]
    for more in parts[1:]:
        every = every.unionByName(more)
    base = root.rstrip("/")
    files = every.where("kind = 'file'").select("rel_path", F.concat(F.lit(f"{base}/"), "rel_path").alias("path"), "size", F.timestamp_millis("modified_ms").alias("modified"))
    return files, every.where("kind = 'listed'").select("folder")


def with_content(files: DataFrame) -> DataFrame:
    """``files`` (…, path) with their ``content``, null where it can't be read."""
    schema = files.withColumn("content", F.lit(b"")).schema

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start, held, out = 0, 0, []
            for k, path in enumerate(batch.column(batch.schema.get_field_index("path")).to_pylist()):
                out.append(read(path))
                held += len(out[-1] or b"")
                if held > HELD or k + 1 == batch.num_rows:
                    part = batch.slice(start, len(out))
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.binary())], names=[*batch.schema.names, "content"])
                    start, held, out = k + 1, 0, []

    return files.mapInArrow(run, schema)


def read(path: str) -> bytes | None:
    system, inner = placed(path)
    try:
        with (system or fs.LocalFileSystem()).open_input_stream(inner) as source:
            return source.read()
    except OSError:
        return None
