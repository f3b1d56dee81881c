"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import remove, shared_folder

#: Largest side, in rows, that is sent to every executor; larger sides are joined by a shuffle.
BROADCAST_ROWS = 200_000


_folder: ContextVar[str | None] = ContextVar("folder", default=None)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """A folder in the shared one for all that is cut inside; it is removed at the end, when what was made of it is written."""
    path = f"{shared_folder(spark)}/atomweave/scratch-{uuid.uuid4().hex}"
    token = _folder.set(path)
    try:
        yield path
    finally:
        _folder.reset(token)
        remove(spark, path)


def sliced(batches: Iterable[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in slices, so that what is made of one at a time stays small. Pages that Arrow or the C library keep
    are given back, as a worker lives on for later tasks of other kinds."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
        give_back()
    give_back()


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of the GNU C library
        trim(0)


#: Rows that Spark hands to Python at a time; its default is ten times as many, which long documents make large.
ARROW_ROWS = 1_000


def small_batches(spark: SparkSession) -> SparkSession:
    """Lowers the session's Arrow batches to ARROW_ROWS where they are larger, to bound the space of both sides."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= ARROW_ROWS:
        spark.conf.set(name, ARROW_ROWS)
    return spark


def cut(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` into the shared folder and reads it again: a lost executor then costs no recomputation of what came before."""
    spark = df.sparkSession
    path = f"{_folder.get() or shared_folder(spark) + '/atomweave'}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sized(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint only when its counted ``rows`` are within ``limit``."""
    return F.broadcast(df) if rows <= limit else df


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` doesn't have, in any case."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def column_type(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z alone, whatever the locale."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
