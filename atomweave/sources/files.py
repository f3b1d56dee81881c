"""Files of a workspace, transcripts and attempt logs as DataFrames."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import globs as G
from ..functions import names as N
from ..session import checkpointed
from . import tree


def scan_files(spark: SparkSession, root: str, include: Iterable[str] | None = None, ignore: Iterable[str] = (), content: bool = False) -> DataFrame:
    """(rel_path, doc_name, path, size, modified[, content]) below a folder, by relative path. Ignored folders aren't listed, links not followed;
    contents are read only if they are asked for."""
    ignored = [*G.default_ignored(), *ignore]
    found, _ = tree.walked(spark, root, ignored)
    chosen = found.where(G.wanted(F.col("rel_path"), include, ignore)).select("rel_path", N.flat_name(F.col("rel_path")).alias("doc_name"), "path", "size", "modified")
    return (tree.with_content(chosen) if content else chosen).orderBy("rel_path")


def plan_files(spark: SparkSession, root: str) -> DataFrame:
    """(name, modified, plan, approved) of markdown files, for the backfill of plans, oldest first."""
    found = scan_files(spark, root, include=("**/*.md",), content=True)
    return found.select("rel_path", "modified", F.decode("content", "UTF-8").alias("plan"), F.lit(True).alias("approved")).orderBy("modified")


#: How deep texts in a transcript may be nested.
DEPTH = 8
_INSIDE = ("message", "content", "prompt", "compact_summary", "summary")


def texts_in(value: object, depth: int = DEPTH) -> list[str]:
    """Texts in a JSON value: a string, the ``text`` of an object, or what its known fields hold; tool calls and their results
    are passed over."""
    if depth < 0 or value is None:
        return []
    if isinstance(value, str):
        return [value]
    if isinstance(value, list):
        return [t for item in value for t in texts_in(item, depth - 1)]
    if not isinstance(value, dict) or value.get("type") in ("tool_use", "tool_result"):
        return []
    if isinstance(value.get("text"), str):
        return [value["text"]]
    return [t for name in _INSIDE for t in texts_in(value.get(name), depth - 1)]


@F.pandas_udf(T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType())]))
def _entries(lines: pd.Series) -> pd.DataFrame:
    """Role and text of each line, null where it isn't JSON. Texts nest to a depth that SQL functions can't follow."""
    out = []
    for line in lines:
        try:
            entry = json.loads(line)
        except (TypeError, ValueError, RecursionError):
            entry = None
        message = entry.get("message") if isinstance(entry, dict) else None
        inner = message if isinstance(message, dict) else {}
        role = next((str(x) for x in (inner.get("role"), entry.get("role"), entry.get("type")) if x), "entry") if isinstance(entry, dict) else None
        out.append((role, "\n".join(texts_in(entry)).strip() if role else None))
    return pd.DataFrame(out, columns=["role", "text"])


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line, value): lines of text files with their numbers in the file, from 0.

    Spark reads a file in blocks, each by one task and in order. Lines are counted within a block where they are read; what stands before a block is a sum over
    the blocks of its file, of which only those of files with several blocks are joined."""
    read = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), "value")

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, seen = None, 0
        for batch in batches:
            keys = list(zip(batch.column("path").to_pylist(), batch.column("block").to_pylist(), strict=True))
            numbers = []
            for key in keys:
                now, seen = key, seen + 1 if key == now else 0
                numbers.append(seen)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(numbers, pa.int64())], names=[*batch.schema.names, "nth"])

    counted = read.mapInArrow(count, "path string, block long, value string, nth long")
    blocks = counted.groupBy("path", "block").agg((F.max("nth") + 1).alias("n"))
    ahead = blocks.withColumn("before", F.sum("n").over(Window.partitionBy("path").orderBy("block")) - F.col("n")).where("before > 0").select("path", "block", "before")
    return counted.join(checkpointed(ahead), ["path", "block"], "left").select("path", (F.col("nth") + F.coalesce("before", F.lit(0))).alias("line"), "value")


def transcripts(spark: SparkSession, path: str) -> DataFrame:
    """(conv_id, turn, role, text) of JSON lines: one conversation for each file, with the line as its turn; lines that aren't JSON or whose role is
    none of the known are passed over."""
    lines = numbered_lines(spark, path).select(F.col("path").alias("conv_id"), F.col("line").alias("turn"), _entries("value").alias("e"))
    return lines.select("conv_id", "turn", "e.role", "e.text").where(F.col("role").isin("user", "assistant", "summary", "system") & (F.col("text") != ""))


ATTEMPT = "ts timestamp, kind string, ok boolean, durationMs long, error string, logPath string"


def attempts(spark: SparkSession, path: str, last: int | None = None) -> DataFrame:
    """Attempt log lines, the malformed dropped; the last few by time if asked."""
    found = spark.read.schema(ATTEMPT).option("mode", "DROPMALFORMED").json(path)
    return found.orderBy(F.desc("ts")).limit(last) if last else found


def append_log(entries: DataFrame, path: str) -> None:
    """Log entries (at_ms, …) appended under year and month."""
    at = F.timestamp_millis("at_ms")
    entries.withColumn("year", F.date_format(at, "yyyy")).withColumn("month", F.date_format(at, "MM")).write.mode("append").partitionBy("year", "month").json(path)


def kept_last(entries: DataFrame, most: int = 50, order: str = "ts") -> DataFrame:
    """The last so many attempts, by time; the others may be pruned."""
    return entries.orderBy(F.desc_nulls_last(order)).limit(most)


def kept_logs(listing: DataFrame, now_ms: int, days: int) -> DataFrame:
    """Logs whose name says that they are younger than so many days."""
    epoch = F.regexp_extract("path", r"cron-(\d+)\.json$", 1).try_cast("long")
    return listing.where(epoch >= now_ms - days * 86_400_000)
