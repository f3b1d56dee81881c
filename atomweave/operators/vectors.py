"""Vector search over a stored coarse quantiser: lists by nearest centre, of which each query reads some.

Centres are fitted on a sample of at most SAMPLE_ROWS rows, taken by hash of the id, so that what the driver holds is bounded. Every row goes to the list of its nearest
centre; lists are folders, so a search reads those of its queries alone. Rows of a list and the queries that read it meet in groups of bounded size, as in ``retrieve.scores``,
which with all lists, or without an index, is the exact way.

How many lists to read for a recall is measured and not guessed: once on the sample, when an index is built, and at any time by ``recall``, which compares with the exact
results of given queries. Vectors that lie in clusters need few lists; vectors without any structure need most of them, and then the exact way costs little more."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpointed, remove
from ..sources.journal import Journal, LostRace
from . import retrieve

#: Rows to fit centres on, at most; centres, at most; rounds of fitting.
SAMPLE_ROWS, MOST_CENTRES, ROUNDS = 100_000, 4_096, 10
#: Sample rows that act as queries when lists are counted, their neighbours, and the part of these to be found.
TRIED, NEIGHBOURS, TARGET = 256, 8, 0.95


def units(vectors: np.ndarray) -> np.ndarray:
    norm = np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
    return np.divide(vectors, norm, out=np.zeros_like(vectors), where=norm > 0)


def fitted(sample: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """``k`` centres of unit length: first rows spread by farthest choice, then means of what is nearest."""
    centres = [sample[0]]
    near = sample @ sample[0]
    for _ in range(1, min(k, len(sample))):
        centres.append(sample[int(np.argmin(near))])
        near = np.maximum(near, sample @ centres[-1])
    now = np.array(centres)
    for _ in range(rounds):
        of = np.concatenate([(part @ now.T).argmax(axis=1) for part in np.array_split(sample, max(1, len(sample) // 4_096))])
        total, count = np.zeros_like(now), np.bincount(of, minlength=len(now))
        np.add.at(total, of, sample)
        now = np.where(count[:, None] > 0, units(total), now)
    return now


def lists_needed(sample: np.ndarray, centres: np.ndarray, target: float = TARGET) -> int:
    """The least number of lists in which sample rows find ``target`` of their nearest in the sample."""
    asked = sample[:TRIED]
    score = asked @ sample.T
    score[np.arange(len(asked)), np.arange(len(asked))] = -np.inf
    nearest = np.argpartition(-score, min(NEIGHBOURS, len(sample) - 1) - 1, axis=1)[:, :NEIGHBOURS] if len(sample) > 1 else np.zeros((len(asked), 0), int)
    of = np.concatenate([(part @ centres.T).argmax(axis=1) for part in np.array_split(sample, max(1, len(sample) // 4_096))])
    place = np.argsort(np.argsort(-(asked @ centres.T), axis=1, kind="stable"), axis=1)  # of each list in the order that a query reads them
    needed = np.sort(np.take_along_axis(place, of[nearest], axis=1).ravel())
    return int(needed[min(len(needed) - 1, int(np.ceil(target * len(needed))) - 1)]) + 1 if len(needed) else 1


class VectorIndex:
    """Versions of an index of (doc_id, embedding) below one folder. Vectors of another width than most of the sample, or null, or with components that are null
    or not finite, are in no list and found by no search."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.journal = spark, path.rstrip("/"), Journal(spark, f"{path.rstrip('/')}/journal")

    @staticmethod
    def usable(rows: DataFrame, vector: str) -> DataFrame:
        return rows.where(F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))

    def build(self, rows: DataFrame, name: str, centres: int | None = None, sample_rows: int = SAMPLE_ROWS) -> int:
        """Fits centres, about the root of the number of rows by default, and writes all rows of ``rows`` (doc_id, embedding, …) in lists."""
        base, place = self.journal.last(), f"{self.path}/{name}"
        fine = self.usable(rows, "embedding")
        n = fine.count()
        one_in = max(1, -(-2 * n // sample_rows))  # half of the bound is aimed at, so that the limit seldom cuts
        picked = fine.where(F.pmod(F.xxhash64("doc_id"), F.lit(one_in)) == 0).select("doc_id", "embedding").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows).toArrow()
        vectors = picked.column("embedding").to_pylist()  # sample_rows at most
        width = 0
        if vectors:
            lengths, counts = np.unique([len(v) for v in vectors], return_counts=True)
            width = int(lengths[counts.argmax()])
        sample = units(np.array([v for v in vectors if len(v) == width], float)) if width else np.zeros((0, 0))
        k = min(MOST_CENTRES, centres or max(1, int(np.sqrt(n))))
        chosen = fitted(sample, k) if len(sample) else np.zeros((0, 0))
        lists = lists_needed(sample, chosen) if len(sample) else 1
        listed = self.listed(fine.where(F.size("embedding") == width), chosen)
        listed.repartition(F.col("list"), F.pmod(F.xxhash64("doc_id"), F.lit(8))).write.partitionBy("list").parquet(f"{place}/lists")
        self.spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(chosen)], "list int, centre array<double>").coalesce(1).write.parquet(f"{place}/centres")
        try:
            return self.journal.append({"folder": name, "rows": n, "centres": len(chosen), "width": width, "lists": lists, "schema": listed.schema.toDDL()}, base)
        except LostRace:
            remove(self.spark, place)
            raise

    def centres(self) -> np.ndarray:
        found = self.spark.read.parquet(f"{self.path}/{self._entry()['folder']}/centres").orderBy("list").collect()  # MOST_CENTRES rows
        return np.array([r["centre"] for r in found], float)

    def _entry(self) -> dict:
        return self.journal.entry(self.journal.last())

    @staticmethod
    def listed(rows: DataFrame, centres: np.ndarray, most: int = 1, vector: str = "embedding") -> DataFrame:
        """``rows`` with ``list``, the number of the nearest centre; with ``most`` above 1 a row for each of so many nearest ones."""
        told = rows.sparkSession.sparkContext.broadcast(centres)  # MOST_CENTRES rows
        schema = rows.withColumn("list", F.lit(0)).schema

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for start in range(0, batch.num_rows, 1_024):
                    part = batch.slice(start, 1_024)
                    values = part.column(vector).flatten().to_numpy(zero_copy_only=False).astype(float)
                    near = units(values.reshape(part.num_rows, -1)) @ told.value.T
                    count = min(most, near.shape[1])
                    order = np.argsort(-near, axis=1, kind="stable")[:, :count]
                    again = part.take(pa.array(np.repeat(np.arange(part.num_rows), count)))
                    yield pa.RecordBatch.from_arrays([*again.columns, pa.array(order.ravel(), pa.int32())], names=[*part.schema.names, "list"])

        return rows.where("false").withColumn("list", F.lit(0)) if not len(centres) else rows.mapInArrow(run, schema)

    def search(self, queries: DataFrame, k: int, lists: int | None = None, own: bool = False) -> DataFrame:
        """(query_id, rank, doc_id, score) of queries (query_id, query_vector), each over its ``lists`` nearest lists; by default as many as the sample needed."""
        entry, centres = self._entry(), self.centres()
        lists = lists or entry["lists"]
        fine = self.usable(queries, "query_vector").where(F.size("query_vector") == entry["width"])
        asked = checkpointed(self.listed(fine, centres, lists, "query_vector"))
        numbers = sorted(r[0] for r in asked.select("list").distinct().collect())  # numbers of centres
        rows = self.spark.read.schema(entry["schema"]).parquet(f"{self.path}/{entry['folder']}/lists").where(F.col("list").isin(numbers))
        scored = retrieve.scores(rows.select("doc_id", "embedding", "list"), asked, k, "vector", keys=("list",), own=own)
        return retrieve.best(scored, ["query_id"], k).select("query_id", "rank", "doc_id", "score")


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(queries, recall): of the exact results of all queries, how many were found; one row."""
    hits = exact.select("query_id", "doc_id").join(found.select("query_id", "doc_id").withColumn("hit", F.lit(1)), ["query_id", "doc_id"], "left")
    return hits.agg(F.countDistinct("query_id").alias("queries"), (F.count("hit") / F.count("*")).alias("recall"))
