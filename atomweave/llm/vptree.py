"""Centroid clustering: rounds of exact assignment through a vantage-point tree over the centroids.

Vectors become whole numbers, ``floor(64 x)``. The first centroids are the vectors whose hashed ids are smallest. In each
round the driver builds a tree over the centroids, a table of ``k`` rows, and broadcasts it; tasks assign vectors to their
nearest centroid, and hand on one row of sums for each centroid and partition; these are added up by centroid and
component, and what reaches the driver is ``k`` times the width. Sums are decimals and means are floors of whole
quotients, so results don't hang on partitions or order. Nothing of the vectors is kept or shuffled.

The tree: a node holds a vantage centroid, or some few centroids at a leaf, and of each of its two sides the least and
greatest distance from the vantage. Each vector goes through the nodes best first: it opens the node with the smallest
lower bound, compares whole squared distances there, and bounds the two sides by the triangle inequality. It stops when
the smallest bound lies beyond its best distance; a bound equal to it, or within rounding of it, is still opened, so that a tie is
found and goes to the smaller number. All vectors of a batch take their steps together, and those at one node are
compared at once.

Edge cases: a vector takes part if it has exactly ``width`` components, none null or not finite; a null id is hashed as empty text
and keeps its row; rows that repeat take part each, and equal hashes go by the vector; with fewer vectors than ``k`` there
are as many centroids as vectors, and without any no rows; equal centroids are allowed, the later one stays empty, and
empty centroids stay where they are. Components of up to 2^27 (after quantising) are compared in 64 bits, larger ones as
integers of any length; beyond 2^62 there is an error; distances and sums that don't fit in a long are null. Other columns
aren't read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column_type, sliced

K, ROUNDS, WIDTH, SCALE, SEED = 16, 3, 64, 64, 1
#: Centroids of a leaf, vectors that go through the tree together, and how far a bound may be off by rounding.
LEAF, ROWS, SLACK = 2, 4_096, 1e-12
NARROW, WIDE, LONG = 2**27, 2**62, 2**63 - 1


@dataclass
class Node:
    #: Numbers of the centroids that are compared here: a vantage, or those of a leaf.
    members: list[int]
    #: Sides of the vantage: node, least and greatest distance of its centroids.
    sides: list[tuple[int, float, float]]


def squares(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances, exact: in 64 bits where these hold them, else of whole numbers of any length."""
    if max((int(abs(x).max()) for x in (vectors, centroids) if x.size), default=0) > NARROW:
        vectors, centroids = vectors.astype(object), centroids.astype(object)
    gap = vectors[:, None, :] - centroids[None, :, :]
    return (gap * gap).sum(axis=2)


class VantageTree:
    """A tree over the rows of ``centroids``; equal centroids are told apart by number alone."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        self.nodes: list[Node] = []
        self.grow(list(range(len(centroids))))

    def grow(self, members: list[int]) -> int:
        place = len(self.nodes)
        if len(members) <= LEAF:
            self.nodes.append(Node(members, []))
            return place
        # the vantage: the centroid farthest from the first one, which lies at an edge
        away = squares(self.centroids[members[:1]], self.centroids[members])[0]
        vantage = members[int(np.argmax(away))]
        rest = [m for m in members if m != vantage]
        far = np.sqrt(squares(self.centroids[[vantage]], self.centroids[rest])[0].astype(float))
        order = np.argsort(far, kind="stable")
        node = Node([vantage], [])
        self.nodes.append(node)
        half = len(rest) // 2
        for part in (order[:half], order[half:]):
            if len(part):
                low, high = float(far[part].min()), float(far[part].max())
                node.sides.append((self.grow([rest[p] for p in part]), low, high))
        return place

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Number of the nearest centroid of each vector, its squared distance, and how many distances were computed."""
        n, compared = len(vectors), 0
        bounds = np.full((n, len(self.nodes)), np.inf)
        bounds[:, 0] = 0.0
        best = np.full(n, -1, object if max(int(abs(x).max()) if x.size else 0 for x in (vectors, self.centroids)) > NARROW else np.int64)
        reach, number = np.full(n, np.inf), np.full(n, len(self.centroids))
        left = np.arange(n)
        while len(left):
            step = bounds[left].argmin(axis=1)
            low = bounds[left, step]
            open_ = np.isfinite(low) & (low <= reach[left] * (1 + SLACK))
            left, step = left[open_], step[open_]
            for place in np.unique(step):
                rows, node = left[step == place], self.nodes[place]
                above = bounds[rows, place]
                bounds[rows, place] = np.inf
                found = squares(vectors[rows], self.centroids[node.members])
                compared += found.size
                for column, member in enumerate(node.members):
                    d = found[:, column]
                    better = (number[rows] == len(self.centroids)) | (d < best[rows]) | ((d == best[rows]) & (member < number[rows]))
                    best[rows[better]], number[rows[better]] = d[better], member
                reach[rows] = np.sqrt(best[rows].astype(float))
                if node.sides:
                    far = np.sqrt(found[:, 0].astype(float))
                    for side, least, most in node.sides:
                        bounds[rows, side] = np.maximum(above, np.maximum(far - most, least - far) - SLACK * (far + most))
        return number, best, compared


def whole(values: np.ndarray) -> np.ndarray:
    """Quantised components."""
    scaled = np.floor(values.astype(float) * SCALE)
    if scaled.size and np.abs(scaled).max() > WIDE:
        raise ValueError(f"a component is beyond 2^62 after quantising: {np.abs(values).max()}")
    return scaled.astype(np.int64)


def kept(vectors: DataFrame, key: str, vector: str, width: int) -> DataFrame:
    fine = (F.size("v") == width) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select(F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("v")).where(F.col("v").isNotNull() & fine)


def rows_of(batches: Iterable[pa.RecordBatch], width: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    for batch in sliced(batches, ROWS):
        yield batch.column("k"), whole(batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width))


def first_centroids(rows: DataFrame, k: int, seed: int) -> np.ndarray:
    """Vectors with the smallest hashes of ``seed:key``, in their order: k rows."""
    tag = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("k").cast("string"), F.lit(""))), 256)
    found = rows.select(tag.alias("tag"), "v").orderBy("tag", "v").limit(k).collect()
    return whole(np.array([r["v"] for r in found], float)) if found else np.empty((0, 0), np.int64)


def summed(rows: DataFrame, tree: VantageTree, width: int) -> tuple[list[int], list[list[int]], list[int]]:
    """For each centroid how many vectors are nearest to it, their sums by component, and the sum of their distances."""
    spark, k = rows.sparkSession, len(tree.centroids)
    told = spark.sparkContext.broadcast(tree)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = told.value
        count, total = np.zeros(k, np.int64), np.zeros((k, width + 1), object)  # the last column adds distances up
        for _, v in rows_of(batches, width):
            number, distance, _ = tree.nearest(v)
            count += np.bincount(number, minlength=k)
            for c in np.unique(number):
                mine = v[number == c]
                wide = mine.astype(object) if len(mine) and int(abs(mine).max()) > NARROW else mine
                total[c, :width] += wide.sum(axis=0).astype(object)
                total[c, width] += sum(distance[number == c].tolist())
        used = np.flatnonzero(count)
        sums = pa.array([[Decimal(int(x)) for x in total[c]] for c in used], pa.list_(pa.decimal128(38, 0)))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(count[used], pa.int64()), sums], names=["cluster", "n", "sums"])

    parts = rows.mapInArrow(run, "cluster int, n long, sums array<decimal(38,0)>")
    cells = parts.select("cluster", "n", F.posexplode("sums").alias("at", "x")).groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    count, total = [0] * k, [[0] * (width + 1) for _ in range(k)]
    for r in cells.collect():  # k rows for each component
        count[r["cluster"]], total[r["cluster"]][r["at"]] = r["n"], int(r["x"])
    told.destroy()
    return count, [t[:width] for t in total], [t[width] for t in total]


def moved(centroids: np.ndarray, count: list[int], sums: list[list[int]]) -> np.ndarray:
    """Floors of means; empty centroids stay."""
    return np.array([[x // n for x in total] if n else old.tolist() for old, n, total in zip(centroids, count, sums, strict=True)], np.int64)


def fit(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, width: int = WIDTH, seed: int = SEED, key: str = "vec_id", vector: str = "embedding") -> np.ndarray:
    """The centroids after ``rounds``."""
    rows = kept(vectors, key, vector, width)
    centroids = first_centroids(rows, k, seed)
    for _ in range(rounds if len(centroids) else 0):
        count, sums, _ = summed(rows, VantageTree(centroids), width)
        centroids = moved(centroids, count, sums)
    return centroids


def assign(vectors: DataFrame, centroids: np.ndarray, width: int = WIDTH, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector that takes part."""
    names = f"{key} {column_type(vectors, key)}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    rows, spark = kept(vectors, key, vector, width), vectors.sparkSession
    if not len(centroids):
        return spark.createDataFrame([], names)
    tree = VantageTree(centroids)
    _, _, inertia = summed(rows, tree, width)
    fits = lambda x: x if x <= LONG else None
    each = pa.array([fits(x) for x in inertia], pa.int64())
    shas = pa.array([hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()])
    everything = fits(sum(inertia))
    told = spark.sparkContext.broadcast(tree)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, v in rows_of(batches, width):
            number, distance, _ = told.value.nearest(v)
            number = pa.array(number, pa.int32())
            distance = pa.array([fits(d) for d in distance.tolist()], pa.int64())
            yield pa.RecordBatch.from_arrays([ids, number, distance, each.take(number), pa.array([everything] * len(ids), pa.int64()), shas.take(number)], names=[key, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"])

    return rows.mapInArrow(run, names)


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, width: int = WIDTH, seed: int = SEED, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    return assign(vectors, fit(vectors, k, rounds, width, seed, key, vector), width, key, vector)
