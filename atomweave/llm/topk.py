"""Exact top-k search by inner product with an impact-ordered index, processed score at a time.

Vectors become whole numbers, ``floor(1024 x)``. Candidates are dealt by hash into blocks, each with its own index: for
every dimension and sign, the candidates in segments of equal quantised impact, where impact is how far a component lies
from the end of its range that is worst for a query of that sign. For a query, segments of all dimensions are processed
by descending weight times impact, in rounds, adding the sure part to accumulators. After some rounds the candidates that are ahead are scored exactly; the
k-th best of these is a floor that the results reach. What a candidate can still gain is bounded by the next level of each list in which it
wasn't met yet; processing stops once that proves that few candidates can reach the floor, or when all is processed. All candidates that can reach
it are then scored exactly, so that neither quantising nor stopping changes a result.

Query blocks meet candidate blocks in a keyed shuffle; each pair of blocks is one group of bounded size and returns at
most k rows for each query, of which the best k are kept. Blocks have a fixed size, so their number grows with the table.

Sums of a block whose components are small enough for any bound to stay below 2^53 are taken in 64 bits, where they are exact. A pair of
blocks with larger components is scored whole in integers of any length. A component beyond 2^62 after quantising is an error; a score that
doesn't fit in a long is null, but ranked by its exact value.

Edge cases: vectors that are null, or hold null or components that aren't finite, take no part; shorter vectors count as
padded by noughts; a query's own row, that is every row with its vec_id, isn't a candidate; fewer candidates than k give
fewer rows; ties go to the smaller vec_id; rows that repeat are candidates each; queries that repeat count once, the first of an id by its vector. Blocks go by hash of id and vector, and where one id has
many rows, equal rows are put together before and counted, so that no block grows with them.
"""

from __future__ import annotations

import heapq
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import column_type

K, SCALE, QUERY_EVERY = 10, 1024, 100
#: Candidates and queries of a block, and levels of quantised impact. Each block of queries needs a copy of all candidates.
CANDIDATE_BLOCK, QUERY_BLOCK, LEVELS = 8_192, 8_192, 128
#: Rounds in which all segments are processed, the first after which a stop is tried, and the share of candidates that may be left for exact scores.
ROUNDS, TRY_FROM, LEFT = 8, 3, 0.4
#: Quantised components at most; sums that doubles hold exactly; what fits in a long.
WIDE, EXACT, LONG = 2**62, 2**53, 2**63 - 1


class ImpactIndex:
    """Segments of one block of candidates."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors.astype(np.int64)
        self.low, self.high = self.vectors.min(axis=0), self.vectors.max(axis=0)
        self.step = np.maximum(1, -(-(self.high - self.low + 1) // LEVELS))
        #: For each sign and dimension: members by descending level and the level of each; where each level starts, and the levels present.
        self.lists: list[list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]] = []
        for impact in (self.vectors - self.low, self.high - self.vectors):
            level = impact // self.step
            of_sign = []
            for k in range(vectors.shape[1]):
                members = np.argsort(-level[:, k], kind="stable")
                found, starts = np.unique(-level[members, k], return_index=True)
                of_sign.append((members, level[members, k], np.r_[starts, len(ids)], -found))
            self.lists.append(of_sign)

    def search(self, query: np.ndarray, own: int, k_best: int = K) -> tuple[np.ndarray, np.ndarray]:
        """Ids and exact scores of the k best, own id left out."""
        n, allowed = len(self.ids), self.ids != own
        if not allowed.any():
            return np.empty(0, np.int64), np.empty(0, np.int64)
        used = np.flatnonzero(query)
        weight = np.abs(query)[used]
        lists = [self.lists[int(query[d] < 0)][d] for d in used]
        unit = weight * self.step[used]
        # segments by descending upper end of what a member gains there
        dim = np.repeat(np.arange(len(used)), [len(x[3]) for x in lists])
        gain = np.concatenate([u * (x[3] + 1) for u, x in zip(unit, lists, strict=True)]) if len(used) else np.empty(0, np.int64)
        dim = dim[np.argsort(-gain, kind="stable")]
        # what is sure so far, and the place up to which each list is done; levels of one list are done in order
        sure, done, floor, possible = np.zeros(n, np.int64), np.zeros(len(used), int), None, np.flatnonzero(allowed)
        for turn in range(1, ROUNDS + 1):
            levels = np.bincount(dim[: -(-len(dim) * turn // ROUNDS)], minlength=len(used))
            ends = [int(x[2][c]) for x, c in zip(lists, levels, strict=True)]
            for x, u, start, end in zip(lists, unit, done, ends, strict=True):
                if end > start:
                    sure[x[0][start:end]] += u * x[1][start:end]
            done = np.array(ends)
            if turn < TRY_FROM or n <= 4 * k_best:
                continue
            if floor is None:
                floor = self.floor(query, sure, allowed, k_best)
            # a member of a list that is done gains less than a step more; any other what the next level gives at most
            ahead = np.array([u * (x[3][c] + 1) if c < len(x[3]) else u for u, x, c in zip(unit, lists, levels, strict=True)])
            most = sure + int(ahead.sum())
            for x, u, a, end in zip(lists, unit, ahead, ends, strict=True):
                if a != u:
                    most[x[0][:end]] -= a - u
            possible = np.flatnonzero(allowed & (most >= floor))
            if len(possible) <= LEFT * n:
                break
        score = self.vectors[possible] @ query
        best = np.lexsort((self.ids[possible], -score))[:k_best]
        return self.ids[possible[best]], score[best]

    def floor(self, query: np.ndarray, sure: np.ndarray, allowed: np.ndarray, k_best: int) -> int:
        """The k-th best exact score among candidates that are ahead: a score that the k best of all reach."""
        ahead = np.argpartition(np.where(allowed, sure, -1), len(sure) - 8 * k_best if len(sure) > 8 * k_best else 0)[-8 * k_best :]
        score = np.sort(self.vectors[ahead[allowed[ahead]]] @ query)[::-1]
        return int(score[k_best - 1]) - int(self.base(query)) if len(score) >= k_best else -1

    def base(self, query: np.ndarray) -> np.int64:
        """The score of a candidate that is worst in every dimension, from which gains count."""
        return np.where(query < 0, self.high, self.low) @ query


def usable(vectors: DataFrame, vector: str) -> DataFrame:
    fine = F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    too_wide = F.raise_error(F.lit("a component is beyond 2^62 after quantising")).cast("long")
    scaled = lambda x: x.cast("double") * SCALE
    return vectors.where(fine).withColumn(vector, F.transform(vector, lambda x: F.when(F.abs(scaled(x)) > float(WIDE), too_wide).otherwise(F.floor(scaled(x)))))


def stacked(values: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(values), width), np.int64)
    for row, v in zip(out, values, strict=True):
        row[: len(v)] = v
    return out


def narrow(queries: np.ndarray, candidates: np.ndarray) -> bool:
    """Whether every sum over a query's weights times ranges and steps of the candidates stays exact in doubles."""
    largest = [max((int(x.max(initial=0)), -int(x.min(initial=0)))) + 1 for x in (queries, candidates)]
    return 8 * largest[0] * largest[1] * max(1, queries.shape[1]) < EXACT


def all_scores(query: list[int], ids: np.ndarray, vectors: list[list[int]], own: int, k: int) -> list[tuple[int, int]]:
    """(id, score) of the k best, in integers of any length."""
    scored = ((-sum(a * b for a, b in zip(query, v, strict=True)), i) for i, v in zip(ids.tolist(), vectors, strict=True) if i != own)
    return [(i, -s) for s, i in heapq.nsmallest(k, scored)]


def search(vectors: DataFrame, k: int = K, key: str = "vec_id", vector: str = "embedding", every: int = QUERY_EVERY) -> DataFrame:
    """(query_id, rank, key, score) for the rows whose id is divisible by ``every``, against all other rows."""
    named = vectors.select(key, vector).where(F.col(key).isNotNull())
    rows = usable(named, vector)
    asked = F.col(key) % every == 0
    n, n_asked, most = rows.count(), named.where(asked).select(key).distinct().count(), named.groupBy(key).count().agg(F.max("count")).first()[0] or 0
    times = F.lit(1)
    if most > CANDIDATE_BLOCK // 8:
        rows, times = rows.groupBy(key, vector).agg(F.least(F.count("*"), F.lit(k)).cast("int").alias("times")), F.col("times")  # more than k of a row are never seen
    n_candidates, n_queries = max(1, -(-n // CANDIDATE_BLOCK)), max(1, -(-n_asked // QUERY_BLOCK))
    block = lambda count, *of: F.pmod(F.xxhash64(*of), F.lit(count)).cast("int")
    queries = rows.where(asked).groupBy(key).agg(F.min(vector).alias(vector)).withColumn("qb", block(n_queries, key)).withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(n_candidates - 1))))
    candidates = rows.select(key, vector, times.alias("times"), block(n_candidates, key, vector).alias("cb")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(n_queries - 1))))

    def pair(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        names = ["query_id", key, "score", "exact"]
        if not len(left) or not len(right):
            return pd.DataFrame({name: np.empty(0, np.int64) for name in names})
        width = max(left[vector].map(len).max(), right[vector].map(len).max())
        right = right.loc[right.index.repeat(right["times"])]
        asked, there, ids = stacked(left[vector], width), stacked(right[vector], width), right[key].to_numpy(np.int64)
        out = []
        if narrow(asked, there):
            index = ImpactIndex(ids, there)
            for query_id, query in zip(left[key].to_numpy(np.int64), asked, strict=True):
                found, scores = index.search(query, query_id, k)
                out.append(pd.DataFrame({"query_id": query_id, key: found, "score": scores}))
            return pd.concat(out).assign(exact=None)[names]
        whole = there.tolist()
        for query_id, query in zip(left[key].tolist(), asked.tolist(), strict=True):
            out += [(query_id, i, s) for i, s in all_scores(query, ids, whole, query_id, k)]
        fits = pd.array([s if -LONG - 1 <= s <= LONG else None for _, _, s in out], "Int64")
        return pd.DataFrame({"query_id": pd.array([x[0] for x in out], "int64"), key: pd.array([x[1] for x in out], "int64"), "score": fits, "exact": [Decimal(x[2]) for x in out]})

    anew = lambda df: df.select(*[F.col(c).alias(c) for c in df.columns])  # noqa: E731  both sides come from one table
    found = anew(queries).groupBy("qb", "cb").cogroup(anew(candidates).groupBy("qb", "cb")).applyInPandas(pair, f"query_id long, {key} {column_type(vectors, key)}, score long, exact decimal(38,0)")
    by_score = F.coalesce("exact", F.col("score").cast("decimal(38,0)"))
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(by_score.desc(), key)))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", key, "score")
