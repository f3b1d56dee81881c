"""Scored retrieval: keyword, vector and hybrid scores, best rows for each query, the broadening ladder, and clusters.

Filters are predicates on columns and act before any score. Documents and queries meet in groups of bounded size, which
score each other as matrices and hand on the best rows of each query alone; the best of all are ranked windows, which
Spark limits on the map side first."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import KEYWORD_WEIGHT, VECTOR_WEIGHT
from ..session import checkpointed
from .terms import document_counts, weighted

#: Scores are rounded so that ties, and their order by id, don't hang on the last bits of a sum.
DIGITS = 6
#: Documents and queries of a group, at most about: their scores take about 33 MB. Documents are copied once for each block of queries.
PART_ROWS, BLOCK_ROWS = 4_096, 1_024


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def clipped(score: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def best(scored: DataFrame, keys: list[str], k: int, score: str = "score", tie: str = "doc_id") -> DataFrame:
    """The k best of each group of keys, with their rank; null scores come last, ties by id."""
    order = Window.partitionBy(*keys).orderBy(F.col(score).desc_nulls_last(), tie)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def with_terms(docs: DataFrame, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``docs`` (doc_id, …) and ``queries`` (query_id, …) with (terms, weights, norm) by TF-IDF over (doc_id, body) and
    (query_id, query).

    Norms need all words of a document; of the words themselves only those that some query has are gathered. Documents are counted row by row."""
    n = docs.agg(F.count("*").cast("double").alias("n"))
    asked = queries.select("query_id", F.explode(words(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("tf"))
    idf = document_counts(docs).join(F.broadcast(n)).select("term", "df", (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1).alias("idf"))  # n is one row
    idf = checkpointed(idf.join(asked.select("term").distinct().withColumn("asked", F.lit(True)), "term", "left"))
    of = asked.join(idf.where("asked"), "term").withColumn("w", F.col("tf") * F.col("idf")).groupBy("query_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), F.collect_list(F.struct("term", "w")).alias("t"))
    of = of.select("query_id", F.col("t.term").alias("terms"), F.col("t.w").alias("weights"), "norm")
    return weighted(docs, idf, asked_alone=True), queries.drop("query").join(of, "query_id", "left")


def stacked(vectors: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of length one as rows, noughts where there is none or it has no length, and which there are."""
    known = vectors.notna().to_numpy()
    width = max((len(v) for v in vectors[known]), default=0)
    out = np.zeros((len(vectors), width))
    for row, v in zip(out, vectors, strict=True):
        if v is not None:
            row[: len(v)] = v
    norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return np.divide(out, norm, out=np.zeros_like(out), where=norm > 0), known


def cosines(docs: pd.DataFrame, asked: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Scores of vectors, a row for each query, and which pairs have both."""
    (d, has_d), (q, has_q) = stacked(docs["embedding"]), stacked(asked["query_vector"])
    width = min(d.shape[1], q.shape[1])
    return np.round(np.clip(q[:, :width] @ d[:, :width].T, 0, 1), DIGITS), has_q[:, None] & has_d


def overlaps(docs: pd.DataFrame, asked: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Scores of words, a row for each query, and which pairs share a word."""
    number: dict[str, int] = {}
    for terms in asked["terms"]:
        for term in terms if terms is not None else ():
            number.setdefault(term, len(number))
    q = np.zeros((len(asked), len(number)))
    for row, terms, weights, norm in zip(q, asked["terms"], asked["weights"], asked["norm"], strict=True):
        if terms is not None and len(terms):
            row[[number[t] for t in terms]] = np.asarray(weights, float) / norm
    score, shared = np.zeros((len(asked), len(docs))), np.zeros((len(asked), len(docs)), bool)
    for k, (terms, weights, norm) in enumerate(zip(docs["terms"], docs["weights"], docs["norm"], strict=True)):
        at = [(number[t], w) for t, w in zip(terms, weights, strict=True) if t in number] if terms is not None else []
        if at:
            some = q[:, [a for a, _ in at]]
            score[:, k] = some @ (np.array([w for _, w in at]) / norm)
            shared[:, k] = (some > 0).any(axis=1)
    return np.round(np.clip(score, 0, 1), DIGITS), shared


def hybrid(vector: np.ndarray, keyword: np.ndarray) -> np.ndarray:
    # parts of six digits by weights of one give seven
    return np.round(VECTOR_WEIGHT * vector + KEYWORD_WEIGHT * keyword, DIGITS + 1)


def scores(docs: DataFrame, queries: DataFrame, k: int, kind: str, keys: tuple[str, ...] = (), within: tuple[str, ...] = (), own: bool = True, counted: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(query_id, doc_id, within, score): the best ``k`` of each query among documents of each group of ``within``, or a few
    more; ``kind`` is vector (embedding and query_vector), keyword (terms, weights, norm) or hybrid (both).

    Only rows that are equal in ``keys`` meet, and unless ``own`` not those of one id. Rows of a key are cut in parts, and its
    queries in blocks, by their number, so that each part and block meet in a group of bounded size; a group hands on its
    best rows alone. Documents without a shared word or a vector on both sides are no candidates; a hybrid score takes
    what is missing as 0. ``counted`` are cheaper tables with the rows of both sides, to be counted in their stead."""
    counted = counted or (docs, queries)
    d_type, q_type = docs.schema["doc_id"].dataType.simpleString(), queries.schema["query_id"].dataType.simpleString()
    per_key = lambda df, name, most: df.groupBy(*keys).agg(F.ceil(F.count("*") / most).cast("long").alias(name))
    numbers = per_key(counted[0], "parts", PART_ROWS)
    blocks = per_key(counted[1], "blocks", BLOCK_ROWS)
    numbers = numbers.join(blocks, list(keys)) if keys else numbers.join(F.broadcast(blocks))  # without keys, one row each
    dealt = lambda df: df.join(numbers, list(keys)) if keys else df.join(F.broadcast(numbers))
    spread = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = dealt(docs).where("blocks > 0").withColumn("part", F.pmod(F.xxhash64("doc_id"), "parts")).withColumn("block", spread("blocks")).drop("parts", "blocks")
    right = dealt(queries).where("parts > 0").withColumn("block", F.pmod(F.xxhash64("query_id"), "blocks")).withColumn("part", spread("parts")).drop("parts", "blocks")
    group = [*keys, "part", "block"]

    def meet(some: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        names = ["query_id", "doc_id", *within, "score"]
        if not len(some) or not len(asked):
            return pd.DataFrame({n: [] for n in names})
        some = some.sort_values("doc_id").reset_index(drop=True)
        if kind == "vector":
            score, there = cosines(some, asked)
        elif kind == "keyword":
            score, there = overlaps(some, asked)
        else:
            (v, has_v), (w, has_w) = cosines(some, asked), overlaps(some, asked)
            score, there = hybrid(v * has_v, w * has_w), has_v | has_w
        ids = some["doc_id"].to_numpy()
        slots = some.groupby(list(within), dropna=False).indices.values() if within else [np.arange(len(some))]
        out = []
        for row, query_id in enumerate(asked["query_id"]):
            good = there[row] if own else there[row] & (ids.astype(str) != str(query_id))
            for members in slots:
                at = members[good[members]]
                at = at[np.argsort(-score[row, at], kind="stable")[:k]]  # ids are in order, so ties go by id
                out.append(some.loc[at, ["doc_id", *within]].assign(query_id=query_id, score=score[row, at]))
        return pd.concat(out)[names]

    kinds = ", ".join([f"query_id {q_type}", f"doc_id {d_type}", *(f"{c} {docs.schema[c].dataType.simpleString()}" for c in within), "score double"])
    # both sides may come from one table: columns get identities of their own
    anew = lambda df: df.select(*[F.col(c).alias(c) for c in df.columns])
    return anew(left).groupBy(*group).cogroup(anew(right).groupBy(*group)).applyInPandas(meet, kinds)


def with_patterns(docs: DataFrame, asked: DataFrame, always: tuple[str, ...], optional: tuple[str, ...]) -> tuple[DataFrame, DataFrame, tuple[str, ...]]:
    """(docs, queries, keys) for scores among documents that equal a query in ``always`` and in those of ``optional`` that the query has set (not null, not blank).

    What a query has set is its pattern; a document stands under each pattern that occurs among the queries, at most two to the power of ``optional``, with
    the other fields blank. So rows meet by equality of keys, and no pair of rows is looked at for nothing."""
    value = lambda c: F.coalesce(F.trim(F.col(c).cast("string")), F.lit(""))
    pattern = F.concat(*[F.when(value(c) != "", "1").otherwise("0") for c in optional])
    found = sorted(r[0] for r in asked.select(pattern).distinct().collect())
    keys = (*always, "pattern", *[f"key_{c}" for c in optional])
    mine = asked.withColumn("pattern", pattern).select("*", *[value(c).alias(f"key_{c}") for c in optional])
    each = docs.withColumn("pattern", F.explode(F.array(*map(F.lit, found)))) if found else docs.where("false").withColumn("pattern", F.lit(""))
    theirs = each.select("*", *[F.when(F.substring("pattern", k + 1, 1) == "1", value(c)).otherwise("").alias(f"key_{c}") for k, c in enumerate(optional)])
    return theirs, mine, keys


def search(scored: DataFrame, limit: int, threshold: float | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """The best of every slot, then the best of all: (keys, rank, slot, doc_id, score, total), for each query that ``keys`` name;
    total counts before the last cut."""
    if threshold is not None and 0 <= threshold <= 1:
        scored = scored.where(F.col("score") >= threshold)
    found = best(scored, [*keys, "slot"], limit).drop("rank")
    ranked = best(found.withColumn("total", F.count("*").over(Window.partitionBy(*keys))), [*keys], limit)
    # at most limit rows of each slot reach the last rank
    return ranked.select(*keys, "rank", "slot", "doc_id", "score", "total")


LADDER = ("error_pattern", "language", "task_type")


def rungs(filters: dict[str, str]) -> list[dict[str, str]]:
    """Filter sets from narrow to broad: each drops one more of LADDER; a rung equal to the one before goes."""
    out = [dict(filters)]
    for name in LADDER:
        wider = {k: v for k, v in out[-1].items() if k != name}
        if wider != out[-1]:
            out.append(wider)
    return out


def ladder(scored: DataFrame, filters: dict[str, str], limit: int, threshold: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, rung, doc_id, score): for each query that ``keys`` name, broader filters are tried until enough is found, in one pass.

    Each row enters the rungs that it matches, four at most; every rung gives its best ``limit``; a document counts at its
    first rung; the first rung at which min(3, limit) documents of a query are found is its last."""
    steps = rungs(filters)
    match = lambda f: reduce(lambda a, b: a & b, [F.col(k) == v for k, v in f.items()], F.lit(True))
    entered = F.filter(F.array(*[F.when(match(f), F.lit(r)) for r, f in enumerate(steps)]), lambda r: r.isNotNull())
    hits = scored.where(match(steps[-1]) & (F.col("score") >= threshold)).withColumn("rung", F.explode(entered))
    hits = best(hits, [*keys, "rung"], limit).groupBy(*keys, "doc_id").agg(F.min("rung").alias("rung"), F.first("score").alias("score"))
    # four rungs of limit rows at most are left of each query
    so_far = F.count("*").over(Window.partitionBy(*keys).orderBy("rung"))
    last = F.min(F.when(F.col("found") >= min(3, limit), F.col("rung"))).over(Window.partitionBy(*keys))
    kept = hits.withColumn("found", so_far).withColumn("last", F.coalesce(last, F.lit(len(steps)))).where("rung <= last")
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("rung", F.desc("score"), "doc_id"))
    return kept.withColumn("place", place).where(F.col("place") <= limit).orderBy(*keys, "place").select(*keys, "rung", "doc_id", "score")


def rung_counts(found: DataFrame, filters: dict[str, str]) -> DataFrame:
    """(rung, filters, hits): how many hits each rung of a ladder added, with the names it filtered by."""
    steps = found.sparkSession.createDataFrame([(r, ",".join(sorted(f))) for r, f in enumerate(rungs(filters))], "rung int, filters string")
    return F.broadcast(steps).join(found.groupBy("rung").agg(F.count("*").alias("hits")), "rung", "left").select("rung", "filters", F.coalesce("hits", F.lit(0)).alias("hits"))  # four rows at most


def cross_references(scored: DataFrame, types: tuple[str, ...], module: str, threshold: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """For each query that ``keys`` name, the best document of each type in one module."""
    met = scored.where(F.col("atom_type").isin(*types) & (F.col("project_module") == module) & (F.col("score") >= threshold))
    return best(met, [*keys, "atom_type"], 1).select(*keys, "atom_type", "doc_id", "score")


#: Rows of a list that meet in one group, at most about; longer lists are dealt out in pairs of blocks.
LIST = 500


def meetings(rows: DataFrame, keys: list[str], id_: str, count: str, kept: list[str], good: Column | None = None) -> DataFrame:
    """Pairs of ``rows`` that are equal in ``keys``, each once with the smaller id first, as columns ``a_…`` and ``b_…``.

    ``count`` bounds the rows of a key. A long list is cut in blocks by hash, and each pair of its blocks is a group of its
    own, so that a hot key is spread over many tasks."""
    blocks = F.ceil(F.col(count) / LIST).cast("int")
    dealt = rows.withColumn("own", F.pmod(F.xxhash64(id_), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = dealt.select(*keys, F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", id_, *kept)
    side = lambda x: dealt.select(*keys, "lo", "hi", *[F.col(c).alias(f"{x}_{c}") for c in ("own", id_, *kept)])
    once = (F.col(f"a_{id_}") < F.col(f"b_{id_}")) & ((F.col("lo") == F.col("hi")) | (F.col("a_own") != F.col("b_own")))
    met = side("a").join(side("b"), [*keys, "lo", "hi"]).where(once if good is None else once & good)
    return met.drop("lo", "hi", "a_own", "b_own")


#: Frequency is estimated from one in so many classes; a word seen HOT_COUNT times there comes late in the order. At most
#: HOT_WORDS of these are told to the tasks, which bounds a broadcast and changes the cost alone.
SAMPLE, HOT_COUNT, HOT_WORDS = 16, 2, 200_000


def word_sets(leaves: DataFrame) -> DataFrame:
    """(slot, doc_id, created_at_ms, set, tokens): the words of each body as a checksum of them all and as sorted hashes. Texts
    without words have none. What has sets already is left as it is, so that they can be stored and read by all that needs them."""
    if "set" in leaves.columns:
        return leaves
    sets = leaves.select("slot", "doc_id", "created_at_ms", F.sort_array(F.array_distinct(words(F.col("body")))).alias("words")).where(F.size("words") > 0)
    return sets.select("slot", "doc_id", "created_at_ms", F.md5(F.array_join("words", " ")).alias("set"), F.transform("words", lambda w: F.xxhash64(w)).alias("tokens"))


def representatives(leaves: DataFrame) -> DataFrame:
    """(slot, set, rep, members, tokens) of classes of documents of one slot with equal sets of words. The newest of a class,
    then the smallest id, stands for it. Copies are put together before the shuffle."""
    first = F.min(F.struct((-F.col("created_at_ms")).alias("age"), "doc_id"))
    found = word_sets(leaves).groupBy("slot", "set").agg(first.alias("first"), F.count("*").alias("members"), F.first("tokens").alias("tokens"))
    return found.select("slot", "set", F.col("first.doc_id").alias("rep"), "members", "tokens")


def classed(leaves: DataFrame, reps: DataFrame) -> DataFrame:
    """(slot, doc_id, created_at_ms, rep, members): documents with their class; those without words are in none."""
    return word_sets(leaves).drop("tokens").join(reps.select("slot", "set", "rep", "members"), ["slot", "set"]).drop("set")


def frequent_words(reps: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Words, as sorted hashes, that are frequent in a sample of sets, and how often they were seen."""
    some = reps.where(F.pmod(F.xxhash64("rep"), F.lit(SAMPLE)) == 0).select(F.explode("tokens").alias("token"))
    top = some.groupBy("token").count().where(F.col("count") >= HOT_COUNT).orderBy(F.desc("count"), "token").limit(HOT_WORDS).toArrow()
    token, count = top.column("token").to_numpy(), top.column("count").to_numpy()
    order = np.argsort(token)
    return token[order], count[order]


#: Entries of a group of lists, at most about; those of one list that meet in one task; pairs that a task holds before it hands them on.
GROUP_ENTRIES, LONG_LIST, HELD_PAIRS = 250_000, 20_000, 400_000
#: A set's signature: for each of so many times 64 classes of hashes, at most, whether the set has an odd number of them.
SIGNATURE = 8
#: Entries of words' lists, and of lists that are cut in blocks; their signatures stand beside them, one after the other.
WORD = {"token": np.int64, "label": np.int64, "n": np.int32, "at": np.int32}
ENTRY = {"list": np.int64, "label": np.int64, "n": np.int32, "at": np.int32, "own": np.int32}
Entries = tuple[dict[str, np.ndarray], np.ndarray]  # columns, and the words of signatures, which are counted without a sign


def mixed(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def signature(tokens: np.ndarray, words: int = SIGNATURE) -> np.ndarray:
    """A signature of so many 64-bit words. Sets that differ in d words differ in at most d places, whatever its width is; halves of a signature, one
    laid on the other by exclusive or, are the signature of half its width."""
    odd = np.bincount((mixed(tokens) % np.uint64(64 * words)).astype(np.int64), minlength=64 * words) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64)


def widths(n: np.ndarray, least: float) -> np.ndarray:
    """Words of signatures of sets of n words: four places for each word in which one of like size may differ, as a power of two up to SIGNATURE."""
    wanted = np.maximum(np.asarray(n) * (8 * (1 - least) / (1 + least) / 64), 1)
    return np.minimum(2 ** np.ceil(np.log2(wanted)).astype(np.int64), SIGNATURE)


def seen_of(tokens: np.ndarray, hot: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """How often the sample has each word."""
    known, counts = hot
    if not len(known):
        return np.zeros(len(tokens), np.int64)
    at = np.minimum(np.searchsorted(known, tokens), len(known) - 1)
    return np.where(known[at] == tokens, counts[at], 0)


def prefixed(batches: Iterable[pa.RecordBatch], least: float, hot: tuple[np.ndarray, np.ndarray]) -> Iterator[tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]]:
    """Entries (WORD), their signatures and their slots, in pieces of about GROUP_ENTRIES, of sets (label, slot_hash, tokens): the first
    ``n - ceil(least n) + 1`` words of each, rare ones by hash, then by frequency."""
    held, size = [], 0

    def piece() -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
        kept, label, n, slot, bits = zip(*held, strict=True)
        times = np.array([len(k) for k in kept])
        of = lambda x, kind: np.repeat(np.array(x, kind), times)
        at = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        columns = {"token": np.concatenate(kept), "label": of(label, np.int64), "n": of(n, np.int32), "at": at.astype(np.int32)}
        return columns, np.concatenate([np.tile(b, k) for b, k in zip(bits, times, strict=True)]), of(slot, np.int64)

    for batch in batches:
        for label, slot, value in zip(batch.column("label").to_pylist(), batch.column("slot_hash").to_pylist(), batch.column("tokens"), strict=True):
            s = value.values.to_numpy()
            kept = s[np.lexsort((s, seen_of(s, hot)))][: len(s) - int(np.ceil(len(s) * least)) + 1]
            held.append((kept, label, len(s), slot, signature(s, int(widths(len(s), least)))))
            size += len(kept)
            if size > GROUP_ENTRIES:
                yield piece()
                held, size = [], 0
    if held:
        yield piece()


def cut(columns: dict[str, np.ndarray], slot: np.ndarray, hot: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Entries (ENTRY) of entries (WORD), and of which each is. A list that is long by the sample is cut in blocks by label, of which each pair
    makes a list of its own; ``own`` is an entry's block there, -1 where both are one."""
    blocks = seen_of(columns["token"], hot) * SAMPLE // LONG_LIST + 1
    of = np.repeat(np.arange(len(blocks)), blocks)
    other = np.arange(len(of)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    own = (mixed(columns["label"]) >> np.uint64(8)).astype(np.int64)[of] % blocks[of]
    place = np.minimum(own, other) * 1_000_003 + np.maximum(own, other)
    key = mixed(mixed(columns["token"] ^ slot)[of] + place.astype(np.uint64)).view(np.int64)
    return of, {"list": key, **{name: columns[name][of] for name in ("label", "n", "at")}, "own": np.where(own == other, -1, own).astype(np.int32)}


def rows_of(bits: np.ndarray, wide: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Words of signatures of the widths ``wide``, of the rows ``order`` in this order."""
    w = wide[order]
    return bits[np.repeat((np.cumsum(wide) - wide)[order] - (np.cumsum(w) - w), w) + np.arange(w.sum())]


def cells(columns: dict[str, np.ndarray], bits: np.ndarray, part: np.ndarray, least: float) -> tuple[np.ndarray, dict[str, list[bytes]]]:
    """Parts that there are, and the bytes of each column and of the signatures for each of them."""
    order = np.argsort(part, kind="stable")
    present, starts = np.unique(part[order], return_index=True)
    ends = [*starts[1:], len(order)]
    wide = widths(columns["n"], least)
    edge, words = np.r_[0, np.cumsum(wide[order])], rows_of(bits, wide, order)
    out = {name: [c[order[x:y]].tobytes() for x, y in zip(starts, ends, strict=True)] for name, c in columns.items()}
    return present, out | {"signature": [words[edge[x] : edge[y]].tobytes() for x, y in zip(starts, ends, strict=True)]}


def by_group(columns: dict[str, np.ndarray], bits: np.ndarray, slot: np.ndarray, least: float, hot: tuple[np.ndarray, np.ndarray], n_groups: int) -> dict[str, pa.Array]:
    """Columns of a batch (g and ENTRY, signature as bytes) from entries (WORD)."""
    of, lists = cut(columns, slot, hot)
    group = (lists["list"].view(np.uint64) % np.uint64(n_groups)).astype(np.int64)
    present, out = cells(lists, rows_of(bits, widths(columns["n"], least), of), group, least)
    return {"g": pa.array(present, pa.int32()), **{name: pa.array(c, pa.binary()) for name, c in out.items()}}


PACKED = ", ".join(f"{x} binary" for x in (*ENTRY, "signature"))


def entries(reps: DataFrame, least: float, hot: tuple[np.ndarray, np.ndarray], n_groups: int) -> DataFrame:
    """Packed list entries of the prefixes of sets (label, slot_hash, tokens), by group of lists."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns, bits, slot in prefixed(batches, least, hot):
            yield pa.RecordBatch.from_pydict(by_group(columns, bits, slot, least, hot, n_groups))

    return reps.select("label", "slot_hash", "tokens").mapInArrow(run, f"g int, {PACKED}")


def gathered(batches: Iterable[pa.RecordBatch | pa.Table], kinds: dict[str, type]) -> Entries:
    """What the rows of batches hold as bytes."""
    found: dict[str, list[bytes]] = {name: [] for name in (*kinds, "signature")}
    for batch in batches:
        for name, of in found.items():
            of.extend(batch.column(name).to_pylist())
    bits = np.frombuffer(b"".join(found.pop("signature")), np.uint64)
    return {name: np.frombuffer(b"".join(found.pop(name)), kind) for name, kind in kinds.items()}, bits


def once(pairs: np.ndarray) -> np.ndarray:
    pairs = pairs[:, np.lexsort(pairs)]
    return pairs[:, np.r_[True, (pairs[:, 1:] != pairs[:, :-1]).any(axis=0)]]


class Lists:
    """Entries by list and size, with the signatures of each width that they have or that theirs can be laid together to."""

    def __init__(self, entries: Entries, least: float):
        columns, bits = entries
        order = np.lexsort((columns["n"], columns["list"]))
        wide = widths(columns["n"], least)
        bits = rows_of(bits, wide, order)
        self.key, self.label, self.at, self.own = (columns[name][order] for name in ("list", "label", "at", "own"))
        self.n, self.wide = columns["n"][order].astype(np.int64), wide[order]
        self.bits, start, width = {}, np.cumsum(self.wide) - self.wide, SIGNATURE
        wider = np.zeros((0, 2 * width), np.uint64)
        while width:
            rows = np.zeros((len(order), width), np.uint64)
            if len(wider):
                rows |= wider[:, :width] ^ wider[:, width:]
            here = np.flatnonzero(self.wide == width)
            rows[here] = bits[start[here][:, None] + np.arange(width)]
            self.bits[width] = wider = rows
            width //= 2
        self.names, first = np.unique(self.key, return_index=True)
        self.rank = np.searchsorted(first, np.arange(len(order)), side="right") - 1

    def place(self, rank: np.ndarray, n: np.ndarray, side: str) -> np.ndarray:
        """Where sizes stand in lists."""
        return np.searchsorted((self.rank << 32) + self.n, (rank << 32) + n, side=side)


def list_pairs(mine: Entries, theirs: Entries | None, least: float) -> Iterator[np.ndarray]:
    """Pairs of labels (two rows) that meet in a list and whose sizes, what is left behind the word, and signatures allow the score: of ``mine`` with
    each other, or with ``theirs``; in pieces of bounded size, of which several may name one pair."""
    x = Lists(mine, least)
    y = x if theirs is None else Lists(theirs, least)
    if not len(x.n) or not len(y.n):
        return
    if theirs is None:
        rank, begin = x.rank, np.arange(len(x.n)) + 1
    else:
        rank = np.minimum(np.searchsorted(y.names, x.key), len(y.names) - 1)
        begin = y.place(rank, np.ceil(x.n * least - 1e-6).astype(np.int64), "left")
    ahead = np.maximum(y.place(rank, np.floor(x.n / least + 1e-6).astype(np.int64), "right") - begin, 0) * (y.names[rank] == x.key)
    total = np.cumsum(ahead)
    out, held, start = [], 0, 0
    while start < len(x.n):
        before = total[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(total, before + HELD_PAIRS)))
        i = np.repeat(np.arange(start, stop), ahead[start:stop])
        j = begin[i] + np.arange(len(i)) - np.repeat(total[start:stop] - ahead[start:stop] - before, ahead[start:stop])
        start = stop
        both = x.n[i] + y.n[j]
        good = (np.minimum(x.n[i] - x.at[i], y.n[j] - y.at[j]) >= both * (least / (1 + least)) - 1e-6) & ((x.own[i] != y.own[j]) | (x.own[i] < 0))
        i, j, most = i[good], j[good], both[good] * ((1 - least) / (1 + least)) + 1e-6
        width = np.minimum(x.wide[i], y.wide[j])
        for w in np.unique(width):
            some = width == w
            a, b, bound, apart = i[some], j[some], most[some], np.zeros(np.count_nonzero(some), np.int64)
            for k in range(w):
                apart += np.bitwise_count(x.bits[w][a, k] ^ y.bits[w][b, k])
                near = apart <= bound
                a, b, bound, apart = a[near], b[near], bound[near], apart[near]
            if len(a):
                out.append(once(np.stack([np.minimum(x.label[a], y.label[b]), np.maximum(x.label[a], y.label[b])])))
                held += out[-1].shape[1]
        if held > HELD_PAIRS:
            yield once(np.concatenate(out, axis=1))
            out, held = [], 0
    if out:
        yield once(np.concatenate(out, axis=1))


def pair_batches(pairs: Iterable[np.ndarray]) -> Iterator[pa.RecordBatch]:
    for found in pairs:
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in found], names=["x", "y"])


def candidates(reps: DataFrame, least: float, hot: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(slot, a, b), a < b: pairs of ``reps`` (slot, rep, tokens) that may reach ``least``, each once."""
    named = labelled(reps)
    return told(candidates_by_word(named, least, hot), named)


def candidates_by_word(reps: DataFrame, least: float, hot: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(x, y): labels of pairs of sets (label, slot_hash, tokens) that may reach ``least``, each once. Ids stand as 64-bit hashes in
    lists, and a pair is handed on only if its signatures allow it, so that few pairs are shuffled beside those that are like."""
    total = reps.agg(F.sum(F.size("tokens"))).first()[0] or 0
    n_groups = max(16, int(total * (1 - least) / GROUP_ENTRIES) + 1)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from pair_batches(list_pairs(gathered(batches, ENTRY), None, least))

    return entries(reps, least, hot, n_groups).groupBy("g").applyInArrow(meet, "x long, y long").distinct()


def labelled(reps: DataFrame) -> DataFrame:
    return reps.select("slot", "rep", "tokens", F.xxhash64("slot", "rep").alias("label"), F.xxhash64("slot").alias("slot_hash"))


def told(met: DataFrame, named: DataFrame) -> DataFrame:
    """(slot, a, b), a < b: pairs of labels by the ids they stand for."""
    of = lambda x, rep: named.select(F.col("label").alias(x), F.col("rep").alias(rep), F.col("slot").alias(f"slot_{x}"))
    found = met.join(of("x", "one"), "x").join(of("y", "other"), "y").where("slot_x = slot_y and one <> other")
    return found.select(F.col("slot_x").alias("slot"), F.least("one", "other").alias("a"), F.greatest("one", "other").alias("b"))


#: Below this score half of each set and more would stand in lists, long ones too; sets of like sizes are then compared by signature alone.
LISTED_SCORE = 0.7
#: Sets of a part, and 64-bit words of its signatures, at most about; words of one signature at most; rows and columns compared at once.
PART_SETS, PART_WORDS, MOST_WORDS, TILE = 131_072, 4_000_000, 512, (8, 4_096)
#: Few sets are cut in so many parts, so that all cores have work, unless these have fewer sets than a small part.
LEAST_PARTS, SMALL_PART = 8, 4_096
SIDE = {"label": np.int64, "n": np.int32, "own": np.int8, "part": np.int32}


def width(octave: int) -> int:
    """Words of a signature of sets of ``2 ** octave`` words and more: four places for each word, two at the octave's end."""
    return min(MOST_WORDS, max(1, 4 * 2**octave // 64))


def near_pairs(x: tuple[np.ndarray, ...], y: tuple[np.ndarray, ...], least: float) -> Iterator[np.ndarray]:
    """Pairs of labels (two rows) of ``x`` and of no larger sets in ``y``, whose sizes and signatures allow the score. Both are (label, n, bits) by n,
    bits with a row for each word; of equal sizes the smaller label is the smaller set."""
    (x_label, x_n, x_bits), (y_label, y_n, y_bits) = x, y
    rows, columns = TILE
    share = (1 - least) / (1 + least)
    word, ones = np.empty(rows * columns, np.uint64), np.empty(rows * columns, np.uint8)
    for start in range(0, len(x_n), rows):
        n, bits, label = x_n[start : start + rows], x_bits[:, start : start + rows], x_label[start : start + rows]
        low, high = np.searchsorted(y_n, n[0] * least - 1e-6), np.searchsorted(y_n, n[-1], side="right")
        for at in range(int(low), int(high), columns):
            there = slice(at, min(at + columns, int(high)))
            shape = (len(n), there.stop - there.start)
            size = shape[0] * shape[1]
            w, o, apart = word[:size].reshape(shape), ones[:size].reshape(shape), np.zeros(shape, np.uint16)
            for mine, theirs in zip(bits, y_bits[:, there], strict=True):
                np.bitwise_xor(mine[:, None], theirs[None], out=w)
                np.bitwise_count(w, out=o)
                np.add(apart, o, out=apart)
            most = np.minimum((n[-1] + y_n[there].astype(np.int64)) * share + 1e-6, 65_535).astype(np.uint16)
            i, j = np.nonzero(apart <= most)
            other = y_n[at + j]
            smaller = (other < n[i]) | ((other == n[i]) & (y_label[at + j] < label[i]))
            good = smaller & (other >= n[i] * least - 1e-6) & (apart[i, j] <= (n[i] + other.astype(np.int64)) * share + 1e-6)
            if good.any():
                yield np.stack([label[i[good]], y_label[at + j[good]]])


def candidates_by_size(reps: DataFrame, least: float) -> DataFrame:
    """As ``candidates_by_word``, for low scores. Sets of one octave of sizes meet each other and those of octaves below that may be like them (at one half, the next), in parts of
    bounded size of which each pair is a group; their signatures are as wide as the octave asks. Each pair of parts is looked at whole: the work is quadratic, but
    nothing grows with frequent words, and what is shuffled are signatures, once for each part, so parts are large where there are many sets."""
    octave = F.floor(F.log2(F.size("tokens") + 0.5)).cast("int")
    sizes = {(s, o): n for s, o, n in reps.groupBy("slot_hash", octave.alias("o")).count().collect()}  # some twenty for each slot
    below = int(np.floor(np.log2(1 / least) + 1e-4)) + 1
    parts = {}
    for s, o in sizes:
        n = sum(sizes.get((s, o - k), 0) for k in range(below))
        parts[s, o] = max(-(-n // min(PART_SETS, max(1, PART_WORDS // width(o)))), min(LEAST_PARTS, -(-n // SMALL_PART)))
    n_groups = sum(p * (p + 1) // 2 for p in parts.values())

    def pack(held: dict[tuple, list[tuple]]) -> pa.RecordBatch:
        columns = {name: [np.array([r[k] for r in rows], kind).tobytes() for rows in held.values()] for k, (name, kind) in enumerate(SIDE.items())}
        keys = [pa.array([key[k] for key in held], kind) for k, kind in enumerate((pa.int64(), pa.int32(), pa.int32(), pa.int32()))]
        return pa.RecordBatch.from_arrays([*keys, *(pa.array(c, pa.binary()) for c in columns.values()), pa.array([b"".join(r[-1] for r in rows) for rows in held.values()], pa.binary())], names=["s", "o", "i", "j", *SIDE, "bits"])

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list[tuple]] = {}
        size = 0
        for batch in batches:
            for label, slot, value in zip(batch.column("label").to_pylist(), batch.column("slot_hash").to_pylist(), batch.column("tokens"), strict=True):
                tokens = value.values.to_numpy()
                mine = len(tokens).bit_length() - 1
                octaves = [o for o in range(mine, int(len(tokens) / least + 1e-6).bit_length()) if (slot, o) in parts]
                wide = signature(tokens, width(max(octaves)))
                for o in octaves[::-1]:
                    number = parts[slot, o]
                    while len(wide) > width(o):
                        wide = wide[: len(wide) // 2] ^ wide[len(wide) // 2 :]
                    bits = wide.tobytes()
                    part = (int(mixed(np.array([label]))[0]) >> 8) % number
                    for other in range(number):
                        held.setdefault((slot, o, min(part, other), max(part, other)), []).append((label, len(tokens), o == mine, -1 if part == other else part, bits))
                        size += len(bits) + 20
                if size > PART_WORDS:
                    yield pack(held)
                    held, size = {}, 0
        if held:
            yield pack(held)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells: dict[str, list[bytes]] = {name: [] for name in (*SIDE, "bits")}
        for batch in batches:
            for name, found in cells.items():
                found.extend(batch.column(name).to_pylist())
        bits = np.frombuffer(b"".join(cells.pop("bits")), np.uint64)
        label, n, own, part = (np.frombuffer(b"".join(cells.pop(name)), kind) for name, kind in SIDE.items())
        bits, order = bits.reshape(len(label), -1), np.lexsort((label, n))
        side = lambda keep: (label[order][keep], n[order][keep], np.ascontiguousarray(bits[order][keep].T))
        own, part = own[order] > 0, part[order]
        present = np.unique(part)
        meetings = [(own, part == part)] if present[0] < 0 else [(own & (part == a), part == b) for a, b in ((present[0], present[-1]), (present[-1], present[0])) if a != b]
        held, size = [], 0
        for mine, theirs in meetings:
            for found in near_pairs(side(mine), side(theirs), least):
                held.append(found)
                size += found.shape[1]
                if size > HELD_PAIRS:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in np.concatenate(held, axis=1)], names=["x", "y"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in np.concatenate(held, axis=1)], names=["x", "y"])

    keys = ["s", "o", "i", "j"]
    dealt = reps.select("label", "slot_hash", "tokens").mapInArrow(deal, "s long, o int, i int, j int, " + ", ".join(f"{x} binary" for x in (*SIDE, "bits")))
    # groups are small in bytes and long in work: so many partitions as there are groups, within reason
    return dealt.repartition(max(1, min(4 * n_groups, 2_000)), *keys).groupBy(*keys).applyInArrow(meet, "x long, y long")


#: Sets of a group in which pairs are compared, at most about. Labels that are told to all tasks, at most; of more, sets are joined to them.
GROUP_SETS, TOLD_LABELS = 2_048, 1_000_000


def compared(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """(slot, a, b, score), a < b: likeness of at least ``least`` of sets (label, slot, set, tokens) whose labels are a pair (x, y); each pair comes once and should be stored.

    Sets that are like one another stand in one group, by the smallest label that each meets, so that a set goes to few groups and not to each of its
    pairs. Where a label is met by many, its sets are dealt out to several groups. Sets in no pair aren't shuffled."""
    met = pairs.select("x", "y").union(pairs.select("y", "x")).toDF("label", "other").groupBy("label").agg(F.least(F.first("label"), F.min("other")).alias("leader"))
    met = checkpointed(met)
    n = met.count()
    parts = met.groupBy("leader").agg(F.ceil(F.count("*") / GROUP_SETS).alias("parts"))
    group = F.pmod(F.xxhash64("leader", F.pmod(F.xxhash64("label"), "parts")), F.lit(n // GROUP_SETS + 1)).cast("int")
    placed = checkpointed(met.join(parts, "leader").select("label", group.alias("group")))
    told = F.broadcast(placed) if n <= TOLD_LABELS else placed
    here = sets.select("label", "slot", "set", "tokens").join(told, "label")
    wanted = pairs.join(placed.withColumnRenamed("label", "y"), "y").groupBy("x", "group").agg(F.collect_list("y").alias("ys"))
    asking = here.drop("group").join(wanted.withColumnRenamed("x", "label"), "label")

    def meet(xs: pa.Table, ys: pa.Table) -> pa.Table:
        at: dict[int, list[int]] = {}
        for k, label in enumerate(ys.column("label").to_pylist()):
            at.setdefault(label, []).append(k)  # two sets may have one label
        theirs = [np.sort(value.values.to_numpy()) for value in ys.column("tokens")]
        slots, names = ys.column("slot").to_pylist(), ys.column("set").to_pylist()
        out: dict[str, list] = {name: [] for name in ("slot", "set_x", "set_y", "n_x", "n_y", "common")}
        for label, slot, name, value, asked in zip(xs.column("label").to_pylist(), xs.column("slot").to_pylist(), xs.column("set").to_pylist(), xs.column("tokens"), xs.column("ys"), strict=True):
            mine = value.values.to_numpy()
            for y in asked.values.to_numpy().tolist():
                for k in at.get(y, ()):
                    if slots[k] == slot and names[k] != name and (y != label or name < names[k]):
                        near = theirs[k][np.minimum(np.searchsorted(theirs[k], mine), len(theirs[k]) - 1)]
                        row = slot, name, names[k], len(mine), len(theirs[k]), int(np.count_nonzero(near == mine))
                        for of, x in zip(out.values(), row, strict=True):
                            of.append(x)
        kinds = pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()
        return pa.table({c: pa.array(of, kind) for (c, of), kind in zip(out.items(), kinds, strict=True)})

    anew = lambda df: df.select(*[F.col(c).alias(c) for c in df.columns])
    found = anew(asking).groupBy("group").cogroup(anew(here).groupBy("group")).applyInArrow(meet, "slot string, set_x string, set_y string, n_x long, n_y long, common long")
    score = F.round(F.col("common") / (F.col("n_x") + F.col("n_y") - F.col("common")), DIGITS)
    return found.select("slot", F.least("set_x", "set_y").alias("a"), F.greatest("set_x", "set_y").alias("b"), score.alias("score")).where(F.col("score") >= least)


def likeness(reps: DataFrame, least: float) -> DataFrame:
    """(slot, a, b, score) with a < b: Jaccard likeness of the words of whole bodies, for all pairs of class representatives
    of one slot that reach ``least``. Members of a class are as like others as their representative is.

    Candidates come from prefix filtering: with words in one order, rare ones first, two sets that reach the score share
    one of their first ``n - ceil(least n) + 1`` words. They meet at such a word if their sizes, what is left behind it, and
    the places in which their signatures differ can still reach the score; the sets themselves meet in the pairs that are left.
    For scores below LISTED_SCORE candidates come from signatures of sets of like sizes."""
    t = least - 10.0**-DIGITS  # rounding may lift a score to the threshold
    named = labelled(reps)
    pairs = candidates_by_word(named, t, frequent_words(reps)) if least >= LISTED_SCORE else candidates_by_size(named, t)
    return compared(checkpointed(pairs), named.withColumnRenamed("rep", "set"), least)


def clusters(edges: DataFrame, classes: DataFrame, k: int, least: float) -> DataFrame:
    """(doc_id, rank, other, score): the k most like of each document, from edges between class representatives.

    The k best of a document lie in the first k + 1 classes by likeness and smallest id, its own included, and there among
    the first k + 1 ids: so many of each are joined, however large classes are."""
    good = edges.where(F.col("score") >= least)
    both = good.select(F.col("a").alias("rep"), F.col("b").alias("near"), "score").union(good.select("b", "a", "score"))
    members = classes.select("rep", "doc_id")
    both = both.union(classes.where("members > 1 and doc_id = rep").select("rep", F.col("rep").alias("near"), F.lit(1.0).alias("score")))
    smallest = members.groupBy("rep").agg(F.min("doc_id").alias("smallest"))
    chosen = best(both.join(smallest.withColumnRenamed("rep", "near"), "near"), ["rep"], k + 1, tie="smallest").select("rep", "near", "score")
    first = members.withColumn("nth", F.row_number().over(Window.partitionBy("rep").orderBy("doc_id"))).where(F.col("nth") <= k + 1).select(F.col("rep").alias("near"), F.col("doc_id").alias("other"))
    others = best(chosen.join(first, "near"), ["rep"], k + 1, tie="other").select("rep", "other", "score")  # one of them may be the document itself
    found = members.join(others, "rep").where("doc_id <> other")
    return best(found, ["doc_id"], k, tie="other").select("doc_id", "rank", "other", "score")
