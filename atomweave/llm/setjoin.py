"""Exact n-gram Jaccard join that skips work through set relations, and its connected components.

Documents link when the Jaccard similarity of their sets of word 5-grams reaches 75 %. The join is exact; it saves work
in three ways that follow from relations between sets:

* Equal sets form one class; one representative (the smallest id) stands for it.
* A set that is very similar (90 %) to a *leader* becomes its satellite. Its own prefix is indexed under the leader's
  name, so a family of near copies is one entry of an index list, and its answers are derived from the leader's: with
  ``|A ^ C|`` known for leaders A and C, ``|S ^ C'| <= |A ^ C| + |S - A| + |C' - C|`` for their satellites. Only pairs of
  satellites that this bound leaves open are compared, and none when the leaders link, as all then have one component.
* What is asked for are components, so a pair whose sets already have one need not be compared. The partners that share
  most are compared first, which joins families; then all pairs that still lie in different components.
* Index lists are sorted by set size and cut in blocks by position; a pair of blocks whose sizes can't link is skipped
  whole.

Candidates come from prefix filtering: with all tokens in one fixed order, a set's prefix are its first
``n - ceil(3n/4) + 1`` tokens. Tokens that two sets share lie in both prefixes or behind one of them, so a pair is kept
only if it shares at least ``3 (n_a + n_b) / 7 - max(n_a - p_a, n_b - p_b)`` prefix tokens, which near copies do and
documents with a common passage don't. Any order gives the same result; frequent tokens come last in ours, so that lists are
short. Which are frequent is estimated from distinct texts by hash, and at most ``HOT_TOKENS`` are told to the executors:
that bounds a broadcast and changes the cost alone.

``links`` gives the join itself, without what follows from components.

5-grams are held as 64-bit hashes, compared only within a pair; classes are by 128 bits. What is shuffled are packed
arrays of prefix tokens, and the sets of documents that have a candidate, never all pairs and never all sets.

Edge cases: null, empty or blank texts have no 5-grams and link with nothing; fewer than five words are one sequence;
rows that repeat share their class; ids that repeat with other texts count as one document; a null id takes no part in
links and gets a null component; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import column_type, cut, give_back, sized, sliced

SHINGLE_WORDS = 5
#: A link needs 100 * intersection >= LINK * union; a satellite needs the same with CLOSE.
LINK, CLOSE = 75, 90
#: Frequency is estimated from one in SAMPLE distinct texts; a token seen HOT_COUNT times there comes late in the order.
SAMPLE, HOT_COUNT, HOT_TOKENS = 16, 2, 500_000
#: Partners of a set that are compared before all others, and the share of tokens (one in so many) that names them.
FIRST_PARTNERS, FIRST_TOKENS = 10, 4
#: Pairs of one id that meet in a task, and classes with one least hash that are joined to their leader by a shuffle.
HOT_PAIRS, HOT_GROUP = 256, 256
#: Prefix tokens in a group of index lists, entries of a block of a long list, and slices in which a group is sorted.
GROUP_TOKENS, BLOCK, SLICES = 1_000_000, 256, 4
#: Pairs that a task holds before it hands them on, at most about (48 bytes each, a few times over while they are sorted).
HELD_PAIRS = 250_000

U64 = np.uint64
FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], U64)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    x = x ^ U64(salt)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def shingles(text: bytes | None, hashes: WordHashes, width: int = SHINGLE_WORDS) -> np.ndarray:
    """The sorted distinct hashes of a text's 5-grams. bytes.lower and bytes.split know ASCII alone, as the definition does."""
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, U64)
    h = np.fromiter(map(hashes.__getitem__, words), U64, len(words))
    used = min(width, len(h))
    n = max(1, len(h) - width + 1)
    total = h[:n] * FACTORS[0]
    for k in range(1, used):
        total += h[k : k + n] * FACTORS[k]
    if used < width:
        total += U64(used * int(FACTORS[used]) % 2**64)
    return np.unique(mix(total))


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.asarray(x, U64).view(np.int64))


def sets_of(df: DataFrame) -> DataFrame:
    """(all columns but the text, n, tokens); ``df`` has a binary column ``text``."""
    kept = [c for c in df.columns if c != "text"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in sliced(batches):
            sets = [shingles(v.as_py(), hashes) for v in batch.column("text")]
            sizes = np.array([len(s) for s in sets], np.int64)
            tokens = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), signed(np.concatenate([np.empty(0, U64), *sets])))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(sizes), tokens], names=[*kept, "n", "tokens"])

    return df.mapInArrow(run, ", ".join(f"{c} {column_type(df, c)}" for c in kept) + ", n long, tokens array<long>")


def signatures(docs: DataFrame, key: str, hot: np.ndarray) -> DataFrame:
    """(key, n, f1, f2, least, prefix): size of the set, a 128-bit fingerprint of it, its least hash and packed prefix."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in sliced(batches):
            n, f1, f2, least, prefix = [], [], [], [], []
            for value in batch.column(1):
                s = shingles(value.as_py(), hashes)
                n.append(len(s))
                m = mix(s, 0x5851F42D4C957F2D)
                f1.append(np.sum(m, dtype=U64))
                f2.append(np.sum(m ^ (m >> U64(17)), dtype=U64))
                least.append(s[0] if len(s) else U64(0))
                prefix.append(prefix_order(s, hot).tobytes() if len(s) else b"")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), signed(f1), signed(f2), signed(least), pa.array(prefix, pa.binary())], names=[key, "n", "f1", "f2", "least", "prefix"])

    return docs.mapInArrow(run, f"{key} {column_type(docs, key)}, n long, f1 long, f2 long, least long, prefix binary")


def reaches(percent: int, common: str = "common", a: str = "n_a", b: str = "n_b"):
    return 100 * F.col(common) >= percent * (F.col(a) + F.col(b) - F.col(common))


def fetch(docs: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of ``docs`` whose id is in ``ids``, with its other columns: by broadcast when its count allows, else by a shuffle."""
    return docs.join(sized(ids, ids.count()), key)


def compare(docs: DataFrame, pairs: DataFrame, key: str) -> DataFrame:
    """(a, b, n_a, n_b, common) of pairs of ids; sets are made again for these ids alone. A set that meets more than HOT_PAIRS
    others is copied, so that no task gets all of its partners; the other pairs need no copies."""
    pairs = cut(pairs.select("a", "b"), "compared")
    count = lambda x: pairs.groupBy(F.col(x).alias("id")).agg(F.ceil(F.count("*") / HOT_PAIRS).cast("int").alias("salts")).where("salts > 1")
    hot = cut(count("a").union(count("b")).groupBy("id").agg(F.max("salts").alias("salts")), "hot")
    n_hot = hot.count()
    if not n_hot:
        return intersections(docs, pairs, key, None)
    hot = sized(hot, n_hot)
    side = lambda x: hot.select(F.col("id").alias(x), F.col("salts").alias(f"salts_{x}"))
    told = cut(pairs.join(side("a"), "a", "left").join(side("b"), "b", "left"), "told")
    few = intersections(docs, told.where("salts_a is null and salts_b is null").select("a", "b"), key, None)
    return few.unionByName(intersections(docs, told.where("salts_a is not null or salts_b is not null"), key, hot))


def intersections(docs: DataFrame, pairs: DataFrame, key: str, hot: DataFrame | None) -> DataFrame:
    """What ``compare`` gives, for pairs of ids of which none is ``hot``, or for those of which one is."""
    ids = cut(pairs.select(F.col("a").alias(key)).union(pairs.select(F.col("b").alias(key))).distinct(), "ids")
    # one shuffle by id serves the removal of repeated rows and, without copies, both joins
    sets = sets_of(fetch(docs, ids, key)).repartition(F.col(key)).dropDuplicates([key, "n", "tokens"])
    side = lambda x: sets.select(F.col(key).alias(x), F.col("n").alias(f"n_{x}"), F.col("tokens").alias(f"tokens_{x}"))
    if hot is None:
        both = pairs.join(side("a"), "a").join(side("b"), "b")
    else:
        both = pairs
        for x, other in (("a", "b"), ("b", "a")):
            copies = side(x).join(hot.select(F.col("id").alias(x), "salts"), x, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
            both = both.withColumn("salt", F.pmod(F.xxhash64(other), F.coalesce(f"salts_{x}", F.lit(1))).cast("int")).join(copies, [x, "salt"]).drop("salt")
    return both.select("a", "b", "n_a", "n_b", F.size(F.array_intersect("tokens_a", "tokens_b")).cast("long").alias("common"))


def frequent_tokens(docs: DataFrame) -> np.ndarray:
    """Hashes that are frequent among distinct texts, sorted; at most HOT_TOKENS, the most frequent first kept."""
    some = docs.select("text").where(F.pmod(F.crc32("text"), F.lit(SAMPLE)) == 0).distinct()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in sliced(batches):
            for value in batch.column(0):
                yield pa.RecordBatch.from_arrays([signed(shingles(value.as_py(), hashes))], names=["token"])

    found = some.mapInArrow(run, "token long").groupBy("token").count().where(F.col("count") >= HOT_COUNT)
    top = found.orderBy(F.desc("count"), "token").limit(HOT_TOKENS).select("token").toArrow()
    return np.sort(top.column("token").to_numpy().view(U64))


def prefix_order(s: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """The first tokens of a sorted set, rare ones by hash, then frequent ones by hash."""
    if len(hot):
        at = np.minimum(np.searchsorted(hot, s), len(hot) - 1)
        late = hot[at] == s
        s = np.concatenate([s[~late], s[late]])
    n = len(s)
    return s[: n - (LINK * n + 99) // 100 + 1]


def postings(labelled: DataFrame, n_groups: int, every: int = 1) -> DataFrame:
    """Packed index entries in groups of tokens: (g, token, label, component, low, high); one in ``every`` token."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in sliced(batches):
            label, component, low, high, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("label", "component", "low", "high", "n"))
            for k, value in enumerate(batch.column("prefix")):
                p = np.frombuffer(value.as_py(), U64)
                if every > 1:
                    p = p[(p >> U64(32)) % U64(every) == 0]
                held.append((p, np.full(len(p), label[k]), np.full(len(p), component[k]), np.full(len(p), min(n[k], low[k] or n[k]), np.int32), np.full(len(p), max(n[k], high[k]), np.int32)))
                size += len(p)
                if size > 500_000:
                    yield pack(held, n_groups)
                    held, size = [], 0
        if size:
            yield pack(held, n_groups)

    return labelled.mapInArrow(run, "g int, " + ", ".join(f"{x} binary" for x in ENTRY))


ENTRY = {"token": U64, "label": np.int64, "component": np.int64, "low": np.int32, "high": np.int32}


def pack(held: list[tuple], n_groups: int) -> pa.RecordBatch:
    columns = [np.concatenate([h[k] for h in held]) for k in range(len(ENTRY))]
    group = (columns[0] % U64(n_groups)).astype(np.int64)
    order = np.argsort(group, kind="stable")
    present, starts = np.unique(group[order], return_index=True)
    ends = [*starts[1:], len(order)]
    cells = [[c[order[a:b]].tobytes() for a, b in zip(starts, ends, strict=True)] for c in columns]
    return pa.RecordBatch.from_arrays([pa.array(present, pa.int32()), *(pa.array(c, pa.binary()) for c in cells)], names=["g", *ENTRY])


def rolled_up(rows: np.ndarray) -> np.ndarray:
    """Rows (a, b, shared, groups, low, high) with one column for each pair: tokens and groups of tokens are added up, low
    and high go with the pair."""
    if not rows.shape[1]:
        return rows
    rows = rows[:, np.lexsort((rows[1], rows[0]))]
    at = np.flatnonzero(np.r_[True, (rows[0, 1:] != rows[0, :-1]) | (rows[1, 1:] != rows[1, :-1])])
    return np.vstack([rows[:2, at], np.add.reduceat(rows[2:4], at, axis=1), rows[4:, at]])


def needed(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Seven times the prefix tokens that linked sets share at least, from the least sum and the greatest of their sizes:
    n - p is ceil(3 n / 4) - 1, and grows with n."""
    return 3 * low - 7 * ((3 * high + 3) // 4 - 1)


def list_pairs(token: np.ndarray, label: np.ndarray, component: np.ndarray, low: np.ndarray, high: np.ndarray, partners: int = 0) -> Iterator[np.ndarray]:
    """Pairs of labels in different components that the index lists of a group of tokens name: rows a, b, shared, groups, low, high.
    With ``partners``, a few of the nearest of each label, and neighbours alone in long lists; else all, in pieces as soon as there
    are more than HELD_PAIRS, of which several may name one pair."""
    none = np.empty((6, 0), np.int64)
    if not len(token):
        return
    order = np.lexsort((label, token))
    order = order[np.r_[True, (token[order][1:] != token[order][:-1]) | (label[order][1:] != label[order][:-1])]]
    # each list by component and size, so that blocks by position are of few components and of like sizes
    order = order[np.lexsort((low[order], component[order], token[order]))]
    token, label, component, low, high = (x[order] for x in (token, label, component, low.astype(np.int64), high.astype(np.int64)))
    first = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
    length = np.diff(np.r_[first, len(token)])

    def met() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places of entries that meet, some at a time."""
        for size in np.unique(length[(length > 1) & (length <= 48)]):
            starts = first[length == size]
            i, j = np.triu_indices(size, 1)
            step = max(1, 400_000 // len(i))
            for k in range(0, len(starts), step):
                s = starts[k : k + step, None]
                yield (s + i).ravel(), (s + j).ravel()
        for start, size in zip(first[length > 48], length[length > 48], strict=True):
            if partners:
                at = np.arange(start, start + size)
                for gap in range(1, partners + 1):
                    yield at[:-gap], at[gap:]
                continue
            blocks = [np.arange(start + k, min(start + size, start + k + BLOCK)) for k in range(0, size, BLOCK)]
            # a block's sizes, and its component if it has but one
            ends = [(low[b].min(), high[b].max(), component[b[0]] if component[b[0]] == component[b[-1]] else None) for b in blocks]
            for x, a in enumerate(blocks):
                for y in range(x, len(blocks)):
                    if 4 * ends[x][1] < 3 * ends[y][0] or 4 * ends[y][1] < 3 * ends[x][0] or (ends[x][2] is not None and ends[x][2] == ends[y][2]):
                        continue
                    i, j = np.meshgrid(a, blocks[y], indexing="ij")
                    i, j = i.ravel(), j.ravel()
                    yield (i[i < j], j[i < j]) if x == y else (i, j)

    out: list[np.ndarray] = []
    size_out = 0
    for i, j in met():
        good = (4 * high[j] >= 3 * low[i]) & (4 * high[i] >= 3 * low[j]) & (component[i] != component[j])
        i, j = i[good], j[good]
        if not len(i):
            continue
        out.append(rolled_up(np.stack([np.minimum(label[i], label[j]), np.maximum(label[i], label[j]), np.ones(len(i), np.int64), np.zeros(len(i), np.int64), low[i] + low[j], np.maximum(high[i], high[j])])))
        size_out += out[-1].shape[1]
        if size_out > HELD_PAIRS:
            out[:] = [rolled_up(np.concatenate(out, axis=1))]
            size_out = 0
            if not partners and out[0].shape[1] > HELD_PAIRS:
                yield out.pop()
    found = rolled_up(np.concatenate(out, axis=1)) if out else none
    if partners and found.shape[1]:
        near = np.zeros(found.shape[1], bool)
        for side in (0, 1):
            order = np.lexsort((-found[2], found[side]))
            new = np.flatnonzero(np.r_[True, found[side][order][1:] != found[side][order][:-1]])
            nth = np.arange(len(order)) - np.repeat(new, np.diff(np.r_[new, len(order)]))
            near[order[nth < partners]] = True
        found = found[:, near]
    yield found


def candidates(grouped: DataFrame, n_groups: int, partners: int = 0) -> DataFrame:
    """(a, b, shared) of labels that share enough prefix tokens for a link between any of their sets, or, with
    ``partners``, of the nearest few of each.

    Where many tokens are needed, some group has its share of them, so that only groups with that share name the pair;
    where few are needed, all groups do and the sum is exact. A group hands its pairs on in pieces, of which the last alone
    counts as a group: what others leave out then stays below their share as well. Pairs are dealt by both ids."""
    n_parts = n_groups * SLICES

    def packed(found: np.ndarray) -> pa.RecordBatch:
        part = (mix(mix(found[0].view(U64)) ^ found[1].view(U64)) % U64(n_parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        parts, starts = np.unique(part[order], return_index=True)
        cells = [np.ascontiguousarray(found[:, order[a:b]]).tobytes() for a, b in zip(starts, [*starts[1:], len(order)], strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(cells, pa.binary())], names=["h", "pairs"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A group's pairs, packed by the part of the sums that they go to."""
        blocks = [batch.select(list(ENTRY)) for batch in batches]
        last: list[np.ndarray] = []
        for part in range(SLICES):  # tokens by tokens, so that sorting takes little room
            columns: dict[str, list[np.ndarray]] = {name: [] for name in ENTRY}
            for row in (dict(zip(ENTRY, values, strict=True)) for block in blocks for values in zip(*block.columns, strict=True)):
                chosen = (np.frombuffer(row["token"].as_py(), U64) >> U64(20)) % U64(SLICES) == part
                for name, kind in ENTRY.items():
                    columns[name].append(np.frombuffer(row[name].as_py(), kind)[chosen])
            pieces = list_pairs(*(np.concatenate(v) for v in columns.values()), partners=partners)
            before = None
            for found in pieces:
                if before is not None:
                    yield packed(before)
                before = found
            if before is not None:
                last.append(before)
            if not partners and sum(x.shape[1] for x in last) > HELD_PAIRS:
                last = [rolled_up(np.concatenate(last, axis=1))]
                if last[0].shape[1] > HELD_PAIRS:
                    yield packed(last.pop())
        found = rolled_up(np.concatenate([np.empty((6, 0), np.int64), *last], axis=1))
        found[3] = 1
        if not partners:
            need = needed(found[4], found[5])
            found = found[:, (need <= 14 * n_groups) | (7 * found[2] * n_groups >= need)]
        if found.shape[1]:
            yield packed(found)
        give_back()

    def add_up(table: pa.Table) -> pa.Table:
        """The pairs of a part with their sums over all groups, where these suffice."""
        found = rolled_up(np.concatenate([np.frombuffer(v.as_py(), np.int64).reshape(6, -1) for v in table.column("pairs")], axis=1))
        if not partners:
            need = needed(found[4], found[5])
            found = found[:, 7 * found[2] * n_groups >= np.where(need <= 14 * n_groups, need * n_groups, need * found[3])]
        return pa.table({name: pa.array(np.ascontiguousarray(found[k])) for k, name in enumerate(("a", "b", "shared"))})

    return grouped.groupBy("g").applyInArrow(meet, "h int, pairs binary").groupBy("h").applyInArrow(add_up, "a long, b long, shared long")


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest id that each node of the edges (u, v) reaches. Stars are grown in turn around large
    and small neighbours until the edges stay the same; each turn is written to the shared folder."""
    edges = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    before = mark(edges)
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        edges = cut(small.where("u <> v").distinct(), "edges")
        after = mark(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())


def apart(pairs: DataFrame, joined: DataFrame) -> DataFrame:
    """The pairs (a, b, ...) whose components differ so far."""
    of = lambda x: joined.select(F.col("node").alias(x), F.col("component").alias(f"c_{x}"))
    return pairs.join(of("a"), "a", "left").join(of("b"), "b", "left").where(F.coalesce("c_a", "a") != F.coalesce("c_b", "b")).drop("c_a", "c_b")


def led(plain: DataFrame) -> DataFrame:
    """(a, b): each class of ``plain`` (rep, least) with the leader of those that have its least hash, the smallest id. The
    few large groups are told to all tasks, if their number allows, so that no task gets a whole one."""
    groups = cut(plain.groupBy("least").agg(F.min("rep").alias("leader"), F.count("*").alias("members")).where("members > 1"), "groups")
    hot = groups.where(F.col("members") > HOT_GROUP).select("least", F.col("leader").alias("b"))
    marked = plain.select(F.col("rep").alias("a"), "least").join(sized(hot, hot.count()), "least", "left")
    few = groups.where(F.col("members") <= HOT_GROUP).select("least", F.col("leader").alias("b"))
    return marked.where("b is not null").select("a", "b").union(marked.where("b is null").select("a", "least").join(few, "least").select("a", "b")).where("a <> b")


def links(docs: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """The join itself: (a, b, n_a, n_b, common) with a < b, each link between representatives of classes of equal sets, and
    (key, rep), which documents they stand for. No pair is passed over because others join its components.

    Answers of a satellite follow from its leader's: leaders are compared with leaders that the index names, and of their
    satellites those pairs that the leaders' intersections leave open; satellites of one leader are compared with each other.
    Ids must not repeat with other texts; null ids take no part."""
    docs = docs.select(F.col(key), F.col(text).cast("binary").alias("text")).where(F.col(key).isNotNull())
    sig = cut(signatures(docs, key, frequent_tokens(docs)).where("n > 0"), "signatures")
    classes = cut(sig.groupBy("f1", "f2", "n", "least").agg(F.min(key).alias("rep")), "classes")
    members = sig.join(classes, ["f1", "f2", "n", "least"]).select(key, "rep")
    near = cut(compare(docs, led(classes), key).where(reaches(CLOSE)), "satellites")
    satellites = near.select(F.col("a").alias("rep"), F.col("b").alias("label"), (F.col("n_a") - F.col("common")).alias("own"), F.col("n_a").alias("n"))
    folk = cut(satellites.unionByName(classes.join(satellites, "rep", "left_anti").select("rep", F.col("rep").alias("label"), F.lit(0).cast("long").alias("own"), "n")), "folk")

    # the index has every representative's prefix under its leader's name; sizes and gains are those of the whole family
    sizes = folk.groupBy("label").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.max("own").alias("own"))
    rows = sig.select(F.col(key).alias("rep"), "prefix").join(folk.select("rep", "label", "n"), "rep").dropDuplicates(["rep"]).join(sizes, "label")
    rows = cut(rows.select("label", F.col("label").alias("component"), "low", "high", "n", "prefix"), "labels")
    n_groups = max(16, int((classes.agg(F.sum("n")).first()[0] or 0) * (100 - LINK) / 100 / GROUP_TOKENS) + 1)
    leaders = cut(candidates(postings(rows, n_groups), n_groups).select("a", "b"), "pairs")
    known = cut(compare(docs, leaders, key), "answers")

    # a satellite shares with others at most what its leader does, and what either has beyond its leader
    family = lambda x: folk.select(F.col("label").alias(x), F.col("rep").alias(f"rep_{x}"), F.col("own").alias(f"own_{x}"), F.col("n").alias(f"size_{x}"))
    most = lambda x: sizes.select(F.col("label").alias(x), F.col("own").alias(f"most_{x}"), F.col("low").alias(f"low_{x}"))
    open_to = lambda n_a, n_b, shared: 7 * shared >= 3 * (n_a + n_b)
    wide = known.join(most("a"), "a").join(most("b"), "b")
    wide = wide.where(open_to(F.col("low_a"), F.col("low_b"), F.col("common") + F.col("most_a") + F.col("most_b"))).join(family("a"), "a")
    wide = wide.where(open_to(F.col("size_a"), F.col("low_b"), F.col("common") + F.col("own_a") + F.col("most_b"))).join(family("b"), "b")
    wide = wide.where(open_to(F.col("size_a"), F.col("size_b"), F.col("common") + F.col("own_a") + F.col("own_b")) & ((F.col("rep_a") != F.col("a")) | (F.col("rep_b") != F.col("b"))))
    inside = family("a").join(folk.select(F.col("label").alias("a"), F.col("rep").alias("rep_b")), "a").where("rep_a < rep_b")
    rest = wide.select("rep_a", "rep_b").union(inside.select("rep_a", "rep_b")).select(F.least("rep_a", "rep_b").alias("a"), F.greatest("rep_a", "rep_b").alias("b")).distinct()
    return known.unionByName(compare(docs, rest, key)).where(reaches(LINK)), members


def link_components(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id) for each row of ``docs``."""
    docs = docs.select(F.col(key), F.col(text).cast("binary").alias("text"))
    named = docs.where(F.col(key).isNotNull())
    sig = cut(signatures(docs, key, frequent_tokens(named)), "signatures")
    classes = sig.where((F.col("n") > 0) & F.col(key).isNotNull()).groupBy("f1", "f2", "n", "least").agg(F.min(key).alias("rep"))
    classes = cut(classes, "classes")
    # ids that name several classes lead none, so that bounds refer to one set
    plain = classes.groupBy("rep").agg(F.count("*").alias("texts"), F.first("least").alias("least"), F.first("n").alias("n")).where("texts = 1")

    # leaders: the smallest id among the classes with one least hash
    members = cut(led(plain), "members")
    tried = cut(compare(named, members, key), "leaders")
    near = tried.where(reaches(LINK)).select(F.col("a").alias("u"), F.col("b").alias("v"))
    satellites = cut(tried.where(reaches(CLOSE)).select(F.col("a").alias("rep"), F.col("b").alias("label"), (7 * (F.col("n_a") - F.col("common")) - 3 * F.col("n_a")).alias("gain")), "satellites")

    # representatives are indexed under their leader's name, with the sizes of all sets of that name; copies are left out
    copies = sig.where((F.col("n") > 0) & F.col(key).isNotNull()).join(classes.select(F.col("rep").alias(key)).distinct(), key, "left_anti").select(key).distinct()
    own_name = classes.join(satellites.select("rep", "label"), "rep", "left").select(F.col("rep").alias(key), F.coalesce("label", "rep").alias("label"), "n")
    sizes = own_name.groupBy("label").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.count("*").alias("sets")).where("sets > 1").drop("sets")
    several = own_name.join(sizes, "label").select(key, "label", "low", "high").distinct()
    names = cut(several.withColumn("copy", F.lit(False)).unionByName(copies.withColumn("copy", F.lit(True)), allowMissingColumns=True), "names")

    def labelled(joined: DataFrame) -> DataFrame:
        known = cut(names.select(key, "label", "low", "high", "copy").join(joined.withColumnRenamed("node", key), key, "full").withColumn("label", F.coalesce("label", key)), "labels")
        rows = sig.where((F.col("n") > 0) & F.col(key).isNotNull()).join(sized(known, known.count()), key, "left").where(~F.coalesce("copy", F.lit(False)))
        label = F.coalesce("label", key)
        return rows.select(label.alias("label"), F.coalesce("component", label).alias("component"), F.coalesce("low", F.lit(0)).alias("low"), F.coalesce("high", F.lit(0)).alias("high"), "n", "prefix")

    tokens = classes.agg(F.sum("n")).first()[0] or 0
    n_groups = max(16, int(tokens * (100 - LINK) / 100 / GROUP_TOKENS) + 1)
    linked = lambda df: df.where(reaches(LINK)).select(F.col("a").alias("u"), F.col("b").alias("v"))

    # the nearest few of each first, from some of the tokens; then all pairs that this leaves in different components
    joined = components(near)
    ways = candidates(postings(labelled(joined), n_groups, FIRST_TOKENS), n_groups, FIRST_PARTNERS)
    ways = cut(ways, "nearest")
    ways = ways.union(ways.select("b", "a", "shared"))
    closest = ways.withColumn("k", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("shared"), "b"))).where(F.col("k") <= FIRST_PARTNERS)
    known = cut(compare(named, closest.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), key), "answers")
    joined = components(near.union(linked(known)))
    pairs = cut(candidates(postings(labelled(joined), n_groups), n_groups).select("a", "b"), "pairs")
    known = known.union(cut(compare(named, pairs.join(known.select("a", "b"), ["a", "b"], "left_anti"), key), "answers"))
    joined = components(near.union(linked(known)))

    # answers of satellites that the bound leaves open
    family = satellites.groupBy("label").agg(F.max("gain").alias("gain"))
    gains = lambda x: family.select(F.col("label").alias(x), F.col("gain").alias(f"gain_{x}"))
    ahead = apart(known.where(~reaches(LINK)), joined).join(gains("a"), "a", "left").join(gains("b"), "b", "left")
    best = lambda x: F.greatest(F.coalesce(F.col(f"gain_{x}"), -3 * F.col(f"n_{x}")), -3 * F.col(f"n_{x}"))
    ahead = ahead.where((F.col("gain_a").isNotNull() | F.col("gain_b").isNotNull()) & (7 * F.col("common") + best("a") + best("b") >= 0))
    folk = satellites.select("label", "rep", "gain")
    side = lambda df, x: df.join(folk.select(F.col("label").alias(x), F.col("rep").alias(f"rep_{x}"), F.col("gain").alias(f"own_{x}")), x, "left")
    own = lambda x: F.array(F.struct(F.col(x).alias("id"), (-3 * F.col(f"n_{x}")).alias("gain")), F.struct(F.col(f"rep_{x}").alias("id"), F.col(f"own_{x}").alias("gain")))
    kept = lambda x: F.col(f"{x}.id").isNotNull()
    wide = side(ahead, "a").withColumn("x", F.explode(own("a"))).where(kept("x") & (7 * F.col("common") + F.col("x.gain") + best("b") >= 0)).select("a", "b", "n_b", "common", "x").distinct()
    wide = side(wide, "b").withColumn("y", F.explode(own("b"))).where(kept("y") & (7 * F.col("common") + F.col("x.gain") + F.col("y.gain") >= 0))
    open_pairs = wide.where("not (x.id = a and y.id = b)").select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()
    more = compare(named, open_pairs, key)

    same_id = sig.where("n > 0").join(classes, ["f1", "f2", "n", "least"]).where(F.col("rep") != F.col(key)).join(classes.select(F.col("rep").alias(key)).distinct(), key, "left_semi").select(F.col(key).alias("u"), F.col("rep").alias("v"))
    found = components(near.union(linked(known)).union(linked(more)).union(same_id))

    of_class = classes.join(found, classes["rep"] == found["node"], "left").select("f1", "f2", "n", "least", F.coalesce("component", "rep").alias("component"))
    out = sig.drop("prefix").join(of_class, ["f1", "f2", "n", "least"], "left")
    return out.select(F.col(key), F.col("n").alias("n_shingles"), F.when(F.col(key).isNotNull(), F.coalesce("component", key)).alias("component_id"))
