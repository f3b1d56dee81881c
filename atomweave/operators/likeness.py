"""Likeness over a store that grows: a stored prefix index, and the join of each batch with what was there before.

The index keeps classes of documents with equal sets of words, not documents. For each class it has the words of its prefix, with the set's size, signature and the
word's place, packed, in folders by hash of the word; the set itself, in folders by hash of the set; who is a member; and every pair of classes that reaches the
score. All of it is written once for each batch and never changed; a batch counts once its entry stands in the journal.

A batch brings documents that are new, changed or gone. Its sets that the index lacks get prefixes in the order of words that the first batch fixed (any
order is right; a stale one costs candidates alone, and ``rebuilt`` makes a new one). They meet each other, and the stored prefixes
of the same words: only folders of such words are read, and only folders of sets that met. So the work follows the new rows and those they meet, and
pairs of stored sets aren't looked at again. A pair is shuffled only if its signatures allow the score, and then as two numbers. Sets are shuffled
once in a batch to be stored, and those in such pairs again to be compared; what a batch puts aside goes when it is done."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpointed, remove, tidied
from ..sources.journal import Journal, LostRace
from . import retrieve

SETS = "slot string, set string, n int, tokens array<long>, folder int"
POSTINGS = "slot_hash long, entries int, " + ", ".join(f"{x} binary" for x in (*retrieve.WORD, "signature")) + ", folder int"
MEMBERS = "doc_id string, slot string, set string, created_at_ms long"
EDGES = "slot string, a string, b string, score double"
#: Files of a folder that a batch writes at most, so that a hot word is spread. Sets whose copies a task knows, at most.
SPREAD, KNOWN_SETS = 8, 200_000
#: A batch of at most so many entries tells the tasks which words it asks for; a larger one asks for nearly all of what it reads.
ASKED = 200_000


def folder_of(key: Column, folders: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(folders)).cast("int")


def label_of() -> Column:
    return F.xxhash64("slot", "set").alias("label")


def without_copies(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first row of each set (slot, set, …) of a task, now and then one more."""
    seen: set[tuple[str, str]] = set()
    for batch in batches:
        kept = []
        for k, key in enumerate(zip(batch.column("slot").to_pylist(), batch.column("set").to_pylist(), strict=True)):
            if key not in seen:
                seen.add(key)
                kept.append(k)
        if len(seen) > KNOWN_SETS:
            seen.clear()
        yield batch.take(pa.array(kept, pa.int64()))


def posted(sets: DataFrame, least: float, hot: tuple[np.ndarray, np.ndarray], folders: int) -> DataFrame:
    """Rows of POSTINGS from sets (label, slot_hash, tokens): entries of one slot and folder of words, packed."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns, bits, slot in retrieve.prefixed(batches, least, hot):
            slots, number = np.unique(slot, return_inverse=True)
            part = number * folders + (retrieve.mixed(columns["token"]) % np.uint64(folders)).astype(np.int64)
            present, packed = retrieve.cells(columns, bits, part, least)
            own = {"slot_hash": pa.array(slots[present // folders]), "entries": pa.array([len(x) // 8 for x in packed["token"]], pa.int32())}
            yield pa.RecordBatch.from_pydict(own | {name: pa.array(x, pa.binary()) for name, x in packed.items()} | {"folder": pa.array(present % folders, pa.int32())})

    return sets.select("label", "slot_hash", "tokens").mapInArrow(run, POSTINGS)


def dealt(postings: DataFrame, least: float, hot: tuple[np.ndarray, np.ndarray], n_groups: int, asked: np.ndarray | None = None) -> DataFrame:
    """Packed entries by group of lists, of rows of POSTINGS; of the words in ``asked`` alone, if they are told."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def packed() -> pa.RecordBatch:
            columns = {name: np.concatenate([h[0][name] for h in held]) for name in retrieve.WORD}
            slot = np.concatenate([np.full(len(h[0]["token"]), h[2]) for h in held])
            return pa.RecordBatch.from_pydict(retrieve.by_group(columns, np.concatenate([h[1] for h in held]), slot, least, hot, n_groups))

        for batch in batches:
            for k in range(len(batch)):
                columns, bits = retrieve.gathered([batch.slice(k, 1)], retrieve.WORD)
                if asked is not None:
                    at = np.flatnonzero(np.isin(columns["token"], asked))
                    bits, columns = retrieve.rows_of(bits, retrieve.widths(columns["n"], least), at), {name: c[at] for name, c in columns.items()}
                if len(columns["token"]):
                    held.append((columns, bits, batch.column("slot_hash")[k].as_py()))
                    size += len(columns["token"])
                if size > retrieve.GROUP_ENTRIES:
                    yield packed()
                    held, size = [], 0
        if held:
            yield packed()

    return postings.select("slot_hash", *retrieve.WORD, "signature").mapInArrow(run, f"g int, {retrieve.PACKED}")


class LikenessIndex:
    """Stored classes, prefixes and pairs of likeness of at least ``least``, below one folder."""

    def __init__(self, spark: SparkSession, path: str, least: float, folders: int = 1024):
        self.spark, self.path, self.journal = spark, path.rstrip("/"), Journal(spark, f"{path.rstrip('/')}/journal")
        known = self.journal.last()
        first = self.journal.entry(1) if known else {"least": least, "folders": folders}
        if first["least"] != least:
            raise ValueError(f"{path} was made for likeness of {first['least']}, not {least}")
        self.least, self.folders = least, first["folders"]

    def stored(self, name: str, schema: str, upto: int | None = None) -> DataFrame:
        """One table over all batches."""
        known = self.journal.last() if upto is None else upto
        places = [self.place(name, self.journal.entry(v)["batch"]) for v in range(1, known + 1)]
        if not places:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(f"{schema}, batch string").option("basePath", f"{self.path}/{name}").parquet(*places).drop("batch")

    def place(self, name: str, batch: str) -> str:
        return f"{self.path}/{name}/batch={batch}"

    def order(self, reps: DataFrame, place: str) -> tuple[np.ndarray, np.ndarray]:
        """Frequent words and their counts, as the first batch saw them; at most retrieve.HOT_WORDS rows."""
        if not self.journal.last():
            tokens, counts = retrieve.frequent_words(reps)
            rows = list(zip(tokens.tolist(), counts.tolist(), strict=True))
            self.spark.createDataFrame(rows, "token long, count long").coalesce(1).write.parquet(place)
            return tokens, counts
        found = self.spark.read.schema("token long, count long").parquet(self.place("order", self.journal.entry(1)["batch"])).orderBy("token").toArrow()
        return found.column("token").to_numpy(), found.column("count").to_numpy()

    def folders_of(self, rows: DataFrame, key: Column) -> list[int]:
        """Numbers of folders that hold these keys: as many as there are folders, at most."""
        return sorted(r[0] for r in rows.select(folder_of(key, self.folders)).distinct().collect())

    def add(self, leaves: DataFrame, gone: DataFrame | None = None, stream: tuple[str, int] | None = None) -> int:
        """Adds documents (slot, doc_id, created_at_ms, body), each in its newest form, and takes out those in ``gone`` (doc_id). Gives the version; a
        batch of a stream that is there already changes nothing; another writer in between raises LostRace."""
        base = self.journal.last()
        if stream is not None and base and self.journal.entry(base)["streams"].get(stream[0], -1) >= stream[1]:
            return base
        name = uuid.uuid4().hex
        t = self.least - 10.0**-retrieve.DIGITS
        aside = self.place("aside", name)
        retrieve.word_sets(leaves).select("slot", "set", "doc_id", "created_at_ms", "tokens").write.parquet(aside)
        sets = self.spark.read.parquet(aside)
        wordless = leaves.select("doc_id").join(sets.select("doc_id"), "doc_id", "left_anti")
        out = wordless if gone is None else wordless.unionByName(gone.select(F.col("doc_id").cast("string").alias("doc_id")).join(leaves.select("doc_id"), "doc_id", "left_anti"))
        nothing = [F.lit(None).cast(kind).alias(c) for c, kind in (("slot", "string"), ("set", "string"), ("created_at_ms", "long"))]
        members = sets.select("doc_id", "slot", "set", "created_at_ms").unionByName(out.select("doc_id", *nothing)).dropDuplicates(["doc_id"])
        members.write.parquet(self.place("members", name))

        old_sets, old_postings = self.stored("sets", SETS, base), self.stored("postings", POSTINGS, base)
        self._new_sets(sets, old_sets).write.partitionBy("folder").parquet(self.place("sets", name))
        remove(self.spark, aside)
        mine = self.spark.read.schema(SETS).parquet(self.place("sets", name))
        hot = self.order(mine.withColumn("rep", F.col("set")), self.place("order", name))
        named = mine.select(label_of(), F.xxhash64("slot").alias("slot_hash"), "tokens")
        spread = posted(named, t, hot, self.folders).repartition(F.col("folder"), F.pmod(F.xxhash64("token"), F.lit(SPREAD)))
        spread.write.partitionBy("folder").parquet(self.place("postings", name))

        new = self.spark.read.schema(POSTINGS).parquet(self.place("postings", name))
        word_folders = sorted(r[0] for r in new.select("folder").distinct().collect()) if base else []
        there = old_postings.where(F.col("folder").isin(word_folders))
        pairs = checkpointed(self._met(new, there, t, hot))
        tidied(self.spark)

        set_folders = self.folders_of(pairs.select(F.explode(F.array("x", "y")).alias("label")), F.col("label")) if base else []
        known = old_sets.where(F.col("folder").isin(set_folders)).select("slot", "set", "tokens")
        tokens = mine.select("slot", "set", "tokens").unionByName(known)
        retrieve.compared(pairs, tokens.withColumn("label", label_of()), self.least).write.parquet(self.place("edges", name))

        streams = (self.journal.entry(base)["streams"] if base else {}) | ({stream[0]: stream[1]} if stream else {})
        entry = {"batch": name, "streams": streams, "least": self.least, "folders": self.folders, "told": {"sets": mine.count(), "pairs": pairs.count(), "word_folders": len(word_folders), "set_folders": len(set_folders)}}
        del pairs
        tidied(self.spark)
        try:
            return self.journal.append(entry, base)
        except LostRace:
            for table in ("members", "order", "edges", "sets", "postings"):
                remove(self.spark, self.place(table, name))
            raise

    def _new_sets(self, sets: DataFrame, old_sets: DataFrame) -> DataFrame:
        """Rows of SETS that aren't stored yet. What is stored meets what came in the files that are written, so that sets are shuffled once."""
        came = sets.select("slot", "set", "tokens").mapInArrow(without_copies, "slot string, set string, tokens array<long>").withColumn("known", F.lit(False))
        if self.journal.last():
            known = old_sets.where(F.col("folder").isin(self.folders_of(sets, label_of())))
            came = came.unionByName(known.select("slot", "set", F.lit(None).cast("array<long>").alias("tokens"), F.lit(True).alias("known")))
        keys = ["folder", "salt"]
        came = came.withColumns({"folder": folder_of(label_of(), self.folders), "salt": F.pmod(F.xxhash64("set"), F.lit(SPREAD))}).repartition(*keys)
        one = came.groupBy(*keys, "slot", "set").agg(F.first("tokens", ignorenulls=True).alias("tokens"), F.bool_or("known").alias("known"))
        return one.where(~F.col("known")).select("slot", "set", F.size("tokens").alias("n"), "tokens", "folder")

    def _met(self, new: DataFrame, there: DataFrame, least: float, hot: tuple[np.ndarray, np.ndarray]) -> DataFrame:
        """(x, y): pairs of labels that may reach ``least``, of new entries with each other and with those ``there``, each once."""
        count = lambda rows: rows.agg(F.sum("entries")).first()[0] or 0
        n, known = count(new), count(there)
        n_groups = max(16, (n + known) // retrieve.GROUP_ENTRIES + 1)
        asked = None
        if known and n <= ASKED:
            asked = np.unique(np.frombuffer(b"".join(new.select("token").toArrow().column(0).to_pylist()), np.int64))
        rows = dealt(new, least, hot, n_groups).withColumn("old", F.lit(False))
        if known:
            rows = rows.unionByName(dealt(there, least, hot, n_groups, asked).withColumn("old", F.lit(True)))

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sides: dict[bool, list[pa.RecordBatch]] = {False: [], True: []}
            for batch in batches:
                for old, of in sides.items():
                    of.append(batch.filter(pc.equal(batch.column("old"), old)))
            mine, theirs = (retrieve.gathered(of, retrieve.ENTRY) for of in sides.values())
            yield from retrieve.pair_batches(retrieve.list_pairs(mine, None, least))
            yield from retrieve.pair_batches(retrieve.list_pairs(mine, theirs, least))

        return rows.groupBy("g").applyInArrow(meet, "x long, y long").distinct()

    def told(self, version: int) -> dict[str, int]:
        """Counts of a batch: new sets, pairs that met, and folders read of what was stored."""
        return self.journal.entry(version)["told"]

    def classes(self) -> DataFrame:
        """(slot, set, doc_id, created_at_ms, rep, members) of documents as the last batch that has them left them; the newest of a class, then
        the smallest id, stands for it."""
        known = self.journal.last()
        rows = [self.spark.read.schema(MEMBERS).parquet(self.place("members", self.journal.entry(v)["batch"])).withColumn("version", F.lit(v)) for v in range(1, known + 1)]
        every = rows[0]
        for more in rows[1:]:
            every = every.unionByName(more)
        now = every.groupBy("doc_id").agg(F.max_by(F.struct("slot", "set", "created_at_ms"), "version").alias("m")).select("doc_id", "m.*").where(F.col("set").isNotNull())
        first = F.min(F.struct((-F.col("created_at_ms")).alias("age"), "doc_id"))
        reps = now.groupBy("slot", "set").agg(first.alias("first"), F.count("*").alias("members")).select("slot", "set", F.col("first.doc_id").alias("rep"), "members")
        return now.join(reps, ["slot", "set"])

    def edges(self, classes: DataFrame) -> DataFrame:
        """(slot, a, b, score) between representatives of ``classes``; pairs of classes that lost all members are gone."""
        reps = classes.where("doc_id = rep").select("slot", "set", "rep")
        of = lambda x: reps.select("slot", F.col("set").alias(x), F.col("rep").alias(f"rep_{x}"))
        found = self.stored("edges", EDGES).join(of("a"), ["slot", "a"]).join(of("b"), ["slot", "b"])
        return found.select("slot", F.least("rep_a", "rep_b").alias("a"), F.greatest("rep_a", "rep_b").alias("b"), "score")

    def rebuilt(self, path: str, leaves: DataFrame) -> LikenessIndex:
        """A new index of the same kind over all documents in one batch, with an order of words of its own."""
        fresh = LikenessIndex(self.spark, path, self.least, self.folders)
        fresh.add(leaves)
        return fresh
