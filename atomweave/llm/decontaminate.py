"""Benchmark decontamination by multi-pattern search over words.

Test texts are cut into windows of ten consecutive words. Windows of equal length form one search table in the manner of
Wu and Manber, with words in place of characters: the shift table says, for the last two words under the search window,
how far it may move without missing anything; where it says nought, the bucket of that suffix names the few windows
that can end here, their first word is compared, and then all words, directly.

Test texts are read once, and sent to the executors in tables of at most about ``TABLE_WINDOWS`` windows. A larger
benchmark is searched table after table: what one pass found is written to the shared folder with the texts and the next
pass adds to it, so that neither the driver nor a task holds more than one table, and nothing is left out.

Edge cases: null or wordless texts have no words and no windows; items of fewer than ten words are one window each;
equal windows of several items name all of them; words of an item without an id are hits and name nothing; rows that repeat give rows that repeat.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column_type, cut, sliced

WINDOW_WORDS = 10
TABLE_WINDOWS = 500_000

#: A-Z to lower case; digits, lower-case letters and every byte of a character beyond ASCII are kept; all else parts words.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(WORD_BYTES).split()


def windows(item: list[bytes], size: int = WINDOW_WORDS) -> Iterator[tuple[bytes, ...]]:
    if item:
        yield from (tuple(item[i : i + size]) for i in range(max(1, len(item) - size + 1)))


class ShiftTable:
    """Windows of one length, searched together."""

    def __init__(self, patterns: Iterable[tuple[bytes, ...]]):
        self.patterns = list(dict.fromkeys(patterns))
        self.length = len(self.patterns[0])
        self.block = min(2, self.length)
        self.most = self.length - self.block + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.buckets: dict[tuple[bytes, ...], dict[bytes, list[tuple[bytes, ...]]]] = defaultdict(lambda: defaultdict(list))
        for pattern in self.patterns:
            for end in range(self.block, self.length + 1):
                key = pattern[end - self.block : end]
                self.shift[key] = min(self.shift.get(key, self.most), self.length - end)
            self.buckets[pattern[-self.block :]][pattern[0]].append(pattern)

    def search(self, text: list[bytes]) -> Iterator[tuple[int, tuple[bytes, ...]]]:
        """Each occurrence: the place of its first word, and the window."""
        length, most, get, n = self.length, self.most, self.shift.get, len(text)
        at = length
        if self.block == 1:
            for i, word in enumerate(text):
                if (word,) in self.shift:
                    yield i, (word,)
            return
        while at <= n:
            step = get((text[at - 2], text[at - 1]), most)
            if step:
                at += step
                continue
            start = at - length
            for pattern in self.buckets[(text[at - 2], text[at - 1])].get(text[start], ()):
                if tuple(text[start:at]) == pattern:
                    yield start, pattern
            at += 1


class Searcher:
    """Tables for windows of all lengths, and the items of each window."""

    def __init__(self, items: dict[tuple[bytes, ...], dict[str, None]]):
        self.items = items
        by_length: dict[int, list[tuple[bytes, ...]]] = defaultdict(list)
        for window in items:
            by_length[len(window)].append(window)
        self.tables = [ShiftTable(by_length[n]) for n in sorted(by_length)]

    def scan(self, text: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Spans of hit words and the items that occur."""
        spans: list[tuple[int, int]] = []
        found: set[str] = set()
        for table in self.tables:
            for start, window in table.search(text):
                spans.append((start, start + table.length))
                found.update(self.items[window])
        return spans, found


def read_items(benchmark: DataFrame, key: str = "item_id", text: str = "text") -> Iterator[dict[tuple[bytes, ...], dict[str, None]]]:
    """Windows with their items, in tables that close once they have TABLE_WINDOWS windows, also within an item. There is
    one table at least."""
    table: dict[tuple[bytes, ...], dict[str, None]] = {}
    given = False
    for row in benchmark.select(F.col(key).cast("string"), F.col(text).cast("binary")).toLocalIterator():
        for window in windows(words(row[1])):
            if window not in table and len(table) >= TABLE_WINDOWS:
                yield table
                table, given = {}, True
            named = table.setdefault(window, {})
            if row[0] is not None:
                named[row[0]] = None
    if table or not given:
        yield table


def merge_spans(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    merged: list[tuple[int, int]] = []
    for start, stop in sorted(spans):
        if merged and start <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(stop, merged[-1][1]))
        else:
            merged.append((start, stop))
    return merged


SPANS = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
FOUND = "n_words long, spans array<struct<start:int,stop:int>>, items array<string>"


def search_pass(df: DataFrame, table: dict[tuple[bytes, ...], dict[str, None]], key: str) -> DataFrame:
    """``df`` has (key, text binary, n_words, spans, items); the table's finds are added to the last two."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher = Searcher(table)
        for batch in sliced(batches):
            n_words, spans, items = [], [], []
            for value, had, named in zip(batch.column(1), batch.column(3), batch.column(4), strict=True):
                doc = words(value.as_py())
                hits, found = searcher.scan(doc)
                n_words.append(len(doc))
                spans.append([{"start": a, "stop": b} for a, b in merge_spans([(x["start"], x["stop"]) for x in had.as_py()] + hits)])
                items.append(sorted(found.union(named.as_py())))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n_words, pa.int64()), pa.array(spans, SPANS), pa.array(items, pa.list_(pa.string()))], names=[key, "text", "n_words", "spans", "items"])

    return df.mapInArrow(run, f"{key} {column_type(df, key)}, text binary, {FOUND}")


def find_overlaps(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """For each row of ``docs``: its words, merged spans of hit words, and the items that occur, sorted as strings."""
    none = F.from_json(F.lit("[]"), "array<struct<start:int,stop:int>>"), F.array().cast("array<string>")
    out = docs.select(F.col(key), F.col(text).cast("binary").alias("text"), F.lit(0).cast("long").alias("n_words"), none[0].alias("spans"), none[1].alias("items"))
    for k, table in enumerate(read_items(benchmark, item_key, item_text)):
        out = search_pass(cut(out, "overlaps") if k else out, table, key)
    return out.drop("text")


def digests(found: DataFrame, key: str = "doc_id") -> DataFrame:
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + (s["stop"] - s["start"]))
    return found.select(key, "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs``, with their columns, in which no window of any item occurs. Whole rows go through the search,
    so nothing is joined back by an id that may be null or repeat."""
    at = docs.columns.index(text)

    def keep(table: dict) -> object:
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            searcher = Searcher(table)
            for batch in sliced(batches):
                texts = (words((value.as_py() or "").encode("utf-8", "replace")) for value in batch.column(at))
                yield batch.filter(pa.array([not any(True for t in searcher.tables for _ in t.search(doc)) for doc in texts], pa.bool_()))

        return run

    for k, table in enumerate(read_items(benchmark)):
        docs = (cut(docs, "clean") if k else docs).mapInArrow(keep(table), docs.schema)
    return docs
