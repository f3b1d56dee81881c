"""Byte-level BPE by a tree of joins.

A piece of text (one match of the split pattern) is encoded by halves: each half is encoded by itself, and the two token
lists are joined. To join them, a window of tokens around the seam is encoded anew; it grows until the tokens at its
ends fit the tokens outside. A list of tokens is the encoding of its bytes exactly when each two neighbours are, so once
both ends fit, nothing outside the window can change: the join is proven and not only likely. This needs every token to
encode to itself, which ``self_encoding`` checks. Joining is associative, so whole texts are joined from pieces, and
pieces from halves, in any grouping; decoding concatenates bytes up the same tree.

Edge cases: null and empty texts have no tokens; texts of any length are read in blocks, so that what a worker holds stays bounded;
rows that repeat give rows that repeat; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import column_type, give_back, sliced

#: Pieces up to so many bytes are leaves of the tree, merged directly.
LEAF_BYTES = 48
#: Characters of a text that are split at a time.
BLOCK_CHARS = 1 << 20
#: Encoded pieces that a Python worker remembers; beyond that all are dropped.
CACHE_PIECES = 300_000
#: The rank of two neighbours that no merge joins.
NEVER = 1 << 62


class TreeBpe:
    """Encoder and decoder for tokens given with their ranks."""

    def __init__(self, ranks: dict[bytes, int], leaf: int = LEAF_BYTES):
        self.ranks, self.leaf = ranks, leaf
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.stable = lru_cache(50_000)(self._stable)

    def merge(self, data: bytes) -> list[int]:
        """Merges the pair of lowest rank, the leftmost of equals, until none is left."""
        ranks, n = self.ranks, len(data)
        if n > 2 * self.leaf:
            return self._merge_long(data)
        parts, get, bytes_of = [data[i : i + 1] for i in range(n)], ranks.get, self.bytes_of
        pairs = [get(data[i : i + 2], NEVER) for i in range(n - 1)]
        while pairs and (best := min(pairs)) != NEVER:
            i = pairs.index(best)
            parts[i] = both = bytes_of[best]
            del parts[i + 1], pairs[i]
            if i < len(pairs):
                pairs[i] = get(both + parts[i + 1], NEVER)
            if i:
                pairs[i - 1] = get(parts[i - 1] + both, NEVER)
        return [ranks[p] for p in parts]

    def _merge_long(self, data: bytes) -> list[int]:
        """The same with a heap and links, for windows that grew long."""
        ranks, n = self.ranks, len(data)
        end, after, before, alive = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := ranks.get(data[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, j, stop = heapq.heappop(heap)
            if not (alive[i] and j < n and alive[j] and after[i] == j and end[j] == stop):
                continue
            end[i], after[i], alive[j] = stop, after[j], False
            if after[j] < n:
                before[after[j]] = i
            for a in (before[i], i):
                if a >= 0 and (b := after[a]) < n and (r := ranks.get(data[a : end[b]])) is not None:
                    heapq.heappush(heap, (r, a, b, end[b]))
        return [ranks[data[i : end[i]]] for i in range(n) if alive[i]]

    def _stable(self, left: int, right: int) -> bool:
        """Whether two neighbours stay as they are."""
        return self.merge(self.bytes_of[left] + self.bytes_of[right]) == [left, right]

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of two encoded byte strings set together."""
        if not left or not right:
            return left or right
        width = 1
        while True:
            a, b = max(0, len(left) - width), min(width, len(right))
            window = self.merge(b"".join(self.bytes_of[t] for t in left[a:] + right[:b]))
            if (a == 0 or self.stable(left[a - 1], window[0])) and (b == len(right) or self.stable(window[-1], right[b])):
                return left[:a] + window + right[b:]
            width *= 2

    def encode(self, piece: bytes) -> list[int]:
        if (rank := self.ranks.get(piece)) is not None:
            return [rank]
        if len(piece) <= self.leaf:
            return self.merge(piece)
        middle = len(piece) // 2
        return self.join(self.encode(piece[:middle]), self.encode(piece[middle:]))

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= 16:
            return b"".join([self.bytes_of[t] for t in ids])
        middle = len(ids) // 2
        return self.decode(ids[:middle]) + self.decode(ids[middle:])

    def self_encoding(self) -> bool:
        """Whether every token is the encoding of its own bytes, on which the proof of a join rests."""
        return all(self.merge(token) == [rank] for token, rank in self.ranks.items())


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())}


def split_blocks(pattern: regex.Pattern, text: str, block: int = BLOCK_CHARS) -> Iterator[list[str]]:
    """Matches of a pattern that covers every character, in blocks. A match that touches a block's end may go on, so it
    is left for the next block; a match longer than a block widens it."""
    at, width = 0, block
    while at < len(text):
        found = pattern.findall(text, at, min(len(text), at + width))
        if at + width < len(text):
            kept = found[:-2]
            if not kept:
                width *= 2
                continue
            found = kept
        yield found
        at += sum(map(len, found))
        width = block


@lru_cache(2)
def worker(path: str, split: str) -> tuple[TreeBpe, regex.Pattern, dict[str, str], dict[str, bytes]]:
    """One for each Python worker: the coder, the pattern and what pieces were encoded and decoded to."""
    return TreeBpe(read_ranks(path)), regex.compile(split), {}, {}


def digest(text: str, path: str, split: str) -> tuple[int, str, str]:
    """Number of tokens, and SHA-256 of the ids and of the decoded bytes."""
    coder, pattern, ids_of, bytes_of = worker(path, split)
    ids_hash, bytes_hash, n, first = hashlib.sha256(), hashlib.sha256(), 0, True
    for pieces in split_blocks(pattern, text):
        if len(ids_of) > CACHE_PIECES:
            ids_of.clear()
            bytes_of.clear()
        for piece in set(pieces).difference(ids_of):
            ids = coder.encode(piece.encode("utf-8", "replace"))
            ids_of[piece] = " ".join(map(str, ids))
            bytes_of[piece] = coder.decode(ids)
        joined = " ".join(map(ids_of.__getitem__, pieces))
        ids_hash.update((joined if first else " " + joined).encode())
        bytes_hash.update(b"".join(map(bytes_of.__getitem__, pieces)))
        n, first = n + joined.count(" ") + 1, False
    return n, ids_hash.hexdigest(), bytes_hash.hexdigest()


@lru_cache(4)
def proven(path: str) -> None:
    """Fails unless the proof of joins holds for a vocabulary; asked once by the driver, before it encodes with it."""
    if not TreeBpe(read_ranks(path)).self_encoding():
        raise ValueError(f"in {path} some token isn't the encoding of its own bytes, so halves can't be joined safely")


def encode_documents(docs: DataFrame, path: str, split: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Token counts and digests of ids and of decoded bytes for each document; no shuffle."""
    proven(path)
    schema = f"{key} {column_type(docs, key)}, n_tokens long, ids_sha256 string, decoded_sha256 string"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            out = [digest(value.as_py() or "", path, split) for value in batch.column(1)]
            n, ids, decoded = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], names=[key, "n_tokens", "ids_sha256", "decoded_sha256"])
        for known in worker(path, split)[2:]:  # the worker's next task may be of another kind
            known.clear()
        give_back()

    return docs.select(key, text).mapInArrow(run, schema)


def token_ids(docs: DataFrame, path: str, split: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The tokens themselves: (key, tokens array<int>)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, pattern, _, _ = worker(path, split)
        for batch in sliced(batches):
            out = [[t for pieces in split_blocks(pattern, v.as_py() or "") for p in pieces for t in coder.encode(p.encode("utf-8", "replace"))] for v in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int32()))], names=[key, "tokens"])

    return docs.select(key, text).mapInArrow(run, f"{key} {column_type(docs, key)}, tokens array<int>")
