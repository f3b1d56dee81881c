"""Token counts by a count-only Viterbi search over a unigram vocabulary.

The vocabulary are pieces with scores, read from a SentencePiece file as a unigram model. A text gets a leading mark and
each space becomes the mark (U+2581), as the file's normaliser does. An Aho-Corasick automaton names the pieces that end at
each character; for every position the search carries the best score and the number of pieces on that path, and no path
is kept. Ties follow the tokenizer: paths are tried by ascending start, and only a higher score replaces one, so of equal
paths the one whose last piece is longest stands. A character that is no piece costs the least score less a penalty, and
counts one piece for each byte of its UTF-8 form, as byte fallback makes of it.

Pieces hold the mark at their start alone, or are runs of marks. So no piece crosses from another character to a mark, and a
text's search is the sum of searches over its runs of marks with the characters that follow, which are remembered by worker.
Scores are added in that order exactly where they are whole numbers, as here.

Edge cases: null and empty texts have no tokens and score 0; rows that repeat give rows that repeat; texts of any length
are read run by run.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from .common import column_type

MARK = "▁"
#: How far an unknown character lies below the least score.
UNKNOWN_PENALTY = 10.0
CACHE_RUNS = 500_000
RUN = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


class CountViterbi:
    """Best score and count of pieces; ``pieces`` maps each piece to its score."""

    def __init__(self, pieces: dict[str, float]):
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("a piece holds the mark behind another character")
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces.items():
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(pieces.values()) - UNKNOWN_PENALTY
        self.single = {p: s for p, s in pieces.items() if len(p) == 1}

    def search(self, run: str) -> tuple[float, int]:
        """Score and number of pieces of the best path over a run."""
        score: list[float | None] = [0.0] + [None] * len(run)
        count = [0] * (len(run) + 1)
        ends: dict[int, list[tuple[int, float]]] = {}
        for last, found in self.automaton.iter(run):
            ends.setdefault(last + 1, []).append(found)
        for end in range(1, len(run) + 1):
            # longer pieces start earlier, and earlier starts are tried first
            options = sorted(ends.get(end, ()), reverse=True)
            best, n = None, 0
            for length, gain in options:
                now = score[end - length] + gain
                if best is None or now > best:
                    best, n = now, count[end - length] + 1
            char = run[end - 1]
            if char not in self.single:
                now = score[end - 1] + self.unknown
                if best is None or now > best:
                    best, n = now, count[end - 1] + len(char.encode("utf-8", "replace"))
            score[end], count[end] = best, n
        return score[-1], count[-1]


def read_pieces(path: str) -> dict[str, float]:
    """Pieces of a SentencePiece file that text can match: neither control nor unknown nor byte pieces."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    kept = [i for i in range(model.vocab_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    return {model.id_to_piece(i): model.get_score(i) for i in kept}


@lru_cache(2)
def worker(path: str) -> tuple[CountViterbi, dict[str, tuple[float, int]]]:
    return CountViterbi(read_pieces(path)), {}


def count(text: str, path: str) -> tuple[int, float]:
    """Number of pieces of a text, and the score of its best path."""
    search, known = worker(path)
    n, total = 0, 0.0
    if not text:
        return n, total
    if len(known) > CACHE_RUNS:
        known.clear()
    runs = RUN.findall(MARK + text.replace(" ", MARK))
    for run in set(runs).difference(known):
        known[run] = search.search(run)
    for gain, pieces in map(known.__getitem__, runs):
        total += gain
        n += pieces
    return n, total


def count_tokens(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, best_score) of each document; no shuffle."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [count(value.as_py() or "", path) for value in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, _ in found], pa.int64()), pa.array([s for _, s in found], pa.float64())], names=[key, "n_tokens", "best_score"])

    return docs.select(key, text).mapInArrow(run, f"{key} {column_type(docs, key)}, n_tokens long, best_score double")
