"""Toxicity by a subsequence string-kernel support vector machine with Nystroem landmarks, trained on labelled sentences.

*Kernel.* Two words are alike as far as they share subsequences of three characters, with gaps, weighted by ``DECAY`` to
the power of the stretch they cover (at most ``SPAN``), each word scaled to length one. A gap or an inserted character
lowers a match and doesn't end it. A likeness of ``LEAST`` or more counts with its cube, which leaves little of chance
matches; less counts as none.

*Sentences.* A sentence is like a landmark as far as its nearest word is, words spelled out with separators included. With
the landmarks' own kernel matrix K, the likenesses x of a sentence become ``x K^(-1/2)``, and a linear machine with squared
hinge loss is trained on these vectors: the instances are sentences. Sentences of clean documents are clean. A toxic
document says only that some of its sentences are toxic: at first all count, each with its share of the document, then
those that the machine itself finds, or the document's highest. Toxic sentences are also shown with a character inserted
into, or left out of, the word that gives them away.

*Landmarks.* The words whose documents are toxic more often than chance has it, without those near a stronger one; and the
frequent words of clean documents that are near one of these, so that the machine can tell them apart. What it takes to
be a landmark falls, in ``BARS``, where labels are so few that no word reaches it.

*Documents.* The three highest sentences of a text enter a logistic curve, fitted on the training documents; those that a
short text lacks count as sentences that are near no landmark.

Training is done on at most ``TRAIN_DOCS`` labelled documents of at most ``TRAIN_CHARS`` characters, taken by hash of the
id from those that ``train`` allows; ids, languages and sources are no input. Scoring reads every text whole.

Edge cases: null, empty and wordless texts score as texts near no landmark do; without labels of both kinds, or where toxic documents
have no word that clean ones lack, every score is 0; rows that repeat get the same score; null labels aren't used.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column_type, give_back, sliced

TRAIN_DOCS, TRAIN_CHARS = 5_000, 20_000
LANDMARKS, CLEAN_LANDMARKS = 128, 32
DECAY, SPAN, BITS = 0.7, 5, 18
#: Likeness that counts at all.
LEAST = 0.5
#: What a landmark needs: toxic documents that have it, and standard deviations of their number above chance.
BARS = ((3, 4.0), (3, 3.0), (2, 1.5), (1, 0.0))
#: Words beyond so many characters are read through windows of PART characters, a new one after each STEP.
WINDOW, PART, STEP = 24, 14, 5
#: Distinct words that a worker remembers.
CACHE_WORDS = 300_000
LOW, HIGH = -2.0, 5.0
TOP = 3

OFFSETS = [(a, b) for b in range(2, SPAN) for a in range(1, b)]
SENTENCE = re.compile(r"[.!?]+(?=\s|$)|\n")
SPELLED = re.compile(r"(?<!\w)\w(?:[\W_]{1,3}\w){2,}(?!\w)")
SEPARATORS = re.compile(r"[\W_]+")


def bare(token: str) -> str:
    """A token without punctuation at its ends or inside."""
    return token if token.isalnum() else SEPARATORS.sub("", token)


def spelled_out(text: str) -> list[str]:
    """Words whose letters stand alone, put together."""
    return [SEPARATORS.sub("", m) for m in SPELLED.findall(text)]


def windows(word: str) -> list[str]:
    if len(word) <= WINDOW:
        return [word] if word else []
    return [word[i : i + PART] for i in range(0, len(word) - PART + STEP, STEP)]


def features(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For words of each length: their places in the list, hashed subsequences (a row for each word) and weights, scaled
    so that each word has unit length. Of a subsequence that repeats the first place has all the weight."""
    by_length: dict[int, list[int]] = {}
    for at, word in enumerate(words):
        if word:
            by_length.setdefault(len(word), []).append(at)
    for length, all_places in by_length.items():
        n = length + 2
        for start in range(0, len(all_places), 2048):
            places = np.array(all_places[start : start + 2048])
            codes = np.frombuffer("".join([f"^{words[p]}$" for p in places]).encode("utf-32-le", "replace"), np.uint32).reshape(len(places), n).astype(np.uint64)
            x, y, z = (codes * np.uint64(f) for f in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
            fit = [(a, b) for a, b in OFFSETS if n > b]
            hashed = np.hstack([((x[:, : n - b] + y[:, a : n - b + a] + z[:, b:]) >> np.uint64(64 - BITS)).astype(np.int32) for a, b in fit])
            weight = np.hstack([np.full(n - b, DECAY ** (b + 1), np.float32) for _, b in fit])
            order = np.argsort(hashed, axis=1)
            hashed, weight = np.take_along_axis(hashed, order, 1), weight[order]
            new = np.ones(hashed.shape, bool)
            new[:, 1:] = hashed[:, 1:] != hashed[:, :-1]
            starts = np.flatnonzero(new)
            sums = np.add.reduceat(weight.ravel(), starts)
            squares = np.add.reduceat(sums * sums, np.r_[0, np.cumsum(new.sum(axis=1))[:-1]])
            merged = np.zeros(hashed.size, np.float32)
            merged[starts] = sums
            yield places, hashed, merged.reshape(hashed.shape) / np.sqrt(squares)[:, None]


#: What a word says: the margin of a sentence that has it alone, and its landmarks with their values; None if it has none.
Hit = tuple[float, np.ndarray, np.ndarray] | None


@dataclass
class Landmarks:
    """For each hashed subsequence, a row of the table, or 0 where no landmark has it; a column for each landmark."""

    row: np.ndarray
    table: np.ndarray

    @staticmethod
    def of(words: list[str]) -> Landmarks:
        found = list(features(words))
        present = np.unique(np.concatenate([h.ravel() for _, h, _ in found])) if found else np.empty(0, np.int32)
        row = np.zeros(1 << BITS, np.int32)
        row[present] = np.arange(1, len(present) + 1)
        table = np.zeros((len(present) + 1, len(words)), np.float32)
        for places, hashed, weight in found:
            np.add.at(table, (row[hashed], places[:, None]), weight)
        return Landmarks(row, table)

    def likeness(self, words: list[str]) -> np.ndarray:
        """The kernel with each landmark. A word whose subsequences that landmarks have are shorter than LEAST can't reach
        it with any, so the test before the product changes nothing."""
        out = np.zeros((len(words), self.table.shape[1]), np.float32)
        for places, hashed, weight in features(words):
            rows = self.row[hashed]
            near = ((weight * (rows > 0)) ** 2).sum(axis=1) >= LEAST**2 - 1e-6
            for k in range(0, int(near.sum()), 256):
                at = np.flatnonzero(near)[k : k + 256]
                out[places[at]] = np.einsum("rsm,rs->rm", self.table[rows[at]], weight[at])
        return np.where(out >= LEAST, out**3, np.float32(0))


@dataclass
class Machine:
    """Landmarks, their weights and offset in the machine of sentences, and the logistic curve of documents."""

    landmarks: Landmarks
    weights: np.ndarray
    offset: float
    curve: np.ndarray

    def margin(self, at: np.ndarray, value: np.ndarray) -> float:
        return min(HIGH, max(LOW, float(value @ self.weights[at]) + self.offset))

    def hits(self, words: list[str]) -> list[Hit]:
        out: list[Hit] = []
        for k in range(0, len(words), 8192):  # a table of words by landmarks is made for so many words at a time
            some = words[k : k + 8192]
            found = self.landmarks.likeness([w if len(w) <= WINDOW else "" for w in some])
            for at, word in enumerate(some):
                if len(word) > WINDOW:
                    found[at] = self.landmarks.likeness(windows(word)).max(axis=0)
            any_hit = found.any(axis=1)
            for row, hit in zip(found, any_hit.tolist(), strict=True):
                if not hit:
                    out.append(None)
                    continue
                at = np.flatnonzero(row).astype(np.int16)
                out.append((self.margin(at, row[at]), at, row[at].copy()))
        return out

    def sentence(self, hits: list[Hit]) -> float:
        """The margin of a sentence from what its words say: of each landmark the nearest word counts."""
        if not hits:
            return min(HIGH, max(LOW, self.offset))
        if len(hits) == 1:
            return hits[0][0]
        pooled = pool(hits, len(self.weights))
        return min(HIGH, max(LOW, float(pooled @ self.weights) + self.offset))

    def score(self, tops: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(tops @ self.curve[:-1] + self.curve[-1])))


def pool(hits: list[Hit], size: int) -> np.ndarray:
    out = np.zeros(size, np.float32)
    for _, at, value in hits:
        out[at] = np.maximum(out[at], value)
    return out


def parsed(text: str) -> list[list[str]]:
    """The tokens of each sentence of a lower-case text; each spelled-out word is one more."""
    out = [tokens for s in SENTENCE.split(text) if (tokens := s.split())]
    out += [[word] for word in spelled_out(text)]
    return out


def top_sentences(sentences: list[list[str]], cache: dict[str, Hit], machine: Machine) -> list[float]:
    """The TOP highest sentence margins; the cache knows all tokens."""
    get = cache.__getitem__
    found = [machine.sentence([h for h in map(get, tokens) if h is not None]) for tokens in sentences]
    found.sort(reverse=True)
    return found[:TOP] + [machine.sentence([])] * (TOP - len(found))


def remember(machine: Machine, texts: list[list[list[str]]], cache: dict[str, Hit]) -> None:
    """Adds what tokens say that the cache lacks."""
    fresh = list({t for text in texts for tokens in text for t in tokens}.difference(cache))
    if fresh:
        cache.update(zip(fresh, machine.hits([bare(t) for t in fresh]), strict=True))


def squared_hinge(x: np.ndarray, root: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0, rounds: int = 12) -> tuple[np.ndarray, float]:
    """Newton's method on the active set, for the rows of ``x @ root`` and an offset. Sums of products are taken from a few
    thousand rows at a time and turned by the root afterwards, so that no second table as large as ``x`` is made. Gives the
    weights of x's columns, and the offset."""
    n = x.shape[1]
    turned = np.eye(n + 1)
    turned[:n, :n] = root
    penalty = ridge * np.eye(n + 1)
    penalty[-1, -1] = 1e-6
    active = np.ones(len(x), bool)
    for _ in range(rounds):
        gram, right = np.zeros((n + 1, n + 1)), np.zeros(n + 1)
        for k in range(0, len(x), 4096):
            at = k + np.flatnonzero(active[k : k + 4096])
            some = np.hstack([x[at], np.ones((len(at), 1))])
            weighted = some.T * weight[at]
            gram += weighted @ some
            right += weighted @ y[at]
        beta = turned @ np.linalg.solve(penalty + turned.T @ gram @ turned, turned.T @ right)
        now = y * (x @ beta[:-1].astype(np.float32) + beta[-1]) < 1
        if (now == active).all():
            break
        active = now
    return beta[:-1], float(beta[-1])


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, rounds: int = 25) -> np.ndarray:
    x = np.hstack([x, np.ones((len(x), 1))])
    beta = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        beta += np.linalg.solve(ridge * np.eye(len(beta)) + (x * (p * (1 - p) + 1e-9)[:, None]).T @ x, x.T @ (y - p) - ridge * beta)
    return beta


def disguised(word: str, turn: np.random.Generator) -> list[str]:
    """A word with a character inserted and with one left out."""
    if len(word) < 4:
        return []
    i, j = turn.integers(1, len(word), 2)
    return [word[:i] + chr(turn.integers(97, 123)) + word[i:], word[: j - 1] + word[j:]]


@dataclass
class Corpus:
    """Training documents as numbers: words, the words of all sentences one after the other, where each sentence starts and the
    document it is of, and the label of each document."""

    words: list[str]
    tokens: np.ndarray
    starts: np.ndarray
    document: np.ndarray
    label: np.ndarray

    @staticmethod
    def of(texts: Iterable[str], labels: Iterable[int]) -> Corpus:
        once = {t.lower(): int(y) for t, y in zip(texts, labels, strict=True)}  # copies teach nothing more
        number: dict[str, int] = {}
        tokens, sizes, document = [], [], []
        for k, text in enumerate(once):
            of_text: list[int] = []
            for sentence in parsed(text):
                found = {number.setdefault(w, len(number)) for t in sentence if (w := bare(t))}
                if found:
                    of_text += found
                    sizes.append(len(found))
                    document.append(k)
            tokens.append(np.array(of_text, np.int32))
        return Corpus(list(number), np.concatenate([np.empty(0, np.int32), *tokens]), np.r_[0, np.cumsum(sizes, dtype=np.int64)].astype(np.int64), np.array(document, np.int32), np.array(list(once.values()), float))


def landmark_words(corpus: Corpus) -> list[str]:
    """Words that speak for toxicity, none near a stronger one, and clean words near one of them."""
    n_words, n_docs = len(corpus.words), len(corpus.label)
    toxic, clean = np.zeros(n_words), np.zeros(n_words)
    first = np.flatnonzero(np.r_[True, corpus.document[1:] != corpus.document[:-1]])
    for a, b in zip(first, [*first[1:], len(corpus.document)], strict=True):
        has = np.unique(corpus.tokens[corpus.starts[a] : corpus.starts[b]])
        (toxic if corpus.label[corpus.document[a]] else clean)[has] += 1
    chance = (toxic + clean) * corpus.label.sum() / n_docs
    strength = (toxic - chance) / np.sqrt(chance)
    short = np.array([len(w) <= WINDOW for w in corpus.words])
    order = sorted(np.flatnonzero(short & (toxic > chance)), key=lambda w: (-strength[w], corpus.words[w]))
    ranked: list[int] = []
    for count, bar in BARS:
        ranked = ranked or [w for w in order if toxic[w] >= count and strength[w] > bar][: 8 * LANDMARKS]
    if not ranked:
        return []
    names = [corpus.words[w] for w in ranked]
    alike = Landmarks.of(names).likeness(names)
    chosen: list[int] = []
    for k in range(len(ranked)):
        if len(chosen) < LANDMARKS - CLEAN_LANDMARKS and (not chosen or alike[k, chosen].max() < 0.5):
            chosen.append(k)
    insults = [names[k] for k in chosen]
    taken = set(ranked)
    common = [w for w in np.argsort(-clean, kind="stable")[: 100 * LANDMARKS].tolist() if clean[w] > 1 and short[w] and w not in taken]
    near = Landmarks.of(insults).likeness([corpus.words[w] for w in common]).max(axis=1, initial=0)
    return insults + [corpus.words[w] for w, x in zip(common, near, strict=True) if x > 0][:CLEAN_LANDMARKS]


def train(texts: list[str], labels: list[int]) -> Machine:
    return learned(Corpus.of(texts, labels))


def sentence_vectors(corpus: Corpus, machine: Machine) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sentences that are near a landmark, the vectors of these and of disguised toxic ones, and which sentence each disguise is of."""
    hits = machine.hits(corpus.words)
    label = corpus.label[corpus.document]
    told = np.array([h is not None for h in hits], bool)[corpus.tokens]
    at = np.unique(np.searchsorted(corpus.starts, np.flatnonzero(told), side="right") - 1)
    turn = np.random.default_rng(7)
    size = len(machine.weights)
    plain = np.zeros((len(at), size), np.float32)
    shown, of = [], []
    for row, k in enumerate(at.tolist()):
        heard = [(w, hits[w]) for w in corpus.tokens[corpus.starts[k] : corpus.starts[k + 1]].tolist() if hits[w] is not None]
        plain[row] = pool([h for _, h in heard], size)
        if label[k]:  # the strongest word disguised
            word, _ = max(heard, key=lambda h: float(h[1][2].max()))
            others = [h for w, h in heard if w != word]
            for other in machine.hits(disguised(corpus.words[word], turn)):
                shown.append(pool([*others, other] if other else others, size))
                of.append(row)
    return at, np.vstack([plain, *shown, np.zeros((2, size), np.float32)]), np.array(of, int)


def learned(corpus: Corpus) -> Machine:
    never = Machine(Landmarks.of(["-"]), np.zeros(1, np.float32), LOW, np.array([0.0] * TOP + [-30.0]))
    if not len(corpus.document) or corpus.label.min() == corpus.label.max():
        return never
    names = landmark_words(corpus)
    if not names:
        return never
    landmarks = Landmarks.of(names)
    values, vectors = np.linalg.eigh(landmarks.likeness(names).astype(float) + 1e-3 * np.eye(len(names)))
    root = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-3))) @ vectors.T
    machine = Machine(landmarks, np.zeros(len(names), np.float32), 0.0, never.curve)

    # sentences that are near no landmark are all alike, and are one instance with their number as weight
    at, every, of = sentence_vectors(corpus, machine)
    x = every[: len(at)]
    label = corpus.label[corpus.document]
    share = 1 / np.bincount(corpus.document, minlength=len(corpus.label))[corpus.document]
    positive = label[at] == 1
    weight = np.where(positive, share[at] * len(at) / max(1, len(corpus.label)), 1.0)
    untold = (label == 0).sum() - (label[at] == 0).sum()
    for _ in range(3):
        sign = np.r_[np.where(positive, 1.0, -1.0), np.ones(len(of)), 1.0, -1.0]
        left_out = (label[at] == 1) & ~positive
        w = np.r_[np.where(left_out, 0.0, weight), 0.25 * np.where(positive, weight, 0.0)[of], 0.0, untold]
        for side in (1.0, -1.0):  # both kinds weigh alike
            w[sign == side] *= len(at) / 2 / max(1e-9, w[sign == side].sum())
        weights, machine.offset = squared_hinge(every, root, sign, w)
        machine.weights = weights.astype(np.float32)
        margin = x @ machine.weights + machine.offset
        best = np.full(len(corpus.label), -np.inf)
        np.maximum.at(best, corpus.document[at], margin)
        positive = (label[at] == 1) & ((margin > 0) | (margin >= best[corpus.document[at]]))
        weight = np.ones(len(at))
    # documents
    of_sentence = np.full(len(corpus.document), machine.offset)
    of_sentence[at] = x @ machine.weights + machine.offset
    of_sentence = np.clip(of_sentence, LOW, HIGH)
    order = np.lexsort((-of_sentence, corpus.document))
    first = np.flatnonzero(np.r_[True, corpus.document[order][1:] != corpus.document[order][:-1]])
    nth = np.arange(len(order)) - np.repeat(first, np.diff(np.r_[first, len(order)]))
    tops = np.full((len(corpus.label), TOP), machine.sentence([]))
    kept = nth < TOP
    tops[corpus.document[order][kept], nth[kept]] = of_sentence[order][kept]
    machine.curve = logistic(tops, corpus.label)
    return machine


def fit(docs: DataFrame, labels: DataFrame, label: str, allowed: Column, key: str = "doc_id", text: str = "text") -> Machine:
    """Trains on the driver with a bounded sample of labelled rows that ``allowed`` lets through."""
    known = labels.where(allowed & F.col(label).isNotNull() & F.col(key).isNotNull()).select(key, F.col(label).cast("int").alias("y"))
    some = known.orderBy(F.xxhash64(F.col(key).cast("string")), key).limit(TRAIN_DOCS).dropDuplicates([key])
    rows = docs.where(F.length(text) <= TRAIN_CHARS).select(key, F.col(text).alias("t")).join(F.broadcast(some), key).select("t", "y").collect()  # TRAIN_DOCS rows by TRAIN_CHARS
    rows.sort()
    corpus = Corpus.of((r["t"] for r in rows), (r["y"] for r in rows))
    del rows
    give_back()
    machine = learned(corpus)
    del corpus
    give_back()  # the driver lives on for other stages
    return machine


def scores(texts: list[str], machine: Machine, cache: dict[str, Hit]) -> np.ndarray:
    if len(cache) > CACHE_WORDS:
        cache.clear()
    read = [parsed(t.lower()) for t in texts]
    remember(machine, read, cache)
    return machine.score(np.array([top_sentences(t, cache, machine) for t in read]).reshape(len(texts), TOP))


#: Characters of texts that are scored together.
CHUNK_CHARS = 1_000_000


def in_chunks(values: Iterable[str]) -> Iterator[list[str]]:
    held, size = [], 0
    for value in values:
        held.append(value)
        size += len(value)
        if size > CHUNK_CHARS:
            yield held
            held, size = [], 0
    if held:
        yield held


def score(docs: DataFrame, machine: Machine, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score) of each row; no shuffle."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, Hit] = {}
        for batch in sliced(batches):
            found = [scores(chunk, machine, cache) for chunk in in_chunks(v.as_py() or "" for v in batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(found) if found else [], pa.float64())], names=[key, "score"])

    return docs.select(key, text).mapInArrow(run, f"{key} {column_type(docs, key)}, score double")


def keep_clean(docs: DataFrame, machine: Machine, limit: float = 0.5, text: str = "text") -> DataFrame:
    """The rows of ``docs``, with their columns, that score below the limit."""
    at = docs.columns.index(text)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, Hit] = {}
        for batch in sliced(batches):
            found = [scores(chunk, machine, cache) for chunk in in_chunks(v.as_py() or "" for v in batch.column(at))]
            yield batch.filter(pa.array(np.concatenate(found) < limit)) if found else batch

    return docs.mapInArrow(run, docs.schema)
