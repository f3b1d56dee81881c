"""Small documents and plain, slow versions of the operators."""

from __future__ import annotations

import random
from collections import defaultdict

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "src0", None if t is None else len(t)) for i, t in zip(ids, texts, strict=True)], DOCS)


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def shingle_set(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return frozenset()
    return frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4)))


def components(ids, texts):
    """id -> smallest id reachable, by comparing all pairs."""
    parent = {i: i for i in ids if i is not None}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    rows = [(i, shingle_set(t)) for i, t in zip(ids, texts, strict=True) if i is not None]
    for n, (i, a) in enumerate(rows):
        for j, b in rows[:n]:
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return {i: root(i) for i in parent}


def near_copies(seed, families=6, members=12, words=60, edits=6, alone=20):
    """Texts in families of random distance, and texts that share a passage alone."""
    turn = random.Random(seed)
    word = lambda: "".join(turn.choice("abcdefgh") for _ in range(turn.randint(2, 6)))
    passage = [word() for _ in range(30)]
    texts = []
    for _ in range(families):
        base = [word() for _ in range(turn.randint(8, words))]
        for _ in range(members):
            copy = list(base)
            for _ in range(turn.randint(0, edits)):
                copy[turn.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    for _ in range(alone):
        texts.append(" ".join([word() for _ in range(turn.randint(5, 80))] + passage))
    turn.shuffle(texts)
    return texts


def grouped(pairs):
    out = defaultdict(set)
    for a, b in pairs:
        out[b].add(a)
    return {frozenset(v) for v in out.values()}
