"""Main text of web pages by a recurrent labeller of blocks.

A page is cut into its leaf blocks: runs of text between block-level tags, with the path of tags above them. Each block
becomes a vector of its hashed tag path (tags, their classes and ids, and the innermost pair of tags), of its hashed words,
and of a few shapes (length, share of links, place). A bidirectional LSTM in numpy reads the sequence of a page's blocks,
so that each label draws on the whole page, and says for every block whether it is main text.

The model is trained here, on the driver, on at most ``TRAIN_PAGES`` different pages, taken by hash of their html, of at
most ``TRAIN_CHARS`` characters, and on variants of them in which the same texts stand in other containers among other
surroundings. No table has labels for blocks; the labels to learn from come from what tags and names declare (``declared``).
The executors get the weights, whose size is fixed. Extraction reads every page whole; no shuffle. Paths are nodes of a
tree that know their parents, so that work follows a page's length, however deep it is.

Edge cases: null and empty pages and pages without main text give an empty text; unclosed and stray tags are tolerated;
an unfinished tag or comment ends the page; rows that repeat give rows that repeat; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column_type

TRAIN_PAGES, TRAIN_CHARS, VARIANTS = 240, 60_000, 3
PATH_DIM, WORD_DIM, SHAPES, HIDDEN = 64, 24, 6, 16
EPOCHS, BATCH, RATE = 14, 24, 0.02
#: Blocks, with padding, that are labelled at a time, unless one page has more.
BATCH_BLOCKS = 50_000

INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea iframe svg math object canvas".split())
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

OUTSIDE_TAGS = frozenset("head title nav footer aside form button select option dialog menu".split())
OUTSIDE_NAMES = frozenset(
    "ad ads advert adverts advertisement sponsor sponsored promo promotion banner cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe signup login share sharing social "
    "comment comments reply replies discussion disqus respond sidebar widget rail menu navbar nav navigation breadcrumb breadcrumbs pagination pager toolbar footer header masthead topbar related recommended "
    "trending".split()
)
MAIN_TAGS = frozenset(("article", "main"))
MAIN_NAMES = frozenset("article content main post entry story articlebody maincontent text body".split())
TEXT_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre td th dd dt".split())

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*)(?:>|\Z)|([^<]+|<)""", re.S)
NAMES = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
NAME_PARTS = re.compile(r"[a-z0-9]+")


@lru_cache(10_000)
def names_of(attributes: str) -> tuple[str, ...]:
    """Lower-case words of an element's class, id and role."""
    found = " ".join(a or b or c for a, b, c in NAMES.findall(attributes)).lower()
    return tuple(NAME_PARTS.findall(found))


@lru_cache(200_000)
def slot(word: str, size: int) -> int:
    return zlib.crc32(word.encode("utf-8", "replace")) % size


class Node:
    """A path of tags with their names: the last of them, and the path above. Equal paths are one node of their tree."""

    __slots__ = ("tag", "names", "parent", "children", "counts", "vector")

    def __init__(self, tag: str, names: tuple[str, ...], parent: Node | None):
        self.tag, self.names, self.parent = tag, names, parent
        self.children: dict[tuple, Node] = {}
        self.counts = np.zeros(PATH_DIM, np.float32) if parent is None else parent.counts.copy()
        self.vector: np.ndarray | None = None
        if parent is not None:
            self.counts[slot("<" + tag, PATH_DIM)] += 1
            for name in names:
                self.counts[slot("." + name, PATH_DIM)] += 1

    def below(self, tag: str, names: tuple[str, ...]) -> Node:
        node = self.children.get((tag, names))
        if node is None:
            Tree.nodes += 1
            node = self.children[tag, names] = Node(tag, names, self)
        return node

    def path(self) -> tuple[tuple[str, tuple[str, ...]], ...]:
        out, node = [], self
        while node.parent is not None:
            out.append((node.tag, node.names))
            node = node.parent
        return tuple(reversed(out))

    def described(self) -> np.ndarray:
        """Hashed tags, names, and the innermost pair of tags."""
        if self.vector is None:
            out = self.counts.copy()
            above = self.parent
            pair = self.tag if above is None or above.parent is None else f"{above.tag}/{self.tag}"
            out[slot(pair, PATH_DIM)] += 1
            self.vector = np.minimum(out, 2)
        return self.vector


class Tree:
    """The paths that this process has met; it starts anew beyond MOST, between pages."""

    MOST = 20_000
    nodes = 0
    root: Node | None = None

    @classmethod
    def start(cls) -> Node:
        if cls.root is None or cls.nodes > cls.MOST:
            cls.root, cls.nodes = Node("", (), None), 0
        return cls.root


def node_of(path: tuple[tuple[str, tuple[str, ...]], ...]) -> Node:
    node = Tree.start()
    for tag, names in path:
        node = node.below(tag, names)
    return node


@dataclass
class Block:
    node: Node
    text: str
    link_chars: int = 0

    @property
    def path(self) -> tuple[tuple[str, tuple[str, ...]], ...]:
        return self.node.path()


@dataclass
class Reader:
    """Reads a page into blocks. Each open element has the node of its path; where the open ones of a tag are, is kept by tag."""

    stack: list[tuple[str, Node]] = field(default_factory=list)
    places: dict[str, list[int]] = field(default_factory=dict)
    pieces: list[str] = field(default_factory=list)
    blocks: list[Block] = field(default_factory=list)
    link_chars: int = 0
    root: Node = field(default_factory=Tree.start)

    def here(self) -> Node:
        return self.stack[-1][1] if self.stack else self.root

    def open(self, tag: str, names: tuple[str, ...] | None) -> None:
        """Opens an element; inline ones, without names, add nothing to the path."""
        self.places.setdefault(tag, []).append(len(self.stack))
        self.stack.append((tag, self.here() if names is None else self.here().below(tag, names)))

    def end_block(self) -> None:
        if self.pieces:
            text = " ".join("".join(self.pieces).split())
            if text:
                self.blocks.append(Block(self.here(), text, self.link_chars))
            self.pieces, self.link_chars = [], 0

    def last(self, tags: Iterable[str]) -> int:
        return max((at[-1] for t in tags if (at := self.places.get(t))), default=-1)

    def close(self, tags: set[str], stop: frozenset[str] = frozenset()) -> None:
        """Closes the last open one of the tags with all inside, unless an element to stop at is inside."""
        at = self.last(tags)
        if at < 0 or self.last(stop) > at:
            return
        while len(self.stack) > at:
            self.places[self.stack.pop()[0]].pop()

    def read(self, page: str) -> list[Block]:
        at = 0
        while match := TOKEN.match(page, at):
            at = match.end()
            cdata, closing, tag, attributes, text = match.groups()
            if text is not None:
                self.pieces.append(unescape(text))
                if self.places.get("a"):
                    self.link_chars += len(text)
            elif cdata is not None:
                self.pieces.append(cdata)
            elif tag:
                tag = tag.lower()
                if tag == "br":
                    self.pieces.append(" ")
                elif tag in INLINE:
                    if closing:
                        self.close({tag}, TEXT_TAGS)
                    elif tag not in VOID:
                        self.open(tag, None)
                else:
                    self.end_block()
                    if closing:
                        self.close({tag})
                    elif tag in RAW:
                        if not attributes.rstrip().endswith("/"):
                            raw = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
                            at = raw.end() if raw else len(page)
                    elif tag not in VOID:
                        self.close(CLOSES.get(tag, set()), frozenset(("ul", "ol", "dl", "table")) if tag != "p" else frozenset())
                        self.open(tag, names_of(attributes))
            if at >= len(page):
                break
        self.end_block()
        return self.blocks


def blocks_of(page: str | None) -> list[Block]:
    return Reader().read(page) if page else []


def declared(blocks: list[Block]) -> list[bool]:
    """What tags and names declare to be main text."""
    paths = [b.path for b in blocks]
    inside = [any(t in MAIN_TAGS or not MAIN_NAMES.isdisjoint(n) for t, n in path if t not in ("html", "body")) for path in paths]
    some = any(inside)
    out = []
    for path, within in zip(paths, inside, strict=True):
        main_at = max((k for k, (t, _) in enumerate(path) if t in MAIN_TAGS), default=-1)
        outside = any(t in OUTSIDE_TAGS or (t == "header" and main_at < 0) or not OUTSIDE_NAMES.isdisjoint(n) for t, n in path)
        out.append(not outside and (within if some else bool(path) and path[-1][0] in TEXT_TAGS))
    return out


def vectors(blocks: list[Block]) -> np.ndarray:
    out = np.zeros((len(blocks), PATH_DIM + WORD_DIM + SHAPES), np.float32)
    for k, block in enumerate(blocks):
        out[k, :PATH_DIM] = block.node.described()
        words = block.text.lower().split()
        counts = np.bincount([slot(w, WORD_DIM) for w in words], minlength=WORD_DIM)
        out[k, PATH_DIM : PATH_DIM + WORD_DIM] = counts / max(1, len(words)) ** 0.5 / 4
        n = len(block.text)
        out[k, PATH_DIM + WORD_DIM :] = np.log1p(n) / 5, np.log1p(len(words)) / 4, min(1.0, block.link_chars / n), k / len(blocks), (len(blocks) - k) / len(blocks), block.text[-1] in ".!?"
    return out


@dataclass
class Labeller:
    """Weights of both directions (input, recurrent, bias) and of the output."""

    weights: list[np.ndarray]

    @staticmethod
    def fresh(turn: np.random.Generator) -> Labeller:
        d = PATH_DIM + WORD_DIM + SHAPES
        one = lambda: [turn.normal(0, d**-0.5, (d, 4 * HIDDEN)), turn.normal(0, HIDDEN**-0.5, (HIDDEN, 4 * HIDDEN)), np.r_[np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)]]
        return Labeller([w.astype(np.float32) for w in [*one(), *one(), turn.normal(0, 0.3, 2 * HIDDEN), np.zeros(1)]])

    def run(self, x: np.ndarray, mask: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
        """x: pages x blocks x features, padded. Chances for each block, and what training needs again."""
        n, t, _ = x.shape
        states, tapes = [], []
        for way in (0, 1):
            w, u, b = self.weights[3 * way : 3 * way + 3]
            ahead = x @ w + b
            h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
            hs, tape = np.zeros((n, t, HIDDEN), np.float32), []
            for k in range(t) if way == 0 else range(t - 1, -1, -1):
                z = ahead[:, k] + h @ u
                gates = 1 / (1 + np.exp(-np.clip(z[:, : 3 * HIDDEN], -30, 30)))
                i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
                g = np.tanh(z[:, 3 * HIDDEN :])
                m = mask[:, k, None]  # padding leaves the state as it is
                c_new = np.where(m, f * c + i * g, c)
                tanh_c = np.tanh(c_new)
                h_new = np.where(m, o * tanh_c, h)
                if keep:
                    tape.append((k, h, c, i, f, o, g, tanh_c, m))
                h, c = h_new, c_new
                hs[:, k] = h
            states.append(hs)
            tapes.append(tape)
        both = np.concatenate(states, axis=2)
        out = 1 / (1 + np.exp(-np.clip(both @ self.weights[6] + self.weights[7], -30, 30)))
        return out, [both, tapes]

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
        p, (both, tapes) = self.run(x, mask, keep=True)
        total = max(1, mask.sum())
        loss = -float((np.log(np.where(y > 0.5, p, 1 - p) + 1e-9) * mask).sum() / total)
        error = (p - y) * mask / total
        out = [np.zeros_like(w) for w in self.weights]
        out[6], out[7] = np.tensordot(error, both, ((0, 1), (0, 1))), np.array([error.sum()], np.float32)
        back = error[:, :, None] * self.weights[6]
        for way in (0, 1):
            w, u, _ = self.weights[3 * way : 3 * way + 3]
            dh, dc = np.zeros((len(x), HIDDEN), np.float32), np.zeros((len(x), HIDDEN), np.float32)
            for k, h, c, i, f, o, g, tanh_c, m in reversed(tapes[way]):
                dh = dh + back[:, k, way * HIDDEN : (way + 1) * HIDDEN]
                inner = dc + dh * o * (1 - tanh_c**2)
                dz = np.hstack([inner * g * i * (1 - i), inner * c * f * (1 - f), dh * tanh_c * o * (1 - o), inner * i * (1 - g**2)]) * m
                out[3 * way] += x[:, k].T @ dz
                out[3 * way + 1] += h.T @ dz
                out[3 * way + 2] += dz.sum(axis=0)
                dh, dc = np.where(m, dz @ u.T, dh), np.where(m, inner * f, dc)
        return loss, out

    def chances(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """For each page, the chance of each block; pages of like length are run together."""
        out: list[np.ndarray] = [np.empty(0)] * len(pages)
        order = [k for k in sorted(range(len(pages)), key=lambda k: len(pages[k])) if len(pages[k])]
        at = 0
        while at < len(order):
            some = order[at : at + 64]
            while len(some) > 1 and (len(pages[some[-1]]) > 2 * len(pages[some[0]]) + 16 or len(some) * len(pages[some[-1]]) > BATCH_BLOCKS):
                some = some[: len(some) // 2]
            x, mask, _ = padded([pages[k] for k in some], None)
            p, _ = self.run(x, mask)
            for row, k in enumerate(some):
                out[k] = p[row, : len(pages[k])]
            at += len(some)
        return out


def padded(pages: list[np.ndarray], labels: list | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    longest = max(map(len, pages))
    x, mask, y = np.zeros((len(pages), longest, pages[0].shape[1]), np.float32), np.zeros((len(pages), longest), bool), np.zeros((len(pages), longest), np.float32)
    for k, page in enumerate(pages):
        x[k, : len(page)], mask[k, : len(page)] = page, True
        if labels is not None:
            y[k, : len(page)] = labels[k]
    return x, mask, y


def variant(blocks: list[Block], main: list[bool], turn: np.random.Generator) -> tuple[list[Block], list[bool]]:
    """The same texts in another container, with other surroundings between and around them."""
    pick = lambda options: options[turn.integers(len(options))]
    body = (("html", ()), ("body", ()))
    holder = pick([(("article", ()),), (("main", ()),), (("main", ("content",)), ("article", ("post",))), (("div", ("post", "content")),), (("section", ("article", "body")),), (("div", ("entry", "content")),), (("div", ("main", "content")), ("article", ()))])
    around = [
        (("nav", ()), ("ul", ()), ("li", ())), (("header", ("site", "header")), ("p", ())), (("header", ()),), (("footer", ()),), (("footer", ()), ("p", ())), (("aside", ("sidebar",)), ("p", ())), (("div", ("sidebar",)), ("ul", ()), ("li", ())),
        (("div", ("ad",)),), (("div", ("ads", "banner")), ("p", ())), (("div", ("cookie", "notice")), ("p", ())), (("form", ()), ("p", ())), (("form", ("newsletter",)), ("div", ())), (("section", ("comments",)), ("p", ())), (("div", ("comments",)), ("div", ("comment",)), ("p", ())),
        (("div", ("comment",)), ("p", ())), (("ul", ("menu",)), ("li", ())), (("div", ("related",)), ("li", ())), (("div", ("share", "social")), ("li", ())), (("div", ("breadcrumb",)), ("li", ())),
    ]
    out: list[Block] = []
    labels: list[bool] = []
    texts = [b.text for b in blocks]

    def surround(within: tuple) -> None:
        where = within + pick(around)
        for _ in range(turn.integers(1, 5)):
            words = pick(texts).split()
            text = " ".join(words[: turn.integers(1, 30)])
            linked = len(text) if where[-1][0] == "li" and turn.random() < 0.8 else 0
            out.append(Block(node_of(where), text, linked))
            labels.append(False)

    for _ in range(turn.integers(1, 4)):
        surround(body)
    for block, is_main in zip(blocks, main, strict=True):
        if is_main:
            if turn.random() < 0.1:
                surround(body + holder)
            out.append(Block(node_of(body + holder + ((block.node.tag if block.node.tag in TEXT_TAGS else "p", ()),)), block.text, block.link_chars))
            labels.append(True)
    if turn.random() < 0.6:  # comments and notices often close an article inside its container
        surround(body + holder)
    for _ in range(turn.integers(1, 4)):
        surround(body)
    return out, labels


def train(pages: list[str]) -> Labeller:
    turn = np.random.default_rng(11)
    model = Labeller.fresh(turn)
    made = []
    for page in pages:
        blocks = blocks_of(page)
        if blocks:
            main = declared(blocks)
            made.append((blocks, main))
            made += [variant(blocks, main, turn) for _ in range(VARIANTS) if any(main)]
    if not made:
        return model
    data = [(vectors(b), np.array(m, np.float32)) for b, m in made]
    data.sort(key=lambda d: len(d[0]))
    batches = [data[k : k + BATCH] for k in range(0, len(data), BATCH)]
    first, second, step = [np.zeros_like(w) for w in model.weights], [np.zeros_like(w) for w in model.weights], 0
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for k in turn.permutation(len(batches)):
            x, mask, y = padded([d[0] for d in batches[k]], [d[1] for d in batches[k]])
            _, grads = model.gradients(x, mask, y)
            norm = float(np.sqrt(sum((g * g).sum() for g in grads)))
            step += 1
            for w, g, a, b in zip(model.weights, grads, first, second, strict=True):
                g = g * min(1.0, 1.0 / max(norm, 1e-9))
                a += 0.1 * (g - a)
                b += 0.01 * (g * g - b)
                w -= (rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return model


def fit(pages: DataFrame, html: str = "html") -> Labeller:
    """Trains on the driver with a bounded sample of pages. Hashes alone are sorted; then the pages chosen are fetched, of
    those with one hash one."""
    short = pages.where(F.col(html).isNotNull() & (F.length(html) <= TRAIN_CHARS)).select(F.xxhash64(html).alias("h"), F.col(html).alias("page"))
    chosen = [r["h"] for r in short.select("h").distinct().orderBy("h").limit(TRAIN_PAGES).collect()]  # TRAIN_PAGES numbers
    rows = short.where(F.col("h").isin(chosen)).groupBy("h").agg(F.min("page").alias("page")).orderBy("h").collect()  # TRAIN_PAGES rows by TRAIN_CHARS
    return train([r["page"] for r in rows])


def main_texts(pages: list[str | None], model: Labeller) -> list[str]:
    read = [blocks_of(page) for page in pages]
    chances = model.chances([vectors(b) for b in read])
    return [" ".join(b.text for b, p in zip(blocks, chance, strict=True) if p >= 0.5) for blocks, chance in zip(read, chances, strict=True)]


#: Characters of pages that are labelled together.
CHUNK_CHARS = 1_000_000


def extract(pages: DataFrame, model: Labeller, key: str = "page_id", html: str = "html", kept: tuple[str, ...] = ("url",)) -> DataFrame:
    """The key, the kept columns, the main text and its length, for each row."""
    columns = [key, *kept]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts: list[str] = []
            held: list[str | None] = []
            size = 0
            for value in batch.column(html):
                held.append(value.as_py())
                size += len(held[-1] or "")
                if size > CHUNK_CHARS:
                    texts += main_texts(held, model)
                    held, size = [], 0
            texts += main_texts(held, model)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*columns, "text", "n_chars"])

    schema = ", ".join(f"{c} {column_type(pages, c)}" for c in columns) + ", text string, n_chars long"
    return pages.select(*columns, html).mapInArrow(run, schema)
