"""Operators 11 to 13: fill-in-middle, centroid clustering and archives."""

import base64
import gzip
import hashlib
import io
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
import regex
from helpers import frame
from pyspark.sql import functions as F

from atomweave.llm import common, fim, registry, vptree, warc

# 11 -----------------------------------------------------------------------------------------------------------------


def lines_of(text):
    """Units by plain splitting, without an expression."""
    parts = text.split("\n")
    return [p + "\n" for p in parts[:-1]] + ([parts[-1]] if parts[-1] else [])


def cut_plainly(doc_id, text):
    text = text or ""
    units = lines_of(text)
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, _, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(t in text for t in ("<P>", "<S>", "<M>")):
        return n, "plain", None, None, text
    if h4 % 100 < 50:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


ODD_TEXTS = ["", None, "\n", "\n\n\n", "one", "one\n", "a\nb", "é\n\U0001f600x\nß", "a <P> b\nc", "x\n<M>", "<S\n>a\n<\nP>\n<", "\r\n\r\n", "a\x00b\nc", " \n\t\n", "<P\n>", "tail<\n<S"]


def test_cuts_equal_plain_ones(spark):
    turn = random.Random(1)
    texts = ODD_TEXTS + ["".join(turn.choice("ab\n<>PSMé ") for _ in range(turn.randint(0, 60))) for _ in range(300)] + ["q" * 300_000, "ab\n" * 60_000]
    ids = [None, 5, 5, *range(100, 100 + len(texts) - 3)]
    cut = fim.transform(frame(spark, texts, ids))
    got = sorted((str(r["doc_id"]), r["n"], r["form"], str(r["prefix_chars"]), str(r["middle_chars"]), r["output"]) for r in cut.collect())
    want = sorted((str(i), n, form, str(a), str(b), out) for i, t in zip(ids, texts, strict=True) for n, form, a, b, out in [cut_plainly(i, t)])
    assert got == want
    back = sorted(r[0] for r in cut.select(fim.restored(F.col("output"), F.col("form"))).collect())
    assert back == sorted(t or "" for t in texts)
    assert {r["form"] for r in cut.select("form").distinct().collect()} == {"plain", "psm", "spm"}


def test_cut_query_and_table_edges(spark, data, same_rows):
    same_rows(registry.op11_fill_in_middle(spark, data), registry.ORACLES["op11_fill_in_middle"], data)
    docs = frame(spark, ["a\nb\nc\n", "a\nb\nc\n"], [1, 1]).withColumn("n", F.lit(9)).withColumn("output", F.lit("x")).withColumn("form", F.create_map(F.lit("a"), F.lit("b")))
    rows = fim.digests(fim.transform(docs)).collect()
    assert len(rows) == 2 and rows[0] == rows[1] and rows[0]["n"] == 3
    assert fim.transform(docs.where("false")).count() == 0


def test_recipe(spark):
    texts = [f"line {k}\nmore\nend {k}" for k in range(200)]
    rate = fim.transform(frame(spark, texts), fim.Recipe(seed=3, rate=40, spm=0, marks=("<pre>", "<suf>", "<mid>")))
    forms = [r["form"] for r in rate.collect()]
    assert 40 < forms.count("psm") < 120 and "spm" not in forms
    assert sorted(r[0] for r in rate.select(fim.restored(F.col("output"), F.col("form"), fim.Recipe(marks=("<pre>", "<suf>", "<mid>")))).collect()) == sorted(texts)
    for marks in (("<P>", "<P>", "<M>"), ("P", "<S>", "<M>"), ("<P>", "<S><x>", "<M>")):
        with pytest.raises(ValueError, match="marks"):
            fim.Recipe(marks=marks)


def test_one_match_keeps_every_line():
    assert fim.ends_of_units("a\n\nb", regex.compile(f"({fim.UNIT})*+")) == [2, 3, 4]


# 12 -----------------------------------------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<double>"


def clustered_plainly(rows, k, rounds, width):
    """Whole numbers of any length, all pairs."""
    v = [(i, [int(np.floor(64 * float(x))) for x in e]) for i, e in rows if e is not None and len(e) == width and all(x is not None and np.isfinite(x) for x in e)]
    c = [x for _, x in sorted((hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest(), x) for i, x in v)[:k]]
    away = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda x: min((away(x, y), n) for n, y in enumerate(c))
    for _ in range(rounds):
        of = [nearest(x)[1] for _, x in v]
        for n in range(len(c)):
            mine = [x for (_, x), m in zip(v, of, strict=True) if m == n]
            if mine:
                c[n] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    found = [(i, *reversed(nearest(x))) for i, x in v]
    total = sum(d for _, _, d in found)
    fits = lambda x: x if x < 2**63 else None
    return sorted(((str(i), n, fits(d), fits(sum(y for _, m, y in found if m == n)), fits(total), hashlib.sha256(",".join(map(str, c[n])).encode()).hexdigest()) for i, n, d in found), key=str)


def clustered(frame_, k, rounds, width):
    return sorted(((str(r[0]), *r[1:]) for r in vptree.cluster(frame_, k, rounds, width).collect()), key=str)


@pytest.mark.parametrize(("n", "k", "width", "step"), [(300, 16, 3, 1.0), (200, 7, 2, 0.5), (120, 40, 8, 0.01), (5, 16, 4, 1.0), (60, 16, 2, 4.0), (80, 9, 3, 3e12), (80, 9, 3, 3e6)])
def test_clusters_equal_plain_ones(spark, n, k, width, step):
    turn = np.random.default_rng(n)
    values = turn.integers(-3, 4, size=(n, width)) * step  # many ties, and equal vectors
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(values)]
    assert clustered(spark.createDataFrame(rows, VECTORS).repartition(5), k, 3, width) == clustered_plainly(rows, k, 3, width)


def test_odd_vectors_in_clusters(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (1, [3.0, 2.0]), (None, [0.0, 0.0]), (2, None), (3, [1.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, []), (8, [-0.001, 5.0]), (9, [1.0, 2.0, 3.0])]
    docs = spark.createDataFrame(rows, VECTORS)
    assert clustered(docs, 3, 2, 2) == clustered_plainly(rows, 3, 2, 2)
    clashing = docs.withColumn("cluster", F.lit("x")).withColumn("k", F.lit(1)).withColumn("v", F.lit(2))
    assert clustered(clashing, 3, 2, 2) == clustered_plainly(rows, 3, 2, 2)
    empty = vptree.cluster(docs.where("false"), 3, 2, 2)
    assert empty.count() == 0 and empty.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    far = spark.createDataFrame([(1, [1e30, 0.0])], VECTORS)
    with pytest.raises(Exception, match="beyond 2\\^62"):
        vptree.cluster(far, 1, 1, 2).collect()
    wide = spark.createDataFrame([(1, [1e15, 0.0]), (2, [-1e15, 0.0])], VECTORS)
    assert {(r["distance"], r["inertia"]) for r in vptree.cluster(wide, 1, 0, 2).collect()} == {(0, None), (None, None)}


def test_tree_prunes_and_keeps_ties():
    turn = np.random.default_rng(4)
    centroids = turn.integers(-50, 50, size=(64, 2))
    vectors = np.r_[centroids, turn.integers(-60, 60, size=(2000, 2))]
    number, distance, compared = vptree.VantageTree(centroids).nearest(vectors)
    plain = ((vectors[:, None] - centroids[None]) ** 2).sum(axis=2)
    assert (number == plain.argmin(axis=1)).all() and (distance == plain.min(axis=1)).all()
    assert compared < 0.5 * plain.size
    same = np.zeros((9, 3), np.int64)
    assert set(vptree.VantageTree(same).nearest(np.ones((4, 3), np.int64))[0]) == {0}


def test_cluster_query(spark, data, same_rows):
    same_rows(registry.op12_centroid_clusters(spark, data), registry.ORACLES["op12_centroid_clusters"], data)


# 13 -----------------------------------------------------------------------------------------------------------------

PAGES = "page_id long, url string, html string"


def recorded_plainly(rows, least=0):
    """(id, bytes, digest, type, refers) of rows (id, url, html)."""
    out = []
    for i, _, html in rows:
        p = (html or "").encode()
        ids = [j for j, _, h in rows if (h or "").encode() == p and j is not None]
        first = min(ids) if ids and sum((h or "").encode() == p for _, _, h in rows) > 1 and len(p) >= least else None
        revisit = first is not None and i != first
        out.append((str(i), len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if revisit else "response", str(first) if revisit else "None"))
    return sorted(out)


def digested(spark, pages, path, **options):
    read = warc.digests(warc.read_records(spark, path, **options), pages)
    return sorted((str(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], str(r["refers_to"])) for r in read.collect())


def page_rows(n=120):
    turn = random.Random(2)
    noise = lambda size: "".join(chr(turn.randint(32, 0x2FF)) for _ in range(size))
    rows = [(7, "http://a/é", "<p>x</p>"), (3, None, "<p>x</p>"), (9, "http://b\r\nWARC-Type: x", "<p>x</p>"), (3, "u", "<p>x</p>"), (1, "u", None), (2, "u", ""), (None, "u", ""), (None, "u", "alone"), (None, "v", "twice"), (None, "w", "twice")]
    return rows + [(100 + k, f"http://h/{k}", noise(turn.choice([5, 300, 4_000, 90_000]))) for k in range(n)] + [(10**12, "u", "\r\n\r\nWARC/1.1\r\n\r\n")]


@pytest.mark.parametrize("range_bytes", [None, 40_000, 300_000])
def test_archives_round_trip(spark, tmp_path, range_bytes):
    rows = page_rows()
    pages = spark.createDataFrame(rows, PAGES)
    warc.write_archives(pages.repartition(3), f"{tmp_path}/a")
    assert digested(spark, pages, f"{tmp_path}/a", range_bytes=range_bytes) == recorded_plainly(rows)
    read = warc.read_records(spark, f"{tmp_path}/a", range_bytes).collect()
    assert all(r["intact"] for r in read if r["record_type"] == "response")
    assert sorted(r["payload"].decode() for r in read if r["payload"] is not None) == sorted((h or "") for (i, _, h), x in zip(rows, rows, strict=True) if (i, h) != (7, "<p>x</p>") and (i, h) != (9, "<p>x</p>") and (i, h) != (2, "") and (i, h) != (None, ""))


def test_archives_are_plain_gzip_and_valid(spark, tmp_path):
    rows = page_rows(10)
    warc.write_archives(spark.createDataFrame(rows, PAGES).coalesce(1), f"{tmp_path}/a")
    (file,) = [f for f in (tmp_path / "a").iterdir() if f.name.startswith("part")]
    whole = gzip.decompress(file.read_bytes())
    at = seen = 0
    while at < len(whole):
        head, _, rest = whole[at:].partition(b"\r\n\r\n")
        fields = warc.parsed(head)
        assert head.startswith(b"WARC/1.1\r\n") and rest[int(fields["content-length"]) :].startswith(b"\r\n\r\n")
        assert ("warc-refers-to" in fields) == (fields["warc-type"] == "revisit") == ("warc-profile" in fields)
        at += len(head) + 4 + int(fields["content-length"]) + 4
        seen += 1
    assert seen == len(rows)


def test_small_payloads_and_many_kinds_of_join(spark, tmp_path, monkeypatch):
    rows = [(k, "u", "ab" if k % 3 else "longer text") for k in range(60)] + [(100 + k, "u", f"pair {k // 2}") for k in range(20)]
    pages = spark.createDataFrame(rows, PAGES).withColumn("first", F.lit("x")).withColumn("hash", F.lit(1)).withColumn("n", F.create_map(F.lit(1), F.lit(2)))
    warc.write_archives(pages, f"{tmp_path}/a", least=3)
    assert digested(spark, pages, f"{tmp_path}/a") == recorded_plainly(rows, 3)
    monkeypatch.setattr(warc, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(warc, "HOT_PAYLOADS", 2)
    warc.write_archives(pages, f"{tmp_path}/b")
    assert digested(spark, pages, f"{tmp_path}/b") == recorded_plainly(rows)


def test_empty_tables_and_long_pages(spark, tmp_path):
    pages = spark.createDataFrame([], PAGES)
    warc.write_archives(pages, f"{tmp_path}/a")
    assert digested(spark, pages, f"{tmp_path}/a") == []
    turn = random.Random(5)
    rows = [(1, "u", "".join(chr(turn.randint(33, 126)) for _ in range(1_000)) * 17_000), (2, "u", "z")]  # over 16 MB: ends in an empty member
    pages = spark.createDataFrame(rows, PAGES).coalesce(1)
    warc.write_archives(pages, f"{tmp_path}/b")
    assert digested(spark, pages, f"{tmp_path}/b", range_bytes=10_000) == recorded_plainly(rows)


def test_query_and_its_folder(spark, data, same_rows, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "shared_folder", lambda _: f"file://{tmp_path}/shared")
    same_rows(registry.op13_warc(spark, data), registry.ORACLES["op13_warc"], data)
    assert [p for p in (tmp_path / "shared").rglob("*") if "scratch" in p.name] == []


def test_false_magic_damage_and_foreign_members():
    good = [warc.member(str(k), "u", b"x" * k, None, "d") for k in range(4)]
    inner = warc.member("9", "u", bytes(random.Random(1).randbytes(500)) + b"\x1f\x8b\x08\x00" * 5, None, "d")
    plain_member = gzip.compress(b"not a record")
    torn = bytearray(good[3])
    torn[len(torn) // 2] ^= 0xFF
    data = b"junk\x1f\x8b\x08" + good[0] + plain_member + inner + bytes(torn) + b"\x1f\x8b" + good[1] + good[2][:-9]
    found = lambda a, b: [r.fields["warc-record-id"] for r in warc.records(io_of(data), a, b)]
    assert found(0, len(data)) == ["<urn:x-page:0>", "<urn:x-page:9>", "<urn:x-page:1>"]
    for size in (1, 7, 50, 333):
        assert [x for a in range(0, len(data), size) for x in found(a, min(len(data), a + size))] == ["<urn:x-page:0>", "<urn:x-page:9>", "<urn:x-page:1>"]
    two = zlib.compressobj(6, zlib.DEFLATED, 31)
    both = two.compress(gzip.decompress(good[1]) * 2) + two.flush()
    assert list(warc.records(io_of(both), 0, len(both))) == []


def io_of(data: bytes) -> pa.NativeFile:
    return pa.PythonFile(io.BytesIO(data), "r")
