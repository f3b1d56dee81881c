"""Operators that bring rows together: 1, 4, 5, and the pipeline."""

import random
import zlib

import numpy as np
import pytest
from helpers import by_id, components, frame, near_copies, shingle_set
from pyspark.sql import functions as F

import corpus_pipeline
from atomweave.llm import decontaminate, registry, setjoin, sharding, topk

# 1 ------------------------------------------------------------------------------------------------------------------


def test_shards_are_even_and_gapless(spark, data):
    rows = registry.op1_sharding(spark, "/root/testdata/sf0.01").toPandas()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    assert len(rows) == len(texts) and set(rows["shard"]) == set(range(24))
    for _, shard in rows.groupby("shard"):
        assert sorted(shard["slot"]) == list(range(len(shard)))
    loads = rows.groupby("shard")["size"].sum()
    assert loads.max() - loads.min() <= 0.01 * loads.mean()
    for r in rows.itertuples():
        assert r.size == len(texts[r.doc_id].encode()) + 8 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode())


def test_map_versions_move_little(spark, tmp_path):
    docs = frame(spark, [None, "", "a" * 50, "é" * 30, *("x" * (k % 37) for k in range(400))])
    first = sharding.build_map(docs, 5, n_slots=64)
    first.save(spark, str(tmp_path / "map"))
    grown = first.rebalanced(6)
    grown.save(spark, str(tmp_path / "map"))
    assert sharding.SlotMap.load(spark, str(tmp_path / "map")) == grown and sharding.SlotMap.load(spark, str(tmp_path / "map"), 1) == first
    moved = [(a, b) for a, b in zip(first.owner, grown.owner, strict=True) if a != b]
    assert sum(b == 5 for _, b in moved) >= 0.6 * len(moved) and len(moved) <= 0.5 * len(first.owner)
    assert max(grown.loads()) - min(grown.loads()) <= 2 * max(grown.size)
    shrunk = grown.rebalanced(3)
    assert set(shrunk.owner) <= {0, 1, 2} and max(shrunk.loads()) - min(shrunk.loads()) <= max(shrunk.size)


def test_shards_of_odd_rows(spark):
    docs = frame(spark, [None, "", "a", "a", "b"], [None, 1, 2, 2, None])
    rows = sharding.assign(docs, sharding.build_map(docs, 2, n_slots=8)).collect()
    assert len(rows) == 5 and {r["size"] for r in rows} == {8, 9}
    for shard in {r["shard"] for r in rows}:
        assert sorted(r["slot"] for r in rows if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in rows)))
    empty = docs.where("false")
    assert sharding.assign(empty, sharding.build_map(empty, 2, n_slots=8)).count() == 0


# 4 ------------------------------------------------------------------------------------------------------------------


def best_by_brute_force(rows, k):
    vectors = {i: np.floor(np.asarray(v, float) * 1024).astype(int) for i, v in rows}
    out = {}
    for q in (i for i in vectors if i % 100 == 0):
        scored = sorted((-int(vectors[q] @ v), i) for i, v in vectors.items() if i != q)
        out[q] = [(n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return out


@pytest.mark.parametrize(("n", "d", "step"), [(700, 8, 0.25), (3, 4, 0.5), (1500, 16, None), (60, 2, 1.0)])
def test_search_is_exact_with_ties(spark, monkeypatch, n, d, step):
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 256)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 4)
    turn = np.random.default_rng(n)
    values = turn.normal(size=(n, d)) if step is None else turn.integers(-4, 5, size=(n, d)) * step
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(values.astype(np.float32))]
    found = topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    got = {}
    for r in sorted(found, key=lambda r: r["rank"]):
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert got == best_by_brute_force(rows, 10)


def scored_plainly(rows, k, every=100):
    """In integers of any length: {query: [(rank, id, score)]}, scores beyond a long as None."""
    whole = [(i, [int(np.floor(x * 1024.0)) for x in v]) for i, v in rows]
    out = {}
    for q, x in {i: v for i, v in sorted(whole, reverse=True) if i % every == 0}.items():
        scored = sorted((-sum(a * b for a, b in zip(x, v, strict=False)), i) for i, v in whole if i != q)[:k]
        out[q] = [(n + 1, i, -s if -(2**63) <= -s < 2**63 else None) for n, (s, i) in enumerate(scored)]
    return out


def found_by_search(frame_, k=10):
    got = {}
    for r in sorted(topk.search(frame_, k).collect(), key=lambda r: r["rank"]):
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return got


@pytest.mark.parametrize("scale", [1e-3, 1.0, 1e3, 1e6, 1e9, 1e12, 1e15])
def test_search_is_exact_at_any_scale(spark, monkeypatch, scale):
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 64)
    turn = np.random.default_rng(3)
    values = turn.normal(size=(205, 5)) * scale
    values[::7] *= 1e-3 / scale  # some small among large
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(values)]
    assert found_by_search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")) == scored_plainly(rows, 10)


def test_large_components(spark):
    rows = [(0, [3e6]), (1, [2e6]), (2, [-1e6]), (3, [1.0])]
    assert found_by_search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")) == scored_plainly(rows, 10)
    with pytest.raises(Exception, match="beyond 2\\^62"):
        topk.search(spark.createDataFrame([(0, [1e30]), (1, [1.0])], "vec_id long, embedding array<double>")).collect()


def test_one_id_on_many_rows(spark, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 16)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
    turn = np.random.default_rng(5)
    rows = [(7, [1.0, 2.0])] * 60 + [(7, [float(x) for x in turn.integers(-3, 4, 2)]) for _ in range(40)] + [(100 * k, [float(x) for x in turn.integers(-3, 4, 2)]) for k in range(30)]
    assert found_by_search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")) == scored_plainly(rows, 10)


def test_odd_vectors_take_no_part(spark):
    rows = [(0, [1.0, 0.5]), (1, None), (2, [1.0, None]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, [1.0]), (6, []), (7, [-1.0, 2.0]), (7, [-1.0, 2.0]), (100, [0.0, 0.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.search(df).collect())
    assert found == [(0, 1, 5, 1024 * 1024), (0, 2, 6, 0), (0, 3, 7, 0), (0, 4, 7, 0), (0, 5, 100, 0), (100, 1, 0, 0), (100, 2, 5, 0), (100, 3, 6, 0), (100, 4, 7, 0), (100, 5, 7, 0)]
    assert topk.search(df.where("false")).count() == 0


def test_search_stops_early_on_clustered_vectors():
    turn = np.random.default_rng(1)
    vectors = np.floor(turn.normal(size=(2000, 16)) * 20).astype(int)
    vectors[:12] += np.array([400] * 4 + [0] * 12)
    index = topk.ImpactIndex(np.arange(2000), vectors)
    ids, scores = index.search(vectors[0], 0)
    want = sorted(((-int(vectors[0] @ v), i) for i, v in enumerate(vectors) if i))[:10]
    assert [(-int(s), int(i)) for i, s in zip(ids, scores, strict=True)] == want


# 5 ------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(("seed", "edits", "words"), [(1, 3, 60), (2, 8, 120), (3, 2, 14), (4, 14, 200)])
def test_components_equal_brute_force(spark, seed, edits, words):
    texts = [*near_copies(seed, edits=edits, words=words), None, "", "  ", "one two", "ONE\ttwo", "a b c d", "a b c d", "a b c d e", *["copy of one text that has more than five words"] * 4]
    found = by_id(setjoin.link_components(frame(spark, texts)))
    want = components(range(len(texts)), texts)
    assert {i: r["component_id"] for i, r in found.items()} == want
    assert {i: r["n_shingles"] for i, r in found.items()} == {i: len(shingle_set(t)) for i, t in enumerate(texts)}


def test_small_groups_and_wide_families(spark, monkeypatch):
    """Many groups of tokens, long lists in small blocks and few first partners give the same components."""
    monkeypatch.setattr(setjoin, "GROUP_TOKENS", 50)
    monkeypatch.setattr(setjoin, "FIRST_PARTNERS", 1)
    monkeypatch.setattr(setjoin, "SAMPLE", 1)
    texts = near_copies(7, families=2, members=90, words=50, edits=7, alone=60)
    found = by_id(setjoin.link_components(frame(spark, texts)))
    assert {i: r["component_id"] for i, r in found.items()} == components(range(len(texts)), texts)


def test_pairs_of_long_lists_come_in_pieces(monkeypatch):
    """A task hands on the pairs of frequent tokens before it has them all; their sums are those of one piece."""
    rng = np.random.default_rng(1)
    token = np.r_[np.zeros(300, np.uint64), rng.integers(1, 40, 900).astype(np.uint64)]
    label = np.r_[np.arange(300), rng.integers(0, 300, 900)]
    size = np.full(1200, 50, np.int32)
    want = {}
    for t in np.unique(token):
        members = sorted(set(label[token == t].tolist()))
        for k, a in enumerate(members):
            for b in members[k + 1 :]:
                want[a, b] = want.get((a, b), 0) + 1
    monkeypatch.setattr(setjoin, "HELD_PAIRS", 500)
    monkeypatch.setattr(setjoin, "BLOCK", 16)
    pieces = list(setjoin.list_pairs(token, label, label, size, size))
    assert len(pieces) > 10 and max(x.shape[1] for x in pieces) < 30_000 < len(want)
    found = setjoin.rolled_up(np.concatenate(pieces, axis=1))
    assert {(a, b): n for a, b, n in found[:3].T.tolist()} == want


@pytest.mark.parametrize(("seed", "edits", "words", "members"), [(1, 3, 60, 12), (2, 8, 120, 12), (3, 2, 14, 12), (9, 3, 40, 40)])
def test_links_equal_brute_force(spark, monkeypatch, seed, edits, words, members):
    monkeypatch.setattr(setjoin, "HOT_PAIRS", 5)
    monkeypatch.setattr(setjoin, "HOT_GROUP", 6)
    texts = [*near_copies(seed, edits=edits, words=words, members=members), None, "", "one two", "ONE\ttwo", "a b c d e", *["copy of one text that has more than five words"] * 4]
    pairs, members_of = setjoin.links(frame(spark, texts))
    of = {}
    for r in members_of.collect():
        of.setdefault(r["rep"], []).append(r["doc_id"])
    rows = pairs.collect()
    assert len(rows) == len({(r["a"], r["b"]) for r in rows}) and all(r["a"] < r["b"] for r in rows)
    found = {(min(x, y), max(x, y)) for r in rows for x in of[r["a"]] for y in of[r["b"]]} | {(x, y) for m in of.values() for x in m for y in m if x < y}
    sets = [shingle_set(t) for t in texts]
    assert found == {(i, j) for j, b in enumerate(sets) for i, a in enumerate(sets[:j]) if a and b and 100 * len(a & b) >= 75 * len(a | b)}
    assert all(r["common"] == len(sets[r["a"]] & sets[r["b"]]) for r in rows)


def test_repeated_rows_leave_one(spark):
    from pyspark.sql import types as T

    text = "one two three four five six seven eight nine ten"
    docs = frame(spark, [text, text, text, "other words that stand alone here", "", None, None], [4, 4, 9, 4, 5, 5, 5])
    docs = docs.withColumn("source", F.concat(F.lit("s"), F.monotonically_increasing_id().cast("string"))).withColumn("extra", F.create_map("source", "lang")).withColumn("row_", F.lit(1)).withColumn("n", F.lit(2))
    kept = registry.keep_one_of_each_group(spark, docs.repartition(3), None)
    assert kept.columns == docs.columns and kept.schema["extra"].dataType == T.MapType(T.StringType(), T.StringType(), True)
    rows = kept.collect()
    assert sorted((r["doc_id"], str(r["text"])) for r in rows) == sorted([(4, text), (4, "other words that stand alone here"), (5, ""), (5, "None")])


def test_secrets_stage_without_lengths(spark):
    docs = frame(spark, ["password = hunter2hunter2", None], [1, 2]).drop("n_chars")
    out = registry.redact_secrets(spark, docs, None)
    assert out.columns == docs.columns and by_id(out)[1]["text"].endswith("[SECRET]") and by_id(out)[2]["text"] is None


def test_ids_that_repeat_or_lack(spark):
    one, other = "a b c d e f g h i j", "k l m n o p q r s t"
    found = setjoin.link_components(frame(spark, [one, other, other, one, one, None], [5, 5, 9, None, 7, 3])).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_shingles"], r["component_id"]) for r in found) == [(False, 3, 0, 3), (False, 5, 6, 5), (False, 5, 6, 5), (False, 7, 6, 5), (False, 9, 6, 5), (True, 0, 6, None)]
    assert setjoin.link_components(frame(spark, [])).count() == 0


def test_components_of_long_paths(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(0, 200)] + [(500, 501), (501, 500), (7, 7)], "u long, v long")
    assert {(r["node"], r["component"]) for r in setjoin.components(edges).collect()} == {(k, 0) for k in range(201)} | {(500, 500), (501, 500)}


# pipeline -----------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def small_corpus(spark, tmp_path_factory):
    """Planted: toxic rows, near copies, test passages and secrets, among clean rows."""
    turn = random.Random(2)
    word = lambda: "".join(turn.choice(["th", "er", "on", "an", "in", "re", "ed", "st"]) for _ in range(turn.randint(1, 4)))
    prose = lambda n: " ".join(word() for _ in range(n))
    item = prose(25)
    texts = {k: prose(40) for k in range(300)}
    for k in range(0, 300, 4):
        texts[k] = texts[k] + ". " + " ".join(turn.choice(["blockhead", "numbskull", "dimwit"]) for _ in range(3))
    texts[301], texts[303] = texts[1], texts[1] + " extra"
    texts[305] = prose(10) + " " + item + " " + prose(10)
    texts[307] = prose(10) + ' token = "0123456789abcdef0123456789abcdef" ' + prose(5)
    texts[309], texts[311] = None, ""
    path = tmp_path_factory.mktemp("sf")
    frame(spark, list(texts.values()), list(texts)).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(k, 1, int(k % 4 == 0)) for k in range(300)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path), texts, item


def test_pipeline_keeps_what_brute_force_keeps(spark, small_corpus):
    path, texts, item = small_corpus
    docs = spark.read.parquet(f"{path}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    clean = stages["toxicity"](spark, docs, path)
    assert clean.columns == docs.columns
    left = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert not any(k % 4 == 0 and k < 300 for k in left) and len(left) >= 0.98 * sum(k % 4 != 0 or k >= 300 for k in texts)
    groups = components(list(left), list(left.values()))
    kept = {i for i, c in groups.items() if i == c}
    window = set(decontaminate.windows(decontaminate.words(item.encode())))
    kept = {i for i in kept if not window & set(decontaminate.windows(decontaminate.words((left[i] or "").encode())))}
    assert not {301, 303, 305} & kept and {1, 307, 309, 311} <= kept
    out = by_id(corpus_pipeline.run(spark, path))
    assert set(out) == kept and out[309]["n_tokens"] == out[311]["n_tokens"] == 0
    import hashlib

    assert out[1]["decoded_sha256"] == hashlib.sha256(texts[1].encode()).hexdigest() and out[307]["decoded_sha256"] != hashlib.sha256(texts[307].encode()).hexdigest()


def test_stages_keep_columns_and_bear_empty_tables(spark, small_corpus):
    path, _, _ = small_corpus
    docs = spark.read.parquet(f"{path}/documents.parquet").where("false").withColumn("score", F.lit(1)).withColumn("label", F.lit("x")).withColumn("copy", F.lit(True))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, path)
        assert out.columns == docs.columns and out.count() == 0, name


def test_extra_columns_with_our_names(spark, small_corpus):
    path, _, _ = small_corpus
    docs = spark.read.parquet(f"{path}/documents.parquet").where("doc_id > 290").withColumns({c: F.lit(7) for c in ("n", "label", "component_id", "copy", "spans", "__base", "size", "token", "component", "found", "found_", "__run", "__assign", "base", "text_", "start", "tokens", "score")})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, path)
        assert out.columns == docs.columns and 0 < out.count() <= docs.count(), name
    assert setjoin.link_components(docs).count() == docs.count() and sharding.assign(docs, sharding.build_map(docs, 3, n_slots=16)).count() == docs.count()


@pytest.mark.parametrize("name", ["op5_ngram_jaccard", "op8_decontaminate"])
def test_queries_leave_no_folders(spark, data, tmp_path, monkeypatch, name):
    from atomweave.llm import common

    monkeypatch.setattr(common, "shared_folder", lambda _: f"file://{tmp_path}/shared")
    assert registry.QUERIES[name](spark, data).count() == spark.read.parquet(f"{data}/documents.parquet").count()
    assert [p for p in (tmp_path / "shared").rglob("*") if p.is_dir() and p.name != "atomweave"] == []
