"""What is stored and changed by many: the journal, snapshots, buckets, indexes and whole passes."""

import random

import pytest
from pyspark.sql import functions as F

from atomweave.operators import dedup, healing, keywords, likeness, passes, retrieve, store, vectors
from atomweave.operators.joins import looked_up
from atomweave.operators.likeness import LikenessIndex
from atomweave.sources.journal import Journal, LostRace

NOW = 1_700_000_000_000
DAY = 86_400_000

# journal and snapshots ----------------------------------------------------------------------------------------------


def test_one_of_two_writers_wins(spark, tmp_path):
    one, two = Journal(spark, str(tmp_path / "j")), Journal(spark, str(tmp_path / "j"))
    assert one.versions() == [] and one.last() == 0
    assert one.append({"by": "one"}, 0) == 1
    with pytest.raises(LostRace):
        two.append({"by": "two"}, 0)
    assert two.append({"by": "two"}, 1) == 2 and one.versions() == [1, 2] and one.entry(2) == {"by": "two"}
    assert [p.name for p in (tmp_path / "j").iterdir() if "draft" in p.name] == []


def test_a_taken_number_is_a_lost_race(spark, tmp_path, monkeypatch):
    first, late = Journal(spark, str(tmp_path / "j")), Journal(spark, str(tmp_path / "j"))
    first.append({}, 0)
    monkeypatch.setattr(late, "last", lambda: 0)  # it looked before the other wrote
    with pytest.raises(LostRace, match="taken"):
        late.append({}, 0)


def test_lost_commits_leave_no_rows(spark, tmp_path):
    rows = lambda n: spark.createDataFrame([(n,)], "x int")
    shelf, other = store.Snapshots(spark, str(tmp_path / "s")), store.Snapshots(spark, str(tmp_path / "s"))
    base = shelf.commit(rows(1))
    assert other.commit(rows(2), base=base) == 2
    with pytest.raises(LostRace):
        shelf.commit(rows(3), base=base)
    assert shelf.read().first()["x"] == 2 and shelf.read(1).first()["x"] == 1
    assert len([p for p in (tmp_path / "s").iterdir() if p.name.startswith("data-")]) == 2
    assert shelf.keep_last(1) == [1] and shelf.versions() == [1, 2] and shelf.read().count() == 1


def test_batches_count_once(spark, tmp_path):
    shelf = store.Snapshots(spark, str(tmp_path / "s"))
    rows = lambda n: spark.createDataFrame([(n,)], "x int")
    assert shelf.commit(rows(1), batch=("a", 0)) == 1 and shelf.commit(rows(2), batch=("a", 0)) == 1
    assert shelf.commit(rows(3), batch=("b", 0)) == 2 and shelf.commit(rows(4), batch=("a", 0)) == 2
    assert shelf.commit(rows(5), batch=("a", 1), told={"n": 5}) == 3 and shelf.told() == {"n": 5} and shelf.read().first()["x"] == 5


# buckets ------------------------------------------------------------------------------------------------------------

BASE = "slot string, name string, version long, metadata map<string,string>"


def exchanged(frame) -> list[str]:
    """Of each shuffle, the scans below it."""
    plan = frame._jdf.queryExecution().executedPlan().toString().split("\n")
    depth = lambda line: len(line) - len(line.lstrip(" :+-*()0123456789"))
    out = []
    for k, line in enumerate(plan):
        if "Exchange " in line and "Broadcast" not in line:
            below = []
            for x in plan[k + 1 :]:
                if depth(x) <= depth(line):
                    break
                below.append(x)
            out.append(" ".join(below))
    return out


def test_merges_into_buckets_do_not_shuffle_the_base(spark, tmp_path):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        shelf = store.Snapshots(spark, str(tmp_path / "b"), buckets=(4, ("slot", "name")))
        base = spark.createDataFrame([("s", f"n{k}", 1, {"a": "x"}) for k in range(200)], BASE)
        shelf.commit(base)
        incoming = spark.createDataFrame([("s", "n5", 3, {"b": "y"}), ("s", "n5", 2, {"b": "z"}), ("t", "new", 1, None)], BASE)
        merged = store.upserted_by_join(shelf.read(), incoming)
        for plan in exchanged(merged):
            assert "FileScan" not in plan, plan
        assert shelf.commit(merged, base=1) == 2
        patches = spark.createDataFrame([("s", "n5", {"a": "1", "odd": "q"}), ("s", "n6", {"a": None})], "slot string, name string, patch map<string,string>")
        patched = store.patched_by_name(shelf.read(), patches, ("a", "b"))
        for plan in exchanged(patched):
            assert "FileScan" not in plan, plan
        assert shelf.commit(patched, base=2) == 3
        again = store.Snapshots(spark, str(tmp_path / "b"), buckets=(4, ("slot", "name")))
        got = {(r["slot"], r["name"]): (r["version"], r["metadata"]) for r in again.read().collect()}
        assert len(got) == 201 and got["s", "n5"] == (3, {"b": "y", "a": "1"}) and got["t", "new"] == (1, None) and got["s", "n6"] == (1, {"a": ""}) and got["s", "n7"] == (1, {"a": "x"})
        files = [p for p in (tmp_path / "b" / shelf.journal.entry(3)["folder"]).iterdir() if p.name.startswith("part")]
        assert len(files) <= 4  # a file for each bucket
        assert sorted(map(str, store.upserted(base, incoming).collect())) == sorted(map(str, store.upserted_by_join(base, incoming).collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


# lookups ------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("hot", [0, 1, 50])
def test_lookups_of_hot_keys(spark, hot):
    rows = spark.createDataFrame([("h", k) for k in range(40)] + [(f"k{k % 5}", 100 + k) for k in range(20)] + [("none", 1), (None, 2)], "key string, id long")
    table = spark.createDataFrame([("h", 40, "H"), *[(f"k{k}", 4, f"K{k}") for k in range(5)], (None, 1, "N")], "key string, n long, v string")
    found = looked_up(rows, table, "key", "n", F.col("id"), hot_keys=hot)
    assert found.columns == ["key", "id", "v"]
    assert sorted((r["key"], r["id"], r["v"]) for r in found.collect()) == sorted([("h", k, "H") for k in range(40)] + [(f"k{k % 5}", 100 + k, f"K{k % 5}") for k in range(20)])


# likeness -----------------------------------------------------------------------------------------------------------


def some_leaves(spark, rows):
    return spark.createDataFrame([(i, slot, at, body) for i, slot, at, body in rows], "doc_id string, slot string, created_at_ms long, body string")


def family(seed, n=60):
    turn = random.Random(seed)
    words = [f"w{k}" for k in range(60)]
    bases = [turn.sample(words, 20) for _ in range(6)]
    out = []
    for k in range(n):
        body = list(bases[k % 6])
        for _ in range(turn.randint(0, 3)):
            body[turn.randrange(20)] = turn.choice(words)
        out.append((f"d{k:03d}", "knowledge" if k % 9 else "plans", 1000 + turn.randint(0, 5), " ".join(body)))
    return [*out, ("blank", "plans", 1, " - "), ("null", "plans", 1, None)]


def pairs_of(index, least):
    classes = index.classes()
    return sorted((r["keeper_id"], r["loser_id"], round(r["score"], 6)) for r in dedup.similarity_pairs(index.edges(classes), classes, least).collect())


def pairs_at_once(spark, rows, least):
    docs = some_leaves(spark, rows)
    reps = retrieve.representatives(docs)
    return sorted((r["keeper_id"], r["loser_id"], round(r["score"], 6)) for r in dedup.similarity_pairs(retrieve.likeness(reps, least), retrieve.classed(docs, reps), least).collect())


@pytest.mark.parametrize("list_rows", [500, 3])
def test_batches_give_the_pairs_of_one_run(spark, tmp_path, monkeypatch, list_rows):
    monkeypatch.setattr(retrieve, "LIST", list_rows)
    rows = family(1)
    index = LikenessIndex(spark, str(tmp_path / "i"), 0.8, folders=8)
    assert [index.add(some_leaves(spark, rows[a:b])) for a, b in ((0, 25), (25, 40), (40, 62))] == [1, 2, 3]
    assert pairs_of(index, 0.8) == pairs_at_once(spark, rows, 0.8) != []
    again = LikenessIndex(spark, str(tmp_path / "i"), 0.8)
    assert again.folders == 8 and pairs_of(again, 0.8) == pairs_of(index.rebuilt(str(tmp_path / "r"), some_leaves(spark, rows)), 0.8)


def test_changed_and_removed_documents(spark, tmp_path):
    rows = family(2, 30)
    index = LikenessIndex(spark, str(tmp_path / "i"), 0.8, folders=4)
    index.add(some_leaves(spark, rows))
    changed = [(rows[0][0], "knowledge", 2000, rows[1][3]), (rows[2][0], "knowledge", 2000, "nothing like it at all"), (rows[3][0], "knowledge", 2000, "-")]
    index.add(some_leaves(spark, changed), gone=spark.createDataFrame([(rows[4][0],), (rows[0][0],)], "doc_id string"))
    left = {r[0]: r for r in rows} | {r[0]: r for r in changed}
    del left[rows[4][0]]
    assert pairs_of(index, 0.8) == pairs_at_once(spark, list(left.values()), 0.8)


def test_work_follows_the_new_rows(spark, tmp_path):
    turn = random.Random(3)
    body = lambda: " ".join(f"x{turn.randrange(10**6)}" for _ in range(12))
    old = [(f"o{k}", "knowledge", 1, body()) for k in range(300)]
    index = LikenessIndex(spark, str(tmp_path / "i"), 0.8, folders=128)
    index.add(some_leaves(spark, old))
    version = index.add(some_leaves(spark, [("new", "knowledge", 2, old[7][3] + " y"), ("alone", "knowledge", 2, body())]))
    told = index.told(version)
    assert told["sets"] == 2 and told["pairs"] == 1 and told["word_folders"] <= 8 and told["set_folders"] <= 2
    assert [(a, b) for a, b, _ in pairs_of(index, 0.8)] == [("new", "o7")]
    assert index.add(some_leaves(spark, old[:3]), stream=("s", 4)) == 3 and index.add(some_leaves(spark, old[3:5]), stream=("s", 4)) == 3
    with pytest.raises(ValueError, match="likeness"):
        LikenessIndex(spark, str(tmp_path / "i"), 0.7)


@pytest.mark.parametrize(("seen", "asked"), [(1, 10**6), (retrieve.LONG_LIST // 8, 0)])
def test_pairs_of_batches_pass_by_signature(spark, tmp_path, monkeypatch, seen, asked):
    """Sets of common words meet in most lists, also in lists that are cut in blocks; those alone become pairs that may be like, and nothing is left aside."""
    monkeypatch.setattr(likeness, "ASKED", asked)
    real = retrieve.frequent_words
    monkeypatch.setattr(retrieve, "frequent_words", lambda reps: (real(reps)[0], real(reps)[1] * seen))
    turn = random.Random(6)
    words = [f"w{k}" for k in range(70)]
    bodies = [turn.sample(words, turn.choice((24, 25, 40))) for _ in range(240)]
    for k in range(0, 240, 20):
        bodies[k + 1] = [*bodies[k][1:], "other"]
    rows = [(f"d{k:03d}", "knowledge" if k % 7 else "plans", 1000, " ".join(b)) for k, b in enumerate(bodies)]
    index = LikenessIndex(spark, str(tmp_path / "i"), 0.8, folders=4)
    turn.shuffle(rows)
    pairs = [index.told(index.add(some_leaves(spark, rows[a:b])))["pairs"] for a, b in ((0, 110), (110, 240))]
    want = pairs_at_once(spark, rows, 0.8)
    assert pairs_of(index, 0.8) == want and len(want) >= 8
    assert sum(pairs) < 1.5 * len(want) + 20
    assert sorted(p.name for p in (tmp_path / "i" / "aside").iterdir() if not p.name.startswith(".")) == []


def test_signatures_of_all_widths_can_be_laid_together():
    import numpy as np

    turn = np.random.default_rng(1)
    sets = [turn.integers(0, 1 << 62, n) for n in (5, 100, 130, 260, 700, 2_000)]
    assert [int(retrieve.widths(len(s), 0.88)) for s in sets] == [1, 1, 2, 4, 8, 8]
    for s in sets:
        wide = retrieve.signature(s)
        for words in (4, 2, 1):
            wide = wide[:words] ^ wide[words:]
            assert (wide == retrieve.signature(s, words)).all()
            assert np.bitwise_count(wide ^ retrieve.signature(s[3:], words)).sum() <= 3


def test_a_second_writer_of_an_index_is_refused(spark, tmp_path, monkeypatch):
    one, two = (LikenessIndex(spark, str(tmp_path / "i"), 0.8, folders=4) for _ in range(2))
    one.add(some_leaves(spark, family(4, 12)))
    real = two.journal.last
    monkeypatch.setattr(two.journal, "append", lambda entry, after: (one.journal.append({"batch": "x", "streams": {}, "least": 0.8, "folders": 4}, real()), Journal.append(two.journal, entry, after))[1])
    with pytest.raises(LostRace):
        two.add(some_leaves(spark, [("z", "plans", 1, "a b c")]))
    assert {t: len([p for p in (tmp_path / "i" / t).iterdir() if p.name.startswith("batch=")]) for t in ("sets", "postings", "members", "edges")} == dict.fromkeys(("sets", "postings", "members", "edges"), 1)


# keyword index ------------------------------------------------------------------------------------------------------


def test_keyword_index_skips_blocks(spark, tmp_path):
    turn = random.Random(5)
    docs = [(f"d{k:04d}", f"g{k % 4}", " ".join(turn.choice([f"common{turn.randrange(30)}", f"g{k % 4}word{turn.randrange(40)}"]) for _ in range(turn.randint(3, 25)))) for k in range(600)] + [("empty", "g0", ""), ("null", None, None)]
    frame = spark.createDataFrame(docs, "doc_id string, language string, body string")
    asked = spark.createDataFrame([(1, "g1word3 g1word4 common1"), (2, "common2 common2 common3"), (3, "nowhere"), (4, None), (5, "G2WORD7")], "query_id long, query string")
    index = keywords.KeywordIndex(spark, str(tmp_path / "k"), folders=8)
    assert index.build(frame, "language", block_docs=16) == 1
    found, blocks = index.search(asked, 5, first_blocks=2)
    terms, queries = retrieve.with_terms(frame.select("doc_id", "body"), asked)
    exact = retrieve.best(retrieve.scores(terms, queries, 5, "keyword"), ["query_id"], 5)
    as_set = lambda rows: sorted((r["query_id"], r["rank"], r["doc_id"], round(r["score"], 6)) for r in rows.collect())
    assert as_set(found) == as_set(exact) and {r["query_id"] for r in found.collect()} == {1, 2, 5}
    told = {r["query_id"]: (r["n"], r["read"]) for r in blocks.groupBy("query_id").agg(F.count("*").alias("n"), F.count_if("read").alias("read")).collect()}
    assert told[1][1] < told[1][0] and told[5][0] < told[2][0]
    plan = index._scored(index.asked(asked), blocks.where("read"), index.tables(index.asked(asked))[1])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(folder" in plan or "folder#" in plan.split("PartitionFilters")[1][:200]
    assert index.build(frame.where("language = 'g1'"), None, "second") == 2 and index.search(asked, 5)[0].where("query_id = 5").count() == 0
    index.remove_before(2)
    assert not (tmp_path / "k" / "first").exists()


# vector index -------------------------------------------------------------------------------------------------------


def test_vector_index_finds_what_lies_in_clusters(spark, tmp_path):
    import numpy as np

    turn = np.random.default_rng(1)
    centres = turn.normal(size=(12, 8))
    rows = [(f"v{k}", [float(x) for x in centres[k % 12] + 0.15 * turn.normal(size=8)]) for k in range(900)] + [("odd", [1.0]), ("none", None), ("nan", [float("nan")] * 8)]
    known = spark.createDataFrame(rows, "doc_id string, embedding array<double>")
    asked = known.where("doc_id like '%0'").select(F.substring("doc_id", 2, 9).cast("long").alias("query_id"), F.col("embedding").alias("query_vector"))
    index = vectors.VectorIndex(spark, str(tmp_path / "v"))
    assert index.build(known, "a", centres=12, sample_rows=300) == 1
    entry = index.journal.entry(1)
    assert entry["width"] == 8 and entry["centres"] == 12 and entry["lists"] <= 4
    fine = known.where(F.size("embedding") == 8).where("doc_id <> 'nan'")
    exact = retrieve.best(retrieve.scores(fine, asked, 8, "vector"), ["query_id"], 8)
    assert vectors.recall(index.search(asked, 8, own=True), exact).first()["recall"] >= 0.9
    assert vectors.recall(index.search(asked, 8, lists=12, own=True), exact).first()["recall"] == 1.0
    empty = vectors.VectorIndex(spark, str(tmp_path / "e"))
    empty.build(known.where("false"), "a")
    assert empty.search(asked, 8).count() == 0


# whole passes -------------------------------------------------------------------------------------------------------

STORE = "doc_id string, slot string, name string, atom_type string, project_module string, task_type string, error_pattern string, enabled boolean, created_at_ms long, last_recalled_at string, metadata map<string,string>, body string"
PAIRS = "keeper_id string, loser_id string, source_pass string"
MERGES = "keeper_id string, loser_id string, said_keeper string, said_loser string, action string, merged_body string, written boolean"
REFRESHES = "doc_id string, said_id string, action string, stale_after boolean, rewritten_body string"
AT = "2023-11-14T22:13:20.000Z"


def doc(i, kind="feedback-rule", slot="knowledge", age=1, enabled=True, body=None, recalled=None, **metadata):
    return (i, slot, f"{i}.md", kind, "m", "t", None, enabled, NOW - age * DAY, recalled, metadata, body or f"body of {i}")


def test_consolidation_of_one_store(spark, tmp_path):
    rows = [
        doc("keep", body="same"), doc("copy", age=2, body="same"), doc("fuzzy", age=3), doc("merged", age=4, body="short"), doc("flagged", age=300), doc("fresh", stale="true"), doc("rewritten", age=300, stale="true"),
        doc("gone", age=300), doc("kept", age=300, stale="true"), doc("still", age=300), doc("later", age=300, recalled="2020-01-01T00:00:00Z"), doc("plan", slot="plans", age=900), doc("long", enabled=False, age=300, body="x" * 2000),
        doc("cut", enabled=False, age=300, body="x" * 2000, consolidate_truncated_at="before"), doc("lore", "project-lore", age=900),
    ]
    base = spark.createDataFrame(rows, STORE)
    pairs = spark.createDataFrame([("keep", "copy", "sha256"), ("keep", "fuzzy", "similarity"), ("keep", "merged", "similarity")], PAIRS)
    merges = spark.createDataFrame([("keep", "merged", "keep", "merged", "merge", "both texts", True)], MERGES)
    refreshes = spark.createDataFrame([("rewritten", "rewritten", "rewrite", None, "new text"), ("gone", "gone", "archive", None, None), ("kept", "kept", "keep", False, None), ("still", "other", "keep", False, None), ("flagged", "flagged", "odd", None, None)], REFRESHES)
    shelf = store.Snapshots(spark, str(tmp_path / "s"))
    shelf.commit(base)
    step = lambda state: passes.consolidated(state, pairs, merges, refreshes, NOW, AT)
    assert passes.committed(shelf, step, passes.PAIR_KINDS, ("c", 1)) == 2 and passes.committed(shelf, step, passes.PAIR_KINDS, ("c", 1)) == 2
    got = {r["doc_id"]: r for r in shelf.read().collect()}
    assert {i for i, r in got.items() if not r["enabled"]} == {"copy", "merged", "gone", "long", "cut"} and shelf.read().columns == base.columns
    assert got["copy"]["metadata"] == {"superseded_by": "keep", "consolidated_at": AT} == got["merged"]["metadata"]
    assert got["keep"]["body"] == "both texts" and got["keep"]["metadata"] == {"consolidated_at": AT} and got["fuzzy"]["metadata"] == {}
    assert got["rewritten"]["body"] == "new text" and got["rewritten"]["metadata"] == {"stale": "false", "last_refreshed_at": AT, "consolidated_at": AT}
    assert got["gone"]["metadata"] == {"stale": "true", "consolidated_at": AT} and got["kept"]["metadata"] == {"stale": "false"} and got["fresh"]["metadata"] == {"stale": "false"}
    assert all(got[i]["metadata"] == {"stale": "true"} for i in ("flagged", "still", "later")) and got["lore"]["metadata"] == {} == got["plan"]["metadata"]
    assert len(got["long"]["body"]) <= 1200 and got["long"]["metadata"] == {"consolidate_truncated_at": AT} and len(got["cut"]["body"]) == 2000
    assert shelf.told() == {"pair-archive": 1, "pair-merge": 1, "pair-keeper": 1, "stale-flag": 4, "refresh-keep": 1, "refresh-refresh": 1, "refresh-archive": 1, "compress": 1}
    one = passes.consolidation(base, pairs, merges, refreshes, NOW, AT, refresh_most=1).where("done like 'refresh%'").count()
    assert one == 0  # the one that was recalled last has no decision


def test_passes_by_stream(spark, tmp_path):
    shelf = store.Snapshots(spark, str(tmp_path / "s"))
    shelf.commit(spark.createDataFrame([doc("keep", body="same"), doc("copy", age=2, body="same"), doc("two", age=3, body="same")], STORE))
    decided = lambda name: spark.createDataFrame([("keep", name, "sha256")], PAIRS)
    none = lambda schema: spark.createDataFrame([], schema)
    step = lambda state, batch: passes.consolidated(state, batch.select("keeper_id", "loser_id", "source_pass"), none(MERGES), none(REFRESHES), NOW, AT)
    run = lambda checkpoint: passes.by_stream(spark.readStream.schema(PAIRS).parquet(f"{tmp_path}/in"), shelf, step, passes.PAIR_KINDS, "pairs", f"{tmp_path}/{checkpoint}").awaitTermination()
    decided("copy").write.mode("append").parquet(f"{tmp_path}/in")
    run("c")
    decided("two").write.mode("append").parquet(f"{tmp_path}/in")
    run("c")
    assert shelf.versions() == [1, 2, 3] and shelf.told()["pair-archive"] == 2 and shelf.read().where("enabled").count() == 1
    run("lost")  # the stream's own record is gone, and its batches come again
    assert shelf.versions() == [1, 2, 3]


def test_promotion_of_days(spark):
    head = "# Daily flush\n\n"
    atom = lambda kind, title, pattern="": f"### Atom · {kind} · {title}\n- type: {kind}\n- title: {title}\n- tags: [a]\n- metadata: " + '{"project_module":"m","task_type":"debugging"' + (f',"error_pattern":"{pattern}"' if pattern else "") + "}\n- body: |\n    Something learned\n"
    day = lambda i, on, text, **metadata: (i, "daily", f"daily-{on}.md", None, None, None, None, True, NOW, None, metadata, head + text)
    rows = [
        day("today", "2023-11-14", atom("decision", "A")), day("fine", "2023-11-12", atom("decision", "B") + atom("plan", "P")), day("waits", "2023-11-11", atom("decision", "C")), day("given-up", "2023-11-10", atom("decision", "D"), promotion_tries="2"),
        day("old", "2023-11-01", atom("decision", "E")), day("retired", "2023-11-02", "x", promoted_words="4"), day("blank", "2023-11-13", "nothing"), day("blank-old", "2023-10-01", "nothing"), day("lesson", "2023-11-09", atom("self-improvement-lesson", "L", "ep")),
        doc("target", "self-improvement-lesson", "self_improvement"), doc("c1"),
    ]
    base = spark.createDataFrame(rows, STORE)
    candidates = spark.createDataFrame([("waits-1", 1, "c1"), ("given-up-1", 1, "c1"), ("lesson-1", 1, "target")], "atom_id string, rank int, doc_id string")
    given = spark.createDataFrame([("waits-1", "update", "c1", None, " ")], "atom_id string, action string, target_id string, merged_name string, merged_text string")
    out = passes.promoted(base, candidates, given, spark.createDataFrame([], "atom_id string"), "2023-11-14", NOW, 7).collect()
    got = {r["doc_id"]: r for r in out}
    state = {i: (got[i]["enabled"], got[i]["metadata"], got[i]["done"]) for i in (r[0] for r in rows)}
    words = lambda i: {"promoted_words": str(len(got[i]["body"].split()))}
    assert state["today"] == (True, {}, None) and state["fine"] == (True, words("fine"), "day-promoted") and state["waits"] == (True, {"promotion_tries": "1"}, "day-retried")
    assert state["given-up"] == (True, words("given-up"), "day-given-up") and state["old"] == (False, {}, "day-retired") == state["retired"] == state["blank-old"]
    assert state["blank"] == (True, words("blank"), "day-promoted") and state["lesson"] == (True, words("lesson"), "day-promoted")
    assert state["target"][0] is False and state["target"][2] == "atom-replaced" and state["c1"][0] is True
    new = [r for r in out if r["doc_id"] not in state]
    assert sorted((r["slot"], r["atom_type"], r["done"]) for r in new) == [("knowledge", "decision", "atom-create"), ("knowledge", "decision", "atom-create"), ("self_improvement", "self-improvement-lesson", "atom-update")]
    assert all(r["enabled"] and r["body"].startswith("# ") and r["metadata"]["tags"] == "a" for r in new)


# issues batch by batch ----------------------------------------------------------------------------------------------

TICKS = "entity string, tick long, at_ms long, ok boolean, signature string"


def folded_plainly(ticks):
    """Failures since the last success of each entity, tick by tick."""
    out = {}
    for entity, tick, at, ok, said in sorted(ticks, key=lambda t: t[1]):
        n, first, _, _ = out.get(entity, (0, None, None, None))
        out[entity] = (0, None, None, None) if ok else (n + 1, at if n == 0 else first, at, said)
    return {e: v for e, v in out.items() if v[0]}


def test_streaks_and_issues_follow_batches(spark):
    turn = random.Random(6)
    ticks = [(f"e{turn.randrange(7)}", k, 1000 * k, turn.random() < 0.45, f"s{turn.randrange(3)}") for k in range(60)]
    state, issues, seen = spark.createDataFrame([], healing.STATE), {}, []
    for k in range(0, 60, 12):
        seen += ticks[k : k + 12]
        state = spark.createDataFrame(healing.healing_pass(state, spark.createDataFrame(ticks[k : k + 12], TICKS), 3, 3).drop("done").collect(), healing.STATE)
        want = folded_plainly(seen)
        assert {r["id"]: (r["failures"], r["first_ms"], r["last_ms"], r["signature"]) for r in state.where("kind = 'entity'").collect()} == want
        live = {}
        for n, _, _, said in want.values():
            live.setdefault(said, []).append(n)
        for said in {*issues, *live}:
            raised = said in live and (max(live[said]) >= 3 or len(live[said]) >= 3)
            version, status = issues.get(said, (0, None))
            if raised:
                issues[said] = (version + (status != "open"), "open")
            elif status == "open" and said not in live:
                issues[said] = (version, "resolved")
        assert {r["id"]: (r["version"], r["status"]) for r in state.where("kind = 'issue'").collect()} == issues
    assert issues


def test_idle_entities_are_forgotten_and_issues_come_again(spark):
    batch = lambda rows: spark.createDataFrame(rows, TICKS)
    empty = spark.createDataFrame([], healing.STATE)
    step = lambda state, rows: healing.healing_pass(state, batch(rows), 1, 9)
    one = step(empty, [("a", 1, 0, False, "x")])
    assert {(r["id"], r["done"]) for r in one.collect()} == {("a", "entity-failing"), ("x", "issue-opened")}
    two = step(one.drop("done"), [("b", 2, 91 * DAY, False, "y")])
    assert {(r["id"], r["status"], r["done"]) for r in two.where("kind = 'issue'").collect()} == {("x", "resolved", "issue-resolved"), ("y", "open", "issue-opened")} and [r["id"] for r in two.where("kind = 'entity'").collect()] == ["b"]
    three = step(two.drop("done"), [("c", 3, 92 * DAY, False, "x"), ("b", 3, 92 * DAY, True, "")])
    assert {(r["id"], r["version"], r["status"], r["done"]) for r in three.where("kind = 'issue'").collect()} == {("x", 2, "open", "issue-reopened"), ("y", 1, "resolved", "issue-resolved")}
    assert sorted(r["id"] for r in step(three.drop("done"), []).where("kind = 'entity'").collect()) == ["c"]


def test_names_and_titles_of_updates(spark):
    from atomweave.operators import atoms

    old = "2020-01-02-030405678.md"
    rows = [("1", "decision", "My title", "update", "t", f"knowledge-old-one-{old}", None), ("2", "decision", "My title", "update", "t", f"lesson-old-one-{old}", "New Name"), ("3", "self-improvement-lesson", "My title", "update", "t", f"lesson-old-one-{old}", None), ("4", "self-improvement-lesson", "My title", "update", "t", f"knowledge-old-one-{old}", " "), ("5", "decision", "My title", "create", None, None, "x"), ("6", "decision", "T", "skip", None, None, None)]
    decided = spark.createDataFrame(rows, "atom_id string, type string, title string, action string, target_id string, target_name string, merged_name string")
    found = {r["atom_id"]: (r["name"].rsplit("-2023", 1)[0], r["supersedes"]) for r in atoms.writes(decided, F.lit("2023-11-14T22:13:20").cast("timestamp_ntz")).collect()}
    assert found == {"1": ("knowledge-old-one", "t"), "2": ("knowledge-new-name", "t"), "3": ("lesson-old-one", "t"), "4": ("lesson-my-title", "t"), "5": ("knowledge-my-title", None)}
