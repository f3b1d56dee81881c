"""Operators on small hand-made tables."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from atomweave.operators import atoms, audit, capture, decisions, dedup, healing, leaf, lifecycle, retrieve, store
from atomweave.schema import MONTH_MS

NOW, DAY = 1_700_000_000_000, 86_400_000
LEAF = "doc_id string, n long, atom_type string, slot string, project_module string, language string, task_type string, error_pattern string, name string, enabled boolean, created_at_ms long, last_recalled_at string, body string, stale string"


def leaves(spark, *rows):
    base = {"atom_type": "decision", "slot": "knowledge", "name": "doc.md", "enabled": True, "created_at_ms": NOW}
    names = [f.split()[0] for f in LEAF.split(", ")]
    return spark.createDataFrame([tuple({**base, "n": k, **r}.get(c) for c in names) for k, r in enumerate(rows)], LEAF)


def pairs(df):
    return sorted((r["keeper_id"], r["loser_id"]) for r in df.collect())


def test_hash_pairs_keep_the_newest_and_the_smaller_id(spark):
    found = dedup.sha256_pairs(leaves(spark, {"doc_id": "old", "body": "same"}, {"doc_id": "new", "body": "same", "created_at_ms": NOW + 1000}, {"doc_id": "x", "body": "other"}, {"doc_id": "n1"}, {"doc_id": "n2"}))
    assert pairs(found) == [("new", "old")]
    assert pairs(dedup.sha256_pairs(leaves(spark, {"doc_id": "9", "body": "b"}, {"doc_id": "10", "body": "b"}))) == [("10", "9")]
    assert pairs(dedup.sha256_pairs(leaves(spark).where("false"))) == []


def test_lesson_pairs_need_enabled_lessons(spark):
    lesson = {"atom_type": "self-improvement-lesson", "project_module": "api", "task_type": "debug", "error_pattern": "flaky"}
    found = dedup.lesson_key_pairs(leaves(spark, {"doc_id": "l1", **lesson}, {"doc_id": "l2", **lesson, "created_at_ms": NOW + 1}, {"doc_id": "l3", **lesson, "error_pattern": "other"}, {"doc_id": "k", **lesson, "atom_type": "bug-root-cause"}, {"doc_id": "off", **lesson, "enabled": False}))
    assert pairs(found) == [("l2", "l1")]


def test_chains_end_at_one_keeper_and_hashes_win(spark):
    given = spark.createDataFrame([("B", "A", "sha256", 0), ("A", "C", "similarity", 1), ("B", "C", "similarity", 2), ("X", "A", "similarity", 0)], "keeper_id string, loser_id string, source_pass string, scan_idx int")
    kept = dedup.retained(dedup.with_rank(given))
    assert pairs(kept) == [("A", "C"), ("B", "A")]
    assert pairs(dedup.ultimate_keepers(kept)) == [("B", "A"), ("B", "C")]


def test_long_chains_are_followed(spark):
    given = spark.createDataFrame([(str(k + 1), str(k), "sha256") for k in range(150)], "keeper_id string, loser_id string, source_pass string")
    assert {r["keeper_id"] for r in dedup.ultimate_keepers(given).collect()} == {"150"}


def test_similarity_reaches_the_threshold(spark):
    edges = spark.createDataFrame([("q", "a", 0.88), ("q", "b", 0.5)], "a string, b string, score double")
    docs = leaves(spark, {"doc_id": "q", "created_at_ms": NOW + 5, "body": "x"}, {"doc_id": "a", "body": "y"}, {"doc_id": "b", "body": "z"}, {"doc_id": "c", "body": "Z, z"})
    classes = retrieve.classed(docs, retrieve.representatives(docs))
    assert pairs(dedup.similarity_pairs(edges, classes, 0.88)) == [("b", "c"), ("q", "a")]


def test_staleness_is_strict(spark):
    docs = leaves(
        spark, {"doc_id": "old", "atom_type": "self-improvement-lesson", "created_at_ms": NOW - 8 * MONTH_MS}, {"doc_id": "edge", "atom_type": "feedback-rule", "created_at_ms": NOW - 6 * MONTH_MS},
        {"doc_id": "recalled", "atom_type": "feedback-rule", "created_at_ms": NOW - 8 * MONTH_MS, "last_recalled_at": "2023-10-20T00:00:00Z"}, {"doc_id": "decision", "created_at_ms": NOW - 24 * MONTH_MS},
    )
    assert [r["doc_id"] for r in lifecycle.stale_documents(docs, NOW, 6, lifecycle.STALE_TYPES).collect()] == ["old"]
    assert {(r["doc_id"], r["stale"]) for r in lifecycle.stale_changes(docs, NOW, 6, lifecycle.STALE_TYPES).collect()} == {("old", "true")}


def test_compression_is_strict_and_counts_bytes(spark):
    off = {"enabled": False, "created_at_ms": NOW - 200 * DAY}
    docs = leaves(spark, {"doc_id": "big", **off, "body": "x" * 1300}, {"doc_id": "small", **off, "body": "x" * 1200}, {"doc_id": "young", **off, "created_at_ms": NOW - 10 * DAY, "body": "x" * 1300}, {"doc_id": "on", "body": "x" * 1300, "created_at_ms": NOW - 200 * DAY})
    found = lifecycle.compressible(docs, NOW, 1200, 180).collect()
    assert [(r["doc_id"], len(r["truncated"]), r["freed_bytes"]) for r in found] == [("big", 1200, 100)]


def test_daily_documents(spark):
    days = spark.createDataFrame([("daily-2026-05-25.md", 5), ("daily-2026-05-24.md", 5), ("daily-2026-05-23.md", 5), ("daily-2026-05-22.md", None), ("daily-2026-05-18.md", 5), ("notes.md", 5)], "name string, word_count int")
    promoted = spark.createDataFrame([("daily-2026-05-24.md", 5), ("daily-2026-05-23.md", 4), ("daily-2026-05-22.md", None)], "name string, word_count int")
    verbs = {r["name"]: r["verb"] for r in lifecycle.classify_daily(days, promoted, "2026-05-25", 7).collect()}
    assert verbs == {"daily-2026-05-25.md": "skip-today", "daily-2026-05-24.md": "skip-promoted", "daily-2026-05-23.md": "promote", "daily-2026-05-22.md": "skip-promoted", "daily-2026-05-18.md": "retire", "notes.md": "skip-today"}


def test_stamps_depend_on_the_last_that_counted(spark):
    hits = spark.createDataFrame([("d", t) for t in (0, 10, 23, 24, 30, 47, 48, None)], "doc_id string, at_ms long")
    assert [tuple(r) for r in lifecycle.accepted_stamps(hits, "doc_id", "at_ms", 24).collect()] == [("d", 3, 48)]


@pytest.mark.parametrize(("plans", "flagged"), [(["plan-auth.md", "plan-auth-rewrite.md"], ["0"]), (["plan-auth.md", "plan-auth.md"], []), (["plan-auth.md", "plan-oauth.md"], []), (["plan-auth.md", "plan-authz.md"], []), (["plan-auth-rewrite.md", "plan-auth.md"], [])])
def test_stale_plans(spark, plans, flagged):
    docs = leaves(spark, *[{"doc_id": str(k), "slot": "plans", "name": name, "created_at_ms": NOW + k} for k, name in enumerate(plans)])
    assert [r["doc_id"] for r in audit.stale_plans(docs).collect()] == flagged


def test_other_audits(spark):
    lesson = {"atom_type": "self-improvement-lesson", "slot": "self_improvement", "project_module": "m", "task_type": "t"}
    docs = leaves(
        spark, {"doc_id": "a", **lesson, "error_pattern": " x "}, {"doc_id": "b", **lesson, "error_pattern": "x", "created_at_ms": NOW - 1}, {"doc_id": "c", **lesson, "error_pattern": "X", "created_at_ms": NOW - 2},
        {"doc_id": "d", **lesson, "error_pattern": "  "}, {"doc_id": "e", "atom_type": "bug-root-cause"}, {"doc_id": "f", "atom_type": "project-lore", "created_at_ms": NOW - 90 * DAY},
    )
    found = {(r["class"], r["doc_id"]): r["reason"] for r in audit.findings(docs, NOW, 90).collect()}
    assert set(found) == {("duplicate-error-pattern", "b"), ("missing-metadata", "d"), ("missing-metadata", "e"), ("stale-lore", "f")}
    assert found["stale-lore", "f"] == "age 90 days"
    assert {(r["class"], r["slot"]): r["n"] for r in audit.summary(audit.findings(docs, NOW, 90)).collect()}[None, None] == 4


def test_filters(spark):
    df = spark.createDataFrame([("api", "rapid-api,x"), (None, "y"), ("", "api")], "project_module string, tags string")
    assert df.where(leaf.condition({"project_module": " api ", "language": "  "})).count() == 1
    assert df.where(leaf.condition({"tags": "api"})).count() == 2
    assert df.where(leaf.condition({"project_module": "api", "tags": "y"}, either=True)).count() == 2
    assert df.where(leaf.condition({})).count() == 3
    assert leaf.with_default_module({}, "m", always=False) == ({}, {}) and leaf.with_default_module({}, "m", always=True)[1] == {"project_module": "m"}


def test_flattened_metadata_takes_the_last(spark):
    df = spark.createDataFrame([([("a", "1"), ("b", "2"), ("a", "3")],), (None,)], "m array<struct<name:string,value:string>>")
    assert [r["f"] for r in df.select(leaf.flattened(F.col("m")).alias("f")).collect()] == [{"a": "3", "b": "2"}, {}]


def test_ladder_stops_when_enough_is_found(spark):
    rows = [("1", "l", "m", "e", "en", "t", 0.9), ("2", "l", "m", "z", "en", "t", 0.8), ("3", "l", "m", "z", "en", "t", 0.7), ("4", "l", "m", "z", "de", "t", 0.95)]
    df = spark.createDataFrame(rows, "doc_id string, atom_type string, project_module string, error_pattern string, language string, task_type string, score double")
    filters = {"atom_type": "l", "project_module": "m", "error_pattern": "e", "language": "en", "task_type": "t"}
    assert [(r["rung"], r["doc_id"]) for r in retrieve.ladder(df, filters, 5, 0.55).collect()] == [(0, "1"), (1, "2"), (1, "3")]
    assert [(r["rung"], r["doc_id"]) for r in retrieve.ladder(df.where("doc_id <> '3'"), filters, 5, 0.55).collect()] == [(0, "1"), (1, "2"), (2, "4")]
    assert len(retrieve.rungs({"atom_type": "l"})) == 1
    assert retrieve.ladder(df, filters, 5, 0.99).count() == 0


def test_chunks_overlap(spark):
    df = spark.createDataFrame([("d", " ".join(map(str, range(25))) + "\n\n### tail")], "doc_id string, body string")
    found = leaf.chunked(df, 10, 2, "\n\n### ").orderBy("part", "run").collect()
    assert [(r["part"], r["run"], r["n_words"]) for r in found] == [(0, 0, 10), (0, 1, 10), (0, 2, 9), (1, 0, 1)]
    assert found[1]["content"].startswith("8 9 10")


ATOM = "type string, title string, body string, tags array<string>, metadata map<string,string>, evidence string"


def test_atoms_survive_the_round_trip(spark):
    rows = [
        ("decision", "Use A", "Because\n  of B\n\nand C", ["x", "y"], {"project_module": "m"}, 'say "why"'), ("Self-Improvement-Lesson", "L", "b", ["t"], {"project_module": "M", "task_type": "odd", "error_pattern": "e"}, None),
        ("self-improvement-lesson", "L", "b", ["t"], {"project_module": "M"}, None), ("plan", "P", "b", ["t"], {}, None), ("decision", " ", "b", ["t"], {}, None), ("decision", "t", "b", [" "], {}, None), ("unknown", "t", "b", ["t"], {}, None),
    ]
    df = spark.createDataFrame([(1, k, *r) for k, r in enumerate(rows)], f"day int, k int, {ATOM}")
    good = atoms.validated(df)
    assert [(r["k"], r["task_type"]) for r in good.orderBy("k").collect()] == [(0, ""), (1, "unknown")]
    read = atoms.parsed(atoms.rendered(good, ["day"], "k", F.lit("# Head")), ["day"]).orderBy("position").collect()
    assert [(r["type"], r["title"], r["body"], r["tags"], r["evidence"]) for r in read] == [("decision", "Use A", "Because\n  of B\n\nand C", ["x", "y"], 'say "why"'), ("self-improvement-lesson", "L", "b", ["t"], None)]
    assert read[1]["metadata"] == {"project_module": "m", "task_type": "unknown", "error_pattern": "e"}


def test_parser_tolerates_what_writers_do(spark):
    text = "head\n### Atom · decision · T\n- type: decision\n- title: T\n- tags: []\n- metadata: [1]\n- body: |\n one space\n- evidence: raw text\nAtom · nope · U\n- type: nope\n- title: U\n- body: |\n    x"
    found = atoms.parsed(spark.createDataFrame([(1, text)], "k int, text string"), ["k"]).collect()
    assert [(r["title"], r["body"], r["metadata"], r["evidence"], r["tags"]) for r in found] == [("T", "one space", {}, "raw text", [])]


def test_quality(spark):
    df = spark.createDataFrame([("decision", "b" * 80, ["t"], "e", ""), ("bug-root-cause", "Why: x", ["t"], None, "")], "type string, body string, tags array<string>, evidence string, project_module string")
    assert [r["reasons"] for r in atoms.quality(df).collect()] == ["", "body-too-short,no-project-module"]


def test_decisions(spark):
    df = spark.createDataFrame([("a", "self-improvement-lesson", "e"), ("b", "decision", ""), ("c", "decision", ""), ("d", "decision", "")], "atom_id string, type string, error_pattern string")
    candidates = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z"), ("d", 1, "w")], "atom_id string, rank int, doc_id string")
    given = spark.createDataFrame([("b", "update", "z"), ("d", "update", "made-up")], "atom_id string, action string, target_id string")
    out = {r["atom_id"]: (r["action"], r["target_id"]) for r in atoms.decisions(df, candidates, given).collect()}
    assert out == {"a": ("update", "x"), "b": ("update", "z"), "c": ("create", None), "d": ("unresolved", None)}


def test_source_material(spark):
    turns = spark.createDataFrame([(1, k, "user" if k % 2 else "assistant", f"turn {k}") for k in range(40)] + [(2, 0, "tool", "x"), (3, 0, "user", "token=abc")], "conv_id int, turn int, role string, text string")
    found = {r["conv_id"]: r for r in atoms.source_material(turns, least=2, most=30).collect()}
    assert found[1]["turn_count"] == 30 and found[1]["body"].startswith("### Assistant\n\nturn 10") and found[1]["skip"] is None
    assert found[3]["skip"] == "too-few-turns" and "[REDACTED]" in found[3]["body"] and 2 not in found


def test_plan_specs(spark):
    df = spark.createDataFrame([("# My Plan\nsecret: abc", True), ("x", False), ("  ", True), (None, True), ("y" * 50, True)], "plan string, approved boolean")
    found = capture.plan_specs(df, most=40).collect()
    assert [r["skip"] for r in found] == [None, "not-approved", "empty-plan", "empty-plan", "plan-too-large (>40 bytes)"]
    assert found[0]["name"] == "plan-my-plan.md" and "[REDACTED]" in found[0]["text"]


def test_failures_escalate_and_heal(spark):
    ticks = spark.createDataFrame(
        [("a", t, t, False, "s1") for t in (1, 2, 3)] + [("b", 1, 1, False, "s2"), ("b", 2, 2, True, ""), ("c", 2, 2, False, "s2"), ("d", 2, 2, False, "s2"), ("e", 3, 3, False, "s2"), ("e", 3, 3, True, "")],
        "entity string, tick long, at_ms long, ok boolean, signature string",
    )
    streak = healing.streaks(ticks)
    assert {r["entity"]: r["failures"] for r in streak.collect()} == {"a": 3, "c": 1, "d": 1, "e": 1}
    raised = healing.escalations(streak, 3, 3)
    assert {r["signature"]: (r["reason"], r["entities"]) for r in raised.collect()} == {"s1": ("pending-consecutive", "a"), "s2": ("recurring-bug", "c,d,e")}
    known = spark.createDataFrame([("s1", 1, "resolved"), ("s3", 1, "open")], "signature string, version long, status string")
    assert {tuple(r) for r in healing.issues(known, streak, raised).collect()} == {("s1", 2, "open"), ("s2", 1, "open"), ("s3", 1, "resolved")}


def test_store_changes(spark, tmp_path):
    base = spark.createDataFrame([("1", {"a": "x", "b": "y"}, True), ("2", {}, True)], "doc_id string, metadata map<string,string>, enabled boolean")
    patches = spark.createDataFrame([("1", {"b": None, "c": "z", "odd": "q"}), ("9", {"a": "1"})], "doc_id string, patch map<string,string>")
    state, absent = store.patched(base, patches, ("a", "b", "c"))
    assert {r["doc_id"]: r["metadata"] for r in state.collect()} == {"1": {"a": "x", "b": "", "c": "z"}, "2": {}}
    assert [r["doc_id"] for r in absent.collect()] == ["9"]
    assert {r["doc_id"]: r["enabled"] for r in store.switched(base, base.where("doc_id = '1'"), False).collect()} == {"1": False, "2": True}
    assert [r["doc_id"] for r in store.deleted(base, base.where("doc_id = '1'")).collect()] == ["2"]
    listing = spark.createDataFrame([("n", "1"), ("n", "2"), ("m", "3")], "name string, doc_id string")
    assert [r["doc_id"] for r in store.replaced_copies(listing, "n", "2").collect()] == ["1"] and store.replaced_copies(listing, "n", None).count() == 0
    shelf = store.Snapshots(spark, str(tmp_path / "docs"))
    assert shelf.versions() == [] and shelf.commit(base) == 1 and shelf.commit(store.deleted(base, base.where("doc_id = '1'"))) == 2
    assert shelf.read().count() == 1 and shelf.read(1).count() == 2


def test_writes_supersede(spark):
    base = spark.createDataFrame([("1", "knowledge", "a.md", 1, True)], "doc_id string, slot string, name string, version long, enabled boolean")
    incoming = spark.createDataFrame([("knowledge", "b.md", 2, "1"), ("knowledge", "c.md", 2, "gone"), ("knowledge", "d.md", 2, None)], "slot string, name string, version long, supersedes string")
    state, failed = store.superseded(base, incoming)
    assert {(r["name"], r["enabled"]) for r in state.collect()} == {("a.md", False), ("b.md", True), ("c.md", True), ("d.md", True)}
    assert [r["doc_id"] for r in failed.collect()] == ["gone"]
    assert {r["name"] for r in store.superseded(base, incoming, "delete")[0].collect()} == {"b.md", "c.md", "d.md"}


def test_lesson_documents_and_entries(spark):
    df = spark.createDataFrame([("T\n", "m", "t", "e", "", "x", "Body", "why"), ("T", "m", " ", "e", "", "x", "Body", None)], "title string, project_module string, task_type string, error_pattern string, language string, tags string, body string, evidence string")
    assert [r[0] for r in df.select(atoms.lesson_document()).collect()] == ["# T\n\n- project_module: m\n- task_type: t\n- error_pattern: e\n- tags: x\n\nBody\n\nevidence: why", None]
    df = spark.createDataFrame([("raw-fallback", "a\nb"), ("nothing-durable", None), ("distilled", "x")], "o string, b string")
    out = [r[0] for r in df.select(atoms.day_entry(F.col("o"), F.col("b"))).collect()]
    assert "\n    a\n    b\n" in out[0] and "nothing durable" in out[1] and out[2] is None


def test_provider_failures_and_reports(spark):
    runs = spark.createDataFrame([(1, 1, 69, False), (2, 2, 0, True), (3, 3, 69, None)], "tick long, at_ms long, exit_code int, skipped boolean")
    streak = healing.streaks(healing.provider_failures(runs))
    assert [(r["entity"], r["failures"]) for r in streak.collect()] == [("provider", 3)]
    report = healing.escalations(streak, 3, 3).select(healing.issue_report()).first()[0]
    assert report.startswith("# provider-unavailable\n\n- reason: pending-consecutive") and "1970-01-01T00:00:00Z" in report
    assert healing.due(None, 5, 1) and healing.due(0, DAY, 1) and not healing.due(1, DAY, 1)


def like_pairs(sets, least):
    return {(a, b, score) for a, v in sets.items() for b, w in sets.items() if a < b and v and w and (score := round(len(v & w) / len(v | w), 6)) >= least}


def expanded(spark, docs, least):
    """All pairs of documents that edges between representatives and memberships stand for."""
    reps = retrieve.representatives(docs)
    classes = retrieve.classed(docs, reps)
    members = {}
    for r in classes.collect():
        members.setdefault(r["rep"], []).append(r["doc_id"])
    edges = [(r["a"], r["b"], r["score"]) for r in retrieve.likeness(reps, least).collect()]
    assert len(edges) == len(set(edges)) and all(a < b for a, b, _ in edges)
    out = [(min(x, y), max(x, y), s) for a, b, s in edges for x in members[a] for y in members[b]]
    return sorted(out + [(x, y, 1.0) for of in members.values() for x in of for y in of if x < y])


def test_likeness_finds_pairs_whose_words_are_all_common(spark):
    words = [f"w{k}" for k in range(24)]
    rows = [{"doc_id": str(k), "body": " ".join(words[:k] + words[k + 1 :])} for k in range(24)]  # 24 near copies; each word stands in 23 of them
    rows += [{"doc_id": f"c{k}", "body": " ".join(reversed(words)), "created_at_ms": k} for k in range(30)] + [{"doc_id": "e", "body": "- -"}, {"doc_id": "n"}, {"doc_id": "o", "body": " ".join(words), "slot": "plans"}]
    docs = leaves(spark, *rows)
    sets = {r["doc_id"]: set((r.get("body") or "").split()) - {"-"} for r in rows if r["doc_id"] != "o"}
    for least in (0.5, 0.88, 0.93, 0.958333):
        assert expanded(spark, docs, least) == sorted(like_pairs(sets, least))
    reps = retrieve.representatives(docs)
    classes = retrieve.classed(docs, reps)
    assert {r["rep"] for r in classes.where("doc_id like 'c%'").collect()} == {"c29"}
    found = retrieve.clusters(retrieve.likeness(reps, 0.5), classes, 12, 0.5).collect()
    want = {}
    for a, b, score in like_pairs(sets, 0.5):
        want.setdefault(a, []).append((-score, b))
        want.setdefault(b, []).append((-score, a))
    assert {(r["doc_id"], r["rank"], r["other"]) for r in found} == {(d, k + 1, other) for d, of in want.items() for k, (_, other) in enumerate(sorted(of)[:12])}


def test_signatures_keep_sets_apart_before_they_are_shuffled(spark):
    """Sets that share rare words alone don't become candidates; like sets do, also in long lists that are cut in blocks."""
    rng = np.random.default_rng(3)
    sets = [np.unique(np.r_[np.arange(4), rng.integers(10, 1 << 60, 60)]) for _ in range(60)]
    sets += [np.unique(np.r_[s[:-2], rng.integers(10, 1 << 60, 1)]) for s in sets[:20]]
    reps = spark.createDataFrame([("s", f"{k:03d}", s.tolist()) for k, s in enumerate(sets)], "slot string, rep string, tokens array<long>")
    share = lambda a, b: len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    want = {(f"{i:03d}", f"{j:03d}") for i, a in enumerate(sets) for j, b in enumerate(sets) if i < j and share(a, b) >= 0.88}
    assert len(want) == 20
    hot = np.arange(4), np.full(4, retrieve.LONG_LIST // 4)  # lists of these come in five blocks
    for least in (0.88, 0.05):
        found = [(r["a"], r["b"]) for r in retrieve.candidates(reps, least, hot).collect()]
        assert len(found) == len(set(found)) and set(found) >= {(f"{i:03d}", f"{j:03d}") for i, a in enumerate(sets) for j, b in enumerate(sets) if i < j and share(a, b) >= least}
        assert least < 0.5 or set(found) == want
    assert all(np.bitwise_count(retrieve.signature(a) ^ retrieve.signature(b)).sum() <= len(np.setxor1d(a, b)) for a in sets[:10] for b in sets)


@pytest.mark.parametrize(("sf", "least"), [("sf0.001", 0.3), ("sf0.01", 0.5), ("sf0.1", 0.88)])
def test_likeness_of_documents_equals_brute_force(spark, sf, least):
    """All pairs of a slot that share a word, by DuckDB; nothing is left out."""
    import duckdb

    from atomweave.operators.leaf import leaves as stored

    sql = f"""WITH s AS (SELECT CAST(doc_id AS VARCHAR) AS id, CASE doc_id % 8 WHEN 6 THEN 's' WHEN 7 THEN 'p' ELSE 'k' END AS slot, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM '/root/testdata/{sf}/documents.parquet'),
    t AS (SELECT id, slot, len(w) AS n, unnest(w) AS term FROM s), c AS (SELECT slot, term FROM t GROUP BY 1, 2 HAVING count(*) <= 2000),
    m AS (SELECT a.id AS a, b.id AS b, count(*) AS seen FROM t a JOIN c USING (slot, term) JOIN t b USING (slot, term) WHERE a.id < b.id AND b.n >= a.n * {least} AND a.n >= b.n * {least} GROUP BY 1, 2)
    SELECT m.a, m.b, round(len(list_intersect(p.w, q.w)) / (len(p.w) + len(q.w) - len(list_intersect(p.w, q.w))), 6) AS score FROM m JOIN s p ON p.id = m.a JOIN s q ON q.id = m.b WHERE score >= {least}"""
    assert expanded(spark, stored(spark, f"/root/testdata/{sf}"), least) == sorted(duckdb.sql(sql).fetchall())


def test_blocks_of_any_size_give_the_same_best(spark, monkeypatch):
    turn = random.Random(3)
    docs = spark.createDataFrame([(str(k), [float(turn.randint(-2, 2)) for _ in range(4)] if k % 9 else None, turn.choice("abc")) for k in range(150)], "doc_id string, embedding array<float>, slot string")
    queries = spark.createDataFrame([(str(k), [float(turn.randint(-2, 2)) for _ in range(4)]) for k in range(20)] + [("none", None)], "query_id string, query_vector array<float>")
    best = lambda: sorted(map(tuple, retrieve.best(retrieve.scores(docs, queries, 3, "vector", within=("slot",), own=False), ["query_id", "slot"], 3).select("query_id", "slot", "rank", "doc_id", "score").collect()))
    whole = best()
    monkeypatch.setattr(retrieve, "PART_ROWS", 16)
    monkeypatch.setattr(retrieve, "BLOCK_ROWS", 3)
    assert best() == whole and len(whole) == 20 * 9 and not [r for r in whole if r[0] == r[3]]
    cosine = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) / (sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5 if any(a) and any(b) else 0.0
    rows, asked = docs.where("embedding is not null").collect(), {r["query_id"]: r["query_vector"] for r in queries.collect() if r["query_vector"]}
    for q, v in asked.items():
        for slot in "abc":
            scored = sorted((-round(min(1, max(0, cosine(v, r["embedding"]))), 6), r["doc_id"]) for r in rows if r["slot"] == slot and r["doc_id"] != q)[:3]
            assert [(d, s) for a, b, _, d, s in whole if (a, b) == (q, slot)] == [(d, -s) for s, d in scored]


def test_searches_serve_every_query(spark, data):
    from atomweave.plans.catalog import QUERIES

    ids = {r[0] for r in spark.read.parquet(f"{data}/embeddings.parquet").where("vec_id % 100 = 0").select("vec_id").collect()}
    for name in ("multi_slot_search", "recall_ladder", "knowledge_xref", "vector_topk"):
        assert {r[0] for r in QUERIES[name](spark, data).select("query_id").collect()} == ids, name


def test_hybrid_finds_documents_and_items_without_a_vector(spark, data, tmp_path, same_rows):
    import duckdb

    from atomweave.plans.catalog import ORACLES, QUERIES

    for t, kept in {"documents": "true", "embeddings": "vec_id % 3 <> 0", "benchmark": "true"}.items():
        duckdb.sql(f"COPY (SELECT * FROM '{data}/{t}.parquet' WHERE {kept}) TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    want = con.execute(ORACLES["hybrid_topk"]).fetchall()
    found = [tuple(r) for r in QUERIES["hybrid_topk"](spark, str(tmp_path)).collect()]
    assert sorted(r[:3] for r in found) == sorted(r[:3] for r in want)
    assert {q for q, *_ in found} == {r[0] for r in con.execute("SELECT item_id FROM benchmark").fetchall()}


def test_slugs_read_whole_texts(spark, tmp_path):
    from atomweave.plans.catalog import QUERIES

    spark.createDataFrame([(1, "-" * 100 + "Hello, World!"), (2, "!" * 80 + "x" * 200)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r["doc_id"]: r["slug"] for r in QUERIES["slugs"](spark, str(tmp_path)).collect()} == {"1": "hello-world", "2": "x" * 60}


def test_decisions_on_merges(spark):
    names = "keeper_id string, loser_id string, source_pass string"
    pairs = spark.createDataFrame([("k", c, "similarity" if c < "h" else "sha256") for c in "abcdefghij"] + [("m", "z", "similarity")], names)
    rows = [  # what was said of each loser of k
        ("k", "a", "k", "a", "merge", "both of it", True), ("k", "b", "k", "b", "merge", "x" * 50, True), ("k", "c", "k", "other", "merge", "x", True), ("k", "d", "k", "d", "merge", "", True),
        ("k", "e", "k", "e", "merge", "x", False), ("k", "f", "k", "f", "skip", None, True), ("k", "g", "k", "g", "drop", None, True), ("k", "h", "k", "h", "keep-keeper-unchanged", None, True), ("m", "z", "m", "z", "merge", "y" * 60, None),
    ]
    given = spark.createDataFrame(rows, "keeper_id string, loser_id string, said_keeper string, said_loser string, action string, merged_body string, written boolean")
    out = decisions.merges(pairs, given, 40, "now")
    assert {r["loser_id"]: r["outcome"] for r in out.collect()} == {"a": "merge", "b": "wait", "c": "error", "d": "error", "e": "error", "f": "flag", "g": "error", "h": "archive", "i": "archive", "j": "archive", "z": "merge"}
    body = {r["loser_id"]: r["body"] for r in out.collect()}
    assert body["a"] == "both of it" and len(body["z"]) == 40 and body["z"].endswith(decisions.cut_marker("now")) and body["b"] is None
    base = spark.createDataFrame([(c, "old", {"t": "x"}, True) for c in "abkmzf"], "doc_id string, body string, metadata map<string,string>, enabled boolean")
    state = {r["doc_id"]: r for r in decisions.merged(base, out, "now").collect()}
    assert state["k"]["body"] == "both of it" and state["k"]["metadata"] == {"t": "x", "consolidated_at": "now"} and state["k"]["enabled"]
    assert not state["a"]["enabled"] and state["a"]["metadata"]["superseded_by"] == "k" and state["b"]["enabled"] and state["f"]["enabled"]
    counted = decisions.totals(out, []).first()
    assert (counted["merged"], counted["archived"], counted["errors"], counted["flagged"], counted["waiting"]) == (2, 3, 4, 1, 1)


def test_decisions_on_refreshes(spark):
    stale = spark.createDataFrame([(c,) for c in "abcdefg"], "doc_id string")
    rows = [("a", "a", "keep", False, None), ("b", "b", "keep", None, None), ("c", "x", "keep", False, None), ("d", "d", "rewrite", None, "new"), ("e", "e", "rewrite", None, ""), ("f", "f", "archive", None, None)]
    out = decisions.refreshes(stale, spark.createDataFrame(rows, "doc_id string, said_id string, action string, stale_after boolean, rewritten_body string"), 40, "now")
    assert {r["doc_id"]: (r["outcome"], r["stale"]) for r in out.collect()} == {"a": ("keep", "false"), "b": ("keep", "true"), "c": ("error", None), "d": ("refresh", "false"), "e": ("error", None), "f": ("archive", "true"), "g": ("wait", None)}
    base = spark.createDataFrame([(c, "old", {}, True) for c in "abcdefgh"], "doc_id string, body string, metadata map<string,string>, enabled boolean")
    state = {r["doc_id"]: r for r in decisions.refreshed(base, out, "now").collect()}
    assert state["d"]["body"] == "new" and state["d"]["metadata"] == {"stale": "false", "last_refreshed_at": "now", "consolidated_at": "now"} and not state["f"]["enabled"] and state["h"]["metadata"] == {} and state["e"]["body"] == "old"


def test_evidence_and_occurrences(spark):
    failed = spark.createDataFrame([("s", f"e{k % 8}", f"log{k % 9}") for k in range(40)] + [("t", None, "log1"), ("u", "", None)], "signature string, excerpt string, log_path string")
    found = {r["signature"]: r for r in healing.evidence(failed).collect()}
    assert found["s"]["excerpts"] == ["e0", "e1", "e2", "e3", "e4"] and found["s"]["n_excerpts"] == 8 and found["s"]["logs"] == ["log4", "log5", "log6", "log7", "log8"] and found["t"]["n_excerpts"] is None and "u" not in found
    before = spark.createDataFrame([("s", k, 1, 1) for k in range(60)], "signature string, at_ms long, attempts long, n_entities long")
    raised = spark.createDataFrame([("s", 9, 2)], "signature string, attempts long, n_entities long")
    kept = healing.occurrences(before, raised, 100).collect()
    assert len(kept) == 50 and max(r["at_ms"] for r in kept) == 100 and min(r["at_ms"] for r in kept) == 11


def test_saved_documents_tell_what_failed(spark):
    rows = [("s", "a", "text", None), ("s", "b", " ", None), ("s", "c", "text", {"tags": "x"}), ("s", "d", "text", {"odd": "x"}), ("none", "e", "text", {"tags": "x"}), ("s", None, "text", {"tags": "x"}), ("s", "g", "x" * 11, {})]
    fields = spark.createDataFrame([("s", ["tags"])], "slot string, names array<string>")
    out = store.saved(spark.createDataFrame(rows, "slot string, name string, text string, metadata map<string,string>"), fields, 10).collect()
    assert [(r["name"], r["document_ok"], r["metadata_ok"], r["ok"]) for r in sorted(out, key=lambda r: r["name"] or "z")] == [
        ("a", True, True, True), ("b", False, True, False), ("c", True, True, True), ("d", True, False, False), ("e", True, False, False), ("g", False, True, False), (None, False, False, False)]


def test_low_likeness_meets_by_size_in_parts(spark, monkeypatch):
    """Pairs at one half, across octaves of sizes and pairs of parts, equal those of all pairs; a word in every set makes no list."""
    rng = np.random.default_rng(3)
    monkeypatch.setattr(retrieve, "PART_SETS", 7)
    sets = [set(map(int, rng.choice(4_000, size, replace=False))) | {-1} for size in (1, 2, 3, 7, 8, 15, 16, 31, 40, 63, 64, 100, 127, 128, 200, 255, 256, 300)]
    for base in list(sets):
        ordered = sorted(base)
        sets += [set(ordered[: (len(ordered) + 1) // 2]) | {-1}, base | {5_000 + k for k in range(len(base))}, base | {9_000 + k for k in range(len(base) + 1)}, set(ordered[len(ordered) // 5 :]) | {20_000 + len(base)}]
    sets = [list(t) for t in sorted({tuple(sorted(s)) for s in sets})]
    rows = [("one" if k % 5 else "two", f"{k:03d}", s) for k, s in enumerate(sets)]
    reps = spark.createDataFrame(rows, "slot string, rep string, tokens array<long>")
    monkeypatch.setattr(retrieve, "candidates", None)
    found = {(r["slot"], r["a"], r["b"], r["score"]) for r in retrieve.likeness(reps, 0.5).collect()}
    want = {(s, a, b, round(len(x & y) / len(x | y), 6)) for s, a, x in [(s, a, set(x)) for s, a, x in rows] for t, b, y in [(t, b, set(y)) for t, b, y in rows] if s == t and a < b and len(x & y) / len(x | y) >= 0.5 - 5e-7}
    assert found == want and len(want) > 30


@pytest.mark.parametrize("told", [1_000_000, 0])
def test_sets_of_pairs_meet_in_bounded_groups(spark, monkeypatch, told):
    """Pairs far below one half, of a hub and of chains, get the scores of all pairs however groups are cut; sets in no pair don't matter."""
    monkeypatch.setattr(retrieve, "GROUP_SETS", 3)
    monkeypatch.setattr(retrieve, "TOLD_LABELS", told)
    rng = np.random.default_rng(4)
    sets = [(k, "one" if k % 4 else "two", f"{k:02d}", list(map(int, rng.choice(40, 12, replace=False)))) for k in range(40)]
    pairs = [(0, k) for k in range(1, 25)] + [(k, k + 1) for k in range(1, 30)] + [(2, 38)]
    frame = spark.createDataFrame(sets, "label long, slot string, set string, tokens array<long>")
    found = sorted(map(tuple, retrieve.compared(spark.createDataFrame(pairs, "x long, y long"), frame, 0.1).collect()))
    of = {k: (slot, name, set(tokens)) for k, slot, name, tokens in sets}
    want = sorted((of[x][0], of[x][1], of[y][1], score) for x, y in pairs if of[x][0] == of[y][0] and (score := round(len(of[x][2] & of[y][2]) / len(of[x][2] | of[y][2]), 6)) >= 0.1)
    assert found == want and len(want) > 10


def test_low_likeness_of_sets_octaves_apart(spark):
    """Below one half a set meets those of octaves further below."""
    sets = [list(range(n)) for n in (3, 4, 10, 16, 33, 50, 64, 100)]
    reps = spark.createDataFrame([("s", f"{len(s):03d}", s) for s in sets], "slot string, rep string, tokens array<long>")
    for least in (0.12, 0.3):
        found = {(r["a"], r["b"], r["score"]) for r in retrieve.likeness(reps, least).collect()}
        assert found == {(f"{len(a):03d}", f"{len(b):03d}", round(len(a) / len(b), 6)) for a in sets for b in sets if len(a) < len(b) and len(a) / len(b) >= least}


def test_saving_moves_no_texts(spark):
    """Slots are few, so that a join by slot would put most texts into one task."""
    fields = spark.createDataFrame([("knowledge", ["tags"])], "slot string, names array<string>")
    incoming = spark.createDataFrame([("knowledge", f"n{k}", "t" * (k % 4), {"tags": "x"}) for k in range(20)], "slot string, name string, text string, metadata map<string,string>")
    found = store.saved(incoming, fields, 2)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
    assert sorted((r["name"], r["ok"]) for r in found.collect()) == sorted((f"n{k}", k % 4 in (1, 2)) for k in range(20))
