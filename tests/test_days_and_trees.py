"""Days that a stream builds, and folders that tasks list."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from atomweave.functions import globs as G
from atomweave.operators import atoms
from atomweave.sources import files, tree
from atomweave.streaming import streams

ENTRY = "captured_at timestamp, arrived_at timestamp, entry_id string, text string"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@pytest.fixture
def rocks(spark):
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(PROVIDER, before)


def at(text):
    return dt.datetime.fromisoformat(text).replace(tzinfo=dt.UTC)


def run_batches(spark, folder, batches):
    """Rows that the stream gives, by batch of the source."""
    for rows in batches:
        spark.createDataFrame([(at(c), at(a), i, t) for c, a, i, t in rows], ENTRY).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        source = spark.readStream.schema(ENTRY).parquet(f"{folder}/in")
        told = streams.day_texts(source).writeStream.outputMode("update").option("checkpointLocation", f"{folder}/state")
        told.foreachBatch(lambda batch, n: batch.withColumn("batch", F.lit(n)).write.mode("append").parquet(f"{folder}/out")).trigger(availableNow=True).start().awaitTermination()
    return [tuple(r) for r in spark.read.parquet(f"{folder}/out").orderBy("batch", "kind", "name").select("name", "kind", "n_entries", "text", "entry_id").collect()]


def test_days_are_built_closed_and_followed_by_late_entries(spark, tmp_path, rocks):
    rows = run_batches(spark, str(tmp_path), [
        [("2024-01-01T10:00", "2024-01-01T10:01", "b", "two "), ("2024-01-01T09:00", "2024-01-01T10:01", "a", "one"), ("2024-01-02T00:30", "2024-01-02T00:30", "c", "next")],
        [("2024-01-01T23:59", "2024-01-02T00:40", "d", "three")],  # after midnight, within the grace
        [("2024-01-02T08:00", "2024-01-02T08:00", "e", None)],
        [("2024-01-01T12:00", "2024-01-02T09:00", "f", "too late"), ("2024-01-01T12:30", "2024-01-02T09:00", "g", "too")],
    ])
    first, second = "daily-2024-01-01.md", "daily-2024-01-02.md"
    assert (first, "open", 2, "one\n\ntwo ", None) in rows and (first, "open", 3, "one\n\ntwo\n\nthree", None) in rows
    assert [r for r in rows if r[1] == "closed"] == [(first, "closed", 3, "one\n\ntwo\n\nthree", None)]
    assert sorted(r for r in rows if r[1] == "late") == [(first, "late", 1, "too", "g"), (first, "late", 1, "too late", "f")]
    assert (second, "open", 2, "next\n\n", None) in rows


def test_day_text_is_that_of_columns(spark):
    for entries in ([], [(1, "a", "x")], [(2, "b", "y\n "), (1, "a", "x  ")], [(1, "a", "  "), (2, "b", "z")], [(1, "a", "p"), (1, "A", "q")]):
        prior = F.lit("")
        for _, _, text in sorted(entries):
            prior = atoms.merged_day(prior, F.lit(text))
        assert spark.range(1).select(prior.alias("t")).first()["t"] == streams.day_text(entries)


def make_tree(root):
    for path in ("a.md", "docs/b.txt", "docs/deep/c.md", "node_modules/x/y.md", "docs/build/z.md", ".git/h.md", "mine/skip/k.md", "mine/n.md"):
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(path)
    (root / "link").symlink_to(root / "docs")
    (root / "docs" / "up").symlink_to(root)
    (root / "linked.md").symlink_to(root / "a.md")


def test_ignored_folders_are_not_listed_and_links_not_followed(spark, tmp_path):
    make_tree(tmp_path)
    found, listed = tree.walked(spark, str(tmp_path), [*G.default_ignored(), "mine/skip", "mine/skip/**"])
    assert sorted(r["folder"] for r in listed.collect()) == ["", "docs", "docs/deep", "mine"]
    assert sorted(r["rel_path"] for r in found.collect()) == ["a.md", "docs/b.txt", "docs/deep/c.md", "mine/n.md"]
    scanned = files.scan_files(spark, f"file://{tmp_path}", ignore=["mine/skip", "mine/skip/**"], content=True).collect()
    assert [(r["rel_path"], bytes(r["content"]).decode(), r["size"]) for r in scanned] == [(p, p, len(p)) for p in ("a.md", "docs/b.txt", "docs/deep/c.md", "mine/n.md")]
    assert files.scan_files(spark, str(tmp_path / "none")).count() == 0


def test_plans_are_read_from_files(spark, tmp_path):
    make_tree(tmp_path)
    plans = files.plan_files(spark, str(tmp_path)).collect()
    assert {(r["rel_path"], r["plan"], r["approved"]) for r in plans} == {(p, p, True) for p in ("a.md", "docs/deep/c.md", "mine/n.md", "mine/skip/k.md")}
    assert [r["modified"] for r in plans] == sorted(r["modified"] for r in plans)


def test_logs_are_appended_by_month(spark, tmp_path):
    rows = spark.createDataFrame([(0, "k"), (86_400_000 * 40, "m")], "at_ms long, kind string")
    files.append_log(rows, str(tmp_path / "log"))
    files.append_log(rows, str(tmp_path / "log"))
    assert sorted({(p.parent.parent.name, p.parent.name) for p in (tmp_path / "log").rglob("*.json")}) == [("year=1970", "month=01"), ("year=1970", "month=02")]
    assert spark.read.json(str(tmp_path / "log")).count() == 4


def test_lines_are_numbered_across_blocks(spark, tmp_path):
    (tmp_path / "a.txt").write_text("".join(f"line {k} of a\n" for k in range(500)))
    (tmp_path / "b.txt").write_text("only\n\nthird")
    (tmp_path / "c.txt").write_text("")
    before = {n: spark.conf.get(n) for n in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        found = files.numbered_lines(spark, str(tmp_path))
        assert found.rdd.getNumPartitions() > 5
        rows = sorted((r["path"].rsplit("/", 1)[1], r["line"], r["value"]) for r in found.collect())
    finally:
        for n, v in before.items():
            spark.conf.set(n, v)
    assert rows == sorted([("a.txt", k, f"line {k} of a") for k in range(500)] + [("b.txt", 0, "only"), ("b.txt", 1, ""), ("b.txt", 2, "third")])


def test_the_text_of_a_long_day_takes_time_in_proportion():
    import time

    began = time.process_time()
    text = streams.day_text([(k, str(k), f"entry {k} " + "x" * 60) for k in range(150_000)])
    assert text.count("\n\n") == 149_999 and time.process_time() - began < 10
    for texts in ([], [" "], ["a ", " ", "b"], [" ", "\n", " c "], ["a", " "], [" ", "a\n\n", "", "b "]):
        out = ""
        for t in texts:
            out = t if not out.strip() else f"{out.rstrip()}\n\n{t}"
        assert streams.day_text([(k, "", t) for k, t in enumerate(texts)]) == out
