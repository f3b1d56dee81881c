"""Sources read files; streams give what batches give."""

import json

from pyspark.sql import functions as F

from atomweave.operators import healing, lifecycle
from atomweave.plans.state_queries import hits, ticks
from atomweave.sources import files
from atomweave.streaming import streams


def test_scan_files(spark, tmp_path):
    for path, text in {"a.md": "x", "docs/b.txt": "yy", "node_modules/c.md": "z", "d.py": "q"}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    assert [(r["rel_path"], r["doc_name"], r["size"]) for r in files.scan_files(spark, str(tmp_path)).collect()] == [("a.md", "a.md", 1), ("docs/b.txt", "docs_b.txt", 2)]
    assert [r["rel_path"] for r in files.scan_files(spark, str(tmp_path), include=["**/*.py"]).collect()] == ["d.py"]


def test_texts_nest_deeply(spark, tmp_path):
    inner = "deep"
    for _ in range(3):
        inner = {"content": [inner]}
    lines = [{"type": "user", "message": {"role": "user", "content": inner}}, {"type": "summary", "summary": "told"}, {"role": "assistant", "content": [{"type": "tool_use", "text": "no"}, {"type": "text", "text": "yes"}, [[["in lists"]]]]}]
    (tmp_path / "t.jsonl").write_text("\n".join([*map(json.dumps, lines), "{broken", '["a"]', '{"type": "odd", "text": "x"}']))
    assert [(r["role"], r["text"]) for r in files.transcripts(spark, str(tmp_path / "t.jsonl")).orderBy("turn").collect()] == [("user", "deep"), ("summary", "told"), ("assistant", "yes\nin lists")]


def test_transcripts(spark, tmp_path):
    lines = [{"message": {"role": "user", "content": "hi"}}, {"role": "assistant", "content": [{"type": "text", "text": "one"}, {"type": "tool_use", "text": "no"}, {"type": "text", "text": "two"}]}, {"role": "tool", "content": "no"}]
    (tmp_path / "t.jsonl").write_text("\n".join(map(json.dumps, lines)) + "\nnot json\n")
    assert [(r["role"], r["text"]) for r in files.transcripts(spark, str(tmp_path / "t.jsonl")).orderBy("turn").collect()] == [("user", "hi"), ("assistant", "one\ntwo")]


def test_attempts(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"ts": "2024-01-01T00:00:00Z", "kind": "k", "ok": true}\nbroken\n{"ts": "2024-01-02T00:00:00Z", "kind": "k", "ok": false}\n')
    assert [r["ok"] for r in files.attempts(spark, str(tmp_path / "log.jsonl"), 1).collect()] == [False]
    listing = spark.createDataFrame([("x/cron-100.json",), ("x/cron-86400000.json",), ("x/other",)], "path string")
    assert [r["path"] for r in files.kept_logs(listing, 2 * 86_400_000, 1).collect()] == ["x/cron-86400000.json"]


def streamed(spark, frame, transform, tmp_path, name, parts=3, order="at_ms"):
    """Runs a stream over a table that was split in files, in order of time, and gives the last row of each key."""
    ranked = frame.repartitionByRange(parts, order).sortWithinPartitions(order)
    for k, file in enumerate(sorted({r[0] for r in ranked.select(F.spark_partition_id()).distinct().collect()})):
        ranked.where(F.spark_partition_id() == file).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{k:03d}")
    source = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    query = transform(source).writeStream.outputMode("update").format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination(120)
    return spark.table(name)


def test_streamed_stamps_equal_batch(spark, data, tmp_path):
    given = hits(spark, data)
    out = streamed(spark, given, lambda s: streams.recall_stamps(s, 86_400_000), tmp_path, "stamps").groupBy("doc_id").agg(F.max("stamps").alias("stamps"), F.max("last_ms").alias("last_ms"))
    batch = lifecycle.accepted_stamps(given, "doc_id", "at_ms", 86_400_000)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, batch.collect()))


def test_streamed_streaks_equal_batch(spark, data, tmp_path):
    given = ticks(spark, data).withColumn("tick", F.col("at_ms") * 1000 + F.col("tick") % 1000)
    out = streamed(spark, given, streams.failure_streaks, tmp_path, "streaks", parts=1)
    got = {r["entity"]: (r["failures"], r["signature"]) for r in out.collect() if r["failures"]}
    assert got == {r["entity"]: (r["failures"], r["signature"]) for r in healing.streaks(given).collect()}


def test_daily_stream(spark, tmp_path):
    given = spark.createDataFrame([("2024-01-01 10:00:00", "ab"), ("2024-01-01 23:59:59", "c"), ("2024-01-02 00:00:00", "d"), ("2024-02-01 00:00:00", "e")], "at string, text string").select(F.to_timestamp("at").alias("at"), "text")
    out = streamed(spark, given, lambda s: streams.daily_counts(s, "at"), tmp_path, "days", parts=1, order="at")
    assert {(str(r["day"]), r["n_entries"], r["n_chars"]) for r in out.collect()} == {("2024-01-01", 2, 3), ("2024-01-02", 1, 1), ("2024-02-01", 1, 1)}
