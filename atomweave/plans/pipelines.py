"""Whole passes over the store: consolidation and promotion, with their reports, and streams run to their end."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import atoms, dedup, lifecycle
from ..operators.leaf import leaves, slot_of
from ..schema import ARCHIVE_DAYS, BODY_CHARS, SLOT_POLICIES, STALE_MONTHS
from ..session import checkpointed, scratch_folder
from ..streaming import streams
from .base import NOW, ORACLES, TICKS, query
from .dedup_queries import ALL_PAIRS, STALE, all_pairs
from .state_queries import DEBOUNCE_MS, at_ms
from .text_queries import RAW, raw_atoms

REFINED = tuple(slot for slot, policy in SLOT_POLICIES.items() if policy == "refine")


def consolidated(docs: DataFrame, pairs: DataFrame, now: int) -> dict[str, DataFrame]:
    """What each pass of a consolidation does to documents of slots that are refined: archived and flagged pairs, stale
    flags that change, and archived bodies that are cut. ``pairs`` has every candidate pair with its rank and index."""
    ours = docs.where(F.col("slot").isin(*REFINED))
    mine = ours.select(F.col("doc_id").alias("loser_id"), "slot")
    kept = dedup.deterministic(dedup.retained(pairs)).join(mine, "loser_id")
    return {
        "archive": kept.where("deterministic").withColumn("freed_bytes", F.lit(0).cast("long")),
        "flag": kept.where("not deterministic").withColumn("freed_bytes", F.lit(0).cast("long")),
        "staleness": lifecycle.stale_documents(ours, now, STALE_MONTHS, lifecycle.STALE_TYPES).withColumn("freed_bytes", F.lit(0).cast("long")),
        "compress": lifecycle.compressible(ours, now, BODY_CHARS, ARCHIVE_DAYS),
    }


def report(passes: dict[str, DataFrame]) -> DataFrame:
    """(pass, slot, touched, freed_bytes)."""
    out = None
    for name, touched in passes.items():
        counted = touched.groupBy("slot").agg(F.count("*").alias("touched"), F.sum("freed_bytes").alias("freed_bytes")).select(F.lit(name).alias("pass"), "slot", "touched", "freed_bytes")
        out = counted if out is None else out.unionByName(counted)
    return out


@query(f"""WITH {ALL_PAIRS}, k AS (SELECT r.*, l.slot FROM retained r JOIN leaf l ON l.doc_id = r.loser_id WHERE l.slot <> 'plans'),
c AS (SELECT slot, greatest(0, strlen(body) - strlen(regexp_replace(left(body, {BODY_CHARS - len(lifecycle.TRUNCATED)}), '\\s+$', '') || '..[truncated]')) AS freed FROM leaf
  WHERE slot <> 'plans' AND NOT enabled AND length(body) > {BODY_CHARS} AND {NOW} - created_at_ms > 15552000000)
SELECT CASE WHEN source_pass = 'similarity' THEN 'flag' ELSE 'archive' END AS pass, slot, count(*) AS touched, 0::BIGINT AS freed_bytes FROM k GROUP BY 1, 2
UNION ALL SELECT 'staleness', slot, count(*), 0 FROM leaf WHERE slot <> 'plans' AND enabled AND atom_type IN {STALE} AND {NOW} - created_at_ms > {STALE_MONTHS} * 2629800000 GROUP BY 2
UNION ALL SELECT 'compress', slot, count(*), CAST(sum(freed) AS BIGINT) FROM c GROUP BY 2""")
def consolidate_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(consolidated(leaves(spark, sf_dir), all_pairs(spark, sf_dir), NOW))


def promoted(good: DataFrame, candidates: DataFrame, given: DataFrame | None = None) -> DataFrame:
    """(atom_id, slot, action, target_id, reasons): the decision on each valid atom that passes the rubric, or why it is dropped."""
    judged = atoms.quality(good).withColumn("slot", slot_of(F.col("type")))
    chosen = atoms.decisions(judged.where("ok"), candidates, given)
    dropped = F.when(~F.col("ok"), "drop")
    return judged.join(chosen, "atom_id", "left").select("atom_id", "slot", F.coalesce(dropped, F.col("action")).alias("action"), "target_id", "reasons")


@query(f"""WITH {RAW}, q AS (SELECT *, length(body) >= 80 AND (evidence IS NOT NULL OR regexp_matches(body, '(?is)(^|\\n)\\s*(why|how to apply)\\s*:')) AS ok FROM good)
SELECT CASE type WHEN 'self-improvement-lesson' THEN 'self_improvement' ELSE 'knowledge' END AS slot,
       CASE WHEN NOT ok THEN 'drop' WHEN type = 'self-improvement-lesson' AND error_pattern <> '' THEN 'update' ELSE 'unresolved' END AS action, count(*) AS n FROM q GROUP BY 1, 2""")
def compile_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = atoms.validated(raw_atoms(spark, sf_dir)).withColumn("atom_id", F.concat_ws("-", "conv_id", "turn"))
    first = good.groupBy("project_module").agg(F.min_by("atom_id", F.struct("conv_id", "turn")).alias("doc_id"))
    candidates = good.select("atom_id", "project_module").join(first, "project_module").select("atom_id", F.lit(1).alias("rank"), "doc_id")
    return promoted(good, candidates).groupBy("slot", "action").agg(F.count("*").alias("n"))


def run_stream(spark: SparkSession, sf_dir: str, transform: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """All rows that a stream over the events gives, from what is there now; batches and state go to the shared folder, and are removed once
    the rows are checkpointed."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    with scratch_folder(spark) as path:
        # a pattern, as a stream takes a plain path for a folder
        out = transform(spark.readStream.schema(schema).parquet(f"{sf_dir}/event[s].parquet"))

        def keep(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{path}/out/batch={number}")

        query = out.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
        query.awaitTermination()
        return checkpointed(spark.read.schema(out.schema).option("basePath", f"{path}/out").parquet(f"{path}/out/*"))


@query(ORACLES["recall_stamp_debounce"])
def stream_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    def stamps(events: DataFrame) -> DataFrame:
        hits = events.where(F.col("event_type").isin("view", "click")).select(F.col("user_id").cast("string").alias("doc_id"), at_ms().alias("at_ms"))
        return streams.recall_stamps(hits, DEBOUNCE_MS)

    return run_stream(spark, sf_dir, stamps).groupBy("doc_id").agg(F.max("stamps").alias("stamps"), F.max("last_ms").alias("last_ms"))


@query(f"WITH {TICKS} SELECT entity, failures, signature FROM streak")
def stream_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    def folded(events: DataFrame) -> DataFrame:
        k = F.get_json_object("props", "$.k").cast("long")
        return streams.failure_streaks(events.select(F.col("user_id").cast("string").alias("entity"), F.col("event_id").alias("tick"), at_ms().alias("at_ms"), (F.col("event_type") != "error").alias("ok"), F.concat(F.lit("sig-"), (k % 5).cast("string")).alias("signature")))

    return run_stream(spark, sf_dir, folded).where("failures > 0").select("entity", "failures", "signature")


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n_entries, CAST(sum(length(props)) AS BIGINT) AS n_chars FROM events GROUP BY 1")
def stream_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    def counted(events: DataFrame) -> DataFrame:
        return streams.daily_counts(events.select(F.timestamp_millis(at_ms()).alias("at"), F.col("props").alias("text")), "at")

    found = run_stream(spark, sf_dir, counted)
    return found.groupBy(F.date_format("day", "yyyy-MM-dd").alias("day")).agg(F.max("n_entries").alias("n_entries"), F.max("n_chars").alias("n_chars"))


@query("""SELECT 'daily-' || strftime(ts, '%Y-%m-%d') || '.md' AS name, count(*) AS n_entries, sha256(string_agg(props, chr(10) || chr(10) ORDER BY epoch_us(ts) // 1000, CAST(event_id AS VARCHAR))) AS text_sha FROM events GROUP BY 1""")
def stream_day_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last text of every day, whether it has closed by then or not."""

    def texts(events: DataFrame) -> DataFrame:
        at = F.timestamp_millis(at_ms())
        return streams.day_texts(events.select(at.alias("captured_at"), at.alias("arrived_at"), F.col("event_id").cast("string").alias("entry_id"), F.col("props").alias("text")))

    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        found = run_stream(spark, sf_dir, texts)
    finally:
        spark.conf.set(name, before)
    return found.where("kind <> 'late'").groupBy("name").agg(F.max("n_entries").alias("n_entries"), F.sha2(F.max_by("text", "n_entries"), 256).alias("text_sha"))
