"""Queries on recall stamps, daily documents, failures and health."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import healing, lifecycle
from ..operators.leaf import table
from ..schema import ACTIVE_DAYS, ESCALATE_AFTER, ESCALATE_ENTITIES, PROMOTION_TRIES, RECALL_DEBOUNCE_HOURS
from .base import TICKS, query

DEBOUNCE_MS = RECALL_DEBOUNCE_HOURS * 3_600_000


def at_ms(ts: str = "ts"):
    """Milliseconds of a time without a zone, whatever the session's zone is."""
    return F.expr(f"timestampdiff(MILLISECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', {ts})")


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views and clicks as recall hits of documents."""
    return table(spark, sf_dir, "events").where(F.col("event_type").isin("view", "click")).select(F.col("user_id").cast("string").alias("doc_id"), at_ms().alias("at_ms"))


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("entity"), F.col("event_id").alias("tick"), at_ms().alias("at_ms"), (F.col("event_type") != "error").alias("ok"), F.concat(F.lit("sig-"), (k % 5).cast("string")).alias("signature"))


@query(f"""WITH RECURSIVE h AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS doc_id, epoch_us(ts) // 1000 AS at_ms FROM events WHERE event_type IN ('view', 'click')),
r(doc_id, stamps, last_ms) AS (SELECT doc_id, CAST(1 AS BIGINT), min(at_ms) FROM h GROUP BY 1 UNION ALL SELECT r.doc_id, r.stamps + 1, min(h.at_ms) FROM r JOIN h ON h.doc_id = r.doc_id AND h.at_ms >= r.last_ms + {DEBOUNCE_MS} GROUP BY r.doc_id, r.stamps)
SELECT doc_id, max(stamps) AS stamps, max(last_ms) AS last_ms FROM r GROUP BY 1""")
def recall_stamp_debounce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.accepted_stamps(hits(spark, sf_dir), "doc_id", "at_ms", DEBOUNCE_MS)


@query(f"WITH {TICKS} SELECT * FROM streak")
def failure_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return healing.streaks(ticks(spark, sf_dir))


@query(f"""WITH {TICKS}, g AS (SELECT signature, max(failures) AS attempts, min(first_ms) AS first_ms, max(last_ms) AS last_ms, count(*) AS n_entities, array_to_string(list_sort(list(entity))[1:5], ',') AS entities FROM streak GROUP BY 1)
SELECT signature, CASE WHEN attempts >= {ESCALATE_AFTER} THEN 'pending-consecutive' ELSE 'recurring-bug' END AS reason, attempts, first_ms, last_ms, n_entities, entities FROM g WHERE attempts >= {ESCALATE_AFTER} OR n_entities >= {ESCALATE_ENTITIES}""")
def escalations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return healing.escalations(healing.streaks(ticks(spark, sf_dir)), ESCALATE_AFTER, ESCALATE_ENTITIES)


@query(f"""WITH {TICKS}, known AS (SELECT DISTINCT 'sig-' || CAST(CAST(json_extract_string(props, '$.k') AS BIGINT) % 7 AS VARCHAR) AS signature FROM events),
raised AS (SELECT signature FROM streak GROUP BY 1 HAVING max(failures) >= {ESCALATE_AFTER} OR count(*) >= {ESCALATE_ENTITIES})
SELECT coalesce(k.signature, r.signature) AS signature, CASE WHEN k.signature IS NULL THEN 1 WHEN r.signature IS NOT NULL AND k.signature = 'sig-1' THEN 2 ELSE 1 END::BIGINT AS version,
  CASE WHEN r.signature IS NOT NULL THEN 'open' WHEN k.signature = 'sig-1' THEN 'resolved' WHEN k.signature NOT IN (SELECT signature FROM streak) THEN 'resolved' ELSE 'open' END AS status
FROM known k FULL JOIN raised r ON r.signature = k.signature""")
def issue_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    signature = F.concat(F.lit("sig-"), (k % 7).cast("string"))
    known = table(spark, sf_dir, "events").select(signature.alias("signature")).distinct().withColumn("version", F.lit(1).cast("long")).withColumn("status", F.when(F.col("signature") == "sig-1", "resolved").otherwise("open"))
    streak = healing.streaks(ticks(spark, sf_dir))
    return healing.issues(known, streak, healing.escalations(streak, ESCALATE_AFTER, ESCALATE_ENTITIES))


@query(f"""WITH {TICKS}, k AS (SELECT 'kind-' || CAST(CAST(entity AS BIGINT) % 20 AS VARCHAR) AS kind, * FROM ticks), s AS (SELECT 'kind-' || CAST(CAST(entity AS BIGINT) % 20 AS VARCHAR) AS kind, count(*) AS open FROM streak WHERE failures >= {ESCALATE_AFTER} GROUP BY 1)
SELECT k.kind, CASE WHEN coalesce(any_value(s.open), 0) > 0 THEN 'unhealthy: open escalation' WHEN NOT arg_max(ok, tick) THEN 'unhealthy: last attempt failed' ELSE 'healthy' END AS verdict, coalesce(max(at_ms) FILTER (NOT ok), -1) AS last_failure_ms
FROM k LEFT JOIN s ON s.kind = k.kind GROUP BY 1""")
def cron_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.concat(F.lit("kind-"), (F.col("entity").cast("long") % 20).cast("string")).alias("kind")
    all_ticks = ticks(spark, sf_dir)
    open_counts = healing.streaks(all_ticks).where(F.col("failures") >= ESCALATE_AFTER).groupBy(kind).agg(F.count("*").alias("open"))
    return healing.health(all_ticks.select(kind, "tick", "at_ms", "ok"), open_counts).fillna(-1, ["last_failure_ms"])


DAYS = """days AS (SELECT CASE WHEN conv_id % 12 = 11 THEN 'daily-notes.md' ELSE 'daily-' || strftime(DATE '2023-11-14' - CAST(conv_id % 12 AS INTEGER), '%Y-%m-%d') || '.md' END AS name, conv_id % 12 AS age, count(*) AS word_count FROM conversations GROUP BY 1, 2)"""


def days(spark: SparkSession, sf_dir: str) -> DataFrame:
    age = F.col("conv_id") % 12
    name = F.when(age == 11, "daily-notes.md").otherwise(F.concat(F.lit("daily-"), F.date_format(F.date_sub(F.lit("2023-11-14").cast("date"), age.cast("int")), "yyyy-MM-dd"), F.lit(".md")))
    return table(spark, sf_dir, "conversations").groupBy(name.alias("name"), age.alias("k")).agg(F.count("*").alias("word_count"))


@query(f"""WITH {DAYS} SELECT name, CASE WHEN age < 11 THEN age ELSE -1 END AS age, CASE WHEN age = 11 OR age <= 0 THEN 'skip-today' WHEN age >= {ACTIVE_DAYS} THEN 'retire' WHEN age % 2 = 1 OR age % 3 = 0 THEN 'promote' ELSE 'skip-promoted' END AS verb FROM days""")
def daily_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = days(spark, sf_dir)
    promoted = found.where("k % 2 = 0").select("name", (F.col("word_count") + F.when(F.col("k") % 3 == 0, 1).otherwise(0)).alias("word_count"))
    return lifecycle.classify_daily(found.select("name", "word_count"), promoted, "2023-11-14", ACTIVE_DAYS).fillna(-1, ["age"])


@query(f"""WITH a AS (SELECT user_id, count(*) FILTER (event_type = 'error') AS attempts, max(ts) < TIMESTAMP '2024-01-01' AS aged_out FROM events GROUP BY 1)
SELECT CAST(user_id AS VARCHAR) AS doc_id, attempts, CASE WHEN attempts < {PROMOTION_TRIES} THEN 'retry' WHEN aged_out THEN 'disable' ELSE 'mark-promoted' END AS action FROM a""")
def retry_giveup(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = F.max("ts") < F.lit("2024-01-01").cast("timestamp_ntz")
    found = table(spark, sf_dir, "events").groupBy(F.col("user_id").cast("string").alias("doc_id")).agg(F.count_if(F.col("event_type") == "error").alias("attempts"), last.alias("aged_out"))
    return lifecycle.give_up(found, PROMOTION_TRIES).select("doc_id", "attempts", "action")
