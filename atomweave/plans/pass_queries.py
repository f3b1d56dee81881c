"""Whole passes over a stored version, committed and read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import atoms, healing, lifecycle, passes, store
from ..operators.leaf import leaves, table
from ..schema import ACTIVE_DAYS, ARCHIVE_DAYS, BODY_CHARS, DAY_MS, LESSON, PROMOTION_TRIES, STALE_MONTHS
from ..session import checkpointed, scratch_folder
from .base import LEAF, NOW, query, slug_sql
from .dedup_queries import KEYED, SHA, STALE
from .state_queries import at_ms
from .store_queries import _CUT, AT, STAMP, decided_on, metadata, refreshes_given
from .text_queries import RAW, raw_atoms

# consolidation ------------------------------------------------------------------------------------------------------

#: Stale documents of a slot whose decisions count in one pass.
REFRESH_MOST = 50
_LOSS = f"""{LEAF.replace("leaf AS", "all_leaf AS", 1)}, leaf AS (SELECT * FROM all_leaf WHERE enabled AND slot <> 'plans'), {SHA}, {KEYED},
pairs AS (SELECT *, 0 AS pass_rank FROM sha WHERE keeper_id <> loser_id UNION ALL SELECT *, 1 FROM keyed WHERE keeper_id <> loser_id),
retained AS (SELECT loser_id, keeper_id, source_pass FROM pairs QUALIFY row_number() OVER (PARTITION BY loser_id ORDER BY pass_rank, keeper_id) = 1),
walk(loser_id, cur, depth) AS (SELECT loser_id, keeper_id, 1 FROM retained UNION ALL SELECT w.loser_id, r.keeper_id, w.depth + 1 FROM walk w JOIN retained r ON r.loser_id = w.cur),
ends AS (SELECT loser_id, arg_max(cur, depth) AS keeper_id FROM walk GROUP BY 1),
told AS (SELECT e.*, l.body AS loser_body, CASE CAST(e.loser_id AS BIGINT) % 7 WHEN 0 THEN 'archive' WHEN 2 THEN 'flag' WHEN 4 THEN CASE WHEN l.body = '' THEN 'error' ELSE 'merge' END WHEN 6 THEN 'archive' ELSE 'error' END AS first FROM ends e JOIN leaf l ON l.doc_id = e.loser_id),
outcomes AS (SELECT *, CASE WHEN first = 'merge' AND row_number() OVER (PARTITION BY keeper_id, first ORDER BY loser_id) > 1 THEN 'wait' ELSE first END AS outcome FROM told),
lost AS (SELECT loser_id AS doc_id, keeper_id, outcome FROM outcomes WHERE outcome IN ('merge', 'archive')), kept AS (SELECT keeper_id AS doc_id, {_CUT.format(b="loser_body")} AS body FROM outcomes WHERE outcome = 'merge'),
live AS (SELECT *, atom_type IN {STALE} AND {NOW} - created_at_ms > {STALE_MONTHS} * 2629800000 AS is_stale, n % 4 = 0 AS was_stale FROM leaf WHERE doc_id NOT IN (SELECT doc_id FROM lost) AND doc_id NOT IN (SELECT doc_id FROM kept)),
asked AS (SELECT *, n // 8 % 7 AS k FROM live WHERE is_stale QUALIFY row_number() OVER (PARTITION BY slot ORDER BY doc_id) <= {REFRESH_MOST}),
renewed AS (SELECT doc_id, body, CASE WHEN k IN (2, 3) THEN 'keep' WHEN k = 4 AND body <> '' THEN 'refresh' WHEN k = 5 THEN 'archive' END AS did, CASE WHEN k = 3 OR k = 5 THEN 'true' ELSE 'false' END AS flag FROM asked WHERE k IN (2, 3, 5) OR (k = 4 AND body <> '')),
cut AS (SELECT doc_id, regexp_replace(left(body, {BODY_CHARS - len(lifecycle.TRUNCATED)}), '\\s+$', '') || chr(10) || chr(10) || '[truncated]' AS body FROM all_leaf WHERE slot <> 'plans' AND NOT enabled AND length(body) > {BODY_CHARS} AND {NOW} - created_at_ms > {ARCHIVE_DAYS * DAY_MS}),
state AS (SELECT a.doc_id, l.outcome, r.did, kept.doc_id IS NOT NULL AS is_kept, cut.doc_id IS NOT NULL AS is_cut, v.is_stale IS NOT NULL AND v.is_stale <> v.was_stale AND r.did IS NULL AS flagged, a.enabled AND coalesce(l.outcome, '') = '' AND coalesce(r.did, '') <> 'archive' AS enabled,
  coalesce(kept.body, cut.body, CASE WHEN r.did = 'refresh' THEN {_CUT.format(b="r.body")} END, a.body) AS body, CASE WHEN r.flag IS NOT NULL THEN r.flag WHEN v.is_stale <> v.was_stale THEN CASE WHEN v.is_stale THEN 'true' ELSE 'false' END WHEN a.n % 4 = 0 THEN 'true' END AS stale,
  l.keeper_id AS superseded_by, CASE WHEN l.doc_id IS NOT NULL OR kept.doc_id IS NOT NULL OR r.did IN ('refresh', 'archive') THEN '{AT}' END AS consolidated_at, CASE WHEN r.did = 'refresh' THEN '{AT}' END AS last_refreshed_at, CASE WHEN cut.doc_id IS NOT NULL THEN '{AT}' END AS truncated_at
  FROM all_leaf a LEFT JOIN lost l ON l.doc_id = a.doc_id LEFT JOIN kept ON kept.doc_id = a.doc_id LEFT JOIN live v ON v.doc_id = a.doc_id LEFT JOIN renewed r ON r.doc_id = a.doc_id LEFT JOIN cut ON cut.doc_id = a.doc_id)"""


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as a store keeps them, every fourth with a stale flag."""
    docs = leaves(spark, sf_dir).withColumn("stale", F.when(F.col("n") % 4 == 0, "true"))
    return docs.withColumn("metadata", metadata("atom_type", "stale"))


def store_columns(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "slot", "name", "atom_type", "project_module", "task_type", "error_pattern", "enabled", "created_at_ms", "last_recalled_at", "metadata", "body")


def consolidate(base: DataFrame, docs: DataFrame) -> DataFrame:
    """A consolidation of ``base``, with decisions of each kind."""
    active = base.where(F.col("slot").isin(*passes.REFINED) & F.coalesce("enabled", F.lit(True)))
    pairs = passes.candidate_pairs(active)
    return passes.consolidated(base, pairs, decided_on(pairs, base), refreshes_given(docs), NOW, AT, REFRESH_MOST)


@query(f"""WITH RECURSIVE {_LOSS} SELECT doc_id, enabled, sha256(body) AS body_sha, stale, superseded_by, consolidated_at, last_refreshed_at, truncated_at FROM state""")
def consolidated_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = stored(spark, sf_dir)
    with scratch_folder(spark) as folder:
        shelf = store.Snapshots(spark, f"{folder}/store")
        shelf.commit(store_columns(docs))
        passes.committed(shelf, lambda base: consolidate(base, docs), passes.PAIR_KINDS)
        field = lambda name, alias=None: F.element_at("metadata", name).alias(alias or name)
        state = shelf.read().select("doc_id", "enabled", F.sha2("body", 256).alias("body_sha"), field("stale"), field("superseded_by"), field("consolidated_at"), field("last_refreshed_at"), field("consolidate_truncated_at", "truncated_at"))
        return checkpointed(state)


@query(f"""WITH RECURSIVE {_LOSS}, c AS (SELECT unnest(['pair-archive', 'pair-merge', 'pair-keeper', 'stale-flag', 'refresh-keep', 'refresh-refresh', 'refresh-archive', 'compress']) AS done,
  unnest([count(*) FILTER (outcome = 'archive'), count(*) FILTER (outcome = 'merge'), count(*) FILTER (is_kept), count(*) FILTER (flagged), count(*) FILTER (did = 'keep'), count(*) FILTER (did = 'refresh'), count(*) FILTER (did = 'archive'), count(*) FILTER (is_cut)]) AS n FROM state)
SELECT done, 2 * n AS n FROM c""")
def consolidated_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters over two passes, of which each began with the same documents: those of the first version are put back between."""
    docs = stored(spark, sf_dir)
    with scratch_folder(spark) as folder:
        shelf = store.Snapshots(spark, f"{folder}/store")
        shelf.commit(store_columns(docs))
        for _ in range(2):
            version = passes.committed(shelf, lambda base: consolidate(base, docs), passes.PAIR_KINDS)
            shelf.put_back(1, told=shelf.told(version))
        return spark.createDataFrame(sorted(shelf.told().items()), "done string, n long")  # one row for each kind


# promotion ----------------------------------------------------------------------------------------------------------

TODAY = "2023-11-14"
OLD_NAME = "2020-01-02-030405678"
_DAY = "CASE k WHEN 11 THEN 'daily-notes.md' ELSE 'daily-' || strftime(DATE '2023-11-14' - CAST(k AS INTEGER), '%Y-%m-%d') || '.md' END"
PROMOTION = f"""{RAW}, g AS (SELECT *, conv_id % 12 AS k, row_number() OVER (PARTITION BY conv_id % 12 ORDER BY conv_id, turn) AS pos, trim(string_split(title, chr(10))[1]) AS t1, regexp_replace(body, '\\s+$', '') AS b1 FROM good),
acts AS (SELECT *, 'day-' || k || '-' || pos AS atom_id, pos % 3 = 0 AS has, 'old-' || (pos % 5) AS cand, type = '{LESSON}' AND error_pattern <> '' AS forced FROM g WHERE k IN (1, 2, 3, 4, 5, 7, 9, 10)),
done AS (SELECT *, CASE WHEN forced AND has THEN 'update' WHEN k % 2 = 1 AND pos % 4 = 3 THEN 'skip' WHEN NOT has OR pos % 4 = 0 THEN 'create' WHEN pos % 4 = 1 THEN 'update' WHEN k % 2 = 0 THEN 'create' ELSE 'error' END AS action FROM acts),
wrong AS (SELECT DISTINCT k FROM done WHERE action = 'error' OR (k = 4 AND pos = 1)),
days AS (SELECT DISTINCT g.k, wrong.k IS NOT NULL AS wrong, CASE WHEN g.k IN (5, 9) THEN 2 ELSE 0 END AS tries, g.k IN (1, 2, 3, 4, 5, 7, 9, 10) AS read, g.k >= {ACTIVE_DAYS} AND g.k < 11 AS old FROM g LEFT JOIN wrong ON wrong.k = g.k),
made AS (SELECT *, CASE WHEN type = '{LESSON}' THEN 'self_improvement' ELSE 'knowledge' END AS slot, CASE WHEN type = '{LESSON}' THEN 'lesson' ELSE 'knowledge' END || '-' || CASE WHEN action = 'update' AND pos % 5 < 3 AND type <> '{LESSON}' THEN 'old-' || (pos % 5) ELSE {slug_sql("t1")} END || '-{STAMP}.md' AS name
  FROM done WHERE action IN ('create', 'update'))"""
_TEXT = """'# ' || t1 || chr(10) || chr(10) || '- type: ' || type || chr(10) || '- tags: [' || tag || ']' || chr(10) || '- project_module: ' || project_module || chr(10) || '- language: ' || chr(10) || '- task_type: ' || task_type || chr(10) || '- error_pattern: ' || error_pattern || chr(10) ||
  '- updated_at_utc: {at}' || chr(10) || chr(10) || CASE WHEN action = 'update' AND pos % 4 = 1 THEN 'Merged.' ELSE b1 || CASE WHEN evidence IS NOT NULL THEN chr(10) || chr(10) || 'evidence: ' || evidence ELSE '' END END || chr(10)""".format(at=AT)


def day_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Day documents of atoms, and the documents that some of them replace."""
    good = atoms.validated(raw_atoms(spark, sf_dir)).withColumn("k", F.col("conv_id") % 12).withColumn("place", F.col("conv_id") * 1_000_000 + F.col("turn"))
    # a day holds a twelfth of the conversations
    written = atoms.rendered(good, ["k"], "place", F.lit("# Daily flush"))
    k = F.col("k")
    name = F.when(k == 11, "daily-notes.md").otherwise(F.concat(F.lit("daily-"), F.date_format(F.date_sub(F.lit(TODAY).cast("date"), k.cast("int")), "yyyy-MM-dd"), F.lit(".md")))
    words = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    was = F.when(k.isin(6, 8), words).when(k == 3, words + 1).cast("string")
    tries = F.when(k.isin(5, 9), "2")
    held = F.map_filter(F.create_map(F.lit(passes.PROMOTED_WORDS), was, F.lit(passes.TRIES), tries), lambda a, b: b.isNotNull())
    none = F.lit(None).cast("string")
    days = written.select(F.concat(F.lit("day-"), k.cast("string")).alias("doc_id"), F.lit(passes.DAILY).alias("slot"), name.alias("name"), none.alias("atom_type"), F.lit(True).alias("enabled"), F.lit(NOW - 1).alias("created_at_ms"), none.alias("last_recalled_at"), held.alias("metadata"), F.col("text").alias("body"))
    old = [(f"old-{n}", "knowledge", f"knowledge-old-{n}-{OLD_NAME}.md" if n < 3 else f"other-{n}", "project-lore", True, NOW - 2, None, {}, "old") for n in range(5)]
    return days.unionByName(spark.createDataFrame(old, days.schema))


def promotion_inputs(base: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Candidates, decisions and failed writes, of each kind, for all atoms of the day documents."""
    read = atoms.parsed(base.where(F.col("slot") == passes.DAILY).select("doc_id", F.col("body").alias("text")), ["doc_id"])
    pos, day = F.col("position"), F.regexp_extract("doc_id", r"(\d+)$", 1).cast("int")
    ids = read.select(F.concat_ws("-", "doc_id", pos.cast("string")).alias("atom_id"), pos.alias("pos"), day.alias("k"))
    target = F.concat(F.lit("old-"), (F.col("pos") % 5).cast("string"))
    candidates = ids.where("pos % 3 = 0").select("atom_id", F.lit(1).alias("rank"), target.alias("doc_id"))
    four, odd = F.col("pos") % 4, F.col("k") % 2 == 1
    action = F.when(odd & (four == 3), "skip").when((four == 0) | (~odd & (four >= 2)), "create").otherwise("update")
    given = ids.select("atom_id", action.alias("action"), F.when(action == "update", target).alias("target_id"), F.lit(None).cast("string").alias("merged_name"), F.when(four == 1, "Merged.").alias("merged_text"))
    return candidates, given, ids.where("k = 4 and pos = 1").select("atom_id")


def promote(base: DataFrame) -> DataFrame:
    return passes.promoted(base, *promotion_inputs(base), TODAY, NOW, ACTIVE_DAYS)


@query(f"""WITH {PROMOTION}
SELECT 'day-' || k AS doc_id, 'daily' AS slot, {_DAY} AS name, NULL AS body_sha, NOT (old AND (NOT read OR NOT wrong OR tries + 1 >= {PROMOTION_TRIES})) AS enabled,
  CASE WHEN NOT read THEN k = 6 WHEN NOT wrong OR tries + 1 >= {PROMOTION_TRIES} THEN NOT old ELSE false END AS is_promoted, CASE WHEN read AND wrong AND tries + 1 < {PROMOTION_TRIES} THEN CAST(tries + 1 AS VARCHAR) END AS tries FROM days
UNION ALL SELECT 'old-' || n, 'knowledge', CASE WHEN n < 3 THEN 'knowledge-old-' || n || '-{OLD_NAME}.md' ELSE 'other-' || n END, NULL, 'old-' || n NOT IN (SELECT cand FROM done WHERE action = 'update'), false, NULL FROM range(5) r(n)
UNION ALL SELECT sha256(slot || '|' || name || '|' || atom_id), slot, name, sha256({_TEXT}), true, false, NULL FROM made""")
def promoted_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    with scratch_folder(spark) as folder:
        shelf = store.Snapshots(spark, f"{folder}/store")
        shelf.commit(day_documents(spark, sf_dir))
        passes.committed(shelf, promote, passes.DAY_KINDS)
        body: Column = F.when(F.col("created_at_ms") == NOW, F.sha2("body", 256))
        return checkpointed(shelf.read().select("doc_id", "slot", "name", body.alias("body_sha"), "enabled", F.map_contains_key("metadata", F.lit(passes.PROMOTED_WORDS)).alias("is_promoted"), F.element_at("metadata", passes.TRIES).alias("tries")))


# issues, by stream --------------------------------------------------------------------------------------------------

BATCHES, AFTER, ENTITIES = 4, 2, 3
_ALIKE = "'sig-' || CAST(user_id % 150 AS VARCHAR) || '-' || CAST(event_id % 2 AS VARCHAR)"


@query(f"""WITH RECURSIVE t AS (SELECT user_id, event_id AS tick, event_type <> 'error' AS ok, {_ALIKE} AS signature, ntile({BATCHES}) OVER (ORDER BY event_id) AS b FROM events),
s AS (SELECT r.b, user_id, max(tick) FILTER (ok) AS healed FROM range(1, {BATCHES + 1}) r(b) JOIN t ON t.b <= r.b GROUP BY 1, 2),
streak AS (SELECT s.b, t.user_id, count(*) AS failures, arg_max(signature, tick) AS signature FROM s JOIN t ON t.user_id = s.user_id AND t.b <= s.b WHERE NOT ok AND (healed IS NULL OR tick > healed) GROUP BY 1, 2),
flags AS (SELECT b, signature, max(failures) >= {AFTER} OR count(*) >= {ENTITIES} AS raised FROM streak GROUP BY 1, 2),
sigs AS (SELECT DISTINCT signature FROM flags),
steps(b, signature, version, status) AS (SELECT 0, signature, CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR) FROM sigs UNION ALL
  SELECT s.b + 1, s.signature, CASE WHEN f.raised AND version IS NULL THEN 1 WHEN f.raised AND status = 'resolved' THEN version + 1 ELSE version END,
    CASE WHEN f.raised THEN 'open' WHEN status = 'open' AND f.signature IS NULL THEN 'resolved' ELSE status END FROM steps s LEFT JOIN flags f ON f.b = s.b + 1 AND f.signature = s.signature WHERE s.b < {BATCHES})
SELECT signature, version, status FROM steps WHERE b = {BATCHES} AND version IS NOT NULL""")
def stream_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues after a stream of ticks in four batches, each of which commits the state of entities and issues."""
    ticks = table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("entity"), F.col("event_id").alias("tick"), at_ms().alias("at_ms"), (F.col("event_type") != "error").alias("ok"),
        F.concat(F.lit("sig-"), (F.col("user_id") % 150).cast("string"), F.lit("-"), (F.col("event_id") % 2).cast("string")).alias("signature"),
    )
    n = ticks.count()
    long, short = n % BATCHES, n // BATCHES
    with scratch_folder(spark) as folder:
        shelf = store.Snapshots(spark, f"{folder}/state")
        shelf.commit(spark.createDataFrame([], healing.STATE))
        seen, first = 0, ticks.agg(F.min("tick")).first()[0]
        for k in range(BATCHES):  # the log grows by a part, and the stream takes what is new
            size = short + (k < long)
            ticks.where(F.col("tick").between(first + seen, first + seen + size - 1)).write.mode("append").parquet(f"{folder}/log")
            seen += size
            log = spark.readStream.schema(ticks.schema).parquet(f"{folder}/log")
            passes.by_stream(log, shelf, lambda state, batch: healing.healing_pass(state, batch, AFTER, ENTITIES), healing.ISSUE_KINDS, "ticks", f"{folder}/checkpoint").awaitTermination()
        return checkpointed(shelf.read().where("kind = 'issue'").select(F.col("id").alias("signature"), "version", "status"))
