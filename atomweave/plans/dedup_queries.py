"""Queries on duplicates, staleness, archives and stored state."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import audit, dedup, lifecycle, retrieve, store
from ..operators.leaf import leaves, resolved_policies, slots
from ..operators.likeness import LikenessIndex
from ..schema import ARCHIVE_DAYS, BODY_CHARS, CLUSTER_RESULTS, CLUSTER_SCORE, DAY_MS, LORE_DAYS, MERGE_SCORE, METADATA_FIELDS, STALE_MONTHS
from ..session import checkpointed, scratch_folder
from .base import LEAF, NOW, query

SHA = """sha AS (
  SELECT first_value(doc_id) OVER w AS keeper_id, doc_id AS loser_id, 'sha256' AS source_pass FROM leaf WHERE body IS NOT NULL
  WINDOW w AS (PARTITION BY sha256(body) ORDER BY created_at_ms DESC, doc_id))"""
KEYED = """keyed AS (
  SELECT first_value(doc_id) OVER w AS keeper_id, doc_id AS loser_id, 'lesson-key' AS source_pass FROM leaf WHERE atom_type = 'self-improvement-lesson' AND enabled AND error_pattern IS NOT NULL
  WINDOW w AS (PARTITION BY lower(project_module || '|' || task_type || '|' || error_pattern) ORDER BY created_at_ms DESC, doc_id))"""
#: Classes of equal sets of words, and all pairs of their representatives that share a word; nothing is left out.
LIKE = f"""sets AS (SELECT slot, doc_id, created_at_ms, list_sort(list_distinct(regexp_extract_all(lower(body), '[a-z0-9]+'))) AS w FROM leaf),
classed AS (SELECT slot, doc_id, created_at_ms, w, first_value(doc_id) OVER (PARTITION BY slot, w ORDER BY created_at_ms DESC, doc_id) AS rep FROM sets WHERE len(w) > 0),
terms AS (SELECT slot, doc_id, unnest(w) AS term FROM classed WHERE doc_id = rep),
near AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM terms x JOIN terms y ON x.slot = y.slot AND x.term = y.term AND x.doc_id < y.doc_id GROUP BY 1, 2),
edges AS (SELECT a, b, round(c / (len(p.w) + len(q.w) - c), 6) AS score, p.created_at_ms AS ms_a, q.created_at_ms AS ms_b FROM near JOIN sets p ON p.doc_id = a JOIN sets q ON q.doc_id = b),
alike AS (
  SELECT CASE WHEN ms_a > ms_b OR (ms_a = ms_b AND a < b) THEN a ELSE b END AS keeper_id, CASE WHEN ms_a > ms_b OR (ms_a = ms_b AND a < b) THEN b ELSE a END AS loser_id, 'similarity' AS source_pass, score
  FROM edges WHERE score >= {MERGE_SCORE} UNION ALL SELECT rep, doc_id, 'similarity', 1.0 FROM classed WHERE rep <> doc_id)"""
ALL_PAIRS = f"""{LEAF}, {SHA}, {KEYED}, {LIKE},
pairs AS (
  SELECT keeper_id, loser_id, source_pass, 0 AS pass_rank FROM sha WHERE keeper_id <> loser_id UNION ALL SELECT keeper_id, loser_id, source_pass, 1 FROM keyed WHERE keeper_id <> loser_id
  UNION ALL SELECT keeper_id, loser_id, source_pass, 2 FROM alike),
retained AS (SELECT loser_id, keeper_id, source_pass FROM pairs QUALIFY row_number() OVER (PARTITION BY loser_id ORDER BY pass_rank, CAST(keeper_id AS BIGINT)) = 1)"""


def alike(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = checkpointed(retrieve.word_sets(leaves(spark, sf_dir)))
    reps = checkpointed(retrieve.representatives(docs))
    return dedup.similarity_pairs(retrieve.likeness(reps, MERGE_SCORE), retrieve.classed(docs, reps), MERGE_SCORE)


def all_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = leaves(spark, sf_dir)
    pairs = reduce(DataFrame.unionByName, [dedup.sha256_pairs(docs), dedup.lesson_key_pairs(docs), alike(spark, sf_dir).drop("score")])
    return dedup.with_rank(pairs).withColumn("scan_idx", F.col("keeper_id").cast("long"))


@query(f"WITH {LEAF}, {SHA} SELECT * FROM sha WHERE keeper_id <> loser_id")
def sha256_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.sha256_pairs(leaves(spark, sf_dir))


@query(f"WITH {LEAF}, {KEYED} SELECT * FROM keyed WHERE keeper_id <> loser_id")
def lesson_key_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.lesson_key_pairs(leaves(spark, sf_dir))


@query(f"WITH {LEAF}, {LIKE} SELECT * FROM alike")
def similarity_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alike(spark, sf_dir)


@query(f"WITH {LEAF}, {LIKE} SELECT * FROM alike")
def similarity_pairs_in_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs of a stored index that got the older documents first, then the others."""
    docs = leaves(spark, sf_dir)
    old = F.col("created_at_ms") < NOW - 200 * DAY_MS
    with scratch_folder(spark) as folder:
        index = LikenessIndex(spark, f"{folder}/index", MERGE_SCORE, folders=32)
        for batch in (old, ~old):
            index.add(docs.where(batch))
        classes = index.classes()
        return checkpointed(dedup.similarity_pairs(index.edges(classes), classes, MERGE_SCORE))


@query(f"""WITH {LEAF}, s AS (SELECT slot, doc_id, list_distinct(regexp_extract_all(lower(body), '[a-z0-9]+')) AS w FROM leaf), t AS (SELECT slot, doc_id, len(w) AS n, unnest(w) AS term FROM s),
met AS (SELECT x.doc_id, y.doc_id AS other, round(count(*) / (any_value(x.n) + any_value(y.n) - count(*)), 6) AS score FROM t x JOIN t y ON x.slot = y.slot AND x.term = y.term AND x.doc_id <> y.doc_id GROUP BY 1, 2)
SELECT doc_id, CAST(row_number() OVER w AS INTEGER) AS rank, other, score FROM met WHERE score >= {CLUSTER_SCORE} WINDOW w AS (PARTITION BY doc_id ORDER BY score DESC, other) QUALIFY row_number() OVER w <= {CLUSTER_RESULTS}""")
def cluster_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = checkpointed(retrieve.word_sets(leaves(spark, sf_dir)))
    reps = checkpointed(retrieve.representatives(docs))
    edges = checkpointed(retrieve.likeness(reps, CLUSTER_SCORE))
    return retrieve.clusters(edges, retrieve.classed(docs, reps), CLUSTER_RESULTS, CLUSTER_SCORE)


@query(f"""WITH RECURSIVE {ALL_PAIRS},
walk(loser_id, source_pass, cur, depth) AS (SELECT loser_id, source_pass, keeper_id, 1 FROM retained UNION ALL SELECT w.loser_id, w.source_pass, r.keeper_id, w.depth + 1 FROM walk w JOIN retained r ON r.loser_id = w.cur)
SELECT arg_max(cur, depth) AS keeper_id, loser_id, any_value(source_pass) AS source_pass FROM walk GROUP BY loser_id""")
def dedupe_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.ultimate_keepers(dedup.retained(all_pairs(spark, sf_dir)))


@query(f"WITH {ALL_PAIRS} SELECT source_pass, source_pass IN ('sha256', 'lesson-key') AS deterministic, count(*) AS n FROM retained GROUP BY 1, 2")
def archive_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.deterministic(dedup.retained(all_pairs(spark, sf_dir))).groupBy("source_pass", "deterministic").agg(F.count("*").alias("n"))


STALE = "('" + "', '".join(lifecycle.STALE_TYPES) + "')"


@query(f"WITH {LEAF} SELECT doc_id, atom_type, created_at_ms AS last_ms FROM leaf WHERE atom_type IN {STALE} AND {NOW} - created_at_ms > {STALE_MONTHS} * 2629800000")
def stale_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.stale_documents(leaves(spark, sf_dir), NOW, STALE_MONTHS, lifecycle.STALE_TYPES, active=False).drop("slot")


@query(f"""WITH {LEAF}, c AS (SELECT *, regexp_replace(left(body, {BODY_CHARS - len(lifecycle.TRUNCATED)}), '\\s+$', '') || chr(10) || chr(10) || '[truncated]' AS cut FROM leaf
  WHERE NOT enabled AND length(body) > {BODY_CHARS} AND {NOW} - created_at_ms > 15552000000)
SELECT doc_id, length(body) AS n_chars, sha256(cut) AS truncated_sha, greatest(0, strlen(body) - strlen(cut)) AS freed_bytes FROM c""")
def compress_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lifecycle.compressible(leaves(spark, sf_dir), NOW, BODY_CHARS, ARCHIVE_DAYS)
    return found.select("doc_id", "n_chars", F.sha2("truncated", 256).alias("truncated_sha"), "freed_bytes")


@query(f"""WITH {LEAF}, c AS (SELECT *, regexp_replace(left(body, {BODY_CHARS - len(lifecycle.TRUNCATED)}), '\\s+$', '') || chr(10) || chr(10) || '[truncated]' AS cut FROM leaf
  WHERE NOT enabled AND length(body) > {BODY_CHARS} AND {NOW} - created_at_ms > 15552000000)
SELECT slot, count(*) AS n, CAST(sum(greatest(0, strlen(body) - strlen(cut))) AS BIGINT) AS freed_bytes FROM c GROUP BY 1""")
def freed_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = leaves(spark, sf_dir)
    found = lifecycle.compressible(docs, NOW, BODY_CHARS, ARCHIVE_DAYS)
    return found.groupBy("slot").agg(F.count("*").alias("n"), F.sum("freed_bytes").alias("freed_bytes"))


HITS = "hits AS (SELECT CAST(user_id AS VARCHAR) AS doc_id, epoch_us(ts) // 1000 AS at_ms FROM events WHERE event_type IN ('view', 'click'))"


@query(f"""WITH {LEAF}, {HITS}, last AS (SELECT doc_id, strftime(make_timestamp(max(at_ms) * 1000), '%Y-%m-%dT%H:%M:%S.%gZ') AS at, max(at_ms) AS ms FROM hits GROUP BY 1)
SELECT l.doc_id, coalesce(last.ms, 0) AS recalled_ms FROM leaf l LEFT JOIN last ON last.doc_id = l.doc_id WHERE enabled AND atom_type IN {STALE} AND {NOW} - created_at_ms > {STALE_MONTHS} * 2629800000
ORDER BY recalled_ms DESC, l.doc_id LIMIT 25""")
def refresh_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .state_queries import hits

    docs = leaves(spark, sf_dir)
    stale = lifecycle.stale_documents(docs, NOW, STALE_MONTHS, lifecycle.STALE_TYPES)
    last = hits(spark, sf_dir).groupBy("doc_id").agg(F.max("at_ms").alias("ms"))
    iso = F.date_format(F.timestamp_millis("ms"), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX")
    return lifecycle.refresh_queue(stale.join(last, "doc_id", "left").withColumn("last_recalled_at", iso), 25).select("doc_id", "recalled_ms")


# audits -------------------------------------------------------------------------------------------------------------

PLANS = f"""plans AS (SELECT *, regexp_extract(name, '^plan-(.+)\\.md$', 1) AS slug FROM leaf WHERE slot = 'plans'),
old AS (
  SELECT o.slot, o.doc_id, o.name, arg_min(p.name, (p.created_at_ms, p.n)) AS newer FROM plans o JOIN plans p ON starts_with(p.slug, o.slug || '-') AND (p.created_at_ms, p.n) > (o.created_at_ms, o.n) GROUP BY 1, 2, 3),
f1 AS (SELECT 'stale-plans' AS class, slot, doc_id, name, 'superseded by ' || newer AS reason, 'delete' AS suggested_action FROM old)"""
LACKS = """f2 AS (SELECT 'missing-metadata' AS class, slot, doc_id, name, 'missing: error_pattern' AS reason, 'disable' AS suggested_action FROM leaf WHERE atom_type = 'self-improvement-lesson' AND error_pattern IS NULL)"""
LORE = f"""f3 AS (SELECT 'stale-lore' AS class, slot, doc_id, name, 'age ' || CAST(({NOW} - created_at_ms) // 86400000 AS VARCHAR) || ' days' AS reason, 'disable' AS suggested_action
  FROM leaf WHERE atom_type = 'project-lore' AND {NOW} - created_at_ms >= {LORE_DAYS} * 86400000::BIGINT)"""
SAME = """f4 AS (SELECT 'duplicate-error-pattern' AS class, slot, doc_id, name, 'same error_pattern as ' || first_value(name) OVER w AS reason, 'delete' AS suggested_action FROM leaf
  WHERE slot = 'self_improvement' AND error_pattern IS NOT NULL WINDOW w AS (PARTITION BY error_pattern ORDER BY created_at_ms DESC, n) QUALIFY row_number() OVER w > 1)"""


@query(f"WITH {LEAF}, {PLANS} SELECT * FROM f1")
def audit_stale_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.stale_plans(leaves(spark, sf_dir))


@query(f"WITH {LEAF}, {LACKS} SELECT * FROM f2")
def audit_missing_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.missing_metadata(leaves(spark, sf_dir))


@query(f"WITH {LEAF}, {LORE} SELECT * FROM f3")
def audit_stale_lore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.stale_lore(leaves(spark, sf_dir), NOW, LORE_DAYS)


@query(f"WITH {LEAF}, {SAME} SELECT * FROM f4")
def audit_dup_error_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.duplicate_patterns(leaves(spark, sf_dir))


@query(f"""WITH {LEAF}, {PLANS}, {LACKS}, {LORE}, {SAME}, f AS (SELECT * FROM f1 UNION ALL SELECT * FROM f2 UNION ALL SELECT * FROM f3 UNION ALL SELECT * FROM f4)
SELECT class, slot, count(*) AS n FROM f GROUP BY GROUPING SETS ((class), (slot), ())""")
def audit_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.summary(audit.findings(leaves(spark, sf_dir), NOW, LORE_DAYS))


@query(f"""WITH {LEAF}, {KEYED}, d AS (SELECT slot, count(*) AS k FROM keyed JOIN leaf ON leaf.doc_id = loser_id WHERE keeper_id <> loser_id GROUP BY 1)
SELECT l.slot, count(*) FILTER (enabled) AS working_set, count(*) FILTER (NOT enabled) AS disabled, count(*) FILTER (enabled AND atom_type IN {STALE} AND {NOW} - created_at_ms > {STALE_MONTHS} * 2629800000) AS stale,
       count(*) FILTER (NOT enabled AND {NOW} - created_at_ms > 15552000000) AS compressible_approx, coalesce(any_value(k), 0) AS lesson_duplicates
FROM leaf l LEFT JOIN d ON d.slot = l.slot GROUP BY l.slot""")
def consolidate_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = leaves(spark, sf_dir)
    duplicates = dedup.lesson_key_pairs(docs).select(F.col("loser_id").alias("doc_id")).join(docs.select("doc_id", "slot"), "doc_id")
    return audit.projection(docs, duplicates, NOW, STALE_MONTHS, ARCHIVE_DAYS, lifecycle.STALE_TYPES)


# slots and stored state ---------------------------------------------------------------------------------------------


@query(f"""WITH {LEAF}, declared(slot, policy) AS (VALUES ('knowledge', 'refine'), ('self_improvement', 'refine'), ('plans', 'none'), ('investigations', 'none'), ('daily', 'none'))
SELECT d.slot, d.policy, count(l.doc_id) AS n_docs FROM declared d LEFT JOIN leaf l ON l.slot = d.slot GROUP BY 1, 2""")
def slot_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slots(leaves(spark, sf_dir))


@query("""SELECT DISTINCT source AS slot, CASE source WHEN 'src1' THEN 'refine' WHEN 'src2' THEN 'none' END AS policy, source NOT IN ('src1', 'src2') AS refused FROM documents""")
def slot_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound = leaves(spark, sf_dir).select(F.col("project_module").alias("slot")).distinct()
    return resolved_policies(bound, {"src1": "refine", "src2": "none"})


@query(f"WITH {LEAF} SELECT slot, name, arg_max(doc_id, n) AS doc_id, max(n) AS version, arg_max(enabled, n) AS enabled FROM leaf GROUP BY 1, 2")
def upsert_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.latest_by_name(leaves(spark, sf_dir).select("slot", "name", F.col("n").alias("version"), "doc_id", "enabled"))


@query(f"""WITH {LEAF} SELECT doc_id, CASE WHEN n % 3 = 0 THEN '' ELSE language END AS language, CASE WHEN n % 3 = 0 THEN 'true' END AS stale, atom_type,
  CAST(4 + CASE WHEN error_pattern IS NULL THEN 0 ELSE 1 END + CASE WHEN n % 3 = 0 THEN 1 ELSE 0 END AS BIGINT) AS n_fields FROM leaf""")
def read_merge_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = leaves(spark, sf_dir)
    fields = ("atom_type", "project_module", "language", "task_type", "error_pattern")
    base = docs.select("doc_id", "n", F.map_filter(F.create_map(*[x for f in fields for x in (F.lit(f), F.col(f))]), lambda k, v: v.isNotNull()).alias("metadata"))
    patch = F.create_map(F.lit("stale"), F.lit("true"), F.lit("language"), F.lit(None).cast("string"), F.lit("unknown_field"), F.lit("x"))
    state, _ = store.patched(base, docs.where("n % 3 = 0").select("doc_id", patch.alias("patch")), METADATA_FIELDS)
    return state.select("doc_id", *[F.element_at("metadata", f).alias(f) for f in ("language", "stale", "atom_type")], F.size("metadata").cast("long").alias("n_fields"))


@query(f"""WITH {LEAF}, {SHA} SELECT l.doc_id, CASE WHEN s.keeper_id IS NOT NULL THEN false ELSE enabled END AS enabled, s.keeper_id AS superseded_by
FROM leaf l LEFT JOIN (SELECT * FROM sha WHERE keeper_id <> loser_id) s ON s.loser_id = l.doc_id""")
def archive_losers(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = leaves(spark, sf_dir)
    base = docs.select("doc_id", "enabled", F.create_map(F.lit("atom_type"), "atom_type").alias("metadata"))
    state = store.archived(base, dedup.sha256_pairs(docs), "2023-11-14T22:13:20.000Z")
    return state.select("doc_id", "enabled", F.element_at("metadata", "superseded_by").alias("superseded_by"))
