"""Queries on changes to stored documents, decisions, slots, and what surrounds them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import globs as G
from ..functions import names as N
from ..functions import text as X
from ..functions import times as D
from ..operators import atoms, capture, decisions, dedup, healing, leaf, lifecycle, retrieve, store
from ..operators.leaf import leaves, table
from ..schema import BODY_CHARS, CHUNK_OVERLAP, CHUNK_SEPARATOR, CHUNK_WORDS, ESCALATE_AFTER, ESCALATE_ENTITIES, FILE_BYTES, METADATA_FIELDS, RECALL_RESULTS, STALE_MONTHS
from ..sources import files
from .base import LEAF, NOW, TICKS, listed, query, slug_sql
from .dedup_queries import KEYED, SHA, STALE
from .search_queries import EACH, LESSON_FILTERS, recall_ladder
from .state_queries import at_ms, ticks
from .text_queries import PATH, RAW, raw_atoms

AT = "2023-11-14T22:13:20.000Z"
STAMP = "2023-11-14-221320000"
FIELDS = "f(position, name) AS (SELECT unnest(range(13)), unnest(" + listed(METADATA_FIELDS) + "))"
SOME_FIELDS = ("atom_type", "project_module", "language", "task_type", "error_pattern")


def metadata(*fields: str) -> Column:
    return F.map_filter(F.create_map(*[x for f in fields for x in (F.lit(f), F.col(f))]), lambda k, v: v.isNotNull())


# listings and slots -------------------------------------------------------------------------------------------------


@query(f"""WITH f AS (SELECT page_id, {PATH} AS rel_path FROM pages) SELECT page_id, rel_path FROM f
WHERE regexp_matches(rel_path, '{G.glob_regex("en/**")}|{G.glob_regex("fr/*.html")}|{G.glob_regex("**/index*")}') AND NOT regexp_matches(rel_path, '{"|".join(G.glob_regex(p) for p in [*G.default_ignored(), "**/*1.html"])}')""")
def glob_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    files_of = table(spark, sf_dir, "pages").select("page_id", capture.url_path(F.col("url")).alias("rel_path"))
    return files_of.where(G.wanted(F.col("rel_path"), ("en/**", "fr/*.html", "**/index*"), ("**/*1.html",)))


@query(f"WITH {LEAF} SELECT slot, count(*) AS total FROM leaf WHERE name LIKE '%src%' AND NOT enabled GROUP BY 1")
def list_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaf.listed(leaves(spark, sf_dir), "src", False).groupBy("slot").agg(F.count("*").alias("total"))


@query(f"WITH {LEAF} SELECT min(doc_id) AS doc_id, name FROM leaf WHERE name = 'plan-src7.md' GROUP BY name")
def exact_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaf.named(leaves(spark, sf_dir), "plan-src7.md").select("doc_id", "name")


@query(f"WITH {LEAF} SELECT doc_id, slot, name, enabled, created_at_ms, CAST(5 + CASE WHEN error_pattern IS NULL THEN 0 ELSE 1 END AS BIGINT) AS n_fields, project_module FROM leaf")
def working_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leaf.working_set(leaves(spark, sf_dir))
    return found.select("doc_id", "slot", "name", "enabled", "created_at_ms", F.size("metadata").cast("long").alias("n_fields"), F.element_at("metadata", "project_module").alias("project_module"))


STEP = CHUNK_WORDS - CHUNK_OVERLAP


@query(f"""WITH {LEAF}, p AS (SELECT doc_id, unnest(string_split(body, chr(10) || chr(10) || '### ')) AS piece, generate_subscripts(string_split(body, chr(10) || chr(10) || '### '), 1) AS part FROM leaf),
w AS (SELECT doc_id, part, regexp_extract_all(piece, '\\S+') AS ws FROM p),
c AS (SELECT doc_id, part, ws, unnest(range(0, CAST(greatest(0, ceil((len(ws) - {CHUNK_WORDS}) / {STEP}.0)) AS BIGINT) + 1)) AS run FROM w WHERE len(ws) > 0)
SELECT doc_id, sha256(string_agg(array_to_string(ws[run * {STEP} + 1:run * {STEP} + {CHUNK_WORDS}], ' '), chr(10) || chr(10) ORDER BY part, run)) AS body_sha FROM c GROUP BY 1""")
def assemble_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = leaf.chunked(leaves(spark, sf_dir).select("doc_id", "body"), CHUNK_WORDS, CHUNK_OVERLAP, CHUNK_SEPARATOR)
    return leaf.assembled(cut, ("part", "run")).select("doc_id", F.sha2("body", 256).alias("body_sha"))


@query(f"""WITH {LEAF} SELECT doc_id, '{{' || CASE WHEN n % 3 = 0 THEN '' ELSE '"language":"' || language || '",' END || '"project_module":"' || project_module || '"' || CASE WHEN error_pattern IS NULL THEN '' ELSE ',"stale":"' || error_pattern || '"' END || '}}' AS key FROM leaf""")
def filter_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = F.create_map(F.lit("stale"), F.col("error_pattern"), F.lit("project_module"), F.col("project_module"), F.lit("language"), F.when(F.col("n") % 3 == 0, " ").otherwise(F.col("language")))
    return leaves(spark, sf_dir).select("doc_id", leaf.filter_key(given).alias("key"))


@query(f"""WITH {LEAF} SELECT slot, CASE WHEN n % 4 <> 0 THEN n / 10 END AS score, NULL::VARCHAR AS segment_id, doc_id, name, n AS position, enabled, CAST(0 AS BIGINT) AS n_keywords, NULL::BIGINT AS n_words, '' AS content FROM leaf""")
def compact_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = leaves(spark, sf_dir).select("slot", F.when(F.col("n") % 4 == 0, "none").otherwise((F.col("n") / 10).cast("string")).alias("score"), "doc_id", "name", F.col("n").alias("position"), "enabled")
    out = leaf.compact(hits)
    return out.withColumn("n_keywords", F.size("keywords").cast("long")).drop("keywords")


@query("""WITH a AS (SELECT DISTINCT upper(source) AS asked FROM documents UNION SELECT DISTINCT md5(source) FROM documents UNION SELECT 'short-1')
SELECT asked, CASE WHEN asked LIKE 'SRC%' THEN CASE WHEN asked = 'SRC3' THEN '' ELSE 'id-' || lower(asked) END WHEN length(asked) = 32 THEN asked ELSE '' END AS slot_id FROM a""")
def resolve_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = table(spark, sf_dir, "documents").select("source").distinct()
    asked = source.select(F.upper("source").alias("asked")).union(source.select(F.md5("source"))).union(spark.createDataFrame([("short-1",)], "asked string"))
    known = source.select(F.col("source").alias("slot"), F.when(F.col("source") == "src3", "").otherwise(F.concat(F.lit("id-"), "source")).alias("slot_id"))
    return leaf.resolved_ids(asked, known)


@query(f"""WITH {FIELDS}, s AS (SELECT DISTINCT source AS slot FROM documents)
SELECT slot, CAST(position AS INTEGER) AS position, name, NOT (slot IN ('src1', 'src2') AND name = 'tags') AS ok, slot NOT IN ('src1', 'src2') AS complete FROM s, f""")
def create_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = table(spark, sf_dir, "documents").select(F.col("source").alias("slot"))
    return leaf.created_slots(wanted, spark.createDataFrame([("src1", "tags"), ("src2", "tags")], "slot string, name string"))


@query(f"""WITH {LEAF}, {FIELDS}, present AS (SELECT DISTINCT slot, unnest(list_filter(['language', CASE WHEN error_pattern IS NOT NULL THEN 'error_pattern' END, CASE WHEN atom_type = 'plan' THEN 'tags' END], lambda x: x IS NOT NULL)) AS name FROM leaf)
SELECT s.slot, f.name, CAST(f.position AS INTEGER) AS position FROM (SELECT DISTINCT slot FROM leaf) s, f WHERE NOT EXISTS (SELECT 1 FROM present p WHERE p.slot = s.slot AND p.name = f.name)""")
def missing_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    has = F.array_compact(F.array(F.lit("language"), F.when(F.col("error_pattern").isNotNull(), "error_pattern"), F.when(F.col("atom_type") == "plan", "tags")))
    return leaf.missing_fields(leaves(spark, sf_dir).select("slot", F.explode(has).alias("name")).distinct())


@query(f"WITH {LEAF} SELECT doc_id, project_module AS tag, CASE WHEN n % 5 <> 0 THEN atom_type END AS kind, CAST(CASE WHEN n % 5 = 0 THEN 0 ELSE 2 END AS BIGINT) AS n_fields FROM leaf WHERE n % 5 <> 0 UNION ALL SELECT doc_id, NULL, NULL, 0 FROM leaf WHERE n % 5 = 0")
def flatten_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    entry = lambda name, value: F.struct(F.lit(name).alias("name"), F.col(value).alias("value"))
    listing = F.when(F.col("n") % 5 != 0, F.array(entry("tag", "language"), entry("kind", "atom_type"), entry("tag", "project_module")))
    flat = leaves(spark, sf_dir).select("doc_id", leaf.flattened(listing).alias("m"))
    return flat.select("doc_id", F.element_at("m", "tag").alias("tag"), F.element_at("m", "kind").alias("kind"), F.size("m").cast("long").alias("n_fields"))


# changes ------------------------------------------------------------------------------------------------------------


@query(f"WITH {LEAF} SELECT doc_id, CASE WHEN n % 10 = 0 THEN true WHEN n % 5 = 0 THEN false ELSE enabled END AS enabled FROM leaf")
def switch_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = leaves(spark, sf_dir)
    off = store.switched(docs.select("doc_id", "enabled"), docs.where("n % 5 = 0"), False)
    return store.switched(off, docs.where("n % 10 = 0"), True)


@query(f"WITH {LEAF} SELECT doc_id, name FROM leaf WHERE n % 4 <> 0")
def delete_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = leaves(spark, sf_dir)
    return store.deleted(docs.select("doc_id", "name"), docs.where("n % 4 = 0"))


@query(f"WITH {LEAF} SELECT doc_id, name, enabled FROM leaf UNION ALL SELECT sha256(slot || '|' || name || '|' || CAST(n AS VARCHAR)), name, true FROM leaf WHERE n % 9 = 0")
def create_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = leaves(spark, sf_dir)
    base = docs.select("doc_id", "slot", "name", F.col("n").alias("version"), "enabled")
    return store.created(base, docs.where("n % 9 = 0").select("slot", "name", F.col("n").alias("version"))).select("doc_id", "name", "enabled")


_NEW = "sha256(slot || '|new-' || name || '|' || CAST(n AS VARCHAR))"


@query(f"""WITH {LEAF} SELECT 'kept' AS what, doc_id, CASE WHEN n % 12 = 0 THEN false ELSE enabled END AS enabled FROM leaf UNION ALL SELECT 'kept', {_NEW}, true FROM leaf WHERE n % 12 = 0
UNION ALL SELECT 'refused', 'new-' || name, NULL FROM leaf WHERE n % 12 = 6 UNION ALL SELECT 'refused', 'new-' || name, NULL FROM leaf WHERE n % 12 = 3""")
def supersede_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = leaves(spark, sf_dir)
    base = docs.select("doc_id", "slot", "name", F.col("n").alias("version"), "enabled")
    old = F.when(F.col("n") % 12 == 0, F.col("doc_id")).when(F.col("n") % 12 == 6, F.concat(F.lit("gone-"), "doc_id"))
    incoming = docs.where("n % 12 in (0, 3, 6)").select("slot", F.concat(F.lit("new-"), "name").alias("name"), F.col("n").alias("version"), old.alias("supersedes"))
    state, refused = store.superseded_or_refused(base, incoming)
    return state.select(F.lit("kept").alias("what"), "doc_id", "enabled").unionByName(refused.select(F.lit("refused").alias("what"), F.col("name").alias("doc_id"), F.lit(None).cast("boolean").alias("enabled")))


@query(f"WITH {LEAF} SELECT doc_id, name FROM leaf WHERE name = 'plan-src7-v2.md' AND doc_id <> '47'")
def replaced_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.replaced_copies(leaves(spark, sf_dir).select("doc_id", "name"), "plan-src7-v2.md", "47")


@query(f"""WITH {LEAF}, s AS (SELECT slot, name, CASE WHEN n % 5 <> 0 THEN body END AS text, n % 3 AS k FROM leaf), t AS (SELECT *, coalesce(trim(text) <> '' AND length(text) <= {FILE_BYTES}, false) AS document_ok FROM s)
SELECT slot, name, document_ok, k = 2 OR (document_ok AND k = 1 AND slot <> 'plans') AS metadata_ok, document_ok AND (k = 2 OR (k = 1 AND slot <> 'plans')) AS ok FROM t""")
def save_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = leaves(spark, sf_dir)
    given = F.when(F.col("n") % 3 == 0, F.create_map(F.lit("odd"), F.lit("x"))).when(F.col("n") % 3 == 1, F.create_map(F.lit("tags"), F.col("tags")))
    incoming = docs.select("slot", "name", F.when(F.col("n") % 5 != 0, F.col("body")).alias("text"), given.alias("metadata"))
    fields = spark.createDataFrame([("knowledge", ["tags", "stale"]), ("self_improvement", ["tags"]), ("plans", ["stale"])], "slot string, names array<string>")
    return store.saved(incoming, fields, FILE_BYTES)


# decisions ----------------------------------------------------------------------------------------------------------


CERTAIN = f"""{LEAF}, {SHA}, {KEYED}, pairs AS (SELECT loser_id, arg_min(keeper_id, r) AS keeper_id, arg_min(source_pass, r) AS source_pass FROM (
  SELECT *, 0 AS r FROM sha WHERE keeper_id <> loser_id UNION ALL SELECT *, 1 FROM keyed WHERE keeper_id <> loser_id) GROUP BY 1)"""
_MARK = decisions.cut_marker(AT)
_CUT = "CASE WHEN length({b}) > {m} THEN regexp_replace(left({b}, {k}), '\\s+$', '') || '{t}' ELSE {b} END".format(b="{b}", m=BODY_CHARS, k=BODY_CHARS - len(_MARK), t=_MARK.replace("\n", "' || chr(10) || '"))
MERGES = f"""{CERTAIN}, asked AS (SELECT p.*, CAST(p.loser_id AS BIGINT) % 7 AS k, l.body AS loser_body FROM pairs p JOIN leaf l ON l.doc_id = p.loser_id),
told AS (SELECT *, CASE k WHEN 0 THEN 'archive' WHEN 1 THEN 'error' WHEN 2 THEN 'flag' WHEN 3 THEN 'error' WHEN 4 THEN CASE WHEN loser_body = '' THEN 'error' ELSE 'merge' END WHEN 5 THEN 'error' ELSE 'archive' END AS first FROM asked),
outcomes AS (SELECT keeper_id, loser_id, source_pass, CASE WHEN first = 'merge' AND row_number() OVER (PARTITION BY keeper_id, first ORDER BY loser_id) > 1 THEN 'wait' ELSE first END AS outcome, loser_body FROM told)"""


def certain_pairs(docs: DataFrame) -> DataFrame:
    pairs = dedup.with_rank(dedup.sha256_pairs(docs).unionByName(dedup.lesson_key_pairs(docs))).withColumn("scan_idx", F.col("keeper_id").cast("long"))
    return dedup.retained(pairs)


def merge_decisions(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs and a decision of each kind on them; the merged text is the loser's."""
    pairs = certain_pairs(docs)
    return pairs, decided_on(pairs, docs)


def decided_on(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    k = F.col("loser_id").cast("long") % 7
    asked = pairs.join(docs.select(F.col("doc_id").alias("loser_id"), "body"), "loser_id").where(k != 0)
    action = F.when(k == 2, "skip").when(k == 3, "delete-both").when(k.isin(1, 4, 5), "merge").otherwise("keep-keeper-unchanged")
    return asked.select("keeper_id", "loser_id", F.when(k == 1, "other").otherwise(F.col("keeper_id")).alias("said_keeper"), F.col("loser_id").alias("said_loser"), action.alias("action"), F.when(k == 4, F.col("body")).when(k == 1, "x").alias("merged_body"), F.lit(True).alias("written"))


def merge_outcomes_of(docs: DataFrame) -> DataFrame:
    return decisions.merges(*merge_decisions(docs), BODY_CHARS, AT)


@query(f"WITH {MERGES} SELECT keeper_id, loser_id, source_pass, outcome, CASE WHEN outcome = 'merge' THEN sha256({_CUT.format(b='loser_body')}) END AS body_sha FROM outcomes")
def merge_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge_outcomes_of(leaves(spark, sf_dir)).select("keeper_id", "loser_id", "source_pass", "outcome", F.sha2("body", 256).alias("body_sha"))


@query(f"""WITH {MERGES}, m AS (SELECT keeper_id, {_CUT.format(b="loser_body")} AS body FROM outcomes WHERE outcome = 'merge'), a AS (SELECT loser_id, keeper_id FROM outcomes WHERE outcome IN ('merge', 'archive'))
SELECT l.doc_id, sha256(coalesce(m.body, l.body)) AS body_sha, CASE WHEN a.loser_id IS NULL THEN l.enabled ELSE false END AS enabled, a.keeper_id AS superseded_by, CASE WHEN m.keeper_id IS NOT NULL OR a.loser_id IS NOT NULL THEN '{AT}' END AS consolidated_at
FROM leaf l LEFT JOIN m ON m.keeper_id = l.doc_id LEFT JOIN a ON a.loser_id = l.doc_id""")
def merged_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = leaves(spark, sf_dir)
    state = decisions.merged(docs.select("doc_id", "body", "enabled", metadata("atom_type").alias("metadata")), merge_outcomes_of(docs), AT)
    return state.select("doc_id", F.sha2("body", 256).alias("body_sha"), "enabled", F.element_at("metadata", "superseded_by").alias("superseded_by"), F.element_at("metadata", "consolidated_at").alias("consolidated_at"))


@query(f"""WITH {MERGES} SELECT source_pass, count(*) FILTER (outcome = 'archive') AS archived, count(*) FILTER (outcome = 'merge') AS merged, count(*) FILTER (outcome = 'refresh') AS refreshed, count(*) FILTER (outcome = 'flag') AS flagged,
  count(*) FILTER (outcome = 'keep') AS touched, count(*) FILTER (outcome = 'error') AS errors, count(*) FILTER (outcome = 'wait') AS waiting FROM outcomes GROUP BY 1""")
def decision_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions.totals(merge_outcomes_of(leaves(spark, sf_dir)), ["source_pass"])


REFRESH = f"""{LEAF}, stale AS (SELECT * FROM leaf WHERE enabled AND atom_type IN {STALE} AND {NOW} - created_at_ms > {STALE_MONTHS} * 2629800000), r AS (SELECT doc_id, body, n // 8 % 7 AS k FROM stale),
outcomes AS (SELECT doc_id, CASE k WHEN 0 THEN 'wait' WHEN 1 THEN 'error' WHEN 2 THEN 'keep' WHEN 3 THEN 'keep' WHEN 4 THEN CASE WHEN body = '' THEN 'error' ELSE 'refresh' END WHEN 5 THEN 'archive' ELSE 'wait' END AS outcome,
  CASE k WHEN 2 THEN 'false' WHEN 3 THEN 'true' WHEN 4 THEN CASE WHEN body <> '' THEN 'false' END WHEN 5 THEN 'true' END AS stale, CASE WHEN k = 4 AND body <> '' THEN {_CUT.format(b="body")} END AS body FROM r)"""


def refresh_outcomes_of(docs: DataFrame) -> DataFrame:
    stale = lifecycle.stale_documents(docs, NOW, STALE_MONTHS, lifecycle.STALE_TYPES)
    return decisions.refreshes(stale, refreshes_given(docs), BODY_CHARS, AT)


def refreshes_given(docs: DataFrame) -> DataFrame:
    k = F.floor(F.col("n") / 8) % 7
    action = F.when(k.isin(1, 2, 3), "keep").when(k == 4, "rewrite").when(k == 5, "archive").otherwise("rename")
    return docs.where(k != 0).select("doc_id", F.when(k == 1, "other").otherwise(F.col("doc_id")).alias("said_id"), action.alias("action"), F.when(k == 2, False).alias("stale_after"), F.when(k == 4, F.col("body")).alias("rewritten_body"))


@query(f"WITH {REFRESH} SELECT doc_id, outcome, stale, sha256(body) AS body_sha FROM outcomes")
def refresh_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return refresh_outcomes_of(leaves(spark, sf_dir)).select("doc_id", "outcome", "stale", F.sha2("body", 256).alias("body_sha"))


@query(f"""WITH {REFRESH} SELECT l.doc_id, sha256(coalesce(o.body, l.body)) AS body_sha, CASE WHEN o.outcome = 'archive' THEN false ELSE l.enabled END AS enabled, o.stale, CASE WHEN o.outcome = 'refresh' THEN '{AT}' END AS last_refreshed_at
FROM leaf l LEFT JOIN outcomes o ON o.doc_id = l.doc_id""")
def refreshed_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = leaves(spark, sf_dir)
    state = decisions.refreshed(docs.select("doc_id", "body", "enabled", metadata("atom_type").alias("metadata")), refresh_outcomes_of(docs), AT)
    return state.select("doc_id", F.sha2("body", 256).alias("body_sha"), "enabled", F.element_at("metadata", "stale").alias("stale"), F.element_at("metadata", "last_refreshed_at").alias("last_refreshed_at"))


@query(f"WITH {LEAF} SELECT doc_id, CASE WHEN t THEN 'true' ELSE 'false' END AS stale FROM (SELECT doc_id, n, atom_type IN {STALE} AND {NOW} - created_at_ms > {STALE_MONTHS} * 2629800000 AS t FROM leaf) WHERE t <> (n % 4 = 0)")
def stale_flag_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = leaves(spark, sf_dir).withColumn("stale", F.when(F.col("n") % 4 == 0, "true"))
    return lifecycle.stale_changes(docs, NOW, STALE_MONTHS, lifecycle.STALE_TYPES)


@query(f"WITH {CERTAIN} SELECT doc_id FROM leaf WHERE doc_id NOT IN (SELECT loser_id FROM pairs)")
def unused_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = leaves(spark, sf_dir)
    return dedup.unused(docs.select("doc_id"), certain_pairs(docs).select(F.col("loser_id").alias("doc_id")))


# retrieval, atoms and names -----------------------------------------------------------------------------------------


_BASE = "atom_type = 'self-improvement-lesson' AND project_module = 'src6'"


@query(f"""WITH {EACH}, m AS (SELECT query_id, doc_id, score, unnest(list_filter([CASE WHEN {_BASE} AND error_pattern = 'ep-0' AND language = 'en' AND task_type = 'planning' THEN 0 END, CASE WHEN {_BASE} AND language = 'en' AND task_type = 'planning' THEN 1 END,
    CASE WHEN {_BASE} AND task_type = 'planning' THEN 2 END, CASE WHEN {_BASE} THEN 3 END], lambda x: x IS NOT NULL)) AS rung FROM each),
t AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY query_id, rung ORDER BY score DESC, doc_id) <= {RECALL_RESULTS}), h AS (SELECT query_id, doc_id, min(rung) AS rung, any_value(score) AS score FROM t GROUP BY 1, 2),
c AS (SELECT r.query_id, r.rung, count(*) AS n FROM (SELECT DISTINCT query_id, rung FROM h) r JOIN h ON h.query_id = r.query_id AND h.rung <= r.rung GROUP BY 1, 2), l AS (SELECT query_id, coalesce(min(rung) FILTER (n >= 3), 9) AS last FROM c GROUP BY 1),
o AS (SELECT rung FROM h JOIN l ON l.query_id = h.query_id WHERE rung <= last QUALIFY row_number() OVER (PARTITION BY h.query_id ORDER BY rung, score DESC, doc_id) <= {RECALL_RESULTS}),
s(rung, filters) AS (VALUES (0, 'atom_type,error_pattern,language,project_module,task_type'), (1, 'atom_type,language,project_module,task_type'), (2, 'atom_type,project_module,task_type'), (3, 'atom_type,project_module'))
SELECT s.rung, s.filters, count(o.rung) AS hits FROM s LEFT JOIN o ON o.rung = s.rung GROUP BY 1, 2""")
def rung_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieve.rung_counts(recall_ladder(spark, sf_dir), LESSON_FILTERS)


@query(f"""WITH {RAW} SELECT conv_id, turn, type AS atom_type, tag AS tags, nullif(task_type, '') AS task_type, CAST(3 + CASE WHEN task_type <> '' THEN 1 ELSE 0 END + CASE WHEN error_pattern <> '' THEN 1 ELSE 0 END AS BIGINT) AS n_fields FROM good""")
def atom_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = atoms.validated(raw_atoms(spark, sf_dir)).select("conv_id", "turn", atoms.stored_metadata().alias("m"))
    return found.select("conv_id", "turn", *[F.element_at("m", f).alias(f) for f in ("atom_type", "tags", "task_type")], F.size("m").cast("long").alias("n_fields"))


@query(f"""WITH {RAW}, d AS (SELECT *, conv_id || '-' || turn AS atom_id, turn % 5 AS k FROM good WHERE turn % 5 < 4)
SELECT atom_id, CASE WHEN k = 0 THEN 'create' ELSE 'update' END AS action, CASE WHEN type = 'self-improvement-lesson' THEN 'lesson' ELSE 'knowledge' END || '-' ||
  CASE WHEN k = 1 AND type <> 'self-improvement-lesson' THEN 'old-name' WHEN k = 2 THEN 'another-name' ELSE {slug_sql("title")} END || '-{STAMP}.md' AS name, CASE WHEN k > 0 THEN 'doc-' || conv_id END AS supersedes FROM d""")
def atom_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("turn") % 5
    target = F.concat(F.lit("doc-"), "conv_id")
    good = atoms.validated(raw_atoms(spark, sf_dir)).select(
        F.concat_ws("-", "conv_id", "turn").alias("atom_id"), "type", "title", F.when(k == 0, "create").when(k == 4, "skip").otherwise("update").alias("action"), target.alias("target_id"),
        F.when(k == 1, "knowledge-old-name-2020-01-02-030405678.md").alias("target_name"), F.when(k == 2, "Another  name!").otherwise(" ").alias("merged_name"),
    )
    return atoms.writes(good, F.lit(AT[:-1]).cast("timestamp_ntz"))


@query("""WITH t AS (SELECT conv_id, count(*) AS n FROM conversations WHERE role IN ('user', 'assistant', 'summary', 'system') AND trim(text) <> '' GROUP BY 1), s AS (SELECT DISTINCT conv_id, CASE conv_id % 4 WHEN 0 THEN 'What was said in ' || conv_id WHEN 1 THEN '  ' END AS summary FROM conversations)
SELECT s.conv_id, coalesce(t.n, 0) > 0 AS has_turns, CASE WHEN trim(coalesce(summary, '')) <> '' THEN summary END AS told, CASE WHEN trim(coalesce(summary, '')) = '' AND least(t.n, 30) < 5 THEN 'too-few-turns' END AS skip FROM s LEFT JOIN t ON t.conv_id = s.conv_id""")
def transcript_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    summary = F.when(F.col("conv_id") % 4 == 0, F.concat(F.lit("What was said in "), F.col("conv_id").cast("string"))).when(F.col("conv_id") % 4 == 1, "  ")
    found = atoms.source_material(turns, least=5, summaries=turns.select("conv_id").distinct().withColumn("summary", summary))
    return found.select("conv_id", (F.col("turn_count") > 0).alias("has_turns"), F.when(F.col("conv_id") % 4 == 0, F.col("body")).alias("told"), "skip")


@query(f"""WITH {RAW} SELECT conv_id, turn, sha256('# ' || title || chr(10) || chr(10) || '- type: ' || type || chr(10) || '- tags: [' || tag || ']' || chr(10) || '- project_module: ' || project_module || chr(10) || '- language: ' || chr(10) || '- task_type: ' || task_type || chr(10) ||
  '- error_pattern: ' || error_pattern || chr(10) || '- updated_at_utc: {AT}' || chr(10) || chr(10) || CASE WHEN turn % 2 = 1 THEN 'Merged.' ELSE body END || CASE WHEN turn % 2 = 0 AND evidence IS NOT NULL THEN chr(10) || chr(10) || 'evidence: ' || evidence ELSE '' END || chr(10)) AS text_sha FROM good""")
def promoted_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = atoms.validated(raw_atoms(spark, sf_dir))
    text = atoms.promoted_text(F.lit(AT), F.when(F.col("turn") % 2 == 1, " Merged. "))
    return good.select("conv_id", "turn", F.sha2(text, 256).alias("text_sha"))


@query("""SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 'The session was read and holds nothing durable to keep.' WHEN 1 THEN 'The session''s context could not be read.'
  ELSE '<!-- BEGIN UNTRUSTED SESSION BODY -->' || chr(10) || '    ' || replace(text, chr(10), chr(10) || '    ') || chr(10) || '<!-- END UNTRUSTED SESSION BODY -->' END AS entry,
  CASE WHEN turn % 4 = 0 THEN text ELSE regexp_replace(role, '\\s+$', '') || chr(10) || chr(10) || text END AS day FROM conversations""")
def day_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcome = F.when(F.col("turn") % 3 == 0, "nothing-durable").when(F.col("turn") % 3 == 1, "context-unreadable").otherwise("raw-fallback")
    prior = F.when(F.col("turn") % 4 == 0, " ").otherwise(F.concat("role", F.lit(" \n")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", atoms.day_entry(outcome, F.col("text")).alias("entry"), atoms.merged_day(prior, F.col("text")).alias("day"))


@query("""SELECT doc_id, CASE WHEN length(source || lang) <= 8 THEN CASE WHEN length(source || lang) <= 8 THEN '***' END ELSE left(source || lang, 4) || '…' || right(source || lang, 4) END AS masked, source || ' ' || lang AS header, strftime(make_timestamp(1700000000000000 + doc_id * 86400000000), '%Y/%m') || '/cron-' || CAST(1700000000000 + doc_id * 86400000 AS VARCHAR) || '.json' AS log_path,
  CASE WHEN doc_id % 3 = 0 THEN CAST(doc_id AS INTEGER) + 1 ELSE 7 END AS setting, CASE WHEN doc_id % 2 = 0 THEN '{"a": ' || doc_id || '}' END AS json, CASE WHEN doc_id % 2 = 0 THEN 'never' ELSE CAST(doc_id % 400 AS VARCHAR) END AS recalled,
  'knowledge-' || source || '-' || strftime(make_timestamp(1700000000000000 + doc_id * 1000), '%Y-%m-%d-%H%M%S') || lpad(CAST((1700000000000 + doc_id) % 1000 AS VARCHAR), 3, '0') || '.md' AS name, lang || '|' || source AS parts FROM documents""")
def scalar_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id")
    at = F.expr("timestampadd(MILLISECOND, 1700000000000 + doc_id, TIMESTAMP_NTZ '1970-01-01 00:00:00')")
    recalled = F.when(n % 2 == 0, "sometime").otherwise(F.concat(F.date_format(F.expr("timestampadd(DAY, - cast(doc_id % 400 as int), TIMESTAMP_NTZ '2023-11-14 22:13:20')"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")))
    reply = F.when(n % 2 == 0, F.concat(F.lit('```json\n{"a": '), n.cast("string"), F.lit("}\n```"))).otherwise("no {json")
    return table(spark, sf_dir, "documents").select(
        "doc_id", X.masked(F.concat("source", "lang")).alias("masked"), X.header_value(F.concat("source", F.lit("\r\n"), "lang", F.lit("\n"))).alias("header"), N.log_path(F.lit(NOW) + n * 86_400_000).alias("log_path"),
        X.setting(F.when(n % 3 == 0, (n + 1).cast("string")).otherwise("-1"), "int", 7).alias("setting"), X.bare_json(reply).alias("json"), D.days_since(recalled, NOW).alias("recalled"), N.dated_name("knowledge", F.col("source"), at).alias("name"),
        F.array_join(X.split_list(F.concat("lang", F.lit(" , ,"), "source", F.lit(","))), "|").alias("parts"),
    )


# failures, attempts and streams -------------------------------------------------------------------------------------


@query(f"WITH {TICKS} SELECT entity, tick, ok FROM ticks QUALIFY row_number() OVER (PARTITION BY entity ORDER BY tick DESC) <= {max(ESCALATE_AFTER + 2, 5)}")
def failure_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return healing.history(ticks(spark, sf_dir), ESCALATE_AFTER).select("entity", "tick", "ok")


@query(f"""WITH {TICKS}, f AS (SELECT signature, 'excerpt ' || (tick % 23) AS excerpt, 'cron-' || (tick % 31) || '.json' AS log_path FROM ticks WHERE NOT ok)
SELECT signature, count(DISTINCT excerpt) AS n_excerpts, array_to_string(list_sort(list(DISTINCT excerpt))[1:5], ';') AS excerpts, count(DISTINCT log_path) AS n_logs, array_to_string(list_sort(list_reverse_sort(list(DISTINCT log_path))[1:5]), ';') AS logs FROM f GROUP BY 1""")
def failure_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = ticks(spark, sf_dir).where(~F.col("ok")).select("signature", F.concat(F.lit("excerpt "), (F.col("tick") % 23).cast("string")).alias("excerpt"), F.concat(F.lit("cron-"), (F.col("tick") % 31).cast("string"), F.lit(".json")).alias("log_path"))
    return healing.evidence(failed).withColumn("excerpts", F.array_join("excerpts", ";")).withColumn("logs", F.array_join("logs", ";"))


@query(f"""WITH {TICKS}, g AS (SELECT signature, max(failures) AS attempts, count(*) AS n_entities FROM streak GROUP BY 1 HAVING max(failures) >= {ESCALATE_AFTER} OR count(*) >= {ESCALATE_ENTITIES}),
b AS (SELECT signature, at_ms, CAST(1 AS BIGINT) AS attempts, CAST(1 AS BIGINT) AS n_entities FROM ticks WHERE NOT ok GROUP BY 1, 2), o AS (SELECT * FROM b UNION ALL SELECT signature, {NOW}, attempts, n_entities FROM g)
SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY signature ORDER BY at_ms DESC, attempts DESC) <= 50""")
def issue_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = ticks(spark, sf_dir)
    raised = healing.escalations(healing.streaks(every), ESCALATE_AFTER, ESCALATE_ENTITIES)
    before = every.where(~F.col("ok")).select("signature", "at_ms").distinct().select("signature", "at_ms", F.lit(1).cast("long").alias("attempts"), F.lit(1).cast("long").alias("n_entities"))
    return healing.occurrences(before, raised, NOW)


_ATTEMPTED = tuple(str(k) for k in range(0, 1000, 7))


@query(f"""WITH {TICKS}, g AS (SELECT signature, max(failures) AS attempts FROM streak GROUP BY 1 HAVING max(failures) >= {ESCALATE_AFTER} OR count(*) >= {ESCALATE_ENTITIES})
SELECT signature, attempts FROM g WHERE signature IN (SELECT signature FROM streak WHERE CAST(entity AS BIGINT) % 7 = 0 AND CAST(entity AS BIGINT) < 1000)""")
def off_cycle_escalations(spark: SparkSession, sf_dir: str) -> DataFrame:
    streak = healing.streaks(ticks(spark, sf_dir))
    return healing.off_cycle(healing.escalations(streak, ESCALATE_AFTER, ESCALATE_ENTITIES), streak, _ATTEMPTED).select("signature", "attempts")


@query("""WITH r AS (SELECT event_id AS tick, CASE WHEN event_id % 3 = 0 THEN 69 ELSE 0 END = 69 OR event_id % 7 = 0 AS bad FROM events), h AS (SELECT coalesce(max(tick) FILTER (NOT bad), -1) AS healed FROM r)
SELECT 'provider' AS entity, count(*) AS failures, 'provider-unavailable' AS signature FROM r, h WHERE bad AND tick > healed HAVING count(*) > 0""")
def provider_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    runs = table(spark, sf_dir, "events").select(e.alias("tick"), at_ms().alias("at_ms"), F.when(e % 3 == 0, 69).otherwise(0).alias("exit_code"), (e % 7 == 0).alias("skipped"))
    return healing.streaks(healing.provider_failures(runs)).select("entity", "failures", "signature")


@query("SELECT event_id, event_type AS kind FROM events ORDER BY event_id DESC LIMIT 50")
def kept_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.kept_last(table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("kind")), 50, "event_id")


@query(f"SELECT path FROM (SELECT strftime(ts, '%Y/%m') || '/cron-' || CAST(epoch_us(ts) // 1000 AS VARCHAR) || '.json' AS path, epoch_us(ts) // 1000 AS ms FROM events) WHERE ms >= {NOW} - 90 * 86400000::BIGINT")
def kept_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = table(spark, sf_dir, "events").select(F.concat(F.date_format("ts", "yyyy/MM"), F.lit("/cron-"), at_ms().cast("string"), F.lit(".json")).alias("path"))
    return files.kept_logs(paths, NOW, 90)


@query(f"""WITH last AS (SELECT CAST(user_id AS VARCHAR) AS doc_id, max(epoch_us(ts) // 1000) AS ms FROM events WHERE user_id % 3 <> 0 GROUP BY 1)
SELECT doc_id, {NOW} - ms >= 24 * 3600000 AS due FROM last UNION ALL SELECT DISTINCT CAST(user_id AS VARCHAR), true FROM events WHERE user_id % 3 = 0""")
def due_stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("ts").alias("ts"))
    recalled = F.when(F.col("user_id") % 3 != 0, F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("Z"))).otherwise("unreadable")
    return last.select(F.col("user_id").cast("string").alias("doc_id"), D.due_for_stamp(recalled, F.lit(NOW), 24).alias("due"))
