"""Queries on transcripts, atoms, names, redaction and capture."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import atoms, capture
from ..operators.leaf import leaves, nth, slot_of, table
from ..schema import ATOM_TYPES, FILE_BYTES, TURNS
from .base import LEAF, listed, query, redacted_sql, slug_sql

DURABLE = ATOM_TYPES[:7]

#: Atoms made from turns: rows that hold and rows that don't.
RAW = f"""raw AS (
  SELECT conv_id, turn, {listed(DURABLE)}[(conv_id + turn) % 7 + 1] AS type, left(trim(text), 80) AS title, left(trim(text), 700) AS body, role AS tag, 'mod-' || CAST(conv_id % 5 AS VARCHAR) AS project_module,
         CASE WHEN turn % 4 = 0 THEN '' WHEN turn % 4 = 1 THEN 'debugging' ELSE 'nonsense' END AS task_type, CASE WHEN turn % 3 = 0 THEN '' ELSE 'ep-' || CAST(turn AS VARCHAR) END AS error_pattern,
         CASE WHEN turn % 2 = 0 THEN 'turn ' || CAST(turn AS VARCHAR) END AS evidence FROM conversations),
good AS (SELECT conv_id, turn, type, title, body, tag, project_module, CASE WHEN task_type IN ('', 'debugging') THEN task_type ELSE 'unknown' END AS task_type, error_pattern, evidence FROM raw
  WHERE title <> '' AND body <> '' AND tag <> '' AND (type <> 'self-improvement-lesson' OR (task_type <> '' AND error_pattern <> '')))"""


def raw_atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("conv_id") + F.col("turn")
    task = F.when(F.col("turn") % 4 == 0, "").when(F.col("turn") % 4 == 1, "Debugging").otherwise("nonsense")
    pattern = F.when(F.col("turn") % 3 == 0, "").otherwise(F.concat(F.lit("EP-"), F.col("turn").cast("string")))
    module = F.concat(F.lit("Mod-"), (F.col("conv_id") % 5).cast("string"), F.lit("\n"))
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.upper(nth(DURABLE, n % 7)).alias("type"), F.col("text").alias("title"), F.col("text").alias("body"), F.array(F.upper("role"), F.lit(" ")).alias("tags"),
        F.create_map(F.lit("project_module"), module, F.lit("task_type"), task, F.lit("error_pattern"), pattern).alias("metadata"), F.when(F.col("turn") % 2 == 0, F.concat(F.lit("turn "), F.col("turn").cast("string"))).alias("evidence"),
    )


@query(f"WITH {RAW} SELECT conv_id, turn, type, title, body, tag AS tags, project_module, task_type, error_pattern, evidence FROM good")
def validate_atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return atoms.validated(raw_atoms(spark, sf_dir)).select("conv_id", "turn", "type", "title", "body", F.array_join("tags", ",").alias("tags"), "project_module", "task_type", "error_pattern", "evidence")


@query(f"""WITH {RAW} SELECT conv_id, turn, type, array_to_string(list_filter([CASE WHEN length(body) < 80 THEN 'body-too-short' END, CASE WHEN evidence IS NULL AND NOT regexp_matches(body, '(?is)(^|\\n)\\s*(why|how to apply)\\s*:') THEN 'no-evidence' END],
  lambda x: x IS NOT NULL), ',') AS reasons FROM good""")
def quality_rubric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return atoms.quality(atoms.validated(raw_atoms(spark, sf_dir))).select("conv_id", "turn", "type", "reasons")


@query(f"WITH {RAW} SELECT CASE type WHEN 'self-improvement-lesson' THEN 'self_improvement' ELSE 'knowledge' END AS slot, type, count(*) AS n FROM good GROUP BY 1, 2")
def route_atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return atoms.validated(raw_atoms(spark, sf_dir)).groupBy(slot_of(F.col("type")).alias("slot"), "type").agg(F.count("*").alias("n"))


@query(f"""WITH {RAW} SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS nth, type, trim(string_split(title, chr(10))[1]) AS title, regexp_replace(body, '\\s+$', '') AS body, tag AS tags, project_module, evidence FROM good""")
def parse_atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Atoms of each conversation, written as a document and read from it again: what comes out is what went in."""
    good = atoms.validated(raw_atoms(spark, sf_dir))
    written = atoms.rendered(good, ["conv_id"], "turn", F.lit("# Daily flush"))
    read = atoms.parsed(written, ["conv_id"])
    return read.select("conv_id", F.col("position").cast("long").alias("nth"), "type", "title", "body", F.array_join("tags", ",").alias("tags"), F.element_at("metadata", "project_module").alias("project_module"), "evidence")


@query(f"""WITH {RAW}, c AS (SELECT project_module, arg_min(turn, (conv_id, turn)) AS turn, arg_min(conv_id, (conv_id, turn)) AS conv_id FROM good GROUP BY 1)
SELECT g.conv_id || '-' || g.turn AS atom_id, CASE WHEN type = 'self-improvement-lesson' AND g.error_pattern <> '' THEN 'update' ELSE 'unresolved' END AS action,
       CASE WHEN type = 'self-improvement-lesson' AND g.error_pattern <> '' THEN c.conv_id || '-' || c.turn END AS target_id FROM good g JOIN c ON c.project_module = g.project_module""")
def forced_lesson_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = atoms.validated(raw_atoms(spark, sf_dir)).withColumn("atom_id", F.concat_ws("-", "conv_id", "turn"))
    first = good.groupBy("project_module").agg(F.min_by("atom_id", F.struct("conv_id", "turn")).alias("doc_id"))
    candidates = good.select("atom_id", "project_module").join(first, "project_module").select("atom_id", F.lit(1).alias("rank"), "doc_id")
    return atoms.decisions(good, candidates)


TURN = "'### ' || CASE role WHEN 'user' THEN 'User' WHEN 'assistant' THEN 'Assistant' ELSE role END || chr(10) || chr(10) || trim(text)"


@query(f"""WITH t AS (SELECT conv_id, turn, {TURN} AS block FROM conversations WHERE role IN ('user', 'assistant', 'summary', 'system') AND trim(text) <> '' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= {TURNS}),
j AS (SELECT conv_id, count(*) AS turn_count, string_agg(block, chr(10) || chr(10) ORDER BY turn) AS body FROM t GROUP BY 1)
SELECT conv_id, turn_count, sha256({redacted_sql("body")}) AS body_sha, CASE WHEN turn_count < 2 THEN 'too-few-turns' END AS skip FROM j""")
def transcript_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return atoms.source_material(table(spark, sf_dir, "conversations"), least=2).select("conv_id", "turn_count", F.sha2("body", 256).alias("body_sha"), "skip")


@query("""SELECT 'daily-' || strftime(DATE '2023-01-01' + CAST(conv_id // 20 AS INTEGER), '%Y-%m-%d') || '.md' AS name, count(*) AS n_turns,
  sha256(string_agg(text, chr(10) || chr(10) ORDER BY conv_id, turn)) AS text_sha FROM conversations GROUP BY 1""")
def daily_accumulate(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.date_add(F.lit("2023-01-01").cast("date"), F.floor(F.col("conv_id") / 20).cast("int"))
    name = F.concat(F.lit("daily-"), F.date_format(day, "yyyy-MM-dd"), F.lit(".md"))
    # a day holds twenty conversations, whatever the table's size
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("conv_id", "turn", "text"))), lambda x: x["text"]), "\n\n")
    return table(spark, sf_dir, "conversations").groupBy(name.alias("name")).agg(F.count("*").alias("n_turns"), F.sha2(joined, 256).alias("text_sha"))


@query(f"SELECT CAST(doc_id AS VARCHAR) AS doc_id, sha256({redacted_sql('text')}) AS text_sha, {redacted_sql('text')} <> text AS changed FROM documents")
def redact_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text", X.redacted(F.col("text")).alias("clean"))
    return out.select("doc_id", F.sha2("clean", 256).alias("text_sha"), (F.col("clean") != F.col("text")).alias("changed"))


@query(f"SELECT CAST(doc_id AS VARCHAR) AS doc_id, {slug_sql('text')} AS slug FROM documents")
def slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), X.slug(F.col("text")).alias("slug"))


#: Messages around whole texts: quoted words, times, paths, files and numbers, and the words of the text itself.
MESSAGES = (
    "'Timeout after ' || n_chars || ' ms reading \"the file ' || source || '\" ' || text", "'ENOENT: /srv/' || source || '/' || doc_id || '.txt: ' || text",
    "'2024-01-02T03:04:05Z worker ' || doc_id || ' failed: ' || text", "'cannot parse data.' || lang || '.json (line ' || doc_id || '), ' || text", "text",
)
_KINDS = " ".join(f"WHEN regexp_matches(w, '{p}') THEN 'any-{k}'" for k, p in X.WORD_KINDS).replace("^\u0001$", "^\\x01$")


@query(f"""WITH m AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, CASE doc_id % 5 {" ".join(f"WHEN {k} THEN {m}" for k, m in enumerate(MESSAGES))} END AS raw FROM documents),
w AS (SELECT doc_id, list_transform(regexp_split_to_array(regexp_replace(lower({redacted_sql("coalesce(raw, '')")}), '"[^"]*"|''[^'']*''|`[^`]*`', ' ' || chr(1) || ' ', 'g'), '[ \\t\\n\\x0b\\f\\r]+'),
  lambda w: regexp_replace(w, '^[(\\[{{<,;:.!?]+|[)\\]}}>,;:.!?]+$', '', 'g')) AS ws FROM m),
k AS (SELECT doc_id, list_filter(list_transform(ws, lambda w: CASE {_KINDS} ELSE regexp_replace(w, '[^\\pL]+', '-', 'g') END), lambda w: NOT regexp_matches(w, '^-*$')) AS ks FROM w),
o AS (SELECT doc_id, array_to_string(list_filter(ks, lambda x, i: i = 1 OR NOT starts_with(x, 'any-') OR x <> ks[i - 1]), ' ') AS told FROM k)
SELECT doc_id, {slug_sql("'compile document ' || CASE WHEN told = '' THEN 'unknown-error' ELSE told END", 80)} AS signature FROM o""")
def error_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    message = F.expr(f"CASE doc_id % 5 {' '.join(f'WHEN {k} THEN {m}' for k, m in enumerate(MESSAGES))} END")
    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), X.error_signature(message, F.lit("document"), F.lit("compile")).alias("signature"))


TITLE = "left(trim(list_filter(string_split(clean, chr(10)), lambda x: trim(x) <> '')[1], chr(32) || chr(9) || chr(10) || chr(13)), 80)"


@query(f"""WITH {LEAF}, p AS (SELECT doc_id, n, trim({redacted_sql("body")}, chr(32) || chr(9) || chr(10) || chr(13)) AS clean FROM leaf WHERE slot = 'plans')
SELECT doc_id, CASE WHEN n % 3 = 1 THEN 'not-approved' WHEN clean = '' THEN 'empty-plan' END AS skip, CASE WHEN n % 3 <> 1 AND clean <> '' THEN 'plan-' || {slug_sql(TITLE)} || '.md' END AS name,
  CASE WHEN n % 3 <> 1 AND clean <> '' THEN sha256('{X.fence_head('a captured plan')}' || chr(10) || chr(10) || clean || chr(10) || chr(10) || '{X.FENCE_FOOT}') END AS text_sha FROM p""")
def plan_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    hooks = leaves(spark, sf_dir).where("slot = 'plans'").select("doc_id", F.col("body").alias("plan"), (F.col("n") % 3 != 1).alias("approved"))
    return capture.plan_specs(hooks).select("doc_id", "skip", "name", F.sha2("text", 256).alias("text_sha"))


PATH = "CASE WHEN regexp_replace(regexp_extract(url, '^[a-z]+://[^/]+/([^?#]*)', 1), '/+$', '') = '' THEN 'index' ELSE regexp_replace(regexp_extract(url, '^[a-z]+://[^/]+/([^?#]*)', 1), '/+$', '') END"
SMALL_FILE = 6_000


@query(f"""WITH f AS (SELECT page_id, {PATH} AS rel_path, strlen(html) AS size FROM pages)
SELECT page_id, rel_path, replace(rel_path, '/', '_') AS doc_name, CASE WHEN NOT regexp_matches(rel_path, '^(?:en|de|fr)/[^/]*$') OR regexp_matches(rel_path, '^de/[^/]*\\.html$') THEN 'ignored' WHEN size > {SMALL_FILE} THEN 'too-large' ELSE 'absorbed' END AS status FROM f""")
def absorb_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "pages").select("page_id", capture.url_path(F.col("url")).alias("rel_path"), F.octet_length("html").alias("size"))
    return capture.absorbed(files, include=("en/*", "de/*", "fr/*"), ignore=("de/*.html",), most=SMALL_FILE).select("page_id", "rel_path", "doc_name", "status")


@query(f"""WITH f AS (SELECT {PATH} AS rel_path, strlen(html) AS size FROM pages)
SELECT CASE WHEN NOT regexp_matches(rel_path, '\\.html$') THEN 'ignored' WHEN size > {FILE_BYTES} THEN 'too-large' ELSE 'absorbed' END AS status, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM f GROUP BY 1""")
def absorb_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "pages").select(capture.url_path(F.col("url")).alias("rel_path"), F.octet_length("html").alias("size"))
    return capture.totals(capture.absorbed(files, include=("**/*.html",)))
