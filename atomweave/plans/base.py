"""How queries are registered, and the SQL that oracles share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions.text import REDACTIONS
from ..schema import ATOM_TYPES, TASK_TYPES

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

NOW = 1_700_000_000_000


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with the DuckDB SQL that gives the same rows."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def listed(names: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{n}'" for n in names) + "]"


#: The document view in SQL; queries add their own steps.
LEAF = f"""leaf AS (
  SELECT CAST(doc_id AS VARCHAR) AS doc_id, doc_id AS n, {listed(ATOM_TYPES)}[doc_id % 8 + 1] AS atom_type,
         CASE doc_id % 8 WHEN 6 THEN 'self_improvement' WHEN 7 THEN 'plans' ELSE 'knowledge' END AS slot, source AS project_module, lang AS language,
         {listed(TASK_TYPES)}[(doc_id // 8) % 2 + 1] AS task_type, CASE WHEN doc_id % 11 <> 0 THEN 'ep-' || CAST(doc_id % 3 AS VARCHAR) END AS error_pattern, lang || ',' || source AS tags,
         CASE WHEN doc_id % 8 = 7 THEN 'plan-' || source || CASE WHEN doc_id % 3 = 0 THEN '' ELSE '-v' || CAST(doc_id % 5 AS VARCHAR) END || '.md' ELSE 'doc-' || CAST(doc_id AS VARCHAR) || '.md' END AS name,
         doc_id % 7 <> 0 AS enabled, {NOW} - (doc_id % 400) * 86400000 AS created_at_ms, text AS body
  FROM documents)"""


def redacted_sql(column: str) -> str:
    """The redaction rules for an engine without lookaround: ASCII word boundaries, and a stand-in for what one rule spares."""
    out = f"replace({column}, 'sk-ant-', chr(2))"
    for k, (pattern, replacement) in enumerate(REDACTIONS):
        if replacement.startswith("sk-ant-"):
            out = f"replace({out}, chr(2), 'sk-ant-')"
        pattern = pattern.replace("(?<![A-Za-z0-9_])", r"\b").replace("(?![A-Za-z0-9_])", r"\b").replace("(?!ant-)", "").replace("'", "''")
        replacement = replacement.replace("$1", r"\1").replace("$2", r"\2")
        out = f"regexp_replace({out}, '{pattern}', '{replacement}', 'g')"
    return out


def slug_sql(column: str, most: int = 60) -> str:
    cut = f"regexp_replace(left(regexp_replace(regexp_replace(lower(strip_accents(coalesce({column}, ''))), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), {most}), '-+$', '')"
    return f"CASE WHEN {cut} = '' THEN 'untitled' ELSE {cut} END"


TICKS = """ticks AS (
  SELECT CAST(user_id AS VARCHAR) AS entity, event_id AS tick, epoch_us(ts) // 1000 AS at_ms, event_type <> 'error' AS ok, 'sig-' || CAST(CAST(json_extract_string(props, '$.k') AS BIGINT) % 5 AS VARCHAR) AS signature FROM events),
healed AS (SELECT entity, max(tick) AS healed FROM ticks WHERE ok GROUP BY 1),
streak AS (
  SELECT t.entity, count(*) AS failures, min(at_ms) AS first_ms, max(at_ms) AS last_ms, arg_max(signature, tick) AS signature
  FROM ticks t LEFT JOIN healed h ON h.entity = t.entity WHERE NOT ok AND (healed IS NULL OR tick > healed) GROUP BY 1)"""
