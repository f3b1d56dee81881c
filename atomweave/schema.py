"""Names, enumerations and defaults of the document store."""

from __future__ import annotations

from pyspark.sql import types as T

# Formats that stored documents share.
ATOM_TYPES = ("decision", "bug-root-cause", "feedback-rule", "project-lore", "reference", "pattern-gotcha", "self-improvement-lesson", "plan")
TASK_TYPES = ("planning", "implementation", "debugging", "refactor", "review", "deploy", "docs", "unknown")
METADATA_FIELDS = (
    "atom_type", "tags", "project_module", "language", "task_type", "error_pattern",
    "last_recalled_at", "recall_count", "superseded_by", "consolidated_at", "stale", "last_refreshed_at", "consolidate_truncated_at",
)
LESSON, PLAN = "self-improvement-lesson", "plan"
CROSS_REFERENCES = ("bug-root-cause", "feedback-rule")
SLOT_OF_TYPE = {LESSON: "self_improvement", PLAN: "plans"}
DEFAULT_SLOT = "knowledge"
SLOT_POLICIES = {"knowledge": "refine", "self_improvement": "refine", "plans": "none", "investigations": "none", "daily": "none"}
LESSON_FIELDS = ("project_module", "task_type", "error_pattern")

DAY_MS = 86_400_000
#: A month is 30.4375 days, whatever the calendar says.
MONTH_MS = 2_629_800_000

VECTOR_WEIGHT, KEYWORD_WEIGHT = 0.7, 0.3
SEARCH_RESULTS, RECALL_RESULTS, RECALL_SCORE = 8, 5, 0.55
CLUSTER_RESULTS, CLUSTER_SCORE, MERGE_SCORE, CLUSTER_QUERY_CHARS = 12, 0.5, 0.88, 240
PROMOTION_CANDIDATES = 5
STALE_MONTHS, LORE_DAYS, ARCHIVE_DAYS, BODY_CHARS = 6, 90, 180, 1200
ACTIVE_DAYS, PROMOTION_TRIES = 7, 3
RECALL_DEBOUNCE_HOURS = 24
ESCALATE_AFTER, ESCALATE_ENTITIES = 3, 3
CHUNK_WORDS, CHUNK_OVERLAP, CHUNK_SEPARATOR = 700, 120, "\n\n### "
FILE_BYTES, PLAN_BYTES = 500_000, 256_000
TURNS, TURN_CHARS = 30, 80_000
QUALITY_CHARS, TITLE_CHARS, ATOM_CHARS, EVIDENCE_CHARS = 80, 80, 700, 240

ATOM = T.StructType([
    T.StructField("type", T.StringType()), T.StructField("title", T.StringType()), T.StructField("tags", T.ArrayType(T.StringType())),
    T.StructField("metadata", T.MapType(T.StringType(), T.StringType())), T.StructField("body", T.StringType()), T.StructField("evidence", T.StringType()),
])

FINDING_COLUMNS = ("class", "slot", "doc_id", "name", "reason", "suggested_action")
