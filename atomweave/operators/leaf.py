"""The document view of the store over the driver's tables, and row-level operators on it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import ATOM_TYPES, DAY_MS, DEFAULT_SLOT, METADATA_FIELDS, SLOT_OF_TYPE, SLOT_POLICIES, TASK_TYPES

NOW = 1_700_000_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nth(names: tuple[str, ...], index: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, names)), (index + 1).cast("int"))


def slot_of(atom_type: Column, fallback: str = DEFAULT_SLOT) -> Column:
    """Where a promoted atom goes: lessons and plans have slots of their own."""
    return reduce(lambda rest, kind: F.when(atom_type == kind, SLOT_OF_TYPE[kind]).otherwise(rest), SLOT_OF_TYPE, F.lit(fallback))


def leaves(spark: SparkSession, sf_dir: str, now: int = NOW) -> DataFrame:
    """One row for each document with its metadata as columns, so that predicates on them reach the scan."""
    n = F.col("doc_id")
    kind = nth(ATOM_TYPES, n % 8)
    plan_name = F.concat(F.lit("plan-"), F.col("source"), F.when(n % 3 == 0, "").otherwise(F.concat(F.lit("-v"), (n % 5).cast("string"))), F.lit(".md"))
    return table(spark, sf_dir, "documents").select(
        n.cast("string").alias("doc_id"), n.alias("n"), kind.alias("atom_type"), slot_of(kind).alias("slot"), F.col("source").alias("project_module"), F.col("lang").alias("language"),
        nth(TASK_TYPES, F.floor(n / 8) % 2).alias("task_type"), F.when(n % 11 != 0, F.concat(F.lit("ep-"), (n % 3).cast("string"))).alias("error_pattern"),
        F.concat_ws(",", "lang", "source").alias("tags"), F.when(kind == "plan", plan_name).otherwise(F.concat(F.lit("doc-"), n.cast("string"), F.lit(".md"))).alias("name"),
        (n % 7 != 0).alias("enabled"), (F.lit(now) - (n % 400) * F.lit(DAY_MS)).alias("created_at_ms"), F.lit(None).cast("string").alias("last_recalled_at"), F.col("text").alias("body"),
    )


def flattened(listing: Column) -> Column:
    """Metadata entries as a map; of entries with one name the last wins; null gives an empty map."""
    names = F.array_distinct(F.transform(listing, lambda e: e["name"]))
    last = F.transform(names, lambda name: F.element_at(F.filter(listing, lambda e: e["name"] == name), -1)["value"])
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    return F.when(listing.isNull(), empty).otherwise(F.map_from_arrays(names, last))


def condition(filters: dict[str, str | None], contains: tuple[str, ...] = ("tags",), either: bool = False) -> Column:
    """A predicate over metadata columns: equality, or a part for ``tags``; blank values are passed over. A null never matches."""
    terms = []
    for name, value in sorted(filters.items()):
        value = (value or "").strip()
        if value:
            terms.append(F.col(name).contains(value) if name in contains else F.col(name) == value)
    if not terms:
        return F.lit(True)
    return reduce((lambda a, b: a | b) if either else (lambda a, b: a & b), terms)


def with_default_module(filters: dict[str, str], module: str, always: bool) -> tuple[dict[str, str], dict[str, str]]:
    """Filters with the project's module where none is given, and what was put in. Searches do so only if they filter at all."""
    if module and not filters.get("project_module") and (always or filters):
        return {**filters, "project_module": module}, {"project_module": module}
    return dict(filters), {}


def listed(df: DataFrame, keyword: str = "", enabled: bool | None = None) -> DataFrame:
    """Documents whose name has the keyword; a null ``enabled`` is neither true nor false."""
    if keyword:
        df = df.where(F.col("name").contains(keyword))
    return df if enabled is None else df.where(F.col("enabled") == enabled)


def chunked(df: DataFrame, size: int, overlap: int, separator: str) -> DataFrame:
    """(doc_id, position, n_words, content): documents cut at the separator, and long parts in overlapping runs of words."""
    parts = df.select("doc_id", F.posexplode(F.split("body", separator)).alias("part", "piece"))
    words = parts.withColumn("words", F.filter(F.split("piece", r"\s+"), lambda w: w != "")).where(F.size("words") > 0)
    step = size - overlap
    last = F.greatest(F.lit(0), F.ceil((F.size("words") - size) / step)).cast("int")
    cut = words.select("doc_id", "part", F.explode(F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(i.alias("i"), F.slice("words", i * step + 1, size).alias("run")))).alias("c"))
    return cut.select("doc_id", F.col("part").cast("long").alias("part"), F.col("c.i").cast("long").alias("run"), F.size("c.run").cast("long").alias("n_words"), F.array_join("c.run", " ").alias("content"))


def assembled(segments: DataFrame, order: tuple[str, ...] = ("position",), separator: str = "\n\n") -> DataFrame:
    """(doc_id, body) of documents from their own segments (doc_id, position, content), in order."""
    of = F.array_sort(F.collect_list(F.struct(*order, "content")))
    return segments.groupBy("doc_id").agg(F.array_join(F.transform(of, lambda s: s["content"]), separator).alias("body"))


def named(df: DataFrame, name: str) -> DataFrame:
    """The document of exactly this name, the first by id, or none."""
    return df.where(F.col("name") == name).orderBy("doc_id").limit(1)


def working_set(df: DataFrame) -> DataFrame:
    """Every document, enabled or not, with its metadata as a map and without its body, which the scan then leaves out."""
    fields = [f for f in METADATA_FIELDS if f in df.columns]
    metadata = F.map_filter(F.create_map(*[x for f in fields for x in (F.lit(f), F.col(f))]), lambda k, v: v.isNotNull())
    return df.select("doc_id", "slot", "name", F.coalesce("enabled", F.lit(True)).alias("enabled"), "created_at_ms", metadata.alias("metadata"))


def filter_key(filters: Column) -> Column:
    """One text for equal filters, in whatever order they are given: JSON by name, without blanks."""
    kept = F.map_filter(filters, lambda k, v: F.trim(v) != "")
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(kept))))


def compact(hits: DataFrame) -> DataFrame:
    """What a caller sees of search hits: missing columns are null, scores that aren't numbers too, keywords an empty list."""
    given = lambda name, kind: (F.col(name).try_cast(kind) if name in hits.columns else F.lit(None).cast(kind)).alias(name)
    keywords = F.coalesce(F.col("keywords"), F.array().cast("array<string>")) if "keywords" in hits.columns else F.array().cast("array<string>")
    score = F.when(~F.isnan(F.col("score").try_cast("double")), F.col("score").try_cast("double"))
    return hits.select("slot", score.alias("score"), given("segment_id", "string"), "doc_id", given("name", "string"), given("position", "long"), given("enabled", "boolean"), keywords.alias("keywords"), given("n_words", "long"), F.coalesce(given("content", "string"), F.lit("")).alias("content"))


def resolved_ids(asked: DataFrame, known: DataFrame) -> DataFrame:
    """(asked, slot_id) of names or ids: a slot (slot, slot_id) in any case, else what looks like an id, else empty."""
    name = F.trim("asked")
    of = known.select(F.lower("slot").alias("low"), "slot_id").where("slot_id <> ''")
    joined = asked.join(of, F.lower(name) == F.col("low"), "left")
    return joined.select("asked", F.coalesce("slot_id", F.when(name.rlike("(?i)^[0-9a-f-]{20,}$"), name), F.lit("")).alias("slot_id"))


def created_slots(wanted: DataFrame, failed: DataFrame) -> DataFrame:
    """(slot, position, name, ok, complete) of the fields that new slots (slot) get; (slot, name) that could not be added fail,
    and a slot is complete without such."""
    every = wanted.select("slot").distinct().crossJoin(F.broadcast(metadata_fields(wanted.sparkSession)))  # 13 rows for each slot
    told = every.join(failed.select("slot", "name").distinct().withColumn("bad", F.lit(True)), ["slot", "name"], "left").withColumn("ok", F.col("bad").isNull())
    whole = told.groupBy("slot").agg(F.min("ok").alias("complete"))
    return told.join(whole, "slot").select("slot", "position", "name", "ok", "complete")


def slots(df: DataFrame) -> DataFrame:
    """(slot, policy, n_docs) of declared slots, those without documents included."""
    rows = [(slot, policy) for slot, policy in SLOT_POLICIES.items()]
    declared = df.sparkSession.createDataFrame(rows, "slot string, policy string")
    counts = df.groupBy("slot").agg(F.count("*").alias("n_docs"))
    return F.broadcast(declared).join(counts, "slot", "left").select("slot", "policy", F.coalesce("n_docs", F.lit(0)).alias("n_docs"))


def resolved_policies(bound: DataFrame, declared: dict[str, str]) -> DataFrame:
    """(slot, policy, refused): an explicit policy, else the built-in one; a bound slot without either is refused."""
    given = bound.sparkSession.createDataFrame([*{**SLOT_POLICIES, **declared}.items()], "slot string, policy string")
    return bound.join(F.broadcast(given), "slot", "left").select("slot", "policy", F.col("policy").isNull().alias("refused"))


def metadata_fields(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, name) for i, name in enumerate(METADATA_FIELDS)], "position int, name string")


def missing_fields(present: DataFrame) -> DataFrame:
    """(slot, name, position) of schema fields that a slot in (slot, name) lacks."""
    wanted = present.select("slot").distinct().crossJoin(F.broadcast(metadata_fields(present.sparkSession)))  # 13 rows for each slot
    return wanted.join(present, ["slot", "name"], "left_anti").select("slot", "name", "position")
