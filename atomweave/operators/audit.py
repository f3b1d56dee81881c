"""Audit rules: each gives (class, slot, doc_id, name, reason, suggested_action)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names as N
from ..functions import text as X
from ..schema import DAY_MS, FINDING_COLUMNS, LESSON, LESSON_FIELDS, MONTH_MS


def finding(df: DataFrame, kind: str, reason: Column, action: str) -> DataFrame:
    return df.select(F.lit(kind).alias("class"), "slot", "doc_id", "name", reason.alias("reason"), F.lit(action).alias("suggested_action")).select(*FINDING_COLUMNS)


def stale_plans(leaves: DataFrame) -> DataFrame:
    """Plans that a later plan replaces, whose name goes on after a hyphen.

    Each later plan stands under all hyphen prefixes of its name; under one name, rows are sorted from late to early, and
    the plan last seen is the next later one. So the work follows rows times prefixes, and not pairs of plans; the frame
    only grows, which Spark keeps up with row by row."""
    plans = leaves.where(F.col("slot") == "plans").withColumn("slug", N.plan_slug(F.col("name"))).where("slug is not null")
    parts = F.split("slug", "-")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "-"))
    later = plans.where(F.size(parts) > 1).select(F.explode(prefixes).alias("slug"), "created_at_ms", "n", F.col("name").alias("newer"))
    older = plans.select("slug", "created_at_ms", "n", F.lit(None).cast("string").alias("newer"), "slot", "doc_id", "name")
    seen = Window.partitionBy("slug").orderBy(F.desc("created_at_ms"), F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)
    found = older.unionByName(later, allowMissingColumns=True).withColumn("by", F.last("newer", ignorenulls=True).over(seen)).where("doc_id is not null and by is not null")
    return finding(found, "stale-plans", F.concat(F.lit("superseded by "), F.col("by")), "delete")


def missing_metadata(leaves: DataFrame) -> DataFrame:
    """Lessons without one of their fields, and root causes without a module; white space counts as missing."""
    lacks = lambda fields: F.array_join(F.array_compact(F.array(*[F.when(X.blank(F.col(f)), F.lit(f)) for f in fields])), ", ")
    wanted = F.when(F.col("atom_type") == LESSON, lacks(LESSON_FIELDS)).when(F.col("atom_type") == "bug-root-cause", lacks(("project_module",))).otherwise("")
    found = leaves.where(F.col("atom_type").isin(LESSON, "bug-root-cause")).withColumn("lacks", wanted).where("lacks <> ''")
    return finding(found, "missing-metadata", F.concat(F.lit("missing: "), F.col("lacks")), "disable")


def stale_lore(leaves: DataFrame, now: int, days: int) -> DataFrame:
    """Lore of at least so many days."""
    age = F.floor((F.lit(now) - F.col("created_at_ms")) / DAY_MS).cast("long")
    found = leaves.where((F.col("atom_type") == "project-lore") & (F.lit(now) - F.col("created_at_ms") >= days * DAY_MS)).withColumn("age", age)
    return finding(found, "stale-lore", F.concat(F.lit("age "), F.col("age").cast("string"), F.lit(" days")), "disable")


def duplicate_patterns(leaves: DataFrame) -> DataFrame:
    """Lessons whose error pattern, trimmed and as written, a newer lesson has too. The newest is an aggregate joined back."""
    lessons = leaves.where(F.col("slot") == "self_improvement").withColumn("pattern", X.trimmed(F.col("error_pattern"))).where("pattern <> ''")
    newest = lessons.groupBy("pattern").agg(F.max_by(F.struct("doc_id", "name"), F.struct("created_at_ms", -F.col("n"))).alias("kept"), F.count("*").alias("members")).where("members > 1")
    found = lessons.join(newest, "pattern").where(F.col("doc_id") != F.col("kept.doc_id"))
    return finding(found, "duplicate-error-pattern", F.concat(F.lit("same error_pattern as "), F.col("kept.name")), "delete")


def findings(leaves: DataFrame, now: int, lore_days: int, classes: tuple[str, ...] = ("stale-plans", "missing-metadata", "stale-lore", "duplicate-error-pattern")) -> DataFrame:
    rules = {"stale-plans": lambda: stale_plans(leaves), "missing-metadata": lambda: missing_metadata(leaves), "stale-lore": lambda: stale_lore(leaves, now, lore_days), "duplicate-error-pattern": lambda: duplicate_patterns(leaves)}
    return reduce(DataFrame.unionByName, [rules[c]() for c in classes])


def summary(found: DataFrame) -> DataFrame:
    """(class, slot, n): by class, by slot and in all, in one pass; null stands for all."""
    return found.groupingSets([["class"], ["slot"], []], "class", "slot").agg(F.count("*").alias("n"))


def projection(leaves: DataFrame, duplicates: DataFrame, now: int, months: float, archive_days: int, types: tuple[str, ...]) -> DataFrame:
    """For each slot what consolidation would touch; duplicates are (slot, doc_id)."""
    last = F.greatest(F.coalesce(F.unix_millis(F.try_to_timestamp("last_recalled_at")), F.lit(0)), "created_at_ms")
    on = F.coalesce("enabled", F.lit(True))
    counts = leaves.groupBy("slot").agg(
        F.count_if(on).alias("working_set"), F.count_if(~on).alias("disabled"),
        F.count_if(on & F.col("atom_type").isin(*types) & (F.lit(now) - last > int(months * MONTH_MS))).alias("stale"),
        F.count_if(~on & (F.lit(now) - F.col("created_at_ms") > archive_days * DAY_MS)).alias("compressible_approx"),
    )
    return counts.join(duplicates.groupBy("slot").agg(F.count("*").alias("lesson_duplicates")), "slot", "left").fillna(0, ["lesson_duplicates"])
