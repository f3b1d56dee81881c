"""Capture of plans and absorption of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import globs as G
from ..functions import names as N
from ..functions import text as X
from ..schema import FILE_BYTES, PLAN_BYTES


def plan_specs(hooks: DataFrame, ascii_only: bool = False, most: int = PLAN_BYTES, origin: str = "a captured plan") -> DataFrame:
    """(…, skip, name, text) of approved plans (plan, approved): secrets replaced, fenced, named by title; or why not."""
    clean = X.trimmed(X.redacted(F.col("plan")))
    seen = hooks.withColumn("clean", clean)
    skip = (
        F.when(~F.col("approved").eqNullSafe(True), "not-approved").when(F.col("plan").isNull() | (F.col("clean") == ""), "empty-plan")
        .when(F.octet_length("clean") > most, f"plan-too-large (>{most} bytes)")
    )
    named = seen.withColumn("skip", skip).withColumn("title", X.title_of(F.col("clean")))
    name = F.concat(F.lit("plan-"), X.slug(F.col("title"), ascii_only=ascii_only), F.lit(".md"))
    kept = F.col("skip").isNull()
    return named.select(*[c for c in hooks.columns if c != "plan"], "skip", F.when(kept, name).alias("name"), F.when(kept, X.fenced(F.col("clean"), origin)).alias("text"))


def url_path(url: Column) -> Column:
    """The path of a URL without host, query and fragment, as a relative path."""
    return F.regexp_replace(F.regexp_replace(F.regexp_extract(url, r"^[a-z]+://[^/]+/([^?#]*)", 1), "/+$", ""), "^$", "index")


def absorbed(files: DataFrame, include: tuple[str, ...] | None = None, ignore: tuple[str, ...] = (), most: int = FILE_BYTES) -> DataFrame:
    """(…, doc_name, status) of files (rel_path, size): what is absorbed under which name, and why others are not."""
    escape = F.col("rel_path").rlike(r"(^|/)\.\.(/|$)|^/")
    status = F.when(escape, "outside-workspace").when(~G.wanted(F.col("rel_path"), include, ignore), "ignored").when(F.col("size") > most, "too-large").otherwise("absorbed")
    return files.withColumn("doc_name", N.flat_name(F.col("rel_path"))).withColumn("status", status)


def totals(results: DataFrame) -> DataFrame:
    return results.groupBy("status").agg(F.count("*").alias("files"), F.sum("size").cast("long").alias("bytes"))
