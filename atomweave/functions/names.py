"""Names of documents: built from times and slugs, and taken apart again."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def utc_stamp(at: Column) -> Column:
    """``YYYY-MM-DD-HHMMSSmmm``."""
    return F.date_format(at, "yyyy-MM-dd-HHmmssSSS")


def daily_name(at: Column) -> Column:
    return F.concat(F.lit("daily-"), F.date_format(at, "yyyy-MM-dd"), F.lit(".md"))


def daily_path(at: Column) -> Column:
    return F.date_format(at, "yyyy/MM/dd")


def dated_name(family: str, slug: Column, at: Column) -> Column:
    """``knowledge-<slug>-<stamp>.md`` and the like."""
    return F.concat(F.lit(f"{family}-"), slug, F.lit("-"), utc_stamp(at), F.lit(".md"))


def parsed_dated(name: Column, family: str) -> Column:
    """struct<slug, stamp> of a dated name of a family, or null."""
    pattern = rf"^{family}-(.+)-(\d{{4}}-\d{{2}}-\d{{2}}-\d{{9}})\.md$"
    return F.when(name.rlike(pattern), F.struct(F.regexp_extract(name, pattern, 1).alias("slug"), F.regexp_extract(name, pattern, 2).alias("stamp")))


def daily_date(name: Column) -> Column:
    """The day of a daily document's name, with or without a time of day, or null."""
    return F.nullif(F.regexp_extract(name, r"^daily-(\d{4}-\d{2}-\d{2})(?:-\d{9})?\.md$", 1), F.lit(""))


def plan_slug(name: Column) -> Column:
    return F.nullif(F.regexp_extract(name, r"^plan-(.+)\.md$", 1), F.lit(""))


def flat_name(path: Column) -> Column:
    """A relative path as a document's name."""
    return F.translate(path, "\\/", "__")


def log_path(epoch_ms: Column) -> Column:
    at = F.timestamp_millis(epoch_ms)
    return F.concat(F.date_format(at, "yyyy/MM"), F.lit("/cron-"), epoch_ms.cast("string"), F.lit(".json"))
