"""What becomes of decisions on merges and refreshes. Decisions are an input table; a decision that names other documents than
it was asked about, or an unknown action, changes nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from . import dedup, store

#: What counts in the totals of a report, by outcome.
COUNTED = {"archive": "archived", "merge": "merged", "refresh": "refreshed", "flag": "flagged", "keep": "touched", "error": "errors", "wait": "waiting"}


def cut_marker(at: str) -> str:
    return f"\n\n[cut at {at}]\n"


def capped(body: Column, most: int, at: str) -> Column:
    return F.when(F.length(body) > most, X.truncated(body, most, cut_marker(at))).otherwise(body)


def merges(pairs: DataFrame, given: DataFrame, most: int, at: str) -> DataFrame:
    """(keeper_id, loser_id, source_pass, outcome, body) of pairs, from what was decided on (keeper_id, loser_id): (said_keeper,
    said_loser, action, merged_body, written).

    Pairs without a decision are archived if they are certain, else they wait. A merge whose text is blank, or that could not
    be written, leaves both documents. Of several merges into one keeper the one with the smallest loser counts now, and
    the others wait, so that no text is overwritten unread."""
    both = dedup.deterministic(pairs).join(given.withColumn("decided", F.lit(True)), ["keeper_id", "loser_id"], "left")
    other_ids = ~(F.col("said_keeper").eqNullSafe(F.col("keeper_id")) & F.col("said_loser").eqNullSafe(F.col("loser_id")))
    merge = F.col("action") == "merge"
    outcome = (
        F.when(F.col("decided").isNull(), F.when(F.col("deterministic"), "archive").otherwise("wait")).when(other_ids, "error").when(F.col("action") == "skip", "flag")
        .when(merge & (F.coalesce("merged_body", F.lit("")) == ""), "error").when(merge & ~F.coalesce("written", F.lit(True)), "error").when(merge, "merge")
        .when(F.col("action") == "keep-keeper-unchanged", "archive").otherwise("error")
    )
    told = both.withColumn("outcome", outcome)
    nth = F.row_number().over(Window.partitionBy("keeper_id", "outcome").orderBy("loser_id"))
    ready = told.where("outcome = 'merge'").withColumn("nth", nth).withColumn("outcome", F.when(F.col("nth") > 1, "wait").otherwise("merge")).drop("nth")
    out = told.where("outcome <> 'merge'").unionByName(ready)
    return out.select("keeper_id", "loser_id", "source_pass", "outcome", F.when(F.col("outcome") == "merge", capped(F.col("merged_body"), most, at)).alias("body"))


def merged(base: DataFrame, outcomes: DataFrame, at: str) -> DataFrame:
    """The next state of (doc_id, body, metadata, enabled, …): keepers with the merged text, losers archived under them."""
    texts = outcomes.where("outcome = 'merge'").select(F.col("keeper_id").alias("doc_id"), F.col("body").alias("new_body"))
    joined = base.join(texts, "doc_id", "left")
    hit = F.col("new_body").isNotNull()
    stamped = store.merged_metadata(F.col("metadata"), F.create_map(F.lit("consolidated_at"), F.lit(at)))
    rewritten = joined.withColumn("metadata", F.when(hit, stamped).otherwise(F.col("metadata"))).withColumn("body", F.coalesce("new_body", "body")).select(*base.columns)
    return store.archived(rewritten, outcomes.where("outcome in ('merge', 'archive')"), at)


def refreshes(stale: DataFrame, given: DataFrame, most: int, at: str) -> DataFrame:
    """(doc_id, outcome, stale, body) of stale documents, from what was decided on doc_id: (said_id, action, stale_after,
    rewritten_body). Only an explicit false clears the flag; a blank text is an error; without a decision the flag stays."""
    both = stale.select("doc_id").join(given.withColumn("decided", F.lit(True)), "doc_id", "left")
    outcome = (
        F.when(F.col("decided").isNull(), "wait").when(~F.col("said_id").eqNullSafe(F.col("doc_id")), "error").when(F.col("action") == "keep", "keep")
        .when((F.col("action") == "rewrite") & (F.coalesce("rewritten_body", F.lit("")) == ""), "error").when(F.col("action") == "rewrite", "refresh").when(F.col("action") == "archive", "archive").otherwise("wait")
    )
    told = both.withColumn("outcome", outcome)
    flag = F.when(F.col("outcome") == "refresh", "false").when(F.col("outcome") == "keep", F.when(F.col("stale_after").eqNullSafe(False), "false").otherwise("true")).when(F.col("outcome") == "archive", "true")
    return told.select("doc_id", "outcome", flag.alias("stale"), F.when(F.col("outcome") == "refresh", capped(F.col("rewritten_body"), most, at)).alias("body"))


def refreshed(base: DataFrame, outcomes: DataFrame, at: str) -> DataFrame:
    """The next state of (doc_id, body, metadata, enabled, …): flags set, texts rewritten, archived documents disabled."""
    acted = outcomes.where(F.col("stale").isNotNull()).select("doc_id", F.col("outcome").alias("did"), F.col("stale").alias("flag"), F.col("body").alias("new_body"))
    joined = base.join(acted, "doc_id", "left")
    stamps = F.when(F.col("did") == "refresh", F.create_map(F.lit("stale"), "flag", F.lit("last_refreshed_at"), F.lit(at), F.lit("consolidated_at"), F.lit(at)))
    stamps = stamps.when(F.col("did") == "archive", F.create_map(F.lit("stale"), "flag", F.lit("consolidated_at"), F.lit(at))).otherwise(F.create_map(F.lit("stale"), "flag"))
    out = joined.withColumn("metadata", F.when(F.col("did").isNotNull(), store.merged_metadata(F.col("metadata"), stamps)).otherwise(F.col("metadata")))
    out = out.withColumn("body", F.coalesce("new_body", "body")).withColumn("enabled", F.when(F.col("did") == "archive", False).otherwise(F.col("enabled")))
    return out.select(*base.columns)


def totals(outcomes: DataFrame, keys: list[str]) -> DataFrame:
    """Counts of outcomes for each of the keys, under the names of a report."""
    return outcomes.groupBy(*keys).agg(*[F.count_if(F.col("outcome") == name).alias(column) for name, column in COUNTED.items()])
