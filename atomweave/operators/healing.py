"""Failure streaks, escalations, issues and health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..schema import DAY_MS


def streaks(ticks: DataFrame, idle_days: int | None = None, now_ms: int | None = None) -> DataFrame:
    """(entity, failures, first_ms, last_ms, signature): failures of each entity since its last success, from
    (entity, tick, at_ms, ok, signature). A success and a failure in one tick is a failure.

    Two aggregates with partial sums, so that an entity with many ticks isn't sorted in one task."""
    ticks = ticks.groupBy("entity", "tick").agg(F.min("at_ms").alias("at_ms"), F.min("ok").alias("ok"), F.max(F.when(~F.col("ok"), F.col("signature"))).alias("signature"))
    healed = ticks.where("ok").groupBy("entity").agg(F.max("tick").alias("healed"))
    open_ticks = ticks.where(~F.col("ok")).join(healed, "entity", "left").where(F.col("healed").isNull() | (F.col("tick") > F.col("healed")))
    out = open_ticks.groupBy("entity").agg(F.count("*").alias("failures"), F.min("at_ms").alias("first_ms"), F.max("at_ms").alias("last_ms"), F.max_by("signature", "tick").alias("signature"))
    if idle_days is not None:
        out = out.where(F.lit(now_ms) - F.col("last_ms") <= idle_days * DAY_MS)
    return out


def escalations(streak: DataFrame, after: int, entities: int, shown: int = 5) -> DataFrame:
    """(signature, reason, attempts, first_ms, last_ms, n_entities, entities): signatures that an entity failed on so often,
    or that so many entities share. Ids are shown up to a fixed number, the smallest first; the count is of all."""
    grouped = streak.groupBy("signature").agg(F.max("failures").alias("attempts"), F.min("first_ms").alias("first_ms"), F.max("last_ms").alias("last_ms"), F.count("*").alias("n_entities"))
    # ids are ranked, which Spark limits on the map side, so that no signature's ids are gathered whole
    first = streak.withColumn("nth", F.row_number().over(Window.partitionBy("signature").orderBy("entity"))).where(F.col("nth") <= shown)
    ids = first.groupBy("signature").agg(F.array_join(F.sort_array(F.collect_list("entity")), ",").alias("entities"))
    reason = F.when(F.col("attempts") >= after, "pending-consecutive").when(F.col("n_entities") >= entities, "recurring-bug")
    return grouped.withColumn("reason", reason).where("reason is not null").join(ids, "signature").select("signature", "reason", "attempts", "first_ms", "last_ms", "n_entities", "entities")


def history(ticks: DataFrame, after: int) -> DataFrame:
    """The last ticks of each entity, so many as an escalation may ask about."""
    nth = F.row_number().over(Window.partitionBy("entity").orderBy(F.desc("tick")))
    return ticks.withColumn("nth", nth).where(F.col("nth") <= max(after + 2, 5)).drop("nth")


def evidence(failures: DataFrame, shown: int = 5) -> DataFrame:
    """(signature, n_excerpts, excerpts, n_logs, logs) of failures (signature, excerpt, log_path): so many different excerpts, the
    first by text, and the last log paths by name; all are counted."""

    def first(column: str, order: Column, count: str, listed: str) -> DataFrame:
        once = failures.where(F.col(column).isNotNull() & (F.col(column) != "")).select("signature", column).distinct()
        few = once.withColumn("nth", F.row_number().over(Window.partitionBy("signature").orderBy(order))).where(F.col("nth") <= shown)
        texts = few.groupBy("signature").agg(F.sort_array(F.collect_list(column)).alias(listed))
        return once.groupBy("signature").agg(F.count("*").alias(count)).join(texts, "signature")

    return first("excerpt", F.col("excerpt"), "n_excerpts", "excerpts").join(first("log_path", F.desc("log_path"), "n_logs", "logs"), "signature", "full")


def occurrences(before: DataFrame, escalated: DataFrame, at_ms: int, most: int = 50) -> DataFrame:
    """(signature, at_ms, attempts, n_entities): what was noted of each issue with what this run notes, the last ``most``."""
    now = escalated.select("signature", F.lit(at_ms).cast("long").alias("at_ms"), "attempts", "n_entities")
    nth = F.row_number().over(Window.partitionBy("signature").orderBy(F.desc("at_ms"), F.desc("attempts")))
    return before.unionByName(now).withColumn("nth", nth).where(F.col("nth") <= most).drop("nth")


def off_cycle(escalated: DataFrame, streak: DataFrame, attempted: tuple[str, ...]) -> DataFrame:
    """Escalations that a run between cycles may note: those of signatures on which entities that it attempted fail."""
    return escalated.join(streak.where(F.col("entity").isin(*attempted)).select("signature").distinct(), "signature", "left_semi")


def issues(known: DataFrame, live: DataFrame, escalated: DataFrame) -> DataFrame:
    """(signature, version, status): issues as they stand after a run. Known issues (signature, version, status) without a
    live signature are resolved; escalated ones are opened, or opened again with the next version."""
    live = live.select("signature").distinct().withColumn("live", F.lit(True))
    raised = escalated.select("signature").distinct().withColumn("raised", F.lit(True))
    both = known.join(raised, "signature", "full").join(live, "signature", "left")
    status = F.when(F.col("raised"), "open").when((F.col("status") == "open") & F.col("live").isNull(), "resolved").otherwise(F.col("status"))
    again = F.col("raised") & (F.col("status") == "resolved")
    version = F.when(F.col("version").isNull(), 1).when(again, F.col("version") + 1).otherwise(F.col("version"))
    return both.select("signature", version.cast("long").alias("version"), status.alias("status"))


def provider_failures(runs: DataFrame, unavailable: int = 69) -> DataFrame:
    """Failures of a run's provider as an entity of its own: (entity, tick, at_ms, ok, signature) from (tick, at_ms,
    exit_code, skipped). A run that could not reach its provider, or was cut short, fails it; another heals it."""
    bad = (F.col("exit_code") == unavailable) | F.coalesce("skipped", F.lit(False))
    return runs.select(F.lit("provider").alias("entity"), "tick", "at_ms", (~bad).alias("ok"), F.when(bad, "provider-unavailable").otherwise("").alias("signature"))


def due(last_ms: int | None, now_ms: int, days: float) -> bool:
    """Whether a pass that may run every so many days is due; the driver asks before it starts one."""
    return last_ms is None or now_ms - last_ms >= days * DAY_MS


def issue_report() -> Column:
    """The text of an issue from columns of ``escalations``, with secrets replaced."""
    when = lambda c: F.date_format(F.timestamp_millis(c), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    lines = F.concat_ws("\n", F.concat(F.lit("# "), "signature"), F.lit(""), F.concat(F.lit("- reason: "), "reason"), F.concat(F.lit("- attempts: "), F.col("attempts").cast("string")), F.concat(F.lit("- first failure: "), when("first_ms")),
                        F.concat(F.lit("- last failure: "), when("last_ms")), F.concat(F.lit("- entities ("), F.col("n_entities").cast("string"), F.lit("): "), "entities"))
    return X.redacted(lines)


def health(attempts: DataFrame, open_counts: DataFrame) -> DataFrame:
    """(kind, verdict, last_failure_ms) from (kind, tick, at_ms, ok) and open escalations (kind, open)."""
    last = attempts.groupBy("kind").agg(F.max_by("ok", "tick").alias("last_ok"), F.max(F.when(~F.col("ok"), F.col("at_ms"))).alias("last_failure_ms"))
    joined = last.join(open_counts, "kind", "left")
    verdict = F.when(F.coalesce("open", F.lit(0)) > 0, "unhealthy: open escalation").when(~F.col("last_ok"), "unhealthy: last attempt failed").otherwise("healthy")
    return joined.select("kind", verdict.alias("verdict"), "last_failure_ms")


# the same, batch by batch -------------------------------------------------------------------------------------------

#: State of entities and of issues in one table, so that a commit changes both or neither.
STATE = "kind string, id string, failures long, first_ms long, last_ms long, signature string, version long, status string"
ISSUE_KINDS = ("issue-opened", "issue-reopened", "issue-resolved", "entity-failing")


def advanced(before: DataFrame, ticks: DataFrame) -> DataFrame:
    """``streaks`` of all ticks so far, from those ``before`` and the ticks of a batch, which come after all earlier ones: what a success in the batch
    doesn't end goes on. Entities without failures are gone, so the state follows those that fail."""
    healed = ticks.groupBy("entity", "tick").agg(F.min("ok").alias("ok")).where("ok").select("entity").distinct().withColumn("healed", F.lit(True))
    new = streaks(ticks).select("entity", *[F.col(c).alias(f"new_{c}") for c in ("failures", "first_ms", "last_ms", "signature")])
    both = before.join(new, "entity", "full").join(healed, "entity", "left")
    going_on = F.col("healed").isNull() & F.col("failures").isNotNull()
    failures = F.coalesce("new_failures", F.lit(0)) + F.when(going_on, F.col("failures")).otherwise(0)
    out = both.select("entity", failures.cast("long").alias("failures"), F.when(going_on, F.col("first_ms")).otherwise(F.col("new_first_ms")).alias("first_ms"), F.coalesce("new_last_ms", "last_ms").alias("last_ms"), F.coalesce("new_signature", "signature").alias("signature"))
    return out.where("failures > 0")


def healing_pass(state: DataFrame, ticks: DataFrame, after: int, entities: int, idle_days: int = 90) -> DataFrame:
    """The next state (STATE) and what was ``done``, from a batch of ticks (entity, tick, at_ms, ok, signature): failing entities go on, those idle for so many days
    before the batch's last tick are forgotten, and issues are opened, opened again or resolved."""
    old = state.where("kind = 'entity'").select(F.col("id").alias("entity"), "failures", "first_ms", "last_ms", "signature")
    now = ticks.agg(F.max("at_ms").alias("now"))
    failing = advanced(old, ticks).crossJoin(F.broadcast(now)).where(F.col("now").isNull() | (F.col("now") - F.col("last_ms") <= idle_days * DAY_MS)).drop("now")  # one row
    known = state.where("kind = 'issue'").select(F.col("id").alias("signature"), "version", "status")
    after_it = issues(known, failing.select("signature"), escalations(failing, after, entities))
    was = known.select("signature", F.col("version").alias("old_version"), F.col("status").alias("old_status"))
    done = F.when(F.col("old_version").isNull(), "issue-opened").when(F.col("version") > F.col("old_version"), "issue-reopened").when((F.col("status") == "resolved") & (F.col("old_status") == "open"), "issue-resolved")
    none = lambda *names: [F.lit(None).cast(kind).alias(c) for c, kind in names]
    told = after_it.join(was, "signature", "left").select(F.lit("issue").alias("kind"), F.col("signature").alias("id"), *none(("failures", "long"), ("first_ms", "long"), ("last_ms", "long"), ("signature", "string")), "version", "status", done.alias("done"))
    rows = failing.select(F.lit("entity").alias("kind"), F.col("entity").alias("id"), "failures", "first_ms", "last_ms", "signature", *none(("version", "long"), ("status", "string")), F.lit("entity-failing").alias("done"))
    return rows.unionByName(told)
