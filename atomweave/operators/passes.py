"""Whole passes over the stored documents: consolidation, and promotion of day documents. Each takes a version of the store and decisions, and gives the next version as
one DataFrame with what was done, so that a commit changes all of it or nothing.

A pass works out changes (doc_id, rank, done, patch, new_body, enabled_after), of which the highest rank of a document counts, and joins them to the store once. What was done is counted by an
``Observation`` while the next version is written, and kept with that version as totals over all passes so far."""

from __future__ import annotations

from collections.abc import Callable
from datetime import UTC, datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as X
from ..schema import ARCHIVE_DAYS, BODY_CHARS, LESSON, PLAN, PROMOTION_TRIES, SLOT_POLICIES, STALE_MONTHS
from . import atoms, decisions, dedup, leaf, lifecycle, store

REFINED = tuple(slot for slot, policy in SLOT_POLICIES.items() if policy == "refine")
DAILY = "daily"
#: Metadata of a day document: how many words it had when it was promoted, and failed tries since.
PROMOTED_WORDS, TRIES = "promoted_words", "promotion_tries"


def change(rows: DataFrame, rank: int, done: Column, patch: dict[str, Column], body: Column | None = None, enabled: Column | None = None) -> DataFrame:
    """Changes of ``rows`` (doc_id, …)."""
    entries = [x for name, value in patch.items() for x in (F.lit(name), value.cast("string"))]
    of = F.create_map(*entries) if entries else F.create_map().cast("map<string,string>")
    none = lambda kind: F.lit(None).cast(kind)
    return rows.select("doc_id", F.lit(rank).alias("rank"), done.alias("done"), of.alias("patch"), (none("string") if body is None else body).alias("new_body"), (none("boolean") if enabled is None else enabled).alias("enabled_after"))


def applied(base: DataFrame, changes: DataFrame) -> DataFrame:
    """The base with its changes, and ``done`` besides; a null in a patch takes the field out. Changes are few beside the base, and meet it in one join."""
    last = changes.groupBy("doc_id").agg(F.max_by(F.struct("done", "patch", "new_body", "enabled_after"), "rank").alias("c"))
    joined = base.join(last, "doc_id", "left")
    old = F.coalesce(F.col("metadata"), F.create_map().cast("map<string,string>"))
    merged = F.map_filter(F.map_concat(F.map_filter(old, lambda k, v: ~F.map_contains_key(F.col("c.patch"), k)), F.col("c.patch")), lambda k, v: v.isNotNull())
    known = {"metadata": F.when(F.col("c").isNull(), F.col("metadata")).otherwise(merged), "body": F.coalesce("c.new_body", "body"), "enabled": F.coalesce("c.enabled_after", "enabled")}
    return joined.select(*[known.get(name, F.col(name)).alias(name) for name in base.columns], F.col("c.done").alias("done"))


def candidate_pairs(active: DataFrame, alike: DataFrame | None = None) -> DataFrame:
    """(loser_id, keeper_id, source_pass): equal bodies and lesson keys, and pairs of likeness if given, of active documents; one for each loser, at its chain's end."""
    found = [dedup.sha256_pairs(active), dedup.lesson_key_pairs(active)] + ([alike.select("keeper_id", "loser_id", "source_pass")] if alike is not None else [])
    pairs = dedup.with_rank(reduce(DataFrame.unionByName, found)).withColumn("scan_idx", F.col("keeper_id"))
    return dedup.ultimate_keepers(dedup.retained(pairs))


def consolidation(base: DataFrame, pairs: DataFrame, merges: DataFrame, refreshes: DataFrame, now: int, at: str, refresh_most: int | None = None) -> DataFrame:
    """Changes of a consolidation of slots that are refined: pairs are archived, merged, or left, by decisions; documents that this leaves as they are get their
    stale flag, and stale ones what was decided on them, the ``refresh_most`` of a slot that were recalled last; bodies archived long ago are cut.

    Decisions are those of ``decisions.merges`` and ``decisions.refreshes``. Documents that a pair consumed (archived losers, rewritten keepers) take no part in what follows."""
    ours = base.where(F.col("slot").isin(*REFINED))
    enabled = F.coalesce("enabled", F.lit(True))
    outcomes = decisions.merges(pairs, merges, BODY_CHARS, at)
    lost = outcomes.where("outcome in ('merge', 'archive')").select(F.col("loser_id").alias("doc_id"), "keeper_id", "outcome")
    kept = outcomes.where("outcome = 'merge'").select(F.col("keeper_id").alias("doc_id"), "body")
    consumed = lost.select("doc_id").unionByName(kept.select("doc_id"))
    live = dedup.unused(ours.where(enabled), consumed).withColumn("stale", F.element_at("metadata", "stale"))
    flags = lifecycle.stale_changes(live, now, STALE_MONTHS, lifecycle.STALE_TYPES)
    stale = live.join(lifecycle.stale_documents(live, now, STALE_MONTHS, lifecycle.STALE_TYPES).select("doc_id"), "doc_id", "left_semi")
    if refresh_most is not None:
        stale = lifecycle.last_of_each(stale, ["slot"], [F.coalesce(F.to_timestamp("last_recalled_at"), F.timestamp_millis(F.lit(0))).desc(), F.col("doc_id")], refresh_most)
    told = decisions.refreshes(stale, refreshes, BODY_CHARS, at)
    acted = told.where("outcome in ('keep', 'refresh', 'archive')")
    stamp = lambda names: F.when(F.col("outcome").isin(*names), F.lit(at))
    renewed = acted.withColumn("patch", F.map_filter(F.create_map(F.lit("stale"), F.col("stale"), F.lit("last_refreshed_at"), stamp(["refresh"]), F.lit("consolidated_at"), stamp(["refresh", "archive"])), lambda k, v: v.isNotNull()))
    renewed = renewed.select("doc_id", F.lit(2).alias("rank"), F.concat(F.lit("refresh-"), "outcome").alias("done"), "patch", F.col("body").alias("new_body"), F.when(F.col("outcome") == "archive", False).alias("enabled_after"))
    old = ours.where(~enabled & F.element_at("metadata", "consolidate_truncated_at").isNull())
    cut = lifecycle.compressible(old, now, BODY_CHARS, ARCHIVE_DAYS)
    parts = [
        change(lost, 3, F.concat(F.lit("pair-"), "outcome"), {"superseded_by": F.col("keeper_id"), "consolidated_at": F.lit(at)}, enabled=F.lit(False)),
        change(kept, 3, F.lit("pair-keeper"), {"consolidated_at": F.lit(at)}, F.col("body")),
        change(flags, 1, F.lit("stale-flag"), {"stale": F.col("stale")}),
        renewed,
        change(cut, 1, F.lit("compress"), {"consolidate_truncated_at": F.lit(at)}, F.col("truncated")),
    ]
    return reduce(DataFrame.unionByName, parts)


def promotion(base: DataFrame, candidates: DataFrame, given: DataFrame, failed: DataFrame, today: str, now: int, active_days: int, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(changes of day documents and of what is replaced, new documents) of a promotion of the enabled day documents in slot ``daily``.

    Days are classified by age and by the words they had when they were promoted. Atoms of days to be read are decided by ``candidates`` (atom_id, rank, doc_id) and
    ``given`` (atom_id, action, target_id, merged_name, merged_text); an id is the day's id, a dash and the place. What can't be decided yet, an update without a text, and the writes
    in ``failed`` (atom_id) leave their day for another try, PROMOTION_TRIES at most. A day without atoms, or with all done, is marked, or retires if it is old."""
    days = base.where((F.col("slot") == DAILY) & F.coalesce("enabled", F.lit(True)))
    days = days.withColumn("word_count", F.size(F.filter(F.split(F.coalesce("body", F.lit("")), r"\s+"), lambda w: w != "")).cast("long"))
    was = F.element_at("metadata", PROMOTED_WORDS).cast("long")
    verb = lifecycle.daily_verb(lifecycle.daily_age(F.col("name"), today), was.isNotNull(), F.col("word_count"), was, active_days)
    verbs = days.select("doc_id", "name", "body", "word_count", verb.alias("verb"), was.isNotNull().alias("known"), F.coalesce(F.element_at("metadata", TRIES).cast("int"), F.lit(0)).alias("tries"))
    done_with = verbs.where("verb = 'retire' and known")
    read = verbs.where("verb = 'promote' or (verb = 'retire' and not known)")

    found = atoms.validated(atoms.parsed(read.select("doc_id", F.col("body").alias("text")), ["doc_id"]).where(F.col("type") != PLAN)).withColumn("atom_id", F.concat_ws("-", "doc_id", F.col("position").cast("string")))
    judged = atoms.quality(found)
    judged = judged.where("ok") if strict else judged
    chosen = atoms.decisions(judged, candidates, given.select("atom_id", "action", "target_id")).join(given.select("atom_id", "merged_name", "merged_text"), "atom_id", "left")
    skipped = given.where(F.col("action") == "skip").select("atom_id", F.lit(True).alias("skip"))
    each = judged.join(chosen, "atom_id").join(skipped, "atom_id", "left").join(failed.select("atom_id").distinct().withColumn("bad", F.lit(True)), "atom_id", "left")
    forced = (F.col("type") == LESSON) & (F.col("error_pattern") != "")
    blank_update = (F.col("action") == "update") & ~forced & X.blank(F.col("merged_text"))
    action = F.when(F.col("skip") & ~(forced & (F.col("action") == "update")), "skip").when(F.col("action") == "unresolved", "error").when(blank_update, "error").otherwise(F.col("action"))
    each = each.withColumn("action", action)

    writes = each.where(F.col("action").isin("create", "update"))
    at = F.lit(store_time(now)[:-1]).cast("timestamp_ntz")
    target = base.select(F.col("doc_id").alias("target_id"), F.col("name").alias("target_name"))
    named = atoms.writes(writes.join(target, "target_id", "left"), at)
    titled = writes.withColumn("title", F.when(F.col("action") == "update", F.coalesce(F.nullif(X.trimmed(F.col("merged_name")), F.lit("")), "title")).otherwise(F.col("title")))
    text = titled.select("atom_id", leaf.slot_of(F.col("type")).alias("slot"), F.col("type").alias("atom_type"), atoms.stored_metadata().alias("metadata"), atoms.promoted_text(F.lit(store_time(now)), F.when(F.col("action") == "update", F.col("merged_text"))).alias("body"))
    new = named.join(text, "atom_id")
    made = new.select(store.document_id(F.col("slot"), F.col("name"), F.col("atom_id")).alias("doc_id"), "slot", "name", "atom_type", F.lit(True).alias("enabled"), F.lit(now).cast("long").alias("created_at_ms"), F.lit(None).cast("string").alias("last_recalled_at"), "metadata", "body", F.concat(F.lit("atom-"), "action").alias("done"))
    replaced = new.where(F.col("supersedes").isNotNull()).select(F.col("supersedes").alias("doc_id")).distinct()

    wrong = each.where((F.col("action") == "error") | F.col("bad")).select("doc_id").distinct().withColumn("wrong", F.lit(True))
    after = read.join(wrong, "doc_id", "left").withColumn("wrong", F.coalesce("wrong", F.lit(False))).withColumn("old", F.col("verb") == "retire")
    last_try = F.col("tries") + 1 >= PROMOTION_TRIES
    finished = ~F.col("wrong") | last_try
    done = F.when(finished & F.col("old"), F.when(F.col("wrong"), "day-given-up").otherwise("day-retired")).when(finished, F.when(F.col("wrong"), "day-given-up").otherwise("day-promoted")).otherwise("day-retried")
    words = F.when(finished & ~F.col("old"), F.col("word_count"))
    changes = [
        change(after, 1, done, {PROMOTED_WORDS: words, TRIES: F.when(~finished, F.col("tries") + 1)}, enabled=F.when(finished & F.col("old"), False)),
        change(done_with, 1, F.lit("day-retired"), {PROMOTED_WORDS: F.lit(None).cast("string"), TRIES: F.lit(None).cast("string")}, enabled=F.lit(False)),
        change(replaced, 2, F.lit("atom-replaced"), {}, enabled=F.lit(False)),
    ]
    return reduce(DataFrame.unionByName, changes), made


def store_time(ms: int) -> str:
    return datetime.fromtimestamp(ms / 1000, UTC).strftime("%Y-%m-%dT%H:%M:%S.") + f"{ms % 1000:03d}Z"


def counters(kinds: tuple[str, ...]) -> list[Column]:
    return [F.count_if(F.col("done") == kind).alias(kind) for kind in kinds]


PAIR_KINDS = ("pair-archive", "pair-merge", "pair-keeper", "stale-flag", "refresh-keep", "refresh-refresh", "refresh-archive", "compress")
DAY_KINDS = ("atom-create", "atom-update", "atom-replaced", "day-promoted", "day-retired", "day-retried", "day-given-up")


def committed(shelf: store.Snapshots, step: Callable[[DataFrame], DataFrame], kinds: tuple[str, ...], batch: tuple[str, int] | None = None) -> int:
    """Commits ``step`` of the last version, whose rows tell what was ``done``, and gives the new version's number. Counts of what was done are observed while it is
    written and added to those of the version before. A batch that was committed changes nothing; another writer in between raises LostRace."""
    if batch is not None and (known := shelf.seen(*batch)) is not None:
        return known
    version = shelf.last()
    observed = Observation()
    state = step(shelf.read(version)).observe(observed, *counters(kinds)).drop("done")
    before = shelf.told(version)
    return shelf.commit(state, base=version, batch=batch, told=lambda: before | {kind: before.get(kind, 0) + n for kind, n in observed.get.items()})


def consolidated(base: DataFrame, pairs: DataFrame, merges: DataFrame, refreshes: DataFrame, now: int, at: str, refresh_most: int | None = None) -> DataFrame:
    """The next version, with ``done``."""
    return applied(base, consolidation(base, pairs, merges, refreshes, now, at, refresh_most))


def promoted(base: DataFrame, candidates: DataFrame, given: DataFrame, failed: DataFrame, today: str, now: int, active_days: int, strict: bool = False) -> DataFrame:
    """The next version, with ``done``: new documents are added."""
    changes, made = promotion(base, candidates, given, failed, today, now, active_days, strict)
    now_is = applied(base, changes)
    return now_is.unionByName(made.select(*[c if c in made.columns else F.lit(None).cast(now_is.schema[c].dataType).alias(c) for c in now_is.columns]))


def by_stream(decided: DataFrame, shelf: store.Snapshots, step: Callable[[DataFrame, DataFrame], DataFrame], kinds: tuple[str, ...], name: str, checkpoint: str) -> StreamingQuery:
    """Runs a pass for each batch of a stream of decisions: ``step`` takes the last version and the batch. The version that a batch makes holds the batch's number, so one that
    Spark sends again, after a failure between a commit and the stream's own, changes nothing."""

    def run(batch: DataFrame, number: int) -> None:
        committed(shelf, lambda base: step(base, batch), kinds, (name, number))

    return decided.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
