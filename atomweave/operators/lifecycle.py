"""Staleness, archives, daily documents, refresh queues and recall stamps."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names as N
from ..functions import text as X
from ..functions import times as D
from ..schema import DAY_MS, LESSON

#: Types that grow stale; records meant to last do not.
STALE_TYPES = (LESSON, "bug-root-cause", "feedback-rule", "pattern-gotcha")
TRUNCATED = "\n\n[truncated]"


def stale_documents(leaves: DataFrame, now: int, months: float, types: tuple[str, ...], active: bool = True) -> DataFrame:
    """Documents of eligible types without activity for more than so many months; enabled ones alone unless told otherwise."""
    last = D.last_activity(F.col("last_recalled_at"), F.col("created_at_ms"))
    found = (leaves.where(F.coalesce("enabled", F.lit(True))) if active else leaves).withColumn("last_ms", last)
    return found.where(D.stale(F.col("atom_type"), F.col("last_ms"), now, months, types)).select("doc_id", "slot", "atom_type", "last_ms")


def stale_changes(leaves: DataFrame, now: int, months: float, types: tuple[str, ...]) -> DataFrame:
    """(doc_id, stale) where the flag that is stored differs from what holds now."""
    last = D.last_activity(F.col("last_recalled_at"), F.col("created_at_ms"))
    now_stale = F.coalesce(D.stale(F.col("atom_type"), last, now, months, types), F.lit(False)).cast("string")
    return leaves.withColumn("next", now_stale).where(~F.coalesce("stale", F.lit("false")).eqNullSafe(F.col("next"))).select("doc_id", F.col("next").alias("stale"))


def compressible(leaves: DataFrame, now: int, most: int, days: int) -> DataFrame:
    """Archived documents older than so many days with bodies longer than ``most``, with the body cut and the bytes freed."""
    old = (~F.coalesce("enabled", F.lit(True))) & F.col("body").isNotNull() & (F.length("body") > most) & (F.col("created_at_ms") != 0) & (F.lit(now) - F.col("created_at_ms") > days * DAY_MS)
    cut = X.truncated(F.col("body"), most, TRUNCATED)
    freed = F.greatest(F.lit(0), F.octet_length("body") - F.octet_length(cut)).cast("long")
    return leaves.where(old).select("doc_id", "slot", F.length("body").cast("long").alias("n_chars"), cut.alias("truncated"), freed.alias("freed_bytes"))


def classify_daily(days: DataFrame, promoted: DataFrame, today: str, active: int) -> DataFrame:
    """(name, verb) of daily documents (name, word_count) against what was promoted (name, word_count): today's and unreadable
    ones are left, old ones retire, new or changed ones are promoted. A change is promoted before a day retires."""
    joined = days.join(promoted.select("name", F.col("word_count").alias("was"), F.lit(True).alias("known")), "name", "left").withColumn("age", daily_age(F.col("name"), today))
    verb = daily_verb(F.col("age"), F.col("known").isNotNull(), F.col("word_count"), F.col("was"), active)
    return joined.select("name", F.col("age").cast("long").alias("age"), verb.alias("verb"))


def daily_age(name: Column, today: str) -> Column:
    return D.days_between(N.daily_date(name), F.lit(today))


def daily_verb(age: Column, known: Column, words: Column, was: Column, active: int) -> Column:
    return F.when(age.isNull() | (age <= 0), "skip-today").when(age >= active, "retire").when(~known | ~words.eqNullSafe(was), "promote").otherwise("skip-promoted")


def refresh_queue(stale: DataFrame, most: int) -> DataFrame:
    """The stale documents to refresh first: last recalled latest, then by id."""
    recalled = F.coalesce(D.epoch_ms(F.col("last_recalled_at")), F.lit(0))
    return stale.withColumn("recalled_ms", recalled).orderBy(F.desc("recalled_ms"), "doc_id").limit(most)


def accepted_stamps(hits: DataFrame, key: str, at_ms: str, debounce_ms: int) -> DataFrame:
    """(key, stamps, last_ms): recall hits of each document that count, each at least the debounce after the last that did.

    The rule is sequential: what counts depends on the last hit that counted. Hits are sorted by document and time within
    partitions, which Spark does on disk where it must, and folded as they stream past: a task holds one document's count
    and time, however many hits that document has. Equal times count once and are dropped on the map side."""
    kind = hits.schema[key].dataType.simpleString()

    def fold(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], schema.field(key).type), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())], names=[key, "stamps", "last_ms"])
        schema, now, count, last, done = None, None, 0, 0, []
        for batch in batches:
            schema = batch.schema
            for name, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if count and name == now:
                    if at - last >= debounce_ms:
                        count, last = count + 1, at
                    continue
                if count:
                    done.append((now, count, last))
                now, count, last = name, 1, at
            if len(done) > 10_000:
                yield out(done)
                done = []
        if count:
            yield out([*done, (now, count, last)])

    ordered = hits.where(F.col(at_ms).isNotNull()).select(key, F.col(at_ms).cast("long").alias(at_ms)).distinct().repartition(F.col(key)).sortWithinPartitions(key, at_ms)
    return ordered.mapInArrow(fold, f"{key} {kind}, stamps long, last_ms long")


def give_up(retries: DataFrame, most: int) -> DataFrame:
    """(…, action) after a failed promotion: try again, or at the limit disable if the day has aged out, else mark it done."""
    action = F.when(F.col("attempts") < most, "retry").when(F.col("aged_out"), "disable").otherwise("mark-promoted")
    return retries.withColumn("action", action)


def last_of_each(df: DataFrame, keys: list[str], order: list, most: int) -> DataFrame:
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rn") <= most)
