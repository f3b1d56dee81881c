"""Streaming forms of recall stamps, daily documents and failure streaks. Each gives what the batch form gives."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def recall_stamps(hits: DataFrame, debounce_ms: int) -> DataFrame:
    """(doc_id, stamps, last_ms) after each batch, from a stream of (doc_id, at_ms). The state of a document are its count
    and the time of the last hit that counted; late hits inside the debounce of that time never count."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        count, last = state.get if state.exists else (0, None)
        for at in heapq.merge(*[sorted(set(batch["at_ms"].dropna().astype("int64"))) for batch in batches]):
            if last is None or at - last >= debounce_ms:
                count, last = count + 1, int(at)
        if last is not None:
            state.update((count, last))
            yield pd.DataFrame({"doc_id": [key[0]], "stamps": [count], "last_ms": [last]})

    return hits.groupBy("doc_id").applyInPandasWithState(step, "doc_id string, stamps long, last_ms long", "stamps long, last_ms long", "update", GroupStateTimeout.NoTimeout)


def failure_streaks(ticks: DataFrame) -> DataFrame:
    """(entity, failures, first_ms, last_ms, signature) after each batch, from a stream of (entity, tick, at_ms, ok,
    signature); an entity that succeeds has 0 failures. Ticks arrive in order across batches, as a log is read."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        failures, first, last, signature = state.get if state.exists else (0, 0, 0, "")
        told: dict[int, tuple[int, bool, str]] = {}  # one entry for each tick, whatever the number of its rows
        for batch in batches:
            for tick, at, ok, said in zip(batch["tick"], batch["at_ms"], batch["ok"], batch["signature"], strict=True):
                was = told.get(tick, (at, True, ""))
                told[tick] = min(was[0], at), was[1] and bool(ok), was[2] if ok else max(was[2], str(said))
        for tick in sorted(told):
            at, ok, said = told[tick]
            failures, first, last, signature = (0, 0, 0, "") if ok else (failures + 1, first if failures else int(at), int(at), said)
        state.update((failures, first, last, signature))
        yield pd.DataFrame({"entity": [key[0]], "failures": [failures], "first_ms": [first], "last_ms": [last], "signature": [signature]})

    kinds = "failures long, first_ms long, last_ms long, signature string"
    return ticks.groupBy("entity").applyInPandasWithState(step, f"entity string, {kinds}", kinds, "update", GroupStateTimeout.NoTimeout)


def daily_counts(events: DataFrame, at: str, watermark: str = "8 days") -> DataFrame:
    """(day, n_entries, n_chars) of captured entries (…, text) by UTC day; a day is closed a week and a day after its end."""
    windowed = events.withWatermark(at, watermark).groupBy(F.window(at, "1 day").alias("w"))
    counted = windowed.agg(F.count("*").alias("n_entries"), F.sum(F.length("text")).alias("n_chars"))
    # the window starts at midnight UTC, whatever the session's zone is
    return counted.select(F.date_from_unix_date(F.floor(F.unix_seconds("w.start") / 86_400).cast("int")).alias("day"), "n_entries", "n_chars")


#: A day closes so long after its end, by the time at which entries arrive.
GRACE_MS = 3_600_000


def day_text(entries: list[tuple[int, str, str]]) -> str:
    """Entries (at_ms, entry_id, text) in order, as they are merged into a day's text: blank ones vanish but for the last, and each loses the
    white space at its end before the next. The text is put together once, so that the work is as long as the text."""
    texts = [text for _, _, text in sorted(entries)]
    return "\n\n".join([*(text.rstrip() for text in texts[:-1] if text.strip()), *texts[-1:]])


class DayTexts(StatefulProcessor):
    """A day's entries as a list, and whether the day has closed, which a timer does."""

    def __init__(self, grace_ms: int):
        self.grace_ms = grace_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entries = handle.getListState("entries", "at_ms long, entry_id string, text string")
        self.closed = handle.getValueState("closed", "closed boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [(int(at), str(i), "" if text is None else str(text)) for batch in rows for at, i, text in zip(batch["at_ms"], batch["entry_id"], batch["text"], strict=True)]
        if self.closed.exists():
            yield pd.DataFrame([(key[0], "late", 1, text, i) for _, i, text in sorted(new)], columns=DAY_COLUMNS)
            return
        if not self.entries.exists():
            end = int(pd.Timestamp(key[0], tz="UTC").timestamp() * 1000) + 86_400_000 + self.grace_ms
            self.handle.registerTimer(max(end, timerValues.getCurrentWatermarkInMs() + 1))
        self.entries.appendList(new)
        yield self.told(key[0], "open")

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self.told(key[0], "closed")
        self.closed.update((True,))
        self.entries.clear()

    def told(self, day: str, kind: str) -> pd.DataFrame:
        held = [(int(a), i, t) for a, i, t in self.entries.get()]
        return pd.DataFrame([(f"daily-{day}.md", kind, len(held), day_text(held), None)], columns=DAY_COLUMNS)

    def close(self) -> None:
        pass


DAY_COLUMNS = ["name", "kind", "n_entries", "text", "entry_id"]


def day_texts(entries: DataFrame, grace_ms: int = GRACE_MS, watermark: str = "0 seconds") -> DataFrame:
    """(name, kind, n_entries, text, entry_id) from a stream of (captured_at, arrived_at, entry_id, text): after each batch the ``open`` text of every day that it
    touched; once the arrivals are ``grace_ms`` past a day's end its ``closed`` text, the last; then every further entry of that day by itself, as ``late``.

    The watermark is on arrivals, so that Spark drops no entry for being captured long ago: none vanishes. The state of a closed day is one flag. Needs the RocksDB state store."""
    at_ms = F.unix_millis("captured_at")
    day = F.date_format(F.date_from_unix_date(F.floor(at_ms / 86_400_000).cast("int")), "yyyy-MM-dd")
    keyed = entries.withWatermark("arrived_at", watermark).select("arrived_at", day.alias("day"), at_ms.alias("at_ms"), F.col("entry_id").cast("string").alias("entry_id"), "text")
    kinds = "name string, kind string, n_entries long, text string, entry_id string"
    out = keyed.groupBy("day").transformWithStateInPandas(statefulProcessor=DayTexts(grace_ms), outputStructType=kinds, outputMode="Update", timeMode="EventTime")
    return out.withColumn("name", F.when(F.col("kind") == "late", F.concat(F.lit("daily-"), "name", F.lit(".md"))).otherwise(F.col("name")))
