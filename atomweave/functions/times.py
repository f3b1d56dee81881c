"""Times as columns. Every function takes ``now``; nothing reads the clock."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import DAY_MS, MONTH_MS


def epoch_ms(text: Column) -> Column:
    """Milliseconds of a time written as text; null where it isn't one."""
    return F.unix_millis(F.try_to_timestamp(text))


def last_activity(recalled_at: Column, created_ms: Column) -> Column:
    return F.greatest(F.coalesce(epoch_ms(recalled_at), F.lit(0)), F.coalesce(created_ms, F.lit(0)))


def stale(atom_type: Column, last_ms: Column, now: int, months: float, types: tuple[str, ...]) -> Column:
    """Eligible and idle for more than so many months."""
    return atom_type.isin(*types) & (last_ms != 0) & ((F.lit(now) - last_ms) > months * MONTH_MS)


def days_between(older: Column, newer: Column) -> Column:
    return F.datediff(F.try_to_date(newer), F.try_to_date(older))


def due_for_stamp(recalled_at: Column, now_ms: Column, hours: int) -> Column:
    """Never stamped, stamped unreadably, or at least so many hours ago."""
    last = epoch_ms(recalled_at)
    return last.isNull() | (now_ms - last >= hours * 3_600_000)


def days_since(recalled_at: Column, now: int) -> Column:
    last = epoch_ms(recalled_at)
    return F.when(last.isNull(), "never").otherwise(F.greatest(F.lit(0), F.round((F.lit(now) - last) / DAY_MS)).cast("long").cast("string"))
