"""Lookups in a table of keys of which some few may have a large share of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys of which a copy goes to all tasks: those with most rows.
HOT_KEYS = 10_000


def looked_up(rows: DataFrame, table: DataFrame, key: str, weight: str, spread: Column, hot_keys: int = HOT_KEYS) -> DataFrame:
    """``rows`` with the columns that ``table`` (key, weight, …) has for their key, without rows whose key it lacks; null keys meet nothing.

    ``weight`` says how many rows a key has. Rows of the ``hot_keys`` weightiest keys meet a broadcast of just these; in the shuffle for all
    others they go by ``spread``, which differs from row to row, and meet nothing there. So no task gets all rows of a key that is among these; any
    other key has at most one row in ``hot_keys``. ``table`` is used twice and should be written or cheap."""
    values = [c for c in table.columns if c not in (key, weight)]
    hot = table.orderBy(F.desc(weight), key).limit(hot_keys).select(key, F.struct(*values).alias("hot_"))
    led = rows.where(F.col(key).isNotNull()).join(F.broadcast(hot), key, "left")  # hot_keys rows
    mine = lambda x: F.concat(F.lit("k"), x.cast("string"))
    led = led.withColumn("at_", F.when(F.col("hot_").isNull(), mine(F.col(key))).otherwise(F.concat(F.lit("h"), spread.cast("string"))))
    rest = table.select(mine(F.col(key)).alias("at_"), F.struct(*values).alias("rest_"))
    found = led.join(rest, "at_", "left").withColumn("hot_", F.coalesce("hot_", "rest_")).where(F.col("hot_").isNotNull())
    return found.select(*rows.columns, *[F.col(f"hot_.{c}").alias(c) for c in values])
