"""Duplicates: pairs by hash, by lesson key and by likeness; one retained pair for each loser; the keeper at a chain's end."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..schema import LESSON
from ..session import checkpointed
from .joins import looked_up

PASS_RANK = {"sha256": 0, "lesson-key": 1, "similarity": 2}


def keyed_pairs(docs: DataFrame, key: str, source: str) -> DataFrame:
    """(keeper_id, loser_id, source_pass): in each group of a key the newest is kept; of equals the smaller id as text.

    The keeper is one aggregate with partial results on the map side, so that a hot key is one small row and not a sorted group; groups of one are gone before
    the lookup, which spreads the documents of hot keys over all tasks."""
    first = F.min(F.struct((-F.col("created_at_ms")).alias("age"), "doc_id"))
    keepers = docs.groupBy(key).agg(first.alias("first"), F.count("*").alias("members")).where("members > 1").select(key, "members", F.col("first.doc_id").alias("keeper_id"))
    found = looked_up(docs.select(key, F.col("doc_id").alias("loser_id")), checkpointed(keepers), key, "members", F.xxhash64("loser_id"))
    return found.where("loser_id <> keeper_id").select("keeper_id", "loser_id", F.lit(source).alias("source_pass"))


def sha256_pairs(leaves: DataFrame) -> DataFrame:
    """Pairs of documents with one body; a null body pairs with nothing."""
    return keyed_pairs(leaves.where(F.col("body").isNotNull()).withColumn("key", X.content_hash(F.col("body"))), "key", "sha256")


def lesson_key_pairs(leaves: DataFrame) -> DataFrame:
    """Pairs of enabled lessons with one key."""
    keyed = leaves.where((F.col("atom_type") == LESSON) & F.coalesce("enabled", F.lit(True)))
    keyed = keyed.withColumn("key", X.lesson_key(F.col("project_module"), F.col("task_type"), F.col("error_pattern"))).where("key <> ''")
    return keyed_pairs(keyed, "key", "lesson-key")


def retained(pairs: DataFrame) -> DataFrame:
    """For each loser the pair of the best pass, the first by ``scan_idx`` among equals."""
    best = F.min_by(F.struct("keeper_id", "source_pass"), F.struct("pass_rank", "scan_idx"))
    return pairs.groupBy("loser_id").agg(best.alias("b")).select("loser_id", "b.keeper_id", "b.source_pass")


def with_rank(pairs: DataFrame) -> DataFrame:
    rank = F.lit(len(PASS_RANK))
    for name, value in PASS_RANK.items():
        rank = F.when(F.col("source_pass") == name, value).otherwise(rank)
    return pairs.withColumn("pass_rank", rank)


def ultimate_keepers(pairs: DataFrame) -> DataFrame:
    """Retained pairs, re-pointed to the keeper at the end of each loser's chain, by doubling: each turn halves every chain
    that is left. Chains are acyclic, as keepers are newer, or equal and smaller. Pointers are written to the session's
    checkpoint folder each turn, so that plans stay short and a lost executor costs one turn."""
    now = checkpointed(pairs.select("loser_id", "keeper_id", "source_pass"))
    while True:
        ahead = now.select(F.col("loser_id").alias("keeper_id"), F.col("keeper_id").alias("next"))
        stepped = checkpointed(now.join(ahead, "keeper_id", "left").select("loser_id", F.coalesce("next", "keeper_id").alias("keeper_id"), "source_pass", F.col("next").isNotNull().alias("moved")))
        now = stepped.drop("moved")
        if not stepped.where("moved").limit(1).count():
            return now


def similarity_pairs(edges: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """(keeper_id, loser_id, source_pass, score): each edge (a, b, score) between class representatives that reaches the score,
    once, and each other member of a class with its representative, which is the newest."""
    reps = classes.where("doc_id = rep")
    side = lambda x: reps.select(F.col("rep").alias(x), F.col("created_at_ms").alias(f"ms_{x}"))
    both = edges.where(F.col("score") >= least).join(side("a"), "a").join(side("b"), "b")
    a_kept = (F.col("ms_a") > F.col("ms_b")) | ((F.col("ms_a") == F.col("ms_b")) & (F.col("a") < F.col("b")))
    across = both.select(F.when(a_kept, F.col("a")).otherwise(F.col("b")).alias("keeper_id"), F.when(a_kept, F.col("b")).otherwise(F.col("a")).alias("loser_id"), "score")
    within = classes.where("doc_id <> rep").select(F.col("rep").alias("keeper_id"), F.col("doc_id").alias("loser_id"), F.lit(1.0).alias("score"))
    return across.unionByName(within).select("keeper_id", "loser_id", F.lit("similarity").alias("source_pass"), "score")


def deterministic(pairs: DataFrame) -> DataFrame:
    """(…, deterministic): hash and key pairs may be archived at once, likeness needs a decision."""
    return pairs.withColumn("deterministic", F.col("source_pass").isin("sha256", "lesson-key"))


def unused(df: DataFrame, consumed: DataFrame, key: str = "doc_id") -> DataFrame:
    return df.join(consumed, key, "left_anti")


def first_in_group(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("rn = 1").drop("rn")
