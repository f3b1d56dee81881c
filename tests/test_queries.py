"""Every query gives the rows of its SQL."""

import pytest

from atomweave.plans.catalog import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(name, spark, data, same_rows):
    same_rows(QUERIES[name](spark, data), ORACLES[name], data)


def test_entry_runs(spark):
    import __spark_entry__

    found = __spark_entry__.entry(spark)
    assert found.count() > 0
    assert found.columns == ["keeper_id", "loser_id", "source_pass"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_dedup_invariants(spark, data):
    from atomweave.operators.leaf import leaves

    made = {r["doc_id"]: r["created_at_ms"] for r in leaves(spark, data).select("doc_id", "created_at_ms").collect()}
    found = [(r["keeper_id"], r["loser_id"]) for r in QUERIES["dedupe_pairs"](spark, data).collect()]
    losers = [b for _, b in found]
    assert len(losers) == len(set(losers)) and not set(losers) & {a for a, _ in found}
    assert all((-made[a], a) < (-made[b], b) for a, b in found)


def test_redaction_of_documents_is_idempotent(spark, data):
    from pyspark.sql import functions as F

    from atomweave.functions.text import redacted

    once = spark.read.parquet(f"{data}/documents.parquet").select(redacted(F.col("text")).alias("t"))
    assert once.where(redacted(F.col("t")) != F.col("t")).count() == 0


def test_scans_are_pruned_and_filters_pushed(spark, data):
    plan = QUERIES["metadata_filter"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(source,src6)" in plan and "text" not in plan.split("ReadSchema")[1]
