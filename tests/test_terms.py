"""Words counted where documents stand, and keyword scores over blocks."""

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from atomweave.operators import retrieve, terms

TEXTS = {"a": "Apple pear pear, fig-7 apple", "b": "apple apple kiwi", "c": None, "d": "... !", "e": "PEAR fig lime lime lime", "f": "apple plum 7 É", "g": "apple fig K"}


@pytest.mark.parametrize("hot", [2, 100])
def test_weights_and_norms_are_those_of_all_words(spark, monkeypatch, hot):
    monkeypatch.setattr(terms, "HOT_TERMS", hot)
    docs = spark.createDataFrame([*TEXTS.items()], "doc_id string, body string").withColumn("mark", F.concat("doc_id", F.lit("!")))
    queries = spark.createDataFrame([("q", "pear lime unknown"), ("r", "apple"), ("s", "")], "query_id string, query string")
    found, asked = retrieve.with_terms(docs, queries)
    counts = {k: Counter(re.findall("[a-z0-9]+", (t or "").lower())) for k, t in TEXTS.items()}
    df = Counter(w for c in counts.values() for w in c)
    idf = {w: math.log((len(TEXTS) + 1) / (n + 1)) + 1 for w, n in df.items()}
    rows = {r["doc_id"]: r for r in found.collect()}
    assert set(rows) == set(TEXTS)
    for k, c in counts.items():
        norm = math.sqrt(sum((n * idf[w]) ** 2 for w, n in c.items()))
        assert rows[k]["mark"] == k + "!" and (rows[k]["norm"] == pytest.approx(norm) if c else rows[k]["norm"] is None)
        assert dict(zip(rows[k]["terms"], rows[k]["weights"], strict=True)) == pytest.approx({w: n * idf[w] for w, n in c.items() if w in ("pear", "lime", "apple")})
    mine = {r["query_id"]: r for r in asked.collect()}
    assert mine["q"]["norm"] == pytest.approx(math.hypot(idf["pear"], idf["lime"])) and mine["s"]["norm"] is None


def test_common_words_are_not_shuffled_by_document(spark, tmp_path):
    """Rows that exchanges write are the words of all documents, put together by task, and not those of each document."""
    docs = spark.range(400).select(F.col("id").cast("string").alias("doc_id"), F.concat_ws(" ", *[F.lit(f"w{k}") for k in range(50)]).alias("body")).coalesce(2)
    queries = spark.createDataFrame([("q", "w1 w2")], "query_id string, query string")
    found, _ = retrieve.with_terms(docs, queries)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == 400 and "Exchange" not in plan and "w1" in found.first()["terms"]


def test_index_hands_on_the_best_of_each_block_alone(spark, tmp_path):
    """Lists go on over batches of rows; what a block gives to a query are k rows at most, with ties by id."""
    from atomweave.operators.keywords import KeywordIndex

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        docs = spark.createDataFrame([(f"d{k:03d}", f"common w{k % 5} " + "x " * (k % 3)) for k in range(90)], "doc_id string, body string")
        queries = spark.createDataFrame([("q", "common"), ("r", "w1 x"), ("s", "none")], "query_id string, query string")
        index = KeywordIndex(spark, str(tmp_path / "words"), folders=3)
        index.build(docs, block_docs=30)
        asked = index.asked(queries).cache()
        _, postings = index.tables(asked)
        assert postings.where("term in ('common', 'w1', 'x')").selectExpr("sum(size(ids)) as n", "count(distinct term, block) = count(*) as once").first()[:] == (168, True)
        blocks = asked.join(postings, "term").select("query_id", "block").distinct()
        given = index._scored(asked, blocks, postings, 4)
        assert given.groupBy("query_id").count().where("count > 12").count() == 0
        docs_terms, asked_terms = retrieve.with_terms(docs, queries)
        want = retrieve.best(retrieve.scores(docs_terms, asked_terms, 4, "keyword"), ["query_id"], 4).select("query_id", "rank", "doc_id", "score")
        assert sorted(map(tuple, index.search(queries, 4)[0].collect())) == sorted(map(tuple, want.collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_index_shuffles_a_document_once_and_packs_its_lists(spark, tmp_path):
    """Exchanges get a row for each document, and for each block and folder of words, not one for each document and word; lists that nobody asks for aren't shuffled."""
    from atomweave.operators.keywords import KeywordIndex, counted, lists_of

    turn = [f"w{k}" for k in range(40)]
    docs = spark.createDataFrame([(f"d{k:03d}", None if k == 7 else " ".join(turn[k % 7 :] + ["w39"] * (k % 3))) for k in range(60)], "doc_id string, body string")
    assert counted(docs.withColumn("group_", F.lit(""))).count() == 60
    index = KeywordIndex(spark, str(tmp_path / "words"), folders=3)
    index.build(docs, block_docs=20)
    stored = spark.read.parquet(str(tmp_path / "words" / "first" / "postings"))
    held = spark.read.parquet(str(tmp_path / "words" / "first" / "docs"))
    assert stored.count() <= held.count() * 3 and held.selectExpr("sum(size(names))").first()[0] == 59 and sum(len(r["names"]) for r in held.collect()) == 59
    assert all(r["names"] == sorted(r["names"]) for r in held.collect())
    asked = index.asked(spark.createDataFrame([("q", "w39 w0 nowhere")], "query_id string, query string"))
    _, lists = index.tables(asked)
    counts = {(r["term"], n) for r in lists.where("term in ('w39', 'w0')").groupBy("term").agg(F.sum(F.size("ids")).alias("n")).collect() for n in [r["n"]]}
    assert counts == {("w39", 59), ("w0", 8)}
    plan = index._of_words(lists, asked)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning(term" not in plan.split("BroadcastExchange")[0]
    many = lists_of(*[t.toArrow() for t in (spark.createDataFrame([("a", "x", bytearray(b"\x01\0\0\0"))], "doc_id string, words string, tfs binary"), spark.createDataFrame([(0, ["a"], [1.0])], "block long, names array<string>, norms array<double>"))], 3)
    assert many.num_rows == 1 and many.column("terms")[0].as_py() == "x"


def test_a_version_is_put_back_without_writing_rows(spark, tmp_path):
    from atomweave.operators import store

    shelf = store.Snapshots(spark, str(tmp_path / "shelf"))
    shelf.commit(spark.range(3))
    shelf.commit(spark.range(5))
    assert shelf.put_back(1, {"x": 2}) == 3 and shelf.read().count() == 3 and shelf.told() == {"x": 2}
    assert len(list((tmp_path / "shelf").glob("data-*"))) == 2
    assert shelf.keep_last(1) == [2] and shelf.read().count() == 3
