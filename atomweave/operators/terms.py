"""Words of documents with their TF-IDF weights and norms, counted where the documents stand.

A document's words are counted in its own row, so no table of documents by words is shuffled. Of the table of all words, HOT_TERMS with the most documents go to
all tasks; they are nearly all words of any text. What a document has of others, its rare words, meets the table by a join."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of which all tasks know the weight, at most: this bounds a broadcast and changes the cost alone; words that a task counts before it hands them on.
HOT_TERMS, HELD_TERMS = 200_000, 500_000
WORD = re.compile("[a-z0-9]+")


def document_counts(docs: DataFrame) -> DataFrame:
    """(term, df) of all words of bodies; tasks hand on what they counted together."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        batch_of = lambda: pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["term", "df"])
        for batch in batches:
            for text in batch.column(0).to_pylist():
                held.update(set(WORD.findall(text)))
                if len(held) > HELD_TERMS:
                    yield batch_of()
                    held.clear()
        if held:
            yield batch_of()

    return docs.select(lowered()).mapInArrow(run, "term string, df long").groupBy("term").agg(F.sum("df").alias("df"))


def lowered() -> Column:
    return F.lower(F.coalesce("body", F.lit(""))).alias("body")


def weighted(docs: DataFrame, known: DataFrame, asked_alone: bool = False) -> DataFrame:
    """``docs`` (doc_id, body, …) without bodies, with (terms, weights, norm) by ``known`` (term, df, idf), which has all their words and should be stored;
    with ``asked_alone`` of the words those alone that are ``asked`` there. The norm is that of all words, null without any."""
    asked = F.col("asked").isNotNull() if asked_alone else F.lit(True)
    table = known.select("term", "df", "idf", asked.alias("listed"))
    top = table.orderBy(F.desc("df"), "term").limit(HOT_TERMS).toArrow()
    hot = dict(zip(top.column("term").to_pylist(), zip(top.column("idf").to_pylist(), top.column("listed").to_pylist(), strict=True), strict=True))
    others = [f for f in docs.schema.fields if f.name != "body"]
    names = [f.name for f in others]
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def common(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms, weights, squares = [], [], []
            for text in batch.column("body").to_pylist():
                mine, w, square = [], [], 0.0
                for term, tf in Counter(WORD.findall(text)).items():
                    found = hot.get(term)
                    if found is not None:
                        x = tf * found[0]
                        square += x * x
                        if found[1]:
                            mine.append(term)
                            w.append(x)
                terms.append(mine)
                weights.append(w)
                squares.append(square)
            yield pa.RecordBatch.from_arrays([*(batch.column(name) for name in names), pa.array(terms, pa.list_(pa.string())), pa.array(weights, pa.list_(pa.float64())), pa.array(squares, pa.float64())], names=[*names, "terms", "weights", "square"])

    def rare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, terms, tfs = [], [], []
            for k, text in enumerate(batch.column("body").to_pylist()):
                for term, tf in Counter(WORD.findall(text)).items():
                    if term not in hot:
                        at.append(k)
                        terms.append(term)
                        tfs.append(tf)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(at, pa.int64())), pa.array(terms, pa.string()), pa.array(tfs, pa.int64())], names=["doc_id", "term", "tf"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in others)
    first = docs.select(*names, lowered()).mapInArrow(common, f"{fields}, terms array<string>, weights array<double>, square double")
    if top.num_rows == HOT_TERMS:
        left = docs.select("doc_id", lowered()).mapInArrow(rare, f"doc_id {id_type}, term string, tf long").join(table.drop("df"), "term").withColumn("w", F.col("tf") * F.col("idf"))
        # the rare words of one document
        of = F.collect_list(F.when(F.col("listed"), F.struct("term", "w")))
        left = left.groupBy("doc_id").agg(F.sum(F.col("w") * F.col("w")).alias("more"), of.alias("of"))
        first = first.join(left, "doc_id", "left").withColumn("square", F.col("square") + F.coalesce("more", F.lit(0.0)))
        joined = lambda name, part: F.when(F.col("of").isNull(), F.col(name)).otherwise(F.concat(name, F.col(f"of.{part}"))).alias(name)
        first = first.select(*names, joined("terms", "term"), joined("weights", "w"), "square")
    return first.select(*names, "terms", "weights", F.when(F.col("square") > 0, F.sqrt("square")).alias("norm"))
