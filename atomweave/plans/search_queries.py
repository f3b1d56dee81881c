"""Queries on filters and scored retrieval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import leaf, retrieve, vectors
from ..operators.keywords import KeywordIndex
from ..operators.leaf import leaves, table
from ..schema import CHUNK_OVERLAP, CHUNK_SEPARATOR, CHUNK_WORDS, CROSS_REFERENCES, LESSON, PROMOTION_CANDIDATES, RECALL_RESULTS, SEARCH_RESULTS
from ..session import checkpointed, scratch_folder
from .base import LEAF, query

#: Scores of the test vectors seldom reach the defaults, so queries on them ask for less.
LOW_SCORE = 0.1

VEC = "v AS (SELECT CAST(vec_id AS VARCHAR) AS doc_id, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)"
COS = "greatest(0, least(1, list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b})))))"
KEYWORD = f"""terms AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT CAST(doc_id AS VARCHAR) AS doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents) GROUP BY 1, 2),
idf AS (SELECT term, ln(((SELECT count(*) FROM documents) + 1.0) / (count(*) + 1)) + 1 AS idf FROM terms GROUP BY 1),
dw AS (SELECT doc_id, term, tf * idf AS w FROM terms JOIN idf USING (term)),
dn AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM dw GROUP BY 1),
asked AS (SELECT query_id, term, count(*) AS tf FROM (SELECT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM benchmark) GROUP BY 1, 2),
qw AS (SELECT query_id, term, tf * idf AS w FROM asked JOIN idf USING (term)),
qn AS (SELECT query_id, sqrt(sum(w * w)) AS norm FROM qw GROUP BY 1),
kw AS (SELECT qw.query_id, dw.doc_id, round(greatest(0, least(1, sum(qw.w * dw.w) / (any_value(qn.norm) * any_value(dn.norm)))), 6) AS keyword
       FROM qw JOIN dw USING (term) JOIN qn ON qn.query_id = qw.query_id JOIN dn ON dn.doc_id = dw.doc_id GROUP BY 1, 2)"""
BLEND = f"""{VEC}, {KEYWORD},
vs AS (SELECT q.vec_id AS query_id, c.doc_id, round({COS.format(a="q.e", b="c.e")}, 6) AS vector FROM v q JOIN benchmark ON item_id = q.vec_id JOIN v c ON c.vec_id IN (SELECT doc_id FROM documents)),
blend AS (SELECT coalesce(vs.query_id, kw.query_id) AS query_id, coalesce(vs.doc_id, kw.doc_id) AS doc_id, round(0.7 * coalesce(vector, 0) + 0.3 * coalesce(keyword, 0), 7) AS score
          FROM vs FULL JOIN kw ON kw.query_id = vs.query_id AND kw.doc_id = vs.doc_id)"""


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("doc_id"), "vec_id", "embedding")


def bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaves(spark, sf_dir).select("doc_id", "body")


def asked_vectors(known: DataFrame) -> DataFrame:
    """The stated set of queries: the vectors whose number 100 divides."""
    return known.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))


def queried(spark: SparkSession, sf_dir: str, k: int, chosen: Column | None = None, *within: str) -> DataFrame:
    """Leaves with the likeness of their vector to that of each query, the ``k`` best of each group of ``within``."""
    known = embedded(spark, sf_dir)
    docs = leaves(spark, sf_dir).drop("body")
    docs = (docs if chosen is None else docs.where(chosen)).join(known.select("doc_id", "embedding"), "doc_id")
    return retrieve.scores(docs.select("doc_id", "embedding", *within), asked_vectors(known), k, "vector", within=within)


#: Leaves with their likeness to each query.
EACH = f"{LEAF}, {VEC}, each AS (SELECT q.vec_id AS query_id, l.*, round({COS.format(a='q.e', b='v.e')}, 6) AS score FROM leaf l JOIN v ON v.doc_id = l.doc_id JOIN v q ON q.vec_id % 100 = 0)"


@query(f"WITH {LEAF} SELECT doc_id, name FROM leaf WHERE project_module = 'src6' AND language = 'en' AND tags LIKE '%en,src%'")
def metadata_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    filters, _ = leaf.with_default_module({"language": " en ", "tags": "en,src", "task_type": " "}, "src6", always=False)
    return leaves(spark, sf_dir).where(leaf.condition(filters)).select("doc_id", "name")


@query(f"WITH {LEAF} SELECT doc_id, name, slot FROM leaf WHERE name LIKE '%src1%' AND enabled")
def list_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaf.listed(leaves(spark, sf_dir), "src1", True).select("doc_id", "name", "slot")


@query(f"""WITH {KEYWORD} SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, doc_id, keyword AS score FROM kw
WINDOW w AS (PARTITION BY query_id ORDER BY keyword DESC, doc_id) QUALIFY row_number() OVER w <= {SEARCH_RESULTS}""")
def keyword_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, asked = retrieve.with_terms(bodies(spark, sf_dir), questions(spark, sf_dir))
    counted = bodies(spark, sf_dir).select("doc_id"), questions(spark, sf_dir).select("query_id")
    return retrieve.best(retrieve.scores(docs, asked, SEARCH_RESULTS, "keyword", counted=counted), ["query_id"], SEARCH_RESULTS).select("query_id", "rank", "doc_id", "score")


@query(f"""WITH {KEYWORD} SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, doc_id, keyword AS score FROM kw
WINDOW w AS (PARTITION BY query_id ORDER BY keyword DESC, doc_id) QUALIFY row_number() OVER w <= {SEARCH_RESULTS}""")
def keyword_index_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As keyword_topk, from a stored index with bounds for blocks of documents of one language."""
    with scratch_folder(spark) as folder:
        index = KeywordIndex(spark, f"{folder}/words", folders=32)
        index.build(leaves(spark, sf_dir), "language")
        return checkpointed(index.search(questions(spark, sf_dir), SEARCH_RESULTS)[0])


@query(f"""WITH {VEC}, s AS (SELECT q.vec_id AS query_id, c.doc_id, round({COS.format(a="q.e", b="c.e")}, 6) AS score FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, doc_id, score FROM s WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, doc_id) QUALIFY row_number() OVER w <= {SEARCH_RESULTS}""")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = embedded(spark, sf_dir)
    scored = retrieve.scores(known.select("doc_id", "embedding"), asked_vectors(known), SEARCH_RESULTS, "vector", own=False)
    return retrieve.best(scored, ["query_id"], SEARCH_RESULTS).select("query_id", "rank", "doc_id", "score")


@query("SELECT count(*) AS queries, true AS nine_tenths_found FROM embeddings WHERE vec_id % 100 = 0")
def vector_index_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a search of as many lists as the sample needed finds nine tenths of what an exact one finds, over all queries."""
    known = embedded(spark, sf_dir)
    with scratch_folder(spark) as folder:
        index = vectors.VectorIndex(spark, f"{folder}/vectors")
        index.build(known.select("doc_id", "embedding"), "first")
        found = index.search(asked_vectors(known), SEARCH_RESULTS)
        told = vectors.recall(found, vector_topk(spark, sf_dir))
        return checkpointed(told.select("queries", (F.col("recall") >= 0.9).alias("nine_tenths_found")))


@query(f"""WITH {BLEND} SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, doc_id, score FROM blend
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, doc_id) QUALIFY row_number() OVER w <= {SEARCH_RESULTS}""")
def hybrid_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items against all documents; an item's vector has its number. What lacks one of the scores has 0 for it."""
    docs, asked = retrieve.with_terms(bodies(spark, sf_dir), questions(spark, sf_dir))
    known = embedded(spark, sf_dir)
    docs = docs.join(known.select("doc_id", "embedding"), "doc_id", "left")
    asked = asked.join(known.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector")), "query_id", "left")
    counted = bodies(spark, sf_dir).select("doc_id"), questions(spark, sf_dir).select("query_id")
    return retrieve.best(retrieve.scores(docs, asked, SEARCH_RESULTS, "hybrid", counted=counted), ["query_id"], SEARCH_RESULTS).select("query_id", "rank", "doc_id", "score")


@query(f"""WITH {EACH}, f AS (SELECT * FROM each WHERE score >= {LOW_SCORE} QUALIFY row_number() OVER (PARTITION BY query_id, slot ORDER BY score DESC, doc_id) <= {SEARCH_RESULTS})
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, slot, doc_id, score, count(*) OVER (PARTITION BY query_id) AS total FROM f
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, doc_id) QUALIFY row_number() OVER w <= {SEARCH_RESULTS}""")
def multi_slot_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieve.search(queried(spark, sf_dir, SEARCH_RESULTS, None, "slot"), SEARCH_RESULTS, LOW_SCORE, ("query_id",))


LESSON_FILTERS = {"atom_type": LESSON, "project_module": "src6", "error_pattern": "ep-0", "language": "en", "task_type": "planning"}
_BASE = "atom_type = 'self-improvement-lesson' AND project_module = 'src6'"


@query(f"""WITH {EACH}, m AS (
  SELECT query_id, doc_id, score, unnest(list_filter([CASE WHEN {_BASE} AND error_pattern = 'ep-0' AND language = 'en' AND task_type = 'planning' THEN 0 END, CASE WHEN {_BASE} AND language = 'en' AND task_type = 'planning' THEN 1 END,
    CASE WHEN {_BASE} AND task_type = 'planning' THEN 2 END, CASE WHEN {_BASE} THEN 3 END], lambda x: x IS NOT NULL)) AS rung FROM each WHERE score >= 0.0),
t AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY query_id, rung ORDER BY score DESC, doc_id) <= {RECALL_RESULTS}),
h AS (SELECT query_id, doc_id, min(rung) AS rung, any_value(score) AS score FROM t GROUP BY 1, 2),
c AS (SELECT r.query_id, r.rung, count(*) AS n FROM (SELECT DISTINCT query_id, rung FROM h) r JOIN h ON h.query_id = r.query_id AND h.rung <= r.rung GROUP BY 1, 2),
l AS (SELECT query_id, coalesce(min(rung) FILTER (n >= 3), 9) AS last FROM c GROUP BY 1)
SELECT h.query_id, rung, doc_id, score FROM h JOIN l ON l.query_id = h.query_id WHERE rung <= last QUALIFY row_number() OVER (PARTITION BY h.query_id ORDER BY rung, score DESC, doc_id) <= {RECALL_RESULTS}""")
def recall_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = leaf.condition({k: LESSON_FILTERS[k] for k in ("atom_type", "project_module")})
    # in each group of what the rungs tell apart the best are enough
    scored = queried(spark, sf_dir, RECALL_RESULTS, wide, "atom_type", "project_module", "error_pattern", "language", "task_type")
    return retrieve.ladder(scored, LESSON_FILTERS, RECALL_RESULTS, 0.0, ("query_id",))


@query(f"""WITH {EACH} SELECT query_id, atom_type, doc_id, score FROM each WHERE atom_type IN ('bug-root-cause', 'feedback-rule') AND project_module = 'src1' AND score >= 0.0
QUALIFY row_number() OVER (PARTITION BY query_id, atom_type ORDER BY score DESC, doc_id) = 1""")
def knowledge_xref(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = F.col("atom_type").isin(*CROSS_REFERENCES) & (F.col("project_module") == "src1")
    return retrieve.cross_references(queried(spark, sf_dir, 1, chosen, "atom_type", "project_module"), CROSS_REFERENCES, "src1", 0.0, ("query_id",))


@query(f"""WITH {LEAF}, {VEC}, x AS (SELECT l.*, v.e FROM leaf l JOIN v ON v.doc_id = l.doc_id),
s AS (SELECT a.doc_id AS atom_id, b.doc_id, round({COS.format(a="a.e", b="b.e")}, 6) AS score FROM x a JOIN x b ON a.atom_type = b.atom_type AND (a.project_module IS NULL OR a.project_module = b.project_module) AND (a.error_pattern IS NULL OR a.error_pattern = b.error_pattern) AND (a.n % 30 = 0 OR a.language = b.language) AND a.n <> b.n WHERE a.n % 10 = 0)
SELECT atom_id, CAST(row_number() OVER w AS INTEGER) AS rank, doc_id, score FROM s WINDOW w AS (PARTITION BY atom_id ORDER BY score DESC, doc_id) QUALIFY row_number() OVER w <= {PROMOTION_CANDIDATES}""")
def promotion_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of the type of each atom, and of the module, language and error pattern that it has; every third atom has no language."""
    optional = ("project_module", "language", "error_pattern")
    known = leaves(spark, sf_dir).select("doc_id", "n", "atom_type", *optional).join(embedded(spark, sf_dir).select("doc_id", "embedding"), "doc_id")
    atoms = known.where("n % 10 = 0").withColumn("language", F.when(F.col("n") % 30 != 0, F.col("language")))
    asked = atoms.select("atom_type", *optional, F.col("doc_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    docs, asked, keys = retrieve.with_patterns(known.drop("n"), asked, ("atom_type",), optional)
    scored = retrieve.scores(docs.select("doc_id", "embedding", *keys), asked.select("query_id", "query_vector", *keys), PROMOTION_CANDIDATES, "vector", keys=keys, own=False).withColumnRenamed("query_id", "atom_id")
    return retrieve.best(scored, ["atom_id"], PROMOTION_CANDIDATES).select("atom_id", "rank", "doc_id", "score")


@query(f"""WITH {LEAF}, p AS (SELECT doc_id, unnest(string_split(body, chr(10) || chr(10) || '### ')) AS piece, generate_subscripts(string_split(body, chr(10) || chr(10) || '### '), 1) - 1 AS part FROM leaf),
w AS (SELECT doc_id, part, regexp_extract_all(piece, '\\S+') AS ws FROM p),
c AS (SELECT doc_id, part, ws, unnest(range(0, CAST(greatest(0, ceil((len(ws) - {CHUNK_WORDS}) / {CHUNK_WORDS - CHUNK_OVERLAP}.0)) AS BIGINT) + 1)) AS run FROM w WHERE len(ws) > 0)
SELECT doc_id, part, run, len(ws[run * {CHUNK_WORDS - CHUNK_OVERLAP} + 1:run * {CHUNK_WORDS - CHUNK_OVERLAP} + {CHUNK_WORDS}]) AS n_words,
       sha256(array_to_string(ws[run * {CHUNK_WORDS - CHUNK_OVERLAP} + 1:run * {CHUNK_WORDS - CHUNK_OVERLAP} + {CHUNK_WORDS}], ' ')) AS content_sha FROM c""")
def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = leaf.chunked(leaves(spark, sf_dir).select("doc_id", "body"), CHUNK_WORDS, CHUNK_OVERLAP, CHUNK_SEPARATOR)
    return cut.select("doc_id", "part", "run", "n_words", F.sha2("content", 256).alias("content_sha"))
