"""The queries of the thirteen operators, with production parameters over whole tables, and DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpointed
from . import bpe, decontaminate, fim, htmltext, licenses, secrets, setjoin, sharding, tokencount, topk, toxicity, vptree, warc
from .common import cut, scratch, sized, small_batches

N_SHARDS = 24
BYTE_BPE, PIECES = "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return small_batches(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    with scratch(spark) as folder:
        sharding.build_map(docs, N_SHARDS).save(spark, f"{folder}/slot_map")
        slots = sharding.SlotMap.load(spark, f"{folder}/slot_map")  # in the driver, a row for each virtual slot
    placed = sharding.assign(docs, slots)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), public_tokenizers.PATTERN)


def training_row(key: str = "doc_id") -> Column:
    """Rows that may teach: the checksum of the id, as text, leaves a remainder of 1 to 4 by five."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % 5 != 0


def toxicity_machine(spark: SparkSession, docs: DataFrame, sf_dir: str) -> toxicity.Machine:
    return toxicity.fit(docs, table(spark, sf_dir, "labels"), "toxic", training_row())


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity_machine(spark, docs, sf_dir))
    return scored.select("doc_id", (~training_row()).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"))


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    with scratch(spark):
        return checkpointed(setjoin.link_components(table(spark, sf_dir, "documents")))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    with scratch(spark):
        found = decontaminate.find_overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
        return checkpointed(decontaminate.digests(found))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    names = F.transform("found", lambda x: x["license"])
    return found.select("doc_id", F.size("found").cast("long").alias("n_licenses"), F.array_join(names, ",").alias("licenses"), F.to_json("found").alias("evidence"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return htmltext.extract(pages, htmltext.fit(pages))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digests(fim.transform(table(spark, sf_dir, "documents")))


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vptree.cluster(table(spark, sf_dir, "embeddings"))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    with scratch(spark) as folder:
        warc.write_archives(pages, f"{folder}/archives")
        return checkpointed(warc.digests(warc.read_records(spark, f"{folder}/archives", payloads=False), pages))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_sharding, op2_byte_bpe, op3_toxicity, op4_exact_topk, op5_ngram_jaccard, op6_token_counts, op7_secrets, op8_decontaminate, op9_licenses, op10_html_text, op11_fill_in_middle, op12_centroid_clusters, op13_warc)}
LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_INNER = "list_sum(list_transform(range(1, 65), lambda i: (x[i] - y[i]) * (x[i] - y[i])))"


def cluster_sql(rounds: int) -> str:
    """Rounds one after the other, each over all pairs of vectors and centroids."""
    nearest = "n{r} AS (SELECT vec_id, x, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT vec_id, row, x, c, {inner} AS d FROM v, c{r}) GROUP BY vec_id, row, x)"
    steps = [nearest.format(r=0, inner=_INNER)]
    for r in range(rounds):
        steps.append(f"""m{r} AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY pos) AS y FROM (SELECT c, pos, sum(e) AS s, count(*) AS n FROM (SELECT c, unnest(x) AS e, generate_subscripts(x, 1) AS pos FROM n{r}) GROUP BY 1, 2) GROUP BY 1),
c{r + 1} AS (SELECT c{r}.c, coalesce(CAST(m{r}.y AS BIGINT[]), c{r}.y) AS y FROM c{r} LEFT JOIN m{r} ON m{r}.c = c{r}.c)""")
        steps.append(nearest.format(r=r + 1, inner=_INNER))
    return f"""
WITH v AS (SELECT vec_id, row_number() OVER () AS row, CAST(list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS BIGINT[]) AS x FROM embeddings
           WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS (SELECT row_number() OVER (ORDER BY h, x) - 1 AS c, x AS y FROM (SELECT sha256('1:' || CAST(vec_id AS VARCHAR)) AS h, x FROM v ORDER BY h, x LIMIT 16)),
{", ".join(steps)}
SELECT vec_id, CAST(n{rounds}.c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY n{rounds}.c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(y, ',')) AS centroid_sha256 FROM n{rounds} JOIN c{rounds} ON c{rounds}.c = n{rounds}.c
"""


ORACLES: dict[str, str] = {
    "op4_exact_topk": """
WITH v AS (SELECT vec_id, CAST(list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS DOUBLE[]) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10
""",
    "op5_ngram_jaccard": rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({LOWER}, '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN ws IS NULL OR len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
             ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS sh FROM w),
n AS (SELECT doc_id, CAST(len(sh) AS BIGINT) AS n FROM s),
t AS (SELECT doc_id, unnest(sh) AS g FROM s),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM t a JOIN t b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 75 * (nx.n + ny.n - c)),
both_ways AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM n UNION SELECT b.y, r.c FROM r JOIN both_ways b ON r.doc_id = b.x)
SELECT n.doc_id, n.n AS n_shingles, min(r.c) AS component_id FROM n JOIN r ON r.doc_id = n.doc_id GROUP BY 1, 2
""",
    "op8_decontaminate": rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
bw AS (SELECT DISTINCT item_id, CASE WHEN len(ws) < 10 THEN len(ws) ELSE 10 END AS size,
              unnest(CASE WHEN len(ws) < 10 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 8), lambda i: array_to_string(ws[i:i + 9], ' ')) END) AS g
       FROM b WHERE len(ws) > 0),
sizes AS (SELECT DISTINCT size FROM bw),
dw AS (SELECT doc_id, size, unnest(range(1, len(ws) - size + 2)) AS pos, unnest(list_transform(range(1, len(ws) - size + 2), lambda i: array_to_string(ws[i:i + size - 1], ' '))) AS g
       FROM d, sizes WHERE len(ws) >= size),
o AS (SELECT dw.doc_id, dw.pos, dw.size, bw.item_id FROM dw JOIN bw ON dw.g = bw.g AND dw.size = bw.size),
h AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + size)) AS k FROM o) GROUP BY 1),
i AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS items FROM o GROUP BY 1)
SELECT d.doc_id, CAST(coalesce(len(ws), 0) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON h.doc_id = d.doc_id LEFT JOIN i ON i.doc_id = d.doc_id
""",
    "op11_fill_in_middle": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || CAST(doc_id AS VARCHAR)) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS us, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
c AS (SELECT *, CAST(len(us) AS BIGINT) AS n, least(h1 % (len(us) + 1), h2 % (len(us) + 1)) AS a, greatest(h1 % (len(us) + 1), h2 % (len(us) + 1)) AS b FROM u),
f AS (SELECT *, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form,
             array_to_string(us[1:a], '') AS p, array_to_string(us[a + 1:b], '') AS m, array_to_string(us[b + 1:n], '') AS s FROM c),
o AS (SELECT *, CASE form WHEN 'plain' THEN t WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE '<P>' || p || '<S>' || s || '<M>' || m END AS output FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(output) AS output_sha256, sha256(t) AS restored_sha256 FROM o
""",
    "op12_centroid_clusters": cluster_sql(3),
    "op13_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY t) AS first FROM p)
SELECT page_id, CAST(strlen(t) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[((CAST('0x' || h[5 * (i // 4) + 1:5 * (i // 4) + 5] AS BIGINT) >> (15 - 5 * (i % 4))) & 31) + 1]), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM f
""",
}


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below one half."""
    small_batches(spark)
    return toxicity.keep_clean(docs, toxicity_machine(spark, docs, sf_dir))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked or equal documents, the one with the smallest id. Rows that repeat an id and text leave one, whatever their other
    columns; documents without words, and rows without an id, stay."""
    small_batches(spark)
    found = setjoin.link_components(docs).where((F.col("doc_id") != F.col("component_id")) & (F.col("n_shingles") > 0)).select("doc_id").distinct()
    found = cut(found, "copies")
    kept = docs.join(sized(found, found.count()), "doc_id", "left_anti").select(*docs.columns)
    several = docs.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    several = cut(several, "repeated")
    n = several.count()
    return first_of_repeats(kept, sized(several, n)) if n else kept


def first_of_repeats(docs: DataFrame, several: DataFrame) -> DataFrame:
    """One row for each id and text of the ids in ``several``: the first by the text form of all columns; other rows as they are. Rows are put together
    where they are read, before they are shuffled, so a row that repeats often costs little."""
    again = docs.join(several, "doc_id", "left_semi")
    other = docs.join(several, "doc_id", "left_anti").select(*docs.columns)
    whole = F.struct(*[F.col(c) for c in docs.columns])
    form = F.sha2(F.to_json(F.struct(*[F.col(c).cast("string").alias(f"c{k}") for k, c in enumerate(docs.columns)])), 256)
    first = again.groupBy("doc_id", F.sha2(F.coalesce("text", F.lit("\0")), 256).alias("text_")).agg(F.min_by(whole, form).alias("row_"))
    return other.unionByName(first.select("row_.*"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a test item occurs."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced in their texts and lengths, where there is a column of them, brought up to date."""
    out = secrets.redact(docs)
    if "n_chars" not in docs.columns:
        return out.select(*docs.columns)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left."""
    small_batches(spark)
    return bpe.encode_documents(docs, public_tokenizers.path(BYTE_BPE), public_tokenizers.PATTERN)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", keep_one_of_each_group),
    ("decontaminate", drop_contaminated),
    ("secrets", redact_secrets),
    ("byte_bpe", encode),
]
