"""Searches through indexes that are written first, over whole tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import text_tokens
from ..operators import bodies as bodies_of
from ..operators import chunks, inverted, vector_index
from ..sources import embedding
from ..sources.catalog import update_vectors
from ..sources.staging import scratch
from ..sources.upsert import upsert
from ..streaming import progress
from .queries import WORDS, query, read

#: Cells of the vector index, and how many of them a search looks into: two thirds, since the test tables' vectors point anywhere; vectors with a structure need a few.
CELLS, PROBES = 64, 42


@query("""WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}\\p{M}_]+') AS t FROM documents),
w AS (SELECT doc_id, unnest(t) AS word, generate_subscripts(t, 1) AS i FROM t),
h AS (SELECT *, max(i) FILTER (WHERE word = 'the') OVER p AS a, max(i) FILTER (WHERE word = 'and') OVER p AS b, max(i) FILTER (WHERE word = 'that') OVER p AS c FROM w WHERE word IN ('the', 'and', 'that') WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
s AS (SELECT doc_id, i, least(a, b, c) AS begin, lag(least(a, b, c)) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM h WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL),
r AS (SELECT doc_id, sum(0.1::DOUBLE / (i - begin + 1)) AS score FROM s WHERE before IS NULL OR begin > before GROUP BY 1),
n AS (SELECT doc_id, count(*)::INT AS n_hits FROM h GROUP BY 1)
SELECT doc_id, round(score, 6) AS score, n_hits FROM (SELECT r.*, n.n_hits FROM r JOIN n USING (doc_id) ORDER BY round(score, 9) DESC, doc_id LIMIT 25)""")
def lexical_index_topk(spark, d):
    """The words' documents by cover density, from postings in ranges of words."""
    path = scratch(spark, "postings")
    inverted.build(read(spark, d, "documents"), "doc_id", "text", path)
    return inverted.ranked(spark, path, WORDS, 25).select(F.col("item").alias("doc_id"), F.round("score", 6).alias("score"), "n_hits")


@query(None)
def vector_index_topk(spark, d):
    """Each vector whose id is divisible by 20 against all, in the nearest cells; recall is measured in the tests."""
    path, e = scratch(spark, "cells"), read(spark, d, "embeddings")
    vector_index.build(e, "vec_id", "embedding", path, CELLS)
    queries = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return vector_index.search(spark, path, queries, 25, PROBES).select("query_id", F.col("item").alias("vec_id"), "distance")


@query("""WITH g AS (SELECT c_mktsegment AS key, list(c_name ORDER BY c_custkey) AS names FROM customer GROUP BY 1),
p AS (SELECT key, list_reduce(names, lambda a, x: CASE WHEN length(string_split(a, chr(1))[-1]) + 3 + length(x) <= 800 - length(key) - 1 THEN a || ' | ' || x ELSE a || chr(1) || x END) AS packed FROM g)
SELECT key, unnest(range(0, len(string_split(packed, chr(1)))))::INT AS chunk_no, unnest(string_split(packed, chr(1))) AS text FROM p""")
def chunk_rows(spark, d):
    """All customers' names as labels of a few keys, packed by running lengths and doubling pointers."""
    c = read(spark, d, "customer").select(F.col("c_mktsegment").alias("key"), "c_custkey", F.col("c_name").alias("label"))
    labels = chunks.unique_rows(c, "key", "c_custkey", "label").withColumn("room", chunks.LENGTH - F.length("key") - 1)
    return chunks.pack_rows(labels, "key", "c_custkey", "label", "room")


@query("""WITH old AS (SELECT 'C' || c_custkey AS ref_id, c_custkey AS stat_id, c_name AS title_ko FROM customer),
new AS (SELECT 'C' || c_custkey AS ref_id, CASE WHEN c_custkey % 3 = 0 THEN c_name || ' x' ELSE c_name END AS title_ko, c_mktsegment AS unit FROM customer UNION ALL SELECT 'S' || s_suppkey, s_name, NULL FROM supplier)
SELECT n.ref_id, coalesce(o.stat_id, (SELECT max(stat_id) FROM old) + row_number() OVER (PARTITION BY o.stat_id IS NULL ORDER BY n.ref_id)) AS stat_id, n.title_ko,
CASE WHEN o.stat_id IS NULL THEN 'inserted' WHEN o.title_ko = n.title_ko THEN 'unchanged' ELSE 'changed' END AS change, o.title_ko = n.title_ko AND o.stat_id IS NOT NULL AS has_vector,
array_to_string(list_sort(list_distinct(regexp_extract_all(lower(concat_ws(' ', n.title_ko, CASE WHEN o.title_ko = n.title_ko THEN NULL ELSE n.unit END)), '[\\p{L}\\p{N}\\p{M}_]+'))), ' ') AS doc
FROM new n LEFT JOIN old o USING (ref_id)""")
def second_load(spark, d):
    """A load over a load, with ids for new rows, and vectors and search words that go with changed text."""
    c, s, none = read(spark, d, "customer"), read(spark, d, "supplier"), F.lit(None).cast("string")
    rest = {k: none for k in ("title_en", "chapter", "section", "level3_title", "level4_title")}
    old = c.select(F.concat(F.lit("C"), "c_custkey").alias("ref_id"), F.col("c_custkey").alias("stat_id"), F.col("c_name").alias("title_ko")).withColumns(rest)
    old = old.withColumns({"unit": none, "embedding": F.array(F.lit(1.0).cast("float")), "embedding_profile_key": F.lit("p"), "search_doc": F.array_sort(F.array_distinct(text_tokens(F.col("title_ko"))))})
    title = F.when(F.col("c_custkey") % 3 == 0, F.concat("c_name", F.lit(" x"))).otherwise(F.col("c_name"))
    new = c.select(F.concat(F.lit("C"), "c_custkey").alias("ref_id"), title.alias("title_ko"), F.col("c_mktsegment").alias("unit")).union(s.select(F.concat(F.lit("S"), "s_suppkey"), "s_name", none)).withColumns(rest)
    out = upsert(old, new, ["ref_id"], "stat_id")
    return out.select("ref_id", "stat_id", "title_ko", "change", F.col("embedding").isNotNull().alias("has_vector"), F.array_join("search_doc", " ").alias("doc"))


@query("""WITH e AS (SELECT user_id::VARCHAR AS job_id, event_id, event_type AS status FROM events), f AS (SELECT *, ntile(3) OVER (ORDER BY event_id) AS part FROM e)
SELECT job_id, max(event_id) AS event_id, arg_max(status, event_id) AS status, count(*) AS n_events, count(*) FILTER (WHERE part > 1) AS n_ignored FROM f GROUP BY 1""")
def job_states(spark, d):
    """The jobs' states after the events came in two batches, the later two thirds of them twice."""
    e = read(spark, d, "events").select("event_id", F.col("user_id").cast("string").alias("job_id"), F.col("event_type").alias("status"), F.lit("").alias("stage"), F.lit(0).alias("progress"), F.lit("").alias("message"), F.col("ts").alias("created_at"))
    edge = e.select(F.expr("count(*)").alias("n")).first()["n"]
    first = -(-edge // 3)
    cut = e.orderBy("event_id").limit(first).agg(F.max("event_id")).first()[0]
    once = progress.merge_states(spark.createDataFrame([], progress.STATES), e.where(F.col("event_id") <= cut))
    later = e.where(F.col("event_id") > cut)
    return progress.merge_states(once, later.union(later)).select("job_id", "event_id", "status", "n_events", "n_ignored")


@query("SELECT c_custkey AS id, length(c_name)::DOUBLE AS first_value, c_nationkey::DOUBLE AS last_value, 'completed' AS status, (SELECT count(*) FROM customer) AS target_count FROM customer")
def embedding_job(spark, d):
    """Vectors for all customers by a job in slices, put in by key; the job's row."""
    path = scratch(spark, "embeddings")
    rows = read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.concat_ws("|", "c_name", "c_nationkey").alias("text"), F.lit(None).cast("array<float>").alias("embedding"), F.lit(None).cast("string").alias("embedding_profile_key"))
    embedding.run_job(rows, _lengths, "p", path, 1)
    made = update_vectors(rows, embedding.vectors(spark, path, 1), ["id"])
    job = embedding.jobs(spark, path).first()
    value = lambda k: F.get("embedding", F.lit(k)).cast("double")
    return made.select("id", value(0).alias("first_value"), value(1).alias("last_value"), F.lit(job["status"]).alias("status"), F.lit(job["target_count"]).alias("target_count"))


def _lengths(texts: list[str]) -> list[list[float]]:
    """A stand-in for a model: the length of a name and the number behind it."""
    return [[float(len(t.split("|")[0])), float(t.split("|")[1])] for t in texts]


@query("""WITH p AS (SELECT p_partkey // 10 AS k, p_size AS v, p_name || ' ' || p_partkey AS label, row_number() OVER (PARTITION BY p_partkey // 10 ORDER BY p_partkey) - 1 AS i, count(*) OVER (PARTITION BY p_partkey // 10) AS n FROM part),
b AS (SELECT k, i, n, v, label, unnest([0, 1, 2]) AS block FROM p), r AS (SELECT k, i + block * (n + 1) AS row_no, block, i, CASE WHEN block = 2 AND k % 3 = 1 THEN '' ELSE label END AS label, v + 2 * block AS v FROM b),
m AS (SELECT k, block * (n + 1) - 1 AS row_no, '구분' AS label, CASE WHEN block = 1 AND k % 3 = 0 THEN '01년' ELSE '0' || (2 * block + 1) || '년' END AS a, '0' || (2 * block + 2) || '년' AS c FROM (SELECT DISTINCT k, n, unnest([1, 2]) AS block FROM p)),
raw AS (SELECT k, row_no, label, v::VARCHAR AS a, (v + 1)::VARCHAR AS c FROM r UNION ALL SELECT * FROM m),
cell AS (SELECT k, row_no, 0 AS col_no, '구분' AS "column", label AS text FROM raw UNION ALL SELECT k, row_no, 1, '01년', a FROM raw UNION ALL SELECT k, row_no, 2, '02년', c FROM raw)
SELECT k, row_no::INT AS row_no, col_no, "column", text, false AS folded FROM cell WHERE k % 3 = 0
UNION ALL SELECT k, i::INT, 0, '구분', label, true FROM p WHERE k % 3 <> 0
UNION ALL SELECT k, i::INT, j + 1, '0' || (j + 1) || '년', (v + j)::VARCHAR, true FROM (SELECT *, unnest([0, 1, 2, 3, 4, 5])::INT AS j FROM p WHERE k % 3 <> 0)""")
def wrapped_bodies(spark, d):
    """Stored bodies with two wrapped blocks each, some without labels, and a third that must be left as they are since a column comes again."""
    n = F.count(F.lit(1)).over(W.partitionBy("k"))
    p = read(spark, d, "part").select(F.expr("p_partkey div 10").alias("k"), F.col("p_size").alias("v"), F.concat_ws(" ", "p_name", "p_partkey").alias("label"), "p_partkey")
    p = p.withColumns({"i": F.row_number().over(W.partitionBy("k").orderBy("p_partkey")) - 1, "n": n})
    each = p.withColumn("block", F.explode(F.array(*map(F.lit, (0, 1, 2)))))
    label = F.when((F.col("block") == 2) & (F.col("k") % 3 == 1), "").otherwise(F.col("label"))
    rows = each.select("k", (F.col("i") + F.col("block") * (F.col("n") + 1)).alias("row_no"), label.alias("l"), (F.col("v") + 2 * F.col("block")).cast("string").alias("a"), (F.col("v") + 2 * F.col("block") + 1).cast("string").alias("c"))
    again = (F.col("block") == 1) & (F.col("k") % 3 == 0)
    name = lambda plus: F.format_string("0%d년", 2 * F.col("block") + plus)
    marks = each.where("block > 0").select("k", "block", "n").distinct().select("k", (F.col("block") * (F.col("n") + 1) - 1).alias("row_no"), F.lit("구분"), F.when(again, "01년").otherwise(name(1)), name(2))
    record = F.create_map(F.lit("구분"), F.col("l"), F.lit("01년"), F.col("a"), F.lit("02년"), F.col("c"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("row_no", F.to_json(record).alias("record")))), lambda x: x["record"])
    bodies = rows.union(marks).groupBy("k").agg(F.concat(F.lit('{"columns":["구분","01년","02년"],"records":['), F.array_join(listed, ","), F.lit("]}")).alias("body"))
    return bodies_of.stored_rows(bodies, ["k"])
