"""The catalogue's operators over the test tables, each with SQL for the same rows.

The tables stand in for a catalogue: the year of an order is an edition, its status the
kind of publication, the order a statistic, its lines physical tables, its customer the contact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import names, numbers, text, vectors
from ..operators import analyze as an
from ..operators import cells, charts, chunks, derive, search
from ..operators import compare as cmp
from ..sources import archive
from ..sources import catalog as cat
from ..streaming import progress

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None):
    def put(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return put


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def money(c):
    """Exact sums whatever the order of rows."""
    return F.sum(c.cast("decimal(18,2)")).cast("double")


def fixture(spark: SparkSession, d: str) -> cat.Catalog:
    o, c, line = (read(spark, d, n) for n in ("orders", "customer", "lineitem"))
    s = o.select(
        F.col("o_orderkey").alias("stat_id"), (F.year("o_orderdate") * 10 + F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)).alias("pub_id"),
        F.year("o_orderdate").alias("year"), F.col("o_orderkey").cast("string").alias("ref_id"), F.month("o_orderdate").alias("chapter_no"), F.dayofmonth("o_orderdate").alias("section_no"),
        F.concat(F.lit("M"), F.month("o_orderdate")).alias("chapter"), F.concat(F.lit("D"), F.dayofmonth("o_orderdate")).alias("section"), F.concat(F.lit("Customer "), "o_custkey").alias("title_ko"),
        F.col("o_orderpriority").alias("unit"), F.lit(None).cast("string").alias("level3_title"), F.lit(None).cast("string").alias("level4_title"), F.lit(None).cast("string").alias("base_date"), F.col("o_orderkey").cast("int").alias("page_start"),
    )
    p = o.select((F.year("o_orderdate") * 10 + F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)).alias("pub_id"), F.col("o_orderstatus").alias("publication_kind"), F.year("o_orderdate").alias("year")).distinct()
    p = p.withColumns({"period": F.lit(""), "title": F.concat(F.lit("Edition "), "year"), "page_count": F.col("year") - 1900})
    t = line.select((F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("table_id"), F.col("l_orderkey").alias("stat_id"), F.col("l_linenumber").alias("seq"), F.col("l_returnflag").alias("caption"), F.lit(1).alias("n_rows"), F.lit(1).alias("n_cols"))
    k = o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("contact_id"), F.col("o_orderkey").alias("stat_id"), F.col("c_mktsegment").alias("dept"), F.col("c_name").alias("officer"), F.lit(None).cast("string").alias("phone"),
        F.concat(F.lit("SYS "), "c_nationkey").alias("source_system"), F.lit(None).cast("string").alias("source_url"),
    )
    n = line.select((F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("note_id"), F.col("l_orderkey").alias("stat_id"), F.col("l_linenumber").alias("seq"), F.lit(None).cast("string").alias("note_no"), F.col("l_linestatus").alias("content"))
    return cat.Catalog(p, s, t, n, k)


@query("""
SELECT year(o_orderdate)::INT AS publication_year, o_orderstatus AS publication_kind, count(DISTINCT o_orderkey) AS statistics, count(DISTINCT month(o_orderdate)) AS chapters,
 count(DISTINCT (month(o_orderdate), day(o_orderdate))) AS sections, count(DISTINCT l_orderkey * 100 + l_linenumber) AS tables, count(DISTINCT c_mktsegment) AS organizations, count(DISTINCT c_nationkey) AS source_systems
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2""")
def catalog_overview(spark, d):
    return an.overview(fixture(spark, d)).select("publication_year", "publication_kind", "statistics", "chapters", "sections", "tables", "organizations", "source_systems")


@query("SELECT count(DISTINCT o_orderstatus) AS matched_publications, count(DISTINCT c_mktsegment) AS value FROM orders JOIN customer ON c_custkey = o_custkey WHERE year(o_orderdate) = 1998")
def catalog_count_distinct_field(spark, d):
    return an.analyze(fixture(spark, d), "count", distinct_field="department", kind="all", year=1998).rows


@query("""SELECT c_mktsegment AS organization, count(DISTINCT o_orderkey) AS value FROM orders JOIN customer ON c_custkey = o_custkey
WHERE o_orderstatus = 'F' AND year(o_orderdate) = (SELECT max(year(o_orderdate)) FROM orders WHERE o_orderstatus = 'F') GROUP BY 1""")
def catalog_breakdown(spark, d):
    return an.analyze(fixture(spark, d), "breakdown", group_by="organization", kind="F").rows


@query("""SELECT month(o_orderdate)::INT AS chapter_no, day(o_orderdate)::INT AS section_no, 'D' || day(o_orderdate) AS section, count(DISTINCT l_orderkey * 100 + l_linenumber) AS value
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey WHERE year(o_orderdate) = 1997 GROUP BY 1, 2, 3""")
def catalog_breakdown_section(spark, d):
    return an.analyze(fixture(spark, d), "breakdown", "tables", group_by="section", kind="all", year=1997).rows


@query("""SELECT DISTINCT year(o_orderdate)::INT AS publication_year, c_mktsegment AS department, c_name AS officer FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'O'
ORDER BY publication_year DESC, department, officer LIMIT 50 OFFSET 20""")
def catalog_list_page(spark, d):
    return an.analyze(fixture(spark, d), "list", "contacts", fields=["publication_year", "department", "officer"], kind="O", all_years=True, deduplicate=True, limit=50, offset=20).rows


@query("""SELECT p_partkey, p_name, lower(regexp_replace(p_name, '[\\s·･‧・_/-]', '', 'g')) AS name_key FROM part
WHERE contains(lower(regexp_replace(p_name, '[\\s·･‧・_/-]', '', 'g')), 'e') AND contains(lower(regexp_replace(p_brand, '[\\s·･‧・_/-]', '', 'g')), '#1')""")
def catalog_value_filter(spark, d):
    rows = an.value_filter(read(spark, d, "part"), [("p_name", "E"), ("p_brand", "# 1")])
    return rows.select("p_partkey", "p_name", text.match_key(F.col("p_name")).alias("name_key"))


@query("SELECT c_mktsegment AS department, count(*) AS n_rows FROM orders JOIN customer ON c_custkey = o_custkey WHERE NOT regexp_matches(c_name, '[0369]$') GROUP BY 1")
def catalog_required_fields(spark, d):
    c = fixture(spark, d)
    blank = F.when(F.col("officer").rlike("[0369]$"), "  ").otherwise(F.col("dept"))
    c = cat.Catalog(c.publications, c.statistics, c.stat_tables, c.footnotes, c.contacts.withColumn("dept", blank))
    rows = an.analyze(c, "list", "contacts", fields=["department", "contact_id"], required=["department"], kind="all", all_years=True, limit=500).every
    return rows.groupBy("department").agg(F.count(F.lit(1)).alias("n_rows"))


@query("SELECT o_orderkey, o_custkey, year(o_orderdate)::INT AS year FROM (SELECT *, max(year(o_orderdate)) OVER (PARTITION BY o_orderstatus, o_custkey) AS newest FROM orders) WHERE year(o_orderdate) = newest")
def latest_edition_ties(spark, d):
    o = read(spark, d, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("year"), F.lit("").alias("period"), "o_orderstatus", F.col("o_custkey").cast("string").alias("title"))
    return search.latest_editions(o, "o_orderstatus", "title", "o_orderkey").select("o_orderkey", "o_custkey", "year")


ITEMS = """WITH e AS (SELECT year(o_orderdate) AS y, 'customer' || o_custkey AS match_key, o_orderkey, o_orderpriority, o_orderstatus FROM orders),
i AS (SELECT y, match_key, o_orderpriority AS unit, o_orderstatus AS kind, count(*) OVER (PARTITION BY y, match_key) AS record_count, row_number() OVER (PARTITION BY y, match_key ORDER BY o_orderkey, o_orderpriority, o_orderstatus) AS rn FROM e),
b AS (SELECT * FROM i WHERE y = 1997 AND rn = 1), t AS (SELECT * FROM i WHERE y = 1998 AND rn = 1) """


def items(spark, d, year):
    o = read(spark, d, "orders").where(F.year("o_orderdate") == year)
    rows = o.select("o_orderkey", F.col("o_orderpriority").alias("unit"), F.col("o_orderstatus").alias("kind"), F.concat(F.lit("Customer "), "o_custkey").alias("title"))
    return cmp.edition_items(rows, text.match_key(F.col("title")), ["unit", "kind"], ["o_orderkey", "unit", "kind"])


@query(ITEMS + "SELECT match_key, unit, kind, record_count FROM b")
def edition_items(spark, d):
    return items(spark, d, 1997)


@query(ITEMS + """SELECT count(b.match_key) AS base_items, count(t.match_key) AS target_items, coalesce(sum(b.record_count), 0)::BIGINT AS base_records, coalesce(sum(t.record_count), 0)::BIGINT AS target_records,
 count(*) FILTER (WHERE b.match_key = t.match_key) AS in_both, count(*) FILTER (WHERE t.match_key IS NULL) AS only_in_base, count(*) FILTER (WHERE b.match_key IS NULL) AS only_in_target,
 count(*) FILTER (WHERE b.match_key = t.match_key AND (b.unit IS DISTINCT FROM t.unit OR b.kind IS DISTINCT FROM t.kind)) AS changed, count(*) FILTER (WHERE b.record_count > 1) AS base_merged, count(*) FILTER (WHERE t.record_count > 1) AS target_merged
FROM b FULL JOIN t ON b.match_key = t.match_key""")
def compare_summary(spark, d):
    return cmp.compare(items(spark, d, 1997), items(spark, d, 1998), "summary", ["unit", "kind"])


@query(ITEMS + "SELECT match_key, unit, kind, record_count FROM b WHERE match_key NOT IN (SELECT match_key FROM t)")
def compare_only_base(spark, d):
    return cmp.compare(items(spark, d, 1997), items(spark, d, 1998), "only_in_base", ["unit", "kind"])


@query(ITEMS + "SELECT match_key, unit, kind, record_count FROM t WHERE match_key NOT IN (SELECT match_key FROM b)")
def compare_only_target(spark, d):
    return cmp.compare(items(spark, d, 1997), items(spark, d, 1998), "only_in_target", ["unit", "kind"])


PAIRS = ITEMS + """SELECT b.match_key, b.unit AS base_unit, b.kind AS base_kind, b.record_count AS base_record_count, t.unit AS target_unit, t.kind AS target_kind, t.record_count AS target_record_count,
 concat_ws(',', CASE WHEN b.unit IS DISTINCT FROM t.unit THEN 'unit' END, CASE WHEN b.kind IS DISTINCT FROM t.kind THEN 'kind' END) AS changed_fields FROM b JOIN t ON b.match_key = t.match_key"""


def pairs(spark, d, operation):
    return cmp.compare(items(spark, d, 1997), items(spark, d, 1998), operation, ["unit", "kind"]).withColumn("changed_fields", F.array_join("changed_fields", ","))


@query(PAIRS)
def compare_in_both(spark, d):
    return pairs(spark, d, "in_both")


@query(PAIRS + " WHERE b.unit IS DISTINCT FROM t.unit OR b.kind IS DISTINCT FROM t.kind")
def compare_changed(spark, d):
    return pairs(spark, d, "changed")


@query("SELECT c_nationkey, string_agg(DISTINCT c_mktsegment, ' | ' ORDER BY c_mktsegment) AS dept FROM customer GROUP BY 1")
def contact_fold(spark, d):
    return cmp.fold_contacts(read(spark, d, "customer").withColumn("dept", F.col("c_mktsegment")), "c_nationkey", ("dept",))


@query("SELECT c_nationkey, arg_min(c_mktsegment, c_custkey) AS dept FROM customer WHERE trim(c_mktsegment) <> '' GROUP BY 1")
def lateral_first_contact(spark, d):
    return cmp.first_contact(read(spark, d, "customer").withColumn("dept", F.col("c_mktsegment")), "c_nationkey", "dept", "c_custkey")


@query("SELECT o_orderkey, EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 49) AS has_tables FROM orders")
def exists_flag(spark, d):
    big = read(spark, d, "lineitem").where("l_quantity > 49").withColumnRenamed("l_orderkey", "o_orderkey")
    return search.with_flag(read(spark, d, "orders"), big, "o_orderkey", "has_tables").select("o_orderkey", "has_tables")


@query("""SELECT id FROM (SELECT vec_id AS id FROM embeddings UNION SELECT doc_id FROM documents UNION SELECT doc_id FROM labels) u
WHERE NOT EXISTS (SELECT 1 FROM labels WHERE doc_id = id) AND NOT EXISTS (SELECT 1 FROM pages WHERE page_id = id)""")
def profile_gc(spark, d):
    get = lambda t, c: read(spark, d, t).select(F.col(c).alias("profile_key"))
    every = get("embeddings", "vec_id").union(get("documents", "doc_id")).union(get("labels", "doc_id")).distinct()
    return cat.orphan_profiles(every, get("labels", "doc_id"), get("pages", "page_id")).select(F.col("profile_key").alias("id"))


@query("SELECT l_orderkey, l_linenumber, count(*) AS n_rows, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS labels FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_guard(spark, d):
    return cat.duplicates(read(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], "l_returnflag")


@query("""SELECT 'stat_tables' AS table_name, count(*) AS n_rows, count(*) FILTER (WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)) AS lost FROM lineitem
UNION ALL SELECT 'footnotes', count(*), count(*) FILTER (WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)) FROM lineitem
UNION ALL SELECT 'contacts', count(*), 0 FROM orders JOIN customer ON c_custkey = o_custkey""")
def verification_counts(spark, d):
    return cat.verification(fixture(spark, d))


@query("""WITH gone AS (SELECT o_orderkey FROM orders WHERE year(o_orderdate) = 1996 AND o_orderstatus = 'F')
SELECT 'statistics' AS table_name, count(*) AS n_rows FROM gone UNION ALL SELECT 'stat_tables', count(*) FROM lineitem WHERE l_orderkey IN (SELECT * FROM gone)
UNION ALL SELECT 'footnotes', count(*) FROM lineitem WHERE l_orderkey IN (SELECT * FROM gone) UNION ALL SELECT 'contacts', count(*) FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderkey IN (SELECT * FROM gone)""")
def cascade_delete(spark, d):
    return cat.without_publications(fixture(spark, d), [19960])[1]


@query("""WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0)
SELECT vec_id, round(1 - list_dot_product(embedding::DOUBLE[], q) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(q, q))), 6) + 0.0 AS distance FROM embeddings, q ORDER BY distance, vec_id LIMIT 25""")
def vector_topk(spark, d):
    e = read(spark, d, "embeddings")
    q = e.where("vec_id = 0").select("embedding").first()[0]  # the request's vector
    return search.nearest(e, F.lit([float(x) for x in q]), search.pool_size(5), ties=("vec_id",), decimals=6).select("vec_id", "distance")


@query("""SELECT q.vec_id AS query_id, e.vec_id, round(1 - list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) / (sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) * sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[]))), 6) + 0.0 AS distance
FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0 QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY distance, e.vec_id) <= 25""")
def vector_topk_all(spark, d):
    """The whole query set, each vector whose id is divisible by 20, against all vectors."""
    e = read(spark, d, "embeddings").select("vec_id", "embedding")
    return search.nearest_each(e, e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), "vec_id", search.pool_size(5))


@query("""WITH p AS (SELECT a.vec_id, list_transform(list_zip(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), lambda z: z[1] * 0.85 + z[2] * 0.15) AS s FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)
SELECT vec_id, round(s[1] / sqrt(list_dot_product(s, s)), 6) + 0.0 AS first_value, round(s[64] / sqrt(list_dot_product(s, s)), 6) + 0.0 AS last_value FROM p""")
def weighted_vector(spark, d):
    e = read(spark, d, "embeddings")
    b = e.select((F.col("vec_id") - 1).alias("k"), F.col("embedding").alias("other"))
    v = e.join(b, F.col("vec_id") == F.col("k")).select("vec_id", vectors.weighted(F.col("embedding"), F.col("other")).alias("v"))
    return v.select("vec_id", (F.round(F.get("v", F.lit(0)), 6) + F.lit(0.0)).alias("first_value"), (F.round(F.get("v", F.lit(63)), 6) + F.lit(0.0)).alias("last_value"))


WORDS = ["the", "and", "that"]
LEXICAL = """WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}\\p{M}_]+') AS t FROM documents),
n AS (SELECT doc_id, len(list_filter(t, lambda x: x = 'the')) AS a, len(list_filter(t, lambda x: x = 'and')) AS b, len(list_filter(t, lambda x: x = 'that')) AS c FROM w),
lexical AS (SELECT doc_id, (a + b + c)::INT AS score FROM n WHERE a > 0 AND b > 0 AND c > 0 ORDER BY score DESC, doc_id LIMIT 25) """


@query(LEXICAL + "SELECT doc_id, score FROM lexical")
def lexical_topk(spark, d):
    docs = read(spark, d, "documents")
    return search.by_words(docs, "text", WORDS, 25, ("doc_id",)).select("doc_id", "score")


@query(LEXICAL + "SELECT doc_id, score FROM lexical")
def lexical_topk_all(spark, d):
    """Documents of every language."""
    return search.by_words(read(spark, d, "documents"), "text", WORDS, 25, ("doc_id",)).select("doc_id", "score")


@query(LEXICAL + """, q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0),
v AS (SELECT vec_id AS doc_id, round(1 - list_dot_product(embedding::DOUBLE[], q), 6) AS distance FROM embeddings, q ORDER BY distance, vec_id LIMIT 25),
g AS (SELECT doc_id, 3.0 / (10 + row_number() OVER (ORDER BY score DESC, doc_id)) AS gain FROM lexical UNION ALL SELECT doc_id, 1.8 / (10 + row_number() OVER (ORDER BY distance, doc_id)) FROM v)
SELECT doc_id, round(sum(gain)::DOUBLE, 6) AS score FROM g GROUP BY 1""")
def rrf_fusion(spark, d):
    lexical = lexical_topk(spark, d)
    e = read(spark, d, "embeddings")
    q = [float(x) for x in e.where("vec_id = 0").select("embedding").first()[0]]
    near = search.nearest(e.withColumnRenamed("vec_id", "doc_id"), F.lit(q), 25, ties=("doc_id",), decimals=6).select("doc_id", "distance")
    parts = [search.contributions(lexical, "table_lexical", [F.col("score").desc(), F.col("doc_id")], "doc_id"), search.contributions(near, "table_vector", [F.col("distance"), F.col("doc_id")], "doc_id")]
    return search.fuse(parts, "doc_id").select("doc_id", F.round("score", 6).alias("score"))


@query(LEXICAL + """, v AS (SELECT q.vec_id AS query_id, e.vec_id AS doc_id, round(1 - list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) / (sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) * sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[]))), 6) + 0.0 AS distance
FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0 QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY distance, e.vec_id) <= 25),
g AS (SELECT q.vec_id AS query_id, doc_id, 3.0 / (10 + row_number() OVER (PARTITION BY q.vec_id ORDER BY score DESC, doc_id)) AS gain FROM lexical, embeddings q WHERE q.vec_id % 20 = 0
UNION ALL SELECT query_id, doc_id, 1.8 / (10 + row_number() OVER (PARTITION BY query_id ORDER BY distance, doc_id)) FROM v)
SELECT query_id, doc_id, round(sum(gain)::DOUBLE, 6) AS score FROM g GROUP BY 1, 2""")
def rrf_fusion_all(spark, d):
    """The words' list with that of each vector of the query set."""
    ids = read(spark, d, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"))
    words = search.contributions(lexical_topk_all(spark, d), "table_lexical", [F.col("score").desc(), F.col("doc_id")], "doc_id")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("distance", "vec_id"))
    near = vector_topk_all(spark, d).select("query_id", F.col("vec_id").alias("doc_id"), (search.WEIGHTS["table_vector"] / (search.RRF_K + rank)).alias("gain"))
    gains = ids.crossJoin(words.select("doc_id", "gain")).unionByName(near)
    return gains.groupBy("query_id", "doc_id").agg(F.round(F.sum("gain"), 6).alias("score"))


@query("""WITH a AS (SELECT c_custkey AS k, c_acctbal AS s, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS position, 0 AS list_no FROM customer QUALIFY position <= 10),
b AS (SELECT s_suppkey AS k, s_acctbal AS s, row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) AS position, 1 AS list_no FROM supplier QUALIFY position <= 10)
SELECT k, s, position::INT AS position, list_no FROM (SELECT * FROM a UNION ALL SELECT * FROM b)""")
def interleave_by_kind(spark, d):
    a = read(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("s")).orderBy(F.col("s").desc(), "k").limit(10)
    b = read(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("s")).orderBy(F.col("s").desc(), "k").limit(10)
    return search.interleave([a, b], [F.col("s").desc(), F.col("k")], 10)


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CASE l_partkey % 5 WHEN 3 THEN NULL WHEN 1 THEN -l_quantity WHEN 4 THEN -l_quantity ELSE l_quantity END AS number FROM lineitem""")
def parse_number_cells(spark, d):
    q, k = F.col("l_quantity").cast("decimal(10,2)").cast("string"), F.col("l_partkey") % 5
    cell = F.when(k == 0, F.concat(q, F.lit(" %"))).when(k == 1, F.concat(F.lit("("), q, F.lit(")"))).when(k == 2, F.concat(F.lit("0,0"), q)).when(k == 3, F.lit(" － ")).otherwise(F.concat(F.lit("△ "), q))
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", numbers.parse_number(cell).alias("number"))


@query("SELECT o_orderkey, year(o_orderdate)::INT AS year, CASE WHEN o_orderkey % 3 = 2 THEN NULL ELSE year(o_orderdate)::INT END AS header FROM orders")
def parse_year_labels(spark, d):
    y = F.year("o_orderdate")
    k = F.col("o_orderkey") % 3
    label = F.when(k == 0, F.concat(F.lit("'"), F.lpad((y % 100).cast("string"), 2, "0"), F.lit("(잠정)"))).when(k == 1, F.concat(y.cast("string"), F.lit("년"))).otherwise(F.concat(y.cast("string"), F.lit("_예산")))
    return read(spark, d, "orders").select("o_orderkey", numbers.parse_year(label).alias("year"), numbers.header_year(label).alias("header"))


@query("""WITH u AS (SELECT 'p_name' AS c, p_name AS t FROM part UNION ALL SELECT 'p_size', p_size::VARCHAR FROM part UNION ALL SELECT 'p_year', (1990 + p_size)::VARCHAR FROM part)
SELECT c AS "column", count(*) AS n_filled, round(avg((regexp_full_match(t, '[-+]?[0-9]+(\\.[0-9]+)?'))::INT), 3) AS numeric_ratio, round(avg((regexp_matches(t, '^(18|19|20)[0-9]{2}'))::INT), 3) AS year_ratio FROM u GROUP BY 1""")
def column_profile(spark, d):
    p = read(spark, d, "part").select("p_partkey", "p_name", F.col("p_size").cast("string").alias("p_size"), (F.lit(1990) + F.col("p_size")).cast("string").alias("p_year"))
    long = p.unpivot(["p_partkey"], ["p_name", "p_size", "p_year"], "column", "text").withColumn("col_no", F.lit(0))
    long = long.withColumns({"number": numbers.parse_number(F.col("text")), "year": numbers.parse_year(F.col("text"))})
    return cells.profile(long, []).select("column", "n_filled", "numeric_ratio", "year_ratio")


YEARS = "WITH y AS (SELECT o_orderpriority AS series, year(o_orderdate)::INT AS x, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS value FROM orders GROUP BY 1, 2) "


def by_year(spark, d):
    r = read(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("series"), F.year("o_orderdate").alias("x")).agg(money(F.col("o_totalprice")).alias("value"))
    return r.withColumn("pos", F.concat("series", F.col("x").cast("string")))


@query(YEARS + "SELECT series, x, value FROM y")
def wide_year_unpivot(spark, d):
    o = read(spark, d, "orders")
    years = {str(r[0]): r[0] for r in o.select(F.year("o_orderdate")).distinct().orderBy(F.year("o_orderdate")).collect()}  # a row for each year
    wide = o.withColumn("y_col", F.year("o_orderdate").cast("string")).groupBy(F.col("o_orderpriority").alias("label")).pivot("y_col", list(years)).agg(money(F.col("o_totalprice")))
    return charts.wide_years(wide.withColumn("p", F.col("label")), "label", years, "p").select("series", "x", "value")


@query(YEARS + "SELECT series, x, value, round(value - lag(value) OVER (PARTITION BY series ORDER BY x), 2) AS delta FROM y QUALIFY lag(value) OVER (PARTITION BY series ORDER BY x) IS NOT NULL")
def yoy_delta(spark, d):
    return charts.deltas(by_year(spark, d), ["series"]).select("series", "x", "value", F.round("delta", 2).alias("delta"))


@query(YEARS + "SELECT series, x, row_number() OVER (PARTITION BY x ORDER BY value DESC, series)::INT AS rank, count(*) OVER (PARTITION BY x) AS n_ranked FROM y")
def bump_rank(spark, d):
    return charts.ranks(by_year(spark, d)).select("series", "x", "rank", "n_ranked")


@query(YEARS + "SELECT series, x, round(value / sum(value) OVER (PARTITION BY x), 6) AS share FROM y")
def share_of_total(spark, d):
    return charts.shares(by_year(spark, d)).select("series", "x", F.round("share", 6).alias("share"))


@query(YEARS + "SELECT series, x, round(value / sum(value) OVER (PARTITION BY x), 6) AS share, round((sum(value) OVER (PARTITION BY x ORDER BY series) - value / 2) / sum(value) OVER (PARTITION BY x) * 2 * pi(), 6) AS mid_angle FROM y")
def ring_angles(spark, d):
    r = charts.ring_angles(by_year(spark, d).withColumn("pos", F.col("series")), ["x"])
    return r.select("series", "x", F.round("share", 6).alias("share"), F.round("mid_angle", 6).alias("mid_angle"))


@query(YEARS + "SELECT series, x, round(sum(value) OVER (PARTITION BY series ORDER BY x), 2) AS end_value, round(sum(value) OVER (PARTITION BY series ORDER BY x) - value, 2) AS start_value FROM y")
def waterfall_steps(spark, d):
    w = charts.waterfall(by_year(spark, d), ["series"])
    return w.select("series", "x", F.round("end_value", 2).alias("end_value"), F.round("start_value", 2).alias("start_value"))


@query(YEARS + "SELECT series, x, (dense_rank() OVER (ORDER BY series DESC) - 1)::INT AS stack_no, value >= max(value) OVER (PARTITION BY x) AS is_top, x IN ((SELECT min(x) FROM y), (SELECT max(x) FROM y)) AS is_edge FROM y")
def stack_order_edges(spark, d):
    return charts.stack_order(charts.marks(by_year(spark, d))).select("series", "x", "stack_no", "is_top", "is_edge")


TYPES = "WITH r AS (SELECT p_type AS x, p_brand AS series, sum(p_retailprice::DECIMAL(18,2))::DOUBLE AS value, min(p_partkey) AS pos FROM part GROUP BY 1, 2) "


def by_type(spark, d):
    return read(spark, d, "part").groupBy(F.col("p_type").alias("x"), F.col("p_brand").alias("series")).agg(money(F.col("p_retailprice")).alias("value"), F.min("p_partkey").alias("pos"))


@query(TYPES + "SELECT x, series, value FROM r WHERE x IN (SELECT x FROM r GROUP BY x ORDER BY sum(value::DECIMAL(18,2)) DESC, min(pos) LIMIT 3)")
def top_categories(spark, d):
    return charts.top_by_sum(by_type(spark, d), "x", 3).select("x", "series", "value")


@query(TYPES + "SELECT x, series, value FROM r WHERE series IN (SELECT series FROM r GROUP BY series ORDER BY sum(value::DECIMAL(18,2)) DESC, min(pos) LIMIT 12)")
def top_series(spark, d):
    return charts.top_by_sum(by_type(spark, d), "series", charts.SERIES).select("x", "series", "value")


@query(TYPES + ", s AS (SELECT x, sum(value::DECIMAL(18,2)) AS t, min(pos) AS p FROM r GROUP BY x) SELECT r.x, series, value, dense_rank() OVER (ORDER BY t DESC, p)::INT AS order_no FROM r JOIN s ON r.x = s.x")
def category_value_sort(spark, d):
    return charts.sort_by_value(by_type(spark, d)).select("x", "series", "value", "order_no")


@query("SELECT r_name AS label FROM region UNION ALL SELECT n_name FROM nation")
def total_row_filter(spark, d):
    extra = spark.createDataFrame([("합계 Total",), ("소계",), ("sub-total",), ("총계 Grand",)], "label string")
    rows = read(spark, d, "region").select(F.col("r_name").alias("label")).union(read(spark, d, "nation").select("n_name")).union(extra)
    return charts.without_totals(rows, "label")


OPERANDS = """WITH a AS (SELECT c_nationkey AS k, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS numerator FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1),
b AS (SELECT c_nationkey AS k, sum(CASE WHEN c_nationkey % 7 = 0 THEN 0 ELSE 1 END)::DOUBLE AS denominator FROM customer GROUP BY 1),
j AS (SELECT 'nation' || a.k AS key, numerator, denominator FROM a JOIN b ON a.k = b.k) """


def operands(spark, d):
    c = read(spark, d, "customer").withColumn("label", F.concat(F.lit("NATION_"), "c_nationkey"))
    o = read(spark, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey")).select("label", F.col("o_totalprice").cast("decimal(18,2)").alias("price"))
    ones = c.select("label", F.when(F.col("c_nationkey") % 7 == 0, 0.0).otherwise(1.0).alias("people"))
    return derive.series_points(o, "label", "price").withColumn("value", F.col("value").cast("double")), derive.series_points(ones, "label", "people")


def derived(spark, d, op, per=1.0):
    a, b = operands(spark, d)
    return derive.derive(op, a, b, per).select(F.regexp_replace("key", "_", "").alias("key"), "numerator", "denominator", F.round("value", 4).alias("value"))


@query(OPERANDS + "SELECT key, numerator, denominator, round(numerator / denominator, 4) AS value FROM j WHERE denominator <> 0")
def derive_ratio(spark, d):
    return derived(spark, d, "ratio")


@query(OPERANDS + "SELECT key, numerator, denominator, round(numerator / denominator * 1000, 4) AS value FROM j WHERE denominator <> 0")
def derive_per_capita(spark, d):
    return derived(spark, d, "per_capita", 1000)


@query(OPERANDS + "SELECT key, numerator, denominator, round(numerator / denominator * 100, 4) AS value FROM j WHERE denominator <> 0")
def derive_share(spark, d):
    return derived(spark, d, "share")


@query(OPERANDS + "SELECT key, numerator, denominator, round(numerator - denominator, 4) AS value FROM j")
def derive_difference(spark, d):
    return derived(spark, d, "difference")


@query("SELECT l_linenumber, max(l_discount) / 1000 AS largest, CASE WHEN max(l_discount) / 1000 <= 0 OR max(l_discount) / 1000 >= 0.1 THEN 1 WHEN max(l_discount) >= 1 THEN 1000 WHEN max(l_discount) * 10 >= 1 THEN 10000 WHEN max(l_discount) * 100 >= 1 THEN 100000 ELSE 1000000 END AS step FROM lineitem GROUP BY 1")
def derive_autoscale(spark, d):
    m = read(spark, d, "lineitem").groupBy("l_linenumber").agg((F.max("l_discount") / 1000).alias("largest"))
    return m.withColumn("step", derive.auto_scale(F.col("largest")))


@query("SELECT 'n_name' AS left_column, 'spelled' AS right_column, count(*) AS n_shared FROM nation WHERE n_nationkey % 2 = 0")
def key_alignment(spark, d):
    n = read(spark, d, "nation")
    other = n.where("n_nationkey % 2 = 0").select(F.lower(F.concat(F.lit(" "), "n_name", F.lit(" "))).alias("spelled"), F.lit("x").alias("constant"))
    return derive.shared_keys(n, other, ["n_name"], ["spelled", "constant"])


@query("SELECT lower(l_returnflag) AS key, sum(l_quantity) AS quantity, round(avg(l_discount), 6) AS discount_rate FROM lineitem GROUP BY 1")
def sum_or_mean(spark, d):
    rows = read(spark, d, "lineitem").withColumn("discount_rate", F.col("l_discount")).withColumnRenamed("l_quantity", "quantity")
    one = derive.align({"quantity": derive.series_points(rows, "l_returnflag", "quantity"), "discount_rate": derive.series_points(rows, "l_returnflag", "discount_rate")})
    return one.withColumn("discount_rate", F.round("discount_rate", 6))


@query("SELECT round(max(l_extendedprice) / max(l_tax), 4) AS scale_ratio, max(l_extendedprice) / max(l_tax) >= 20 AS split FROM lineitem")
def axis_scale_ratio(spark, d):
    rows = charts.melt(read(spark, d, "lineitem"), "l_returnflag", ["l_extendedprice", "l_tax"], "l_orderkey")
    return charts.scale_ratio(rows).select(F.round("scale_ratio", 4).alias("scale_ratio"), (F.col("scale_ratio") >= 20).alias("split"))


@query("SELECT l_orderkey AS pos, l_returnflag AS x, unnest(['l_discount', 'l_tax']) AS series, unnest([l_discount, l_tax]) AS value FROM lineitem")
def melt_metrics(spark, d):
    return charts.melt(read(spark, d, "lineitem"), "l_returnflag", ["l_discount", "l_tax"], "l_orderkey")


@query("SELECT x, max(value) FILTER (WHERE series = '1-URGENT') AS \"1-URGENT\", max(value) FILTER (WHERE series = '2-HIGH') AS \"2-HIGH\" FROM (" + YEARS + "SELECT * FROM y) GROUP BY x")
def joined_rows(spark, d):
    return derive.joined_rows(by_year(spark, d), "x", ["1-URGENT", "2-HIGH"])


@query("SELECT p_partkey::VARCHAR AS label, p_size AS x, p_retailprice AS y FROM part WHERE p_partkey % 4 <> 0")
def scatter_pairs(spark, d):
    p = read(spark, d, "part").withColumns({"y": F.when(F.col("p_partkey") % 4 != 0, F.col("p_retailprice")), "name": F.col("p_partkey").cast("string")})
    return derive.pairs(p, "name", "p_size", "y")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_partkey % 3 <> 0 OR l_tax = 0 AS adds_up FROM lineitem")
def component_sum_check(spark, d):
    rows = read(spark, d, "lineitem").withColumn("total", F.col("l_discount") + F.when(F.col("l_partkey") % 3 == 0, 0.0).otherwise(F.col("l_tax")))
    return derive.component_sums(rows, "total", ["l_discount", "l_tax"]).select("l_orderkey", "l_linenumber", "l_partkey", "adds_up")


@query("""SELECT n_nationkey, r, c, n_name AS text FROM nation, (SELECT unnest(range(0, 4))::INT AS r), (SELECT unnest(range(0, 3))::INT AS c) WHERE r < 1 + n_nationkey % 4 AND c < 1 + n_nationkey % 3""")
def grid_expand(spark, d):
    n = read(spark, d, "nation").select("n_nationkey", F.lit(0).alias("row"), F.lit(0).alias("col"), (F.col("n_nationkey") % 4 + 1).alias("row_span"), (F.col("n_nationkey") % 3 + 1).alias("col_span"), F.col("n_name").alias("text"))
    return cells.expand_spans(n, ["n_nationkey"])


@query("""SELECT conv_id, turn, role, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS heading FROM conversations""")
def carry_forward_sections(spark, d):
    c = read(spark, d, "conversations").select("conv_id", "turn", "role")
    return cells.carry_forward(c, "conv_id", "turn", F.when(F.col("role") == "user", F.col("turn")))


@query("SELECT conv_id, turn, expected FROM (SELECT conv_id, turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) + 1 AS expected FROM (SELECT conv_id, turn + turn // 3 AS turn FROM conversations)) WHERE expected IS NOT NULL AND turn <> expected")
def sequence_check(spark, d):
    c = read(spark, d, "conversations").select("conv_id", F.expr("turn + turn div 3").alias("turn"))  # a number is left out after every third
    return cells.sequence_gaps(c, "conv_id", "turn")


@query("""SELECT 'both' AS part, count(*) AS n_keys FROM (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL
SELECT 'either', count(*) FROM (SELECT c_nationkey FROM customer UNION SELECT s_nationkey FROM supplier) UNION ALL SELECT 'one', count(*) FROM (SELECT n_nationkey FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal < 1000)""")
def set_ops(spark, d):
    c, s, n = read(spark, d, "customer").select("c_nationkey"), read(spark, d, "supplier"), read(spark, d, "nation").select("n_nationkey")
    one = lambda df: df.toDF("match_key").distinct().withColumn("record_count", F.lit(1))
    count = lambda df, name: df.agg(F.lit(name).alias("part"), F.count(F.lit(1)).alias("n_keys"))
    both = cmp.compare(one(c), one(s.select("s_nationkey")), "in_both", [])
    either = c.union(s.select("s_nationkey")).distinct()
    poor = s.where("s_acctbal < 1000").select("s_nationkey")
    return count(both, "both").union(count(either, "either")).union(count(cmp.compare(one(n), one(poor), "only_in_base", []), "one"))


@query(r"""WITH b AS (SELECT page_id, regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<script\b.*?</script>', ' ', 'g'), '(?is)<style\b.*?</style>', ' ', 'g') AS h FROM pages),
p AS (SELECT page_id, string_split_regex(h, '(?i)</?(p|div|br|li|ul|ol|h[1-6]|tr|td|th|table|title|head|body|html|section|article|nav|footer|header)\b[^>]*>') AS pieces FROM b),
u AS (SELECT page_id, unnest(range(0, len(pieces)))::INT AS block_no, trim(regexp_replace(regexp_replace(unnest(pieces), '<[^>]*>', '', 'g'), '\s+', ' ', 'g')) AS text FROM p) SELECT * FROM u WHERE text <> ''""")
def html_block_source(spark, d):
    return archive.html_blocks(read(spark, d, "pages"))


@query("""WITH g AS (SELECT c_mktsegment AS h, c_custkey // 1000 AS block, list(c_name ORDER BY c_custkey) AS names FROM customer GROUP BY 1, 2),
p AS (SELECT h, block, list_reduce(names, lambda a, x: CASE WHEN length(string_split(a, chr(1))[-1]) + 3 + length(x) <= 800 - length(h) - 1 THEN a || ' | ' || x ELSE a || chr(1) || x END) AS packed FROM g),
u AS (SELECT h, block, unnest(string_split(packed, chr(1))) AS t, unnest(range(0, len(string_split(packed, chr(1))))) AS chunk_no FROM p)
SELECT h || ' ' || block AS key, 'labels' AS chunk_kind, chunk_no::INT AS chunk_no, h || ' ' || t AS search_text FROM u""")
def chunk_labels(spark, d):
    """All customers; a key has the labels of 1000 customer ids at most, in several chunks."""
    block = F.expr("c_custkey div 1000").alias("block")
    names = F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", "c_name"))), lambda x: x["c_name"])
    rows = read(spark, d, "customer").groupBy("c_mktsegment", block).agg(names.alias("labels")).select(F.concat_ws(" ", "c_mktsegment", "block").alias("key"), F.col("c_mktsegment").alias("heading"), "labels")
    return chunks.chunks(rows, "key", "heading", "labels", "labels")


@query(None)
def chunk_labels_all(spark, d):
    """All customers, in several chunks a key; a key has labels of 100000 customer ids at most."""
    c = read(spark, d, "customer").groupBy("c_mktsegment", "c_nationkey", F.expr("c_custkey div 100000").alias("block")).agg(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", "c_name"))), lambda x: x["c_name"]).alias("labels"))
    rows = c.select(F.concat_ws(" ", "c_mktsegment", "c_nationkey", "block").alias("key"), F.col("c_mktsegment").alias("heading"), "labels")
    return chunks.chunks(rows, "key", "heading", "labels", "labels")


@query("SELECT user_id::VARCHAR AS job_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS status, count(*) AS n_events FROM events GROUP BY 1")
def latest_progress(spark, d):
    e = read(spark, d, "events").select("event_id", F.col("user_id").cast("string").alias("job_id"), F.col("event_type").alias("status"), F.lit("").alias("stage"), F.lit(0).alias("progress"), F.lit("").alias("message"), F.col("ts").alias("created_at"))
    return progress.latest(e).select("job_id", "event_id", "status", "n_events")
