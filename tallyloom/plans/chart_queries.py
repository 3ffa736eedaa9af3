"""Charts by request, of one table and of several, over tables that Spark makes of the whole test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numbers import parse_number, parse_year
from . import visualize as charts
from .queries import query, read


def table_of(rows: DataFrame, order: list[str], columns: dict[str, Column], **asked) -> charts.Source:
    """A table's cells of rows that are groups already; order gives the rows' numbers."""
    numbered = rows.withColumn("row_no", F.row_number().over(W.orderBy(*order)) - 1)
    listed = F.array(*[F.struct(F.lit(n).alias("col_no"), F.lit(c).alias("column"), v.cast("string").alias("text")) for n, (c, v) in enumerate(columns.items())])
    cells = numbered.select("row_no", F.inline(listed))
    return charts.Source(cells.withColumns({"number": parse_number(F.col("text")), "year": parse_year(F.col("text"))}), **asked)


def by_nation(spark, d, name: str, key: str, **asked) -> charts.Source:
    """How many rows of a table each nation has; nations without any are not in it."""
    counted = read(spark, d, name).groupBy(F.col(key).alias("n_nationkey")).agg(F.count(F.lit(1)).alias("n"))
    named = counted.join(F.broadcast(read(spark, d, "nation")), "n_nationkey")  # as many rows as there are nations
    return table_of(named, ["n_nationkey"], {"국가": F.col("n_name"), asked["label"]: F.col("n")}, **asked)


def by_year(spark, d, name: str, date: str, value: Column, label: str) -> charts.Source:
    rows = read(spark, d, name).groupBy(F.year(date).alias("y")).agg(value.alias("v"))
    return table_of(rows, ["y"], {"연도": F.col("y"), label: F.col("v")}, label=label, unit="건")


@query("""WITH g AS (SELECT year(o_orderdate)::VARCHAR AS x, o_orderpriority AS series, count(*)::DOUBLE AS value FROM orders GROUP BY 1, 2)
SELECT 'line' AS kind, x, series, value, value = max(value) OVER (PARTITION BY x) AS is_top, x IN ((SELECT min(x) FROM g), (SELECT max(x) FROM g)) AS is_edge FROM g""")
def visualize_automatic(spark, d):
    """API6, R27, M10 to M12: a request for a trend; the kind comes of the records and the words."""
    rows = read(spark, d, "orders").groupBy(F.year("o_orderdate").alias("y"), F.col("o_orderpriority").alias("p")).agg(F.count(F.lit(1)).alias("n"))
    c = charts.visualize(table_of(rows, ["y", "p"], {"연도": F.col("y"), "우선순위": F.col("p"), "건수": F.col("n")}, unit="건"), "건수 추이", group="우선순위")
    return c.rows.select(F.lit(c.kind).alias("kind"), "x", "series", "value", "is_top", "is_edge")


@query("""SELECT 'grouped_bar' AS kind, 'stacked_bar_100' AS asked, x, series, value, dense_rank() OVER (ORDER BY total DESC, pos)::INT AS order_no FROM (
SELECT p_brand AS x, unnest(['가장 큰', '가장 작은']) AS series, unnest([max(p_size), -min(p_size)])::DOUBLE AS value, (max(p_size) - min(p_size))::DOUBLE AS total, dense_rank() OVER (ORDER BY p_brand) AS pos FROM part GROUP BY p_brand)""")
def visualize_corrected(spark, d):
    """Parts of a whole are asked for of records with negative values; all categories, the greatest sums first."""
    rows = read(spark, d, "part").groupBy("p_brand").agg(F.max("p_size").alias("most"), (-F.min("p_size")).alias("least"))
    source = table_of(rows, ["p_brand"], {"구분": F.col("p_brand"), "가장 큰": F.col("most"), "가장 작은": F.col("least")})
    c = charts.visualize(source, chart="stacked_bar_100", metrics=["가장 큰", "가장 작은"], order="descending", top_n=0)
    return c.rows.select(F.lit(c.kind).alias("kind"), F.lit("stacked_bar_100").alias("asked"), "x", "series", "value", "order_no")


@query("""SELECT CASE WHEN count(*) = 0 THEN 'no numbers' END AS kind, count(DISTINCT p_type) AS n_types, 'no column holds numbers' AS note FROM part""")
def visualize_refused(spark, d):
    """API6: a table that holds no numbers."""
    rows = read(spark, d, "part").select(F.concat(F.lit("type "), "p_type").alias("t")).distinct()
    c = charts.visualize(table_of(rows, ["t"], {"구분": F.col("t")}), "종류별 현황", chart="bar")
    return rows.agg(F.count(F.lit(1)).alias("n_types")).select(F.lit(c.kind).cast("string").alias("kind"), "n_types", F.lit(c.notes[0]).alias("note"))


NATIONS = """c AS (SELECT c_nationkey AS k, count(*)::DOUBLE AS v, row_number() OVER (ORDER BY c_nationkey) - 1 AS pos FROM customer GROUP BY 1),
s AS (SELECT s_nationkey AS k, count(*)::DOUBLE AS v, row_number() OVER (ORDER BY s_nationkey) - 1 AS pos FROM supplier GROUP BY 1)"""


@query(f"""WITH {NATIONS} SELECT n_name AS label, c.v AS v0, s.v AS v1, CASE WHEN c.k IS NULL THEN 1 ELSE 0 END AS first_source, coalesce(c.pos, s.pos) AS first_pos,
row_number() OVER (ORDER BY c.v DESC NULLS LAST, c.k IS NULL, coalesce(c.pos, s.pos))::INT AS place FROM c FULL JOIN s ON c.k = s.k JOIN nation ON n_nationkey = coalesce(c.k, s.k)""")
def visualize_two_sources(spark, d):
    """Two tables by the nations that they share, all nations kept, the leading series first."""
    c = charts.visualize_sources([by_nation(spark, d, "customer", "c_nationkey", label="고객"), by_nation(spark, d, "supplier", "s_nationkey", label="공급")], "", order="descending")
    placed = W.orderBy(F.col("v0").desc_nulls_last(), "first_source", "first_pos")  # as many rows as there are nations
    return c.rows.select("label", "v0", "v1", "first_source", "first_pos", F.row_number().over(placed).alias("place"))


@query(f"""WITH {NATIONS} SELECT n_name AS label, c.v / s.v * 100 AS value, '공급 대비 고객 비중' AS series, '%' AS unit FROM c JOIN s ON c.k = s.k JOIN nation ON n_nationkey = c.k""")
def visualize_share_of_sources(spark, d):
    """One table's counts as a share of another's."""
    c = charts.visualize_sources([by_nation(spark, d, "customer", "c_nationkey", label="고객", unit="명"), by_nation(spark, d, "supplier", "s_nationkey", label="공급", unit="개소")], op="share")
    return c.rows.select("label", "value", F.lit(c.series[0]).alias("series"), F.lit(c.units[0]).alias("unit"))


@query("""WITH o AS (SELECT year(o_orderdate) AS y, count(*)::DOUBLE AS v0, count(DISTINCT o_custkey)::DOUBLE AS v1, count(*) FILTER (WHERE o_orderstatus = 'F')::DOUBLE AS f FROM orders GROUP BY 1),
l AS (SELECT year(l_shipdate) AS y, count(*)::DOUBLE AS v2, sum(l_quantity)::BIGINT::DOUBLE AS v3 FROM lineitem GROUP BY 1)
SELECT coalesce(o.y, l.y)::VARCHAR AS key, v0, v1, v2, v3, f AS v4 FROM o FULL JOIN l ON o.y = l.y""")
def visualize_five_sources(spark, d):
    """Four tables with a column of years and one whose columns are years, of which the row is taken that the request names."""
    n, total = F.count(F.lit(1)), F.sum("l_quantity").cast("bigint")
    sources = [
        by_year(spark, d, "orders", "o_orderdate", n, "주문"), by_year(spark, d, "orders", "o_orderdate", F.count_distinct("o_custkey"), "고객"),
        by_year(spark, d, "lineitem", "l_shipdate", n, "품목"), by_year(spark, d, "lineitem", "l_shipdate", total, "수량"),
    ]
    years = read(spark, d, "orders").groupBy(F.concat(F.lit("상태 "), "o_orderstatus").alias("status"), F.year("o_orderdate").alias("y")).agg(n.alias("n"))
    numbers = years.select("y").distinct().withColumn("col_no", F.row_number().over(W.orderBy("y")))
    rows = years.select("status").distinct().withColumn("row_no", F.row_number().over(W.orderBy("status")) - 1)  # statuses and years are few
    heads = rows.select("row_no", F.lit(0).alias("col_no"), F.lit("구분").alias("column"), F.col("status").alias("text"))
    cells = years.join(numbers, "y").join(rows, "status").select("row_no", "col_no", F.concat(F.col("y").cast("string"), F.lit("년")).alias("column"), F.col("n").cast("string").alias("text")).union(heads)
    wide = charts.Source(cells.withColumns({"number": parse_number(F.col("text")), "year": parse_year(F.col("text"))}), label="상태별")
    c = charts.visualize_sources([*sources, wide], "상태 F 추이")
    return c.rows.select("key", "v0", "v1", "v2", "v3", "v4")
