"""Queries over tables of cells, editions on disk, search evidence and statistics made of documents, each with SQL for the same rows.

Parts stand in for tables: twenty of them are one table, with a brand, a kind, two years and a family of two columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import requests
from ..functions.numbers import parse_number, parse_year
from ..operators import cells, compare, interpret, search
from ..sources import catalog as cat
from ..sources import parsing
from ..sources.staging import scratch, shuffled, written
from .queries import fixture, query, read

K = ["k"]
BRAND, KIND, THIS, NEXT, GOODS, PEOPLE = "구분 Brand", "종류 Type", "'23", "'24", "피해_재산 Property", "피해_인명 People"


def tables(spark, d) -> tuple[DataFrame, DataFrame]:
    """Cells and column profiles."""
    price = F.col("p_retailprice").cast("decimal(12,2)")
    texts = {BRAND: F.col("p_brand"), KIND: F.col("p_type"), THIS: price.cast("string"), NEXT: (price + 1).cast("string"), GOODS: F.col("p_size").cast("string"), PEOPLE: F.when(F.col("p_size") % 2 == 0, "-").otherwise(F.col("p_size").cast("string"))}
    listed = F.array(*[F.struct(F.lit(n).alias("col_no"), F.lit(c).alias("column"), t.alias("text")) for n, (c, t) in enumerate(texts.items())])
    rows = read(spark, d, "part").select(F.expr("p_partkey div 20").alias("k"), (F.col("p_partkey") % 20).cast("int").alias("row_no"), F.inline(listed))
    long = rows.withColumns({"number": parse_number(F.col("text")), "year": parse_year(F.col("text"))})
    return long, cells.profile(long, K)


def asked(spark, profiles: DataFrame, *names: str, **more) -> DataFrame:
    """The same request of every table."""
    each = F.explode(F.array(*map(F.lit, names)))
    return profiles.select("k").distinct().withColumn("requested", each).withColumns({k: F.lit(v) for k, v in more.items()})


NAMED = f"""VALUES ('brand', '{BRAND}'), ('종류', '{KIND}'), ('인명', '{PEOPLE}'), ('2023', '{THIS.replace(chr(39), chr(39) * 2)}'), ('합계', NULL), ('재산', '{GOODS}')"""


@query(f"SELECT k, requested, col AS \"column\" FROM (SELECT DISTINCT p_partkey // 20 AS k FROM part), ({NAMED}) AS v(requested, col) WHERE col IS NOT NULL")
def table_column_names(spark, d):
    """The column that a request's word means."""
    _, profiles = tables(spark, d)
    return interpret.resolve_columns(profiles, asked(spark, profiles, "brand", "종류", "인명", "2023", "합계", "재산"), K).select("k", "requested", "column")


@query("""WITH b AS (SELECT DISTINCT p_partkey // 20 AS k, p_brand FROM part), e AS (SELECT k, bool_or(p_brand = 'Brand#2') AS whole, list_sort(list(p_brand) FILTER (WHERE starts_with(p_brand, 'Brand#2'))) AS parts FROM b GROUP BY k)
SELECT k, 'brand 2' AS requested, CASE WHEN whole THEN 'Brand#2' WHEN len(parts) = 1 THEN parts[1] END AS value, CASE WHEN NOT whole AND len(parts) > 1 THEN array_to_string(parts, ',') ELSE '' END AS candidates FROM e""")
def table_cell_values(spark, d):
    """The one cell that a value means, or the several that it may."""
    long, profiles = tables(spark, d)
    found = interpret.resolve_values(long, asked(spark, profiles, "brand 2", column=BRAND), K)
    return found.select("k", "requested", "value", F.array_join("candidates", ",").alias("candidates"))


@query("""WITH t AS (SELECT *, p_partkey // 20 AS k FROM part WHERE p_type IN ('SMALL', 'LARGE')),
e AS (SELECT k, bool_or(p_brand = 'Brand#1') AS whole, list_distinct(list(p_brand) FILTER (WHERE starts_with(p_brand, 'Brand#1'))) AS parts FROM t GROUP BY k)
SELECT t.k, (p_partkey % 20)::INT AS row_no FROM t JOIN e ON t.k = e.k WHERE p_brand = CASE WHEN whole THEN 'Brand#1' WHEN len(parts) = 1 THEN parts[1] END""")
def table_exact_filters(spark, d):
    """Values of a column are alternatives, columns apply one after another."""
    long, profiles = tables(spark, d)
    return interpret.exact_filters(long, profiles, [("종류", "small"), ("구분", "Brand#1"), ("종류", "LARGE"), ("종류", "none")], K)[0].select("k", "row_no").distinct()


@query("SELECT p_partkey // 20 AS k, (p_partkey % 20)::INT AS row_no FROM part WHERE p_brand = 'Brand#7'")
def table_rows_of_place(spark, d):
    """Rows of a name, exactly before in part."""
    long, profiles = tables(spark, d)
    return interpret.select_rows(long, profiles, K, place="brand 7").select("k", "row_no").distinct()


@query("""WITH p AS (SELECT p_partkey // 20 AS k, p_partkey % 20 AS row_no, p_type, p_type = 'MEDIUM' AS hit FROM part), a AS (SELECT k, bool_or(hit) AS held FROM p GROUP BY k)
SELECT p.k, row_no::INT AS row_no FROM p JOIN a ON p.k = a.k WHERE hit OR NOT held""")
def table_rows_in_query(spark, d):
    """Rows of the longest label that the query holds; all rows where it holds none."""
    long, profiles = tables(spark, d)
    return interpret.select_rows(long, profiles, K, query="parts of medium size").select("k", "row_no").distinct()


@query("SELECT p_partkey // 20 AS k, min(p_partkey % 20)::INT AS row_no, 8 AS score FROM part WHERE p_type = 'STANDARD' GROUP BY 1")
def table_focus_row(spark, d):
    """The row whose label the query names."""
    return interpret.focus_row(tables(spark, d)[0], KIND, "standard parts", K)


@query(f"""SELECT p_partkey // 20 AS k, unnest(['{BRAND}', '{KIND}', '{GOODS}']) AS "column", unnest([count(DISTINCT p_brand), count(DISTINCT p_type), count(DISTINCT p_size)]) AS n_values,
 unnest([count(DISTINCT p_brand), count(DISTINCT p_type), count(DISTINCT p_size)]) AS n_filled_values FROM part GROUP BY 1""")
def table_spread(spark, d):
    """How many values a column has, by which an axis with one is known."""
    s = interpret.spread(tables(spark, d)[0].where(F.col("column").isin(BRAND, KIND, GOODS)), K)
    return s.select("k", "column", "n_values", "n_filled_values")


@query(f"""WITH t AS (SELECT *, p_partkey // 20 AS k FROM part WHERE p_type = 'SMALL'), s AS (SELECT k, count(*) AS n, count(DISTINCT p_brand) AS b, count(DISTINCT p_type) AS t FROM t GROUP BY k)
SELECT k, CASE WHEN n > 1 AND t = 1 AND b > 1 THEN '{BRAND}' ELSE '{KIND}' END AS "column" FROM s""")
def table_axis_repair(spark, d):
    """Where the rows share the axis' value, the column that tells them apart."""
    long, profiles = tables(spark, d)
    small = long.join(long.where((F.col("column") == KIND) & (F.col("text") == "SMALL")).select("k", "row_no"), ["k", "row_no"], "left_semi")
    x = small.select("k").distinct().withColumn("column", F.lit(KIND))
    return interpret.axis_or_other(small, profiles, x, K)


@query(f"""SELECT k, unnest(['x', 'value']) AS part, unnest(['{KIND}', '{NEXT.replace(chr(39), chr(39) * 2)}']) AS "column" FROM (SELECT DISTINCT p_partkey // 20 AS k FROM part)""")
def table_axis_and_value(spark, d):
    """The axis that the query names, and the value column of the year."""
    _, profiles = tables(spark, d)
    x = interpret.x_column(profiles, "by type", K).select("k", F.lit("x").alias("part"), "column")
    return x.union(interpret.value_column(profiles, K, KIND, year=2024).select("k", F.lit("value").alias("part"), "column"))


@query("""SELECT p_partkey // 20 AS k, (p_partkey % 20)::INT AS pos, unnest([2023, 2024]) AS x, p_brand AS series, unnest([p_retailprice, p_retailprice + 1])::DECIMAL(12,2)::DOUBLE AS value FROM part""")
def table_year_series(spark, d):
    """Year columns to points."""
    long, profiles = tables(spark, d)
    return interpret.year_series(long, interpret.year_columns(profiles, K), BRAND, K).select("k", "pos", "x", "series", "value")


@query("""SELECT p_partkey // 20 AS k, (p_partkey % 20)::INT AS pos, unnest([2023, 2024]) AS x, p_brand AS series, unnest([p_retailprice, p_retailprice + 1])::DECIMAL(12,2)::DOUBLE AS value FROM part WHERE p_type = 'PROMO'""")
def table_year_series_of_rows(spark, d):
    """Of chosen rows only."""
    long, profiles = tables(spark, d)
    rows = interpret.exact_filters(long, profiles, [("종류", "promo")], K)[0].select("k", "row_no").distinct()
    return interpret.year_series(long, interpret.year_columns(profiles, K), BRAND, K, rows).select("k", "pos", "x", "series", "value")


@query("""SELECT * FROM (SELECT p_partkey // 20 AS k, (p_partkey % 20)::INT AS row_no, unnest(['재산', '인명']) AS x, unnest([p_size, CASE WHEN p_size % 2 = 1 THEN p_size END])::DOUBLE AS value FROM part) WHERE value IS NOT NULL""")
def table_column_family(spark, d):
    """The columns of a family as categories."""
    long, profiles = tables(spark, d)
    return interpret.family_categories(long, interpret.column_families(profiles, K), "피해", K).select("k", "row_no", "x", "value")


@query("""SELECT p_partkey // 20 AS k, '| 구분 Brand | 종류 Type |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || p_brand || ' | ' || p_type || ' |', chr(10) ORDER BY p_partkey) AS table_md FROM part GROUP BY 1""")
def table_markdown(spark, d):
    """F16: a table as text."""
    return interpret.markdown(tables(spark, d)[0].where(F.col("column").isin(BRAND, KIND)), K)


@query("""WITH t AS (SELECT p_partkey // 20 AS k, p_partkey % 20 AS r, p_brand, p_size FROM part), f AS (SELECT k, min(r) AS first FROM t GROUP BY k)
SELECT t.k, (row_number() OVER (PARTITION BY t.k ORDER BY r) - 1)::INT AS row_no, p_brand AS text FROM t""")
def table_from_grid(spark, d):
    """Header rows joined to names, a header that repeats left out, data below."""
    p = read(spark, d, "part").select(F.expr("p_partkey div 20").alias("k"), (F.col("p_partkey") % 20).cast("int").alias("at"), "p_brand", F.col("p_size").cast("string").alias("n"))
    cell = lambda r, c, t: F.struct(r.cast("int").alias("r"), F.lit(c).alias("c"), t.alias("text"))
    data = p.select("k", F.inline(F.array(cell(F.col("at") + 2, 0, F.col("p_brand")), cell(F.col("at") + 2, 1, F.col("n")), cell(F.col("at") + 2, 2, F.col("n")))))
    lit = lambda r, c, t: cell(F.lit(r), c, F.lit(t))
    again = [lit(40, 0, "구분"), lit(40, 1, "값_남"), lit(40, 2, "값_여")]
    head = p.select("k").distinct().select("k", F.inline(F.array(lit(0, 0, "구분"), lit(0, 1, "값"), lit(0, 2, "값"), lit(1, 0, "구분"), lit(1, 1, "남"), lit(1, 2, "여"), *again)))
    long = interpret.grid_cells(data.unionByName(head), K)
    return long.where("column = '구분'").select("k", "row_no", "text")


@query("SELECT 'label' AS left_column, 'spelled' AS right_column, count(*)::INT AS n_shared FROM nation")
def table_key_choice(spark, d):
    """The columns by which two tables share most keys."""
    n = read(spark, d, "nation")

    def table(**columns) -> tuple[DataFrame, DataFrame]:
        listed = F.array(*[F.struct(F.lit(i).alias("col_no"), F.lit(name).alias("column"), c.cast("string").alias("text")) for i, (name, c) in enumerate(columns.items())])
        long = n.select(F.lit(0).alias("k"), F.col("n_nationkey").alias("row_no"), F.inline(listed)).withColumns({"number": parse_number(F.col("text")), "year": parse_year(F.col("text"))})
        return long, cells.profile(long, K)

    name = F.col("n_name")
    chosen, shared = interpret.choose_keys([table(label=name, value=F.col("n_nationkey")), table(constant=F.lit("x"), spelled=F.lower(F.concat(F.lit(" "), name, F.lit(" "))), value=F.col("n_nationkey"))])
    return spark.createDataFrame([(*chosen, shared)], "left_column string, right_column string, n_shared int")


@query("""SELECT l_orderkey AS stat_id, l_linenumber AS priority, l_returnflag AS path, l_partkey AS rank FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_returnflag, l_partkey) AS n FROM lineitem) WHERE n = 1""")
def search_best_source(spark, d):
    """By what each statistic was found best."""
    rows = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("stat_id"), F.col("l_linenumber").alias("priority"), F.col("l_returnflag").alias("path"), F.col("l_partkey").alias("rank"))
    return search.best_source(rows)


@query("""SELECT p_partkey, CASE WHEN contains(p_name, 'red bolt') THEN p_name WHEN contains(p_name, 'red') AND contains(p_name, 'bolt') THEN p_name
 WHEN contains(p_name, 'red') OR contains(p_name, 'bolt') THEN p_name WHEN length(p_name) >= length(p_brand) THEN p_name ELSE p_brand END AS label,
 contains(p_name, 'red') AND contains(p_name, 'bolt') AS exact, (contains(p_name, 'red')::INT + contains(p_name, 'bolt')::INT) / 2.0 AS coverage FROM part""")
def search_best_label(spark, d):
    """the label that holds most of the words."""
    best = search.best_label(F.array("p_name", "p_brand"), ["red", "bolt"])
    return read(spark, d, "part").select("p_partkey", best.alias("b")).select("p_partkey", "b.label", "b.exact", "b.coverage")


@query("""WITH t AS (SELECT p_partkey, string_split(p_name, ' ') AS w, p_name FROM part) SELECT p_partkey, 0.1::DOUBLE / (abs(list_position(w, 'red') - list_position(w, 'bolt')) + 1) AS score FROM t WHERE list_contains(w, 'red') AND list_contains(w, 'bolt')""")
def search_cover_density(spark, d):
    """words that stand close together."""
    return read(spark, d, "part").select("p_partkey", F.explode(F.filter(F.array(search.cover_density(F.col("p_name"), ["red", "bolt"])), lambda s: s > 0)).alias("score"))


LOADED = """WITH f AS (SELECT o_orderkey FROM orders WHERE year(o_orderdate) = 1996 AND o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'),
o AS (SELECT o_orderkey FROM orders WHERE year(o_orderdate) = 1996 AND o_orderstatus = 'O')
"""


@query(LOADED + """SELECT 'publications' AS table_name, 2 AS n_rows UNION ALL SELECT 'statistics', (SELECT count(*) FROM f) + (SELECT count(*) FROM o)
UNION ALL SELECT 'stat_tables', count(*) FROM lineitem WHERE l_orderkey IN (SELECT * FROM f UNION ALL SELECT * FROM o)
UNION ALL SELECT 'contacts', count(*) FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderkey IN (SELECT * FROM o)""")
def edition_replace(spark, d):
    """K1, K2, K4: two editions loaded, one replaced by a part of it without contacts, read again from disk."""
    c, path = fixture(spark, d), scratch(spark, "editions")

    # What belongs to the two editions is met once, and not again for each check and each load.
    both = F.col("pub_id").isin(19960, 19961)
    statistics = written(c.statistics.where(both).withColumn("ordinal", F.lit(1)), "statistics")
    theirs = lambda df, name: written(df.join(shuffled(statistics.select("stat_id", "pub_id", "unit")), "stat_id"), name)
    publications, tables, contacts = written(c.publications.where(both), "publications"), theirs(c.stat_tables, "tables"), theirs(c.contacts, "contacts")

    def tables_of(pub_id: int, chosen=None) -> dict[str, DataFrame]:
        own = F.col("pub_id") == pub_id
        of = lambda df: df.where(own if chosen is None else own & chosen)
        return {"publications": publications.where(own), "statistics": of(statistics), "stat_tables": of(tables), "contacts": of(contacts)}

    loaded = spark.createDataFrame([], cat.SCHEMAS["publications"])
    cat.load_edition(loaded, tables_of(19960), path)
    cat.load_edition(loaded, tables_of(19961), path)
    part = tables_of(19960, F.col("unit") == "1-URGENT")
    part.pop("contacts")
    cat.load_edition(loaded, part, path, "replace")
    got = cat.Catalog.read(spark, path)
    count = lambda name: getattr(got, name).agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("n_rows"))
    # An annual edition is found by its period again.
    annual = got.publications.where("period = ''").agg(F.lit("publications").alias("table_name"), F.count(F.lit(1)).alias("n_rows"))
    return annual.union(count("statistics")).union(count("stat_tables")).union(count("contacts"))


EDITIONS = """WITH e AS (SELECT year(o_orderdate) AS y, 'customer' || o_custkey AS match_key, 'Customer ' || o_custkey AS title, o_orderkey, o_orderpriority AS unit, 'M' || month(o_orderdate) AS chapter FROM orders WHERE o_orderstatus = 'F'),
i AS (SELECT *, count(*) OVER (PARTITION BY y, match_key) AS record_count, row_number() OVER (PARTITION BY y, match_key ORDER BY o_orderkey) AS n FROM e),
b AS (SELECT * FROM i WHERE y = 1997 AND n = 1), t AS (SELECT * FROM i WHERE y = 1998 AND n = 1) """


def spaced(spark, d) -> cat.Catalog:
    """The catalogue with departments spelled otherwise in one of the editions."""
    c = fixture(spark, d)
    odd = c.statistics.where(F.col("year") % 2 == 1).select(F.col("stat_id").alias("_s"))
    contacts = c.contacts.join(odd, F.col("stat_id") == F.col("_s"), "left").withColumn("dept", F.when(F.col("_s").isNull(), F.col("dept")).otherwise(F.concat(F.substring("dept", 1, 2), F.lit(" · "), F.lower(F.substring("dept", 3, 100))))).drop("_s")
    return cat.Catalog(c.publications, c.statistics, c.stat_tables, c.footnotes, contacts)


@query(EDITIONS + """SELECT b.match_key, b.title AS base_statistic_title, t.title AS target_statistic_title, b.unit AS base_unit, t.unit AS target_unit, b.record_count AS base_record_count, t.record_count AS target_record_count, 'unit' AS changed_fields
FROM b JOIN t ON b.match_key = t.match_key WHERE b.unit <> t.unit ORDER BY b.o_orderkey, b.match_key LIMIT 40 OFFSET 10""")
def compare_page(spark, d):
    """A page of changes, in the order of the base edition; departments that are only spelled otherwise tell none."""
    page = compare.compare_page(spaced(spark, d), "changed", kind="F", base=1997, target=1998, fields=["statistic_title", "unit"], compare_fields=["unit", "organization", "stat_id"], limit=40, offset=10)
    return page.rows.withColumn("changed_fields", F.array_join("changed_fields", ","))


@query(EDITIONS + """SELECT (SELECT count(*) FROM b JOIN t ON b.match_key = t.match_key) AS total, (SELECT count(*) > 25 FROM b JOIN t ON b.match_key = t.match_key) AS truncated,
(SELECT CASE WHEN count(*) > 25 THEN 25 END FROM b JOIN t ON b.match_key = t.match_key) AS next_offset""")
def compare_paging(spark, d):
    """What a page is a part of, and where the next begins."""
    p = compare.compare_page(fixture(spark, d), "in_both", kind="F", base=(1997, ""), target=1998, limit=25)
    return spark.createDataFrame([(p.total, p.truncated, p.next_offset)], "total long, truncated boolean, next_offset int")


@query("SELECT p_partkey, array_to_string(list_sort(list_distinct(regexp_extract_all(lower(p_name || ' ' || p_brand || ' ' || p_type), '[a-z0-9]+'))), ' ') AS search_doc FROM part")
def search_doc_build(spark, d):
    """K5: the words by which a statistic is found."""
    return read(spark, d, "part").select("p_partkey", F.array_join(cat.search_doc("p_name", "p_brand", "p_type"), " ").alias("search_doc"))


@query("SELECT label AS profile_key, min(vec_id) AS first_user FROM embeddings GROUP BY 1 UNION ALL SELECT DISTINCT quality + 1000, -1 FROM labels")
def profile_insert(spark, d):
    """K9: profiles that are there stay as they are, new ones come once."""
    there = read(spark, d, "embeddings").groupBy(F.col("label").cast("long").alias("profile_key")).agg(F.min("vec_id").alias("first_user"))
    new = read(spark, d, "labels").select((F.col("quality") + 1000).cast("long").alias("profile_key"), F.lit(-1).cast("long").alias("first_user"))
    again = there.select("profile_key", F.lit(-1).cast("long").alias("first_user"))
    return cat.add_profiles(there, new.union(again))


@query("""SELECT o_orderkey AS stat_id, 'Customer ' || o_custkey AS title_text, 'M' || month(o_orderdate) || ' D' || day(o_orderdate) AS hierarchy_text FROM orders""")
def embedding_texts(spark, d):
    """the texts of which vectors are made."""
    s = fixture(spark, d).statistics.withColumn("title_en", F.col("title_ko"))
    return s.select("stat_id", cat.title_text().alias("title_text"), cat.hierarchy_text().alias("hierarchy_text"))


@query("""SELECT o_orderkey AS stat_id FROM orders WHERE o_orderstatus IN ('F', 'O') AND year(o_orderdate) = 1998""")
def rows_in_editions(spark, d):
    """Rows of the editions in scope."""
    c = fixture(spark, d)
    return cat.in_editions(c.statistics, c.publications, ("F", "O"), 1998).select("stat_id")


@query("SELECT o_orderkey AS stat_id FROM orders WHERE o_orderkey > 100 AND o_orderkey <= (SELECT max(o_orderkey) FROM orders) ORDER BY 1 LIMIT 50")
def keyset_page(spark, d):
    """The page that follows an id."""
    s = fixture(spark, d).statistics
    return cat.page_after(s.select("stat_id"), "stat_id", 100, s.agg(F.max("stat_id")).first()[0], 50)


@query("SELECT event_id, user_id FROM events ORDER BY event_id DESC LIMIT 30")
def newest_events(spark, d):
    """The newest rows of a log."""
    return cat.newest_first(read(spark, d, "events").select("event_id", "user_id"), "event_id", limit=30)


UNITS = "(SELECT o_custkey::VARCHAR AS ref_id, month(o_orderdate) AS chapter_no, 'Title ' || (o_orderkey % 50) AS title_ko, year(o_orderdate) AS doc FROM orders) u"


@query(f"""SELECT doc::INT AS doc, 'duplicate_ref_id' AS fault, ref_id, count(*)::VARCHAR AS detail FROM {UNITS} GROUP BY 1, 3 HAVING count(*) > 1
UNION ALL SELECT doc::INT, 'without_chapter', ref_id, chapter_no::VARCHAR FROM {UNITS} WHERE chapter_no > 6
UNION ALL SELECT doc::INT, 'duplicate_title', ref_id, chapter_no || '||' || replace(title_ko, ' ', '') FROM (SELECT *, count(*) OVER (PARTITION BY doc, chapter_no, title_ko) AS n FROM {UNITS}) WHERE n > 1""")
def unit_checks(spark, d):
    """Numbers and titles that repeat, and chapters without a name."""
    o = read(spark, d, "orders")
    u = o.select(
        F.year("o_orderdate").alias("doc"), F.col("o_custkey").cast("string").alias("ref_id"), F.month("o_orderdate").alias("chapter_no"), F.lit(None).cast("int").alias("section_no"), F.lit(None).cast("string").alias("section"),
        F.when(F.month("o_orderdate") <= 6, "named").alias("chapter"), F.concat(F.lit("Title "), F.col("o_orderkey") % 50).alias("title_ko"),
    )
    return parsing.unit_faults(u, u, ["doc"]).where("fault <> 'without_tables'")


@query("""WITH b AS (SELECT 'd' AS doc, c_name AS t, min(c_custkey::VARCHAR) AS body FROM customer WHERE c_nationkey <> 3 GROUP BY 2), c AS (SELECT 'd' AS doc, c_name AS t, min((c_custkey + c_nationkey)::VARCHAR) AS toc FROM customer WHERE c_nationkey <> 5 GROUP BY 2)
SELECT 'd' AS doc, CASE WHEN body IS NULL THEN 'toc_only' WHEN toc IS NULL THEN 'body_only' ELSE 'ref_mismatch' END AS difference, coalesce(b.t, c.t) AS title, toc AS toc_ref_id, body AS body_ref_id FROM b FULL JOIN c ON b.t = c.t WHERE body IS NULL OR toc IS NULL OR body <> toc""")
def contents_against_body(spark, d):
    """Contents and body compared by titles."""
    c = read(spark, d, "customer").withColumn("doc", F.lit("d"))
    body = c.where("c_nationkey <> 3").select("doc", F.col("c_custkey").cast("string").alias("ref_id"), F.col("c_name").alias("title_ko"))
    toc = c.where("c_nationkey <> 5").select("doc", (F.col("c_custkey") + F.col("c_nationkey")).cast("string").alias("ref_id"), F.col("c_name").alias("title_ko"))
    return parsing.reconcile(body, toc, ["doc"])


@query("""SELECT p_partkey, format('{:,}', (p_size * 1000)::BIGINT) AS whole, CASE WHEN p_retailprice >= 10000 THEN '만' END AS large FROM part""")
def numbers_as_text(spark, d):
    """thousands marked, and the unit in which a number may be shortened."""
    n = (F.col("p_size") * 1000).cast("double")
    size = requests.compact_unit(F.col("p_retailprice"))
    return read(spark, d, "part").select("p_partkey", requests.number_text(n).alias("whole"), F.when(size == 10**4, "만").alias("large"))
