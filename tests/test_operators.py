import io
import json
import zipfile

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyloom.operators import analyze, cells, charts, chunks, compare, derive, search
from tallyloom.plans import table_queries  # noqa: F401
from tallyloom.plans.queries import ORACLES, QUERIES
from tallyloom.sources import archive, catalog
from tallyloom.streaming import progress

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(df: pd.DataFrame) -> list:
    def one(v):
        if v is None or v is pd.NaT or (not isinstance(v, (list, dict)) and pd.isna(v)):
            return None
        return round(float(v), 6) if isinstance(v, (int, float)) or hasattr(v, "dtype") and v.dtype.kind in "iuf" else str(v)

    df = df[sorted(df.columns)].astype(object)
    return sorted((tuple(map(one, r)) for r in df.values.tolist()), key=str)


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, data, duck, name):
    got, want = QUERIES[name](spark, data).toPandas(), duck.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


def test_choose_editions():
    e = [(2025, "H2"), (2025, "H1"), (2024, "")]
    assert compare.choose_editions(e, None, None) == ((2025, "H1"), (2025, "H2"))
    assert compare.choose_editions(e, (2024, ""), None) == ((2024, ""), (2025, "H1"))
    assert compare.choose_editions(e, None, (2025, "H1")) == ((2024, ""), (2025, "H1"))
    with pytest.raises(ValueError):
        compare.choose_editions(e, (2025, "H2"), None)


def test_request_is_checked(spark, data):
    from tallyloom.plans.queries import fixture

    c = fixture(spark, data)
    for bad in ({"operation": "x"}, {"operation": "breakdown"}, {"operation": "list", "limit": 501}, {"operation": "count", "subject": "x"}, {"operation": "list", "fields": ["nope"]}):
        with pytest.raises(ValueError):
            analyze.analyze(c, **bad)
    assert analyze.analyze(c, "count", kind="F", chapter_no=13).relaxed


def body(columns, rows):
    return json.dumps({"columns": columns, "records": [dict(zip(columns, r, strict=True)) for r in rows]})


def test_cells_profile_and_rows(spark):
    t = spark.createDataFrame([(1, body(["지역", "연도", "인구"], [["서 울", "2023", "1,000"], ["부산광역시", "2024", "-"], ["합계", "2024", "(5)"]]))], "stat_id int, body string")
    long = cells.cells(t, ["stat_id"])
    p = {r["column"]: r for r in cells.profile(long, ["stat_id"]).collect()}
    assert p["연도"]["is_year"] and p["인구"]["is_numeric"] and p["지역"]["is_categorical"]
    hit = cells.rows_by_label(long, ["stat_id"], "부산").collect()
    assert [h["row_no"] for h in hit] == [1] and hit[0]["record"]["인구"] == "-"


def test_merge_parts(spark):
    rows = [(1, 1, body(["a", "b"], [["x", "1"]])), (1, 2, body(["a", "b"], [["y", "2"]])), (2, 1, body(["a", "b"], [["x", "1"]])), (2, 2, body(["a", "c"], [["x", "9"]]))]
    long = cells.cells(spark.createDataFrame(rows, "stat_id int, table_seq int, body string"), ["stat_id", "table_seq"])
    got = {(r["stat_id"], r["row_no"], r["col_no"]): r["text"] for r in cells.merge_parts(long).collect()}
    assert got[1, 1, 0] == "y" and got[1, 1, 1] == "2" and got[2, 0, 3] == "9" and len(got) == 4 + 3


def test_fold_blocks(spark):
    t = spark.createDataFrame([(1, body(["a", "17"], [["x", "1"], ["y", "2"], ["a", "17"], ["x", "3"], ["y", "4"]]))], "stat_id int, body string")
    got = cells.fold_blocks(cells.cells(t, ["stat_id"]), ["stat_id"]).where("block = 1 AND col_no = 1").orderBy("row_no").collect()
    assert [(r["row_no"], r["text"]) for r in got] == [(0, "3"), (1, "4")]


def test_header_names(spark):
    g = spark.createDataFrame([(1, 0, 0, "a"), (1, 1, 0, "b"), (1, 0, 1, "a"), (1, 1, 1, "b"), (1, 2, 1, "data")], "k int, r int, c int, text string")
    assert [r["column"] for r in cells.header_names(g, ["k"], F.lit(2)).orderBy("c").collect()] == ["a_b", "a_b_2"]


def test_labels_apart(spark):
    r = spark.createDataFrame([("g", 0, 1.0, 10.0), ("g", 1, 1.5, 20.0), ("g", 2, 9.0, 1.0)], "g string, pos bigint, y double, size double")
    assert [x["pos"] for x in charts.keep_apart(r, "g", "y", "size", 1.0).orderBy("pos").collect()] == [1, 2]


def test_derive(spark):
    quota = spark.createDataFrame([("서울", 10.0, 0), ("서 울", 20.0, 1), ("부산", 5.0, 2), ("전국", 35.0, 3)], "`지역` string, `정원` double, pos int")
    people = spark.createDataFrame([("서울특별시", 300.0, 0), ("부산광역시", 0.0, 1)], "`지역` string, `인구` double, pos int")
    a, b = derive.series_points(quota, "지역", "정원"), derive.series_points(people, "지역", "인구")
    assert [(r["key"], r["value"]) for r in derive.derive("share", a, b).collect()] == [("서울", 10.0)]
    df = spark.createDataFrame([(0.00002,), (0.5,), (0.05,), (0.0,)], "m double")
    assert [r[0] for r in df.select(derive.auto_scale(F.col("m"))).collect()] == [100_000, 1, 1_000, 1]


def test_cover_density(spark):
    df = spark.createDataFrame([("a x b",), ("b a a b",), ("a",)], "t string")
    assert [round(r[0], 4) for r in df.select(search.cover_density(F.col("t"), ["a", "b"])).collect()] == [round(0.1 / 3, 4), 0.1, 0.0]


def test_chunks(spark):
    df = spark.createDataFrame([(1, " T ", ["aa", "AA", "bbb", "1", "cc"])], "k int, h string, l array<string>")
    assert [r["search_text"] for r in chunks.chunks(df, "k", "h", "labels", "l", 10).orderBy("chunk_no").collect()] == ["T aa | bbb", "T cc"]


def test_archive(spark, tmp_path):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("Contents/section10.xml", '<s xmlns="u"><p pageBreak="1"><run><t>last</t></run></p></s>')
        z.writestr("Contents/section2.xml", '<s xmlns="u"><p><run><t>first</t><tbl><tr><tc><cellAddr rowAddr="0" colAddr="0"/><cellSpan rowSpan="1" colSpan="2"/><subList><p><run><t>head</t></run></p></subList></tc></tr></tbl></run></p></s>')
    (tmp_path / "a.hwpx").write_bytes(b.getvalue())
    got = archive.read_blocks(spark, str(tmp_path)).orderBy("block_no").collect()
    assert [(r["kind"], r["text"], r["page"]) for r in got] == [("paragraph", "first", 1), ("table", None, 1), ("paragraph", "last", 2)]
    grid = cells.expand_spans(spark.createDataFrame(got).where("kind = 'table'").select("path", F.explode("cells").alias("c")).select("path", "c.*"), ["path"])
    assert sorted((r["r"], r["c"], r["text"]) for r in grid.collect()) == [(0, 0, "head"), (0, 1, "head")]


def test_loading(spark, tmp_path):
    pub = spark.createDataFrame([(1, "yearbook", "", 2024, None, "t", 3)], catalog.SCHEMAS["publications"])
    s = spark.createDataFrame([(10, 1, "r1"), (11, 1, "r2")], "stat_id bigint, pub_id int, ref_id string")
    catalog.load_edition(spark.createDataFrame([], catalog.SCHEMAS["publications"]), {"publications": pub, "statistics": s}, str(tmp_path))
    assert catalog.read_table(spark, str(tmp_path), "statistics").count() == 2
    with pytest.raises(ValueError):
        catalog.load_edition(pub, {"publications": pub, "statistics": s}, str(tmp_path))
    catalog.load_edition(pub, {"publications": pub, "statistics": s.limit(1)}, str(tmp_path), "replace")
    assert catalog.read_table(spark, str(tmp_path), "statistics").count() == 1
    ids = catalog.assign_ids(spark.range(100).withColumnRenamed("id", "n"), ["n"], "stat_id", 5).orderBy("n").collect()
    assert [r["stat_id"] for r in ids] == list(range(6, 106))


def test_versions_of_editions(spark, tmp_path):
    """Readers see whole editions: a broken load, a replacement and a removal change all tables at once, and an older state stays readable until the files are cleared."""
    path, none = str(tmp_path), spark.createDataFrame([], catalog.SCHEMAS["publications"])

    def tables(pub_id, year, stat_ids, note=None):
        pub = spark.createDataFrame([(pub_id, "yearbook", "", year, None, "t", 3)], catalog.SCHEMAS["publications"])
        s = spark.createDataFrame([(i, pub_id, f"r{i}", f"title {i}") for i in stat_ids], "stat_id bigint, pub_id int, ref_id string, title_ko string")
        notes = spark.createDataFrame([(i * 10, i, 1, "1", note) for i in stat_ids], catalog.SCHEMAS["footnotes"])
        return {"publications": pub, "statistics": s, "footnotes": notes}

    def state(c):
        return sorted((r["stat_id"], r["content"]) for r in c.statistics.join(c.footnotes, "stat_id", "left").collect()), c.publications.count()

    catalog.load_edition(none, tables(1, 2024, [10, 11], "old"), path)
    before = catalog.Catalog.read(spark, path)
    assert state(before) == ([(10, "old"), (11, "old")], 1)
    # A load whose last table fails leaves its children under a version to which nothing points.
    fail = F.udf(lambda x: 1 // 0, "int")
    broken = tables(1, 2024, [10, 12, 13], "broken")
    broken["publications"] = broken["publications"].withColumn("page_count", fail("page_count"))
    with pytest.raises(Exception, match="ZeroDivisionError"):
        catalog.load_edition(none, broken, path, "replace")
    assert state(catalog.Catalog.read(spark, path)) == ([(10, "old"), (11, "old")], 1)
    # Ids of another edition are refused, those of the replaced one are not.
    with pytest.raises(ValueError, match="ids of footnotes are taken; ids of publications are taken; ids of statistics are taken"):
        catalog.load_edition(none, tables(1, 2025, [11, 20], "other"), path)
    catalog.load_edition(none, tables(2, 2025, [20], "other"), path)
    replaced = tables(1, 2024, [11], "new")
    replaced.pop("footnotes")
    catalog.load_edition(none, replaced, path, "replace")
    assert state(catalog.Catalog.read(spark, path)) == ([(11, None), (20, "other")], 2) and state(before) == ([(10, "old"), (11, "old")], 1)
    many = {k: v.withColumns({"publication_kind": F.lit("yearbook"), "year": F.lit(2026), "period": F.lit("")}) for k, v in tables(3, 2026, [20], "many").items()}
    with pytest.raises(ValueError, match="ids of footnotes are taken; ids of statistics are taken"):
        catalog.load_editions(many, path)
    catalog.remove_edition(spark, path, "yearbook", 2025)
    assert state(catalog.Catalog.read(spark, path)) == ([(11, None)], 1)
    catalog.load_editions(many, path)
    now = ([(11, None), (20, "many")], 2)
    assert state(catalog.Catalog.read(spark, path)) == now
    # Of the dead versions: two old editions' tables, and what the broken load had written before it failed.
    assert catalog.vacuum(spark, path) == 3 + 3 + 2 and state(catalog.Catalog.read(spark, path)) == now and catalog.vacuum(spark, path) == 0
    scan = catalog.read_table(spark, path, "statistics")._jdf.queryExecution().toString()
    assert "PartitionFilters: [concat_ws(" in scan


def test_vectors_are_kept_and_put(spark):
    s = spark.createDataFrame([(1, None, "a", [1.0], "p")], "year int, period string, ref string, embedding array<float>, embedding_profile_key string")
    v = spark.createDataFrame([(1, None, "a", [2.0], "q")], s.schema)
    assert catalog.update_vectors(s, v, ["year", "period", "ref"]).first()["embedding"] == [2.0]
    assert catalog.stale_vectors(s, "p").count() == 0 and catalog.stale_vectors(s, "q").count() == 1
    new = s.withColumn("ref", F.lit("b"))
    assert catalog.keep_vector_if_same(s, new, "year", ["ref"]).first()["embedding"] is None


def test_progress_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    lines = [{"event_id": i, "job_id": "j", "status": s, "stage": "x", "progress": i, "message": "m"} for i, s in enumerate(["running", "completed"])]
    (tmp_path / "in" / "a.json").write_text("\n".join(map(json.dumps, lines)))
    q = progress.follow(spark, str(tmp_path / "in"), "jobs_now", str(tmp_path / "check"))
    try:
        q.processAllAvailable()
        assert [(r["job_id"], r["status"], r["n_events"]) for r in spark.table("jobs_now").collect()] == [("j", "completed", 2)]
    finally:
        q.stop()
