import json

import pytest
from pyspark.sql import functions as F

from tallyloom.operators.compare import compare_editions
from tallyloom.plans import tools
from tallyloom.sources.catalog import SCHEMAS, Catalog


@pytest.fixture(scope="module")
def catalog(spark):
    def make(name, rows, cols):
        df = spark.createDataFrame(rows, ", ".join(f for f in SCHEMAS[name].split(", ") if f.split(" ")[0] in cols))
        return df.select(*[F.col(f.split(" ")[0]) if f.split(" ")[0] in cols else F.lit(None).cast(f.split(" ")[1]).alias(f.split(" ")[0]) for f in SCHEMAS[name].split(", ")])

    pubs = make("publications", [(1, "yearbook", "", 2024, "A"), (2, "yearbook", "", 2025, "B"), (3, "major_statistics", "H2", 2025, "C")], ["pub_id", "publication_kind", "period", "year", "title"])
    stats = make(
        "statistics",
        [(10, 1, 2024, "1-1", 1, "행정", "인구", [1.0, 0.0]), (20, 2, 2025, "1-1", 1, "행정", "인 구", [1.0, 0.0]), (21, 2, 2025, "1-2", 1, "행정", "재정", [0.0, 1.0]), (30, 3, 2025, "2-1", 1, "요약", "인구", [0.6, 0.8])],
        ["stat_id", "pub_id", "year", "ref_id", "chapter_no", "chapter", "title_ko", "embedding"],
    )
    body = json.dumps({"columns": ["지역", "값"], "records": [{"지역": "서울", "값": "1"}, {"지역": "부산", "값": "2"}]})
    tables = make("stat_tables", [(100, 20, 1, body)], ["table_id", "stat_id", "seq", "body"])
    contacts = make("contacts", [(1, 20, " ", "가"), (2, 20, "통계과", "나")], ["contact_id", "stat_id", "dept", "officer"])
    chunks = make("table_search_chunks", [(1, 20, 0, "labels", ["인구", "남자"], "인구 남자", [1.0, 0.0]), (2, 21, 0, "notes", ["x"], "인구 주석", [0.0, 1.0])], ["chunk_id", "stat_id", "chunk_no", "chunk_kind", "search_labels", "search_text", "embedding"])
    return Catalog(pubs, stats, tables, make("footnotes", [], []), contacts, chunks)


def test_search(catalog):
    rows = tools.search_statistics(catalog, "인구 알려줘", [1.0, 0.0]).rows.collect()
    ids = [r["stat_id"] for r in rows]
    assert ids[0] in (20, 30) and set(ids) == {20, 21, 30} and 10 not in ids
    first = next(r for r in rows if r["stat_id"] == 20)
    assert first["score"] == pytest.approx(1 / 11 + (3.0 / 11 + 0.05 + 0.04) + (1.8 / 11 + 0.04), abs=1e-6)  # labels that hold all words count more for words only
    assert first["edition"] == "2025년 통계연보"
    old = tools.search_statistics(catalog, "인구", [1.0, 0.0], kind="yearbook", year=2024)
    assert old.relaxed and {r["stat_id"] for r in old.rows.collect()} == {20, 21}


def test_contacts_and_tables(catalog):
    assert [r["contact_id"] for r in tools.search_contacts(catalog, 20).collect()] == [1, 2]
    assert tools.statistic(catalog, 20)["statistic"].first()["dept"] == "통계과"
    assert [r["record"]["값"] for r in tools.search_tables(catalog, 20, row_label="부산광역시").collect()] == ["2"]
    assert tools.search_tables(catalog, 20, 1).count() == 4


def test_compare(catalog):
    assert [r["match_key"] for r in compare_editions(catalog, "only_in_target").collect()] == ["재정"]
    assert compare_editions(catalog, "summary", "chapters").first()["in_both"] == 1


def test_charts(spark):
    rows = spark.createDataFrame([(0, "a", 1.0), (1, "b", 3.0), (2, "합계", 4.0)], "pos int, x string, v double")
    ring = {r["x"]: r["share"] for r in tools.chart(rows, "x", ["v"], "pos", "ring").collect()}
    assert ring == {"a": 0.25, "b": 0.75}
    two = tools.chart_of_sources({"p": (rows, "x", "v"), "q": (rows.where("x = 'a'"), "x", "v")})
    assert {(r["key"], r["q"]) for r in two.collect()} == {("a", 1.0), ("b", None), ("합계", None)}
