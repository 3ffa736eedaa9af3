"""Archives as a data source, whole documents as editions, and loading of many editions at once."""

import io
import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyloom.plans import document_queries as dq
from tallyloom.sources import archive, documents
from tallyloom.sources import catalog as cat

P, T = dq.paragraph, dq.table


def book() -> bytes:
    front = [T(["앞표지", "가"]), T(["1", "인구 Population"], ["제 1 절 주민 3", ""], ["1-1-1 세대 4", ""], ["1-1-2 인구 5", ""], ["1. 남자 5", ""], ["2. 여성 6", ""])]
    body = [
        T(["목차 다음", "나"]), P("", True), T(["제 1 절"], ["주민등록"], ["Residents"]), P("주1) 표제가 없는 주석"),
        T(["1-1-1 세대 현황"]), T(["구분", "수"], ["서울", "10"]), P("주1) 첫 주석"), P("- 이어짐"), P("주1) 첫 주석"), T(["구분", "수"], ["부산", "20"]), P("- 끊김"), P("* 주민과 홍길동 02-123-4567"),
        P("", True), T(["1-1-1 Households Status"]), P("* 주민과 홍길동 02-123-4567"), T(["1-1-2 인구 Population by Sex"]), T(["구분", "수"], ["묶음", "1"]),
        T(["1-1-2-1 남자 Men"]), T(["(2024.12.31. 기준, 단위 : 명)"], ["구분", "수"], ["합계", "5"], spans={0: 2}), T(["1-1-2-2 여자 Women"]),
        T(["발행처", "가"], ["인 쇄", "나"]), T(["1-1-3 뒤의 것 Later"]),
    ]
    return dq.zipped(front, body)


def half_year() -> bytes:
    body = [
        P("4"), P("주민등록"), P("4-1. 인구 현황 12"), P("5"), P("참고자료"), P("참고-1. 용어 30"), P("4"), P("주민등록"), P("인구 현황"), P("4-1"), P("('25.6.30.)"), P("❍ 총인구 : 51명"), P("❍ 지역"), P("(단위 : 명)"), T(["구분", "수"], ["서울", "9"]), P("주1) 설명"), P("세대 현황"), P("4-2"), P("한 줄"),
        P("5"), P("참고자료"), P("용어"), P("참고-1"), P("풀이"),
    ]
    return dq.zipped(body)


@pytest.fixture(scope="module")
def blocks(spark):
    files = spark.createDataFrame([("a", book()), ("b", book()), ("none", None)], "doc string, content binary")
    return archive.archive_blocks(files, "doc").withColumnRenamed("path", "doc")


def test_archives_as_a_data_source(spark, tmp_path):
    for k in (1, 2, 3):
        (tmp_path / f"{k}.hwpx").write_bytes(book() if k < 3 else dq.zipped([]))
    spark.dataSource.register(archive.ArchiveSource)
    got = spark.read.format("hwpx").load(str(tmp_path))
    assert got.rdd.getNumPartitions() == 3
    same = archive.read_blocks(spark, str(tmp_path)).withColumn("path", F.regexp_replace("path", "^file:", ""))
    rows = lambda df: sorted((r["path"], r["block_no"], r["page"], r["kind"], r["text"], [c["text"] for c in r["cells"] or []]) for r in df.collect())
    assert rows(got) == rows(same) and len(rows(got)) == 2 * 22
    assert spark.read.format("hwpx").load(str(tmp_path / "nothing")).count() == 0


def test_yearbook(blocks):
    parts = documents.yearbook(blocks)
    stats = {r["ref_id"]: r for r in parts["statistics"].where("doc = 'a'").collect()}
    assert list(stats) == ["1-1-1", "1-1-2-1", "1-1-2-2"] and [s["ordinal"] for s in stats.values()] == [1, 2, 3]
    one, men = stats["1-1-1"], stats["1-1-2-1"]
    assert (one["chapter"], one["section"], one["title_ko"], one["title_en"], one["page_start"]) == ("인구", "주민등록", "세대 현황", "Households Status", 2)
    assert (men["level3_title"], men["level4_title"], men["title_ko"], men["unit"], men["base_date"]) == ("인구", "남자", "남자", "명", "2024.12.31.")
    tables = parts["stat_tables"].where("doc = 'a'").orderBy("ref_id", "seq").collect()
    assert [(t["ref_id"], t["seq"]) for t in tables] == [("1-1-1", 1), ("1-1-1", 2), ("1-1-2-1", 1)]
    assert json.loads(tables[2]["body"]) == {"columns": ["구분", "수"], "records": [{"구분": "합계", "수": "5"}]}
    assert [(n["ref_id"], n["seq"], n["content"]) for n in parts["footnotes"].where("doc = 'a'").collect()] == [("1-1-1", 1, "주1) 첫 주석 - 이어짐"), ("1-1-1", 2, "주1) 첫 주석")]
    assert [(c["ref_id"], c["dept"], c["phone"]) for c in parts["contacts"].where("doc = 'b'").collect()] == [("1-1-1", "주민과", "02-123-4567")]
    faults = {(r["fault"], r["ref_id"]) for r in parts["faults"].where("doc = 'a'").collect()}
    assert faults == {("table_without_heading", None), ("table_without_heading", "1-1-2"), ("without_tables", "1-1-2-2")}
    assert {(r["difference"], r["title"]) for r in parts["differences"].where("doc = 'a'").collect()} == {("toc_only", "세대"), ("body_only", "세대 현황"), ("toc_only", "여성"), ("body_only", "여자")}


def test_section_files_in_pieces(monkeypatch):
    whole = list(archive.blocks_of(book()))
    for n in (1, 7, 300):
        monkeypatch.setattr(archive, "PIECE", n)
        assert list(archive.blocks_of(book())) == whole and len(whole) == 22
    read = []

    class Noted(io.BytesIO):
        def read(self, n=-1):
            read.append(n)
            return super().read(n)

    xml = (dq.NAMES + P("one") + P("two") * 50 + "</hs:sec>").encode()
    # The first block is there before the file is read to its end.
    assert next(iter(archive.section_blocks(Noted(xml), True))) == ("paragraph", "one") and sum(read) < len(xml) / 2
    with pytest.raises(SyntaxError):
        list(archive.section_blocks(io.BytesIO(xml[:-5]), True))


def test_tables_are_read_from_written_grids(blocks, monkeypatch):
    made, write = {}, documents.written

    def noted(df, label):
        made[label] = df.inputFiles()
        return write(df, label)

    monkeypatch.setattr(documents, "written", noted)
    documents.yearbook(blocks)
    assert not [f for f in made["bodies"] if "/body-" in f or "/units-" in f] and [f for f in made["bodies"] if "/grid-" in f]


def test_half_yearly_collection(spark):
    rows = archive.archive_blocks(spark.createDataFrame([("h", half_year())], "doc string, content binary"), "doc").withColumnRenamed("path", "doc").withColumn("year", F.lit(2025))
    parts = documents.major_statistics(rows)
    got = {r["ref_id"]: r for r in parts["statistics"].collect()}
    assert list(got) == ["4-1-1", "4-1-2", "4-2", "참고-1"]
    assert (got["4-1-2"]["title_ko"], got["4-1-2"]["unit"], got["4-1-2"]["base_date"], got["4-1-2"]["chapter"]) == ("인구 현황 지역", "명", "2025.6.30.", "주민등록")
    assert got["4-1-1"]["page_start"] == 12 and got["4-2"]["page_start"] == 1
    assert (got["참고-1"]["chapter_no"], got["참고-1"]["chapter"]) == (5, "참고자료")
    tables = {(r["ref_id"], r["n_cols"]): json.loads(r["body"])["records"] for r in parts["stat_tables"].collect()}
    assert tables[("4-1-2", 2)] == [{"구분": "서울", "수": "9"}] and tables[("4-2", 1)] == [{"내용": "한 줄"}]
    assert [(r["ref_id"], r["content"]) for r in parts["footnotes"].collect()] == [("4-1-2", "주1) 설명")]


def test_many_editions_at_once(spark, blocks, tmp_path):
    parts = {k: v for k, v in documents.yearbook(blocks).items() if k not in ("faults", "differences")}
    pubs = spark.createDataFrame(pd.DataFrame({"doc": ["a", "b"], "publication_kind": "yearbook", "year": [2024, 2025], "period": "", "title": ["A", "B"]}))
    out = documents.editions(pubs, parts, first_pub=10, first_stat=100)
    path = str(tmp_path / "editions")
    cat.load_editions(out, path)
    c = cat.Catalog.read(spark, path)
    assert sorted((r["pub_id"], r["year"], r["period"], r["title"]) for r in c.publications.collect()) == [(11, 2024, "", "A"), (12, 2025, "", "B")]
    ids = sorted((r["stat_id"], r["pub_id"], r["ref_id"]) for r in c.statistics.collect())
    assert [i[0] for i in ids] == list(range(101, 107)) and [i[1] for i in ids] == [11] * 3 + [12] * 3
    assert c.stat_tables.join(c.statistics, "stat_id").count() == 6 and c.stat_tables.select("table_id").distinct().count() == 6
    with pytest.raises(ValueError, match="loaded already"):
        cat.load_editions(out, path)
    bad = {**out, "publications": out["publications"].withColumn("year", F.lit(2030)), "statistics": out["statistics"].withColumns({"year": F.lit(2030), "title_ko": F.lit(" ")})}
    with pytest.raises(ValueError, match="comes more than once.*titles that lack"):
        cat.load_editions(bad, path)
    assert cat.Catalog.read(spark, path).publications.count() == 2
