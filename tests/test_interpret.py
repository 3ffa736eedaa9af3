"""Table interpretation, request rules and document parsing on small tables."""

import json

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import requests as rq
from tallyloom.operators import cells, interpret
from tallyloom.sources import parsing

K = ["k"]


def tables(spark, *bodies):
    rows = [(k, json.dumps({"columns": c, "records": [dict(zip(c, r, strict=True)) for r in rows]})) for k, (c, rows) in enumerate(bodies)]
    long = cells.cells(spark.createDataFrame(rows, "k int, body string"), K).cache()
    return long, cells.profile(long, K).cache()


@pytest.fixture(scope="module")
def two(spark):
    people = (["연도 Year", "지역 Region", "인 구 수 Population_계 Total", "인 구 수 Population_남 Male"], [["2023", "서 울 Seoul", "10", "4"], ["2023", "부산광역시", "5", "2"], ["2024", "서 울 Seoul", "12", "5"], ["2024", "부산광역시", "6", "3"]])
    years = (["구분", "'23", "'24", "'24_순위", "'23_순위"], [["서울", "1", "2", "7", "8"], ["부산", "3", "-", "9", "9"], ["합계", "4", "6", "1", "1"]])
    return tables(spark, people, years)


def test_resolve_columns(spark, two):
    asked = spark.createDataFrame([(0, "연도"), (0, "지역"), (0, "인구수_계"), (0, "남"), (0, "category"), (0, "합계"), (0, "없음"), (1, "구분"), (1, "date")], "k int, requested string")
    got = {(r["k"], r["requested"]): r["column"] for r in interpret.resolve_columns(two[1], asked, K).collect()}
    assert got[0, "연도"] == "연도 Year" and got[0, "지역"] == "지역 Region" and got[0, "인구수_계"] == "인 구 수 Population_계 Total" and got[0, "남"] == "인 구 수 Population_남 Male"
    assert got[0, "category"] == "지역 Region" and got[0, "합계"] == "인 구 수 Population_계 Total" and got[1, "구분"] == "구분" and (0, "없음") not in got and (1, "date") not in got


def test_resolve_values_and_filters(spark, two):
    long, profiles = two
    asked = spark.createDataFrame([(0, "지역 Region", "서울"), (0, "지역 Region", "부산"), (0, "지역 Region", "x"), (0, "연도 Year", "20")], "k int, column string, requested string")
    got = {r["requested"]: (r["value"], r["candidates"]) for r in interpret.resolve_values(long, asked, K).collect()}
    assert got == {"서울": ("서 울 Seoul", []), "부산": ("부산광역시", []), "x": (None, []), "20": (None, ["2023", "2024"])}
    one = long.where("k = 0"), profiles.where("k = 0")
    rows, notes = interpret.exact_filters(*one, [("지역", "서울"), ("지역", "x"), ("연도", "2024")], K)
    assert {r["row_no"] for r in rows.collect()} == {2} and {r["requested"] for r in notes.where("value IS NULL").collect()} == {"x"}
    assert interpret.exact_filters(*one, [("지역", "x")], K)[0].count() == 0 and interpret.exact_filters(*one, [("없음", "x")], K)[0].count() == 0


def test_select_rows(two):
    long, profiles = two
    rows = lambda **a: {(r["k"], r["row_no"]) for r in interpret.select_rows(long, profiles, K, **a).collect()}
    assert rows(year=2024) == {(0, 2), (0, 3), (1, 0), (1, 1), (1, 2)} and rows(year=1999) == {(1, 0), (1, 1), (1, 2)}
    assert rows(place="부산") == {(0, 1), (0, 3), (1, 1)} and rows(place="대구") == set()
    assert rows(query="서울 인구") == {(0, 0), (0, 1), (0, 2), (0, 3), (1, 0)}
    assert [(r["k"], r["row_no"]) for r in interpret.focus_row(long, "구분", "부산 추이", K).collect()] == [(1, 1)]


def test_columns_of_a_chart(two):
    long, profiles = two
    of = lambda df: {r["k"]: r["column"] for r in df.collect()}
    x = interpret.x_column(profiles, "지역별", K)
    assert of(x) == {0: "연도 Year", 1: "구분"}
    assert of(interpret.axis_or_other(interpret.rows_of_year(long, profiles, 2024, K), profiles, x, K)) == {0: "지역 Region", 1: "구분"}
    assert of(interpret.value_column(profiles, K, "연도 Year", query="남 male 수")) == {0: "인 구 수 Population_남 Male", 1: "'24"}
    assert of(interpret.value_column(profiles, K, "연도 Year", requested="인구수_계", year=2023)) == {0: "인 구 수 Population_계 Total", 1: "'23"}
    assert {(r["column"], r["header_year"]) for r in interpret.year_columns(profiles, K).collect()} == {("'23", 2023), ("'24", 2024)}
    assert {(r["metric"], r["header_year"]) for r in interpret.year_metrics(profiles, "", K).collect()} == {("순위", 2023), ("순위", 2024)}
    series = interpret.year_series(long, interpret.year_columns(profiles, K), "구분", K, totals=False)
    assert {(r["series"], r["x"], r["value"]) for r in series.collect()} == {("서울", 2023, 1.0), ("서울", 2024, 2.0), ("부산", 2023, 3.0)}
    family = interpret.column_families(profiles, K)
    assert {r["family"] for r in family.where("k = 0").collect()} == {"인 구 수 Population"}
    parts = interpret.family_categories(long, family, "인구", K).where("k = 0 AND row_no = 0").collect()
    assert [(r["x"], r["value"]) for r in parts] == [("남", 4.0)]
    first = long.where("k = 0 AND row_no = 0")
    assert {r["x"]: r["value"] for r in interpret.single_rows(first, profiles, K).collect()} == {"인구수": 10.0} or interpret.single_rows(first, profiles, K).count() == 2


def test_choose_keys(spark):
    a, pa = tables(spark, (["연도", "지역", "값"], [["2023", "서울", "1"], ["2023", "부산", "2"], ["2023", "전국", "3"]]))
    b, pb = tables(spark, (["구분", "시도", "값"], [["x", "서울특별시", "5"], ["y", "부산광역시", "6"], ["z", "합계", "7"]]))
    assert interpret.choose_keys([(a, pa), (b, pb)]) == (["지역", "시도"], 2)
    c, pc = tables(spark, (["n", "값"], [["p", "1"], ["q", "2"]]))
    assert interpret.choose_keys([(a, pa), (c, pc)]) is None


def test_chart_records(spark):
    r = spark.createDataFrame([(0, "2023", "서울", 1.0), (1, "2024", "서울", 2.0), (2, "2024", "부산", 3.0), (3, "2024", "합계", 5.0)], "pos int, x string, series string, value double")
    pos = lambda **a: sorted(x["pos"] for x in interpret.chart_records(r, **a).collect())
    assert pos() == [0, 1, 2] and pos(totals="include") == [0, 1, 2, 3] and pos(year=2024) == [1, 2] and pos(year=1999) == [0, 1, 2] and pos(query="부산 현황") == [2]


def test_grids(spark):
    flow = spark.createDataFrame([(1, 0, 0, 2, 1, "a"), (1, 0, 1, 1, 2, "b"), (1, 1, 0, 1, 1, "c"), (1, 1, 1, 1, 1, "d")], "k int, row int, seq int, row_span int, col_span int, text string")
    got = {(r["r"], r["c"]): r["text"] for r in interpret.flow_grid(flow, K).collect()}
    assert got == {(0, 0): "a", (1, 0): "a", (0, 1): "b", (0, 2): "b", (1, 1): "c", (1, 2): "d"}
    text = [["지역", "인구", "인구"], ["지역", "남", "여"], ["서울", "1", "2"], ["지역", "인구_남", "인구_여"], ["부산", "3", "4"]]
    grid = spark.createDataFrame([(1, r, c, t) for r, row in enumerate(text) for c, t in enumerate(row)], "k int, r int, c int, text string")
    long = interpret.grid_cells(grid, K)
    assert {(r["row_no"], r["column"], r["text"]) for r in long.collect()} == {(0, "지역", "서울"), (0, "인구_남", "1"), (0, "인구_여", "2"), (1, "지역", "부산"), (1, "인구_남", "3"), (1, "인구_여", "4")}
    assert interpret.markdown(long, K).first()["table_md"] == "| 지역 | 인구_남 | 인구_여 |\n| --- | --- | --- |\n| 서울 | 1 | 2 |\n| 부산 | 3 | 4 |"
    spans = spark.createDataFrame([(1, 0, 0, 3, "(단위: 명)"), (1, 1, 0, 1, "a"), (1, 1, 1, 1, "b")], "k int, row int, col int, col_span int, text string")
    assert [r["row"] for r in interpret.caption_rows(spans, K, F.lit(3)).collect()] == [0] == [r["row"] for r in interpret.caption_rows(spans, K, F.lit(3), False).collect()]
    assert {r["c"] for r in interpret.active_columns(spans, K).collect()} == {0, 1}


def test_requests():
    assert rq.query_year("2023년 인구") == 2023 and rq.query_year("2023, 2024") is None
    assert rq.total_mode("auto", "합계 포함해서") == "include" and rq.total_mode("exclude", "합계 포함") == "exclude" and rq.total_mode("auto", "소계 제외") == "exclude"
    for text, want in (("인구 많은 순", "descending"), ("값이 작은 것부터", "ascending"), ("큰 값부터 작은 값순", None), ("내림차순", "descending"), ("최소값부터", "ascending"), ("높은 지역", None), ("규모가 큰 대로", "descending"), ("큰 것부터", None), ("최대 수부터", None), ("최대로 정렬", None), ("큰 대로", None), ("높은 값순", "descending")):
        assert rq.sort_order("auto", text) == want, text
    for text, want in (("인구 10만 명당", 100_000), ("천 대당", 1000), ("1인당", 1), ("한 명당", 1), ("백만원 담당", None), ("100만 명당", 1_000_000)):
        assert rq.per_scale(text) == want, text
    assert rq.per_label(10_000) == "1만" and rq.per_label(1500) == "1,500"
    assert rq.derived_unit("per_capita", "명", "대", 1000) == "명/1천 대" and rq.derived_unit("ratio", "명", "명") == "배" and rq.derived_label("share", "a", "b") == "b 대비 a 비중"
    assert rq.column_unit("사망 인원", "명, 원", "?") == "명" and rq.column_unit("x", "명", "?") == "?"
    assert len(rq.operand_warnings("ratio", "인구", "천명", "2023.1.1.", "2024.1.1.")) == 2
    assert rq.metric_parts(["a_x", "a_y"]) == ["x", "y"] and rq.metric_parts(["a_x", "b_x"]) == ["a", "b"] and rq.metric_parts(["a", "b_x"]) == ["a", "b_x"]
    assert rq.distinct_labels(["p", "p", "q"], ["m_a", "m_b", "c"]) == ["p (a)", "p (b)", "q"]
    s = rq.Shape(True, False, True, 2, 3, False, True)
    assert rq.fitting_chart(s, "추이") == "slope" and rq.fitting_chart(s, "순위") == "bump" and rq.corrected_chart("donut", s) == "line" and rq.corrected_chart("slope", s) == "slope"
    assert rq.corrected_chart("line", rq.Shape(False, False, False, 3, 0, False, False)) == "bar" and rq.fitting_chart(rq.Shape(False, False, False, 3, 0, True, False), "") == "diverging_bar"


def test_numbers_as_text(spark):
    df = spark.createDataFrame([(1234.0,), (0.5,), (12.34,)], "v double")
    assert [r[0] for r in df.select(rq.number_text(F.col("v"))).collect()] == ["1,234", "0.5", "12.34"]
    big = spark.createDataFrame([(123_456_789.0,), (1_200_000_000.0,)], "v double")
    assert [r[0] for r in big.select(rq.compact_text(F.col("v"), rq.compact_unit(F.lit(123_456_789)))).collect()] == ["1.23억", "12.0억"]


def test_parsing_of_lines(spark):
    one = lambda fn, text: spark.createDataFrame([(text,)], "t string").select(fn(F.col("t")).alias("x")).first()["x"]
    assert one(parsing.base_date, "(2024. 12. 31. 기준, 단위 : 명)") == "2024.12.31." and one(parsing.unit, "(단위 : 천 명)") == "천 명" and one(parsing.unit, None) is None
    assert one(lambda c: parsing.full_base_date(c, F.lit(2025)), "('25.6.30.)") == "2025.6.30." and one(parsing.phone, "x 02)123-4567") == "02-123-4567"
    c = one(parsing.contact, "* 통계과 김 주무관 044-205-1234 / 시스템(내부) https://a.b/c")
    assert (c["dept"], c["officer"], c["phone"], c["source_url"]) == ("통계과", "김 주무관", "044-205-1234", "https://a.b/c") and c["source_system"].startswith("시스템")
    line = "• 지방 재정과 과장 김가 (044-205-1111), 주무관 이나 (044-205-2222)"
    got = one(parsing.contact_line, line)
    assert [(x["dept"], x["phone"]) for x in got] == [("지방 재정과", "044-205-1111"), ("지방 재정과", "044-205-2222")] and got[1]["officer"] == "주무관 이나"
    assert one(parsing.is_contact_line, line) and not one(parsing.is_contact_line, "• 전화 없음")
    t = one(parsing.split_title, "CCTV 운영 현황 CCTV Operations by Region")
    assert (t["ko"], t["en"]) == ("CCTV 운영 현황", "CCTV Operations by Region")
    h = one(parsing.heading, "1-2-3-4 인구 현황 Population")
    assert (h["level"], h["ref_id"], h["level4_no"], h["ko"], h["en"]) == (4, "1-2-3-4", 4, "인구 현황", "Population")
    h = one(parsing.heading, "부록 3 용어")
    assert (h["level"], h["ref_id"], h["chapter_no"], h["level3_no"], h["ko"]) == (3, "부록3", None, 3, "용어") and one(parsing.heading, "인구") is None
    assert one(parsing.title_carries_data, "인구 : 3명") and not one(parsing.title_carries_data, "개요")
    df = spark.createDataFrame([("서해 5도", "개요"), ("서해 5도", "서해5도 관광객"), ("서해 5도", None)], "a string, b string")
    assert [r[0] for r in df.select(parsing.composed_title(F.col("a"), F.col("b"))).collect()] == ["서해 5도 개요", "서해5도 관광객", "서해 5도"]
    i = one(parsing.item_id, "4 - 38")
    assert (i["ref_id"], i["chapter_no"], i["item_no"]) == ("4-38", 4, 38) and one(parsing.item_id, "참고-2")["ref_id"] == "참고-2"
    assert one(parsing.contents_line, "4-38. 서해 5도 123")["title"] == "서해 5도"


def test_items_and_units(spark):
    text = ["4", "지역", "서해 5도", "4-38", "('25.6.30.)", "❍ 인구 : 8,151명", "❍ 추진방향", "설명", "<관광객>", "(단위: 명)", None, "• 재정과 김가 044-205-1111", "다음 제목", "4-39", "내용", "5", "다른 장", "새 제목", "5-1", "❍ 개요"]
    blocks = spark.createDataFrame([("d", i, 1, "paragraph" if t else "table", t) for i, t in enumerate(text)], "doc string, block_no int, page int, kind string, text string")
    items = parsing.split_items(blocks, chapters=[4, 5])
    got = {r["block_no"]: (r["role"], r["item"]) for r in items.collect()}
    assert got[0] == ("cover", None) and got[1] == ("chapter", None) and got[2] == ("title", None) and got[3] == ("number", "4-38") and got[10] == ("body", "4-38")
    assert got[12][0] == "title" and got[14] == ("body", "4-39") and got[15][0] == "cover" and got[16] == ("chapter", None) and got[19] == ("body", "5-1")
    body = items.where("role = 'body' AND item IS NOT NULL")
    classified = parsing.classify(body, ["doc", "item"], F.lit(2025))
    kinds = {r["block_no"]: (r["class"], r["level3_title"], r["level4_title"]) for r in classified.collect()}
    assert kinds[4][0] == "base_date" and kinds[5] == ("level3", "인구 : 8,151명", None) and kinds[8] == ("level4", None, "관광객") and kinds[9][0] == "unit" and kinds[11][0] == "contact"
    units = {r["ref_id"]: r for r in parsing.units_of(classified, ["doc", "item"], "item", "item_title", F.lit(2025)).collect()}
    assert set(units) == {"4-38-1", "4-38-2", "4-38-3", "4-39"}
    assert units["4-38-1"]["lines"] == ["인구 : 8,151명"] and units["4-38-1"]["base_date"] == "2025.6.30." and units["4-38-3"]["unit"] == "명" and units["4-38-3"]["title_ko"] == "서해 5도 관광객" and units["4-39"]["lines"] == ["내용"]


def test_level4_below_an_empty_level3(spark):
    text = ["❍ 모금현황", "<기부 추이>", "내용", "<다른 표>", "더"]
    blocks = spark.createDataFrame([("d", "1-1", i, 1, "paragraph", t) for i, t in enumerate(text)], "doc string, item string, block_no int, page int, kind string, text string")
    got = parsing.classify(blocks, ["doc", "item"], F.lit(2025)).orderBy("block_no").collect()
    assert [(r["level3_title"], r["level4_title"]) for r in got] == [("모금현황", None), ("모금현황", "기부 추이"), ("모금현황", "기부 추이"), ("모금현황", "다른 표"), ("모금현황", "다른 표")]


def test_notes_and_outline(spark):
    text = ["주1) 첫째", "- 이어짐", "본문", "- 아님", "#주 둘째", "주1) 첫째", "- 이어짐"]
    got = parsing.notes(spark.createDataFrame([("s", i, t) for i, t in enumerate(text)], "s string, block_no int, text string"), ["s"]).orderBy("seq").collect()
    assert [(r["seq"], r["note_no"], r["content"]) for r in got] == [(1, "주1)", "주1) 첫째 - 이어짐"), (2, None, "주 둘째")]
    heads = ["1-1-1 인구 Population", "1-1-1-1 남자", "1-1-1-2 여자", "1-1-1-1 남자", "1-1-2 재정"]
    h = spark.createDataFrame([("d", i, i + 1, t) for i, t in enumerate(heads)], "doc string, block_no int, page int, t string").select("doc", "block_no", "page", parsing.heading(F.col("t")).alias("h"))
    chapters = spark.createDataFrame([("d", 1, "행정")], "doc string, chapter_no int, chapter string")
    sections = spark.createDataFrame([("d", 1, 1, "총괄")], "doc string, chapter_no int, section_no int, section string")
    units = parsing.unit_titles(parsing.outline(h, "doc", "block_no", chapters, sections))
    assert [(r["ordinal"], r["ref_id"], r["chapter"], r["section"], r["level3_title"], r["title_ko"]) for r in units.orderBy("ordinal").collect()] == [
        (1, "1-1-1-1", "행정", "총괄", "인구", "남자"), (2, "1-1-1-2", "행정", "총괄", "인구", "여자"), (3, "1-1-2", "행정", "총괄", "재정", "재정"),
    ]
    faults = parsing.unit_faults(units, spark.createDataFrame([("d", "1-1-2")], "doc string, ref_id string"), ["doc"])
    assert {(r["fault"], r["ref_id"]) for r in faults.collect()} == {("without_tables", "1-1-1-1"), ("without_tables", "1-1-1-2")}
    leaves = spark.createDataFrame([("d", "1-1-1-1", "남 자"), ("d", "9-9-9", "여자"), ("d", "2-1-1", "없음")], "doc string, ref_id string, title_ko string")
    assert {(r["difference"], r["title"]) for r in parsing.reconcile(units, leaves, ["doc"]).collect()} == {("ref_mismatch", "여자"), ("toc_only", "없음"), ("body_only", "재정")}
    lines = spark.createDataFrame([("d", 0, "제 1 절 총괄 3"), ("d", 1, "1-1-1 인구 Population 5"), ("d", 2, "1. 남자 6"), ("d", 3, "부록 2 용어 ?")], "doc string, line_no int, text string")
    got = parsing.contents(lines, "doc").orderBy("line_no").collect()
    assert [(r["kind"], r["ref_id"], r["title"], r["page"]) for r in got] == [("section", None, "총괄", 3), ("level3", "1-1-1", "인구", 5), ("level4", "1-1-1-1", "남자", 6), ("appendix", "부록2", "용어", None)]
