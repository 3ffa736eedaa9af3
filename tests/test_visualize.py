"""Charts planned from profiles: kinds, corrections, refusals, and several tables by shared keys."""

import pytest

from tallyloom.functions import requests
from tallyloom.functions.numbers import parse_number, parse_year
from tallyloom.operators import charts
from tallyloom.plans import visualize as v


def source(spark, columns, rows, **more):
    cells = [(n, k, c, str(r[k])) for n, r in enumerate(rows) for k, c in enumerate(columns)]
    df = spark.createDataFrame(cells, "row_no int, col_no int, column string, text string")
    return v.Source(df.withColumns({"number": parse_number(df["text"]), "year": parse_year(df["text"])}), **more)


@pytest.fixture
def trips(monkeypatch):
    asked, plain = [], v._ask
    monkeypatch.setattr(v, "_ask", lambda df: asked.append(plain(df)) or asked[-1])
    return asked


@pytest.fixture
def cities(spark):
    return source(spark, ["지역", "인구", "면적"], [("서울", 900, 6), ("부산", 300, 8), ("대구", "-", 9), ("합계", 1200, 23), ("인천", 300, 11)], unit="명, km2")


def test_automatic(cities, trips):
    c = v.visualize(cities, "지역별 인구를 많은 순으로")
    assert (c.kind, c.series, c.units) == ("bar", ["인구"], ["명, km2"]) and len(trips) == 2
    assert [(r["x"], r["value"]) for r in c.rows.collect()] == [("서울", 900.0), ("부산", 300.0), ("인천", 300.0)]
    assert all(len(rows) <= 3 for rows in trips)


def test_corrected_and_refused(spark, cities):
    c = v.visualize(cities, "인구", chart="line")
    assert c.kind in ("bar", "grouped_bar") and any("line became" in n for n in c.notes)
    assert v.visualize(cities, chart="bar", metrics=["밀도"]).kind is None
    assert v.visualize(source(spark, ["a", "b"], [("x", "y"), ("z", "-")])).notes == ["no column holds numbers"]
    none = v.visualize(v.Source(cities.cells, filters=(("지역", "광주"),)), "인구")
    assert none.kind is None and none.rows is None
    assert v.visualize(source(spark, ["a"], [])).kind is None


def test_filters_groups_and_caps(spark):
    rows = [(2020 + y, s, 10 * y + k) for y in range(3) for k, s in enumerate("가나다")]
    s = source(spark, ["연도", "구분", "값"], rows, filters=(("구분", "가"), ("구분", "다")))
    c = v.visualize(s, "추이", group="구분")
    assert c.kind == "line" and [(r["x"], r["series"]) for r in c.rows.collect()][:3] == [("2020", "가"), ("2020", "다"), ("2021", "가")]
    many = source(spark, ["이름", "값"], [(f"이름 {chr(0xAC00 + n)}", 100 - n) for n in range(30)])
    assert v.visualize(many, chart="donut").rows.count() == 8 and v.visualize(many, chart="bar").rows.count() == 20
    assert v.visualize(many, chart="bar", top_n=0).rows.count() == 30
    falls = v.visualize(source(spark, ["이름", "값"], [(f"이름 {chr(0xAC00 + n)}", n) for n in range(30)]), chart="waterfall", top_n=4)
    assert [(r["x"][-1], r["end_value"]) for r in falls.rows.collect()] == [("가", 0.0), ("각", 1.0), ("갂", 3.0), ("갃", 6.0)]


def test_year_columns(spark):
    s = source(spark, ["구분", "2021년", "2022년", "2023년"], [("남", 1, 2, 3), ("여", 3, 3, 1)])
    c = v.visualize(s, "연도별 추이")
    assert c.kind == "line" and c.x == ["2021년", "2022년", "2023년"]
    assert [(r["x"], r["series"], r["value"]) for r in c.rows.collect()][:3] == [("2021", "남", 1.0), ("2021", "여", 3.0), ("2022", "남", 2.0)]
    ends = source(spark, ["구분", "2021년", "2023년"], [("남", 1, 3), ("여", 3, 1)])
    slope = v.visualize(ends, chart="slope")
    assert slope.kind == "slope" and {(r["series"], r["end_no"], r["place"]) for r in slope.rows.collect()} == {("남", 0, 0.0), ("여", 0, 1.0), ("남", 1, 1.0), ("여", 1, 0.0)}


def test_sources(spark, cities, trips):
    other = source(spark, ["시도", "세대"], [("서울특별시", 400), ("부산광역시", 200), ("광주", 50), ("전국", 650)], label="세대", unit="세대")
    c = v.visualize_sources([v.Source(cities.cells, "인구", "명", "인구"), other], "세대와 인구", order="ascending")
    assert len(trips) == 2 and c.x == ["지역", "시도"] and c.series == ["인구", "세대"] and c.units == ["명", "세대"] and c.split
    got = [(r["key"], r["v0"], r["v1"]) for r in c.rows.collect()]
    assert got == [("부산", 300.0, 200.0), ("인천", 300.0, None), ("서울", 900.0, 400.0), ("합계", 1200.0, None), ("광주", None, 50.0)]
    per = v.visualize_sources([v.Source(cities.cells, "인구", "명", "인구"), other], op="ratio")
    assert [(r["key"], r["value"]) for r in per.rows.collect()] == [("서울", 2.25), ("부산", 1.5)] and per.units == ["명/세대"]
    with pytest.raises(ValueError):
        v.visualize_sources([other])
    assert v.visualize_sources([other, source(spark, ["이름", "값"], [("가", 1), ("나", 2)])]).notes == ["no key is shared by all tables"]


def test_sources_of_years(spark):
    wide = source(spark, ["구분", "2021년", "2022년"], [("합계", 5, 7), ("남", 2, 3)], label="넓은")
    tall = source(spark, ["연도", "값"], [(2022, 70), (2021, 50), (2023, 90)], label="긴")
    c = v.visualize_sources([wide, tall], "")
    assert [(r["key"], r["v0"], r["v1"]) for r in c.rows.collect()] == [("2021", 5.0, 50.0), ("2022", 7.0, 70.0), ("2023", None, 90.0)]
    named = v.visualize_sources([wide, tall], "남 추이")
    assert [r["v0"] for r in named.rows.collect()] == [2.0, 3.0, None]


def test_units_and_axes():
    assert requests.metric_units(["대상지구(개소)", "사업"], "개소, 백만원") == ["개소", "백만원"]
    assert requests.metric_units(["비율", "인구"], "명, %") == ["%", "명"]
    assert requests.metric_units(["가"], None) == ["값"]
    assert requests.splits_axis(["명", "원"], []) and not requests.splits_axis(["명", "명"], [1.0, 99.0])
    assert requests.splits_axis(["명", "명"], [1.0, 100.0]) and requests.splits_axis(["", ""], [20.0, 1.0])
    assert not requests.splits_axis(["명", "명"], [0.0, 5.0])


def test_orders(spark):
    df = spark.createDataFrame([("x", 1.0), ("2020", None), ("1999", 3.0), ("a", 2.0)], "key string, v double")
    assert [r[0] for r in df.orderBy(*charts.year_key_order()).collect()] == ["1999", "2020", "a", "x"]
    assert [r[0] for r in df.orderBy(*charts.leading_order("v", True, "key")).collect()] == ["1999", "a", "x", "2020"]
    assert [r[0] for r in df.orderBy(*charts.leading_order("v", False, "key")).collect()] == ["x", "a", "1999", "2020"]
