import pytest
from pyspark.sql import functions as F

from tallyloom.functions import names, numbers, text, vectors


def values(spark, fn, inputs, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


def test_match_key(spark):
    assert values(spark, text.match_key, ["행정 기획·과", "A-b_C/d", "　a b", " ", None, "a･b‧c・d"]) == ["행정기획과", "abcd", "ab", None, None, "abcd"]
    assert [text.match_key_value(x) for x in ["행정 기획·과", "A-b_C/d", "　a b"]] == ["행정기획과", "abcd", "ab"]


def test_collapsed_and_simple_key(spark):
    assert values(spark, text.collapsed, ["  a \n b ", "   ", None]) == ["a b", None, None]
    assert values(spark, text.simple_key, [" A-1 ", "", None]) == ["a-1", None, None]


@pytest.mark.parametrize(
    "cell, want",
    [("1,234", 1234.0), ("(1,234.5)", -1234.5), ("△12", -12.0), ("▲ 3", -3.0), ("−5", -5.0), ("12.5%", 12.5), ("-", None), ("－", None), ("", None), (None, None), ("(−5)", None), ("12a", None), ("+7", 7.0), ("1 000", 1000.0), ("٣", None)],
)
def test_parse_number(spark, cell, want):
    assert values(spark, numbers.parse_number, [cell]) == [want]


def test_years(spark):
    assert values(spark, numbers.parse_year, ["2024년", "'24", "’69", "`70", "'245", "x2024", None]) == [2024, 2024, 2069, 1970, None, None, None]
    assert values(spark, numbers.header_year, ["'24년", "2023.6월", "'24(잠정)", "'24년 본예산", "2024_계", "2023~2024", "2024.12.", "지역"]) == [2024, 2023, 2024, None, None, None, 2024, None]


def test_labels(spark):
    assert values(spark, text.display_label, ["서 울 Seoul", "1급 Grade 1", "Total", "구 분"]) == ["서울", "1급", "Total", "구분"]
    assert values(spark, text.is_total, ["합 계", "합계 Total", "인구 Population", "Sub total", None]) == [True, True, False, True, False]
    assert values(spark, text.leaf, ["연령별_16~19세"]) == ["16~19세"]


def test_canonical_key(spark):
    got = values(spark, names.canonical_key, ["부산광역시", "부 산", "강원특별자치도", "강원도", "경상남도", "세종특별자치시", "전국"])
    assert got == ["부산", "부산", "강원", "강원", "경남", "세종", "전국"]
    assert values(spark, lambda c: names.canonical_key(c, True), ["'24", "2023년"]) == ["2024", "2023"]
    assert values(spark, names.is_whole, ["전국", "nationwide avg", "부산"]) == [True, True, False]


def test_names():
    assert names.department_keys("국과수") == ["국과수", "국립과학수사연구원"]
    assert names.department_keys("행정기획과") == ["행정기획과"]
    assert names.officer_keys("홍길동 주무관님") == ["홍길동주무관님", "홍길동"]
    assert "서울특별시" in names.region_variants("서울") and names.region_variants("x") == ["x"]
    assert text.query_tokens("2024년 인구 현황 알려줘 (서울)") == ["인구", "서울"]


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 1.0]), ([1.0, 0.0], [2.0, 0.0]), ([0.0, 0.0], [0.0, 0.0])], "a array<float>, b array<float>")
    rows = df.select(vectors.cosine_distance(F.col("a"), F.col("b")), vectors.weighted(F.col("a"), F.col("b")), vectors.is_valid(F.col("a"), 2), vectors.literal(F.col("a"), 1)).collect()
    assert [r[0] for r in rows] == [1.0, 0.0, None]
    assert rows[0][1] == pytest.approx([0.9847835588179369, 0.17378533390904767]) and rows[2][1] is None
    assert rows[0][2] and rows[0][3] == "[1.0,0.0]"


def test_editions(spark):
    df = spark.createDataFrame([(2025, "H1", "major_statistics"), (2025, "H2", "major_statistics"), (2026, "", "yearbook")], "y int, p string, k string")
    got = df.select(numbers.edition_rank(F.col("y"), F.col("p")), numbers.edition_label(F.col("y"), F.col("p"), F.col("k"))).collect()
    assert [r[0] for r in got] == [20251, 20252, 20260] and got[0][1] == "2025년 상반기 주요통계집" and got[2][1] == "2026년 통계연보"
