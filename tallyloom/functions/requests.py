"""What a request's text asks for, and the names and units of what it gets: small rules that the driver applies to one request."""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that tell what is wanted.
TREND_WORDS = ("추이", "연도별", "시계열", "변화", "trend", "yearly", "over time")
DELTA_WORDS = ("증감", "전년", "증가", "감소", "변화량", "delta", "change")
SHARE_WORDS = ("비중", "구성", "구성비", "점유", "점유율", "분포", "share", "ratio", "composition")
RANK_WORDS = ("순위", "랭킹", "등수", "rank")
RELATION_WORDS = ("관계", "상관", "산점", "scatter", "correlation")
GAP_WORDS = ("격차", "차이", "간극", "gap", "difference")
INCLUDE_TOTAL = ("합계 포함", "계 포함", "소계 포함", "총계 포함", "include total")
EXCLUDE_TOTAL = ("합계 제외", "계 제외", "소계 제외", "총계 제외", "exclude total")
# Words of an order by value.
LARGE, SMALL = ("큰", "높은", "많은"), ("작은", "낮은", "적은")
MOST, LEAST = ("최대", "최다"), ("최소", "최저")
DOWN, UP = "내림차순", "오름차순"
MEASURES, THING, ORDERED, SORTED, LIKE = ("값", "수", "숫자", "규모"), "것", ("부터", "순"), "로정렬", "대로"
# Numbers of a "per" and the number that they stand for.
PER_WORDS = ((("100만", "백만"), 1_000_000), (("10만", "십만"), 100_000), (("1만", "만"), 10_000), (("1천", "천"), 1_000))
PER_LABELS = ((10**8, "억"), (10**4, "만"), (10**3, "천"))
PER_ONE = ("1인", "1명", "1가구", "1세대", "한명")
# Multiples in a unit, and words of a column that tell which of a table's units is its own.
UNIT_MULTIPLES = ("십만", "백만", "천", "만", "억", "조")
UNIT_HINTS = (
    ("세대", ("세대",)),
    ("명", ("인명", "인구", "인원", "사망", "부상", "이재민", "환자", "직원", "정원")),
    ("원", ("재산", "금액", "적립액", "피해액", "예산", "지출", "잔액", "사업비")),
    ("개", ("개소", "건수", "기관", "시설")),
)
# Units of shortened numbers.
LARGE_UNITS = ((10**12, "조"), (10**8, "억"), (10**4, "만"))
SHOWN_LABELS = 5


def wants(text: str | None, words: tuple[str, ...]) -> bool:
    low = (text or "").lower()
    return any(w in low for w in words)


def wants_trend(text: str | None, chart: str = "auto", x: str | None = None) -> bool:
    return chart in ("line", "area") or (x or "").strip().lower() in ("year", "date", "연도", "년도") or wants(text, TREND_WORDS)


def query_year(text: str | None) -> int | None:
    """The one year that a text names in four digits; none if it names several."""
    found = {int(y) for y in re.findall(r"(?:18|19|20)\d{2}", text or "")}
    return found.pop() if len(found) == 1 else None


def total_mode(mode: str, text: str | None) -> str:
    """include, exclude or auto: as given, or as the text says where auto is given."""
    if mode == "auto" and wants(text, INCLUDE_TOTAL):
        return "include"
    return "exclude" if mode == "auto" and wants(text, EXCLUDE_TOTAL) else mode


def _asks_order(bare: str, sizes: tuple[str, ...], extremes: tuple[str, ...]) -> bool:
    """Whether a size, with a measure behind it or before it perhaps, or an extreme is followed by a word of order."""
    for word in (*sizes, *extremes):
        for hit in re.finditer(word, bare):
            rest = bare[hit.end() :]
            # What may stand between the word and that of order, and the words of order then.
            ways = [(("", *MEASURES), (*ORDERED, SORTED))] if word in sizes else [(("", MEASURES[0]), ORDERED)]
            if word in sizes and bare[: hit.start()].removesuffix("이").removesuffix("가").endswith(MEASURES):
                ways.append((("", THING), (*ORDERED, SORTED, LIKE)))
            if any(rest.startswith(m + end) for between, ends in ways for m in between for end in ends):
                return True
    return False


def sort_order(order: str, text: str | None) -> str | None:
    """ascending or descending: as given, or as the text says where auto is given; None if it says neither or both."""
    if order in ("ascending", "descending"):
        return order
    if order != "auto":
        return None
    bare = "".join((text or "").lower().split())
    down, up = DOWN in bare or _asks_order(bare, LARGE, MOST), UP in bare or _asks_order(bare, SMALL, LEAST)
    return None if down == up else "descending" if down else "ascending"


def per_scale(text: str | None) -> int | None:
    """The number of a per that a text names, the largest first."""
    low = (text or "").lower()
    for words, scale in PER_WORDS:
        for word in words:
            for rest in low.split(word)[1:]:
                unit, per, _ = rest.lstrip().partition("당")
                unit = unit.rstrip()
                if per and len(unit) <= 4 and all("가" <= ch <= "힣" for ch in unit):
                    return scale
    bare = "".join(low.split())
    return 1 if any(f"{one}당" in bare for one in PER_ONE) else None


def per_label(per: int) -> str:
    """A multiple of 100 million, 10,000 or 1000 in words, the greatest of these that divides it; any other number in digits."""
    dividing = [(size, word) for size, word in PER_LABELS if per and not per % size]
    return "{0}{1}".format(per // dividing[0][0], dividing[0][1]) if dividing else format(per, ",")


def column_unit(column: str, table_unit: str | None, otherwise: str) -> str:
    """The unit of a column of a table whose unit lists several."""
    units = [u.strip() for u in (table_unit or "").split(",") if u.strip()]
    low = "".join(column.lower().split())
    hinted = (u for mark, words in UNIT_HINTS if any(w in low for w in words) for u in units if mark in u)
    return next(hinted, otherwise) if len(units) > 1 else otherwise


# Words of columns that hold per cents, what a value without a unit is called, and how far apart two scales of one unit, or of unknown ones, may be.
PERCENT_WORDS = ("비율", "percentage", "ratio", "%")
NO_UNIT = "값"
SCALE_OF_ONE_UNIT, SCALE_OF_ANY = 100, 20


def metric_units(columns: list[str], table_unit: str | None) -> list[str]:
    """The unit of each column: per cent by its name, else the one that fits of those that the table lists; a pair that is left over belongs together."""
    listed = list(dict.fromkeys(u.strip() for u in (table_unit or "").split(",") if u.strip()))
    whole = table_unit or NO_UNIT

    def fitting(column: str) -> str:
        if wants(column, PERCENT_WORDS):
            return "%"
        for some in ([u for u in listed if "%" not in u], [u for u in listed if u in column]):
            if len(listed) > 1 and len(some) == 1:
                return some[0]
        return whole

    out = [fitting(c) for c in columns]
    left_over, unsure = set(listed) - set(out), [k for k, u in enumerate(out) if u not in listed]
    if len(listed) > 1 and (len(left_over), len(unsure)) == (1, 1):
        out[unsure[0]] = left_over.pop()
    return out


def splits_axis(units: list[str], largest: list[float]) -> bool:
    """Whether series need two axes: units of exactly two kinds, or two series of which one is out of sight beside the other."""
    known = {u.strip() for u in units if u and u.strip()}
    if len(units) > 1 and all(units) and len(known) == 2:
        return True
    if len(largest) != 2 or not all(largest):
        return False
    return max(largest) >= min(largest) * (SCALE_OF_ONE_UNIT if len(known) == 1 and all(units) else SCALE_OF_ANY)


#: Of each derived metric: its label, and its unit by what is known of the operands' units: both alike, both, one or none.
DERIVED = {
    "share": ("{bottom} 대비 {top} 비중", {"both": "%", "alike": "%", "one": "%", "none": "%"}),
    "difference": ("{top} - {bottom}", {"both": "{t}", "alike": "{t}", "one": "{either}", "none": "값"}),
    "ratio": ("{top} / {bottom}", {"both": "{t}/{b}", "alike": "배", "one": "배", "none": "배"}),
    "per_capita": ("{top} ({per} {counted}당)", {"both": "{t}/{per} {b}", "alike": "{t}/{per} {b}", "one": "값", "none": "값"}),
}


def derived_unit(op: str, top: str, bottom: str, per: int = 1) -> str:
    known = [u for u in (top, bottom) if u]
    case = ("none", "one", "alike" if top == bottom else "both")[len(known)]
    return DERIVED.get(op, DERIVED["per_capita"])[1][case].format(t=top, b=bottom, per=per_label(per), either="".join(known))


def derived_label(op: str, top: str, bottom: str, per: int = 1, bottom_unit: str = "") -> str:
    return DERIVED.get(op, DERIVED["per_capita"])[0].format(top=top, bottom=bottom, per=per_label(per), counted=bottom_unit.strip() or bottom)


def operand_warnings(op: str, bottom: str, bottom_unit: str, top_date: str | None = None, bottom_date: str | None = None) -> list[str]:
    """What may shift a derived number: a multiple in the denominator's unit, and different base dates."""
    multiple = next((m for m in UNIT_MULTIPLES if bottom_unit.strip().startswith(m)), None)
    out = [f"{bottom}: the unit {bottom_unit.strip()} is a multiple ({multiple})"] if op != "difference" and multiple else []
    dates = [(d or "").strip() for d in (top_date, bottom_date)]
    return out + ([f"different base dates: {dates[0]}, {dates[1]}"] if all(dates) and dates[0] != dates[1] else [])


def sample_labels(labels: list[str]) -> str:
    """The first few, and how many are left."""
    shown, left = labels[:SHOWN_LABELS], labels[SHOWN_LABELS:]
    return " 외 ".join([", ".join(shown), *([f"{len(left)}개"] if left else [])])


def metric_parts(columns: list[str]) -> list[str]:
    """What tells the columns apart: their leaves if they share what stands before, what stands before if they share the leaf, else the whole."""
    heads, leaves = zip(*((c.partition("_")[0], c.partition("_")[2]) for c in columns), strict=True) if columns else ((), ())
    if all(leaves) and len(set(heads)) == 1:
        return list(leaves)
    return list(heads) if all(leaves) and len(set(leaves)) == 1 else list(columns)


def distinct_labels(labels: list[str], value_columns: list[str]) -> list[str]:
    """Labels that repeat get the last part of their value column, or their number."""
    out = []
    for k, (label, column) in enumerate(zip(labels, value_columns, strict=True)):
        part = column.rpartition("_")[2].strip() or str(labels[: k + 1].count(label))
        out.append(f"{label} ({part})" if labels.count(label) > 1 else label)
    return out


def number_text(c: Column, decimals: int = 2) -> Column:
    """Thousands marked, no zeros at the end."""
    whole = F.format_number(c, 0)
    part = F.regexp_replace(F.regexp_replace(F.format_number(c, decimals), "0+$", ""), r"\.$", "")
    return F.when(c == F.floor(c), whole).otherwise(part)


def compact_unit(least: Column) -> Column:
    """The unit in which numbers can be shortened of which the least, other than 0, is this; null if none."""
    size = F.lit(None).cast("long")
    for n, _ in reversed(LARGE_UNITS):
        size = F.when(least >= n, n).otherwise(size)
    return size


def compact_text(c: Column, size: Column) -> Column:
    """About three digits of a number, in the given unit."""
    scaled = F.try_divide(c.cast("double"), size)
    digits = F.when(F.abs(scaled) >= 100, F.format_number(scaled, 0)).when(F.abs(scaled) >= 10, F.format_number(scaled, 1)).otherwise(F.format_number(scaled, 2))
    name = F.create_map(*[x for n, word in LARGE_UNITS for x in (F.lit(n).cast("long"), F.lit(word))])
    return F.concat(digits, name[size])


def markdown_cell(c: Column) -> Column:
    return F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit("<br>"))


def markdown_row(cells: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(F.transform(cells, markdown_cell), " | "), F.lit(" |"))


def ordered_categories(c: Column) -> Column:
    """Over all labels: whether each holds a digit, so that a line between them says something."""
    return F.coalesce(F.every(c.cast("string").rlike("[0-9]")), F.lit(False))


# Kinds of chart whose parts make a whole.
PARTS_OF_WHOLE = ("donut", "stacked_bar_100", "waterfall")
YEARS_FOR_AXIS = 4


@dataclass(frozen=True)
class Shape:
    """What decides a chart's kind: of the axis, and of the records over it."""

    x_is_year: bool
    x_is_numeric: bool
    grouped: bool
    n_x: int
    n_series: int
    negative: bool
    ordered: bool

    def facts(self) -> set[str]:
        held = {"year": self.x_is_year, "number": self.x_is_numeric, "grouped": self.grouped, "two_x": self.n_x == 2, "pair": self.n_series == 2, "negative": self.negative, "sequence": self.x_is_year or self.ordered}
        return {fact for fact, holds in held.items() if holds}


class Kind(NamedTuple):
    """A kind of chart: facts that it needs and facts that it cannot show, as words; its stand-ins, the closest first; with what weight it
    offers itself (None: never), and the words of a request without which it does not."""

    needs: str = ""
    shuns: str = ""
    instead: tuple[str, ...] = ("grouped_bar", "line", "bar")
    weight: int | None = None
    words: tuple[str, ...] = ()

    def shows(self, facts: set[str]) -> bool:
        return set(self.needs.split()) <= facts and facts.isdisjoint(self.shuns.split())

    def offers(self, facts: set[str], text: str | None) -> bool:
        return self.weight is not None and self.shows(facts) and (not self.words or wants(text, self.words))


CHARTS = {
    "stacked_bar_100": Kind("grouped", weight=40, words=SHARE_WORDS),
    "donut": Kind("", "year grouped", ("line", "grouped_bar"), 30, SHARE_WORDS),
    "bump": Kind("grouped year", weight=25, words=RANK_WORDS),
    "slope": Kind("grouped year two_x", instead=("line", "grouped_bar", "bar"), weight=20),
    "dumbbell": Kind("grouped pair", weight=10, words=GAP_WORDS),
    "bar": Kind("", "grouped negative", ("grouped_bar", "diverging_bar"), 0),
    "stacked_bar": Kind("grouped"),
    "combo": Kind("grouped year"),
    "line": Kind("sequence"),
    "area": Kind("sequence"),
    "heatmap": Kind("grouped", instead=("bar",)),
    "scatter": Kind("number", instead=("line", "bar")),
    "waterfall": Kind("", "grouped", ("stacked_bar",)),
    "lollipop": Kind("", "grouped", ("grouped_bar",)),
}
#: As stand-ins, and unasked, these need more or less than if a request names them.
PLAIN = {"line": Kind("year", weight=15), "grouped_bar": Kind("grouped", weight=5), "diverging_bar": Kind("negative", "grouped", weight=8), "stacked_bar": Kind("grouped"), "bar": Kind(weight=0)}


def fitting_chart(s: Shape, text: str | None) -> str:
    """The kind of chart for a request that names none: the weightiest that the records allow and that no word is lacking for."""
    facts = s.facts()
    return max((kind.weight, name) for name, kind in (CHARTS | PLAIN).items() if kind.offers(facts, text))[1]


def corrected_chart(kind: str, s: Shape) -> str:
    """The asked kind of chart, or the closest one that the records can fill."""
    facts = s.facts()
    asked = CHARTS.get(kind, Kind())
    return kind if asked.shows(facts) else next(name for name in asked.instead if PLAIN[name].shows(facts))
