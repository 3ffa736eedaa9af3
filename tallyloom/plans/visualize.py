"""A chart for a request, of one table or of several: the columns' profile, then the chart's shape, then one plan of the data.

Two small questions at most go to the data before that plan is put together: one row for each column, and one for the shape (of
several tables: one for each set of columns that share keys). The plan reads only the columns and rows that they leave.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..functions import requests
from ..functions.names import canonical_key, is_whole
from ..functions.numbers import header_year, is_missing
from ..functions.text import display_label, is_total, label_key
from ..operators import cells, charts, derive, interpret


@dataclass(frozen=True)
class Source:
    """The cells of one table (row_no, col_no, column, text, number, year) and what is asked of it; filters of one column are alternatives."""

    cells: DataFrame
    label: str = ""
    unit: str = ""
    value: str | None = None
    year: int | None = None
    place: str | None = None
    filters: tuple[tuple[str, str], ...] = ()
    base_date: str | None = None


@dataclass
class Chart:
    """kind None: refused, and notes say why; rows are then None. split: the series need two axes."""

    kind: str | None
    rows: DataFrame | None = None
    x: list[str] = field(default_factory=list)
    series: list[str] = field(default_factory=list)
    units: list[str] = field(default_factory=list)
    split: bool = False
    notes: list[str] = field(default_factory=list)


def _ask(df: DataFrame) -> list[Row]:
    """The only way by which facts come to the driver: rows for columns or for the shape, never for data."""
    return df.collect()


def _columns(sources: list[Source]) -> list[list[Row]]:
    """Of each source the profiles of its columns, in their order; one aggregate over all cells."""
    long = reduce(DataFrame.unionByName, [s.cells.select(F.lit(n).alias("source"), "row_no", "col_no", "column", "text", "number", "year") for n, s in enumerate(sources)])
    key, size = label_key(F.col("text")), F.abs("number")
    more = (F.max(size).alias("largest"), F.min("number").alias("least"), (F.max("row_no") + 1).alias("n_rows"), (F.min(key) == F.max(key)).alias("constant"))
    rows = _ask(cells.profile(long, ["source"], *more).withColumn("header_year", header_year(F.col("column"))))
    return [sorted((r for r in rows if r["source"] == n), key=lambda r: r["col_no"]) for n in range(len(sources))]


def _score(column: str, query: str | None) -> int:
    """How many words of a column's name the query holds."""
    low = (query or "").lower()
    return sum(len(w) > 1 and w in low for w in re.findall("[가-힣a-z0-9%]+", column.lower()))


def _bare(name: str) -> str:
    return "".join(ch for ch in name.lower() if ch.isalnum())


def _column_of(columns: list[Row], name: str) -> Row | None:
    """The column of that name, but for marks; else the only one that holds it."""
    whole = [c for c in columns if _bare(c["column"]) == _bare(name)]
    parts = [c for c in columns if _bare(name) and _bare(name) in _bare(c["column"])]
    return whole[0] if whole else parts[0] if len(parts) == 1 else None


def _axis(columns: list[Row], query: str | None) -> Row:
    """A year column before categories before any; one that tells rows apart before one that doesn't; then that which the query names."""

    def rank(c: Row):
        kind = 0 if c["is_year"] else 1 if c["is_categorical"] else 2
        return c["constant"] and c["n_rows"] > 1, kind, -_score(c["column"], query) if kind < 2 else 0, c["col_no"]

    return min(columns, key=rank)


def _value(columns: list[Row], source: Source, query: str | None) -> Row | None:
    """The asked column of numbers, or the only one, that which the query names, that of the year or the last year, or the first."""
    numeric = [c for c in columns if c["is_numeric"]]
    if source.value is not None:
        return _column_of(numeric, source.value)
    at = source.year or requests.query_year(query)

    def rank(c: Row):
        year = c["header_year"]
        return -_score(c["column"], query), year is None, year != at, -(year or 0), c["col_no"]

    return min(numeric, key=rank, default=None)


def _year_headers(columns: list[Row]) -> dict[str, int]:
    """Columns of numbers that are points in time, two or more and no year twice; none where a column holds years."""
    found = {c["column"]: c["header_year"] for c in columns if c["is_numeric"] and c["header_year"] is not None}
    return found if 1 < len(found) == len(set(found.values())) and not any(c["is_year"] for c in columns) else {}


def _pruned(source: Source, columns: list[Row], wanted: list[str]) -> tuple[DataFrame, list[str]]:
    """Cells of the wanted columns in the rows that year, place and filters leave; what could not be applied is named."""
    long, notes = source.cells.where(F.col("column").isin(wanted)), []

    def rows(condition: Column) -> DataFrame:
        return long.join(source.cells.where(condition).select("row_no").distinct(), "row_no", "left_semi")

    years = [c["column"] for c in columns if c["is_year"]]
    if source.year is not None and years:
        long = rows((F.col("column") == years[0]) & (F.col("year") == source.year))
    if source.place:
        places = [c["column"] for c in columns if c["is_categorical"]]
        long = rows(F.col("column").isin(places) & (canonical_key(F.col("text")) == canonical_key(F.lit(source.place))))
    by_column: dict[str, list[str]] = {}
    for name, value in source.filters:
        found = _column_of(columns, name)
        if found is None:
            notes.append(f"no column {name}; there are {requests.sample_labels([c['column'] for c in columns])}")
        else:
            by_column.setdefault(found["column"], []).append(value)
    for column, values in by_column.items():
        key = label_key(F.col("text"))
        long = rows((F.col("column") == column) & reduce(lambda a, b: a | b, [key == label_key(F.lit(v)) for v in values]))
    return long, notes


def _refused(*notes: str) -> Chart:
    return Chart(None, notes=list(notes))


def _of(name: str, what: str) -> Column:
    return F.max(F.when(F.col("column") == name, F.col(what)))


#: What kinds of chart add to their records.
ADDED = {
    "bump": charts.ranks, "stacked_bar_100": charts.shares, "waterfall": charts.waterfall, "donut": charts.ring_angles,
    "line": charts.marks, "area": charts.marks, "stacked_bar": charts.stack_order, "slope": charts.ends_of_time,
}
#: Kinds whose values may stand on two axes.
SPLIT = ("bar", "grouped_bar", "line", "area", "combo")


def _split_kind(kind: str, units: list[str], largest: list[float], years: bool) -> tuple[str, bool]:
    """Two axes: in time as bars and lines over each other, else as two panels."""
    if kind not in SPLIT or not requests.splits_axis(units, largest):
        return kind, False
    return "combo" if years else "paired_panels", True


def visualize(source: Source, query: str = "", chart: str = "auto", x: str | None = None, metrics: list[str] | None = None, group: str | None = None, order: str = "auto", totals: str = "auto", top_n: int | None = None) -> Chart:
    """Chart rows (pos, x, series, value, and what the kind adds) of one table.

    chart: a kind, which is corrected where the records can't fill it, or auto. x, metrics, group: names of columns; group makes series of its
    values for one metric. top_n: most categories (0: all); years are never cut. A table without numbers, an unknown column or records of
    which nothing is left give a refused chart.
    """
    (columns,) = _columns([source])
    numeric = [c for c in columns if c["is_numeric"]]
    if not numeric:
        return _refused("no column holds numbers")
    for name in (x, group, *(metrics or [])):
        if name is not None and _column_of(columns, name) is None:
            return _refused(f"no column {name}; there are {requests.sample_labels([c['column'] for c in columns])}")
    headers = _year_headers(columns)
    trend = requests.wants_trend(query, chart, x)
    labels = [c for c in columns if c["is_categorical"]]
    if headers and labels and metrics is None and (trend or chart in ("bump", "slope")):
        label = _column_of(columns, group) if group else _axis(labels, query)
        x_names, shown, years, units = list(headers), [], True, requests.metric_units(list(headers)[:1], source.unit)
        long, notes = _pruned(source, columns, [label["column"], *headers])
        names = long.where(F.col("column") == label["column"]).select("row_no", display_label(F.col("text")).alias("series"))
        at = F.create_map(*[F.lit(v) for c, y in headers.items() for v in (c, str(y))])
        points = long.where(F.col("column") != label["column"]).select("row_no", at[F.col("column")].alias("x"), F.col("number").alias("value"))
        records = points.where("value IS NOT NULL").join(names, "row_no").select(F.col("row_no").alias("pos"), "x", "series", "value")
        grouped = True
    else:
        axis = _column_of(columns, x) if x else _axis(columns, query)
        others = [c for c in numeric if c["column"] != axis["column"]]
        named = [c for c in others if _score(c["column"], query)]
        chosen = list(dict.fromkeys(_column_of(columns, m) for m in metrics)) if metrics else named or others[: charts.SERIES]
        if not chosen or not all(c["is_numeric"] for c in chosen):
            return _refused("no column of numbers beside the axis" if not chosen else "a metric holds no numbers")
        by = _column_of(columns, group) if group else None
        chosen = chosen[:1] if by else chosen
        wanted = [c["column"] for c in chosen]
        x_names, years = [axis["column"]], axis["is_year"]
        shown = requests.distinct_labels(requests.metric_parts(wanted), wanted)
        units = requests.metric_units(wanted, source.unit)
        long, notes = _pruned(source, columns, [axis["column"], *wanted, *([by["column"]] if by else [])])
        # The rows of the pruned cells, put together by one shuffle.
        rows = long.groupBy("row_no").agg(
            _of(axis["column"], "text").alias("_t"), _of(axis["column"], "year").alias("_y"), (_of(by["column"], "text") if by else F.lit(None).cast("string")).alias("_g"), *[_of(c, "number").alias(f"_{k}") for k, c in enumerate(wanted)]
        )
        place = F.coalesce(F.col("_y").cast("string"), F.col("_t")) if years else display_label(F.col("_t"))
        each = F.array(*[F.struct((display_label(F.col("_g")) if by else F.lit(name)).alias("series"), F.col(f"_{k}").alias("value")) for k, name in enumerate(shown)])
        records = rows.select(F.col("row_no").alias("pos"), place.alias("x"), F.inline(each)).where("value IS NOT NULL AND x IS NOT NULL AND series IS NOT NULL")
        grouped = by is not None or len(chosen) > 1
    mode = requests.total_mode(totals, query)
    # A request for a trend names a year as its end or start, not as the only one.
    records = interpret.chart_records(records, query, mode, None if trend else requests.query_year(query))
    facts = [F.count(F.lit(1)).alias("n"), F.count_distinct("x").alias("n_x"), F.count_distinct("series").alias("n_series"), F.min("value").alias("least"), requests.ordered_categories(F.col("x")).alias("ordered")]
    (s,) = _ask(records.agg(*facts, *[F.max(F.when(F.col("series") == name, F.abs("value"))).alias(f"m{k}") for k, name in enumerate(shown)]))
    if not s["n"]:
        return _refused("nothing is left of the table's records", *notes)
    number_axis = not headers and any(c["column"] == x_names[0] and c["is_numeric"] for c in columns)
    shape = requests.Shape(years, number_axis, grouped and s["n_series"] > 1, s["n_x"], s["n_series"], s["least"] < 0, s["ordered"])
    kind = requests.fitting_chart(shape, query) if chart == "auto" else requests.corrected_chart(chart, shape)
    if kind in ("donut", "stacked_bar_100") and shape.negative:
        kind = "grouped_bar" if shape.grouped else "diverging_bar"
        notes.append("parts of a whole can't be negative")
    if chart not in ("auto", kind):
        notes.append(f"{chart} became {kind}")
    largest = [s[f"m{k}"] or 0.0 for k in range(len(shown))] if not group else []
    kind, split = _split_kind(kind, units, largest, years)
    if kind in requests.PARTS_OF_WHOLE and mode == "include":
        records = charts.without_totals(records, "x", "series")
        notes.append("totals are no part of the whole")
    records = charts.top_by_sum(records, "series", charts.SERIES) if s["n_series"] > charts.SERIES else records
    most = top_n if top_n is not None else charts.RING if kind == "donut" else charts.CATEGORIES
    if not years and kind not in ("line", "area", "bump", "slope") and most and s["n_x"] > most:
        records = charts.first_categories(records, most) if kind == "waterfall" else charts.top_by_sum(records, "x", most)
        notes.append(f"{most} of {s['n_x']} categories")
    sort = None if years or kind == "waterfall" else requests.sort_order(order, query)
    records = charts.sort_by_value(records, sort == "descending") if sort else records
    rows = ADDED[kind](records) if kind in ADDED else records
    by_place = charts.time_order() if years else [F.col("order_no")] if sort else []
    return Chart(kind, rows.orderBy(*by_place, "pos", "series"), x_names, shown, units, split, notes)


def _flat_points(source: Source, columns: list[Row], headers: dict[str, int], query: str | None) -> DataFrame:
    """key, label, value, pos: the year columns of one row; the only row, that which the query names, or the only total. No points where none is such."""
    label = next(c["column"] for c in columns if c["is_categorical"])
    long, _ = _pruned(source, columns, [label, *headers])
    names = long.where(F.col("column") == label).select(F.lit(0).alias("one"), "row_no", "col_no", "column", "text")
    named = interpret.focus_row(names, label, query or "", ["one"]).select("row_no", "score")
    total = F.coalesce(is_total(F.col("text")), F.lit(False))
    facts = names.agg(F.count(F.lit(1)).alias("n"), F.count_if(total).alias("n_totals"))  # one row
    ranked = names.join(named, "row_no", "left").join(F.broadcast(facts)).where((F.col("n") == 1) | F.col("score").isNotNull() | (total & (F.col("n_totals") == 1)))
    focus = ranked.orderBy(F.col("score").desc_nulls_last(), "row_no").limit(1).select("row_no")
    years = F.create_map(*[F.lit(v) for c, y in headers.items() for v in (c, str(y))])
    points = long.where(F.col("column") != label).join(F.broadcast(focus), "row_no", "left_semi").where("number IS NOT NULL")
    key = years[F.col("column")]
    return points.groupBy(key.alias("key")).agg(key.alias("label"), F.sum("number").alias("value"), F.min("col_no").cast("long").alias("pos"))


def _points(source: Source, columns: list[Row], key: str, years: bool, value: str) -> DataFrame:
    """key, label, value, pos of one source: ratios of a key are averaged, all else is summed."""
    long, _ = _pruned(source, columns, [key, value])
    rows = long.groupBy("row_no").agg(_of(key, "text").alias("label"), _of(value, "number").alias("value")).where("value IS NOT NULL")
    labels = rows.where(~is_missing(F.col("label"))).groupBy("label").agg(F.sum("value").alias("s"), F.count(F.lit(1)).alias("n"), F.min("row_no").alias("pos"))
    total = F.try_divide(F.sum("s"), F.sum("n")) if derive.is_ratio(value) else F.sum("s")
    keyed = labels.groupBy(canonical_key(F.col("label"), years).alias("key")).agg(F.min_by("label", "pos").alias("label"), total.alias("value"), F.min("pos").cast("long").alias("pos"))
    return keyed.where((F.col("key") != "") & ~is_whole(F.col("key")))


def _shared_keys(sources: list[Source], columns: list[list[Row]], flat: dict[int, dict[str, int]]) -> tuple[list[tuple[str, bool]], int, int] | None:
    """A key column of each source with whether it holds years, the keys that all share, and all keys; None where none is shared.

    Of each key the set of columns that hold it; the driver gets how many keys there are of each such set.
    """
    sets = []
    for n, (source, some) in enumerate(zip(sources, columns, strict=True)):
        at = lambda c: F.lit(f"{n}:{c['col_no']}").alias("at")  # noqa: B023, E731
        if n in flat:
            sets.append(source.cells.sparkSession.createDataFrame([(f"{n}:flat", str(y)) for y in flat[n].values()], "at string, k string"))
            continue
        for c in (c for c in some if c["is_year"] or c["is_categorical"]):
            texts, _ = _pruned(source, some, [c["column"]])
            texts = texts.where(~is_missing(F.col("text"))).select("text").distinct()
            sets.append(texts.select(at(c), canonical_key(F.col("text"), c["is_year"]).alias("k")))
    if not sets:
        return None
    held = reduce(DataFrame.union, sets).where((F.col("k") != "") & ~is_whole(F.col("k"))).groupBy("k").agg(F.array_sort(F.collect_set("at")).alias("held"))
    patterns = [(set(r["held"]), r["n"]) for r in _ask(held.groupBy("held").agg(F.count(F.lit(1)).alias("n")))]

    def shared(of: list[str]) -> int:
        return sum(n for held, n in patterns if held.issuperset(of))

    def ways(n: int) -> list[tuple[str, str, bool]]:
        if n in flat:
            return [(f"{n}:flat", "", True)]
        some = [c for c in columns[n] if c["is_year"] or c["is_categorical"]]
        return [(f"{n}:{c['col_no']}", c["column"], c["is_year"]) for c in sorted(some, key=lambda c: (not c["is_year"], c["col_no"]))]

    best, best_n = None, 0
    for first in ways(0):
        chosen = [first]
        for n in range(1, len(sources)):
            options = ways(n)
            if options:
                chosen.append(max(options, key=lambda w: shared([c[0] for c in (*chosen, w)])))  # noqa: B023; of equal ones the first
        count = shared([c[0] for c in chosen]) if len(chosen) == len(sources) else 0
        if count > best_n:
            best, best_n = chosen, count
    if best is None:
        return None
    return [(c[1], c[2]) for c in best], best_n, sum(n for held, n in patterns if not held.isdisjoint(c[0] for c in best))


def visualize_sources(sources: list[Source], query: str = "", chart: str = "auto", order: str = "auto", op: str | None = None, per: float = 1.0) -> Chart:
    """Chart rows (key, label, a column for each series by number: v0, v1 …, first_source, first_pos) of two to five tables, by the keys that they share.

    Keys that only some hold stay, empty for the others, but not as a scatter and not with op, which makes value of the first two (ratio, per_capita,
    share, difference). Rows come by year, or by the leading series where an order is asked for, what it lacks last, or else as they come first.
    Whether two axes are needed is decided by the largest cells.
    """
    if not 2 <= len(sources) <= derive.SOURCES:
        raise ValueError(f"two to {derive.SOURCES} sources")
    columns = _columns(sources)
    values = [_value(some, source, query) for some, source in zip(columns, sources, strict=True)]
    headers = [_year_headers(some) for some in columns]
    with_years = any(c["is_year"] for some in columns for c in some) or all(headers)
    flat = {n: h for n, h in enumerate(headers) if with_years and h and sources[n].value is None and any(c["is_categorical"] for c in columns[n])}
    names = [s.label or f"{n + 1}" for n, s in enumerate(sources)]
    for n, value in enumerate(values):
        if value is None:
            return _refused(f"{names[n]}: no column of numbers" + (f" {sources[n].value}" if sources[n].value else ""))
    keys = _shared_keys(sources, columns, flat)
    if keys is None:
        return _refused("no key is shared by all tables")
    chosen, n_shared, n_all = keys
    years = all(is_years for _, is_years in chosen)
    notes = [f"{n_all - n_shared} keys are not in all tables"] if n_all > n_shared else []
    for n, (source, some) in enumerate(zip(sources, columns, strict=True)):
        notes += [f"{names[n]}: {note}" for note in _pruned(source, some, [])[1]]
    units = [requests.metric_units([v["column"]], s.unit)[0] for v, s in zip(values, sources, strict=True)]
    labels = requests.distinct_labels(names, [v["column"] for v in values])
    points = [
        _flat_points(s, some, flat[n], query) if n in flat else _points(s, some, key, is_years, value["column"])
        for n, (s, some, (key, is_years), value) in enumerate(zip(sources, columns, chosen, values, strict=True))
    ]
    # One shuffle of what is one row for each key and source already.
    stacked = reduce(DataFrame.unionByName, [p.withColumn("source", F.lit(n)) for n, p in enumerate(points)])
    first = F.min(F.struct("source", "pos", "label"))
    rows = stacked.groupBy("key").agg(first.alias("_f"), *[F.max(F.when(F.col("source") == n, F.col("value"))).alias(f"v{n}") for n in range(len(sources))])
    rows = rows.select("key", F.col("_f.label").alias("label"), *[f"v{n}" for n in range(len(sources))], F.col("_f.source").alias("first_source"), F.col("_f.pos").alias("first_pos"))
    negative = any((v["least"] or 0) < 0 for v in values)
    shape = requests.Shape(years, chart == "scatter", op is None, n_all, 1 if op else len(sources), negative, years)
    if op:
        rows = rows.withColumn("value", derive.derived(op, F.col("v0"), F.col("v1"), per)).where("value IS NOT NULL")
        units = [requests.column_unit(v["column"], s.unit, u) for v, s, u in zip(values, sources, units, strict=True)]
        unit = requests.derived_unit(op, units[0], units[1], int(per))
        notes += requests.operand_warnings(op, labels[1], units[1], sources[0].base_date, sources[1].base_date)
        labels, units = [requests.derived_label(op, labels[0], labels[1], int(per), units[1])], [unit]
    kind = requests.fitting_chart(shape, query) if chart == "auto" else requests.corrected_chart(chart, shape)
    kind, split = (kind, False) if op else _split_kind(kind, units, [v["largest"] or 0.0 for v in values], years)
    if chart not in ("auto", kind):
        notes.append(f"{chart} became {kind}")
    if kind == "scatter":
        rows = rows.dropna(subset=[f"v{n}" for n in range(len(sources))])
    sort = None if years else requests.sort_order(order, query)
    ties = ("first_source", "first_pos", "key")
    by_place = charts.year_key_order() if years else charts.leading_order("value" if op else "v0", sort == "descending", *ties) if sort else [*map(F.col, ties)]
    return Chart(kind, rows.orderBy(*by_place), [key for key, _ in chosen], labels, units, split, notes)


def first_rows(c: Chart) -> DataFrame:
    """The joined rows to show: the first of them only."""
    return c.rows.limit(derive.JOINED)
