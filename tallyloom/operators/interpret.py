"""Which columns, rows and values of a table a request means: over the long cells and column profiles of any number of tables at once.

long: cells.cells (keys, row_no, col_no, column, text, number, year); profiles: cells.profile of it. keys tell one table from another.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.names import canonical_key, is_whole
from ..functions.numbers import header_year, is_missing
from ..functions.text import clean_label, compact_hangul, display_label, is_total, label_key, label_keys, leaf, once, short_label
from ..sources.staging import shuffled, written

# Words by which a request names a column by what it holds.
YEAR_NAMES = ("year", "date", "연도", "년도")
CATEGORY_NAMES = ("category", "classification", "label", "name", "구분", "분류")
TOTAL_NAMES = ("total", "sum", "계", "합계")
JOINED_SOURCES = 5


def _first(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    ranked = df.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return ranked.where("_n = 1").drop("_n")


def resolve_columns(profiles: DataFrame, asked: DataFrame, keys: list[str]) -> DataFrame:
    """keys, requested, column, step for each asked (keys, requested) that names a column: by its key, one of its keys, its leaf, a part, or what it holds."""
    own = profiles.select(*keys, "column", "col_no", "is_year", "is_categorical", label_key(F.col("column")).alias("key"), label_keys(F.col("column")).alias("all_keys"), label_key(short_label(leaf(F.col("column")))).alias("leaf_key"))
    want = asked.select(*keys, "requested", label_key(F.col("requested")).alias("want"), label_keys(F.col("requested")).alias("wants"))
    key, want_key = F.col("key"), F.col("want")
    total = is_total(F.col("column")) | key.contains("total")
    holds = (want_key.isin(*YEAR_NAMES) & F.col("is_year")) | (want_key.isin(*CATEGORY_NAMES) & F.col("is_categorical")) | (want_key.isin(*TOTAL_NAMES) & total)
    step = (
        F.when(key == want_key, 1)
        .when(F.arrays_overlap("all_keys", "wants"), 2)
        .when((F.col("leaf_key") != "") & F.array_contains("wants", F.col("leaf_key")), 3)
        .when((want_key != "") & (key != "") & (key.contains(want_key) | want_key.contains(key)), 4)
        .when(holds, 5)
    )
    hits = own.join(shuffled(want), keys).withColumn("step", step).where("step IS NOT NULL")
    return _first(hits, [*keys, "requested"], F.col("step"), F.col("col_no")).select(*keys, "requested", "column", "step")


def resolve_values(long: DataFrame, asked: DataFrame, keys: list[str]) -> DataFrame:
    """keys, column, requested, value, candidates for each asked (keys, column, requested): the one cell text that it names.

    Exactly, by one of its keys, or as a part of two letters or more; where several texts fit equally well there is no value, and they are candidates.
    """
    texts = long.where(F.col("text") != "").select(*keys, "column", "text").distinct().withColumn("all_keys", label_keys(F.col("text")))
    want = asked.select(*keys, "column", F.col("requested"), clean_label(F.col("requested")).alias("plain"))
    want = want.withColumns({"want": label_key(F.col("plain")), "wants": label_keys(F.col("plain"))})
    part = (F.length("want") >= 2) & F.exists("all_keys", lambda k: k.contains(F.col("want")))
    step = F.when(F.col("text") == F.col("plain"), 1).when(F.arrays_overlap("all_keys", "wants"), 2).when(part, 3)
    group = [*keys, "column", "requested"]
    hits = want.join(shuffled(texts), [*keys, "column"], "left").withColumn("step", step)
    best = hits.withColumn("best", F.min("step").over(W.partitionBy(*group)))
    fits = F.array_sort(F.collect_set(F.when(F.col("step") == F.col("best"), F.col("text"))))
    out = best.groupBy(*group).agg(fits.alias("fits"))
    return out.select(*group, F.when(F.size("fits") == 1, F.get("fits", F.lit(0))).alias("value"), F.when(F.size("fits") > 1, F.col("fits")).otherwise(F.array().cast("array<string>")).alias("candidates"))


def exact_filters(long: DataFrame, profiles: DataFrame, filters: list[tuple[str, str]], keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows that pass, as cells, and (keys, requested, value, candidates) of each filter value, value null where it isn't found.

    Values of one column are alternatives; columns apply one after another. A table in which no value of a column is found, or none of the columns, keeps no row.
    """
    spark = long.sparkSession
    tables = profiles.select(*keys).distinct()
    by_column: dict[str, list[str]] = {}
    for column, value in filters:
        by_column.setdefault(column, []).append(value)
    notes, left = None, long
    for column, values in by_column.items():
        named = resolve_columns(profiles, tables.withColumn("requested", F.lit(column)), keys).select(*keys, "column")
        asked = named.join(F.broadcast(spark.createDataFrame([(v,) for v in values], "requested string")))  # the request's few values
        found = written(resolve_values(left, asked, keys), "found")
        notes = found if notes is None else notes.unionByName(found)
        rows = left.join(shuffled(found.where("value IS NOT NULL").select(*keys, "column", F.col("value").alias("text"))), [*keys, "column", "text"], "left_semi").select(*keys, "row_no").distinct()
        # A table without such a column isn't filtered by it, but needs one of the columns.
        kept = left.join(shuffled(rows), [*keys, "row_no"], "left_semi")
        # Written, so that a task holds the sorts of one column, and no column is resolved again for the next.
        left = written(kept.unionByName(left.join(shuffled(named.select(*keys).distinct()), keys, "left_anti")), "left") if len(by_column) > 1 else kept
    if notes is None:
        return long, spark.createDataFrame([], "requested string")
    return left.join(shuffled(notes.select(*keys).distinct()), keys, "left_semi"), notes


def _tokens(c: Column) -> Column:
    return F.filter(F.regexp_extract_all(F.lower(c), F.lit("([가-힣a-z0-9%]+)"), 1), lambda t: F.length(t) >= 2)


def column_scores(profiles: DataFrame, query: str, keys: list[str]) -> DataFrame:
    """keys, column, score: words of a column's name that the query holds."""
    n = F.size(F.filter(_tokens(F.col("column")), lambda t: F.lit(query.lower()).contains(t)))
    return profiles.select(*keys, "column", "col_no", n.alias("score"))


def named_column(profiles: DataFrame, query: str, keys: list[str]) -> DataFrame:
    """keys, column: that of which the query holds most words, of equal ones the first."""
    return _first(column_scores(profiles, query, keys).where("score > 0"), keys, F.col("score").desc(), F.col("col_no")).select(*keys, "column")


def x_column(profiles: DataFrame, query: str, keys: list[str]) -> DataFrame:
    """keys, column: a year column before one of categories before any; among equals that which the query names, then the first."""
    kind = F.when(F.col("is_year"), 0).when(F.col("is_categorical"), 1).otherwise(2)
    scored = profiles.join(column_scores(profiles, query, keys).drop("col_no"), [*keys, "column"]).withColumn("kind", kind)
    return _first(scored, keys, F.col("kind"), F.when(F.col("kind") < 2, -F.col("score")).otherwise(0), F.col("col_no")).select(*keys, "column")


def x_value() -> Column:
    """A cell as a place on the axis: a year or number as text of it where the column holds such, else the label to show."""
    return F.when(F.col("is_year"), F.coalesce(F.col("year").cast("string"), F.col("text"))).when(F.col("is_numeric") & F.col("number").isNotNull(), F.col("number").cast("string")).otherwise(display_label(F.col("text")))


def rows_of_year(long: DataFrame, profiles: DataFrame, year: int, keys: list[str]) -> DataFrame:
    """Cells of the rows whose first year column says so; a table without year columns stays whole."""
    first = _first(profiles.where("is_year"), keys, F.col("col_no")).select(*keys, "column")
    rows = long.where(F.col("year") == year).join(first, [*keys, "column"], "left_semi").select(*keys, "row_no").distinct()
    return long.join(rows, [*keys, "row_no"], "left_semi").unionByName(long.join(first.select(*keys), keys, "left_anti"))


def _categories(long: DataFrame, profiles: DataFrame, keys: list[str]) -> DataFrame:
    some = profiles.where("is_categorical").select(*keys, "column")
    return long.join(some, [*keys, "column"], "left_semi").withColumn("key", label_key(F.col("text"))).where("key <> ''")


def _rows_with(long: DataFrame, chosen: DataFrame, keys: list[str]) -> DataFrame:
    """Cells of the rows that have the chosen (keys, column, text)."""
    rows = long.join(chosen.select(*keys, "column", "text"), [*keys, "column", "text"], "left_semi").select(*keys, "row_no").distinct()
    return long.join(rows, [*keys, "row_no"], "left_semi")


def rows_of_place(long: DataFrame, profiles: DataFrame, place: str, keys: list[str]) -> DataFrame:
    """Cells of the rows with a cell of that name; a part of a name counts where it fits one text only, and no cell fits as a whole."""
    want = label_key(F.lit(place))
    cells = _categories(long, profiles, keys)
    fit = F.when(F.col("key") == want, 2).when((want != "") & (F.col("key").contains(want) | want.contains(F.col("key"))), 1)
    hits = cells.withColumn("fit", fit).where("fit IS NOT NULL").withColumn("best", F.max("fit").over(W.partitionBy(*keys))).where("fit = best")
    n = hits.groupBy(*keys).agg(F.count_distinct(F.struct("column", "text")).alias("n"))
    sure = hits.join(n, keys).where("best = 2 OR n = 1")
    return _rows_with(long, _first(sure, keys, F.col("row_no"), F.col("col_no")), keys)


def rows_in_query(long: DataFrame, profiles: DataFrame, query: str, keys: list[str]) -> DataFrame:
    """Cells of the rows with the longest label that the query holds; tables of which it holds none stay whole."""
    cells = _categories(long, profiles, keys)
    held = cells.where((F.length("key") >= 2) & label_key(F.lit(query)).contains(F.col("key")))
    longest = _first(held, keys, F.length("key").desc(), F.col("col_no"), F.col("row_no"))
    return _rows_with(long, longest, keys).unionByName(long.join(longest.select(*keys), keys, "left_anti"))


def select_rows(long: DataFrame, profiles: DataFrame, keys: list[str], year: int | None = None, place: str | None = None, query: str | None = None) -> DataFrame:
    """By year, then by place, or else by what the query names."""
    rows = long if year is None else rows_of_year(long, profiles, year, keys)
    if place:
        return rows_of_place(rows, profiles, place, keys)
    return rows_in_query(rows, profiles, query, keys) if query else rows


def focus_row(long: DataFrame, column: str, query: str, keys: list[str]) -> DataFrame:
    """keys, row_no, score: the row whose label has the longest term in the query, of equal ones the first."""
    want = label_key(F.lit(query))
    label = compact_hangul(F.col("text"))
    hangul = F.regexp_replace(label, "[^가-힣]+", "")
    words = F.filter(F.regexp_extract_all(F.lower(label), F.lit("([a-z0-9]+)"), 1), lambda t: F.length(t) >= 2)
    terms = F.concat(F.array(label_key(label), F.when(F.length(hangul) >= 2, hangul)), words)
    score = F.aggregate(F.filter(terms, lambda t: (t != "") & want.contains(t)), F.lit(0), lambda a, t: F.greatest(a, F.length(t)))
    rows = long.where(F.col("column") == column).withColumn("score", score).where("score > 0")
    return _first(rows, keys, F.col("score").desc(), F.col("row_no")).select(*keys, "row_no", "score")


def spread(long: DataFrame, keys: list[str]) -> DataFrame:
    """keys, column, n_values, n_filled_values: how many keys a column's cells have, with and without the missing."""
    key = label_key(F.col("text"))
    return long.groupBy(*keys, "column").agg(F.count_distinct(key).alias("n_values"), F.count_distinct(F.when(~is_missing(F.col("text")), key)).alias("n_filled_values"), F.count(F.lit(1)).alias("n_rows"))


def axis_or_other(long: DataFrame, profiles: DataFrame, x: DataFrame, keys: list[str]) -> DataFrame:
    """keys, column: x (keys, column), or where all of several rows share its value the first year column, or else categories, that tells rows apart."""
    s = spread(long, keys)
    collapsed = x.join(s, [*keys, "column"]).where("n_values = 1 AND n_rows > 1").select(*keys, F.col("column").alias("x"))
    others = profiles.where("is_year OR is_categorical").join(s.where("n_filled_values > 1"), [*keys, "column"]).join(collapsed, keys).where("column <> x")
    better = _first(others, keys, F.when(F.col("is_year"), 0).otherwise(1), F.col("col_no")).select(*keys, F.col("column").alias("other"))
    return x.join(better, keys, "left").select(*keys, F.coalesce("other", "column").alias("column"))


def year_columns(profiles: DataFrame, keys: list[str]) -> DataFrame:
    """keys, column, header_year of numeric columns whose names are points in time; none of a table in which two name one year."""
    found = profiles.where("is_numeric").select(*keys, "column", "col_no", header_year(F.col("column")).alias("header_year")).where("header_year IS NOT NULL")
    n = found.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("header_year").alias("m")).where("n = m").select(*keys)
    return found.join(n, keys, "left_semi")


def column_families(profiles: DataFrame, keys: list[str]) -> DataFrame:
    """keys, family, column, leaf, leaf_is_total: numeric or empty columns that share what stands before their first mark, two or more."""
    name = F.col("column")
    parts = profiles.where(name.contains("_") & (F.col("is_numeric") | F.col("is_missing_only"))).select(
        *keys, "column", "col_no", clean_label(F.substring_index(name, "_", 1)).alias("family"), F.substring(name, F.length(F.substring_index(name, "_", 1)) + 2, F.length(name)).alias("rest")
    )
    several = parts.groupBy(*keys, "family").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*keys, "family")
    shown = F.array_join(F.transform(F.split("rest", "_"), display_label), " / ")
    return parts.join(several, [*keys, "family"], "left_semi").select(*keys, "family", "column", "col_no", shown.alias("leaf"), is_total(F.substring_index("column", "_", -1)).alias("leaf_is_total"))


def family_categories(long: DataFrame, families: DataFrame, family: str, keys: list[str], totals: bool = False) -> DataFrame:
    """keys, row_no, x, value, pos: the family's columns of each row as categories. The family is named by its key, or by a part that fits one only."""
    want, key = label_key(F.lit(family)), label_key(F.col("family"))
    fit = F.when(key == want, 2).when((want != "") & (key.contains(want) | want.contains(key)), 1)
    names = families.select(*keys, "family").distinct().withColumn("fit", fit).where("fit IS NOT NULL").withColumn("best", F.max("fit").over(W.partitionBy(*keys))).where("fit = best")
    one = names.withColumn("n", F.count(F.lit(1)).over(W.partitionBy(*keys))).where("best = 2 OR n = 1").select(*keys, "family")
    chosen = families.join(one, [*keys, "family"], "left_semi")
    chosen = chosen if totals else chosen.where("NOT leaf_is_total")
    return long.join(chosen.select(*keys, "column", "leaf"), [*keys, "column"]).where("number IS NOT NULL").select(*keys, "row_no", F.col("leaf").alias("x"), F.col("number").alias("value"), F.col("col_no").alias("pos"))


def year_metrics(profiles: DataFrame, query: str, keys: list[str]) -> DataFrame:
    """keys, metric, column, header_year: of numeric columns named by a year and a metric those of the one metric that the query names, or of the first."""
    name = F.col("column")
    found = profiles.where(F.col("is_numeric") & name.contains("_")).select(
        *keys, "column", "col_no", header_year(F.substring_index(name, "_", 1)).alias("header_year"), clean_label(F.substring(name, F.length(F.substring_index(name, "_", 1)) + 2, F.length(name))).alias("metric")
    ).where("header_year IS NOT NULL")
    counted = found.groupBy(*keys, "metric").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("header_year").alias("m"), F.min("col_no").alias("first"))
    clash = counted.where("n <> m").select(*keys).distinct()
    score = F.size(F.filter(_tokens(F.col("metric")), lambda t: F.lit(query.lower()).contains(t)))
    chosen = _first(counted.where("n > 1").join(clash, keys, "left_anti").withColumn("score", score), keys, F.col("score").desc(), F.col("first")).select(*keys, "metric")
    return found.join(chosen, [*keys, "metric"], "left_semi").select(*keys, "metric", "column", "header_year")


def year_series(long: DataFrame, columns: DataFrame, label: str, keys: list[str], rows: DataFrame | None = None, totals: bool = True) -> DataFrame:
    """keys, pos, x, series, value: year columns (keys, column, header_year) to points, a series for each row; rows (keys, row_no): only these."""
    long = long if rows is None else long.join(rows.select(*keys, "row_no"), [*keys, "row_no"], "left_semi")
    names = long.where(F.col("column") == label).select(*keys, "row_no", display_label(F.col("text")).alias("series"))
    points = long.join(columns.select(*keys, "column", "header_year"), [*keys, "column"]).where("number IS NOT NULL").join(names, [*keys, "row_no"])
    out = points.select(*keys, F.col("row_no").alias("pos"), F.col("header_year").alias("x"), "series", F.col("number").alias("value"))
    return out if totals else out.where(~F.coalesce(is_total(F.col("series")), F.lit(False)))


def single_rows(long: DataFrame, profiles: DataFrame, keys: list[str]) -> DataFrame:
    """keys, x, value, pos: of tables of one row the metrics as categories."""
    one = long.groupBy(*keys).agg(F.count_distinct("row_no").alias("n")).where("n = 1").select(*keys)
    numeric = profiles.where("is_numeric").select(*keys, "column")
    cells = long.join(one, keys, "left_semi").join(numeric, [*keys, "column"], "left_semi").where("number IS NOT NULL")
    return cells.select(*keys, display_label(F.col("column")).alias("x"), F.col("number").alias("value"), F.col("col_no").alias("pos"))


def value_column(profiles: DataFrame, keys: list[str], key_column: str, requested: str | None = None, query: str | None = None, year: int | None = None) -> DataFrame:
    """keys, column, why: the asked numeric column, the only one, that which the query names, that of the year or of the last year, a total, or the first."""
    some = profiles.where(F.col("is_numeric") & (F.col("column") != key_column))
    asked = resolve_columns(profiles, some.select(*keys).distinct().withColumn("requested", F.lit(requested or "")), keys).select(*keys, "column", F.lit(True).alias("asked"))
    scored = some.join(asked, [*keys, "column"], "left").join(column_scores(some, query or "", keys).drop("col_no"), [*keys, "column"])
    scored = scored.join(year_columns(profiles, keys).select(*keys, "column", "header_year"), [*keys, "column"], "left").withColumn("n", F.count(F.lit(1)).over(W.partitionBy(*keys)))
    at_year = F.coalesce(F.col("header_year") == F.lit(year), F.lit(False))
    why = F.when(F.col("asked"), 0).when(F.col("n") == 1, 1).when(F.col("score") > 0, 2).when(at_year, 3).when(F.col("header_year").isNotNull(), 4).when(is_total(F.substring_index("column", "_", -1)), 5).otherwise(6)
    order = [F.col("why"), F.when(F.col("why") == 2, -F.col("score")).when(F.col("why") == 4, -F.col("header_year")).otherwise(0), F.col("col_no")]
    return _first(scored.withColumn("why", why), keys, *order).select(*keys, "column", "why")


def key_sets(sources: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """source, column, col_no, years, k: the canonical keys of each column that may be joined by; sources: (long, profiles) of one table each."""
    out = []
    for n, (long, profiles) in enumerate(sources):
        some = profiles.where("is_year OR is_categorical").select("column", "is_year")
        cells = long.join(some, "column").where(~is_missing(F.col("text"))).select("column", "col_no", "is_year", "text").distinct()
        key = F.when(F.col("is_year"), canonical_key(F.col("text"), True)).otherwise(canonical_key(F.col("text")))
        out.append(cells.select(F.lit(n).alias("source"), "column", "col_no", F.col("is_year").alias("years"), key.alias("k")).where(~is_whole(F.col("k")) & (F.col("k") != "")).distinct())
    return reduce(DataFrame.unionByName, out)


def choose_keys(sources: list[tuple[DataFrame, DataFrame]]) -> tuple[list[str], int] | None:
    """A column for each source such that most keys are shared by all, starting from each column of the first; and how many are. None if no key is.

    Tables are few and what comes to the driver is one row for each step.
    """
    if not 2 <= len(sources) <= JOINED_SOURCES:
        raise ValueError(f"two to {JOINED_SOURCES} sources")
    sets = key_sets(sources).persist()
    try:
        best: tuple[list[str], int] | None = None
        order = [F.col("n").desc(), F.col("years").desc(), F.col("col_no")]
        for first in sets.where("source = 0").select("column", "years", "col_no").distinct().orderBy(F.col("years").desc(), "col_no").collect():
            chosen, shared = [first["column"]], sets.where((F.col("source") == 0) & (F.col("column") == first["column"])).select("k")
            n = 0
            for at in range(1, len(sources)):
                hit = sets.where(F.col("source") == at).join(shared, "k").groupBy("column", "years", "col_no").agg(F.count(F.lit(1)).alias("n")).orderBy(*order).first()
                if hit is None:
                    break
                chosen.append(hit["column"])
                shared, n = shared.join(sets.where((F.col("source") == at) & (F.col("column") == hit["column"])).select("k"), "k", "left_semi"), hit["n"]
            if len(chosen) == len(sources) and (best is None or n > best[1]):
                best = (chosen, n)
        return best
    finally:
        sets.unpersist()


def chart_records(records: DataFrame, query: str | None = None, totals: str = "auto", year: int | None = None) -> DataFrame:
    """Chart records without totals unless they are asked for, of the year if any is of it, and of the categories that the query names if any is."""
    if totals != "include":
        records = records.where(~F.coalesce(is_total(F.col("x").cast("string")), F.lit(False)) & ~F.coalesce(is_total(F.col("series")), F.lit(False)))
    conditions = [] if year is None else [F.coalesce(F.col("x").cast("string").try_cast("int") == year, F.lit(False))]
    if query:
        held = lambda c: once(label_key(F.col(c).cast("string")), lambda k: (F.length(k) >= 2) & label_key(F.lit(query)).contains(k) & ~k.rlike("^(18|19|20)[0-9]{2}"))
        conditions += [F.coalesce(held(c), F.lit(False)) for c in ("x", "series")]
    for fits in conditions:
        marked = records.withColumn("_fits", fits)
        any_fits = marked.agg(F.max("_fits").alias("_any"))  # one row
        records = marked.join(F.broadcast(any_fits)).where("_fits OR NOT _any").drop("_fits", "_any")
    return records


# ---- tables as grids of cells ----


def flow_grid(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Cells (row, seq, row_span, col_span, text) without column numbers to one row for each place: every cell goes to the first place of its row that is free.

    A fold over a table's cells, which are few; the state is the set of taken places.
    """
    cell = F.array_sort(F.collect_list(F.struct("row", "seq", F.greatest(F.col("row_span"), F.lit(1)).alias("rs"), F.greatest(F.col("col_span"), F.lit(1)).alias("cs"), "text")))
    start = F.struct(F.array().cast("array<struct<r:int,c:int>>").alias("taken"), F.array().cast("array<struct<r:int,c:int,text:string>>").alias("out"))

    def put(state: Column, x: Column) -> Column:
        free = F.filter(F.sequence(F.lit(0), F.size(state["taken"])), lambda c: ~F.exists(state["taken"], lambda t: (t["r"] == x["row"]) & (t["c"] == c)))
        at = F.get(free, F.lit(0))
        places = F.flatten(F.transform(F.sequence(F.lit(0), x["rs"] - 1), lambda i: F.transform(F.sequence(F.lit(0), x["cs"] - 1), lambda j: F.struct((x["row"] + i).cast("int").alias("r"), (at + j).cast("int").alias("c")))))
        filled = F.transform(places, lambda p: F.struct(p["r"].alias("r"), p["c"].alias("c"), x["text"].alias("text")))
        return F.struct(F.concat(state["taken"], places).alias("taken"), F.concat(state["out"], filled).alias("out"))

    grid = spans.groupBy(*keys).agg(F.aggregate(cell, start, put, lambda s: s["out"]).alias("places"))
    return grid.select(*keys, F.inline("places"))


def caption_rows(spans: DataFrame, keys: list[str], n_cols: Column, loading: bool = True) -> DataFrame:
    """keys, row, text: rows that are a caption. Loading: one filled cell over all columns, in the first three rows or with a date or unit; reading: a first cell over all columns."""
    if not loading:
        return _first(spans, [*keys, "row"], F.col("col")).where(F.col("col_span") >= n_cols).select(*keys, "row", "text")
    filled = spans.where(clean_label(F.col("text")) != "")
    one = filled.withColumn("n", F.count(F.lit(1)).over(W.partitionBy(*keys, "row"))).where((F.col("n") == 1) & (F.col("col_span") >= n_cols))
    return one.where((F.col("row") <= 2) | F.col("text").rlike(r"[0-9]{4}\.\s*[0-9]{1,2}\.\s*[0-9]{1,2}\.?\s*기준|단위\s*[:：]")).select(*keys, "row", "text")


def active_columns(spans: DataFrame, keys: list[str]) -> DataFrame:
    """keys, c: columns in which a filled cell begins."""
    return spans.where(clean_label(F.col("text")) != "").select(*keys, F.col("col").alias("c")).distinct()


# Words of a header row.
HEADER_WORDS = ("구분", "분류", "연도", "년도", "기관", "지역", "성별", "유형", "classification", "year", "type", "region", "organization", "institution", "category")


def row_kinds(grid: DataFrame, keys: list[str], loading: bool = True) -> DataFrame:
    """keys, r, is_data, is_header, n_filled for each row of a grid (keys, r, c, text) by its words, numbers and years."""
    from ..functions.numbers import parse_number

    text = clean_label(F.col("text"))
    year = text.rlike("^(18|19|20)[0-9]{2}")
    filled, number = text != "", parse_number(F.col("text")).isNotNull()
    low = F.lower(text)
    word = reduce(lambda a, b: a | b, [low.contains(w) for w in HEADER_WORDS])
    n = grid.groupBy(*keys, "r").agg(F.count_if(filled).alias("n_filled"), F.count_if(number).alias("n_numbers"), F.count_if(year & filled).alias("n_years"), F.count_if((number | year) & filled).alias("n_like"), F.coalesce(F.bool_or(word), F.lit(False)).alias("word"))
    header = F.col("word") | ((F.col("n_filled") >= 2) & (F.col("n_numbers") > 0) & (F.col("n_numbers") == F.col("n_years")))
    data = (F.col("n_numbers") >= 2) | ((F.col("n_numbers") >= 1) & (F.col("n_filled") >= 2)) if loading else F.col("n_like") >= 1
    return n.select(*keys, "r", "n_filled", data.alias("is_data"), header.alias("is_header"))


def header_ends(kinds: DataFrame, keys: list[str], loading: bool = True) -> DataFrame:
    """keys, first_data: the row with which the data begin. Loading: a data row that doesn't look like a header, not the first; reading: any data row; else the second row."""
    rows = kinds.where("n_filled > 0").withColumn("at", F.row_number().over(W.partitionBy(*keys).orderBy("r")) - 1)
    fits = F.col("is_data") & ~F.col("is_header") & (F.col("at") > 0) if loading else F.col("is_data")
    return rows.groupBy(*keys).agg(F.coalesce(F.min(F.when(fits, F.col("r"))), F.min(F.when(F.col("at") == 1, F.col("r"))), F.min("r")).alias("first_data"))


def grid_cells(grid: DataFrame, keys: list[str], loading: bool = True) -> DataFrame:
    """A grid without captions to cells (keys, row_no, col_no, column, text): header rows joined to names, data rows below, headers that repeat left out."""
    from . import cells

    ends = header_ends(row_kinds(grid, keys, loading), keys, loading)
    known = grid.join(shuffled(ends), keys)
    names = cells.header_names(known, keys, F.greatest(F.col("first_data"), F.lit(1)))
    if not loading:
        names = names.withColumn("column", F.regexp_replace("column", "_([0-9]+)$", " #$1"))
    width = names.groupBy(*keys).agg(F.count(F.lit(1)).alias("width"))
    data = known.where("r >= first_data").join(shuffled(names), [*keys, "c"]).withColumn("text", clean_label(F.col("text"))).join(shuffled(width), keys)
    same = data.groupBy(*keys, "r").agg(F.count_if(F.col("text") == F.col("column")).alias("same"), F.max("width").alias("width"), F.count_if(F.col("text") != "").alias("filled"))
    repeats = F.col("same") >= (F.greatest(F.lit(2), F.floor(F.col("width") / 2)) if loading else F.least(F.lit(2), F.col("width")))
    kept = same.where(~repeats & (F.col("filled") > 0)).withColumn("row_no", F.row_number().over(W.partitionBy(*keys).orderBy("r")) - 1).select(*keys, "r", "row_no")
    return data.join(shuffled(kept), [*keys, "r"]).select(*keys, "row_no", F.col("c").alias("col_no"), "column", "text")


def markdown(long: DataFrame, keys: list[str]) -> DataFrame:
    """keys, table_md: cells as a Markdown table."""
    from ..functions.requests import markdown_row

    rows = long.groupBy(*keys, "row_no").agg(F.array_sort(F.collect_list(F.struct("col_no", "text", "column"))).alias("x"))
    whole = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("row_no", "x"))).alias("rows"))
    head = F.get("rows", F.lit(0))["x"]
    lines = F.concat(
        F.array(markdown_row(F.transform(head, lambda c: c["column"])), markdown_row(F.transform(head, lambda c: F.lit("---")))), F.transform("rows", lambda r: markdown_row(F.transform(r["x"], lambda c: c["text"])))
    )
    return whole.select(*keys, F.array_join(lines, "\n").alias("table_md"))
