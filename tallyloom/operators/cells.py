"""Tables whose columns differ from row to row, as one long table of cells."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.names import region_variants
from ..functions.numbers import is_missing, parse_number, parse_year
from ..functions.text import clean_label, label_key

BODY = "struct<columns:array<string>,records:array<map<string,string>>>"
#: Share of a column's values that must be numbers, or years, for it to count as such.
SHARE = 0.6
MATCHES = 20


def cells(tables: DataFrame, keys: list[str], body: str = "body") -> DataFrame:
    """keys, row_no, col_no, column, text, number, year for each cell; body is the struct or its JSON."""
    t = tables.withColumn("_b", F.from_json(body, BODY) if dict(tables.dtypes)[body] == "string" else F.col(body))
    rows = t.select(*keys, F.col("_b.columns").alias("_c"), F.posexplode("_b.records").alias("row_no", "_r"))
    long = rows.select(*keys, "row_no", "_r", F.posexplode("_c").alias("col_no", "column"))
    text = clean_label(F.col("_r")[F.col("column")])
    return long.select(*keys, "row_no", "col_no", "column", text.alias("text")).withColumns({"number": parse_number(F.col("text")), "year": parse_year(F.col("text"))})


def profile(long: DataFrame, keys: list[str], *more: Column) -> DataFrame:
    """For each column: filled cells, shares of numbers and years, and what it is; more: further aggregates to take along."""
    filled = ~is_missing(F.col("text"))
    n = F.count_if(filled)
    share = lambda c: F.bround(F.coalesce(F.try_divide(F.count_if(filled & F.col(c).isNotNull()).cast("double"), n), F.lit(0.0)), 3)
    p = long.groupBy(*keys, "column").agg(F.min("col_no").alias("col_no"), n.alias("n_filled"), share("number").alias("numeric_ratio"), share("year").alias("year_ratio"), *more)
    year = F.col("year_ratio") >= SHARE
    numeric = (F.col("numeric_ratio") >= SHARE) & ~year
    return p.withColumns({"is_year": year, "is_numeric": numeric, "is_categorical": (F.col("n_filled") > 0) & ~year & ~numeric, "is_missing_only": F.col("n_filled") == 0})


def exact_filters(rows: DataFrame, filters: list[tuple[str, str]]) -> DataFrame:
    """Values of one column are alternatives, columns apply one after another; nothing found is nothing."""
    by_column: dict[str, list[str]] = {}
    for name, value in filters:
        by_column.setdefault(name, []).append(value)
    for name, values in by_column.items():
        asked = [label_key(F.lit(v)) for v in values]
        rows = rows.where(reduce(lambda a, b: a | b, [label_key(F.col(name)) == k for k in asked]))
    return rows


def rows_by_label(long: DataFrame, keys: list[str], label: str, limit: int = MATCHES) -> DataFrame:
    """Rows one of whose cells is the label or another name of it; only where there is none, rows that contain it."""
    forms = [label_key(F.lit(v)) for v in region_variants(label)]
    key = label_key(F.col("text"))
    exact = reduce(lambda a, b: a | b, [key == f for f in forms])
    part = reduce(lambda a, b: a | b, [key.contains(f) for f in forms])
    rows = long.groupBy(*keys, "row_no").agg(F.max(F.when(exact, 2).when(part, 1).otherwise(0)).alias("fit"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("column", "text")))).alias("record"))
    best = rows.withColumn("best", F.max("fit").over(W.partitionBy(*keys)))
    hits = best.where("fit > 0 AND fit = best").withColumn("n_matched", F.count(F.lit(1)).over(W.partitionBy(*keys)))
    return hits.withColumn("place", F.row_number().over(W.partitionBy(*keys).orderBy("row_no"))).where(F.col("place") <= limit).drop("best", "fit")


def expand_spans(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Cells (row, col, row_span, col_span, text) to one row for each place of the grid; a later cell wins."""
    rows = spans.withColumn("r", F.explode(F.sequence(F.col("row"), F.col("row") + F.col("row_span") - 1))).withColumn("c", F.explode(F.sequence(F.col("col"), F.col("col") + F.col("col_span") - 1)))
    return rows.groupBy(*keys, "r", "c").agg(F.max_by("text", F.struct("row", "col")).alias("text"))


def header_names(grid: DataFrame, keys: list[str], header_rows: Column) -> DataFrame:
    """Names of columns from several header rows: their distinct parts joined; a name that repeats gets a number."""
    parts = grid.where(F.col("r") < header_rows).groupBy(*keys, "c").agg(F.array_sort(F.collect_list(F.struct("r", "text"))).alias("p"))
    named = parts.select(*keys, "c", F.array_join(F.array_distinct(F.filter(F.transform("p", lambda x: clean_label(x["text"])), lambda t: t != "")), "_").alias("name"))
    n = F.row_number().over(W.partitionBy(*keys, "name").orderBy("c"))
    return named.withColumn("n", n).select(*keys, "c", F.when(F.col("n") > 1, F.concat("name", F.lit("_"), F.col("n").cast("string"))).otherwise(F.col("name")).alias("column"))


def merge_parts(long: DataFrame, stat: str = "stat_id", part: str = "table_seq") -> DataFrame:
    """Parts of one table, as cells: a part with the columns of the first continues its rows, one with its row labels continues its columns."""
    shape = long.groupBy(stat, part).agg(F.array_sort(F.collect_set(F.struct("col_no", "column"))).alias("cols"), F.array_sort(F.collect_set(F.when(F.col("col_no") == 0, F.struct("row_no", "text")))).alias("labels"), (F.max("row_no") + 1).alias("n"), (F.max("col_no") + 1).alias("m"))
    head = F.first(F.struct("cols", "labels", "n")).over(W.partitionBy(stat).orderBy(part))
    s = shape.withColumn("head", head).withColumn("wide", (F.col("cols") != F.col("head.cols")) & (F.col("labels") == F.col("head.labels")))
    before = W.partitionBy(stat).orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    s = s.withColumn("row_base", F.when(F.col("wide"), 0).otherwise(F.coalesce(F.sum(F.when(~F.col("wide"), F.col("n"))).over(before), F.lit(0))))
    s = s.withColumn("col_base", F.when(F.col("wide"), F.coalesce(F.sum("m").over(before), F.lit(0))).otherwise(0))
    out = long.join(s.select(stat, part, "wide", "row_base", "col_base"), [stat, part])
    out = out.where(~F.col("wide") | (F.col("col_no") > 0))
    return out.withColumn("row_no", F.col("row_no") + F.col("row_base")).withColumn("col_no", F.col("col_no") + F.col("col_base")).drop("wide", "row_base", "col_base", part)


def fold_blocks(long: DataFrame, keys: list[str]) -> DataFrame:
    """Cells of a table that repeats its header row to go on to the right: each block's rows go back to the label that they have in the first."""
    labels = long.groupBy(*keys, "row_no").agg(F.max(F.when(F.col("col_no") == 0, F.col("text"))).alias("label"), F.count_if(F.col("text") == F.col("column")).alias("same"), F.count(F.lit(1)).alias("n"))
    labels = labels.withColumn("header", 2 * F.col("same") >= F.col("n")).withColumn("block", F.sum(F.col("header").cast("int")).over(W.partitionBy(*keys).orderBy("row_no")))
    first = labels.where("block = 0 AND NOT header").groupBy(*keys, F.col("label").alias("own")).agg(F.min("row_no").alias("to_row"))
    back = labels.where("NOT header").join(first, [*keys]).where(F.col("label") == F.col("own")).select(*keys, "row_no", "block", "to_row")
    return long.join(back, [*keys, "row_no"]).withColumn("row_no", F.col("to_row")).drop("to_row")


def carry_forward(blocks: DataFrame, doc: str, order: str, heading: Column) -> DataFrame:
    """Each block with the last heading before it in its document."""
    return blocks.withColumn("heading", F.last(heading, ignorenulls=True).over(W.partitionBy(doc).orderBy(order).rowsBetween(W.unboundedPreceding, 0)))


def sequence_gaps(items: DataFrame, group: str, number: str) -> DataFrame:
    """Numbers that do not follow the one before by one."""
    before = F.lag(number).over(W.partitionBy(group).orderBy(number))
    return items.withColumn("expected", before + 1).where(F.col("expected").isNotNull() & (F.col(number) != F.col("expected")))
