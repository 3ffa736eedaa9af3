"""Chart data: records of x, series, value and pos, the place from which ties are broken."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import is_total

# Most categories, in a ring, and most series.
CATEGORIES, RING, SERIES = 20, 8, 12


def melt(rows: DataFrame, x: str, metrics: list[str], pos: str) -> DataFrame:
    """Metric columns to series; rows without a number are left out."""
    out = rows.unpivot([pos, x], metrics, "series", "value").where("value IS NOT NULL")
    return out.select(F.col(pos).alias("pos"), F.col(x).alias("x"), "series", "value")


def wide_years(rows: DataFrame, label: str, years: dict[str, int], pos: str, ends_only: bool = False) -> DataFrame:
    """Year columns to points in time, one series for each row; ends_only keeps the first and last year."""
    keep = {c: y for c, y in years.items() if not ends_only or y in (min(years.values()), max(years.values()))}
    names = F.create_map(*[F.lit(v) for kv in keep.items() for v in kv])
    out = rows.unpivot([pos, label], list(keep), "column", "value").where("value IS NOT NULL")
    return out.select(F.col(pos).alias("pos"), names[F.col("column")].alias("x"), F.col(label).alias("series"), "value")


def without_totals(records: DataFrame, *columns: str) -> DataFrame:
    for c in columns:
        records = records.where(~F.coalesce(is_total(F.col(c)), F.lit(False)))
    return records


def top_by_sum(records: DataFrame, by: str, n: int) -> DataFrame:
    """Records of the n groups of greatest sum of absolute values; of equal ones that which comes first. 0: all."""
    if not n:
        return records
    sums = records.groupBy(by).agg(F.sum(F.abs("value")).alias("s"), F.min("pos").alias("p"))
    return records.join(F.broadcast(sums.orderBy(F.col("s").desc(), "p").limit(n).select(by)), by, "left_semi")  # n rows


def first_categories(records: DataFrame, n: int) -> DataFrame:
    """Records of the n categories that come first, since a running sum can't do without one in between. 0: all."""
    if not n:
        return records
    first = records.groupBy("x").agg(F.min("pos").alias("p")).orderBy("p", "x").limit(n).select("x")
    return records.join(F.broadcast(first), "x", "left_semi")  # n rows


def ends_of_time(records: DataFrame) -> DataFrame:
    """Records of the first and last x, with end_no 0 and 1 and the place of the value between the least (0) and the greatest (1); 0.5 where all are equal."""
    ends = records.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    kept = records.join(F.broadcast(ends)).where("x = lo OR x = hi").withColumn("end_no", (F.col("x") == F.col("hi")).cast("int")).drop("lo", "hi")
    bounds = kept.agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    place = F.coalesce(F.try_divide(F.col("value") - F.col("lo"), F.col("hi") - F.col("lo")), F.lit(0.5))
    return kept.join(F.broadcast(bounds)).withColumn("place", place).drop("lo", "hi")  # one row each


def year_key_order(key: str = "key") -> list[Column]:
    """Years in order, then what is no year."""
    n = F.when(F.col(key).rlike("^[0-9]+$"), F.col(key).try_cast("bigint"))
    return [n.isNull(), n, F.col(key)]


def leading_order(value: str, descending: bool, *ties: str) -> list[Column]:
    """By the leading series; what it lacks comes last both ways."""
    v = F.col(value)
    return [v.desc_nulls_last() if descending else v.asc_nulls_last(), *map(F.col, ties)]


def sort_by_value(records: DataFrame, descending: bool = True) -> DataFrame:
    """order_no: categories by their sum, then by where they come first."""
    sums = records.groupBy("x").agg(F.sum("value").alias("total"), F.min("pos").alias("first_pos"))
    order = F.col("total").desc() if descending else F.col("total").asc()
    # A window over the categories, not over their records.
    return records.join(sums.withColumn("order_no", F.row_number().over(W.orderBy(order, "first_pos", "x"))), "x")


def time_order() -> list[Column]:
    """Numbers, then text, then nothing."""
    x = F.col("x").cast("string")
    n = x.try_cast("double")
    return [F.when(x.isNull(), 2).when(n.isNull(), 1).otherwise(0), n.asc_nulls_last(), x.asc_nulls_last(), F.col("series").asc_nulls_last()]


def deltas(points: DataFrame, by: list[str] = ()) -> DataFrame:
    """Change against the record before, whichever year that is of; the first has none and goes."""
    before = F.lag("value").over(W.partitionBy(*by).orderBy("x"))
    return points.withColumn("delta", F.col("value") - before).where("delta IS NOT NULL")


def ranks(records: DataFrame) -> DataFrame:
    return records.withColumn("rank", F.row_number().over(W.partitionBy("x").orderBy(F.col("value").desc(), "pos"))).withColumn("n_ranked", F.count(F.lit(1)).over(W.partitionBy("x")))


def shares(records: DataFrame) -> DataFrame:
    """Share of each positive value in the positive sum of its x."""
    v = F.greatest(F.col("value"), F.lit(0.0))
    s = F.sum(v).over(W.partitionBy("x"))
    return records.withColumn("share", F.when(s > 0, F.try_divide(v, s)).otherwise(0.0))


def waterfall(records: DataFrame, by: list[str] = ()) -> DataFrame:
    run = F.sum("value").over(W.partitionBy(*by).orderBy("pos").rowsBetween(W.unboundedPreceding, 0))
    return records.withColumn("end_value", run).withColumn("start_value", F.col("end_value") - F.col("value"))


def ring_angles(records: DataFrame, by: list[str] = ()) -> DataFrame:
    """Share of the ring and the middle of its arc, in radians."""
    w = W.partitionBy(*by)
    total = F.sum("value").over(w)
    run = F.sum("value").over(w.orderBy("pos").rowsBetween(W.unboundedPreceding, 0))
    return records.withColumn("share", F.try_divide("value", total)).withColumn("mid_angle", F.try_divide(run - F.col("value") / 2, total) * 2 * F.pi())


def marks(records: DataFrame) -> DataFrame:
    """is_top: greatest of its x; is_edge: at the first or last x."""
    r = records.withColumn("is_top", F.col("value") >= F.max("value").over(W.partitionBy("x")))
    ends = records.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    return r.join(F.broadcast(ends)).withColumn("is_edge", (F.col("x") == F.col("lo")) | (F.col("x") == F.col("hi"))).drop("lo", "hi")  # one row


def stack_order(records: DataFrame) -> DataFrame:
    names = records.select("series").distinct()
    return records.join(names.withColumn("stack_no", F.row_number().over(W.orderBy(F.col("series").desc())) - 1), "series")


def scale_ratio(records: DataFrame) -> DataFrame:
    """Ratio of the greatest to the least series by largest absolute value: 1 row."""
    tops = records.groupBy("series").agg(F.max(F.abs("value")).alias("m")).where("m > 0")
    return tops.agg(F.try_divide(F.max("m"), F.min("m")).alias("scale_ratio"))


def keep_apart(records: DataFrame, group: str, position: str, size: str, gap: float) -> DataFrame:
    """Labels that stay when each must be gap away from all greater ones that stay: a fold over a group's labels, which are few."""
    entries = F.array_sort(F.collect_list(F.struct((-F.col(size)).alias("n"), F.col(position).alias("p"), F.col("pos").alias("pos"))))
    stay = F.aggregate(entries, F.array().cast("array<struct<p:double,pos:bigint>>"), lambda kept, e: F.when(F.exists(kept, lambda k: F.abs(k["p"] - e["p"]) < gap), kept).otherwise(F.concat(kept, F.array(F.struct(e["p"].cast("double").alias("p"), e["pos"].cast("bigint").alias("pos"))))))
    shown = records.groupBy(group).agg(stay.alias("kept")).select(group, F.explode("kept.pos").alias("pos"))
    return records.join(shown, [group, "pos"], "left_semi")
