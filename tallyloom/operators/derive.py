"""Alignment of several tables on a canonical key, and metrics derived from them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import canonical_key, is_whole

OPS = ("ratio", "per_capita", "share", "difference")
# Words that make a column a ratio, and the steps of automatic scales.
RATIO_WORDS = ("비율", "구성비", "증감률", "rate", "ratio", "percent", "%")
AUTO_BELOW, AUTO_STEPS = 0.1, (1_000, 10_000, 100_000, 1_000_000)
SOURCES, JOINED = 5, 60


def is_ratio(name: str) -> bool:
    return any(w in name.lower() for w in RATIO_WORDS)


def series_points(rows: DataFrame, label: str, value: str, years: bool = False) -> DataFrame:
    """key, value: ratios of a key are averaged, all else is summed; keys of the whole are left out.

    Rows are combined by their labels as they stand first, so that keys are made of the few distinct labels only.
    """
    pos = F.col("pos") if "pos" in rows.columns else F.lit(0)
    raw = rows.select(F.col(label).alias("label"), F.col(value).alias("v"), pos.alias("pos")).where("v IS NOT NULL")
    labels = raw.groupBy("label").agg(F.sum("v").alias("v"), F.count(F.lit(1)).alias("n"), F.min("pos").alias("pos"))
    total = F.try_divide(F.sum("v"), F.sum("n")) if is_ratio(value) else F.sum("v")
    keyed = labels.groupBy(canonical_key(F.col("label"), years).alias("key")).agg(total.alias("value"), F.min("pos").alias("pos"))
    return keyed.where(~is_whole(F.col("key")))


def align(series: dict[str, DataFrame], how: str = "outer") -> DataFrame:
    """One row for each key, one column for each series."""
    if not 1 <= len(series) <= SOURCES:
        raise ValueError(f"one to {SOURCES} sources")
    frames = [df.select("key", F.col("value").alias(name)) for name, df in series.items()]
    return reduce(lambda a, b: a.join(b, "key", how), frames)


def shared_keys(left: DataFrame, right: DataFrame, left_cols: list[str], right_cols: list[str]) -> DataFrame:
    """For each pair of key columns, how many canonical keys they share; keys are made distinct before they meet."""

    def keys(df: DataFrame, cols: list[str], name: str) -> DataFrame:
        return df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("c"), canonical_key(F.col(c).cast("string")).alias("k")) for c in cols])).alias("e")).select(F.col("e.c").alias(name), F.col("e.k").alias("k")).where("k <> ''").distinct()

    return keys(left, left_cols, "left_column").join(keys(right, right_cols, "right_column"), "k").groupBy("left_column", "right_column").agg(F.count(F.lit(1)).alias("n_shared"))


def derived(op: str, numerator: Column, denominator: Column, per: float = 1.0) -> Column:
    """Null where the denominator is zero; such keys are to be left out and named."""
    if op not in OPS:
        raise ValueError(f"unknown metric: {op}")
    if op == "difference":
        return numerator - denominator
    return F.try_divide(numerator, denominator) * {"ratio": 1.0, "share": 100.0, "per_capita": float(per)}[op]


def derive(op: str, numerator: DataFrame, denominator: DataFrame, per: float = 1.0) -> DataFrame:
    """key, numerator, denominator, value for the keys of both; each operand is summed before the division."""
    both = numerator.select("key", F.col("value").alias("numerator")).join(denominator.select("key", F.col("value").alias("denominator")), "key")
    return both.withColumn("value", derived(op, F.col("numerator"), F.col("denominator"), per)).where("value IS NOT NULL")


def auto_scale(largest: Column) -> Column:
    """The least step that brings the largest value to 1 or more, where it is under a tenth."""
    m = F.abs(largest)
    out = F.lit(AUTO_STEPS[-1])
    for step in reversed(AUTO_STEPS):
        out = F.when(m * step >= 1, F.lit(step)).otherwise(out)
    return F.when((m <= 0) | (m >= AUTO_BELOW) | m.isNull(), F.lit(1)).otherwise(out)


def component_sums(rows: DataFrame, total: str, parts: list[str]) -> DataFrame:
    """adds_up: whether the total is the sum of its parts, to a millionth."""
    s = reduce(lambda a, b: a + b, [F.coalesce(F.col(p), F.lit(0.0)) for p in parts])
    return rows.withColumn("parts_sum", s).withColumn("adds_up", F.abs(F.col(total) - s) <= F.greatest(F.lit(1e-9), F.abs(F.col(total)) * 1e-6))


def pairs(rows: DataFrame, label: str, x: str, y: str) -> DataFrame:
    """Points of two metrics; incomplete ones are left out."""
    return rows.select(F.col(label).alias("label"), F.col(x).alias("x"), F.col(y).alias("y")).dropna(subset=["x", "y"])


def joined_rows(records: DataFrame, key: str, series: list[str], limit: int | None = None) -> DataFrame:
    """Long records to one column for each of the named series; of records that share key and series the first by pos. limit: so many rows, by key."""
    first = F.min_by("value", "pos") if "pos" in records.columns else F.min("value")
    wide = records.groupBy(key).pivot("series", series).agg(first)
    return wide if limit is None else wide.orderBy(F.col(key).asc_nulls_last()).limit(limit)
