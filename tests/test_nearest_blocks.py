"""Nearest rows by blocks against the plain expression for every pair."""

import numpy as np
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.functions.vectors import cosine_distance
from tallyloom.operators import search


def plain(rows, queries, k):
    pairs = rows.where("v IS NOT NULL").crossJoin(queries).select("query_id", "id", (F.round(cosine_distance(F.col("v"), F.col("q")), 6) + F.lit(0.0)).alias("distance"))
    ranked = pairs.withColumn("n", F.row_number().over(W.partitionBy("query_id").orderBy(F.col("distance").asc_nulls_last(), "id")))
    return ranked.where(F.col("n") <= k).drop("n")


@pytest.mark.parametrize("k", [3, 20, 500])
def test_blocks_have_the_pairs_of_a_scan(spark, monkeypatch, k):
    monkeypatch.setattr(search, "ROW_BLOCK", 60)
    monkeypatch.setattr(search, "QUERY_BLOCK", 7)
    rng, inf, nan = np.random.default_rng(4), float("inf"), float("nan")
    some = rng.normal(size=(30, 5)).round(2).tolist()
    odd = [None, [], [0.0] * 5, [1.0, None, 2.0, 3.0, 4.0], [1.0, 2.0], [inf, 1.0, 0.0, 0.0, 0.0], [nan] * 5, [1e-200] * 5, [1e200] * 5, [1e-200, 0.0, 0.0, 0.0, 1.0]]
    vectors = [some[i % 30] if i % 4 else rng.normal(size=5).tolist() for i in range(150)] + [some[0]] * 40 + odd * 2
    rows = spark.createDataFrame(list(enumerate(vectors)), "id long, v array<double>").repartition(3)
    queries = rows.where("id % 20 = 0 OR id >= 190").select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    got = sorted(map(repr, search.nearest_each(rows, queries, "id", k, "v").collect()))
    assert got == sorted(map(repr, plain(rows, queries, k).collect())) and got


def test_pairs_are_not_rows(spark, data):
    from tallyloom.plans.queries import QUERIES

    plan = QUERIES["vector_topk_all"](spark, data)._jdf.queryExecution().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "CartesianProduct" not in plan
