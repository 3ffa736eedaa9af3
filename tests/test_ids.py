"""Ids where ranges of rows and the ranges' sizes are planned apart."""

import pytest
from pyspark.sql import functions as F

from tallyloom.sources import catalog


@pytest.fixture
def small_parts(spark):
    """Parts of a shuffle that are small are read together, as those of large tables are."""
    own = {"spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64KB", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1KB", "spark.sql.shuffle.partitions": "40"}
    before = {k: spark.conf.get(k) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_every_row_has_an_id_of_its_own(spark, small_parts):
    rows = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("n"), F.sha2(F.col("id").cast("string"), 512).alias("text"), F.lit(None).alias("nothing"))
    got = catalog.assign_ids(rows, ["n"], "stat_id", 5)
    assert got.columns == ["n", "text", "nothing", "stat_id"]
    assert sorted((r["n"], r["stat_id"]) for r in got.collect()) == [(n, n + 6) for n in range(5000)]
