"""Joins whose sides grow with the input aren't broadcast, however small their files are."""

import pytest

from tallyloom.operators import chunks
from tallyloom.plans import table_queries  # noqa: F401, it adds its queries
from tallyloom.plans.queries import QUERIES


@pytest.mark.parametrize("name", ["table_from_grid", "table_exact_filters"])
def test_cells_are_not_broadcast(spark, data, name):
    plan = QUERIES[name](spark, data)._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_pieces_are_not_broadcast(spark):
    rows = spark.createDataFrame([("k", i, f"label {i}", 30) for i in range(50)], "key string, place long, label string, room int")
    plan = chunks.pack_rows(rows, "key", "place", "label", "room")._jdf.queryExecution().sparkPlan().toString()
    # Only the sizes of ranges are.
    assert plan.count("SortMergeJoin") == 2 and plan.count("BroadcastHashJoin") == 1


def test_editions_are_picked_once(spark, data, monkeypatch):
    read, load = [], table_queries.cat.load_edition

    def noted(loaded, new, path, *mode):
        read.extend(f for df in new.values() for f in df.inputFiles())
        load(loaded, new, path, *mode)

    monkeypatch.setattr(table_queries.cat, "load_edition", noted)
    QUERIES["edition_replace"](spark, data)
    assert read and not [f for f in read if "lineitem.parquet" in f or "orders.parquet" in f]
