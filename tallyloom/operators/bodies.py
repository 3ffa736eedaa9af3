"""From a table's cells to its rows: captions off, spans spread out, headers joined, and blocks that were wrapped below the first put back beside it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import clean_label, label_key
from ..sources.staging import written
from . import cells, interpret


def fold_wrapped(long: DataFrame, keys: list[str]) -> DataFrame:
    """Cells (keys, row_no, col_no, column, text) with `folded`: tables whose header row comes again further down have the blocks below it as columns of the first block's rows.

    A block's row belongs to the row of the first block with its label, of several the last, else to the one at its place in the block. A table is left as it is where that
    cannot be meant: a block without rows, a name that is empty, repeats or is a column already, a row that fits nowhere, fewer than two columns or three rows.
    """
    cell = written(long.select(*keys, "row_no", "col_no", "column", "text"), "cells")
    order = W.partitionBy(*keys).orderBy("row_no")
    label = label_key(F.col("text"))
    heads = cell.where("col_no = 0").select(*keys, "row_no", label.alias("label"), (label == label_key(F.col("column"))).alias("same"))
    heads = heads.withColumn("mark", F.col("same") & (F.col("label") != "") & (F.col("row_no") > 0))
    heads = heads.withColumns({"block": F.sum(F.col("mark").cast("int")).over(order), "start": F.max(F.when(F.col("mark"), F.col("row_no"))).over(order)})
    shape = cell.groupBy(*keys).agg(F.count_distinct("row_no").alias("n_rows"), F.count_distinct("col_no").alias("n_cols"))
    wrapped = heads.groupBy(*keys).agg(F.max("block").alias("n_blocks"), F.count_if(F.col("block") == 0).alias("n_base")).join(shape, keys).where("n_blocks > 0 AND n_cols > 1 AND n_rows > 2")
    rows = written(heads.drop("same").join(wrapped, keys), "wrapped")
    base = rows.where("block = 0").select(*keys, "row_no", "label", (F.row_number().over(order) - 1).alias("place"))
    below = rows.where("block > 0 AND NOT mark").withColumn("place", F.col("row_no") - F.col("start") - 1)
    named = base.where("label <> ''").groupBy(*keys, "label").agg(F.max("row_no").alias("by_label"))
    placed = below.join(named, [*keys, "label"], "left").join(base.select(*keys, "place", F.col("row_no").alias("by_place")), [*keys, "place"], "left")
    placed = written(placed.select(*keys, "block", "row_no", F.coalesce("by_label", "by_place").alias("to_row")), "placed")
    marks = rows.where("mark").select(*keys, "row_no", "block", "n_cols")
    names = cell.join(marks, [*keys, "row_no"]).where("col_no > 0").withColumn("name", clean_label(F.col("text")))
    names = names.select(*keys, "block", "col_no", "name", (F.col("n_cols") + (F.col("block") - 1) * (F.col("n_cols") - 1) + F.col("col_no") - 1).cast("int").alias("to_col"))
    names = written(names, "names")
    columns = cell.select(*keys, F.col("column").alias("name")).distinct()
    faults = [
        rows.groupBy(*keys, "block").agg(F.count(F.lit(1)).alias("n")).where("block > 0 AND n = 1"), names.where("name = ''"), names.groupBy(*keys, "name").count().where("count > 1"), names.join(columns, [*keys, "name"], "left_semi"),
        placed.where("to_row IS NULL"),
    ]
    refused = faults[0].select(*keys)
    for f in faults[1:]:
        refused = refused.union(f.select(*keys))
    good = written(rows.select(*keys).distinct().join(refused.distinct(), keys, "left_anti"), "folded").withColumn("folded", F.lit(True))
    moved = cell.where("col_no > 0").drop("column").join(placed, [*keys, "row_no"]).join(names, [*keys, "block", "col_no"])
    values = moved.groupBy(*keys, F.col("to_row").alias("row_no"), F.col("to_col").alias("col_no")).agg(F.max_by("text", "row_no").alias("text"))
    # Every row of the first block has all of the new columns.
    places = base.select(*keys, "row_no").join(names.select(*keys, F.col("to_col").alias("col_no"), F.col("name").alias("column")), keys)
    added = places.join(values, [*keys, "row_no", "col_no"], "left").withColumn("text", F.coalesce("text", F.lit(""))).join(good, keys)
    first = cell.join(base.select(*keys, "row_no").withColumn("is_base", F.lit(True)), [*keys, "row_no"], "left").join(good, keys, "left")
    first = first.where("folded IS NULL OR is_base").withColumn("folded", F.coalesce("folded", F.lit(False))).drop("is_base")
    return first.unionByName(added.select(*first.columns))


def read_rows(spans: DataFrame, keys: list[str], n_cols: Column) -> DataFrame:
    """Cells with spans (keys, row, col, row_span, col_span, text) of any number of tables, read to (keys, row_no, col_no, column, text, folded)."""
    captions = interpret.caption_rows(spans, keys, n_cols, loading=False).select(*keys, F.col("row").alias("r"))
    grid = cells.expand_spans(spans, keys).join(captions, [*keys, "r"], "left_anti")
    return fold_wrapped(interpret.grid_cells(grid, keys, loading=False), keys)


def stored_rows(bodies: DataFrame, keys: list[str], body: str = "body") -> DataFrame:
    """Bodies that were stored as {"columns": […], "records": [{…}]}, read to the same rows. A body that is no such text has none."""
    parsed = bodies.select(*keys, F.from_json(body, "columns array<string>, records array<map<string,string>>").alias("b"))
    rows = parsed.select(*keys, F.col("b.columns").alias("columns"), F.posexplode("b.records").alias("row_no", "record"))
    long = rows.select(*keys, "row_no", "record", F.posexplode("columns").alias("col_no", "column"))
    return fold_wrapped(long.select(*keys, "row_no", "col_no", "column", clean_label(F.try_element_at("record", F.col("column"))).alias("text")), keys)
