"""A vector index: cells by k-means over a bounded sample, vectors written by cell, searches in the nearest cells only, exact distances there."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .search import nearest_in_groups

#: Vectors that cells are learned from at most, those of least hash of the item; that bounds what the driver gets.
SAMPLE = 20_000
ROUNDS = 12


def _unit(x: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, length, out=np.zeros_like(x), where=length > 0)


def learn_cells(rows: DataFrame, item: str, vector: str, cells: int) -> np.ndarray:
    """Centres of unit length; the first ones are spread over the sample."""
    sample = rows.where(F.col(vector).isNotNull()).orderBy(F.xxhash64(item), item).limit(SAMPLE).select(vector).toPandas()[vector]
    if not len(sample):
        return np.zeros((0, 0))
    x = _unit(np.array(sample.tolist(), np.float64))
    centres = x[np.linspace(0, len(x) - 1, min(cells, len(x))).astype(int)]
    for _ in range(ROUNDS):
        near = (x @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        centres = np.where(np.bincount(near, minlength=len(centres))[:, None] > 0, _unit(sums), centres)
    return centres


def _in_cells(rows: DataFrame, vector: str, centres: np.ndarray, probes: int) -> DataFrame:
    """rows with cell, once for each of the nearest `probes` cells."""
    kinds = dict(rows.dtypes)

    def run(frames):
        for f in frames:
            if len(f) and len(centres):
                near = np.argsort(-(_unit(np.array(f[vector].tolist(), np.float64)) @ centres.T), axis=1, kind="stable")[:, :probes]
                out = f.loc[f.index.repeat(near.shape[1])].reset_index(drop=True)
                yield out.assign(cell=near.ravel().astype(np.int32))

    return rows.where(F.col(vector).isNotNull()).mapInPandas(run, ", ".join([*(f"{c} {kinds[c]}" for c in rows.columns), "cell int"]))


def build(rows: DataFrame, item: str, vector: str, path: str, cells: int) -> None:
    """Write path/cells (item, vector, cell), in ranges of cell and item, and path/centres. Every vector is indexed; null vectors are not."""
    centres = learn_cells(rows, item, vector, cells)
    spark = rows.sparkSession
    spark.createDataFrame(list(enumerate(centres.tolist())), "cell int, centre array<double>").coalesce(1).write.parquet(f"{path}/centres")
    placed = _in_cells(rows.select(F.col(item).alias("item"), F.col(vector).alias("vector")), "vector", centres, 1)
    placed.repartitionByRange("cell", "item").sortWithinPartitions("cell", "item").write.parquet(f"{path}/cells")


def search(spark: SparkSession, path: str, queries: DataFrame, k: int, probes: int) -> DataFrame:
    """query_id, item, distance: the k nearest of the vectors in each query's nearest cells, by exact cosine distance. queries: query_id, q.

    With as many probes as there are cells the result is exact. Queries meet cells by an equal key, so the pairs grow with the probed cells, not with the table.
    """
    centres = np.array(spark.read.parquet(f"{path}/centres").orderBy("cell").toPandas()["centre"].tolist(), np.float64)
    if not len(centres):
        return spark.createDataFrame([], "query_id long, item long, distance double")
    asked = _in_cells(queries.select("query_id", "q"), "q", centres, min(probes, len(centres)))
    rows = spark.read.parquet(f"{path}/cells").withColumnRenamed("cell", "group")
    return nearest_in_groups(rows, asked.withColumnRenamed("cell", "group"), k)
