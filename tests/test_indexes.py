"""The inverted index against scans of the texts, and the vector index against exact search."""

import collections
import glob

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from tallyloom.operators import inverted, search, vector_index
from tallyloom.plans.index_queries import CELLS, PROBES
from tallyloom.plans.queries import QUERIES, read


def test_index_has_the_rows_of_a_scan(spark, data, tmp_path):
    docs, path = read(spark, data, "documents"), str(tmp_path / "index")
    inverted.build(docs, "doc_id", "text", path)
    for words in (["the", "and"], ["The", "that", "the"], ["was"]):
        want = docs.select("doc_id", search.cover_density(F.col("text"), list(dict.fromkeys(w.lower() for w in words))).alias("s")).where("s > 0").collect()
        got = {r["item"]: r["score"] for r in inverted.ranked(spark, path, words, 10**6).collect()}
        assert got.keys() == {r["doc_id"] for r in want} and all(abs(got[r["doc_id"]] - r["s"]) < 1e-9 for r in want)
    assert inverted.ranked(spark, path, ["the", "nosuchword"], 5).count() == 0 and inverted.ranked(spark, path, [], 5).count() == 0


def test_index_reads_the_words_ranges_only(spark, data, tmp_path):
    path = str(tmp_path / "index")
    inverted.build(read(spark, data, "documents"), "doc_id", "text", path, ranges=100)
    words, total, met = ["the", "and", "that"], 0, collections.Counter()
    for f in glob.glob(f"{path}/postings/*.parquet"):
        meta = pq.ParquetFile(f).metadata
        for g in range(meta.num_row_groups):
            group = meta.row_group(g)
            total += group.total_byte_size
            s = group.column(0).statistics
            for w in words:
                met[w] += group.total_byte_size * (s.min <= w <= s.max)
    assert sum(met.values()) < total / 10 and all(met.values())
    plan = inverted.ranked(spark, path, words, 25)._jdf.queryExecution().toString()
    assert plan.count("EqualTo(word,") >= 3


def test_index_of_odd_rows(spark, tmp_path):
    rows = [(1, "b a x A"), (2, None), (3, ""), (4, "a"), (4, "b"), (5, "été, b_1 A b")]
    path = str(tmp_path / "index")
    inverted.build(spark.createDataFrame(rows, "id long, t string"), "id", "t", path)
    got = {r["item"]: (round(r["score"], 6), r["n_hits"]) for r in inverted.ranked(spark, path, ["a", "b"], 9).collect()}
    assert got == {1: (0.05, 3), 4: (0.1, 2), 5: (0.05, 2)}
    counts = {r["word"]: r["n_items"] for r in spark.read.parquet(f"{path}/words").collect()}
    assert counts == {"a": 3, "b": 3, "x": 1, "été": 1, "b_1": 1}


def test_places_are_gathered_before_the_shuffle(spark, data, tmp_path):
    path = str(tmp_path / "index")
    inverted.build(read(spark, data, "documents"), "doc_id", "text", path)
    # Not a row for each word of each text.
    n_places = spark.read.parquet(f"{path}/words").agg(F.sum("n_items")).first()[0]
    assert spark.read.parquet(f"{path}/postings").count() < n_places / 2
    plan = inverted.ranked(spark, path, ["the", "and"], 25)._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("ObjectHashAggregate(keys=[item") >= 2


def test_gathering_in_parts(monkeypatch):
    texts = [(7, ["a", "b", "a"]), (None, []), (8, ["b"]), (7, ["a"]), (9, []), (10, ["c", "a", "c", "a"])]
    want = collections.Counter((w, k, i) for k, ws in texts for i, w in enumerate(ws))
    batch = pa.RecordBatch.from_arrays([pa.array([k for k, _ in texts], pa.int64()), pa.array([ws for _, ws in texts], pa.list_(pa.string()))], names=["item", "tokens"])
    for at_once, items in ((1 << 20, 128), (1 << 20, 1), (3, 2), (1, 2)):
        monkeypatch.setattr(inverted, "AT_ONCE", at_once)
        monkeypatch.setattr(inverted, "ITEMS", items)
        for parts in ([batch], [batch.slice(0, 0), batch.slice(1, 3), batch.slice(4), batch.slice(0, 1)]):
            rows = [r for b in inverted._gather(iter(parts)) for r in b.to_pylist()]
            assert collections.Counter((r["word"], k, i) for r in rows for k, at in zip(r["items"], r["positions"], strict=True) for i in at) == want
            assert all(len(r["items"]) <= items and all(list(at) == sorted(at) for at in r["positions"]) for r in rows)


def test_index_of_items_in_several_rows(spark, tmp_path):
    rows = [("x", "a b"), ("x", "b a"), (None, "a"), (None, "a b"), ("y", "a")]
    path = str(tmp_path / "index")
    inverted.build(spark.createDataFrame(rows, "id string, t string"), "id", "t", path)
    assert {r["word"]: r["n_items"] for r in spark.read.parquet(f"{path}/words").collect()} == {"a": 3, "b": 2}
    hits = {r["item"]: [tuple(h) for h in r["hits"]] for r in inverted.containing(spark, path, ["a", "b"]).collect()}
    assert hits == {"x": [(0, "a"), (0, "b"), (1, "a"), (1, "b")]}
    assert {r["item"]: len(r["hits"]) for r in inverted.containing(spark, path, ["a"]).collect()} == {"x": 2, None: 2, "y": 1}


def test_recall_of_the_whole_query_set(spark, data):
    want = collections.defaultdict(dict)
    for r in QUERIES["vector_topk_all"](spark, data).collect():
        want[r["query_id"]][r["vec_id"]] = r["distance"]
    df = QUERIES["vector_index_topk"](spark, data)
    assert "CartesianProduct" not in df._jdf.queryExecution().toString() and "NestedLoop" not in df._jdf.queryExecution().toString()
    got = collections.defaultdict(dict)
    for r in df.collect():
        got[r["query_id"]][r["vec_id"]] = r["distance"]
    assert got.keys() == want.keys() and all(len(v) == 25 for v in got.values())
    recall = sum(len(got[q].keys() & want[q].keys()) for q in want) / sum(map(len, want.values()))
    assert recall >= 0.9 and PROBES < CELLS
    assert all(abs(want[q][i] - x) < 1e-9 for q in want for i, x in got[q].items() if i in want[q])


def test_all_cells_are_exact(spark, tmp_path):
    rows = [(i, [float((i * k) % 7 - 3) for k in range(1, 6)]) for i in range(60)] + [(100, None), (101, [0.0] * 5)]
    e = spark.createDataFrame(rows, "id long, v array<float>")
    path = str(tmp_path / "cells")
    vector_index.build(e, "id", "v", path, 8)
    queries = e.where("id IN (1, 9)").select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    got = sorted((r["query_id"], r["distance"], r["item"]) for r in vector_index.search(spark, path, queries, 5, 8).collect())
    want = sorted((r["query_id"], r["distance"], r["id"]) for r in search.nearest_each(e, queries, "id", 5, "v").collect())
    assert got == want
    none = str(tmp_path / "none")
    vector_index.build(e.where("id < 0"), "id", "v", none, 8)
    assert vector_index.search(spark, none, queries, 5, 2).count() == 0


def test_few_cells_do_where_vectors_have_a_structure(spark, tmp_path):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 16))
    rows = [(i, [float(v) for v in centres[i % 40] + 0.15 * rng.normal(size=16)]) for i in range(1200)]
    e, path = spark.createDataFrame(rows, "id long, v array<float>"), str(tmp_path / "cells")
    vector_index.build(e, "id", "v", path, 40)
    queries = e.where("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    want = {(r["query_id"], r["id"]) for r in search.nearest_each(e, queries, "id", 10, "v").collect()}
    got = {(r["query_id"], r["item"]) for r in vector_index.search(spark, path, queries, 10, 4).collect()}
    assert len(got & want) >= 0.95 * len(want)
