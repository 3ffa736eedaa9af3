"""Queries over whole tables against brute force."""

import collections

import numpy as np

from tallyloom.plans.queries import QUERIES, read


def test_search_of_all_rows(spark, data):
    rows = read(spark, data, "embeddings").collect()
    vectors = {r["vec_id"]: np.array(r["embedding"], float) for r in rows}
    got = collections.defaultdict(list)
    for r in QUERIES["vector_topk_all"](spark, data).collect():
        got[r["query_id"]].append((r["distance"], r["vec_id"]))
    assert set(got) == {i for i in vectors if i % 20 == 0}
    for i, found in got.items():
        q = vectors[i]
        want = sorted(1 - v @ q / np.linalg.norm(v) / np.linalg.norm(q) for v in vectors.values())[:25]
        assert np.allclose(sorted(x for x, _ in found), want, atol=2e-6)


def test_words_of_all_languages(spark, tmp_path):
    spark.createDataFrame([(1, "the and that", "en"), (2, "the and that the", "de")], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    assert [tuple(r) for r in QUERIES["lexical_topk_all"](spark, str(tmp_path)).collect()] == [(2, 4), (1, 3)]


def test_fusion_for_each_query(spark, data):
    near = collections.defaultdict(list)
    for r in QUERIES["vector_topk_all"](spark, data).collect():
        near[r["query_id"]].append((r["distance"], r["vec_id"]))
    words = sorted((-r["score"], r["doc_id"]) for r in QUERIES["lexical_topk_all"](spark, data).collect())
    want = collections.Counter()
    for q, found in near.items():
        for weight, ranked in ((3.0, words), (1.8, sorted(found))):
            for k, (_, i) in enumerate(ranked):
                want[q, i] += weight / (11 + k)
    got = {(r["query_id"], r["doc_id"]): r["score"] for r in QUERIES["rrf_fusion_all"](spark, data).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-5 for k in want)
