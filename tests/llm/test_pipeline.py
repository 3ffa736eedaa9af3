"""The pipeline's stages on a small table with planted cases."""

import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rnd = random.Random(9)
    words = ["w%d" % i for i in range(2000)]
    rows = []
    for i in range(300):
        text = " ".join(rnd.choice(words) for _ in range(80))
        rows.append([i, text + (" grumblefoo" if i % 6 == 0 else "")])
    passage = " ".join(rnd.choice(words) for _ in range(60))
    rows[7][1] += " " + passage
    rows[11][1] = passage + " " + rows[11][1]
    rows.append([300, rows[1][1]])  # a copy
    rows.append([301, rows[2][1].replace("w", "W", 3) + " tail"])  # a near copy
    rows += [[302, None], [303, ""]]
    path = tmp_path_factory.mktemp("pipeline")
    spark.createDataFrame([(i, t, "en", "ab"[i % 2], len(t or ""), "more") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, extra string").repartition(4).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 6 == 0)) for i in range(300)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path), dict(map(tuple, rows)), passage


def test_stages(spark, folder):
    path, rows, passage = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialize(stage(spark, docs, path), f"test-{name}")
        kept[name] = docs.collect()
        if name != "pack":
            assert docs.columns == corpus_pipeline.COLUMNS
    ids = lambda name: {r["doc_id"] for r in kept[name]}
    assert len(ids("toxicity") & {i for i in range(300) if i % 6 == 0}) <= 2 and len({i for i in range(300) if i % 6} - ids("toxicity")) <= 3
    assert {300, 301}.isdisjoint(ids("ngram_jaccard_join")) and {1, 2, 302, 303} <= ids("ngram_jaccard_join")
    assert ids("suffix_array_dedup") == ids("ngram_jaccard_join")
    texts = {r["doc_id"]: r["text"] for r in kept["suffix_array_dedup"]}
    assert texts[7] == rows[7] and passage not in texts[11] and texts[11].endswith(rows[11][-200:]) and texts[302] is None
    assert all(r["n_chars"] == len(r["text"] or "") for r in kept["suffix_array_dedup"])
    assert ids("mix_sources") <= ids("suffix_array_dedup")
    copies = len(kept["mix_sources"])
    assert len({(r["sequence_id"], r["offset"]) for r in kept["pack"]}) == len(kept["pack"]) >= copies


def test_near_copies_of_null_and_shared_ids(spark):
    text = lambda k: " ".join(f"{k}w{i}" for i in range(80))
    rows = [(None, text(0)), (3, text(0) + " tail"), (None, text(1)), (None, text(1) + " tail"), (4, text(2)), (4, text(3)), (5, text(3) + " tail"), (4, text(2)), (None, None), (9, ""), (9, "")]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert kept.columns == corpus_pipeline.COLUMNS
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted([(3, text(0) + " tail"), (None, text(1)), (4, text(2)), (4, text(3)), (None, None), (9, "")], key=str)


def test_empty(spark, folder, tmp_path):
    path, _, _ = folder
    for name in ("documents", "labels"):
        spark.read.parquet(f"{path}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
