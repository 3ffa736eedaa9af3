"""Embedding jobs: a model that fails, going on, counts."""

import os

import pytest
from pyspark.sql import functions as F

from tallyloom.sources import embedding
from tallyloom.sources.catalog import update_vectors


def rows(spark, n=200):
    base = spark.range(n).select("id", F.concat(F.lit("text "), "id").alias("text"))
    own = F.when(F.col("id") % 4 == 0, F.array(F.lit(9.0).cast("float")))
    return base.withColumns({"embedding": own, "embedding_profile_key": F.when(F.col("id") % 4 == 0, F.when(F.col("id") % 8 == 0, "old").otherwise("p"))}).repartition(3)


def test_a_job_goes_on_after_a_failure(spark, tmp_path):
    path, mark = str(tmp_path / "store"), str(tmp_path / "broken")
    open(mark, "w").close()

    def model(texts):
        assert 0 < len(texts) <= embedding.BATCH
        if os.path.exists(mark) and "text 150" in texts:
            raise RuntimeError("the model is away")
        return [[float(len(t)), 1.0] for t in texts]

    with pytest.raises(Exception, match="the model is away"):
        embedding.run_job(rows(spark), model, "p", path, 1)
    failed = embedding.jobs(spark, path).first()
    assert failed["status"] == "failed" and 0 < failed["processed_count"] < failed["target_count"] == 175 and failed["max_source_id"] == 199
    assert embedding.vectors(spark, path, 1).count() == failed["processed_count"]
    os.remove(mark)
    # Rows that come after the start are not part of the job.
    out = embedding.run_job(rows(spark, 220), model, "p", path, 1)
    assert (out["status"], out["processed_count"]) == ("completed", 175)
    made = embedding.vectors(spark, path, 1)
    assert made.count() == made.select("id").distinct().count() == 175
    whole = update_vectors(rows(spark), made, ["id"])
    assert whole.where("embedding_profile_key = 'p' AND embedding IS NOT NULL").count() == 200 and whole.where("id = 12").first()["embedding"] == [9.0]
    assert embedding.jobs(spark, path).count() == 1


def test_forced_empty_and_short_jobs(spark, tmp_path):
    path = str(tmp_path / "store")
    assert embedding.run_job(rows(spark, 40), lambda t: [[1.0]] * len(t), "p", path, 2, force=True)["processed_count"] == 40
    assert embedding.run_job(rows(spark, 0), lambda t: [[1.0]] * len(t), "p", path, 3)["status"] == "completed"
    with pytest.raises(Exception, match="no finite vector"):
        embedding.run_job(rows(spark, 40), lambda t: [[1.0]], "p", path, 4)
    assert {r["job_id"]: r["status"] for r in embedding.jobs(spark, path).collect()} == {2: "completed", 3: "completed", 4: "failed"}
