"""Vectors for rows that lack them, as a job that says how far it came and goes on from there."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .catalog import SCHEMAS, embed_missing, stale_vectors

#: Texts that one call of the model gets, and parts in which a job is done: after each of them its row is written.
BATCH, SLICES = 16, 8
VECTORS = "id bigint, embedding array<float>, embedding_profile_key string"


def log(spark: SparkSession, path: str, row: dict) -> None:
    """A new state of a job. The last one counts."""
    fields = SCHEMAS["embedding_jobs"] + ", written_at timestamp"
    spark.createDataFrame([row | {"written_at": datetime.now(timezone.utc)}], fields).coalesce(1).write.mode("append").parquet(f"{path}/jobs")


def jobs(spark: SparkSession, path: str) -> DataFrame:
    """The last state of each job."""
    columns = [f.split()[0] for f in SCHEMAS["embedding_jobs"].split(", ")]
    rows = spark.read.schema(SCHEMAS["embedding_jobs"] + ", written_at timestamp").parquet(f"{path}/jobs")
    return rows.groupBy("job_id").agg(F.max_by(F.struct(*columns[1:]), "written_at").alias("j")).select("job_id", "j.*")


def vectors(spark: SparkSession, path: str, job_id: int) -> DataFrame:
    """What a job has made so far: the slices that were written to the end."""
    try:
        return spark.read.schema(VECTORS + ", slice int").parquet(f"{path}/vectors/job={job_id}").drop("slice")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], VECTORS)


def run_job(rows: DataFrame, model: Callable[[list[str]], list[list[float]]], profile: str, path: str, job_id: int, source: str = "statistics", force: bool = False) -> dict:
    """Give vectors to the rows (id, text, embedding, embedding_profile_key) without one of this profile, or to all if forced; the job's last row.

    What is to do is fixed at the start, by the greatest id and the count. It is done in slices of ids; a slice's vectors are
    there as a whole or not at all, whatever tasks were repeated, and the rows counted as they pass are compared with the rows that were to come. A job that failed
    goes on after its last whole slice if it is run again under its number. Null texts count as empty; rows with a null id are left out.
    """
    spark = rows.sparkSession
    wanted = (rows if force else stale_vectors(rows, profile)).where("id IS NOT NULL").select("id", F.coalesce("text", F.lit("")).alias("text"))
    known = {r["slice"] for r in spark.read.parquet(f"{path}/slices/job={job_id}").collect()} if _there(spark, f"{path}/slices/job={job_id}") else set()
    plan_path = f"{path}/plan/job={job_id}"
    if not _there(spark, plan_path):
        facts = wanted.agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("most"), F.percentile_approx("id", [k / SLICES for k in range(1, SLICES)]).alias("cuts")).first()
        edges = sorted(set(facts["cuts"] or []) | ({facts["most"]} if facts["most"] is not None else set()))
        spark.createDataFrame([(facts["n"], facts["most"], edges)], "n long, most long, edges array<long>").coalesce(1).write.parquet(plan_path)
    plan = spark.read.parquet(plan_path).first()
    done = vectors(spark, path, job_id).count() if known else 0
    row = {"job_id": job_id, "source_name": source, "profile_key": profile, "status": "running", "force_reembed": force, "target_count": plan["n"], "processed_count": done, "max_source_id": plan["most"], "error_message": None, "started_at": datetime.now(timezone.utc), "finished_at": None}
    log(spark, path, row)
    try:
        for k, upto in enumerate(plan["edges"]):
            if k in known:
                continue
            part = wanted.where(F.col("id") <= upto)
            part = part.where(F.col("id") > plan["edges"][k - 1]) if k else part
            seen = Observation(f"slice {k}")
            bare = part.withColumns({"embedding": F.lit(None).cast("array<float>"), "embedding_profile_key": F.lit(None).cast("string")})
            embed_missing(bare, "id", "text", profile, model, BATCH).observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{path}/vectors/job={job_id}/slice={k}")
            spark.createDataFrame([(k, seen.get["n"])], "slice int, n long").coalesce(1).write.mode("append").parquet(f"{path}/slices/job={job_id}")
            row["processed_count"] += seen.get["n"]
            log(spark, path, row)
    except Exception as e:
        row |= {"status": "failed", "error_message": str(e).strip().splitlines()[0][:500], "finished_at": datetime.now(timezone.utc)}
        log(spark, path, row)
        raise
    whole = row["processed_count"] == plan["n"]
    row |= {"status": "completed" if whole else "failed", "error_message": None if whole else f"{plan['n']} rows were to come, {row['processed_count']} came", "finished_at": datetime.now(timezone.utc)}
    log(spark, path, row)
    return row


def _there(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
