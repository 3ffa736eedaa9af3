"""Progress events of jobs, as a table and as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

EVENTS = "event_id bigint, job_id string, status string, stage string, progress int, message string, created_at timestamp"


def latest(events: DataFrame) -> DataFrame:
    """The last event of each job, and how many there were."""
    newest = F.max_by(F.struct("status", "stage", "progress", "message", "created_at"), "event_id")
    return events.groupBy("job_id").agg(F.max("event_id").alias("event_id"), newest.alias("e"), F.count(F.lit(1)).alias("n_events")).select("job_id", "event_id", "e.*", "n_events")


def as_lines(events: DataFrame) -> DataFrame:
    """One JSON object a line, as a client reads them."""
    return events.select("event_id", F.to_json(F.struct(*[c for c in events.columns])).alias("value"))


def follow(spark: SparkSession, path: str, name: str, checkpoint: str) -> StreamingQuery:
    """Keep a table in memory of the last event of each job, from JSON files that are added under path."""
    events = spark.readStream.schema(EVENTS).json(path)
    return latest(events).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).start()


STATES = f"{EVENTS}, n_events bigint, n_ignored bigint"
# States that a job does not leave.
FINAL = ("completed", "failed", "cancelled")


def merge_states(states: DataFrame, events: DataFrame) -> DataFrame:
    """The jobs' states after more events: the last event of each job, how many counted, and how many did not.

    An event counts if its id is above that of the job's state, once, and the state is not final; others, late ones, repeats and those after the end, are
    ignored and counted as such. Events of one job that come together count up to the first final one. Null ids of event or job are left out.
    """
    fields = [f.split()[0] for f in EVENTS.split(", ")]
    given = events.where("event_id IS NOT NULL AND job_id IS NOT NULL").select(*fields)
    once = given.groupBy("job_id", "event_id").agg(F.min(F.struct(*[c for c in fields if c not in ("job_id", "event_id")])).alias("e"), F.count(F.lit(1)).alias("times"))
    known = states.select("job_id", F.col("event_id").alias("last"), F.col("status").isin(*FINAL).alias("over"))
    placed = once.join(known, "job_id", "left").withColumn("new", (F.col("event_id") > F.coalesce("last", F.lit(-(1 << 62)))) & ~F.coalesce("over", F.lit(False)))
    ends = placed.where("new").where(F.col("e.status").isin(*FINAL)).groupBy("job_id").agg(F.min("event_id").alias("end"))
    counted = placed.join(ends, "job_id", "left").withColumn("new", F.col("new") & (F.col("event_id") <= F.coalesce("end", F.col("event_id"))))
    gained = counted.groupBy("job_id").agg(
        F.max_by("e", F.when(F.col("new"), F.col("event_id"))).alias("e"), F.max(F.when(F.col("new"), F.col("event_id"))).alias("event_id"), F.count_if("new").alias("more"),
        (F.sum("times") - F.count_if("new")).alias("passed"),
    )
    old = states.select("job_id", F.struct(*[c for c in states.columns if c != "job_id"]).alias("s"))
    both = old.join(gained, "job_id", "full")
    own = lambda c: F.when(F.col("event_id").isNotNull(), F.col(f"e.{c}")).otherwise(F.col(f"s.{c}")).alias(c)
    return both.select(
        F.coalesce("event_id", "s.event_id").alias("event_id"), "job_id", *[own(c) for c in fields if c not in ("job_id", "event_id")],
        (F.coalesce("s.n_events", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("n_events"), (F.coalesce("s.n_ignored", F.lit(0)) + F.coalesce("passed", F.lit(0))).alias("n_ignored"),
    ).where("event_id IS NOT NULL")


def _versions(spark: SparkSession, path: str) -> list[int]:
    """The versions that were written to the end, in order."""
    base = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = base.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(base):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(base)]
    return sorted(int(n[2:]) for n in names if n.startswith("v=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS")))


def states(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """The jobs' last states as kept under path; before: as of the versions below that number."""
    found = [v for v in _versions(spark, path) if before is None or v < before]
    return spark.read.schema(STATES).parquet(f"{path}/v={found[-1]}") if found else spark.createDataFrame([], STATES)


def keep_states(spark: SparkSession, source: str, path: str, checkpoint: str) -> StreamingQuery:
    """Keep the jobs' last states under path, from JSON files that are added under source.

    Each batch writes a version of its own number from those below it, so a batch that is done again after a failure writes the same; readers take the
    last version that was written to the end. The last three versions stay.
    """

    def put(batch: DataFrame, number: int) -> None:
        merge_states(states(spark, path, number), batch).write.mode("overwrite").parquet(f"{path}/v={number}")
        base = spark._jvm.org.apache.hadoop.fs.Path
        for v in [v for v in _versions(spark, path) if v <= number][:-3]:
            p = base(f"{path}/v={v}")
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)

    return spark.readStream.schema(EVENTS).json(source).writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).start()


def newest(states: DataFrame, limit: int) -> DataFrame:
    """The jobs whose last event is the newest."""
    return states.orderBy(F.desc_nulls_last("created_at"), F.desc("event_id"), "job_id").limit(limit)
