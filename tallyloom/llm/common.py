"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import math
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space: tab to carriage return, and the blank.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder that the session names; one of our own only where it names none and all tasks run in the driver's process."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base and not re.match(r"local($|\[)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not base:
        base = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write df to the shared folder and read it again. Survives the loss of any executor."""
    path = shared_dir(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def broadcast_if(df: DataFrame, rows: int, row_bytes: int, limit: int = 64 << 20) -> DataFrame:
    """Hint a broadcast only where the counted rows prove that df is small."""
    return F.broadcast(df) if rows * row_bytes <= limit else df


#: Bytes of text for one task of a shuffle whose rows grow with the texts.
TASK_BYTES = 64 << 20


def text_bytes(rows: DataFrame, text_col: str = "text") -> int:
    return rows.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()[0]


def dealt_by(df: DataFrame, n_bytes: int, *by: Column | str) -> DataFrame:
    """df shuffled by some columns into as many partitions as the session says, or more where so many bytes of text need them."""
    n = math.ceil(n_bytes / TASK_BYTES)
    return df.repartition(n, *by) if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df.repartition(*by)
