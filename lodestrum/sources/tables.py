"""Reading of the driver tables, and the shared folder for what must be written."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def micros(ts):
    """Whole microseconds since 1970 of a timestamp without zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {ts})")


def triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as triggers: id, k (stream), tid (template), t (microseconds), stat."""
    e = read(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("id"), F.col("event_type").alias("k"), F.col("user_id").alias("tid"), micros("ts").alias("t"), F.col("value").alias("stat"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only in local mode, on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = getattr(shared_dir, "own", None) or tempfile.mkdtemp(prefix="lodestrum-")
        shared_dir.own = found
    return found.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def table(d: DataFrame, tag: str) -> DataFrame:
    """d written to the shared folder and read back, where several passes would work it out anew."""
    path = new_path(d.sparkSession, tag)
    d.write.parquet(path)
    return d.sparkSession.read.schema(d.schema).parquet(path)
