"""The coincidence of two event streams as Structured Streaming, with expiring state."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import tables


def stream(spark: SparkSession, sf_dir: str, table: str = "events") -> DataFrame:
    """The table's files as a stream; its times become zoned so that a watermark can follow them."""
    schema = tables.read(spark, sf_dir, table).schema
    d = spark.readStream.schema(schema).option("pathGlobFilter", f"{table}.parquet").parquet(sf_dir)
    return d.withColumn("ts", F.col("ts").cast("timestamp"))


def coincidences(d: DataFrame, a: str, b: str, seconds: int, late: str = "1 day") -> DataFrame:
    """Pairs of event types a and b of one user with b.ts in [a.ts - w, a.ts + w); state expires by watermark."""
    d = d.withWatermark("ts", late)
    left = d.where(F.col("event_type") == a).select(F.col("user_id").alias("tid"), F.col("event_id").alias("a_id"), F.col("ts").alias("a_ts"))
    right = d.where(F.col("event_type") == b).select(F.col("user_id").alias("b_tid"), F.col("event_id").alias("b_id"), F.col("ts").alias("b_ts"))
    w = F.expr(f"INTERVAL {seconds} SECONDS")
    return left.join(right, (F.col("tid") == F.col("b_tid")) & (F.col("b_ts") >= F.col("a_ts") - w) & (F.col("b_ts") < F.col("a_ts") + w)).select("tid", "a_id", "b_id")


def run_once(d: DataFrame, tag: str) -> DataFrame:
    """Process all that is there, into a table in the shared folder, and read that."""
    spark = d.sparkSession
    path = f"{tables.shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    q = d.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(d.schema).parquet(f"{path}/out")
