"""Signals as streams: blocks of a fixed time are transformed and summed as their watermark passes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(EVENT).parquet(folder)


def block_summary(events: DataFrame, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """For each key and block of time: cells, first and last value, and the energy of its differences, which a delta
    transform of the block would hold. The block's cells are kept in order as state until the watermark ends it."""
    timed = events.withWatermark("ts", late).withColumn("x", F.floor(F.col("value") * 100).cast("long"))
    blocks = timed.groupBy("user_id", F.window("ts", length).alias("block")).agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "x"))).alias("cells"))
    values = F.transform("cells", lambda c: c["x"])
    steps = F.zip_with(F.slice(values, 2, F.size(values)), F.slice(values, 1, F.size(values) - 1), lambda b, a: F.abs(b - a))
    return blocks.select("user_id", F.col("block.start").alias("start"), F.size("cells").alias("n"), F.element_at(values, 1).alias("first"), F.element_at(values, -1).alias("last"), F.aggregate(F.filter(steps, lambda s: s.isNotNull()), F.lit(0).cast("long"), lambda a, s: a + s).alias("energy"))
