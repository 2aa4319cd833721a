"""Measurement records as JSON files in folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = "name string, config string, git_hash string, num_samples bigint, median_ns bigint, min_ns bigint, max_ns bigint, raw_ns array<bigint>, bytes_in bigint, bytes_out bigint"


def load(spark: SparkSession, path: str) -> DataFrame:
    """All records below a folder, by config and name; other files there, such as a manifest, hold no record."""
    rows = spark.read.schema(RECORD).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").option("multiLine", "true").json(path)
    deviation = F.aggregate("raw_ns", F.lit(0.0), lambda a, x: a + (x - F.col("_mean")) * (x - F.col("_mean")), lambda a: F.sqrt(a / F.greatest(F.size("raw_ns"), F.lit(1))))
    mean = F.aggregate("raw_ns", F.lit(0.0), lambda a, x: a + x, lambda a: a / F.greatest(F.size("raw_ns"), F.lit(1)))
    return rows.where("config is not null").withColumn("_mean", mean).withColumn("sigma_ns", F.coalesce(deviation, F.lit(0.0))).drop("_mean").orderBy("config", "name")


def save(records: DataFrame, path: str) -> None:
    records.write.partitionBy("config").json(path)
