"""Measurement records: statistics, comparison with a baseline and regression gates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TIME_GATE, RATIO_GATE = 10, 2  # percent


def records(samples: DataFrame, keys: list[str], value: str) -> DataFrame:
    """A record for each key: count, median (midpoint rounded down), least, most, population deviation."""
    return samples.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("num_samples"),
        F.floor(F.percentile(value, 0.5)).cast("long").alias("median_ns"),
        F.min(value).alias("min_ns"),
        F.max(value).alias("max_ns"),
        F.coalesce(F.stddev_pop(value), F.lit(0.0)).alias("sigma_ns"),
    )


def diff(current: DataFrame, baseline: DataFrame, keys: list[str]) -> DataFrame:
    """Each current record beside its baseline. Time regresses at TIME_GATE percent more that also exceed the
    baseline's deviation; the ratio bytes_out / bytes_in at RATIO_GATE percent more. A baseline of 0 gates nothing.
    Where a key repeats in the baseline, its first record counts: by column `position` if there is one, else the least."""
    fields = F.struct(*([F.col("position")] if "position" in baseline.columns else []), F.col("median_ns").alias("m"), F.col("sigma_ns").alias("s"), F.try_divide("bytes_out", "bytes_in").alias("r"))
    first = baseline.groupBy(*keys).agg(F.min(fields).alias("_b"))
    base = first.select(*keys, F.col("_b.m").alias("baseline_median_ns"), F.col("_b.s").alias("_sigma"), F.col("_b.r").alias("baseline_ratio"))
    joined = current.withColumn("ratio", F.try_divide("bytes_out", "bytes_in")).join(base, keys, "left")
    more = F.col("median_ns") - F.col("baseline_median_ns")
    slower = (F.col("baseline_median_ns") > 0) & (100 * more >= TIME_GATE * F.col("baseline_median_ns")) & (more > F.col("_sigma"))
    larger = (F.col("baseline_ratio") > 0) & (F.col("ratio") >= F.col("baseline_ratio") * (1 + RATIO_GATE / 100))
    return joined.select(*keys, "median_ns", "baseline_median_ns", F.coalesce(slower, F.lit(False)).alias("time_regressed"), F.coalesce(larger, F.lit(False)).alias("ratio_regressed"))


def gated(rows: DataFrame, gate: str) -> DataFrame:
    """The rows that fail a gate: time, ratio or both."""
    tests = {"time": F.col("time_regressed"), "ratio": F.col("ratio_regressed"), "both": F.col("time_regressed") | F.col("ratio_regressed")}
    return rows.where(tests[gate])


def report(rows: DataFrame, gate: str) -> DataFrame:
    """Diff rows with readable columns: the change in percent, and a status that names regressions of the gated kinds
    and notes others. Write it with any of Spark's formats (csv, json) or show it."""
    time, ratio = F.col("time_regressed"), F.col("ratio_regressed")
    gated_time, gated_ratio = gate in ("time", "both"), gate in ("ratio", "both")
    kinds = F.concat_ws("+", F.when(time & F.lit(gated_time), "TIME"), F.when(ratio & F.lit(gated_ratio), "RATIO"))
    noted = F.concat_ws(", ", F.when(time & F.lit(not gated_time), "time n/a"), F.when(ratio & F.lit(not gated_ratio), "ratio n/a"))
    change = F.round(100.0 * (F.col("median_ns") - F.col("baseline_median_ns")) / F.nullif("baseline_median_ns", F.lit(0)), 1)
    text = F.when(F.col("baseline_median_ns").isNull(), "new").otherwise(F.concat(F.when(change >= 0, "+").otherwise(""), change.cast("string"), F.lit(" %")))
    status = F.when(kinds != "", F.concat(kinds, F.lit("-REGRESSED"))).when(noted != "", F.concat(F.lit("ok ("), noted, F.lit(": ungated)"))).otherwise("ok")
    return rows.withColumn("change", text).withColumn("status", status)
