"""What several operators share: tables in the cluster's shared folder and global running totals."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where that is unset, one of our own in local mode (tests), and an
    error on a cluster, whose executors don't share the driver's disk."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return sc.getCheckpointDir()


def fresh_path(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage ends there, and lost executors cost no recomputation. path:
    where, if that matters."""
    path = path or fresh_path(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def released(*tables: DataFrame) -> None:
    """Deletes tables that `written` made, once all that is computed from them is written itself."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.written_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def dealt(df: DataFrame) -> DataFrame:
    """df, over all cores: a table of fewer files than there are cores would be read by as many tasks only. Larger
    tables are read as they lie."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, F.monotonically_increasing_id()) if 0 < len(df._jdf.inputFiles()) < cores else df


def slices(batch: pa.RecordBatch, most: int):
    """Parts of a batch whose texts (column text, null as empty) have about `most` bytes, at least one row each."""
    text = batch.column("text").fill_null("").cast(pa.string())
    sizes = pc.binary_length(text).to_numpy(zero_copy_only=False).astype(np.int64).cumsum()
    cuts = np.unique(np.r_[0, np.searchsorted(sizes, np.arange(most, sizes[-1] if len(sizes) else 0, most)) + 1, len(sizes)])
    for a, b in zip(cuts[:-1], cuts[1:]):
        yield text.slice(a, b - a), batch.slice(a, b - a)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def local_totals(batches, sizes: list[str | None], part: str | None):
    """Exclusive running totals of each of sizes (None counts rows) over a task's sorted rows, anew where part changes."""
    carry, last = np.zeros(len(sizes), np.int64), None
    pid = TaskContext.get().partitionId()
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        if part is None:
            first, starts = last is not None, np.array([0])
            last, parts = pid, np.full(n, pid, np.int64)
        else:
            parts = batch.column(part).to_numpy(zero_copy_only=False).astype(np.int64)
            first, starts = parts[0] == last, np.r_[0, np.flatnonzero(np.diff(parts)) + 1]
            last = parts[-1]
        lens, out = np.diff(np.r_[starts, n]), []
        for i, s in enumerate(sizes):
            v = np.ones(n, np.int64) if s is None else batch.column(s).to_numpy(zero_copy_only=False).astype(np.int64)
            before = np.cumsum(v) - v
            base = before[starts]
            if first:
                base[0] -= carry[i]
            total = before - np.repeat(base, lens)
            carry[i] = total[-1] + v[-1]
            out.append(pa.array(total))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(parts), *out], names=[*batch.schema.names, "_part", *(f"_local{i}" for i in range(len(sizes)))])


def running(df: DataFrame, order: list[str], totals: dict[str, str | None], part: str | None = None) -> DataFrame:
    """df with columns `totals`: for each, the sum of the named size column (None: the number of rows) over all rows
    that come earlier in the order of the columns `order`.

    Rows are range-partitioned by `order` (or hashed by `part`, whose values must rise with `order`), each task sums
    its own sorted rows, and one row per range carries the offsets. No task sees more than its range. The sizes must
    not be null.
    """
    names = list(totals)
    dealt = df.repartitionByRange(*order) if part is None else df.repartition(part)
    rows = dealt.sortWithinPartitions(*([part] if part else []), *order)
    schema = T.StructType([*df.schema.fields, T.StructField("_part", T.LongType()), *(T.StructField(f"_local{i}", T.LongType()) for i in range(len(names)))])
    sizes = list(totals.values())
    local = written(rows.mapInArrow(lambda batches: local_totals(batches, sizes, part), schema))
    ends = [F.max(F.col(f"_local{i}") + (F.lit(1) if s is None else F.col(s))).alias(f"_end{i}") for i, s in enumerate(sizes)]
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = local.groupBy("_part").agg(*ends).select("_part", *(F.coalesce(F.sum(f"_end{i}").over(earlier), F.lit(0)).alias(f"_off{i}") for i in range(len(names))))
    # one row for each range: as many as there are tasks or boundaries, not as there are records
    joined = local.join(F.broadcast(offsets), "_part")
    return joined.select(*df.columns, *((F.col(f"_local{i}") + F.col(f"_off{i}")).alias(name) for i, name in enumerate(names)))
