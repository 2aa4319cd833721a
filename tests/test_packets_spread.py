"""Packets: what a task sorts doesn't grow with the table, whatever number of shuffle partitions is set."""

import duckdb
from pyspark.sql import functions as F

import __spark_entry__ as entry

ROWS, MOST = 1_500_000, 300_000


def test_packets_of_many_orders(spark, tmp_path):
    n = F.col("id")
    lines = spark.range(ROWS).select((n % 200_000).alias("l_orderkey"), (n % 7).cast("int").alias("l_linenumber"), (n * 31 % 20_000).alias("l_partkey"), (n * 17 % 1000).alias("l_suppkey"), (n % 50).cast("double").alias("l_quantity"))
    lines.unionByName(lines.where("l_orderkey < 10")).write.parquet(f"{tmp_path}/lineitem.parquet")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        made = entry.queries()["packet_sequences"](spark, str(tmp_path))
        tasks = made.groupBy(F.spark_partition_id()).count().collect()
        made.write.parquet(f"{tmp_path}/made")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert max(r["count"] for r in tasks) <= MOST
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW lineitem AS FROM '{tmp_path}/lineitem.parquet/*.parquet'")
        db.execute(f"CREATE TABLE want AS {entry.oracle_sql()['packet_sequences']}")
        got = f"(SELECT {', '.join(made.columns)} FROM '{tmp_path}/made/*.parquet')"
        assert db.execute(f"SELECT count(*) FROM (FROM want EXCEPT ALL FROM {got})").fetchone() == (0,)
        assert db.execute(f"SELECT count(*) FROM {got}").fetchone() == db.execute("SELECT count(*) FROM want").fetchone()
