"""Every order asks for the planes that contain its range."""

import __spark_entry__ as entry
from pyspark.sql import functions as F


def test_every_order_asks(spark, tmp_path):
    rows = [(k, 1 + k % 3, 20_000.0 + 500 * k) for k in range(1, 40)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    want = set()
    for chunk in (1, 2, 3):
        at, planes = 116, []
        for plane, (_, _, price) in enumerate(r for r in rows if r[1] == chunk):
            size = int(price // 100) + 1
            planes.append((plane, at, size))
            at += size
        for k, own, _ in rows:
            if own == chunk:
                want |= {(chunk, 200 + k % 900, 260 + k % 900, p) for p, o, n in planes if 200 + k % 900 >= o and 260 + k % 900 <= o + n}
    got = entry.queries()["plan_containment_all"](spark, str(tmp_path))
    found = {(r["chunk"], r["a"], r["b"], r["plane"]) for r in got.select("chunk", "a", "b", F.col("plane").cast("long").alias("plane")).collect()}
    assert found == want and {a - 200 for _, a, _, _ in want if (a - 200) % 5}
