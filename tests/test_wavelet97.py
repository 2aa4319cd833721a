"""The 9/7 wavelet against its SQL where single precision falls on the other side of a limit."""

import duckdb

import __spark_entry__ as entry

PLANE = [-75, -24, 223, -77, -151, -15, -170, 75, -105, 83, -116, 123, 25, 142, 198, -120, -27, -169, -33, -14, -291, -56, -160, 67, 70, 79, 69, -59, 43, -3, 80, -58]
PLANE += [84, 331, 4, -55, -26, -57, -28, -70, -41, -22, 155, 222, 5, -149, 100, -195, 25, -19, -308, -162, 45, 61, 87, 20, -167, -152, -129, -42, -111, 165, 246, -27]


def test_a_coefficient_next_to_a_limit(spark, tmp_path):
    spark.createDataFrame([(1, [(x + 0.5) / 1000 for x in PLANE])], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = entry.queries()["dwt97"](spark, str(tmp_path)).collect()
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW embeddings AS FROM '{tmp_path}/embeddings.parquet/*.parquet'")
        want = db.execute(entry.oracle_sql()["dwt97"]).fetchall()
    assert sorted(map(tuple, got)) == sorted(want)
    assert (1, 5, 2, "between") in want
