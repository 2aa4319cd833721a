"""Layout, indexes, plans, bench records, the planner, and every registered query against DuckDB."""

import pytest
from pyspark.sql import functions as F

from tessella import queries
from tessella.operators import bench, indexes, layout, lifting
from tessella.plans.series import SeriesSpec, codec_series
from tessella.sources import arrays
from tessella.types import InvalidArgument, Unsupported

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_coalesced(spark):
    rows = spark.createDataFrame([(1, 10, 19), (1, 0, 9), (1, 30, 40), (1, 35, 38), (2, 5, 5)], "k int, start long, end long")
    assert sorted(map(tuple, indexes.coalesced(rows, ["k"]).collect())) == [(1, 0, 19), (1, 30, 40), (2, 5, 5)]
    assert indexes.coalesced(rows.limit(0), ["k"]).count() == 0


def test_plans_of_a_synthetic_index(spark):
    # fixed values: four planes of 1000 bytes after a header of 116, prefixes 100, 400, 1000
    planes = spark.createDataFrame([("c", i, 116 + 1000 * i, 1000, 116) for i in range(4)], "chunk string, plane int, offset long, len long, header_len int")
    plan = lambda df, **k: sorted((r["start"], r["end"]) for r in indexes.plane_plan(df, ["chunk"], **k).collect())
    assert plan(planes.where("plane = 0"), length=F.lit(100)) == [(0, 215)]
    assert plan(planes.where("plane = 2")) == [(0, 115), (2116, 3115)]
    assert len(plan(planes, length=F.lit(100))) == 4


def test_depth_transpose_reshape(spark):
    depth = lambda a, b: spark.range(1).select(layout.bit_depth(F.lit(a).cast("long"), F.lit(b).cast("long"))).first()[0]
    assert [depth(0, 0), depth(0, 255), depth(0, 256), depth(-1, 0), depth(-128, 127), depth(-129, 0)] == [1, 8, 9, 1, 8, 9]
    cells = layout.cells(spark.createDataFrame([(1, list(range(12)))], "k int, v array<int>"), ["k"], "v", [3, 4], ["a", "b"])
    turned = layout.transposed(cells, ["a", "b"], [1, 0])
    assert layout.chunked(turned, ["k"], ["a", "b"], [4, 3]).first()["values"] == [0, 4, 8, 1, 5, 9, 2, 6, 10, 3, 7, 11]
    shaped = layout.reshaped(cells, ["a", "b"], [3, 4], ["p", "q", "r"], [2, 3, 2])
    assert layout.chunked(shaped, ["k"], ["p", "q", "r"], [2, 3, 2]).first()["values"] == list(range(12))


def test_records(spark):
    one = lambda v: bench.records(spark.createDataFrame([(1, x) for x in v], "k int, ns long"), ["k"], "ns").first()
    assert one([1, 9])["median_ns"] == 5 and one([3, 1, 2])["median_ns"] == 2 and one([8, 12])["sigma_ns"] == 2.0


def test_baselines_of_zero_and_repeated_keys(spark):
    fields = "name string, median_ns long, sigma_ns double, bytes_out long, bytes_in long"
    base = spark.createDataFrame([("a", 0, 0.0, 0, 10), ("b", 100, 1.0, 5, 10), ("b", 900, 1.0, 9, 10), ("c", 100, 50.0, 5, 0)], fields)
    now = spark.createDataFrame([("a", 50, 0.0, 5, 10), ("b", 120, 0.0, 6, 10), ("c", 120, 0.0, 6, 10), ("d", 1, 0.0, 1, 1)], fields)
    got = {r["name"]: (r["baseline_median_ns"], r["time_regressed"], r["ratio_regressed"]) for r in bench.diff(now, base, ["name"]).collect()}
    assert got == {"a": (0, False, False), "b": (100, True, True), "c": (100, False, False), "d": (None, False, False)}
    placed = base.withColumn("position", F.when(F.col("median_ns") == 900, 0).otherwise(1))
    assert {r["name"]: r["baseline_median_ns"] for r in bench.diff(now, placed, ["name"]).collect()}["b"] == 900


def test_stored_nulls_and_pruned_scans(spark, tmp_path):
    cells = spark.createDataFrame([(i, None if i < 4 else 0 if i < 8 else i) for i in range(16)], "i int, x int")
    arrays.write(cells, str(tmp_path / "a"), ["i"], [4])
    assert sorted(r["c0"] for r in spark.read.parquet(str(tmp_path / "a")).select("c0").collect()) == [0, 2, 3]
    arrays.write(cells, str(tmp_path / "a"), ["i"], [4], mode="overwrite")
    box = arrays.read(spark, str(tmp_path / "a"), ["i"], [4], [9], [2])
    plan = box._jdf.queryExecution().executedPlan().toString()
    scan = box._jdf.queryExecution().executedPlan().collectLeaves().head().metadata().apply("PushedFilters")
    assert all(f in scan for f in ("IsNotNull(c0)", "GreaterThanOrEqual(c0,2)", "LessThanOrEqual(c0,2)")), plan
    assert sorted((r["i"], r["x"]) for r in box.collect()) == [(9, 9), (10, 10)]


def test_filters_stay_above_windows(spark):
    """A box of coefficients cuts cells after the transform: the filter may not pass the window that makes them."""
    cells = spark.createDataFrame([(0, i, i * i) for i in range(16)], "k int, pos long, x long")
    signal = lifting.signal(cells, ["k"], ["pos"], F.col("x"))
    whole = {r["pos"]: r["x"] for r in lifting.forward(signal, ["k"], "lift53").collect()}
    box = lifting.forward(signal, ["k"], "lift53").where("pos between 3 and 5")
    assert {r["pos"]: r["x"] for r in box.collect()} == {p: x for p, x in whole.items() if 3 <= p <= 5}
    plan = box._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Filter") < plan.index("Window")


def test_planned_rows_are_the_planner(spark):
    from tessella.plans import series as planner

    rows = [(tuple(shape), chosen, delta) for shape in ([1, 1, 1, 1, 1], [8, 1, 32, 256, 256], [1, 3, 1, 64, 64], [2, 1, 1, 1, 1], [1, 1, 4, 1, 1]) for chosen in ([], [0], [2], [0, 2], [0, 1, 2]) for delta in (False, True)]
    df = spark.createDataFrame([(i, list(s), c, d) for i, (s, c, d) in enumerate(rows)], "i int, shape array<int>, chosen array<int>, delta boolean")
    axes = ["t", "c", "z", "y", "x"]
    got = df.select("i", planner.order_of(axes, F.col("shape"), F.col("chosen"), F.col("delta")).alias("order"), planner.group_numbers(F.col("shape")).alias("groups")).collect()
    for r in got:
        shape, chosen, delta = rows[r["i"]]
        spec = SeriesSpec(tuple(axes), shape, "uint16", "nd-delta" if delta else "nd-lift-ht")
        assert r["order"] == planner._order(spec, chosen)
        groups = planner._groups(list(shape))
        assert [next(g for g, ds in enumerate(groups) if d in ds) for d in range(5)] == r["groups"]


def series(**given):
    return codec_series(SeriesSpec.from_dict(given))


def test_series():
    # fixed values: the documented example
    assert series(axes=["t", "c", "z", "y", "x"], chunk_shape=[8, 1, 32, 256, 256], dtype="uint16", family="nd-lift-ht") == [
        {"name": "transpose", "configuration": {"order": [1, 0, 2, 3, 4]}},
        {"name": "nd_lift", "configuration": {"version": "0.1", "transforms": [{"axis": "t", "dimension": 1, "kind": "lift53", "levels": 2, "group": 0}, {"axis": "z", "dimension": 2, "kind": "lift53", "levels": 2, "group": 0}]}},
        {"name": "htj2k", "configuration": {"xy_levels": 5, "reversible": True, "progression": "RPCL", "index": True}},
    ]
    delta = series(axes=["z", "y", "x"], chunk_shape=[32, 256, 256], dtype="uint8", family="nd-delta")
    assert delta[0] == {"name": "transpose", "configuration": {"order": [1, 2, 0]}} and delta[1]["configuration"] == {"dtype": "|u1"}
    zfp = series(axes=["t", "c", "z", "y", "x"], chunk_shape=[8, 1, 32, 256, 256], dtype="float32", family="nd-zfp", zfp_rate=8.0)
    assert [c["name"] for c in zfp] == ["transpose", "reshape", "zfp"] and zfp[1]["configuration"] == {"shape": [[0, 1], [2], [3], [4]]}


@pytest.mark.parametrize(
    "given",
    [
        dict(axes=["z", "y", "w"], chunk_shape=[32, 256, 256], dtype="uint16", family="nd-lift-ht"),
        dict(axes=["z", "y", "x"], chunk_shape=[32, 256], dtype="uint16", family="nd-lift-ht"),
        dict(axes=["z", "y", "x"], chunk_shape=[32, 256, 256], dtype="float32", family="nd-lift-ht"),
        dict(axes=["z", "y", "x"], chunk_shape=[32, 256, 256], dtype="complex64", family="nd-delta"),
        dict(axes=["z", "y", "x"], chunk_shape=[32, 256, 256], dtype="uint16", family="nd-lift-ht", decorrelate=[2]),
        dict(axes=["t", "c", "z", "y", "x"], chunk_shape=[8, 4, 32, 256, 256], dtype="float32", family="nd-zfp"),
    ],
)
def test_series_refusals(given):
    with pytest.raises((InvalidArgument, Unsupported)):
        series(**given)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    got = queries.QUERIES[name](spark, SF).toPandas()
    if name not in queries.ORACLE_SQL:
        assert len(got)
        return
    duck.execute(queries.ORACLE_SQL[name])
    want = duck.df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda d: sorted(map(tuple, d[columns].astype(str).values))
    assert rows(got) == rows(want)


def test_windows_share_one_exchange(spark):
    plan = lifting.forward(queries.events_signal(spark, SF), ["user_id"], "lift53")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 2
