"""Codec configurations, the overflow budget and range-checked casts."""

import pytest
from pyspark.sql import functions as F

from tessella.plans import codecs
from tessella.types import AxisTransform, InvalidArgument, Unsupported


def test_configurations():
    assert codecs.validated({"name": "nd_zfp", "configuration": {"mode": "fixed_rate", "rate": 8.0, "dims": 3}}) == {"name": "zfp", "configuration": {"mode": "fixed_rate", "rate": 8.0}}
    assert codecs.validated({"name": "htj2k"})["configuration"]["progression"] == "RPCL"
    wrong = [("zfp", {"mode": "fixed_rate"}), ("zfp", {"rate": 8.0}), ("zfp", {"mode": "x"}), ("zfp", {"mode": "fixed_rate", "rate": float("inf")}), ("zfp", {"mode": "fixed_precision", "precision": 65}), ("zfp", {"dims": 5}), ("htj2k", {"xy_levels": 33}), ("htj2k", {"progression": "X"}), ("htj2k", {"more": 1}), ("numcodecs.delta", {"dtype": "<c8"}), ("numcodecs.delta", {"dtype": "<u2", "astype": "<u4"}), ("transpose", {"order": [0, 0]}), ("other", {})]
    for name, c in wrong:
        with pytest.raises((InvalidArgument, Unsupported)):
            codecs.validated({"name": name, "configuration": c})


def test_budget():
    step = lambda kind, levels=0, group=0: [AxisTransform("z", 0, kind, levels, group)]
    full = codecs.Interval(-(2**31), 2**31 - 1)
    for kind, levels in (("delta", 0), ("haar", 1), ("lift53", 1)):
        with pytest.raises(InvalidArgument):
            codecs.budget(full, step(kind, levels), [8])
        assert codecs.budget(full, step(kind, levels), [1]) == full
    assert codecs.budget(codecs.Interval(0, 255), step("delta"), [8]) == codecs.Interval(-255, 255)
    assert codecs.budget(codecs.Interval(0, 255), step("haar", 1), [8]) == codecs.Interval(-255, 382)


def test_casts_and_shapes(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(codecs.narrowed(F.lit(255).cast("long"), "uint8")) == 255 and one(codecs.widened(F.lit(7), "uint32")) == 7
    for c in (codecs.narrowed(F.lit(256).cast("long"), "uint8"), codecs.widened(F.lit(2**31), "uint32")):
        with pytest.raises(Exception):
            one(c)
    assert codecs.effective_shape([1, 1, 32, 64]) == [1, 1, 32, 64] and codecs.effective_shape([1, 1, 32, 64], 3) == [1, 32, 64]
    with pytest.raises(InvalidArgument):
        codecs.effective_shape([2, 2, 2], 2)


def test_widening_refuses_on_both_sides(spark):
    from pyspark.errors import PySparkException

    df = spark.createDataFrame([(0, 2**31 - 1), (1, -(2**31)), (2, 2**31), (3, -(2**31) - 1), (4, 300)], "k int, x long")
    one = lambda k, *a: df.where(f"k = {k}").select(codecs.widened(F.col("x"), *a).alias("v")).first()["v"]
    assert (one(0, "int64"), one(1, "int64"), one(2, "int64", 64), one(3, "int64", 64)) == (2**31 - 1, -(2**31), 2**31, -(2**31) - 1)
    for k, *a in ((2, "int64"), (3, "int64"), (4, "uint8"), (1, "uint32")):
        with pytest.raises(PySparkException):
            one(k, *a)


def test_budgets_of_wide_planes(spark):
    from tessella.operators import lifting
    from tessella.types import AxisTransform

    cells = spark.createDataFrame([(i, (-1) ** i * 2**40) for i in range(8)], "i int, x long")
    step = [AxisTransform("i", 0, "haar", 1)]
    got = codecs.forward_checked(cells, [], ["i"], step, [8], dtype="int64")
    assert got.count() == 8
    with pytest.raises(InvalidArgument):
        codecs.forward_checked(cells, [], ["i"], step, [8])
    assert codecs.plane_bits("uint32") == codecs.plane_bits("int64") == 64 and codecs.plane_bits("int32") == 32


def test_reshapes():
    assert codecs.reshaped_to([[0, 1], [2]], [2, 3, 4]) == [6, 4] and codecs.reshaped_to([4, -1], [2, 3, 4]) == [4, 6] and codecs.reshaped_to([[0], -1, 2], [2, 3, 4]) == [2, 6, 2]
    for given in ([5, -1], [-1, -1], [6, 5], [0, -1], [[0, 1]]):
        with pytest.raises(InvalidArgument):
            codecs.reshaped_to(given, [2, 3, 4])


def test_large_chunks_are_transposed(spark):
    import numpy as np

    shape = [2, 1, 4, 32, 32]
    flat = np.arange(np.prod(shape))
    chunks = spark.createDataFrame([(1, flat.tolist()), (2, None)], "k int, values array<int>")
    series = [{"name": "transpose", "configuration": {"order": [4, 1, 0, 3, 2]}}]
    there = codecs.array_stages(chunks, series, shape)
    got = {r["k"]: r["values"] for r in there.collect()}
    assert got[1] == flat.reshape(shape).transpose(4, 1, 0, 3, 2).ravel().tolist() and got[2] is None
    back = {r["k"]: r["values"] for r in codecs.array_stages(there, series, shape, back=True).collect()}
    assert back[1] == flat.tolist()


def test_fill_of_coefficients():
    from tessella.types import AxisTransform

    got = codecs.encoded_fill(9, "uint8", [AxisTransform("z", 0, "haar", 1)], [4, 2])
    assert got.tolist() == [[9, 9], [9, 9], [0, 0], [0, 0]]
    with pytest.raises(InvalidArgument):
        codecs.encoded_fill(300, "uint8", [], [2])


def test_kernels_keep_nulls_and_refuse_other_sizes(spark):
    from pyspark.errors import PySparkException
    from tessella.operators import kernels
    from tessella.types import AxisTransform

    chunks = spark.createDataFrame([(1, [1, 2, 3, 4]), (2, None), (3, [5, 5, 6, 9])], "k int, values array<long>")
    steps = [AxisTransform("i", 0, "delta", 0)]
    got = {r["k"]: r["values"] for r in kernels.transformed(chunks, steps, [4]).collect()}
    assert got == {1: [1, 1, 1, 1], 2: None, 3: [5, 0, 1, 3]}
    with pytest.raises(PySparkException):
        kernels.transformed(chunks, steps, [5]).collect()
    assert kernels.transformed(chunks.limit(0), steps, [4]).count() == 0
