"""Lifting against golden vectors: cells with windows, and chunk kernels."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessella.operators import kernels, layout, lifting
from tessella.types import AxisTransform, InvalidArgument, transforms_of

# fixed values: name, shape, steps (axis, dimension, kind, levels, group), input, expected
GOLDEN = [
    ('delta-ramp', [7], [('z', 0, 'delta', 0, 0)], [3, 4, 5, 6, 7, 8, 9], [3, 1, 1, 1, 1, 1, 1]),
    ('delta-group-2', [4], [('z', 0, 'delta', 0, 2)], [10, 11, 20, 23], [10, 1, 20, 3]),
    ('haar-dc', [6], [('z', 0, 'haar', 1, 0)], [9, 9, 9, 9, 9, 9], [9, 9, 9, 0, 0, 0]),
    ('haar-signed-pairs', [4], [('z', 0, 'haar', 1, 0)], [2, 7, -2, -7], [4, -5, 5, -5]),
    ('haar-two-levels-odd', [5], [('z', 0, 'haar', 2, 0)], [1, 2, 4, 8, 16], [3, 16, 5, 1, 4]),
    ('lift53-impulse', [4], [('z', 0, 'lift53', 1, 0)], [0, 4, 0, 0], [2, 1, 4, 0]),
    ('lift53-ramp', [8], [('z', 0, 'lift53', 1, 0)], [0, 1, 2, 3, 4, 5, 6, 7], [0, 2, 4, 6, 0, 0, 0, 1]),
    ('lift53-dc-two-levels-odd', [7], [('z', 0, 'lift53', 2, 0)], [5, 5, 5, 5, 5, 5, 5], [5, 5, 0, 0, 0, 0, 0]),
    ('lift53-group-3-odd-tail', [5], [('z', 0, 'lift53', 2, 3)], [100, 90, 70, 40, 0], [88, -30, 5, 20, -40]),
    ('volume-lift53-z-delta-t', [3, 2, 4], [('z', 0, 'lift53', 2, 0), ('t', 2, 'delta', 0, 2)], [20165, 54275, 14301, 9319, 48180, 9442, 12189, 44157, 48062, 13688, 35880, 39243, 60706, 52003, 4396, 30797, 41404, 60954, 4220, 53670, 42604, 14405, 17821, 17977], [39424, -3772, 22571, 12798, 53049, -21085, 9701, 21231, 21239, -14560, -10081, 54432, -5576, 10539, 5632, -31812, 17277, -61204, 26619, -18871, 15314, 24765, -10609, 10339]),
    ('volume-haar-then-lift53-same-axis', [6, 3], [('z', 0, 'haar', 1, 0), ('z', 0, 'lift53', 1, 0)], [1733, -1021, -35, -921, 1076, -798, 1949, 1149, 958, -648, 1064, 331, 1314, 803, -1748, 77, -1604, 1562], [456, 674, 33, 294, 507, 31, -2683, -80, 257, 99, 1293, 899, -1703, 2340, -403, 1360, -2322, 3937]),
    ('singleton-axis-noop', [1, 4], [('z', 0, 'lift53', 2, 0), ('x', 1, 'delta', 0, 0)], [7, -8, 9, -10], [7, -15, 17, -19]),
    ('i64-plane-wide-values', [6], [('z', 0, 'lift53', 2, 0)], [31260093513728, -4729496993792, 18434936864768, -19666044518400, 18127919513600, 14259910213632], [11212086134784, 2414547724288, -10519002574848, -29577012183040, -37947472707584, -3868009299968]),
]


@pytest.mark.parametrize("name,shape,steps,given_,expected", GOLDEN, ids=[g[0] for g in GOLDEN])
def test_golden_kernel(name, shape, steps, given_, expected):
    made = [AxisTransform(*s) for s in steps]
    out = kernels.apply(np.array(given_).reshape(shape), made)
    assert out.ravel().tolist() == expected
    assert kernels.apply(out, made, back=True).ravel().tolist() == given_


def test_golden_cells(spark):
    for name, shape, steps, given_, expected in GOLDEN:
        axes = [f"a{i}" for i in range(len(shape))]
        made = [AxisTransform(*s) for s in steps]
        cells = layout.cells(spark.createDataFrame([(1, given_)], "k int, v array<bigint>"), ["k"], "v", shape, axes)
        out = lifting.forward_steps(cells, ["k"], axes, made)
        assert layout.chunked(out, ["k"], axes, shape).first()["values"] == expected, name
        back = lifting.inverse_steps(out, ["k"], axes, made)
        assert layout.chunked(back, ["k"], axes, shape).first()["values"] == given_, name


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 7), min_size=1, max_size=3), st.data())
def test_round_trips(shape, data):
    values = np.array(data.draw(st.lists(st.integers(-(2**16), 2**16), min_size=int(np.prod(shape)), max_size=int(np.prod(shape))))).reshape(shape)
    kinds = data.draw(st.lists(st.tuples(st.integers(0, len(shape) - 1), st.sampled_from(["delta", "haar", "lift53"]), st.integers(1, 3), st.sampled_from([0, 2, 3, 5])), min_size=1, max_size=3))
    steps = [AxisTransform("a", d, k, 0 if k == "delta" else n, g) for d, k, n, g in kinds]
    assert (kernels.apply(kernels.apply(values, steps), steps, back=True) == values).all()


def test_strict_configuration():
    step = {"axis": "z", "dimension": 0, "kind": "haar", "levels": 1, "group": 0}
    assert transforms_of({"version": "0.1", "transforms": [step]}) == [AxisTransform(**step)]
    for wrong in ({"version": "0.2", "transforms": []}, {"version": "0.1", "transforms": [step | {"kind": "x"}]}, {"version": "0.1", "transforms": [step | {"more": 1}]}, {"version": "0.1", "transforms": [step | {"levels": 0}]}, {"version": "0.1", "other": 1}):
        with pytest.raises(InvalidArgument):
            transforms_of(wrong)


def test_low_pass(spark):
    at = lambda n, *a: [r[0] for r in spark.range(n).where(lifting.low_pass(F.col("id"), *a, F.lit(n))).orderBy("id").collect()]
    assert at(32, "lift53", 2, 0) == list(range(8))
    assert at(8, "haar", 1, 4) == [0, 1, 4, 5]
    assert at(10, "delta", 0, 4) == [0, 4, 8]
    assert at(5, "lift53", 8, 0) == [0]
    assert at(1, "lift53", 2, 0) == [0]
