"""Boxed streams, the planner's command, report columns."""

import json

import pytest

from tessella import __main__ as command
from tessella.operators import bench
from tessella.sources import boxes
from tessella.types import CodestreamError


def test_boxes(spark):
    data = boxes.wrapped(b"stream", 8, 6, 1, 8)
    found = boxes.located(data)
    assert found == {"offset": 85, "length": 6, "width": 8, "height": 6, "comps": 1} and data[85:] == b"stream"
    for wrong in (b"", data[:40], data[:12] + data[32:], data.replace(b"jph ", b"abcd"), data[:-10]):
        with pytest.raises(CodestreamError):
            boxes.located(wrong)
    rows = boxes.streams(spark.createDataFrame([("a", data), ("b", b"x"), ("c", None)], "path string, content binary")).collect()
    assert {r["path"]: r["offset"] for r in rows} == {"a": 85, "b": None, "c": None}


def test_command(tmp_path, capsys):
    spec = tmp_path / "spec.json"
    spec.write_text(json.dumps({"axes": ["z", "y", "x"], "chunk_shape": [4, 8, 8], "dtype": "uint16", "family": "nd-lift-ht"}))
    assert command.main(["series", str(spec)]) == 0
    series = json.loads(capsys.readouterr().out)
    assert [c["name"] for c in series] == ["nd_lift", "htj2k"]
    spec.write_text(json.dumps(series))
    assert command.main(["check", str(spec)]) == 0
    spec.write_text(json.dumps([{"name": "zfp", "configuration": {"mode": "fixed_rate"}}]))
    assert command.main(["check", str(spec)]) == 1 and command.main([]) == 2


def test_report(spark):
    rows = spark.createDataFrame([("a", 12, 10, True, True), ("b", 9, 10, False, False), ("c", 5, None, False, False)], "name string, median_ns long, baseline_median_ns long, time_regressed boolean, ratio_regressed boolean")
    get = lambda gate: {r["name"]: (r["change"], r["status"]) for r in bench.report(rows, gate).collect()}
    assert get("both") == {"a": ("+20.0 %", "TIME+RATIO-REGRESSED"), "b": ("-10.0 %", "ok"), "c": ("new", "ok")}
    assert get("ratio")["a"][1] == "RATIO-REGRESSED"
