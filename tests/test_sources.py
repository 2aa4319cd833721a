"""Images, containers, chunked arrays, records and streams."""

import json
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.sources import arrays, containers, images, records
from tessella.streaming import signals
from tessella.types import CodestreamError, Unsupported


@pytest.mark.parametrize("dtype,n,kind", [("uint8", 1, "pnm"), ("uint16", 3, "pnm"), ("uint8", 4, "png"), ("uint16", 2, "png"), ("uint16", 1, "png")])
def test_image_bytes(dtype, n, kind):
    samples = np.random.default_rng(1).integers(0, 256 if dtype == "uint8" else 65536, (7, 5, n))
    write, read = (images.write_pnm, images.read_pnm) if kind == "pnm" else (images.write_png, images.read_png)
    data = write(samples, dtype)
    back, found = read(data)
    assert found == dtype and (back == samples).all()
    for cut in (b"", data[:9], data[: len(data) // 2]):
        with pytest.raises((CodestreamError, zlib.error)):
            read(cut)


def test_png_filters():
    r = np.random.default_rng(2)
    want, rows = r.integers(0, 256, (6, 4, 3)).astype(np.uint8), []
    above = np.zeros(12, int)
    for y in range(6):
        line, kind = want[y].ravel().astype(int), y % 5
        left, corner = np.r_[0, 0, 0, line[:-3]], np.r_[0, 0, 0, above[:-3]]
        p = left + above - corner
        paeth = np.where((abs(p - left) <= abs(p - above)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - above) <= abs(p - corner), above, corner))
        rows.append(np.r_[kind, (line - [0, left, above, (left + above) >> 1, paeth][kind]) & 255].astype(np.uint8))
        above = line
    plain = images.write_png(want, "uint8")
    old = zlib.compress(np.concatenate([np.zeros((6, 1), np.uint8), want.reshape(6, -1)], axis=1).tobytes())
    new = zlib.compress(np.stack(rows).tobytes())
    at = plain.index(b"IDAT") - 4
    data = plain[:at] + len(new).to_bytes(4, "big") + b"IDAT" + new + bytes(4) + plain[at + 12 + len(old) :]
    assert (images.read_png(data)[0] == want).all()


def test_image_rows(spark, tmp_path):
    (tmp_path / "a.pgm").write_bytes(b"P5\n# note\n2 2\n255\n\x01\x02\x03\x04")
    (tmp_path / "b.raw").write_bytes(np.arange(4, dtype="<u2").tobytes())
    got = {r["path"][-5:]: r for r in images.load(spark, str(tmp_path), {"width": 2, "height": 2, "dtype": "<u2"}).collect()}
    assert got["a.pgm"]["comps"] == [[1, 2, 3, 4]] and got["b.raw"]["comps"] == [[0, 1, 2, 3]] and got["b.raw"]["dtype"] == "uint16"
    with pytest.raises(Unsupported):
        images.format_of("x.tif")


def test_container_index(spark):
    # fixed values: a chunk of 4 planes of 8 x 8 at two levels
    planes = [(116, 200, [161, 177, 198]), (316, 200, [161, 177, 198]), (516, 201, [162, 178, 199]), (717, 202, [163, 179, 200])]
    data = containers.serialized([4, 8, 8], 2, planes)
    assert len(data) == 116 and data[:8] == b"ndht\x01\x01\x02\x03"
    assert containers.parsed(data) == ([4, 8, 8], 2, planes)
    rows = containers.plane_index(spark.createDataFrame([(1, data), (2, None)], "k int, data binary"), "k").collect()
    assert [(r["plane"], r["offset"], r["len"], r["prefix"]) for r in rows] == [(i, *p) for i, p in enumerate(planes)]
    for cut in range(0, 116, 7):
        with pytest.raises(CodestreamError):
            containers.parsed(data[:cut])
    with pytest.raises(CodestreamError):
        containers.parsed(data[:7] + b"\x21" + data[8:])


def test_chunked_arrays(spark, tmp_path):
    shape = (6, 9, 5)
    want = np.random.default_rng(3).integers(-50, 50, shape)
    want[:3, :4] = 0
    cells = spark.createDataFrame([(*map(int, i), int(v)) for i, v in np.ndenumerate(want)], "z int, y int, x0 int, x long")
    path, axes = str(tmp_path / "a"), ["z", "y", "x0"]
    arrays.write(cells, path, axes, [3, 4, 2])
    got = np.zeros(shape, int)
    for r in arrays.read(spark, path, axes, [3, 4, 2]).collect():
        got[r["z"], r["y"], r["x0"]] = r["x"]
    assert (got == want).all()
    box = arrays.read_box(spark, path, axes, [3, 4, 2], [1, 2, 1], [4, 5, 3])
    assert {(r["z"], r["y"], r["x0"]): r["x"] for r in box.collect()} == {tuple(map(int, i + np.array([1, 2, 1]))): int(v) for i, v in np.ndenumerate(want[1:5, 2:7, 1:4]) for i in [np.array(i)]}
    plan = arrays.read(spark, path, axes, [3, 4, 2], [0, 0, 0], [1, 1, 1])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(c0)" in plan


def test_records(spark, tmp_path):
    for config, name, raw in (("b", "x", [8, 12]), ("a", "y", [])):
        (tmp_path / config).mkdir()
        (tmp_path / config / f"{name}.json").write_text(json.dumps({"name": name, "config": config, "raw_ns": raw, "median_ns": 10, "bytes_in": 4, "bytes_out": 2}, indent=1))
    (tmp_path / "manifest.json").write_text(json.dumps({"name": "m", "machine": "z"}))
    got = records.load(spark, str(tmp_path)).collect()
    assert [(r["config"], r["name"], r["sigma_ns"]) for r in got] == [("a", "y", 0.0), ("b", "x", 2.0)]


def test_streamed_blocks_equal_the_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    end = events.agg(F.max("ts")).first()[0]
    late = events.limit(1).withColumn("ts", F.lit(end) + F.expr("interval 2 days")).withColumn("event_id", F.lit(10**9))
    events.unionByName(late).select("event_id", F.col("ts").cast("timestamp"), "user_id", "event_type", "value", "props").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = signals.block_summary(signals.read_events(spark, str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("blocks").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    rows = lambda df: sorted(map(tuple, df.select("user_id", "start", "n", "first", "last", "energy").collect()))
    assert rows(spark.table("blocks")) == rows(signals.block_summary(events.withColumn("ts", F.col("ts").cast("timestamp"))))
