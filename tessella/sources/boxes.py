"""Boxed codestreams: where the stream lies in a file of boxes, and what its header box says."""

from __future__ import annotations

import struct

import pyarrow as pa
from pyspark.sql import DataFrame

from ..types import CodestreamError

# fixed values of the format
SIGNATURE = bytes.fromhex("0000000c6a5020200d0a870a")
BRANDS = (b"jph ", b"jp2 ")


def walk(data: bytes, at: int, end: int):
    """(type, begin, end) of the payloads of the boxes between two places."""
    while at + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, at)
        begin = at + 8
        if size == 1 and begin + 8 <= end:
            size, begin = struct.unpack_from(">Q", data, begin)[0], begin + 8
        stop = end if size == 0 else at + size
        if stop < begin or stop > end:
            raise CodestreamError(f"box {kind!r} doesn't fit", at)
        yield kind, begin, stop
        at = stop


def located(data: bytes) -> dict:
    """offset and length of the codestream, with width, height and comps where a header box gives them."""
    if data[:12] != SIGNATURE:
        raise CodestreamError("no box signature")
    out, typed = {"width": None, "height": None, "comps": None}, False
    for kind, a, z in walk(data, 12, len(data)):
        if kind == b"ftyp":
            if not {data[a : a + 4], *(data[i : i + 4] for i in range(a + 8, z - 3, 4))} & set(BRANDS):
                raise CodestreamError("another brand", a)
            typed = True
        elif kind == b"jp2h":
            for inner, b, _ in walk(data, a, z):
                if inner == b"ihdr":
                    out["height"], out["width"], out["comps"] = struct.unpack_from(">IIH", data, b)
        elif kind == b"jp2c":
            if not typed:
                break
            return out | {"offset": a, "length": z - a}
    raise CodestreamError("no codestream" if typed else "no file type", 12)


def wrapped(stream: bytes, width: int, height: int, comps: int, depth: int) -> bytes:
    """A codestream in the boxes of a file."""
    make = lambda kind, body: struct.pack(">I4s", 8 + len(body), kind) + body
    header = make(b"ihdr", struct.pack(">IIHBBBB", height, width, comps, depth - 1, 7, 0, 0)) + make(b"colr", struct.pack(">BBBI", 1, 0, 0, 16 if comps >= 3 else 17))
    return SIGNATURE + make(b"ftyp", b"jph " + bytes(4) + b"jph ") + make(b"jp2h", header) + make(b"jp2c", stream)


def streams(files: DataFrame) -> DataFrame:
    """path, offset, length, width, height, comps of each boxed file (path, content); null fields where it is none."""

    def run(batches):
        for batch in batches:
            rows = []
            for data in batch.column("content").to_pylist():
                try:
                    rows.append(located(data or b""))
                except CodestreamError:
                    rows.append({})
            yield pa.RecordBatch.from_arrays([batch.column("path"), *(pa.array([r.get(k) for r in rows], pa.int64()) for k in ("offset", "length", "width", "height", "comps"))], names=["path", "offset", "length", "width", "height", "comps"])

    return files.select("path", "content").mapInArrow(run, "path string, offset bigint, length bigint, width bigint, height bigint, comps bigint")
