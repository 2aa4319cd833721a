"""Chunk containers: a fixed header and the index of coefficient planes, little-endian."""

from __future__ import annotations

import struct

import pyarrow as pa
from pyspark.sql import DataFrame

from ..types import CodestreamError

# fixed values of the format
MAGIC, VERSION, FLAG_INDEX = b"ndht", 1, 1
MOST_DIMENSIONS, MOST_PLANES = 32, 1 << 24


def required(head: bytes) -> int:
    """Bytes of header and index, from the first eight bytes and the extents after them."""
    if len(head) < 8 or head[:4] != MAGIC:
        raise CodestreamError("no container header")
    version, flags, levels, dims = struct.unpack_from("4B", head, 4)
    if version != VERSION or not 2 <= dims <= MOST_DIMENSIONS:
        raise CodestreamError("unknown version or dimensions", 4)
    if len(head) < 8 + 4 * dims:
        return 8 + 4 * dims
    planes = 1
    for n in struct.unpack_from(f"<{dims - 2}I", head, 8):
        planes *= n
        if planes > MOST_PLANES:
            raise CodestreamError("too many planes", 8)
    return 8 + 4 * dims + (planes * (12 + 4 * (levels + 1)) if flags & FLAG_INDEX else 0)


def serialized(dims: list[int], levels: int, planes: list[tuple[int, int, list[int]]]) -> bytes:
    """Header and index of planes (offset, len, prefixes)."""
    head = MAGIC + struct.pack(f"<4B{len(dims)}I", VERSION, FLAG_INDEX, levels, len(dims), *dims)
    return head + b"".join(struct.pack(f"<QI{levels + 1}I", offset, size, *prefix) for offset, size, prefix in planes)


def parsed(data: bytes) -> tuple[list[int], int, list[tuple[int, int, list[int]]]]:
    need = required(data)
    if len(data) < need:
        need = required(data[:need]) if len(data) >= 8 else need
    if len(data) < need:
        raise CodestreamError("the index is cut short", len(data))
    levels, n = data[6], data[7]
    dims = list(struct.unpack_from(f"<{n}I", data, 8))
    width, planes = 12 + 4 * (levels + 1), []
    for at in range(8 + 4 * n, need, width):
        offset, size, *prefix = struct.unpack_from(f"<QI{levels + 1}I", data, at)
        if any(a > b for a, b in zip(prefix, [*prefix[1:], size])):
            raise CodestreamError("prefixes fall or pass the plane's end", at)
        planes.append((offset, size, prefix))
    return dims, levels, planes


def plane_index(chunks: DataFrame, key: str, data: str = "data") -> DataFrame:
    """A row for each plane of each chunk's container: key, plane, offset, len, prefix. No plane is decoded."""
    kind = chunks.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            rows = [(k, i, *p) for k, d in zip(batch.column(key).to_pylist(), batch.column(data).to_pylist()) if d is not None for i, p in enumerate(parsed(d)[2])]
            columns = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (batch.schema.field(key).type, pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64())))], names=[key, "plane", "offset", "len", "prefix"])

    return chunks.select(key, data).mapInArrow(run, f"`{key}` {kind}, plane int, offset bigint, len bigint, prefix array<bigint>")
