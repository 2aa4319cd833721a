"""Images as rows: binary PNM (P5, P6), PNG of 8 or 16 bits, raw little-endian samples.

An image is a row (path, width, height, dtype, comps): one array of samples for each component, in C order.
"""

from __future__ import annotations

import os
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..types import DTYPES, CodestreamError, InvalidArgument, Unsupported, dtype_named

IMAGE = "path string, width int, height int, dtype string, comps array<array<int>>"
PNM_HEAD = re.compile(rb"(P[1-7])" + rb"(?:\s|#[^\n]*\n)+(\d+)" * 3 + rb"\s")
PNG_SIGNATURE = b"\x89PNG\r\n\x1a\n"
PNG_KINDS = {0: 1, 2: 3, 4: 2, 6: 4}  # colour type: components


def format_of(path: str) -> str:
    kind = {".pgm": "pnm", ".ppm": "pnm", ".pnm": "pnm", ".png": "png", ".raw": "raw", ".bin": "raw"}.get(os.path.splitext(path)[1].lower())
    if kind is None:
        raise Unsupported(f"no image format for {path}")
    return kind


def read_pnm(data: bytes) -> tuple[np.ndarray, str]:
    m = PNM_HEAD.match(data)
    if not m or m[1] not in (b"P5", b"P6"):
        raise CodestreamError("no binary PNM header")
    n, width, height, most = (1 if m[1] == b"P5" else 3), int(m[2]), int(m[3]), int(m[4])
    kind = ">u2" if most > 255 else "u1"
    if len(data) - m.end() < width * height * n * np.dtype(kind).itemsize:
        raise CodestreamError("the samples are cut short", m.end())
    return np.frombuffer(data, kind, width * height * n, m.end()).reshape(height, width, n), "uint16" if most > 255 else "uint8"


def write_pnm(samples: np.ndarray, dtype: str) -> bytes:
    height, width, n = samples.shape
    if n not in (1, 3) or dtype not in ("uint8", "uint16"):
        raise Unsupported("PNM holds 1 or 3 unsigned components")
    head = f"P{5 if n == 1 else 6}\n{width} {height}\n{255 if dtype == 'uint8' else 65535}\n"
    return head.encode() + samples.astype("u1" if dtype == "uint8" else ">u2").tobytes()


def read_png(data: bytes) -> tuple[np.ndarray, str]:
    if data[:8] != PNG_SIGNATURE:
        raise CodestreamError("no PNG signature")
    at, body, head = 8, [], None
    while at + 8 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        if kind == b"IHDR":
            head = struct.unpack_from(">IIBBBBB", data, at + 8)
        elif kind == b"IDAT":
            body.append(data[at + 8 : at + 8 + size])
        elif kind == b"IEND":
            break
        at += 12 + size
    if head is None:
        raise CodestreamError("no IHDR")
    width, height, depth, colour, _, _, interlaced = head
    if depth not in (8, 16) or colour not in PNG_KINDS or interlaced:
        raise Unsupported("PNG of 8 or 16 bits, without palette or interlacing")
    n = PNG_KINDS[colour]
    step, row = n * depth // 8, width * n * depth // 8
    raw = zlib.decompress(b"".join(body))
    if len(raw) < height * (row + 1):
        raise CodestreamError("the samples are cut short")
    lines = np.frombuffer(raw, np.uint8, height * (row + 1)).reshape(height, row + 1)
    out = np.zeros((height + 1, row), np.uint8)
    for y in range(height):
        out[y + 1] = _unfiltered(int(lines[y, 0]), lines[y, 1:], out[y], step)
    return out[1:].copy().view(">u2" if depth == 16 else "u1").reshape(height, width, n), "uint16" if depth == 16 else "uint8"


def _unfiltered(kind: int, line: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    if kind == 0:
        return line
    if kind == 2:
        return line + above
    if kind == 1:
        return np.cumsum(line.reshape(-1, step), axis=0, dtype=np.uint8).ravel()
    if kind not in (3, 4):
        raise CodestreamError("unknown PNG filter")
    out, up, left, corner = bytearray(len(line)), above.tolist(), [0] * step, [0] * step
    for i, v in enumerate(line.tolist()):
        a, b, c = left[i % step], up[i], corner[i % step]
        if kind == 3:
            by = (a + b) >> 1
        else:
            pa_, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
            by = a if pa_ <= pb and pa_ <= pc else b if pb <= pc else c
        out[i] = left[i % step] = (v + by) & 255
        corner[i % step] = b
    return np.frombuffer(bytes(out), np.uint8)


def write_png(samples: np.ndarray, dtype: str) -> bytes:
    height, width, n = samples.shape
    colour = {v: k for k, v in PNG_KINDS.items()}.get(n)
    if colour is None or dtype not in ("uint8", "uint16"):
        raise Unsupported("PNG holds 1 to 4 unsigned components")
    lines = np.frombuffer(samples.astype("u1" if dtype == "uint8" else ">u2").tobytes(), np.uint8).reshape(height, -1)
    body = zlib.compress(np.concatenate([np.zeros((height, 1), np.uint8), lines], axis=1).tobytes())
    chunk = lambda kind, b: struct.pack(">I", len(b)) + kind + b + struct.pack(">I", zlib.crc32(kind + b))
    return PNG_SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8 if dtype == "uint8" else 16, colour, 0, 0, 0)) + chunk(b"IDAT", body) + chunk(b"IEND", b"")


def read_raw(data: bytes, width: int, height: int, dtype: str) -> tuple[np.ndarray, str]:
    dtype = dtype_named(dtype)
    code, width_of = DTYPES[dtype][:2]
    if "float" in dtype or width_of > 4 or len(data) % (width * height * width_of) or not data:
        raise InvalidArgument("raw samples are whole planes of up to 32-bit integers")
    return np.moveaxis(np.frombuffer(data, code).reshape(-1, height, width), 0, -1), dtype


def decode(path: str, data: bytes, raw: dict | None = None) -> tuple[np.ndarray, str]:
    kind = format_of(path)
    if kind == "raw":
        return read_raw(data, **(raw or {}))
    return (read_pnm if kind == "pnm" else read_png)(data)


def decoded(files: DataFrame, raw: dict | None = None) -> DataFrame:
    """Image rows of files (path, content). raw: width, height and dtype of raw files."""

    def run(batches):
        for batch in batches:
            rows = []
            for path, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                samples, dtype = decode(path, data, raw)
                rows.append((path, samples.shape[1], samples.shape[0], dtype, [samples[..., i].ravel().astype(np.int64).tolist() for i in range(samples.shape[2])]))
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.string(), pa.list_(pa.list_(pa.int32())))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["path", "width", "height", "dtype", "comps"])

    return files.select("path", "content").mapInArrow(run, IMAGE)


def encoded(images: DataFrame) -> DataFrame:
    """Files (path, content) of image rows, in the format of the path's extension."""

    def run(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                samples = np.stack([np.array(c).reshape(r["height"], r["width"]) for c in r["comps"]], axis=-1)
                kind = format_of(r["path"])
                if kind == "raw":
                    if samples.shape[2] != 1:
                        raise Unsupported("raw files hold one component")
                    out.append(samples.astype(DTYPES[r["dtype"]][0]).tobytes())
                else:
                    out.append((write_pnm if kind == "pnm" else write_png)(samples, r["dtype"]))
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(out, pa.binary())], names=["path", "content"])

    return images.select("path", "width", "height", "dtype", "comps").mapInArrow(run, "path string, content binary")


def load(spark: SparkSession, path: str, raw: dict | None = None) -> DataFrame:
    return decoded(spark.read.format("binaryFile").load(path).select("path", "content"), raw)
