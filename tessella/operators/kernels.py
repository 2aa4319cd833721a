"""Chunk kernels: whole chunks as arrays through Arrow, for several levels or axes at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..types import AxisTransform, InvalidArgument


def _lift(v: np.ndarray, kind: str) -> np.ndarray:
    """One level along axis 0, in subband order."""
    if len(v) < 2:
        return v
    s, d = v[0::2].copy(), v[1::2].copy()
    if kind == "haar":
        d -= s[: len(d)]
        s[: len(d)] += d >> 1
    else:
        right = np.concatenate([s[1:], s[-1:]])[: len(d)]
        d -= (s[: len(d)] + right + 1) >> 1
        s += (np.concatenate([d[:1], d])[: len(s)] + np.concatenate([d, d[-1:]])[: len(s)] + 2) >> 2
    return np.concatenate([s, d])


def _unlift(v: np.ndarray, kind: str) -> np.ndarray:
    if len(v) < 2:
        return v
    half = (len(v) + 1) // 2
    s, d = v[:half].copy(), v[half:].copy()
    if kind == "haar":
        s[: len(d)] -= d >> 1
        d += s[: len(d)]
    else:
        s -= (np.concatenate([d[:1], d])[: len(s)] + np.concatenate([d, d[-1:]])[: len(s)] + 2) >> 2
        right = np.concatenate([s[1:], s[-1:]])[: len(d)]
        d += (s[: len(d)] + right + 1) >> 1
    out = np.empty_like(v)
    out[0::2], out[1::2] = s, d
    return out


def _segment(v: np.ndarray, step: AxisTransform, back: bool) -> np.ndarray:
    if step.kind == "delta":
        return np.cumsum(v, axis=0) if back else np.concatenate([v[:1], np.diff(v, axis=0)])
    lengths = [len(v)]
    for _ in range(step.levels - 1):
        lengths.append((lengths[-1] + 1) // 2)
    out = v.copy()
    for n in reversed(lengths) if back else lengths:
        out[:n] = (_unlift if back else _lift)(out[:n], step.kind)
    return out


def apply(chunk: np.ndarray, steps: list[AxisTransform], back: bool = False, lead: int = 0) -> np.ndarray:
    """A chunk after all steps (or before them); with `lead`, chunks stacked along that many further axes in front."""
    out = chunk.astype(np.int64)
    for step in reversed(steps) if back else steps:
        moved = np.moveaxis(out, step.dimension + lead, 0)
        size = step.group or max(1, len(moved))
        moved = np.concatenate([_segment(moved[a : a + size], step, back) for a in range(0, max(1, len(moved)), size)])
        out = np.moveaxis(moved, 0, step.dimension + lead)
    return out


MOST_ELEMENTS = 1 << 24  # that a kernel works on at once


def mapped(chunks: DataFrame, made, size: int, values: str, kind: str = "bigint") -> DataFrame:
    """An array column of `size` elements in each row after `made`, a function of all rows' elements as one (rows, size)
    array; null chunks stay null, the other columns as they are. Chunks of another size or with null elements raise."""

    def run(batches):
        for whole in batches:
            step = max(1, MOST_ELEMENTS // max(1, size))
            for a in range(0, whole.num_rows, step):
                batch = whole.slice(a, step)
                column = batch.column(values)
                there = column.is_valid().to_numpy(zero_copy_only=False)
                flat = column.drop_null().flatten()
                if len(flat) != size * int(there.sum()) or flat.null_count:
                    raise InvalidArgument(f"a chunk doesn't hold {size} elements")
                out = made(flat.to_numpy(zero_copy_only=False).reshape(-1, size))
                at = pa.array(np.r_[0, np.cumsum(there * size)].astype(np.int32), mask=np.r_[~there, False])
                arrays = pa.ListArray.from_arrays(at, pa.array(np.ascontiguousarray(out).ravel()))
                yield batch.set_column(batch.schema.get_field_index(values), values, arrays)

    schema = ", ".join(f"`{f.name}` {f'array<{kind}>' if f.name == values else f.dataType.simpleString()}" for f in chunks.schema.fields)
    return chunks.mapInArrow(run, schema)


def transformed(chunks: DataFrame, steps: list[AxisTransform], shape: list[int], back: bool = False, values: str = "values") -> DataFrame:
    """An array column (C order, of `shape`) of each row transformed, a batch of rows at a time; null chunks stay null
    and so do the other columns as they are."""
    return mapped(chunks, lambda rows: apply(rows.reshape(-1, *shape), steps, back, 1), int(np.prod(shape)), values)


def permuted(chunks: DataFrame, at: np.ndarray, values: str = "values") -> DataFrame:
    """Each chunk's elements in another order: the one at place at[i] comes i-th. Elements keep their type."""
    kind = chunks.schema[values].dataType.elementType.simpleString()
    return mapped(chunks, lambda rows: rows[:, at], len(at), values, kind)


def wavelet97(chunks: DataFrame, shape: tuple[int, int], back: bool = False, values: str = "values", kind: str = "float") -> DataFrame:
    """One level of the 2-D 9/7 wavelet of each plane (C order), or its inverse, in single precision or, with kind
    "double", in double."""
    real = {"float": np.float32, "double": np.float64}[kind]
    return mapped(chunks, lambda rows: dwt97(rows.reshape(-1, *shape), back, 1, real), shape[0] * shape[1], values, kind)


#: Lifting constants of the 9/7 wavelet (fixed values of ITU-T T.800, table F.4).
ALPHA, BETA, GAMMA, DELTA, SCALE = -1.586134342059924, -0.052980118572961, 0.882911075530934, 0.443506852043971, 1.230174104914001


def _fold97(s: np.ndarray, d: np.ndarray, k: np.floating, on_detail: bool) -> None:
    if on_detail:
        d += k * (s[: len(d)] + np.concatenate([s[1:], s[-1:]])[: len(d)])
    else:
        s += k * (np.concatenate([d[:1], d])[: len(s)] + np.concatenate([d, d[-1:]])[: len(s)])


def dwt97(plane: np.ndarray, back: bool = False, lead: int = 0, real: type[np.floating] = np.float32) -> np.ndarray:
    """One level of the 2-D 9/7 wavelet in the precision of `real`, subband order; the scale stays with the quantiser.
    Planes may be stacked along `lead` axes in front."""
    out = plane.astype(real)
    for axis in (1, 0) if back else (0, 1):
        v = np.moveaxis(out, axis + lead, 0)
        if len(v) > 1:
            half = (len(v) + 1) // 2
            s, d = (v[:half].copy(), v[half:].copy()) if back else (v[0::2].copy(), v[1::2].copy())
            steps = [(ALPHA, True), (BETA, False), (GAMMA, True), (DELTA, False)]
            for k, on_detail in reversed(steps) if back else steps:
                _fold97(s, d, real(-k if back else k), on_detail)
            if back:
                v = np.empty_like(v)
                v[0::2], v[1::2] = s, d
            else:
                v = np.concatenate([s, d])
        out = np.moveaxis(v, 0, axis + lead)
    return np.ascontiguousarray(out)
