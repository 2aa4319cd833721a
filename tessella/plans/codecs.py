"""Codec metadata: strict configurations, and the stages of a series that DataFrames carry out."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import kernels, lifting
from ..types import DTYPES, AxisTransform, InvalidArgument, Unsupported, dtype_named, transforms_of

PROGRESSIONS = ("LRCP", "RLCP", "RPCL", "PCRL", "CPRL")
ALIASES = {"nd_zfp": "zfp"}
ZFP_PARAMETER = {"reversible": None, "fixed_rate": "rate", "fixed_accuracy": "tolerance", "fixed_precision": "precision"}


def _only(configuration: dict, known: set[str]) -> None:
    if unknown := set(configuration) - known:
        raise InvalidArgument(f"unknown keys {sorted(unknown)}")


def check_htj2k(c: dict) -> dict:
    _only(c, {"xy_levels", "reversible", "progression", "index"})
    c = {"xy_levels": 5, "reversible": True, "progression": "RPCL", "index": True} | c
    if not 0 <= c["xy_levels"] <= 32:
        raise InvalidArgument("xy_levels is 0 to 32")
    if c["progression"] not in PROGRESSIONS:
        raise Unsupported(f"progression {c['progression']!r}")
    return c


def check_zfp(c: dict) -> dict:
    """A mode with exactly its own parameter, finite and positive; dims only in old metadata."""
    _only(c, {"mode", "rate", "tolerance", "precision", "dims"})
    mode = c.get("mode", "reversible")
    if mode not in ZFP_PARAMETER:
        raise Unsupported(f"mode {mode!r}")
    own = ZFP_PARAMETER[mode]
    given = {k for k in ("rate", "tolerance", "precision") if c.get(k) is not None}
    if given != ({own} if own else set()):
        raise InvalidArgument(f"{mode} takes {own or 'no parameter'}, not {sorted(given)}")
    if own and not (math.isfinite(c[own]) and c[own] > 0 and (own == "tolerance" or c[own] <= 64)):
        raise InvalidArgument(f"{own} {c[own]} is out of range")
    if c.get("dims") is not None and c["dims"] not in (1, 2, 3, 4):
        raise InvalidArgument("dims is 1 to 4")
    return {"mode": mode} | ({own: c[own]} if own else {})


def check_delta(c: dict) -> dict:
    _only(c, {"dtype", "astype"})
    dtype_named(c.get("dtype", ""))
    if c.get("astype", c["dtype"]) != c["dtype"]:
        raise InvalidArgument("astype differs from dtype")
    return {"dtype": c["dtype"]}


def check_lift(c: dict) -> dict:
    transforms_of(c)
    return c


def check_transpose(c: dict) -> dict:
    _only(c, {"order"})
    if sorted(c["order"]) != list(range(len(c["order"]))):
        raise InvalidArgument("order isn't a permutation")
    return c


#: Codecs by name: (kind, configuration check).
REGISTRY = {
    "transpose": ("array", check_transpose),
    "reshape": ("array", dict),
    "nd_lift": ("array", check_lift),
    "numcodecs.delta": ("array", check_delta),
    "htj2k": ("bytes", check_htj2k),
    "zfp": ("bytes", check_zfp),
    "bytes": ("bytes", dict),
    "blosc": ("bytes", dict),
}


def validated(codec: dict) -> dict:
    """A codec's metadata with its configuration checked and its name resolved."""
    name = ALIASES.get(codec.get("name"), codec.get("name"))
    if name not in REGISTRY:
        raise Unsupported(f"codec {codec.get('name')!r}")
    return {"name": name, "configuration": REGISTRY[name][1](codec.get("configuration", {}))}


def reshaped_to(given: list, shape: list[int]) -> list[int]:
    """The extents that a reshape asks for: each entry is a number of elements, -1 for what is left (once at most), or
    a list of the dimensions whose elements it takes together."""
    out = [math.prod(shape[d] for d in x) if isinstance(x, (list, tuple)) else x for x in given]
    whole, known = math.prod(shape), math.prod(x for x in out if x != -1)
    if out.count(-1) > 1 or any(x < 1 and x != -1 for x in out):
        raise InvalidArgument(f"a reshape to {given} isn't defined")
    if -1 in out and known and whole % known == 0:
        out[out.index(-1)] = whole // known
    if math.prod(out) != whole:
        raise InvalidArgument(f"{whole} elements don't make {given}")
    return out


def array_stages(chunks: DataFrame, series: list[dict], shape: list[int], values: str = "values", back: bool = False) -> DataFrame:
    """The array stages of a series (or their inverse, in reverse) on chunks of values in C order; a stage that makes
    bytes is where Parquet's own encodings take over, and ends the list."""
    stages, shapes = [], [list(shape)]
    for codec in map(validated, series):
        if REGISTRY[codec["name"]][0] != "array":
            break
        c, now = codec["configuration"], shapes[-1]
        stages.append((codec["name"], c, now))
        shapes.append([now[d] for d in c["order"]] if codec["name"] == "transpose" else reshaped_to(c["shape"], now) if codec["name"] == "reshape" else now)
    for name, c, now in reversed(stages) if back else stages:
        if name == "transpose":
            chunks = _transposed(chunks, values, now, c["order"], back)
        elif name == "nd_lift":
            chunks = kernels.transformed(chunks, transforms_of(c), now, back, values)
        elif name == "numcodecs.delta":
            chunks = _modular(chunks, dtype_named(c["dtype"]), math.prod(now), back, values)
    return chunks


def _transposed(chunks: DataFrame, values: str, shape: list[int], order: list[int], back: bool) -> DataFrame:
    """The elements picked in the other order: a constant permutation of places."""
    at = np.arange(math.prod(shape)).reshape(shape).transpose(order).ravel()
    return kernels.permuted(chunks, np.argsort(at) if back else at, values)


def _modular(chunks: DataFrame, dtype: str, n: int, back: bool, values: str) -> DataFrame:
    if "float" in dtype:
        raise Unsupported("differences of floats can't be undone exactly")
    made = kernels.transformed(chunks, [AxisTransform("i", 0, "delta", 0)], [n], back, values)
    bits, low = 8 * DTYPES[dtype][1], DTYPES[dtype][2]
    if bits == 64:
        return made
    return made.withColumn(values, F.transform(values, lambda v: F.pmod(v - F.lit(low), F.lit(1 << bits)) + F.lit(low)))


@dataclass(frozen=True)
class Interval:
    low: int
    high: int

    def __or__(self, other: "Interval") -> "Interval":
        return Interval(min(self.low, other.low), max(self.high, other.high))


def budget(values: Interval, steps: list[AxisTransform], shape: list[int], bits: int = 32) -> Interval:
    """The widest coefficients that steps can make of values, or InvalidArgument where these or an intermediate sum
    leave a plane of `bits` bits. Whole numbers of Python, so that nothing here overflows."""
    most = Interval(-(1 << (bits - 1)), (1 << (bits - 1)) - 1)

    def within(x: Interval, step: AxisTransform) -> Interval:
        if x.low < most.low or x.high > most.high:
            raise InvalidArgument(f"{step.kind} along {step.axis!r} could leave the {bits}-bit plane")
        return x

    reach = values
    for step in steps:
        length = min(step.group or shape[step.dimension], shape[step.dimension])
        if length < 2:
            continue
        band = reach
        for _ in range(max(1, step.levels)):
            if length < 2:
                break
            spread = band.high - band.low
            detail = Interval(-spread, spread)
            if step.kind == "delta":
                band, made = band, detail
            elif step.kind == "haar":
                band = Interval(band.low + (-spread // 2), band.high + spread // 2)
                made = band | detail
            else:
                within(Interval(2 * band.low + 1, 2 * band.high + 1), step)
                within(Interval(2 - 2 * spread, 2 + 2 * spread), step)
                band = Interval(band.low + (2 - 2 * spread) // 4, band.high + (2 + 2 * spread) // 4)
                made = band | detail
            reach = within(reach | made, step)
            length = (length + 1) // 2
    return reach


def widened(x: Column, dtype: str, bits: int = 32) -> Column:
    """Elements as plane samples; values outside the type or the plane of `bits` bits raise."""
    _, _, low, high, _ = DTYPES[dtype]
    if low is None:
        raise Unsupported("planes hold whole numbers")
    low, high = max(low, -(1 << (bits - 1))), min(high, (1 << (bits - 1)) - 1)
    return F.when((x < low) | (x > high), F.raise_error(F.lit(f"a value doesn't fit {dtype} in a {bits}-bit plane"))).otherwise(x.cast("long"))


def plane_bits(dtype: str) -> int:
    """The plane that holds a type's values: of 32 bits where they fit, else of 64."""
    return 64 if DTYPES[dtype][3] is None or DTYPES[dtype][3] > (1 << 31) - 1 else 32


def encoded_fill(fill: int, dtype: str, steps: list[AxisTransform], shape: list[int], bits: int = 32) -> np.ndarray:
    """What a chunk of nothing but `fill` holds after the steps: an absent chunk of coefficients reads as this."""
    low, high = max(DTYPES[dtype][2], -(1 << (bits - 1))), min(DTYPES[dtype][3], (1 << (bits - 1)) - 1)
    if not low <= fill <= high:
        raise InvalidArgument(f"fill {fill} doesn't fit {dtype} in a {bits}-bit plane")
    return kernels.apply(np.full(shape, fill, np.int64), steps)


def narrowed(v: Column, dtype: str) -> Column:
    """Plane samples as elements of a type; those outside its range raise."""
    _, _, low, high, carrier = DTYPES[dtype]
    return F.when((v < low) | (v > high), F.raise_error(F.lit(f"a value doesn't fit {dtype}"))).otherwise(v).cast(carrier)


def forward_checked(cells: DataFrame, keys: list[str], axes: list[str], steps: list[AxisTransform], shape: list[int], value: str = "x", dtype: str = "int32") -> DataFrame:
    """forward_steps after the budget of the values at hand, in the plane of their type."""
    row = cells.agg(F.min(value).alias("a"), F.max(value).alias("b")).first()
    if row["a"] is not None:
        budget(Interval(row["a"], row["b"]), steps, shape, plane_bits(dtype))
    return lifting.forward_steps(cells, keys, axes, steps, value)


def effective_shape(shape: list[int], dims: int | None = None) -> list[int]:
    """A chunk's shape for the field codec: as it is, or (old metadata) squeezed and padded on the left to dims."""
    if dims is None:
        return shape
    kept = [n for n in shape if n > 1]
    if len(kept) > dims:
        raise InvalidArgument(f"{len(kept)} dimensions don't fit {dims}")
    return [1] * (dims - len(kept)) + kept


