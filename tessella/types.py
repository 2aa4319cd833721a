"""Data types, errors and the strict configuration of axis transforms."""

from __future__ import annotations

from dataclasses import dataclass, fields


class InvalidArgument(ValueError):
    """A request that no array or configuration can meet."""


class Unsupported(NotImplementedError):
    """A request that is sound but that this engine doesn't carry out."""


class CodestreamError(ValueError):
    """Bytes that don't hold what their format says, with the offset."""

    def __init__(self, message: str, offset: int = 0):
        super().__init__(f"{message} (at byte {offset})")
        self.offset = offset


class SourceError(OSError):
    """A store or file that can't be read or written."""


#: name -> (NumPy code, bytes, lowest, highest, Spark carrier); fixed values. Floats have no bounds here.
DTYPES = {
    "uint8": ("|u1", 1, 0, 2**8 - 1, "smallint"),
    "int8": ("|i1", 1, -(2**7), 2**7 - 1, "tinyint"),
    "uint16": ("<u2", 2, 0, 2**16 - 1, "int"),
    "int16": ("<i2", 2, -(2**15), 2**15 - 1, "smallint"),
    "uint32": ("<u4", 4, 0, 2**32 - 1, "bigint"),
    "int32": ("<i4", 4, -(2**31), 2**31 - 1, "int"),
    "uint64": ("<u8", 8, 0, 2**64 - 1, "decimal(20,0)"),
    "int64": ("<i8", 8, -(2**63), 2**63 - 1, "bigint"),
    "float32": ("<f4", 4, None, None, "float"),
    "float64": ("<f8", 8, None, None, "double"),
}


def dtype_named(name: str) -> str:
    """The name of a type given by name or NumPy code ("uint16", "<u2", "u2")."""
    for known, (code, *_) in DTYPES.items():
        if name in (known, code, code[1:]):
            return known
    raise InvalidArgument(f"unknown dtype {name!r}")


KINDS = ("delta", "haar", "lift53")


@dataclass(frozen=True)
class AxisTransform:
    """One reversible transform along one axis of a chunk. group 0 is the axis's whole extent."""

    axis: str
    dimension: int
    kind: str
    levels: int
    group: int = 0

    @classmethod
    def from_dict(cls, given: dict) -> "AxisTransform":
        if unknown := set(given) - {f.name for f in fields(cls)}:
            raise InvalidArgument(f"unknown keys {sorted(unknown)}")
        try:
            made = cls(**given)
        except TypeError as e:
            raise InvalidArgument(str(e)) from e
        whole = lambda x: isinstance(x, int) and not isinstance(x, bool)
        if made.kind not in KINDS:
            raise InvalidArgument(f"unknown kind {made.kind!r}")
        if not (whole(made.dimension) and made.dimension >= 0 and whole(made.levels) and whole(made.group) and made.group >= 0):
            raise InvalidArgument("dimension, levels and group are whole numbers of 0 or more")
        if (made.kind == "delta") != (made.levels == 0) or made.levels < 0:
            raise InvalidArgument("delta has no levels, the other kinds have one or more")
        return made


def transforms_of(configuration: dict) -> list[AxisTransform]:
    """The steps of a lifting configuration of version 0.1, or InvalidArgument."""
    if unknown := set(configuration) - {"version", "transforms"}:
        raise InvalidArgument(f"unknown keys {sorted(unknown)}")
    version = str(configuration.get("version", ""))
    if version != "0.1" and not version.startswith("0.1."):
        raise InvalidArgument(f"version {version!r} isn't 0.1")
    return [AxisTransform.from_dict(t) for t in configuration.get("transforms", [])]
