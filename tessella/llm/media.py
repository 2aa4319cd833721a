"""Media columns: payloads in ISO media containers, described without decoding them."""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import dealt, slices, table

SAMPLE = 64  # bytes in a stored sample (a frame of 8-bit audio)
GROUP = 16  # every so many samples one is a keyframe
CHUNK = 1024  # samples in a chunk
RATE = 8000
LONG = 1 << 32
SLICE_BYTES = 8 << 20
#: Boxes that hold boxes, with the bytes of fields before these (fixed values of ISO/IEC 14496-12).
NESTED = {b"moov": 0, b"trak": 0, b"mdia": 0, b"minf": 0, b"dinf": 0, b"stbl": 0, b"edts": 0, b"udta": 0, b"stsd": 8, b"dref": 8}


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body


def full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def container(payload: bytes, sample: int = SAMPLE, group: int = GROUP, chunk: int = CHUNK, rate: int = RATE) -> bytes:
    """A payload of whole samples as one audio track of raw 8-bit samples; the sample tables say where each lies."""
    n = len(payload) // sample
    duration = len(payload)
    head = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isom", b"mp41")
    wide = len(payload) + 16 >= LONG
    entry = box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHHI", 1, 8, 0, 0, rate << 16))
    chunks = -(-n // chunk)
    runs = [(1, chunk)] * (chunks > 1 or n == chunk) + [(chunks, n - (chunks - 1) * chunk)] * (n % chunk > 0)
    keys = np.arange(1, n + 1, group, dtype=">u4")

    def movie(first: int) -> bytes:
        offsets = first + np.arange(chunks, dtype=np.int64) * chunk * sample
        far = first + len(payload) >= LONG
        stbl = box(
            b"stbl",
            full(b"stsd", struct.pack(">I", 1), entry),
            full(b"stts", struct.pack(">III", 1, n, sample)),
            full(b"stss", struct.pack(">I", len(keys)), keys.tobytes()),
            full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", f, s, 1) for f, s in runs)),
            full(b"stsz", struct.pack(">II", sample, n)),
            full(b"co64" if far else b"stco", struct.pack(">I", chunks), offsets.astype(">u8" if far else ">u4").tobytes()),
        )
        minf = box(b"minf", full(b"smhd", bytes(4)), box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1))), stbl)
        mdia = box(b"mdia", full(b"mdhd", struct.pack(">QQIQHH", 0, 0, rate, duration, 0x55C4, 0), version=1), full(b"hdlr", bytes(4), b"soun", bytes(12), b"\0"), minf)
        trak = box(b"trak", full(b"tkhd", struct.pack(">QQIIQ", 0, 0, 1, 0, duration), bytes(8), struct.pack(">hhhH", 0, 0, 0x100, 0), MATRIX, bytes(8), version=1, flags=3), mdia)
        mvhd = full(b"mvhd", struct.pack(">QQIQIH", 0, 0, rate, duration, 0x10000, 0x100), bytes(10), MATRIX, bytes(24), struct.pack(">I", 2), version=1)
        return box(b"moov", mvhd, trak)

    size = len(head) + len(movie(0)) + (16 if wide else 8)
    moov = movie(size)
    if len(head) + len(moov) + (16 if wide else 8) != size:
        moov = movie(len(head) + len(moov) + (16 if wide else 8))
    mdat = struct.pack(">I4sQ", 1, b"mdat", 16 + len(payload)) if wide else struct.pack(">I4s", 8 + len(payload), b"mdat")
    return head + moov + mdat + payload


def boxes(data: memoryview, start: int = 0, end: int | None = None):
    """(type, where its fields begin, where it ends) of each box between start and end, without going into it."""
    end = len(data) if end is None else end
    while start + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, start)
        begin = start + 8
        if size == 1:
            (size,) = struct.unpack_from(">Q", data, begin)
            begin += 8
        stop = end if size == 0 else start + size
        if stop < begin or stop > end:
            raise ValueError(f"box {kind!r} at {start} doesn't fit")
        yield kind, begin, stop
        start = stop


def walked(data: memoryview, start: int = 0, end: int | None = None, path: tuple = ()):
    for kind, begin, stop in boxes(data, start, end):
        yield (*path, kind), begin, stop
        if kind in NESTED:
            yield from walked(data, begin + NESTED[kind], stop, (*path, kind))


def numbers(data: memoryview, at: int, n: int, kind: str, stop: int) -> np.ndarray:
    width = np.dtype(kind).itemsize
    if at + n * width > stop:
        raise ValueError("a table is cut short")
    return np.frombuffer(data, kind, n, at).astype(np.int64)


class Track:
    """What one track says: handler, codec, time scale, duration, and each sample's place, size and keyframe mark. Of a
    whole file that is the first track; `start` and `end` are the fields of another `trak` box."""

    def __init__(self, data: bytes, start: int | None = None, end: int | None = None):
        view = memoryview(data)
        if start is None:
            start, end = next(((a, z) for path, a, z in walked(view) if path == (b"moov", b"trak")), (0, 0))
        self.handler, self.codec, self.scale, self.duration = "", "", 0, 0
        sizes = chunks = runs = keys = None
        for path, a, z in walked(view, start, end, (b"moov", b"trak")):
            kind = path[-1]
            if kind == b"mdhd":
                wide = view[a] == 1
                self.scale, self.duration = struct.unpack_from(">IQ" if wide else ">II", view, a + (20 if wide else 12))
            elif kind == b"hdlr":
                self.handler = bytes(view[a + 8 : a + 12]).decode("latin-1").strip()
            elif path[-2:-1] == (b"stsd",) and not self.codec:
                self.codec = kind.decode("latin-1").strip()
            elif kind == b"stsz":
                each, n = struct.unpack_from(">II", view, a + 4)
                if each * n > len(view):
                    raise ValueError("more samples than bytes")
                sizes = np.full(n, each, np.int64) if each else numbers(view, a + 12, n, ">u4", z)
            elif kind in (b"stco", b"co64"):
                chunks = numbers(view, a + 8, struct.unpack_from(">I", view, a + 4)[0], ">u4" if kind == b"stco" else ">u8", z)
            elif kind == b"stsc":
                runs = numbers(view, a + 8, 3 * struct.unpack_from(">I", view, a + 4)[0], ">u4", z).reshape(-1, 3)
            elif kind == b"stss":
                keys = numbers(view, a + 8, struct.unpack_from(">I", view, a + 4)[0], ">u4", z) - 1
        if sizes is None or chunks is None or runs is None:
            raise ValueError("no sample tables")
        # samples in each chunk, then each sample's place: its chunk's offset and the sizes before it in the chunk
        held = np.diff(np.append(runs[:, 0] - 1, len(chunks)))
        if (held < 0).any() or (runs[:, 1] > len(sizes)).any() or not len(sizes) <= int((runs[:, 1] * held).sum()) <= 2 * len(sizes):
            raise ValueError("chunks and samples differ")
        each = np.repeat(runs[:, 1], held)
        owner = np.repeat(np.arange(len(chunks)), each)[: len(sizes)]
        before = np.cumsum(sizes) - sizes
        lead = np.r_[0, np.cumsum(each)][:-1]
        self.sizes = sizes
        self.at = chunks[owner] + before - before[np.minimum(lead, max(0, len(sizes) - 1))][owner] if len(sizes) else before
        self.keys = np.arange(len(sizes)) if keys is None else keys
        if len(self.keys) and not 0 <= self.keys.min() <= self.keys.max() < len(sizes):
            raise ValueError("a keyframe that is no sample")

    def keyframes(self) -> list[dict]:
        return [{"offset": a, "length": n} for a, n in zip(self.at[self.keys].tolist(), self.sizes[self.keys].tolist())]

    def payload(self, data: bytes) -> bytes:
        """The samples' bytes in order; neighbouring samples are read at once."""
        if not len(self.at):
            return b""
        ends = self.at + self.sizes
        cut = np.flatnonzero(self.at[1:] != ends[:-1]) + 1
        return b"".join(data[a:z] for a, z in zip(self.at[np.r_[0, cut]], ends[np.r_[cut - 1, len(ends) - 1]]))

    def feature(self) -> str:
        where = np.stack([self.at[self.keys], self.sizes[self.keys]]).astype("<i8").tobytes() if len(self.keys) else b""
        return f"codec={self.codec};scale={self.scale};duration={self.duration};samples={len(self.sizes)};keyframes={len(self.keys)};ranges_crc32={zlib.crc32(where)}"


def padded(text: bytes, unit: int = SAMPLE) -> bytes:
    return text + bytes(-len(text) % unit if text else unit)


def stored(batches):
    for batch in batches:
        for texts, rows in slices(batch, SLICE_BYTES):
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pc.binary_length(texts).cast(pa.int64()), pa.array([container(padded(t)) for t in texts.cast(pa.binary()).to_pylist()], pa.binary())], names=["doc_id", "n_bytes", "media"])


def store(docs: DataFrame) -> DataFrame:
    """Each text as a media file: doc_id, n_bytes, media. Null text counts as empty."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(stored, "doc_id long, n_bytes long, media binary")


def tracks(data: bytes) -> tuple[list[Track], str | None]:
    """A file's tracks, and what is wrong with it: broken files have none, and of a fragmented one only the samples
    listed in its movie box are known."""
    try:
        view = memoryview(data)
        found = list(walked(view))
        out = [Track(data, a, z) for path, a, z in found if path == (b"moov", b"trak")]
        kinds = {path[0] for path, _, _ in found}
    except (ValueError, struct.error, IndexError) as e:
        return [], f"broken: {e}"
    return out, "no track" if not out else "fragmented" if b"moof" in kinds else None


KEYFRAMES = "array<struct<offset:bigint,length:bigint>>"
INSPECTED = {"codec": "string", "duration": "double", "samples": "bigint", "keyframes": KEYFRAMES, "tracks": f"array<struct<handler:string,codec:string,duration:double,samples:bigint,keyframes:{KEYFRAMES}>>", "error": "string"}


def inspected(batches, kept: list[str], schema: pa.Schema):
    for batch in batches:
        rows = []
        for media in batch.column("media").to_pylist():
            found, error = tracks(media) if media is not None else ([], None)
            own = [{"handler": t.handler, "codec": t.codec, "duration": t.duration / t.scale if t.scale else None, "samples": len(t.sizes), "keyframes": t.keyframes()} for t in found]
            main = next((t for t in own if t["handler"] == "vide"), own[0] if own else {})
            rows.append([*(main.get(c) for c in ("codec", "duration", "samples", "keyframes")), own if media is not None else None, error])
        results = [pa.array(c, schema.field(len(kept) + i).type) for i, c in enumerate(zip(*rows))] if rows else [pa.array([], schema.field(len(kept) + i).type) for i in range(len(INSPECTED))]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *results], names=schema.names)


def inspect(media: DataFrame) -> DataFrame:
    """Codec, duration (seconds), samples and keyframe byte ranges of a column `media` of ISO media files, from their
    boxes and sample tables alone: of the first video track or, without one, the first track; `tracks` has all.

    `error` is null for a sound file, "broken: ..." for one that can't be read, "no track", or "fragmented" for one
    whose fragments' samples are not in its movie box. Null media gives nulls. All columns but media stay; a result
    whose name is taken is called media_<name>. An empty table gives no rows.
    """
    kept = [c for c in media.columns if c != "media"]
    names = {c: next(x for x in (c, *("media_" * k + c for k in range(1, 99))) if x not in media.columns) for c in INSPECTED}
    fields = [*(f for f in media.schema.fields if f.name in kept), *T._parse_datatype_string(", ".join(f"`{names[c]}` {k}" for c, k in INSPECTED.items())).fields]
    schema = T.StructType(fields)
    arrow = to_arrow_schema(schema)
    return media.select(*(f"`{c}`" for c in kept), "media").mapInArrow(lambda batches: inspected(batches, kept, arrow), schema)


def digested(batches):
    for batch in batches:
        for texts, rows in slices(batch, SLICE_BYTES):
            out = []
            for text in texts.cast(pa.binary()).to_pylist():
                media = container(padded(text))
                track = Track(media)
                back = track.payload(media)
                out.append((len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-SAMPLE:]), len(media), hashlib.sha256(media).hexdigest(), track.feature()))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), *(pa.array(c, k) for c, k in zip(zip(*out), kinds))], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])


def digests(docs: DataFrame) -> DataFrame:
    """Each text's media file, stored and read back in one task, as digests.

    Returns doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature. Null and
    empty texts store one sample of zeros; repeated rows and null doc_ids give a row each; an empty table gives no
    rows; other columns are left out.
    """
    return dealt(docs.select(F.col("doc_id").cast("long"), "text")).mapInArrow(digested, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op5_media(spark, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
