"""Byte indexes and read plans as DataFrames: ranges are inclusive (start, end)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def coalesced(ranges: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """Ranges merged where they overlap or touch (start <= last end + 1), for each key."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = ranges.withColumn("_new", F.when(reach.isNull() | (F.col(start) > reach + 1), 1).otherwise(0))
    island = marked.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(*keys, "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")


def total_bytes(start: str = "start", end: str = "end") -> Column:
    return F.sum(F.col(end) - F.col(start) + 1)


ROWS_A_TASK = 250_000  # whose keys are dealt to one task, in the mean


def spread(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows dealt by keys to as many tasks as their number asks for, so that what a task sorts for windows over these
    keys doesn't grow with the table. Rows of one key stay together, however many."""
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // ROWS_A_TASK)), *keys)


def packet_index(packets: DataFrame, keys: list[str], order: list[str], length: str, base: Column | None = None) -> DataFrame:
    """Each packet's offset: the running sum of the lengths before it in progression order."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return packets.withColumn("offset", F.coalesce(F.sum(length).over(w), F.lit(0)) + (F.lit(0) if base is None else base))


#: What each progression runs through, outermost first (fixed values of ITU-T T.800, B.12); a chunk has one layer.
PROGRESSIONS = {"LRCP": ("res", "comp", "y", "x"), "RLCP": ("res", "comp", "y", "x"), "RPCL": ("res", "y", "x", "comp"), "PCRL": ("y", "x", "comp", "res"), "CPRL": ("comp", "y", "x", "res")}


def sequence(keys: list[str], progression: str, columns: dict[str, str], tie: str) -> Column:
    """A packet's number, from 1, in a progression. columns: the names of res, comp, y and x; tie orders equal ones."""
    return F.row_number().over(Window.partitionBy(*keys).orderBy(*(columns[c] for c in PROGRESSIONS[progression]), tie))


def bands(width: Column, height: Column, levels: int, res: Column) -> Column:
    """The subbands of a resolution as structs: band, x, y (where it lies among all coefficients), width, height."""
    level = F.lit(levels) - res
    lw, lh, pw, ph = (level_extent(v, k) for k in (level, level + 1) for v in (width, height))
    zero = F.lit(0).cast("long")
    one = lambda name, x, y, w, h: F.struct(F.lit(name).alias("band"), x.alias("bx"), y.alias("by"), w.alias("bw"), h.alias("bh"))
    return F.when(res == 0, F.array(one("LL", zero, zero, lw, lh))).otherwise(F.array(one("HL", pw, zero, lw - pw, ph), one("LH", zero, ph, pw, lh - ph), one("HH", pw, ph, lw - pw, lh - ph)))


def code_blocks(width: Column, height: Column, size: int) -> tuple[Column, Column]:
    """The numbers of code-blocks of size x size samples along a band."""
    return F.ceil(width / size).cast("long"), F.ceil(height / size).cast("long")


def region_plan(packets: DataFrame, keys: list[str], hit: Column, header: int) -> DataFrame:
    """Ranges for a region: the main header and the packets that it hits, coalesced."""
    head = packets.select(*keys, F.lit(0).cast("long").alias("start"), F.lit(header - 1).cast("long").alias("end")).distinct()
    body = packets.where(hit & (F.col("len") > 0)).select(*keys, F.col("offset").alias("start"), (F.col("offset") + F.col("len") - 1).alias("end"))
    return coalesced(head.unionByName(body), keys)


def stream_bits(grid: list[Column], rate_bits: int, dims: int, header_bits: int) -> Column:
    """The length of a fixed-rate stream of a grid of bricks."""
    bricks = F.lit(1).cast("long")
    for g in grid:
        bricks = bricks * g
    return F.lit(header_bits) + bricks * (rate_bits * 4**dims)


def prefixes(packets: DataFrame, keys: list[str], res: str = "res") -> DataFrame:
    """For each key and resolution, how far its packets and those of lower resolutions reach."""
    ends = packets.groupBy(*keys, res).agg(F.max(F.col("offset") + F.col("len")).alias("_end"))
    w = Window.partitionBy(*keys).orderBy(res).rowsBetween(Window.unboundedPreceding, 0)
    return ends.select(*keys, res, F.max("_end").over(w).alias("prefix"))


def level_extent(extent: Column, level: int | Column) -> Column:
    """ceil(extent / 2**level) in whole numbers."""
    scale = F.pow(F.lit(2), level if isinstance(level, Column) else F.lit(level)).cast("long")
    return F.floor((extent + scale - 1) / scale).cast("long")


def resolution_for(width: Column, height: Column, levels: int, most: Column) -> Column:
    """The largest resolution whose longer side is at most `most`, else 0."""
    out = F.lit(0)
    for r in range(levels + 1):
        out = F.when(F.greatest(level_extent(width, levels - r), level_extent(height, levels - r)) <= most, F.lit(r)).otherwise(out)
    return out


def plane_plan(planes: DataFrame, keys: list[str], header: str = "header_len", length: Column | None = None) -> DataFrame:
    """Ranges to fetch for the given planes of each chunk: its header and each plane's bytes (or a prefix), coalesced."""
    size = F.col("len") if length is None else length
    head = planes.where(F.col(header) > 0).select(*keys, F.lit(0).cast("long").alias("start"), (F.col(header) - 1).alias("end")).distinct()
    body = planes.where(size > 0).select(*keys, F.col("offset").alias("start"), (F.col("offset") + size - 1).alias("end"))
    return coalesced(head.unionByName(body), keys)


def brick_range(brick: list[Column], grid: list[Column], rate_bits: int, dims: int, header_bits: int) -> tuple[Column, Column]:
    """First and last byte of a fixed-rate brick, from its place in the grid alone."""
    linear = F.lit(0).cast("long")
    for b, g in zip(brick, grid):
        linear = linear * g + b
    bits = rate_bits * 4**dims
    first = F.lit(header_bits) + linear * bits
    return F.floor(first / 8).cast("long"), F.floor((first + bits - 1) / 8).cast("long")


def precinct_hit(px: Column, py: Column, res: Column, levels: int, width: Column, height: Column, rect: tuple[int, int, int, int], size: int) -> Column:
    """Whether a precinct of size x size samples of a resolution overlaps a rectangle (x, y, w, h) of the full plane."""
    x, y, w, h = rect
    down = lambda v: F.floor(F.lit(v) / F.pow(F.lit(2), F.lit(levels) - res)).cast("long")
    rw, rh = level_extent(width, F.lit(levels) - res), level_extent(height, F.lit(levels) - res)
    x0, y0 = F.least(down(x), rw), F.least(down(y), rh)
    x1, y1 = F.least(down(x + w - 1), rw - 1), F.least(down(y + h - 1), rh - 1)
    return (px * size <= x1) & ((px + 1) * size > x0) & (py * size <= y1) & ((py + 1) * size > y0)


def shifted(plan: DataFrame, by: int) -> DataFrame:
    """A plan for bytes that lie `by` further on, as in a box."""
    return plan.withColumns({"start": F.col("start") + by, "end": F.col("end") + by})


def rendered(plan: DataFrame, keys: list[str]) -> DataFrame:
    """Each key's plan as JSON and as the value of an HTTP Range header."""
    gathered = plan.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("ranges"), total_bytes().alias("total_bytes"))
    text = F.array_join(F.transform("ranges", lambda r: F.concat_ws("-", r["start"].cast("string"), r["end"].cast("string"))), ",")
    return gathered.select(*keys, F.to_json(F.struct("ranges", "total_bytes")).alias("plan"), text.alias("ranges"))
