"""Sharding by sampled splitters."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import released, running, table, written

SHARDS = 40
RANGES_PER_SHARD = 64
SAMPLES_PER_RANGE = 16
ROUNDS = 4


def sampled(keys: DataFrame, by: list[str], per_byte: float, seed: int) -> pd.DataFrame:
    """A size-weighted sample of the keys `by`: one is drawn with probability size * per_byte, by its hash, so reruns
    agree. Records alike in `by` are drawn together and come as one row with their number."""
    even = F.pmod(F.xxhash64("h", "id", *(c for c in by if c == "nth"), F.lit(seed)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    drawn = keys.where(even < F.col("size") * F.lit(per_byte)).groupBy(*by).agg(F.max("size").alias("size"), F.count("*").alias("n")).toPandas()
    drawn["w"] = np.maximum(1.0, drawn["size"].to_numpy(float) * per_byte) * drawn["n"].to_numpy()
    return drawn.sort_values(by, ignore_index=True)


def quantiles(drawn: pd.DataFrame, n: int) -> np.ndarray:
    """Rows of drawn at which its weight passes 1/n, 2/n, ..."""
    c = drawn["w"].to_numpy().cumsum()
    return np.unique(np.searchsorted(c, c[-1] * np.arange(1, n) / n)) if len(c) else np.zeros(0, int)


def range_of(h: np.ndarray, ids: np.ndarray, nth: np.ndarray, splitters: list[tuple[int, int, int]]) -> np.ndarray:
    """The number of splitters at or below each key (h, id, nth)."""
    sh, sid, snth = (np.array(x, np.int64) for x in (zip(*splitters) if splitters else ((), (), ())))
    lo, hi = np.searchsorted(sh, h, "left"), np.searchsorted(sh, h, "right")
    out = lo.copy()
    for v in np.unique(h[hi > lo]):
        own = np.flatnonzero(h == v)
        a, b = lo[own[0]], hi[own[0]]
        first, last = np.searchsorted(sid[a:b], ids[own], "left"), np.searchsorted(sid[a:b], ids[own], "right")
        out[own] = a + first
        for i in np.unique(ids[own][last > first]):
            same = own[ids[own] == i]
            c, d = a + np.searchsorted(sid[a:b], i, "left"), a + np.searchsorted(sid[a:b], i, "right")
            out[same] = c + np.searchsorted(snth[c:d], nth[same], "right")
    return out


def ranger(splitters: list[tuple[int, int, int]]):
    @F.pandas_udf("long")
    def place(h: pd.Series, i: pd.Series, nth: pd.Series) -> pd.Series:
        return pd.Series(range_of(h.to_numpy(), i.to_numpy(), nth.to_numpy(), splitters))

    return place


LOW = -(1 << 63)


def shard(docs: DataFrame, shards: int = SHARDS, per_shard: int = RANGES_PER_SHARD, samples: int = SAMPLES_PER_RANGE) -> DataFrame:
    """Every document's shard, by even bytes.

    Keys are (hash of the text, doc_id). A size-weighted sample of keys gives shards * per_shard quantile ranges of
    texts; ranges that turn out over twice their share are subdivided with samples of their own, a range of one text
    by doc_id, one of rows alike in both by the order in which they were read. Running totals over the ranges then
    give every record its place among all bytes and so its shard. Copies of a text stay in one shard unless their range
    had to be subdivided further. The driver holds samples and one row per range, both bounded by the parameters.

    Returns doc_id, size, text_crc32, law, shard, slot, grown_shard. Null text: size 16, crc32 0, one text with the
    empty one. Null doc_ids sort first; repeated rows get a slot each; an empty table gives no rows; other columns
    are left out.
    """
    text = F.coalesce("text", F.lit(""))
    keys = written(docs.select("doc_id", F.coalesce("doc_id", F.lit(-(1 << 63))).cast("long").alias("id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("h"), F.monotonically_increasing_id().alias("nth")))
    total = keys.agg(F.sum("size")).first()[0] or 0
    ranges = shards * per_shard
    share = max(1.0, total / ranges)

    drawn = sampled(keys, ["h", "id"], samples / share, 0)
    splitters = {(int(x), LOW, LOW) for x in drawn["h"].to_numpy()[quantiles(drawn, ranges)]}
    heavy: set[int] = set()
    for seed in range(1, ROUNDS + 1):
        placed = written(keys.withColumn("range", ranger(sorted(splitters))("h", "id", "nth")))
        ends = [f(c).alias(f"{c}{k}") for c in ("h", "id", "nth") for k, f in enumerate((F.min, F.max))]
        held = placed.groupBy("range").agg(F.sum("size").alias("size"), *ends)
        over = held.where((F.col("size") > 2 * share) & (F.col("nth0") < F.col("nth1"))).toPandas()  # half as many as ranges at most
        known = len(splitters)
        for alike in (False, True) if seed < ROUNDS else ():
            some = over[((over["h0"] == over["h1"]) & (over["id0"] == over["id1"])) == alike]
            if not len(some):
                continue
            by = ["range", "h", "id", "nth"] if alike else ["range", "h", "id"]
            drawn = sampled(placed.where(F.col("range").isin([int(x) for x in some["range"]])), by, 8 * samples / share, seed)
            sizes = dict(zip(some["range"], some["size"]))
            for r, own in drawn.groupby("range"):
                own = own.reset_index(drop=True)
                at = quantiles(own, int(np.ceil(sizes[r] / share)) + 1)
                if alike:  # rows alike in text and doc_id
                    heavy.add(int(own["h"].iloc[0]))
                    splitters |= {(int(own["h"].iloc[i]), int(own["id"].iloc[i]), int(own["nth"].iloc[i])) for i in at}
                    continue
                # each text of over a share gets a range of its own, and so does each doc_id of one text; the next round divides these
                level = "h" if own["h"].nunique() > 1 else "id"
                weights = own.groupby(level)["w"].sum()
                large = [int(x) for x in weights.index[weights > 8 * samples]]
                at = {int(own[level].iloc[i]) for i in at} - {int(own[level].iloc[0])} | {*large} | {x + 1 for x in large if x < -LOW - 1}
                if level == "id":
                    heavy.add(int(own["h"].iloc[0]))
                splitters |= {(x, LOW, LOW) if level == "h" else (int(own["h"].iloc[0]), x, LOW) for x in at}
        if len(splitters) == known:
            break
        released(placed)

    rows = running(placed, ["h", "id", "size"], {"start": "size", "index": None}, part="range")
    # the middle byte of a text's copies decides for all of them, if they were not subdivided; they lie within one range
    lead = rows.where(~F.col("h").isin(sorted(heavy))) if heavy else rows
    first = lead.groupBy("range", "h").agg((F.min("start") + F.sum("size") / 2).alias("middle"), F.count("*").alias("n")).where("n > 1").drop("n")
    rows = rows.join(first, ["range", "h"], "left")
    rows = rows.withColumn("shard", F.least(F.floor(F.coalesce("middle", F.col("start") + F.col("size") / 2) * F.lit(float(shards)) / F.lit(float(max(1, total)))), F.lit(shards - 1)).cast("int"))
    begins = rows.groupBy("shard").agg(F.min("index").alias("begin"))  # one row for each shard
    return rows.join(F.broadcast(begins), "shard").select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("index") - F.col("begin")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op1_shards(spark, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))
