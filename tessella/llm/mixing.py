"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

import uuid
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import running, table, written

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
REPEATS = 3


def targets_of(sizes: list[int], weights: list[float], cap: int, budget: int) -> list[float]:
    """Shares of budget by weight; one above cap times its source's size stops there and the excess is shared anew."""
    out, free = [0.0] * len(sizes), list(range(len(sizes)))
    rest = float(budget)
    while free:
        unit = rest / sum(weights[i] for i in free)
        full = [i for i in free if unit * weights[i] > cap * sizes[i]]
        if not full:
            for i in free:
                out[i] = unit * weights[i]
            break
        for i in full:
            out[i] = float(cap * sizes[i])
            rest -= out[i]
        free = [i for i in free if i not in set(full)]
    return out


CHUNK = 256  # copies that a task makes of one row
SOURCES = 10_000  # sources whose plan is sent to all tasks; more are joined by a shuffle


def row_hash(docs: DataFrame, seed: int = 0):
    """A hash of all of a row's columns (but maps, which have none), nulls told from zeros."""
    own = [f.name for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    return F.xxhash64(F.lit(seed), *(x for c in own for x in (F.col(f"`{c}`"), F.col(f"`{c}`").isNull())))


def mix(docs: DataFrame, weights: tuple = WEIGHTS, cap: int = REPEATS, seed: int = 7) -> DataFrame:
    """How often the mix takes each document, and where.

    Every source's documents are shuffled (by hash, so reruns agree) and offered up to `cap` times over; an offer's
    virtual finish time is the source's tokens up to and with it, divided by the source's target. A source offers
    until its target is reached, its last offer only if that brings it nearer. All offers are range-sorted by finish
    time and cut where their sizes, the last one's up to the target, pass the total budget (the size of all
    documents). The driver holds one row per source.

    Returns a row per document: doc_id, source, row_hash, size, source_size, target, copies, taken. Size counts words
    of WORD; null text has none. Documents without words are never taken by the queue (copies 0, taken 0); sources
    may be null (sorted last, a source of its own); repeated rows are documents of their own; an empty table gives
    no rows.
    """
    keys = written(docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), row_hash(docs).alias("row_hash")))
    found = keys.groupBy("source").agg(F.sum("size").alias("size")).collect()
    found.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [r["size"] for r in found]
    shares = targets_of(sizes, [float(weights[i % len(weights)]) for i in range(len(found))], cap, sum(sizes))
    before = accumulate([0, *sizes])
    plan = docs.sparkSession.createDataFrame([(r["source"], i, r["size"], t, b) for i, (r, t, b) in enumerate(zip(found, shares, before))], "source string, rank int, source_size long, target double, before long")

    # one row per source
    ranked = keys.alias("k").join((F.broadcast(plan) if len(found) <= SOURCES else plan).alias("p"), F.col("k.source").eqNullSafe(F.col("p.source"))).select("k.*", "rank", "source_size", "target", "before", F.xxhash64("row_hash", F.lit(seed)).alias("shuffle"))
    queue = written(running(ranked, ["rank", "shuffle", "doc_id", "size"], {"upto": "size", "index": None}))
    start = F.col("upto") - F.col("before")
    offers = queue.where((F.col("size") > 0) & (F.col("target") > 0)).select("index", "size", "target", "upto", "before", "source_size", F.explode(F.sequence(F.lit(0), F.lit(cap - 1))).alias("copy"))
    begun = F.col("upto") - F.col("before") + F.col("copy") * F.col("source_size")
    offers = offers.where(begun + F.col("size") / 2 < F.col("target")).select("index", F.least("size", F.floor(F.col("target") - begun)).cast("long").alias("size"), ((begun + F.col("size")) / F.col("target")).alias("finish"), "copy")
    served = running(offers, ["finish", "index"], {"sent": "size"})
    taken = served.where(F.col("sent") + F.col("size") <= F.lit(sum(sizes)))
    last = taken.agg(F.max(F.struct("finish", "index")).alias("last")).first()["last"]
    limit, tie = (last["finish"], last["index"]) if last else (-1.0, -1)
    finish = lambda k: (start + F.lit(k) * F.col("source_size") + F.col("size")) / F.col("target")
    takes = lambda k: F.when((F.col("size") > 0) & (F.col("target") > 0) & (start + F.lit(k) * F.col("source_size") + F.col("size") / 2 < F.col("target")) & ((finish(k) < F.lit(limit)) | ((finish(k) == F.lit(limit)) & (F.col("index") <= F.lit(tie)))), 1).otherwise(0)
    copies = sum((takes(k) for k in range(1, cap)), takes(0))
    return queue.withColumn("copies", copies).select("doc_id", "source", "row_hash", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def mixed(docs: DataFrame, **how) -> DataFrame:
    """docs with every row as often as the mix takes it, columns unchanged, whatever their names. Rows alike in all
    columns share what is taken of them: one of them stands for all, as often as they are taken together, and tasks
    share its copies. Documents without words (null, empty and blank texts) are not taken; null ids and sources are
    as in `mix`; an empty table gives no rows."""
    mark, whole = f"_mixed_{uuid.uuid4().hex}", f"_all_{uuid.uuid4().hex}"
    key = lambda h, i: F.struct(h.alias("row_hash"), F.coalesce(i.cast("long"), F.lit(0)).alias("id"))
    chosen = mix(docs, **how).groupBy(key(F.col("row_hash"), F.col("doc_id")).alias(mark)).agg(F.sum("copies").alias(whole)).where(F.col(whole) > 0)
    one = docs.withColumn(mark, key(row_hash(docs), docs["doc_id"])).dropDuplicates([mark])  # repeated rows go before the shuffle
    joined = written(one.join(chosen, mark).withColumn(mark, F.col(whole)).drop(whole))  # read twice below
    few, many = joined.where(F.col(mark) <= CHUNK), joined.where(F.col(mark) > CHUNK)
    times = lambda df, n: df.withColumn(mark, F.explode(F.sequence(F.lit(1).cast("long"), n)))
    chunks = many.withColumn(mark, F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.floor((F.col(mark) - 1) / CHUNK)), lambda i: F.least(F.lit(CHUNK).cast("long"), F.col(mark) - i * CHUNK))))
    return times(few, F.col(mark)).unionByName(times(chunks.repartition(F.rand(7)), F.col(mark))).select(*docs.columns)


def op7_mix(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")
