"""Exact top-k inner products over an impact-ordered, score-at-a-time index."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import table, written

TOP = 10
SCALE = 1024
BLOCK = 8192  # vectors in an index block
QUERY_BYTES = 32 << 20  # of queries sent to all tasks at once
LEVELS = 32
STOPS = tuple(i / 10 for i in range(1, 10))  # shares of the postings after which a proof is tried
SMALL, DIMS = 1 << 20, 1 << 11  # components and dimensions whose scores are exact in doubles
FARTHEST = (1 << 63) - 1
NO_ID = (1 << 63) - 1


class Block:
    """The inverted index of a block of integer vectors: for every dimension its vectors by rising value, cut into
    segments of equal quantised value. A segment's impact for a query is the most that it can add to a score."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors
        n, dims = vectors.shape
        self.low = vectors.min(axis=0)
        span = vectors.max(axis=0) - self.low
        self.width = np.maximum(1, -(-(span + 1) // LEVELS))
        level = (vectors - self.low) // self.width
        self.order = np.argsort(level, axis=0, kind="stable").T.copy()
        ranked = np.take_along_axis(level.T, self.order, axis=1)
        self.level = ranked.astype(np.float64)
        #: where each level's segment begins in its dimension
        self.cuts = np.stack([np.searchsorted(r, np.arange(LEVELS + 1)) for r in ranked])

    def best(self, q: np.ndarray, k: int, skip: int, known: float = -np.inf) -> tuple[np.ndarray, np.ndarray]:
        """Positions and exact scores of the k highest scores (with ties of the lowest), without position skip. Scores
        below `known` may be left out: the caller has k that are as high."""
        n, dims = self.vectors.shape
        levels = np.arange(LEVELS)
        floor = self.low[:, None] + levels * self.width[:, None]
        impact = np.maximum(q[:, None] * floor, q[:, None] * (floor + self.width[:, None] - 1))
        count = np.diff(self.cuts, axis=1)
        ranked = np.argsort(-impact, axis=None, kind="stable")
        sent = np.cumsum(count.ravel()[ranked])
        if impact.max(axis=1).sum() < known:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        acc = np.zeros(n)
        lo, hi = np.zeros(dims, int), self.cuts[:, -1].copy()  # what is left of each dimension
        rising = q <= 0  # the highest impacts lie at the low values
        slack = np.where(rising, 0, self.width - 1)
        for part in (*STOPS, 1.0):
            end = int(np.searchsorted(sent, part * sent[-1])) + 1 if part < 1 else len(ranked)
            done = np.bincount(ranked[:end] // LEVELS, minlength=dims)  # segments of each dimension, in order of impact
            ids, adds = [], []
            for d in range(dims):
                a, b = (lo[d], self.cuts[d, done[d]]) if rising[d] else (self.cuts[d, LEVELS - done[d]], hi[d])
                if b > a:
                    ids.append(self.order[d, a:b])
                    adds.append((self.level[d, a:b] * self.width[d] + (self.low[d] + slack[d])) * q[d])
                    if rising[d]:
                        lo[d] = b
                    else:
                        hi[d] = a
            if ids:
                acc += np.bincount(np.concatenate(ids), np.concatenate(adds), n)
            # no dimension can add more to any vector than its next segment's impact, or nothing if it was added already
            left = done < LEVELS
            bound = acc + np.maximum(0, np.where(left, np.where(rising, impact[np.arange(dims), np.minimum(done, LEVELS - 1)], impact[np.arange(dims), np.maximum(LEVELS - 1 - done, 0)]), 0)).sum()
            if skip >= 0:
                bound[skip] = -np.inf
            # exact scores of the most promising give a proof of what can't be among the best
            top = np.argpartition(-bound, min(k, n) - 1)[: min(k, n)]
            top = top[top != skip]
            if len(top) < k:
                some = np.flatnonzero(np.arange(n) != skip)
                if n - (skip >= 0) <= k:
                    return some, self.vectors[some] @ q
                least = -np.inf
            else:
                least = (self.vectors[top] @ q).min()
            least = max(least, known)
            some = np.flatnonzero(bound >= least)
            if len(some) <= max(4 * k, n // 64) or end == len(ranked):
                return some[some != skip], self.vectors[some[some != skip]] @ q
        raise AssertionError


def top_of(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -scores))[:k]


def matrices(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each length of vectors: the places of its rows, and these as a matrix of whole numbers in doubles."""
    lens, flat = column.value_lengths().to_numpy().astype(np.int64), np.floor(column.flatten().to_numpy())
    at, out = np.cumsum(lens) - lens, []
    for dims in np.unique(lens):
        own = np.flatnonzero(lens == dims)
        out.append((own, flat[at[own][:, None] + np.arange(dims)].reshape(len(own), dims)))
    return out


def small(rows: np.ndarray) -> np.ndarray:
    return np.abs(rows).max(axis=1, initial=0) < SMALL if 0 < rows.shape[1] <= DIMS else np.zeros(len(rows), bool)


class Best:
    """The best of each query so far: the vectors' ids, row numbers and scores."""

    def __init__(self, asked: pa.Table, k: int):
        self.k = k
        rids = asked.column("rid").to_numpy()
        self.queries = {rows.shape[1]: (rows, rids[own], small(rows)) for own, rows in matrices(asked.column("v").combine_chunks())} if asked.num_rows else {}
        self.found: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def add(self, qrid: int, ids: np.ndarray, scores: np.ndarray) -> None:
        if qrid in self.found:
            ids, scores = (np.concatenate(x) for x in zip(self.found[qrid], (ids, scores)))
        keep = top_of(scores, ids, self.k)
        self.found[qrid] = ids[keep], scores[keep]

    def meet(self, block: pa.Table) -> None:
        """All queries of a length meet a block's vectors of that length, over the block's index."""
        rids, vids = block.column("rid").to_numpy(), block.column("vid").to_numpy()
        for own, rows in matrices(block.column("v").combine_chunks()):
            asked, qrids, modest = self.queries.get(rows.shape[1], ((), (), ()))
            usual = small(rows)
            index, ids = Block(rows[usual].astype(np.int64)) if usual.any() and len(asked) else None, vids[own[usual]]
            place = {r: i for i, r in enumerate(rids[own[usual]].tolist())}
            for q, qrid, plain in zip(asked, qrids.tolist(), modest):
                if index is not None and plain:
                    had = self.found.get(qrid)
                    some, scores = index.best(q.astype(np.int64), self.k, place.get(qrid, -1), had[1][-1] if had and len(had[1]) == self.k else -np.inf)
                    self.add(qrid, ids[some], scores.astype(np.int64))
                # too large for exact sums of doubles: whole numbers of any size, held to 64 bits in the end
                rest = np.flatnonzero(~(usual & plain) & (rids[own] != qrid)) if not plain or not usual.all() else ()
                if len(rest):
                    whole = [int(x) for x in q]
                    scores = [max(-FARTHEST, min(FARTHEST, sum(int(x) * y for x, y in zip(rows[i], whole)))) for i in rest]
                    self.add(qrid, vids[own[rest]], np.array(scores, np.int64))


def searched(batches, asked, k: int):
    """The best of a task's vectors for each query, block after block; what is known bounds the search of later blocks."""
    best, held, n = Best(asked.value, k), [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= BLOCK:
            best.meet(pa.Table.from_batches(held))
            held, n = [], 0
    if n:
        best.meet(pa.Table.from_batches(held))
    for qrid, (ids, scores) in best.found.items():
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), qrid)), pa.array(ids), pa.array(scores)], names=["qrid", "vid", "score"])


def nearest(vectors: DataFrame, is_query, k: int = TOP, scale: int = SCALE) -> DataFrame:
    """The k highest inner products of each query with all other rows, on components floor(scale * x).

    Vectors are dealt to tasks once and stay there; each task indexes its blocks of BLOCK one after the other and holds
    every query against them, with what it knows of a query's best as a bound. Queries go to the tasks in parts of
    QUERY_BYTES. A query's best of all tasks are ranked in the end.

    Returns query_id, rank, vec_id, score; ties go to the smaller vec_id (null last). Vectors that are null or hold null or
    non-finite components take no part; vectors of another length than the query's don't either. Empty vectors score 0
    with each other. Rows that repeat a vec_id are vectors of their own. Components may be as large as a double; scores
    beyond 64 bits count as the last number of 64 bits on their side, with ties as any. An empty table gives no rows;
    other columns, whatever their names, are left out.
    """
    spark, x = vectors.sparkSession, F.col("embedding")
    sound = F.coalesce(F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))), F.lit(False))
    most = F.lit(1.7976931348623157e308 / scale)  # a component beyond it, in doubles only, would not be finite when scaled
    scaled = F.transform(x, lambda v: F.least(F.greatest(v.cast("double"), -most), most) * F.lit(float(scale)))
    rows = vectors.where(sound).select("vec_id", F.coalesce(F.col("vec_id").cast("long"), F.lit(NO_ID)).alias("vid"), scaled.alias("v"), F.coalesce(is_query(F.col("vec_id")), F.lit(False)).alias("asks"))
    held = written(rows.withColumn("rid", F.monotonically_increasing_id()))
    total, asking = held.agg(F.count("*"), F.coalesce(F.sum(F.when(F.col("asks"), 8 + 8 * F.size("v"))), F.lit(0))).first()
    parts, tasks = max(1, -(-asking // QUERY_BYTES)), max(1, min(-(-total // BLOCK), 4 * spark.sparkContext.defaultParallelism))
    dealt = held.select("rid", "vid", "v").repartition(tasks, F.xxhash64("rid"))
    dealt = written(dealt) if parts > 1 else dealt
    found = None
    for part in range(parts):
        asked = spark.sparkContext.broadcast(held.where("asks").where(F.pmod(F.xxhash64("rid", F.lit(1)), F.lit(parts)) == part).select("rid", "v").toArrow().combine_chunks())  # QUERY_BYTES
        own = dealt.mapInArrow(lambda batches, asked=asked: searched(batches, asked, k), "qrid long, vid long, score long")
        found = own if found is None else found.unionByName(own)
    best = Window.partitionBy("qrid").orderBy(F.col("score").desc(), "vid")  # k rows of each task at most
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    names = held.where("asks").select(F.col("rid").alias("qrid"), F.col("vec_id").alias("query_id"))
    return ranked.join(names, "qrid").select("query_id", "rank", F.nullif("vid", F.lit(NO_ID)).alias("vec_id"), "score")


def op9_topk(spark, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), lambda i: i % 100 == 0)


OP9_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v, row_number() OVER () AS rid
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.rid AS qrid, q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.rid <> c.rid AND len(q.v) = len(c.v)
  WHERE q.vec_id % 100 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY qrid ORDER BY score DESC, vec_id) AS k FROM s
)
SELECT query_id, CAST(k AS INTEGER) AS rank, vec_id, score FROM r WHERE k <= 10
"""
