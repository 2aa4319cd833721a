"""Near-duplicate documents by a MinHash LSH forest, links confirmed on whole shingle sets."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import dealt, released, slices, table, written

HASHES = 64
TREES = 16
DEPTH = 4  # a pair of similarity 0.8 shares this prefix in one of the trees with probability 0.9998
DEEPEST = 8
REGION = 16
NEIGHBOURS = 3
WINDOW = 2048
MEMBER_BLOCK, REST_BLOCK = 1_000_000, 250_000  # shingles in a block
SLICE_BYTES = 8 << 20
NO_ID = -(1 << 63)  # in place of a null doc_id where rows are found by it
#: Pairs whose 2-bit sketches differ in more of the 64 places are no candidates: a pair of similarity 0.8 differs in 9.6 of them, 22 is 4.3 deviations away.
SKETCH_LIMIT = 22

MIX = np.random.default_rng(20240101).integers(1, 1 << 63, HASHES + 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def stirred(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: pa.Array, k: int):
    """Each text's distinct shingle hashes, sorted. Words are lower-cased (A-Z) and split at ASCII white space; a text of fewer than k words is one shingle, one without words has none."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    at = split.offsets.to_numpy().astype(np.int64) - split.offsets[0].as_py()
    words = split.flatten()
    blank = pc.equal(words, "").to_numpy(zero_copy_only=False)
    coded = words.dictionary_encode()
    each = pd.util.hash_array(coded.dictionary.to_pandas().to_numpy(object), categorize=False).astype(np.uint64)
    w = stirred(each)[coded.indices.to_numpy()] if len(coded) else np.zeros(0, np.uint64)
    if blank.any():
        at = np.r_[0, np.cumsum(~blank)][at]
        w = w[~blank]
    rolled = np.zeros(max(0, len(w) - k + 1), np.uint64)
    for j in range(k):
        rolled += w[j : len(w) - k + 1 + j] * MIX[HASHES + j]
    rolled = stirred(rolled)
    for a, b in zip(at[:-1], at[1:]):
        if b - a >= k:
            yield np.unique(rolled[a : b - k + 1])
        elif b > a:
            yield stirred((w[a:b] * MIX[HASHES + 32 : HASHES + 32 + b - a]).sum(keepdims=True) + MIX[HASHES + 31] * np.uint64(b - a))
        else:
            yield rolled[:0]


def signature(s: np.ndarray) -> np.ndarray:
    low = np.full(HASHES, np.iinfo(np.uint64).max)
    for a in range(0, len(s), 2048):
        np.minimum(low, (s[a : a + 2048, None] * MIX[None, :HASHES]).min(axis=0), out=low)
    return (stirred(low) >> np.uint64(32)).astype(">u4")


def digest(s: np.ndarray) -> bytes:
    """128 bits of a set, whatever its order."""
    return (int(s.sum()) << 64 | int(stirred(s ^ MIX[HASHES + 30]).sum())).to_bytes(16, "big")


NODE = "text_hash long, node binary, n int, sig binary, s1 long, s2 long"


def signed(batches, k: int):
    """doc_id, text_hash and, for each document, its set's digest (node), size, signature and sketch."""
    bit = np.uint64(1) << np.arange(64, dtype=np.uint64)
    for batch in batches:
        for texts, rows in slices(batch, SLICE_BYTES):
            node, n, sig, s1, s2 = [], [], [], [], []
            for s in shingle_sets(texts, k):
                low = signature(s)
                node.append(digest(s) if len(s) else None)
                n.append(len(s))
                sig.append(low.tobytes() if len(s) else None)
                s1.append(int(bit[(low & 1).astype(bool)].sum()) if len(s) else 0)
                s2.append(int(bit[(low & 2).astype(bool)].sum()) if len(s) else 0)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("text_hash"), pa.array(node, pa.binary()), pa.array(n, pa.int32()), pa.array(sig, pa.binary()), pa.array(np.array(s1, np.uint64).view(np.int64)), pa.array(np.array(s2, np.uint64).view(np.int64))], names=["doc_id", "text_hash", "node", "n", "sig", "s1", "s2"])


PAIR = "a long, b long, region binary, node long, n int"


def alike(x1, x2, y1, y2) -> np.ndarray:
    return np.bitwise_count((x1 ^ y1) | (x2 ^ y2)) <= SKETCH_LIMIT


def neighbours(batches):
    """Candidates from a task's rows, sorted by tree and signature order.

    A region is a run of rows that share a tree and DEPTH hashes. Regions of up to REGION rows give all pairs; larger
    ones are taken deeper, a hash at a time, until they are small enough or DEEPEST is reached, and also give each
    row the NEIGHBOURS with the nearest sketches among the WINDOW rows on either side, which share the longest
    prefixes with it: copies of one text find that text. The members of such regions, and of those that
    touch the task's first or last row and may go on in another, are passed on as (region, node) for the exact rest.
    """

    def emit(rows: pd.DataFrame, edge: bool):
        n = len(rows)
        if n == 1 and not edge:
            return
        node, order = rows["node"].tolist(), rows["ord"].to_numpy(object)
        x1, x2 = rows["s1"].to_numpy().view(np.uint64), rows["s2"].to_numpy().view(np.uint64)
        pairs: set[tuple[int, int]] = set()

        def all_pairs(a: int, b: int) -> None:
            i, j = np.triu_indices(b - a, 1)
            keep = alike(x1[a + i], x2[a + i], x1[a + j], x2[a + j])
            pairs.update(zip((a + i[keep]).tolist(), (a + j[keep]).tolist()))

        def deeper(a: int, b: int, depth: int) -> None:
            if b - a <= REGION:
                all_pairs(a, b)
            elif depth < DEEPEST:
                keys = [o[: 1 + 4 * (depth + 1)] for o in order[a:b]]
                at = a
                for i in range(a + 1, b + 1):
                    if i == b or keys[i - a] != keys[at - a]:
                        if i - at > 1:
                            deeper(at, i, depth + 1)
                        at = i

        deeper(0, n, DEPTH)
        for a in range(0, n if n > REGION else 0, 256):
            b, lo, hi = min(n, a + 256), max(0, a - WINDOW), min(n, a + 256 + WINDOW)
            far = np.bitwise_count((x1[a:b, None] ^ x1[None, lo:hi]) | (x2[a:b, None] ^ x2[None, lo:hi])).astype(np.int32)
            far[np.arange(b - a), np.arange(a - lo, b - lo)] = 65
            ranked = far * (hi - lo) + np.arange(hi - lo, dtype=np.int32)
            best = np.argpartition(ranked, NEIGHBOURS - 1, axis=1)[:, :NEIGHBOURS]
            i, k = np.nonzero(np.take_along_axis(far, best, axis=1) <= SKETCH_LIMIT)
            j = best[i, k] + lo
            pairs.update(zip(np.minimum(i + a, j).tolist(), np.maximum(i + a, j).tolist()))
        out = [(min(node[i], node[j]), max(node[i], node[j]), None, None, 0) for i, j in pairs]
        if edge or n > REGION:
            region = order[0][: 1 + 4 * DEPTH]
            out += [(None, None, region, v, k) for v, k in zip(node, rows["n"].tolist())]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int32()))], names=["a", "b", "region", "node", "n"])

    held, first = None, True
    for batch in batches:
        rows = batch.to_pandas()
        rows = rows if held is None else pd.concat([held, rows], ignore_index=True)
        if not len(rows):
            continue
        keys = rows["ord"].map(lambda o: o[: 1 + 4 * DEPTH])
        starts = np.r_[0, np.flatnonzero((keys != keys.shift()).to_numpy()[1:]) + 1]
        held = rows.iloc[starts[-1] :].reset_index(drop=True)  # it may go on in the next batch
        sizes = np.diff(np.r_[starts, len(rows)])
        for i in np.flatnonzero(sizes[:-1] > 1) if not first else range(len(starts) - 1):
            if sizes[i] > 1 or first:
                yield from emit(rows.iloc[starts[i] : starts[i] + sizes[i]], first)
            first = False
    if held is not None:
        yield from emit(held, True)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose whole sets have a Jaccard similarity of at least percent / 100."""
    left, right = sets.select(F.col("node").alias("a"), F.col("set").alias("x")), sets.select(F.col("node").alias("b"), F.col("set").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    return pairs.select("a", "b").join(right, "b").join(left, "a").where(100 * both >= percent * (F.size("x") + F.size("y") - both)).select("a", "b")


def crossing(percent: int):
    """Links between a block of a region's rest and a block of its members, on whole sets; one for each node and other component is enough."""

    def run(rest: pa.Table, members: pa.Table) -> pa.Table:
        found: list[tuple[int, int]] = []
        if rest.num_rows and members.num_rows:
            column = members.column("set").combine_chunks()
            lens = column.value_lengths().to_numpy()
            shingles = column.flatten().to_numpy()
            owner = np.repeat(np.arange(len(lens)), lens)
            order = np.argsort(shingles, kind="stable")
            shingles, owner = shingles[order], owner[order]
            names, labels = members.column("node").to_pylist(), members.column("label").to_pylist()
            for node, label, s in zip(rest.column("node").to_pylist(), rest.column("label").to_pylist(), rest.column("set").combine_chunks()):
                s = s.values.to_numpy()
                lo, hi = np.searchsorted(shingles, s, "left"), np.searchsorted(shingles, s, "right")
                n = hi - lo
                at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
                both = np.bincount(owner[at], minlength=len(lens))
                seen = {label}
                for j in np.flatnonzero(100 * both >= percent * (len(s) + lens - both)):
                    if labels[j] not in seen:
                        seen.add(labels[j])
                        found.append((min(node, names[j]), max(node, names[j])))
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return run


def components(links: DataFrame, start: DataFrame | None = None) -> DataFrame:
    """node, label (the component's smallest node) for every node in links. start: labels known from some of the links.

    Labels take the smallest of their neighbours' and then their label's label, until none changes. Every step is a
    join of written tables, so that Spark splits a label with very many nodes; tables of earlier steps are deleted.
    """
    both = written(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    own = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low"))
    labels = own.select("node", F.least("node", "low").alias("label"))
    if start is not None:
        labels = labels.unionByName(start).groupBy("node").agg(F.min("label").alias("label"))
    labels = written(labels)
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("low")).withColumnRenamed("a", "node")
        step = written(labels.join(near, "node", "left").select("node", F.least("label", "low").alias("label"), F.col("label").alias("old")))
        roots = step.select(F.col("node").alias("label"), F.col("label").alias("root"))
        changed = Observation()
        jumped = written(step.join(roots, "label", "left").select("node", F.least("label", "root").alias("label"), "old").observe(changed, F.max((F.col("label") != F.col("old")).cast("int")).alias("any")))
        released(step, labels)
        labels = jumped
        if not changed.get["any"]:
            released(both)
            return labels.select("node", "label")


def groups(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """Every document's near-duplicate component.

    Documents with equal shingle sets are one node. A forest of TREES signature orders, range-partitioned so that a
    region of any size is spread over tasks, gives candidates (neighbours); 2-bit sketches drop the hopeless ones and
    the others are confirmed on whole sets. Regions too large for all pairs get an exact pass: members outside their
    region's largest component are held against every member of other components, in blocks.

    Returns doc_id, n_shingles, component_id (smallest doc_id reachable), kept (doc_id = component_id). Texts without
    words, null ones too, have no shingles and are alone. Rows that repeat a doc_id with another text are nodes of
    their own; a null doc_id is never the smallest unless all are null. Texts of any length are read whole, in parts
    of a batch. An empty table gives no rows; other columns, whatever their names, are left out.
    """
    named = related(docs, k, percent)
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return named.select("doc_id", F.col("n").cast("long").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def related(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Every row's doc_id, text_hash and n (its set's size), and of its component: component_id (the smallest doc_id)
    and the text_hash of one row that has it (kept_hash). Both are null without words."""
    rows = dealt(docs.select(F.col("doc_id").cast("long"), "text")).withColumn("text_hash", F.xxhash64("text"))
    found = written(rows.mapInArrow(lambda batches: signed(batches, k), "doc_id long, " + NODE))
    first_row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    own = found.where("n > 0").groupBy(F.col("node").alias("digest")).agg(F.min(first_row).alias("least"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("s1").alias("s1"), F.first("s2").alias("s2"))
    nodes = written(own.withColumn("node", F.monotonically_increasing_id()))  # the numbers stay as they are written

    turned = F.concat("sig", "sig")
    trees = [F.concat(F.unhex(F.lit(f"{t:02x}")), F.substring(turned, 1 + 4 * DEPTH * t, 4 * DEEPEST)) for t in range(TREES)]
    forest = nodes.select("node", "n", "s1", "s2", F.explode(F.array(*trees)).alias("ord"))
    met = written(forest.repartitionByRange("ord", "node").sortWithinPartitions("ord", "node").mapInArrow(neighbours, PAIR))
    first = written(met.where("region is null").select("a", "b").distinct())

    def sets_of(pairs: DataFrame) -> DataFrame:
        """Sets are made again from one text of each node in a pair; they are too large to keep for all. Rows are found
        by doc_id and text hash together, neither of which may be null here, so that a repeated one multiplies nothing."""
        asked = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        chosen = nodes.join(asked, "node", "left_semi").select("node", "digest", F.coalesce("least.doc_id", F.lit(NO_ID)).alias("id"), F.col("least.text_hash").alias("text_hash"))
        texts = rows.select("text", "text_hash", F.coalesce("doc_id", F.lit(NO_ID)).alias("id")).join(chosen, ["id", "text_hash"]).select("text", "node", "digest")
        once = texts.groupBy("node").agg(F.first("text").alias("text"), F.first("digest").alias("digest"))  # copies go before the shuffle
        return written(once.mapInArrow(lambda batches: of_node(batches, k), "node long, set array<long>"))

    sets = sets_of(first)
    links = written(confirmed(first, sets, percent))
    released(sets, first)
    labels = components(links)

    # the exact rest of large regions: members outside the largest component against those of other components, in blocks
    members = written(met.where("region is not null").select("region", "node", "n").distinct().join(labels, "node", "left").select("region", "node", "n", F.coalesce("label", "node").alias("label")))
    released(met)
    held = members.groupBy("region", "label").agg(F.count("*").alias("rows"), F.sum("n").alias("n"))
    main = held.groupBy("region").agg(F.max_by("label", F.struct("rows", "label")).alias("main"), F.count("*").alias("labels"), F.sum("n").alias("all")).where("labels > 1")
    blocks = lambda n, size: F.ceil(n / F.lit(float(size))).cast("int")
    split = main.select("region", "main", blocks(F.col("all"), MEMBER_BLOCK).alias("mb"))
    rest = members.join(split, "region").where("label != main").select("region", "node", "n", "label", "mb")
    rest = rest.join(rest.groupBy("region").agg(blocks(F.sum("n"), REST_BLOCK).alias("rb")), "region")
    sizes = written(rest.select("region", "mb", "rb").distinct())
    if sizes.limit(1).count():
        asked = members.join(sizes, "region").select("region", "node", "label", "mb", "rb")
        sets = sets_of(asked.select(F.col("node").alias("a"), F.col("node").alias("b")))
        filled = written(asked.join(sets, "node"))
        mixed_up = F.xxhash64("node")
        numbered = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        left = filled.join(main.select("region", "main"), "region").where("label != main").select("region", "node", "label", "set", F.pmod(mixed_up, F.col("rb")).cast("int").alias("r"), numbered("mb").alias("m"))
        right = filled.select(*(F.col(c).alias(c) for c in ("region", "node", "label", "set")), F.pmod(mixed_up, F.col("mb")).cast("int").alias("m"), numbered("rb").alias("r"))
        more = written(left.groupBy("region", "r", "m").cogroup(right.groupBy("region", "r", "m")).applyInArrow(crossing(percent), "a long, b long").distinct())
        released(sets, filled)
        labels = components(links.unionByName(more), labels)

    least = nodes.select("digest", "node", "least").join(labels, "node", "left").select("digest", "least", F.coalesce("label", "node").alias("label"))
    smallest = least.groupBy("label").agg(F.min("least").alias("least"))
    named = written(least.select("digest", "label").join(smallest, "label").select(F.col("digest").alias("node"), F.col("least.doc_id").alias("component_id"), F.col("least.text_hash").alias("kept_hash")))
    released(links, members, sizes, nodes)
    return found.select("doc_id", "text_hash", "n", "node").join(named, "node", "left").drop("node")


def of_node(batches, k: int):
    """Sets of the texts, one for each node."""
    for batch in batches:
        for texts, rows in slices(batch, SLICE_BYTES):
            kept = list(shingle_sets(texts, k))
            at = np.cumsum([0, *map(len, kept)])
            values = np.concatenate(kept).view(np.int64) if kept else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([rows.column("node"), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values))], names=["node", "set"])


def deduplicated(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each near-duplicate component: one of the smallest doc_id's, or, where no row of the
    component has a doc_id, one of its texts. Columns unchanged, whatever their names. Rows without words (null, empty
    and blank texts) are alone and all stay; repeated rows of a component are one; an empty table gives no rows."""
    named = related(docs, k, percent).where("n > 0")
    mark = f"_kept_{uuid.uuid4().hex}"
    key = lambda i, h: F.struct(F.coalesce(i.cast("long"), F.lit(NO_ID)).alias("id"), h.alias("hash"))
    chosen = named.select(key(F.col("component_id"), F.col("kept_hash")).alias(mark)).distinct()
    rows = docs.withColumn(mark, key(docs["doc_id"], F.xxhash64(docs["text"])))
    one = rows.join(chosen, mark, "left_semi").dropDuplicates([mark])
    # words are runs of anything but ASCII white space
    return one.unionByName(rows.where(~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False)))).select(*docs.columns)


def op8_neardup(spark, sf_dir: str) -> DataFrame:
    return groups(table(spark, sf_dir, "documents"), k=4, percent=80)
