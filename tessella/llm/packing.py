"""Packing token sequences by bulk-synchronous best fit."""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left, insort
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from .common import dealt, fresh_path, released, running, slices, table, written

CAPACITY = 2048
TOKENIZER = "word_bpe_49k.json"
END_ID = 0
SMALL = 64  # the last class of lengths
SLICE_BYTES = 6 << 20
CACHED_WORDS = 300_000


class Words:
    """Token ids of whole texts, word by word.

    The tokenizer joins no text across white space and treats each piece between white space alone (its normalizer
    composes no character with a space before it, and its pattern drops white space), so a word's ids are the same in
    any text. Arrow splits and numbers a slice's words; only ASCII white space separates words here, a part of what
    the tokenizer separates. A word is looked up as its body and the marks at its end: after an ASCII letter, which
    the normalizer leaves a letter, the pattern takes marks as a piece of their own; words that end in another letter
    and marks are looked up whole. The tokenizer lower-cases, so an ASCII body is looked up in lower case. Each
    different body of a slice is encoded once. A worker keeps those that a slice holds more than once, up to
    CACHED_WORDS: most bodies are met a single time, and a table of them all would take more memory than time it saves.
    """

    MARKS = "!\"#$%&'()*+,-./:;=?@[\\]^_`{}~"

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, int] = {"": 0}
        self.begin, self.size, self.flat = np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(0, np.int32)

    def learn(self, new: list[str]) -> None:
        found = [e.ids for a in range(0, len(new), 20_000) for e in self.tokenizer.encode_batch_fast(new[a : a + 20_000], add_special_tokens=False)]
        size = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter(chain.from_iterable(found), np.int32, int(size.sum()))
        self.known.update(zip(new, range(len(self.begin), len(self.begin) + len(new))))
        self.begin = np.concatenate([self.begin, len(self.flat) + np.cumsum(size) - size])
        self.size, self.flat = np.concatenate([self.size, size]), np.concatenate([self.flat, flat])

    def unique(self, words: list[str], times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of different words one after the other, and how many each has. times: how often each is met."""
        known, marks = self.known, self.MARKS
        first, second = list(map(known.get, words)), np.zeros(len(words), np.int64)
        unknown = [i for i, x in enumerate(first) if x is None]
        bodies, ends = [], []
        for i in unknown:
            word = words[i]
            body = word.rstrip(marks)
            if not body or not (body[-1].isascii() and body[-1].isalpha()):
                body = word
            ends.append(word[len(body) :])
            bodies.append(body.lower() if body.isascii() and "<" not in body else body)
        room = len(known) < CACHED_WORDS
        again = {*ends, *(b for b, n in zip(bodies, times[unknown].tolist()) if n > 1)} - known.keys() if unknown and room else set()
        if again:
            self.learn(list(again))
        before, once = (len(self.begin), len(self.flat)), list({*bodies, *ends} - known.keys()) if unknown else []
        if once:
            self.learn(once)
        for i, body in zip(unknown, map(known.get, bodies)):
            first[i] = body
        second[unknown] = list(map(known.get, ends))
        segments = np.stack([np.array(first, np.int64), second], axis=1).ravel()
        ids = self.flat[ragged(self.begin[segments], self.size[segments])]
        sizes = self.size[segments].reshape(-1, 2).sum(axis=1)
        for x in once:
            del known[x]
        if once:
            self.begin, self.size, self.flat = (x[:n].copy() for x, n in ((self.begin, before[0]), (self.size, before[0]), (self.flat, before[1])))
        return ids, sizes

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and each text's first place in them (with the end)."""
        split = pc.ascii_split_whitespace(texts)
        coded = split.flatten().dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False)
        flat, lens = self.unique(coded.dictionary.to_pylist(), np.bincount(codes, minlength=len(coded.dictionary)))
        n = lens[codes]
        ids = flat[ragged((np.cumsum(lens) - lens)[codes], n)]
        return ids, np.r_[0, np.cumsum(n)][split.offsets.to_numpy(zero_copy_only=False) - split.offsets[0].as_py()]


def ragged(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Places of all segments (begin, size) one after the other."""
    place = np.repeat((begin - (np.cumsum(size) - size)).astype(np.int32), size)
    place += np.arange(len(place), dtype=np.int32)
    return place


_words: dict[str, Words] = {}


def pieces_of(batches, path: str, capacity: int, end_id: int):
    words = _words.get(path) or _words.setdefault(path, Words(path))
    for batch in batches:
        for texts, own_rows in slices(batch, SLICE_BYTES):
            ids, at = words.encode(texts)
            rows, piece, start, length, crc = [], [], [], [], []
            for i in range(len(texts)):
                own = np.append(ids[at[i] : at[i + 1]], end_id).astype("<u4")
                for k in range(0, len(own), capacity):
                    part = own[k : k + capacity]
                    rows.append(i)
                    piece.append(k // capacity)
                    start.append(k)
                    length.append(len(part))
                    crc.append(zlib.crc32(part.tobytes()))
            yield pa.RecordBatch.from_arrays([own_rows.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Token pieces of every document: whole documents of at most `capacity` ids, longer ones cut into pieces of it."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    return dealt(docs.select(F.col("doc_id").cast("long"), "text")).mapInArrow(lambda batches: pieces_of(batches, path, capacity, end_id), schema)


SWEPT = "item long, length long, seq long, slot long, gap long, part long, rank long"


def swept(batches):
    """Matches a task's rows, sorted by falling size with slots before documents: every document takes the smallest
    slot before it that is still free, as closing brackets take opening ones.

    A walk that goes up at a slot and down at a document crosses each level in turns, so a document's slot is the row
    before it among those that cross its level. What finds no partner within the task is numbered in order: documents
    that need slots of earlier tasks, then slots left for later ones.
    """
    got = list(batches)
    rows = pa.Table.from_batches(got).combine_chunks() if got else None
    if rows is None or not rows.num_rows:
        return
    is_slot = rows.column("item").is_null().to_numpy()
    level = np.cumsum(np.where(is_slot, 1, -1)) - is_slot
    order = np.argsort(level, kind="stable")
    pair = (level[order[1:]] == level[order[:-1]]) & ~is_slot[order[1:]]
    doc, slot = order[1:][pair], order[:-1][pair]
    free = np.ones(len(level), bool)
    free[doc] = free[slot] = False
    for d, s in ((doc, slot), (np.flatnonzero(free & ~is_slot), None), (None, np.flatnonzero(free & is_slot))):
        n, own = len(s if d is None else d), {}
        for names, at in ((("item", "size"), d), (("seq", "slot", "gap"), s)):
            own |= {c: pa.nulls(n, pa.int64()) if at is None else rows.column(c).take(pa.array(at)).combine_chunks() for c in names}
        alone = d is None or s is None
        part = [pa.array(np.full(n, TaskContext.get().partitionId())), pa.array(np.arange(n))] if alone else [pa.nulls(n, pa.int64())] * 2
        yield pa.RecordBatch.from_arrays([*own.values(), *part], names=["item", "length", "seq", "slot", "gap", "part", "rank"])


def spans(ends: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """Which ranges' slots the documents of later ranges take. ends: range, its documents and slots without a partner.

    Returns (range, first document, end, range of the slots, last slot): the documents from the first to before the
    end take the slots from the last one downwards, the smallest first."""
    open_slots: list[list[int]] = []
    out = []
    for part, docs, slots in sorted(ends):
        at = 0
        while at < docs and open_slots:
            other, held = open_slots[-1]
            n = min(docs - at, held)
            out.append((part, at, at + n, other, held - 1))
            at += n
            open_slots[-1][1] -= n
            if n == held:
                open_slots.pop()
        if slots:
            open_slots.append([part, slots])
    return out


def matched(todo: DataFrame, gaps: DataFrame, low: int, high: int, spent: list[DataFrame] | None = None) -> tuple[DataFrame, DataFrame, int]:
    """One superstep: documents (item, length from low to high) take the smallest gaps (seq, gap) that hold them.

    A gap offers as many slots of `high` as it holds, and what is over as a slot of its own. Slots and documents are
    range-sorted together and swept (swept). Documents that found no slot in their range take those of earlier ranges
    by rank (spans: a row or two for each range). Returns what was taken (item, length, seq, slot, gap), the documents
    left, and their number; the written table that both are read from is added to `spent`."""
    spark = todo.sparkSession
    each = F.floor(F.col("gap") / high)
    slots = gaps.where(F.col("gap") >= low).select("seq", "gap", F.explode(F.sequence(F.lit(0).cast("long"), each)).alias("slot"))
    slots = slots.withColumn("size", F.when(F.col("slot") < each, F.lit(high)).otherwise(F.col("gap") % high).cast("long")).where(F.col("size") >= low)
    empty = F.lit(None).cast("long")
    rows = todo.select("item", F.col("length").alias("size"), *(empty.alias(c) for c in ("seq", "slot", "gap"))).unionByName(slots.withColumn("item", empty))
    keys = [F.col("size").desc(), F.col("item").asc_nulls_first(), F.col("gap"), F.col("seq"), F.col("slot")]
    met = written(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(swept, SWEPT))
    if spent is not None:
        spent.append(met)
    alone = met.where("part is not null")
    ends = alone.groupBy("part").agg(F.count("item").alias("docs"), F.count("seq").alias("slots")).collect()  # a row for each range
    links = spans([(r["part"], r["docs"], r["slots"]) for r in ends])
    taken, left = met.where("part is null").select("item", "length", "seq", "slot", "gap"), alone.where("item is not null")
    if links:
        link = F.broadcast(spark.createDataFrame(links, "part long, first long, end long, other long, last long"))
        found = left.select("item", "length", "part", "rank").join(link, "part").where("rank >= first and rank < end")
        found = found.select("item", "length", F.col("other").alias("part"), (F.col("last") - F.col("rank") + F.col("first")).alias("rank"))
        taken = taken.unionByName(found.join(alone.where("item is null").select("part", "rank", "seq", "slot", "gap"), ["part", "rank"]).drop("part", "rank"))
        upto = F.broadcast(spark.createDataFrame(list({part: end for part, _, end, _, _ in links}.items()), "part long, upto long"))
        left = left.join(upto, "part", "left").where(F.col("rank") >= F.coalesce("upto", F.lit(0)))
    return taken, left.select("item", "length"), sum(r["docs"] for r in ends) - sum(end - first for _, first, end, _, _ in links)


def filled(batches, capacity: int, base: int):
    """Best fit of a few rows (item, length) in new sequences from `base`, longest first."""
    got = list(batches)
    rows = sorted((-n, i) for b in got for i, n in zip(b.column("item").to_pylist(), b.column("length").to_pylist()))
    gaps: list[tuple[int, int, int]] = []  # gap, sequence, rows in it
    out, end = [], base
    for fall, item in rows:
        at = bisect_left(gaps, (-fall, -1, 0))
        if at == len(gaps):
            gap, seq, n, end = capacity, end, 0, end + 1
        else:
            gap, seq, n = gaps.pop(at)
        out.append((item, -fall, seq, n))
        insort(gaps, (gap + fall, seq, n + 1))
    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)] if out else [pa.array([], pa.int64())] * 4, names=["item", "length", "seq", "slot"])


def opened(todo: DataFrame, capacity: int, used: int) -> tuple[DataFrame, int]:
    """Documents without a gap in new sequences, numbered from `used`: by falling length, as many in one as its
    documents all fit. What doesn't fill a sequence so, fewer documents of each number that fits than that number, is
    filled up by one task. Returns item, length, seq, slot, and the number of sequences in use."""
    fits = F.floor(F.lit(capacity) / F.col("length"))
    ranked = running(todo.select("item", "length", F.negative("length").alias("fall"), fits.alias("fits")), ["fall", "item"], {"index": None})
    begins, rows = ranked.groupBy("fits").agg(F.min("index").alias("begin"), F.count("*").alias("n")).orderBy("fits").collect(), []  # capacity rows at most
    for r in begins:
        rows.append((r["fits"], r["begin"], used, r["n"] // r["fits"] * r["fits"]))
        used += r["n"] // r["fits"]
    rank = F.col("index") - F.col("begin")
    seated = ranked.join(F.broadcast(todo.sparkSession.createDataFrame(rows, "fits long, begin long, base long, whole long")), "fits")
    full = seated.where(rank < F.col("whole")).select("item", "length", (F.col("base") + F.floor(rank / F.col("fits"))).alias("seq"), (rank % F.col("fits")).alias("slot"))
    if all(r["n"] == whole for r, (*_, whole) in zip(begins, rows)):
        return full, used
    seen = Observation()
    rest = seated.where(rank >= F.col("whole")).select("item", "length").repartition(1).mapInArrow(lambda batches: filled(batches, capacity, used), "item long, length long, seq long, slot long")
    rest = written(rest.observe(seen, F.max("seq").alias("last")))
    return full.unionByName(rest), seen.get["last"] + 1


def best_fit(items: DataFrame, counts: dict[int, int], capacity: int) -> DataFrame:
    """Bulk-synchronous best fit of items (item, length): returns item, sequence_id, offset.

    Lengths go by falling classes, each half as long as the one before. Within a class, supersteps (matched) run until
    all its documents are placed or hardly a gap holds one; every superstep updates the gaps for the next. Documents left
    open new sequences (opened), whose gaps serve the classes that follow. Every state is a table, and so are the
    places that a superstep gives, so that no plan grows with their number: the driver holds counts of lengths (at most
    `capacity`) and a row or two for each range.
    """
    spark, empty = items.sparkSession, "item long, sequence_id long, offset long, length long"
    base, used, steps, most, high = fresh_path(spark), 0, 0, 0, capacity
    written(spark.createDataFrame([], empty), f"{base}/step=0")
    gaps = written(spark.createDataFrame([], "seq long, gap long"))

    def settle(rows: DataFrame, gaps: DataFrame) -> tuple[DataFrame, int]:
        """Writes the places of rows (item, length, seq, slot, gap); returns the gaps that they leave, and the largest of these."""
        nonlocal steps
        steps += 1
        before = F.sum("length").over(Window.partitionBy("seq").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1))  # capacity rows at most
        places = rows.select("item", F.col("seq").alias("sequence_id"), (F.lit(capacity) - F.col("gap") + F.coalesce(before, F.lit(0))).cast("long").alias("offset"), "length")
        step = written(places, f"{base}/step={steps}")
        rest = gaps.unionByName(step.select(F.col("sequence_id").alias("seq"), F.negative("length").alias("gap"))).groupBy("seq").agg(F.sum("gap").alias("gap")).where("gap > 0")
        seen = Observation()
        return written(rest.observe(seen, F.max("gap").alias("most"))), seen.get["most"] or 0

    while high:
        low = high // 2 + 1 if high > SMALL else 1
        own = [x for x in counts if low <= x <= high]
        left, spent = sum(counts[x] for x in own), []
        todo = items.where(F.col("length").between(low, high))
        high = low - 1
        while left and most >= min(own):
            taken, todo, n = matched(todo, gaps, min(own), max(own), spent)
            spent.append(gaps)
            gaps, most = settle(taken, gaps)
            slow, left = n > 0.9 * left, n
            if slow:
                break
        if left:
            rows, end = opened(todo, capacity, used)
            fresh = spark.range(used, end).select(F.col("id").alias("seq"), F.lit(capacity).cast("long").alias("gap"))
            spent.append(gaps)
            gaps, most = settle(rows.withColumn("gap", F.lit(capacity)), gaps.unionByName(fresh))
            used = end
        released(*spent)
    released(gaps)
    return spark.read.schema(empty).parquet(base).select("item", "sequence_id", "offset")


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Packs all documents into sequences of at most `capacity` tokens.

    Pieces are numbered by a distributed range sort, placed by supersteps of best fit (best_fit), and joined with
    their places by number.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id (from 0, gapless), offset. Null text counts as empty:
    a document of the end id alone. Very long texts are cut into pieces of `capacity`. Repeated rows and null doc_ids
    are packed as documents of their own; ties of length go by doc_id, piece and digest; an empty table gives no rows;
    other columns, whatever their names, are left out.
    """
    cut = written(pieces(docs, path, capacity, end_id))
    counts = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}  # at most `capacity` rows
    ranked = written(running(cut, ["length", "doc_id", "piece", "ids_crc32"], {"item": None}))
    released(cut)
    placed = best_fit(ranked.select("item", "length"), counts, capacity)
    return ranked.join(placed, "item").select(*cut.columns, "sequence_id", "offset")


def op3_pack(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))
