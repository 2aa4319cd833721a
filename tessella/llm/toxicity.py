"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index, calibrated votes."""

from __future__ import annotations

import pickle
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dealt, slices, table, written

EXAMPLES = 2_000  # labelled documents learned from, of each class; the only bound on what is learned
NEAREST = 50
EVIDENCE = 3
ASIDE = 5  # one in so many examples is held against an index of the others, to calibrate the votes
BLOCK = 64  # examples in an index block
COMMON = 512  # words held as dense columns of a block
FIRST = 4  # blocks that a text meets before its bounds are proved
TOGETHER, POSTINGS = 128, 500_000  # texts, and postings, that are added up at once
PRIOR, SAME = 2.0, 0.001
STEADY = 4.0  # pseudo-examples that hold the calibration to the votes as they are
SLICE_BYTES = 4 << 20
NO_LETTERS = r"[^\pL]+"


def term_counts(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """The different words of texts and, for each text and word in it: the text's place, the word's and its count.
    Words are runs of letters in lower case. Null counts as empty."""
    split = pc.split_pattern_regex(pc.utf8_lower(texts.fill_null("").cast(pa.string())), pattern=NO_LETTERS)
    coded = split.flatten().dictionary_encode()
    words, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    doc = np.repeat(np.arange(len(texts)), np.diff(split.offsets.to_numpy()))
    if "" in words:
        some = codes != words.index("")
        doc, codes = doc[some], codes[some]
    key, count = np.unique(doc * max(1, len(words)) + codes, return_counts=True)
    return words, key // max(1, len(words)), key % max(1, len(words)), count


def ragged(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Places of all segments (begin, size) one after the other."""
    return np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())


class Index:
    """Unit TF-IDF vectors of the examples over all their words, inverted. Nothing is left out of a vector.

    Examples lie in blocks of BLOCK, ordered by their heaviest word so that blocks differ. Of the COMMON most frequent
    words a block holds dense columns and each column's largest weight; other words are postings. A text's bound for a
    block is the sum of its weights times the block's largest, in which postings count exactly.
    """

    def __init__(self, words: list[str], weight: np.ndarray, unseen: float, docs: np.ndarray, labels: np.ndarray, begin: np.ndarray, ids: np.ndarray, counts: np.ndarray):
        """weight: of each word; unseen: of a word that no example holds; ids and counts of example i from begin[i]."""
        self.words, self.weight, self.unseen = "\n".join(words), weight, unseen
        rows = np.repeat(np.arange(len(docs)), np.diff(begin))
        w = (1 + np.log(counts)) * weight[ids]
        w = w / np.sqrt(np.bincount(rows, w * w, len(docs)))[rows]
        heavy = np.zeros(len(docs), np.int64)
        by = np.lexsort((ids, w, rows))  # each example's heaviest word comes last
        heavy[rows[by]] = ids[by]
        order = np.lexsort((docs, heavy))
        size = np.diff(begin)[order]
        at = ragged(begin[:-1][order], size)
        self.docs, self.labels = docs[order], labels[order].astype(float)
        self.begin, self.ids, self.w = np.r_[0, np.cumsum(size)], ids[at].astype(np.int32), w[at]
        self.met = self.asked = 0
        self.ready = False

    def __getstate__(self):
        return {k: self.__dict__[k] for k in ("words", "weight", "unseen", "docs", "labels", "begin", "ids", "w")} | {"ready": False, "met": 0, "asked": 0}

    def prepare(self) -> None:
        """What is built where it is used: the word table, blocks of dense columns with their maxima, and postings."""
        self.place = {t: i for i, t in enumerate(self.words.split("\n"))} if self.words else {}
        v, n = len(self.weight), len(self.docs)
        self.blocks = -(-n // BLOCK)
        rows = np.repeat(np.arange(n, dtype=np.int32), np.diff(self.begin))
        held = np.bincount(self.ids, minlength=v)
        top = np.argsort(-held, kind="stable")[:COMMON]
        self.column = np.full(v, -1, np.int32)
        self.column[top] = np.arange(len(top))
        common = self.column[self.ids] >= 0
        self.dense = np.zeros((len(top), self.blocks * BLOCK))
        self.dense[self.column[self.ids[common]], rows[common]] = self.w[common]
        self.most = self.dense.reshape(len(top), self.blocks, BLOCK).max(axis=2)
        order = np.argsort(self.ids[~common], kind="stable")
        self.held, self.posted = rows[~common][order], self.w[~common][order]
        self.sizes = np.where(self.column < 0, held, 0)
        self.at = np.cumsum(self.sizes) - self.sizes
        self.ready = True

    def vectors(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Unit vectors of texts: the text's place, the word's and the weight, of words that examples hold. Others add to a text's length only."""
        if not self.ready:
            self.prepare()
        words, doc, code, count = term_counts(texts)
        known = np.fromiter((self.place.get(w, -1) for w in words), np.int64, len(words))[code] if words else code
        w = (1 + np.log(count)) * np.where(known >= 0, self.weight[known] if len(self.weight) else 0.0, self.unseen)
        w = w / np.sqrt(np.bincount(doc, w * w, len(texts)))[doc]
        return doc[known >= 0], known[known >= 0], w[known >= 0]

    def nearest(self, texts: pa.Array, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each text the places and cosines of its k nearest examples, exactly; ties go to the earlier example.
        Examples that share no word with a text are none."""
        doc, ids, w = self.vectors(texts)
        if not self.blocks:
            return [(np.zeros(0, np.int64), np.zeros(0))] * len(texts)
        first = np.searchsorted(doc, np.arange(len(texts) + 1))
        load = np.r_[0, np.cumsum(self.sizes[ids])][first]
        out, a = [], 0
        while a < len(texts):
            b = max(a + 1, min(a + TOGETHER, int(np.searchsorted(load, load[a] + POSTINGS, "right")) - 1, len(texts)))
            own = slice(first[a], first[b])
            out += self.best(b - a, doc[own] - a, ids[own], w[own], k)
            a = b
        return out

    def best(self, n: int, doc: np.ndarray, ids: np.ndarray, w: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        m = self.blocks * BLOCK
        common = self.column[ids] >= 0
        asked = np.zeros((n, len(self.most)))
        asked[doc[common], self.column[ids[common]]] = w[common]
        lens = self.sizes[ids[~common]]
        at = ragged(self.at[ids[~common]], lens)
        total = np.bincount(np.repeat(doc[~common] * m, lens) + self.held[at], np.repeat(w[~common], lens) * self.posted[at], n * m).reshape(n, m)
        bound = total.reshape(n, self.blocks, BLOCK).max(axis=2) + asked @ self.most
        scores, done = np.zeros((n, m)), np.zeros((n, self.blocks), bool)
        todo = np.zeros_like(done)
        np.put_along_axis(todo, np.argpartition(-bound, min(FIRST, self.blocks) - 1, axis=1)[:, :FIRST], True, axis=1)
        for _ in range(2):
            for block in np.flatnonzero(todo.any(axis=0)):
                rows, own = np.flatnonzero(todo[:, block]), slice(block * BLOCK, block * BLOCK + BLOCK)
                scores[rows, own] = total[rows, own] + asked[rows] @ self.dense[:, own]
            done |= todo
            least = np.partition(scores, m - k, axis=1)[:, m - k] if k < m else np.zeros(n)
            # a block whose bound is below the k-th best so far can't hold any of the k best
            todo = ~done & (bound > 0) & (bound >= least[:, None] - 1e-9)
        self.met, self.asked = self.met + int(done.sum()), self.asked + done.size
        out = []
        for row, low in zip(scores, least):
            some = np.flatnonzero(row >= max(low - 1e-11, 1e-12))
            exact = np.round(row[some], 11)
            order = np.lexsort((some, -exact))[:k]
            out.append((some[order], exact[order]))
        return out


def odds(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-9, 1 - 1e-9)
    return np.log(p / (1 - p))


def calibrated(votes: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    """Slope and intercept that make votes' log odds fit the labels (Platt), held to 1 and 0 by STEADY pseudo-examples."""
    x, (a, b) = odds(votes), (1.0, 0.0)
    for _ in range(50):
        p = 1 / (1 + np.exp(-(a * x + b)))
        g, h = weights * (p - labels), weights * p * (1 - p)
        slope = np.array([(g * x).sum() + STEADY * (a - 1), g.sum() + STEADY * b])
        bend = np.array([[(h * x * x).sum() + STEADY, (h * x).sum()], [(h * x).sum(), h.sum() + STEADY]])
        step = np.linalg.solve(bend, slope)
        step *= min(1.0, 2.0 / max(1e-12, float(np.abs(step).max())))
        a, b = a - float(step[0]), b - float(step[1])
        if np.abs(step).max() < 1e-9:
            break
    return max(a, 0.1), b  # a nearer toxic example never lowers a score


class Model:
    """The index, what a vote of each class counts, the base rate, and the calibration."""

    def __init__(self, index: Index, shares: tuple[float, float], base: float):
        self.index, self.shares, self.base, self.fit = index, np.array(shares), base, (1.0, 0.0)

    def vote(self, at: np.ndarray, cosines: np.ndarray) -> float:
        """Votes weighted by the odds of their cosines, shrunk to the base rate: a copy decides, far texts say little."""
        labels = self.index.labels[at]
        weight = cosines / (SAME + np.maximum(0.0, 1 - cosines)) * self.shares[labels.astype(int)]
        return float(((weight * labels).sum() + PRIOR * self.base) / (weight.sum() + PRIOR))

    def scores(self, texts: pa.Array) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """Each text's calibrated score and its nearest examples with their cosines."""
        near = self.index.nearest(texts, NEAREST)
        a, b = self.fit
        return 1 / (1 + np.exp(-(a * odds(np.array([self.vote(*x) for x in near])) + b))), near


class Packed:
    """A model as bytes: the driver passes it on as it came from the task that fitted it, each worker reads it once."""

    def __init__(self, data: bytes):
        self.data = data

    @cached_property
    def model(self) -> Model:
        data, self.data = self.data, b""
        return pickle.loads(data)


def listed(batches):
    """Words and counts of a task's texts, one row for each text."""
    for batch in batches:
        for texts, rows in slices(batch, SLICE_BYTES):
            words, doc, code, count = term_counts(texts)
            at = pa.array(np.searchsorted(doc, np.arange(len(texts) + 1)), pa.int32())
            names = pa.array(words, pa.string()).take(pa.array(code))
            columns = [rows.column("doc_id"), rows.column("toxic").cast(pa.int32()), rows.column("aside"), pa.ListArray.from_arrays(at, names), pa.ListArray.from_arrays(at, pa.array(count, pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "toxic", "aside", "words", "counts"])


def word_documents(batches, words):
    """For each indexed word, how many of a task's documents hold it."""
    place = {t: i for i, t in enumerate(words.value.split("\n"))} if words.value else {}
    df = np.zeros(len(place) + 1, np.int64)  # the last for words that aren't indexed
    for batch in batches:
        for texts, _ in slices(batch, SLICE_BYTES):
            own, _, code, _ = term_counts(texts)
            df += np.bincount(np.fromiter((place.get(w, len(place)) for w in own), np.int64, len(own))[code], minlength=len(df))
    some = np.flatnonzero(df[:-1])
    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(df[some])], names=["id", "n"])


def marking(toxic: np.ndarray, clean: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """How many deviations a word's share of toxic examples lies from its share of clean ones (the root of chi-square)."""
    seen, n = toxic + clean, n1 + n0
    spread = seen * (n - seen) * max(1, n1 * n0)
    return np.abs(toxic * (n0 - clean) - clean * (n1 - toxic)) * np.sqrt(n / np.maximum(1.0, spread.astype(float)))


def weighed(labelled: dict[int, int], drawn: dict[int, int]) -> tuple[float, float]:
    """What an example of each class counts: the inverse of its class's sampling rate, 1 in the mean of all drawn."""
    inverse = [labelled[y] / drawn[y] if drawn.get(y) else 1.0 for y in (0, 1)]
    mean = sum(inverse[y] * n for y, n in drawn.items()) / max(1, sum(drawn.values())) or 1.0
    return inverse[0] / mean, inverse[1] / mean


def learned(docs: DataFrame, labels: DataFrame, training, examples: int = EXAMPLES) -> Packed:
    """A model from labelled rows on which `training` (of doc_id) holds, at most `examples` of each class (by hash, so
    reruns agree).

    All are indexed over all their words; one in ASIDE, held against an index of the others, calibrates the votes. A
    word's weight is (1 + log count) * IDF * (1 + deviations): IDF is counted over all of docs, deviations (marking) are
    how surely the word tells the classes of the indexed examples apart, 0 for one that doesn't. Votes and base rate are weighed by the inverse of
    each class's sampling rate, so that they follow the ratio of all labels whatever the bound. One task fits the
    sample; the driver holds the words of 2 * examples texts at most, and the model as bytes.
    """
    spark = docs.sparkSession
    marked = labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(training(F.col("doc_id")))
    order = F.xxhash64("doc_id", F.lit(11))
    some = [marked.where(F.col("toxic") == y).orderBy(order, "doc_id").limit(examples) for y in (0, 1)]
    drawn = written(some[0].unionByName(some[1]))  # 2 * examples rows at most
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(drawn), "doc_id")
    # a drawn doc_id may repeat in docs, with one text or several: equal texts count once, and the bound holds for all
    once = texts.groupBy(F.xxhash64("text").alias("_h")).agg(F.min("doc_id").alias("doc_id"), F.first("text").alias("text"), F.max("toxic").alias("toxic"))
    sample = once.orderBy("_h").limit(2 * examples).select("doc_id", "text", "toxic", (F.pmod(F.xxhash64("doc_id", F.lit(12)), F.lit(ASIDE)) == 0).alias("aside"))
    rows = written(sample.mapInArrow(listed, "doc_id long, toxic int, aside boolean, words array<string>, counts array<int>"))

    names = rows.select(F.explode("words").alias("word")).distinct().orderBy("word").toArrow().column("word").to_pylist()
    place = spark.sparkContext.broadcast("\n".join(names))
    held = dealt(docs.select("text")).mapInArrow(lambda batches: word_documents(batches, place), "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(len(names))
    df[held.column("id").to_numpy()] = held.column("n").to_numpy()
    counts = spark.sparkContext.broadcast(df)
    n = docs.count()
    shares = weighed({r["toxic"]: r["count"] for r in marked.groupBy("toxic").count().collect()}, {r["toxic"]: r["count"] for r in drawn.groupBy("toxic").count().collect()})
    # one task fits the bounded sample, so that the driver holds no more than its bytes
    made = rows.repartition(1).mapInArrow(lambda batches: fitted(batches, place, counts, n, shares), "model binary").first()
    place.destroy()
    counts.destroy()
    none = Model(Index([], np.zeros(0), 1.0, *[np.zeros(0, np.int64)] * 2, np.zeros(1, np.int64), *[np.zeros(0, np.int64)] * 2), shares, 0.25)
    return Packed(made["model"] if made else pickle.dumps(none))


def fitted(batches, place, documents, n: int, shares: tuple[float, float]):
    """The model of the examples in a task's rows (words and counts), as bytes. documents: how many of all n documents
    hold each word."""
    batches = list(batches)
    if not batches:
        return
    names, df = place.value.split("\n") if place.value else [], documents.value
    found = pa.Table.from_batches(batches).sort_by([("doc_id", "ascending"), ("toxic", "ascending")]).combine_chunks()
    toxic, aside = (found.column(c).to_numpy().astype(bool) for c in ("toxic", "aside"))
    ids = pc.index_in(pc.list_flatten(found.column("words")), pa.array(names, pa.string())).to_numpy().astype(np.int64)
    counts = pc.list_flatten(found.column("counts")).to_numpy()
    begin = np.r_[0, np.cumsum(pc.list_value_length(found.column("words")).to_numpy())].astype(np.int64)

    def model(some: np.ndarray) -> Model:
        """Of the examples numbered in some."""
        size = np.diff(begin)[some]
        at = ragged(begin[some], size)
        y = toxic[some]
        n1, n0 = int(y.sum()), int((~y).sum())
        by = [np.bincount(ids[at][np.repeat(y == c, size)], minlength=len(names)) for c in (True, False)]
        known = by[0] + by[1] > 0
        weight = np.where(known, np.log((1 + n) / (0.5 + df)) * (1 + marking(*by, n1, n0)), np.log((1 + n) / 1.5))
        index = Index(names, weight, float(np.log((1 + n) / 1.5)), found.column("doc_id").to_numpy()[some], y, np.r_[0, np.cumsum(size)], ids[at], counts[at])
        return Model(index, shares, (n1 * shares[1] + 0.5) / (n1 * shares[1] + n0 * shares[0] + 2.0))

    left, fit = np.flatnonzero(aside), (1.0, 0.0)
    if 0 < len(left) < len(toxic):
        trial = model(np.flatnonzero(~aside))
        rows, times = (pc.list_flatten(found.column(c).take(pa.array(left))).to_pylist() for c in ("words", "counts"))
        cuts = np.r_[0, np.cumsum(np.diff(begin)[left])]
        texts = [" ".join(x for x, c in zip(rows[a:b], times[a:b]) for _ in range(c)) for a, b in zip(cuts[:-1], cuts[1:])]
        votes = np.array([trial.vote(*x) for x in trial.index.nearest(pa.array(texts, pa.string()), NEAREST)])
        fit = calibrated(votes, toxic[left].astype(float), np.array(shares)[toxic[left].astype(int)])
    whole = model(np.arange(len(toxic)))
    whole.fit = fit
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(whole)], pa.binary())], names=["model"])


def judged(batches, model):
    """Slices of a task's rows with the scores and nearest examples of their texts."""
    for batch in batches:
        for texts, rows in slices(batch, SLICE_BYTES):
            yield rows, *model.value.model.scores(texts)


def scored(batches, model):
    docs = model.value.model.index.docs
    for rows, scores, near in judged(batches, model):
        evidence = [docs[at[:EVIDENCE]].tolist() for at, _ in near]
        cosines = [c[:EVIDENCE].tolist() for _, c in near]
        yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(scores, pa.float64()), pa.array(evidence, pa.list_(pa.int64())), pa.array(cosines, pa.list_(pa.float64()))], names=["doc_id", "score", "evidence", "cosines"])


def passed(batches, model):
    for rows, scores, _ in judged(batches, model):
        yield rows.filter(pa.array(scores < 0.5))


def learnable(doc_id):
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 != 0


def toxicity(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES) -> DataFrame:
    """Every document's toxicity, from its NEAREST labelled examples.

    Returns doc_id, held_out (its label was not to be learned from: crc32 of the doc_id as text is divisible by 5),
    score, predicted, evidence (doc_ids of the three nearest examples) and their cosines. Equal cosines go to the
    example that comes first in the index. A text without words, such as an empty or null one, or without any word of
    the examples has no neighbours and scores the calibrated base rate. Whole texts are searched, whatever their
    length. Null doc_ids count as not held out; repeated rows are scored alike; a doc_id that repeats in labels is
    toxic if any of its rows is; empty documents give no rows, empty labels a score of the base for all. Labels, lang
    and source play no part in a score; other columns, whatever their names, are left out. The model (at most 2 *
    examples vectors over their words) is what is broadcast.
    """
    model = docs.sparkSession.sparkContext.broadcast(learned(docs, labels, learnable, examples))
    rows = dealt(docs.select(F.col("doc_id").cast("long"), "text")).mapInArrow(lambda batches: scored(batches, model), "doc_id long, score double, evidence array<long>, cosines array<double>")
    return rows.select("doc_id", F.coalesce(~learnable(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence", "cosines")


def clean(docs: DataFrame, labelled: DataFrame, labels: DataFrame, examples: int = EXAMPLES) -> DataFrame:
    """docs without those predicted toxic, by a model learned from the texts of `labelled`; columns unchanged, whatever
    their names. One pass, no join: the texts are judged where they lie, so rows without doc_id and repeated rows are
    judged as any other. Null and empty texts stay unless the base rate itself is toxic; a tie at 0.5 is toxic; empty
    tables give no rows."""
    model = docs.sparkSession.sparkContext.broadcast(learned(labelled, labels, learnable, examples))
    return dealt(docs).mapInArrow(lambda batches: passed(batches, model), docs.schema)


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
