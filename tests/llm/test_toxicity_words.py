"""Toxicity sees whole texts: cosines, neighbours and scores against plain versions."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tessella.llm import toxicity


def words(text):
    return Counter(re.findall(r"[a-z0-9]+", text.lower()))


def plain(weight: dict[str, float], unseen: float, examples: dict[int, str], text: str, k: int) -> list[tuple[float, int]]:
    """The k largest TF-IDF cosines by definition."""

    def vector(t):
        v = {w: (1 + math.log(n)) * weight.get(w, unseen) for w, n in words(t).items()}
        size = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / size for w, x in v.items()}

    q = vector(text)
    found = [(round(sum(x * q.get(w, 0.0) for w, x in vector(t).items()), 9), d) for d, t in examples.items()]
    return sorted(((s, d) for s, d in found if s > 0), key=lambda x: (-x[0], x[1]))[:k]


def indexed(weight, unseen, examples, labels):
    names = sorted({w for t in examples.values() for w in words(t)})
    place = {w: i for i, w in enumerate(names)}
    rows = [words(t) for t in examples.values()]
    ids = np.array([place[w] for c in rows for w in c], np.int64)
    counts = np.array([n for c in rows for n in c.values()], np.int64)
    return toxicity.Index(names, np.array([weight[w] for w in names]), unseen, np.array(list(examples)), np.array(labels, bool), np.r_[0, np.cumsum([len(c) for c in rows])], ids, counts)


@pytest.mark.parametrize("common,together,first", [(0, 3, 1), (5, 128, 1), (512, 64, 4)])
def test_index_is_exact(common, together, first, monkeypatch):
    for name, value in (("COMMON", common), ("TOGETHER", together), ("FIRST", first), ("BLOCK", 16)):
        monkeypatch.setattr(toxicity, name, value)
    r = random.Random(7)
    names = ["".join(x) for x in zip(*[r.choices("abcdefgh", k=60) for _ in range(4)])]
    texts = [" ".join(r.choices(names, [1 / (1 + j) for j in range(60)], k=r.randint(1, 25))) for _ in range(300)]
    examples = {i: texts[i] for i in range(0, 300, 2)}
    weight = {w: 0.1 + 3 * r.random() for w in names}
    index = indexed(weight, 2.5, examples, [i % 3 == 0 for i in examples])
    asked = [*texts, "", "zzz", "zzz " + names[0], texts[0].upper()]
    for text, (at, cosines) in zip(asked, index.nearest(pa.array(asked), 15)):
        want = plain(weight, 2.5, examples, text, 15)
        assert cosines.tolist() == pytest.approx([s for s, _ in want], abs=1e-8)
        found = dict(zip(index.docs[at].tolist(), cosines.tolist()))
        least = want[-1][0] if want else 0
        assert all(d in found for s, d in want if s > least + 1e-8)  # ties of the last go to the earlier in the index
    assert index.nearest(pa.array([None], pa.string()), 15)[0][0].size == 0


def test_blocks_are_left_out_on_proof(monkeypatch):
    monkeypatch.setattr(toxicity, "FIRST", 1)
    r = random.Random(1)
    topics = [["".join(r.choices("abcdefgh", k=6)) for _ in range(30)] for _ in range(40)]
    examples = {i: " ".join(r.choices(topics[i % 40], k=20)) for i in range(4000)}
    weight = {w: 1.0 for t in topics for w in t}
    index = indexed(weight, 1.0, examples, [False] * 4000)
    near = index.nearest(pa.array([" ".join(r.choices(topics[i], k=20)) for i in range(40)]), 10)
    assert all(len(at) == 10 for at, _ in near) and index.met < 0.5 * index.asked


@pytest.fixture(scope="module")
def labelled(spark):
    r = random.Random(21)
    usual = [f"{a}{b}" for a in "bdfgklmn" for b in ("ara", "elo", "ino", "uru", "eta")]
    rows, labels = [], []
    for i in range(500):
        w = r.choices(usual, k=r.randint(3, 60))
        if i % 7 == 0:
            w += r.choices(["vile", "scornful", "grubby"], k=2)
        rows.append((i, " ".join(w)))
        labels.append((i, int(i % 7 == 0)))
    return rows, labels


def test_scores_against_brute_force(spark, labelled):
    rows, labels = labelled
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {x["doc_id"]: x for x in toxicity.toxicity(docs, marks).collect()}
    model = toxicity.learned(docs, marks, toxicity.learnable).model
    texts, truth = dict(rows), dict(labels)
    examples = {int(d): texts[int(d)] for d in model.index.docs}
    assert all(zlib.crc32(str(d).encode()) % 5 for d in examples) and len({*examples.values()}) == len(examples) > 250
    # weights by definition: IDF over all documents, times 1 and the root of chi-square over the indexed examples
    df = Counter(w for _, t in rows for w in set(t.split()))
    n1, n0 = sum(truth[d] for d in examples), sum(1 - truth[d] for d in examples)
    weight = {}
    for w in {w for t in examples.values() for w in t.split()}:
        a, b = sum(truth[d] for d, t in examples.items() if w in t.split()), sum(1 - truth[d] for d, t in examples.items() if w in t.split())
        table = np.array([[a, n1 - a], [b, n0 - b]], float)
        fair = table.sum(1, keepdims=True) * table.sum(0) / table.sum()
        chi = ((table - fair) ** 2 / fair).sum() if (fair > 0).all() else 0.0
        assert (fair > 0).all() or chi == 0
        weight[w] = math.log((1 + 500) / (0.5 + df[w])) * (1 + math.sqrt(chi))
    a, b = model.fit
    for d, text in rows:
        near = plain(weight, math.log(501 / 1.5), examples, text, toxicity.NEAREST)
        votes = [(s / (toxicity.SAME + max(0.0, 1 - s)) * model.shares[truth[j]], truth[j]) for s, j in near]
        p = (sum(v * y for v, y in votes) + toxicity.PRIOR * model.base) / (sum(v for v, _ in votes) + toxicity.PRIOR)
        want = 1 / (1 + math.exp(-(a * math.log(p / (1 - p)) + b)))
        assert got[d]["cosines"] == pytest.approx([s for s, _ in near[:3]], abs=1e-8)
        assert got[d]["score"] == pytest.approx(want, abs=2e-2 if len({s for s, _ in near}) < len(near) else 1e-6)


def test_calibration_follows_the_labels():
    r = np.random.default_rng(5)
    votes = r.random(4000) * 0.6
    labels = (r.random(4000) < 1 / (1 + np.exp(-(2 * toxicity.odds(votes) + 1)))).astype(float)
    a, b = toxicity.calibrated(votes, labels, np.ones(4000))
    assert a == pytest.approx(2, abs=0.3) and b == pytest.approx(1, abs=0.3)
    assert toxicity.calibrated(np.zeros(0), np.zeros(0), np.zeros(0)) == (1.0, 0.0)


def test_copies_of_toxic_examples_without_markers(spark):
    r = random.Random(3)
    usual = [f"{a}{b}" for a in "bdfgklmn" for b in ("ara", "elo", "ino", "uru")]
    rows = [(i, " ".join(r.choices(usual, k=40))) for i in range(400)]
    labels = [(i, int(i % 50 == 1)) for i in range(400)]
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    learned = [i for i, y in labels if y and zlib.crc32(str(i).encode()) % 5]
    texts = dict(rows)
    copies = {1000 + i: i for i in learned}
    docs = spark.createDataFrame([*rows, *((c, texts[i]) for c, i in copies.items()), (2000, "")], "doc_id long, text string")
    got = {x["doc_id"]: x for x in toxicity.toxicity(docs, marks).collect()}
    assert {i: (got[c]["score"], got[c]["evidence"], got[c]["cosines"]) for c, i in copies.items() if got[c]["predicted"] == 0 or got[c]["evidence"][0] != i} == {}
    assert learned and all(got[c]["predicted"] == 1 and got[c]["evidence"][0] == i and got[c]["cosines"][0] == pytest.approx(1) for c, i in copies.items())
    assert all(len(x["evidence"]) == 3 for x in got.values() if x["doc_id"] != 2000) and got[2000]["evidence"] == []


def test_scores_follow_the_ratio_of_all_labels(spark):
    r = random.Random(9)
    usual = [f"{a}{b}" for a in "bdfgklmn" for b in ("ara", "elo", "ino", "uru")]
    docs = spark.createDataFrame([(i, " ".join(r.choices(usual, k=30))) for i in range(600)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 12 == 0)) for i in range(600)], "doc_id long, toxic int")
    held = toxicity.toxicity(docs, labels, examples=30).where("held_out").collect()
    assert sum(x["score"] for x in held) / len(held) < 0.2


def test_shares_of_votes():
    assert toxicity.weighed({0: 100, 1: 10}, {0: 10, 1: 10}) == pytest.approx((20 / 11, 2 / 11))
    assert toxicity.weighed({0: 5, 1: 7}, {0: 5, 1: 7}) == (1, 1) and toxicity.weighed({}, {}) == (1, 1)


def test_a_repeated_doc_id_stays_in_the_bound(spark):
    docs = spark.createDataFrame([(1, f"text number {i} here") for i in range(300)] + [(i, f"other {i}") for i in range(2, 60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 60)], "doc_id long, toxic int")
    assert len(toxicity.learned(docs, labels, toxicity.learnable, examples=10).model.index.docs) <= 20
    assert toxicity.toxicity(docs, labels, examples=10).count() == 358


def test_clean_on_odd_rows(odd, odd_rows, none, spark):
    labels = spark.createDataFrame([(i, int(i % 9 == 0)) for i in range(160)], "doc_id long, toxic int")
    kept = toxicity.clean(odd, odd, labels)
    assert kept.columns == odd.columns
    scores = toxicity.toxicity(odd, labels).where("predicted = 0")
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(r["doc_id"] for r in scores.collect())
    assert toxicity.clean(none, odd, labels).count() == 0 and toxicity.clean(odd, none, labels).count() == len(odd_rows)
