"""Packing: ids as the tokenizer gives them, and supersteps of best fit against a plain sweep."""

import math
import random
from bisect import bisect_left, insort
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tessella.llm import packing


@pytest.fixture(scope="module")
def tokenizer():
    P = pytest.importorskip("public_tokenizers")
    return P.path(packing.TOKENIZER)


def differing(tokenizer, texts):
    from tokenizers import Tokenizer

    ids, at = packing.Words(tokenizer).encode(pa.array(texts))
    want = Tokenizer.from_file(tokenizer).encode_batch(texts, add_special_tokens=False)
    return [t for i, t in enumerate(texts) if ids[at[i] : at[i + 1]].tolist() != want[i].ids]


def test_every_letter_before_every_mark(tokenizer):
    letters = [chr(c) for c in [*range(0x80, 0xD800), *range(0xE000, 0x20000)] if chr(c).isalpha()]
    marks = packing.Words.MARKS
    # each letter with a few marks, and the letters of the first blocks with all of them
    texts = [f"ab{x}{marks[(i * 7 + k) % len(marks)]}" for i, x in enumerate(letters) for k in range(2)]
    texts += [f"ab{x}{m}" for x in letters if ord(x) < 0x2000 for m in ".,_'-"]
    assert differing(tokenizer, texts) == []


def test_random_texts(tokenizer):
    r = random.Random(11)
    pool = "abzABZ019 .,_'!-<|>\t\n\u0130\u0958\u095f\u00e9\u0301\u03a3\u03c3\u212a\ufb01\u6f22\U0001f600\u200d\u0f43\u1e9b\u0323"
    texts = ["".join(r.choices(pool, k=r.randint(1, 12))) for _ in range(30_000)]
    assert differing(tokenizer, texts) == []


def plain_best_fit(counts: dict[int, int], capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Rounds of best fit over runs of equal lengths and equal gaps, longest lengths first.

    In each round the next length's documents, ordered by rank, meet their successor: the smallest gaps that hold
    them, a run of equal gaps at a time. Where documents compete for a run of gaps, rank decides; the others go to
    the next larger gaps or open sequences. Filled gaps become smaller gaps for the rounds that follow. There are at
    most `capacity` lengths and gap sizes, so this state doesn't grow with the data.

    Returns runs (first rank among all documents by rising length, first sequence, offset) and the sequences' number.
    """
    lengths = sorted(counts)
    first = dict(zip(lengths, np.cumsum([0, *(counts[x] for x in lengths)]).tolist()))
    gaps: dict[int, list[tuple[int, int]]] = {}
    sizes: list[int] = []
    out: list[tuple[int, int, int]] = []
    sequences = 0

    def leave(gap: int, base: int, n: int) -> None:
        if gap and n:
            if gap not in gaps:
                insort(sizes, gap)
            gaps.setdefault(gap, []).append((base, n))

    for length in reversed(lengths):
        rank, left = first[length], counts[length]
        while left:
            i = bisect_left(sizes, length)
            if i == len(sizes):
                fits = capacity // length
                full, rest = divmod(left, fits)
                for k in range(fits if full else 0):
                    out.append((rank + k * full, sequences, k * length))
                leave(capacity - fits * length, sequences, full)
                for k in range(rest):
                    out.append((rank + fits * full + k, sequences + full, k * length))
                leave(capacity - rest * length, sequences + full, 1 if rest else 0)
                sequences += full + (1 if rest else 0)
                left = 0
            else:
                gap = sizes[i]
                base, n = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap]
                    sizes.pop(i)
                used = min(n, left)
                out.append((rank, base, capacity - gap))
                leave(gap, base + used, n - used)
                leave(gap - length, base, used)
                rank, left = rank + used, left - used
    runs = np.array(sorted(out), np.int64).reshape(-1, 3)
    return runs[:, 0], runs[:, 1], runs[:, 2], sequences


def plain_places(counts: dict[int, int], capacity: int) -> list[list[int]]:
    """The lengths in each sequence of the plain sweep."""
    lengths = sorted(counts)
    rank, base, offset, n = plain_best_fit(counts, capacity)
    order = np.repeat(lengths, [counts[x] for x in lengths])
    at = np.searchsorted(rank, np.arange(len(order)), "right") - 1
    out = defaultdict(list)
    for s, x in zip(base[at] + np.arange(len(order)) - rank[at], order):
        out[int(s)].append(int(x))
    assert len(out) == n
    return list(out.values())


def placed(spark, lengths, capacity):
    items = spark.createDataFrame(list(enumerate(map(int, lengths))), "item long, length long")
    return packing.best_fit(items, Counter(map(int, lengths)), capacity).toPandas()


@pytest.mark.parametrize("seed,low,high", [(1, 1, 101), (2, 30, 60), (3, 1, 8), (4, 51, 100)])
def test_supersteps_against_the_plain_sweep(spark, seed, low, high):
    lengths = np.random.default_rng(seed).integers(low, high, 3000)
    got = placed(spark, lengths, 100)
    assert sorted(got["item"]) == list(range(3000))
    got["length"] = lengths[got["item"]]
    for _, rows in got.sort_values("offset").groupby("sequence_id"):
        assert (rows["offset"] == rows["length"].cumsum() - rows["length"]).all() and rows["length"].sum() <= 100
    plain = plain_places(Counter(lengths.tolist()), 100)
    assert got["sequence_id"].max() + 1 == got["sequence_id"].nunique() <= 1.03 * len(plain) + 2
    assert len(plain) >= math.ceil(lengths.sum() / 100)


def test_sweep_is_bracket_matching():
    r = random.Random(3)
    for _ in range(200):
        rows = sorted([(-r.randint(1, 9), 0, i) for i in range(r.randint(0, 8))] + [(-r.randint(1, 9), 1, i) for i in range(r.randint(0, 8))])
        stack, want = [], {}
        for size, kind, i in rows:
            if kind == 0:
                stack.append((i, -size))
            elif stack:
                want[i] = stack.pop()
        table = {"item": [i if k else None for _, k, i in rows], "size": [-s for s, _, _ in rows], "seq": [None if k else i for _, k, i in rows], "slot": [None if k else 0 for _, k, _ in rows], "gap": [None if k else -s for s, k, _ in rows]}
        batch = pa.RecordBatch.from_pydict({c: pa.array(v, pa.int64()) for c, v in table.items()})
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(packing, "TaskContext", type("T", (), {"get": staticmethod(lambda: type("P", (), {"partitionId": lambda self: 0})())}))
            out = pa.Table.from_batches(list(packing.swept(iter([batch])))).to_pylist() if rows else []
        found = {x["item"]: (x["seq"], x["gap"]) for x in out if x["part"] is None}
        assert found == want and all(x["length"] <= x["gap"] for x in out if x["part"] is None)
        assert len(out) == len(rows) - len(want)


def test_documents_take_slots_of_earlier_ranges():
    # range 0 leaves three slots, range 1 wants two and leaves one, range 2 wants three
    assert packing.spans([(0, 1, 3), (1, 2, 1), (2, 3, 0)]) == [(1, 0, 2, 0, 2), (2, 0, 1, 1, 0), (2, 1, 2, 0, 0)]
    assert packing.spans([]) == []


def test_ranges_meet(spark, monkeypatch):
    """Gaps and documents in different ranges find each other, whatever the number of ranges."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        todo = spark.createDataFrame([(i, 10 + i % 3) for i in range(50)], "item long, length long")
        gaps = spark.createDataFrame([(i, 20 + i % 5) for i in range(40)], "seq long, gap long")
        taken, left, n = packing.matched(todo, gaps, 10, 12)
        rows = taken.collect()
        # a gap of 24 holds two of 12; others one of 12 and, of 22 and 23, one of 10 or 11 besides
        assert len(rows) + n == 50 == len({r["item"] for r in rows} | {r["item"] for r in left.collect()})
        assert all(r["length"] <= (12 if r["slot"] < r["gap"] // 12 else r["gap"] % 12) for r in rows)
        assert len({(r["seq"], r["slot"]) for r in rows}) == len(rows) and n == left.count() == 0
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
