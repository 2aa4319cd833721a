"""Operators over documents, on odd rows and against plain versions."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tessella.llm import licenses, media, mixing, neardup, packing, sharding, toxicity


def null_last(x):
    return (x is None, x if x is not None else 0)


def test_shards(odd, odd_rows, none):
    got = sharding.shard(odd, 8).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((d, 16 + len((t or "").encode()), zlib.crc32((t or "").encode())) for d, t, *_ in odd_rows)
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and set(by) <= set(range(8))
    assert sharding.shard(none).count() == 0


def test_shards_are_even_and_repeat(spark):
    docs = spark.createDataFrame([(i, "same text" * 9 if i % 3 == 0 else f"text {i} " * (i % 17)) for i in range(4000)], "doc_id long, text string")
    got = sharding.shard(docs).toPandas()
    sizes = got.groupby("shard")["size"].sum()
    assert len(sizes) == 40 and sizes.max() - sizes.min() < 0.1 * sizes.mean() + 2 * got["size"].max()
    again = sharding.shard(docs).toPandas()
    assert (got.sort_values("doc_id").values[:, 4:6] == again.sort_values("doc_id").values[:, 4:6]).all()
    rest = got[got["doc_id"] % 3 != 0]
    assert rest.groupby("text_crc32")["shard"].nunique().max() <= 2


def test_subdivided_ranges():
    low = -(2**63)
    splitters = [(-5, low, low), (0, low, low), (0, 10, low), (0, 10, 5), (0, 10, 9), (7, low, low)]
    keys = [(-9, 0, 0), (-5, 0, 0), (0, 9, 7), (0, 10, 0), (0, 10, 5), (0, 10, 8), (0, 10, 9), (0, 11, 0), (3, 0, 0), (7, 0, 0), (2**62, 0, 0)]
    want = [sum(s <= k for s in splitters) for k in keys]
    assert sharding.range_of(*(np.array(x, np.int64) for x in zip(*keys)), splitters).tolist() == want == [0, 1, 2, 3, 4, 4, 5, 5, 5, 6, 6]


def test_targets():
    assert mixing.targets_of([100, 100, 100], [5, 2, 1], 3, 300) == [187.5, 75.0, 37.5]
    assert mixing.targets_of([10, 100, 100], [5, 2, 1], 3, 210) == [30.0, 120.0, 60.0]
    assert mixing.targets_of([], [], 3, 0) == []


def test_mix(odd, odd_rows, none):
    got = mixing.mix(odd).collect()
    assert len(got) == len(odd_rows)
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((d, words(t)) for d, t, *_ in odd_rows)
    by = defaultdict(list)
    for r in got:
        assert r["taken"] in {k * r["size"] for k in range(4)}
        by[r["source"]].append(r)
    names = sorted(by, key=lambda s: (s is None, s or ""))
    sizes = [sum(r["size"] for r in by[s]) for s in names]
    want = mixing.targets_of(sizes, [(5, 2, 1)[i % 3] for i in range(len(names))], 3, sum(sizes))
    for s, size, target in zip(names, sizes, want):
        assert {(r["source_size"], r["target"]) for r in by[s]} == {(size, target)}
        assert abs(sum(r["taken"] for r in by[s]) - target) <= max(r["size"] for r in by[s])
    assert Counter((r["doc_id"], r["taken"]) for r in got) == Counter((r["doc_id"], r["taken"]) for r in mixing.mix(odd).collect())
    assert mixing.mix(none).count() == 0


def test_mixed_rows(odd, none):
    rows = mixing.mixed(odd)
    assert rows.columns == odd.columns
    taken = Counter()
    for r in mixing.mix(odd).collect():
        taken[r["doc_id"]] += r["copies"]
    assert Counter(r["doc_id"] for r in rows.collect()) == +taken
    assert mixing.mixed(none).count() == 0


@pytest.fixture(scope="module")
def tokenizer():
    P = pytest.importorskip("public_tokenizers")
    return P.path(packing.TOKENIZER)


def test_pack(odd, odd_rows, none, tokenizer):
    from tokenizers import Tokenizer

    t, want = Tokenizer.from_file(tokenizer), Counter()
    for doc, text, *_ in odd_rows:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        for k in range(0, len(ids), 2048):
            part = ids[k : k + 2048]
            want[doc, k // 2048, k, len(part), zlib.crc32(part.tobytes())] += 1
    got = packing.pack(odd, tokenizer).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(by) <= math.ceil(sum(r["length"] for r in got) / 2048) + 1
    assert packing.pack(none, tokenizer).count() == 0


def test_words_are_encoded_as_in_their_text(tokenizer):
    import pyarrow as pa
    from tokenizers import Tokenizer

    t, w = Tokenizer.from_file(tokenizer), packing.Words(tokenizer)
    texts = ["", "  ", "Hello, WORLD's <|endoftext|>x <|startoftext|>, it's!! a.b.c \x01 naïve É\u0301 H\u0331x don'T 'S a b c\x1cd\x85e ½²3.5 \U0001f600,ok 漢字。 ...,' x'... <|ENDOFTEXT|> İ ΣΑΣ. q|> \t\n", "\u0301abc \u0301 A\u030a. e\u0301, don't. it's' rock'n'roll"] * 2
    ids, at = w.encode(pa.array(texts))
    for i, text in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == t.encode(text, add_special_tokens=False).ids


def test_media(odd, odd_rows, none):
    got = media.digests(odd).collect()
    want = Counter()
    for doc, text, *_ in odd_rows:
        raw = (text or "").encode()
        p = media.padded(raw)
        assert len(p) % 64 == 0 and p
        want[doc, len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])] += 1
    assert Counter((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in got) == want
    kept = media.inspect(media.store(odd)).collect()
    assert all(r["codec"] == "raw" and r["keyframes"][0]["length"] == 64 for r in kept)
    assert media.digests(none).count() == 0 and media.inspect(media.store(none)).count() == 0


@pytest.mark.parametrize("n", [0, 1, 64, 65, 64 * 1024, 64 * 1024 + 1, 64 * 3000])
def test_containers_read_back(n):
    payload = media.padded(bytes(i * 7 % 251 for i in range(n)))
    file = media.container(payload)
    track = media.Track(file)
    assert track.payload(file) == payload and track.duration == len(payload)
    assert [k for k, _, _ in media.boxes(memoryview(file))] == [b"ftyp", b"moov", b"mdat"]
    with pytest.raises(ValueError):
        media.Track(file[:200])


def brute_groups(rows, k, percent):
    sets = []
    for _, text, *_ in rows:
        w = (text or "").encode().lower().split()
        sets.append(frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else []))
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = defaultdict(lambda: None)
    for i, r in enumerate(rows):
        a, b = least[find(i)], r[0]
        least[find(i)] = min(x for x in (a, b) if x is not None) if a is not None or b is not None else None
    return Counter((r[0], len(sets[i]), least[find(i)] if sets[i] else r[0]) for i, r in enumerate(rows))


def test_near_duplicates(odd, odd_rows, none):
    got = neardup.groups(odd, 4).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute_groups(odd_rows, 4, 80)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    assert neardup.groups(none).count() == 0


def test_near_duplicates_in_a_large_region(spark):
    import random

    r = random.Random(9)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(400):  # copies edited so that many are alike only through others, or not at all
        copy = list(base)
        for _ in range(r.choice([0, 1, 2, 3, 4, 8, 14])):
            copy[r.randrange(150)] = f"x{r.randrange(10**6)}"
        rows.append((i, " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert Counter((x["doc_id"], x["n_shingles"], x["component_id"]) for x in neardup.groups(docs, 4).collect()) == brute_groups(rows, 4, 80)


def test_deduplicated(odd, none):
    got = neardup.deduplicated(odd)
    assert got.columns == odd.columns
    ids = [r["doc_id"] for r in got.collect()]
    assert len([i for i in ids if i is not None]) == len({i for i in ids if i is not None}) and 10 in ids and 20 not in ids and 50 not in ids
    assert neardup.deduplicated(none).count() == 0


@pytest.fixture(scope="module")
def judged(spark):
    import random

    r = random.Random(2)
    usual = [f"{a}{b}" for a in ("tan", "mir", "sol", "ber") for b in ("o", "u", "e", "i", "ar", "en")]
    rows, labels = [], []
    for i in range(600):
        w = r.choices(usual, k=r.randint(20, 90))
        bad = i % 6 == 0
        for _ in range(r.randint(2, 5) if bad else 0):
            w.insert(r.randrange(len(w)), r.choice(["vilest", "scorn", "grubby"]))
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"), dict(labels)


def test_toxicity(judged, odd, odd_rows, none):
    docs, labels, truth = judged
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == 600 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    held = [r for r in got if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0}
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) >= 0.97 * len(held)
    other = toxicity.toxicity(odd, labels).collect()
    assert Counter(r["doc_id"] for r in other) == Counter(d for d, *_ in odd_rows)
    assert toxicity.toxicity(none, labels).count() == 0
    assert {r["predicted"] for r in toxicity.toxicity(docs, labels.limit(0)).collect()} == {0}


def test_clean(judged):
    docs, labels, truth = judged
    kept = {r["doc_id"] for r in toxicity.clean(docs, docs, labels).collect()}
    assert sum(i in kept for i, y in truth.items() if not y) >= 495 and sum(i in kept for i, y in truth.items() if y) <= 5


def test_licenses(spark, none):
    mit = licenses.TEXTS["MIT"]
    rows = [(1, mit), (2, "Copyright (c) 2020 Some One\n" + mit.upper().replace(",", "")), (3, mit + " more"), (4, None), (5, ""), (6, "RELEASED under the MIT licence"), (None, licenses.TEXTS["ISC"]), (2, licenses.TEXTS["ISC"])]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r["doc_id"], r["license"]) for r in got) == Counter([(1, "MIT"), (2, "MIT"), (3, None), (4, None), (5, None), (6, "MIT (line)"), (None, "ISC"), (2, "ISC")])
    assert licenses.scan(none).count() == 0
