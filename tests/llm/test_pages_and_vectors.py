"""Operators over pages and vectors, and the pipeline."""

from collections import Counter

import numpy as np
import pytest

from tessella.llm import extraction, registry, topk, urls
from tessella.llm.labelled_pages import labelled_pages

SF = "/root/testdata/sf0.001"


def test_urls(spark):
    rows = {
        "https://www.Example.com/en/a?x#y": ("www.example.com", "/en/a", "www.example.com/en/", "allow"),
        "http://a.example.com/en/": ("a.example.com", "/en/", "example.com/en/", "block"),
        "http://example.com/fr": ("example.com", "/fr", "com/", "allow"),
        "http://notexample.com/en/": ("notexample.com", "/en/", "com/", "allow"),
        "http://x.net/es/q": ("x.net", "/es/q", "net/es/", "block"),
        "http://net/fr/": ("net", "/fr/", "net/fr/", "block"),
        "http://x.net/essay": ("x.net", "/essay", None, "allow"),
        "http://com": ("com", "", None, "allow"),
        "x://a://b/c": ("a:", "//b/c", None, "allow"),
        "nothing": ("", "", None, "allow"),
        "": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
    }
    given = [(i, u, 1, "x") for i, u in enumerate(rows)] + [(0, next(iter(rows)), 1, "x"), (None, "http://x.net/es/", 1, "x")]
    got = urls.judge(spark.createDataFrame(given, "page_id long, url string, host int, rule string")).collect()
    want = Counter((i, *rows.get(u, ("x.net", "/es/", "net/es/", "block"))) for i, u, *_ in given)
    assert Counter((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in got) == want
    assert urls.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0
    assert urls.judge(spark.createDataFrame([(1, "http://a.b/enough")], "page_id long, url string"), [("b", "/en", "block")]).first()["verdict"] == "block"


def test_extraction_on_unseen_pages():
    field, wrong, n = extraction.trained(), 0, 0
    for page, truth in labelled_pages(150, seed=77):
        blocks = extraction.leaves(page)
        for b, label in zip(blocks, field.decode(blocks)):
            wrong, n = wrong + (truth[b[0]] != label), n + 1
    assert wrong < 0.02 * n


def test_viterbi_is_the_best_path():
    from itertools import product

    field = extraction.trained()
    blocks = extraction.leaves(next(iter(labelled_pages(1, seed=5)))[0])[:9]
    e = [sum(field.weights.get(f, 0.0) for f in extraction.features(b, i == 0, i == len(blocks) - 1)) for i, b in enumerate(blocks)]
    score = lambda p: sum(e[i] for i, y in enumerate(p) if y) + sum(field.steps[a][b] for a, b in zip(p, p[1:]))
    assert score(field.decode(blocks)) == pytest.approx(max(map(score, product((0, 1), repeat=len(blocks)))))


def test_extraction(spark):
    page = '<html><head><title>t</title><script>var a="</p><p>no";</script></head><body><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="ad">Buy things now, they are cheap.</div><article><h1>A &lt;b&gt; c</h1><p><b>One  two\n three &amp four.<br><p>Five six seven, eight nine ten.</p></article><footer>&copy; someone</footer>'
    rows = [(1, "u", page, 5), (1, "u", page, 5), (2, None, None, 5), (3, "u", "", 5), (None, "u", page[: page.index("Five")] + "Five si&am", 5), (4, "u", "<<<>>> <a href='x", 5)]
    got = extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text int")).collect()
    whole = "A <b> c\nOne two three & four.\nFive six seven, eight nine ten."
    by = Counter((r["page_id"], r["text"], r["n_chars"]) for r in got if r["page_id"] != 4)
    assert by == Counter({(1, whole, len(whole)): 2, (2, "", 0): 1, (3, "", 0): 1, (None, "A <b> c\nOne two three & four.\nFive si&am", 40): 1})
    assert extraction.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def plain(rows, k=10):
    ok = [(i, v, n) for n, (i, v) in enumerate(rows) if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    ints = [(i, [int(np.floor(1024 * float(np.float32(x)))) for x in v], n) for i, v, n in ok]
    out = []
    for i, v, n in ints:
        if i is not None and i % 100 == 0:
            found = sorted(((-sum(a * b for a, b in zip(v, w)), j is None, j or 0) for j, w, m in ints if m != n and len(w) == len(v)))[:k]
            out += [(i, r + 1, None if null else j, -s) for r, (s, null, j) in enumerate(found)]
    return Counter(out)


def test_topk(spark):
    r = np.random.default_rng(8)
    rows = [(int(i), [float(x) for x in r.normal(size=16)]) for i in range(900)]
    rows += [(1000 + i, rows[3][1]) for i in range(30)] + [(5000, None), (5001, [None] + [0.0] * 15), (5002, [float("nan")] * 16), (5003, [float("inf")] * 16), (6000, [0.0] * 16), (6100, [1.0, 2.0]), (6101, [2.0, 1.0]), (None, rows[0][1]), (6200, []), (100, rows[100][1])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, rank int, score int")
    got = topk.nearest(df, lambda i: i % 100 == 0).collect()
    assert Counter((x["query_id"], x["rank"], x["vec_id"], x["score"]) for x in got) == plain(rows)
    assert topk.nearest(df.limit(0), lambda i: i % 100 == 0).count() == 0


def test_topk_of_large_components(spark):
    rows = [(0, [2.0**25, -(2.0**24)]), (1, [2.0**17, 1.0]), (2, [3.0, 2.0**18])]
    got = topk.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), lambda i: i % 100 == 0).collect()
    assert Counter((x["query_id"], x["rank"], x["vec_id"], x["score"]) for x in got) == plain(rows)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "labels"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_with_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, SF).toPandas()
    duck.execute(registry.ORACLE_SQL[name])
    want, columns = duck.df(), sorted(got.columns)
    rows = lambda d: sorted(map(tuple, d[columns].astype(object).where(d[columns].notna(), None).astype(str).values))
    assert columns == sorted(want.columns) and rows(got) == rows(want)


def test_pipeline(spark):
    import corpus_pipeline as p

    docs = p.table(spark, SF, "documents")
    seen, columns = [docs.count()], docs.columns
    for i, (_, stage) in enumerate(p.STAGES):
        docs = p.written(stage(spark, docs, SF))
        seen.append(docs.count())
        assert i == len(p.STAGES) - 1 or docs.columns == columns
    assert seen[0] > seen[1] > seen[2] > 0 and seen[4] > 0
    assert p.run(spark, SF).count() == seen[4]
