"""URL verdicts, language, neighbours, components, the pipeline and what is registered."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import ann, components, language, queries, urls


def test_registered():
    names = list(queries.queries())
    assert sorted(int(n[2:].split("_")[0]) for n in names if n.startswith("op")) == list(range(1, 14)) and "pipeline" in names
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "quality", "near_duplicates", "personal_data", "packing"]


URLS = ["http://A.Net/x", "https://blog.example.net/en/1", "https://example.net/fr/1", "http://notexample.com/de/1", "http://m.example.COM/de/", "http://x.org/fr", "http://x.org/fr/?a=1", "http://example.net?q", "http://example.net/?q", "no scheme", "", None, "ftp://É.org/fr/1#z", "http://x.net:80/a", "://net/"]


def test_url_rules_by_hand(spark):
    df = spark.createDataFrame([(k, u, "h", "r") for k, u in enumerate(URLS)] + [(0, URLS[0], "h", "r")], "page_id long, url string, host string, rule string")
    none = spark.createDataFrame([], "url string, bad boolean")
    got = urls.judge(df, queries.URL_RULES, none).collect()
    assert len(got) == len(URLS) + 1
    by = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in got}
    assert by[0] == ("a.net", "/x", "net/", "block") and by[1] == ("blog.example.net", "/en/1", "example.net/en/", "allow")
    assert by[2][2:] == ("net/", "block") and by[3][2:] == (None, "allow") and by[4][2:] == ("example.com/de/", "block")
    assert by[5][2] is None and by[6][2:] == ("org/fr/", "allow") and by[7] == ("example.net", "", None, "allow") and by[8][2] == "net/"
    assert by[9] == by[10] == by[11] == ("", "", None, "allow") and by[12][:3] == ("É.org", "/fr/1", "org/fr/") and by[13][2] is None and by[14] == ("net", "/", "net/", "block")


def test_url_rules_mined(spark):
    rows = [(k, f"http://{'spam-farm' if k % 3 == 0 else 'good'}.site{k % 2}.com/{k % 7}/x?ref=1", k % 3 == 0) for k in range(300)]
    df = spark.createDataFrame(rows, "page_id long, url string, bad boolean")
    got = urls.judge(df.select("page_id", "url"), {}, df.where("page_id % 2 = 0")).collect()
    assert all((r["verdict"] == "block") == (r["page_id"] % 3 == 0) for r in got)


def test_url_rules_mined_at_every_size(spark):
    rng = random.Random(6)
    for n in (60, 900, 6000):  # twelve spam urls of one host label and of one path word; other labels by chance
        rows = [(k, f"http://{rng.choice('mw')}.h{rng.randrange(40)}x.com/{rng.choice(['en', 'de'])}/{k}?ref=x{rng.randrange(3)}", rng.random() < 0.25) for k in range(n)]
        rows += [(n + k, f"http://m.big-win.h{k}y.com/en/{k}", True) for k in range(12)] + [(n + 20 + k, f"http://w.h{k}z.com/de/cheap_pills-{k}", True) for k in range(12)]
        df = spark.createDataFrame(rows, "page_id long, url string, bad boolean")
        asked = spark.createDataFrame([(0, "http://a.big-win.b.org/x"), (1, "http://b.c/pills/now"), (2, "http://m.h1x.com/en/1")], "page_id long, url string")
        got = {r["page_id"]: r["verdict"] for r in urls.judge(asked, {}, df.select("url", "bad")).collect()}
        assert got == {0: "block", 1: "block", 2: "allow"}, n


def test_language(spark):
    rng = random.Random(1)
    vocab = {"xx": ["kato", "muri", "pelo", "zanta"], "yy": ["schlo", "bergen", "wurst", "krau"]}
    rows = [(k, " ".join(rng.choice(vocab[lang]) for _ in range(40)), lang, "srcA", 7) for k in range(80) for lang in [("xx", "yy")[k % 2]]]
    rows += [(100, None, None, "srcA", 7), (101, "", "xx", None, 7), (102, "1234 !!", "yy", "srcB", 7), (103, "kato " * 20000, None, "srcB", 7), (4, rows[4][1], "xx", "srcA", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, p int")
    pages = spark.createDataFrame([(1, "http://h.a.yy/xx/104.html", '<HTML class="q" LANG="YY-at">'), (2, None, None), (3, "http://h.a.yy/xx/3", "<p>"), (4, "http://g.a.yy/yy/3", "<p>")], "page_id long, url string, html string")
    evidence = language.page_evidence(pages, queries.document_number(F.col("path")))
    assert {(r["doc"], r["host"], r["declared"], r["suffix"]) for r in evidence.collect()} == {(104, "h.a.yy", "yy", "xx"), (3, "h.a.yy", None, "xx"), (3, "g.a.yy", None, "yy")}
    got = language.identify(docs, language.fit(docs), evidence).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == len(rows) and all(by[k]["lang"] == ("xx", "yy")[k % 2] and by[k]["kept"] for k in range(80)) and by[103]["lang"] == "xx"
    assert not any(by[k]["kept"] for k in (100, 101, 102)) and by[100]["lang"] is None and by[3]["pages"] == 2 and by[5]["pages"] == 0
    assert language.identify(docs.limit(0), language.fit(docs)).count() == 0
    assert not any(r["kept"] for r in language.identify(docs, language.fit(docs.limit(0))).collect())


def vectors(spark, x, extra=()):
    rows = [(k, [float(np.float32(c)) for c in v], 3, "q") for k, v in enumerate(x)]
    return spark.createDataFrame(rows + [(k, v, 3, "q") for k, v in extra], "vec_id long, embedding array<float>, cell int, raw string")


def test_neighbours(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 24)).astype(np.float32)
    x[100:140] = x[100]  # one vector many times
    odd = [(5000, None), (5020, [0.0] * 24), (5040, [float("nan")] + [1.0] * 23), (5060, [1.0, None] + [1.0] * 22), (5080, [float("inf")] * 24), (5100, [1.0] * 3)]
    got = ann.search(vectors(spark, x, odd), F.col("vec_id") % 20 == 0, cell_rows=300, probes=0.8, block=256).collect()
    by = {}
    for r in got:
        by.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    assert set(by) == set(range(0, 3000, 20)) and all(sorted(v) == list(range(1, 21)) for v in by.values())
    d = x.astype(np.float64)
    hits = 0
    for q, ranks in by.items():
        s = d @ d[q]
        s[q] = -np.inf
        best = np.lexsort((np.arange(len(s)), -s))[:20]
        mine = [ranks[k] for k in range(1, 21)]
        hits += len({v for v, _ in mine} & set(best.tolist()))
        assert all(abs(sc - s[v]) < 1e-9 for v, sc in mine) and mine == sorted(mine, key=lambda p: (-p[1], p[0]))
    assert hits / (20 * len(by)) >= 0.9
    few = ann.search(vectors(spark, x[:7]), F.col("vec_id") % 5 == 0).collect()
    assert len(few) == 2 * 6 and ann.search(vectors(spark, x[:0]), F.lit(True)).count() == 0


def test_neighbours_at_defaults(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(20_600, 32)).astype(np.float32)  # five cells
    x[:400] = x[0] * (1 + 1e-6 * np.arange(400)[:, None])  # many rows of one code, the largest ids nearest
    asked = np.r_[0, rng.choice(np.arange(400, len(x)), 100, replace=False)]
    got = ann.search(vectors(spark, x), F.col("vec_id").isin(asked.tolist())).collect()
    d = x.astype(np.float64)
    hits = []
    for q in asked:
        s = d @ d[q]
        s[q] = -np.inf
        best = np.lexsort((np.arange(len(s)), -s))[:20]
        hits.append(len({r["vec_id"] for r in got if r["query_id"] == q} & set(best.tolist())))
    assert hits[0] == 20 and np.mean(hits[1:]) / 20 >= 0.95


def test_neighbours_of_repeated_ids_and_doubles(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(400, 16))
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    more = [(0, x[0].tolist()), (7, x[7].tolist()), (7, (3 * x[0]).tolist()), (20, rng.normal(size=16).tolist())]
    df = spark.createDataFrame(rows + more, "vec_id long, embedding array<double>")
    got = {}
    for r in ann.search(df, F.col("vec_id") % 20 == 0, rerank=400).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert sorted(got) == list(range(0, 400, 20))
    for q, found in got.items():
        best = {}
        for a, v in rows + more:
            for b, w in rows + more:
                if a == q and b != q:
                    best[b] = max(best.get(b, -np.inf), float(np.dot(v, w)))
        want = sorted(best.items(), key=lambda kv: (-kv[1], kv[0]))[:20]
        assert [v for _, v, _ in sorted(found)] == [v for v, _ in want] and all(abs(s - w) < 1e-12 for (_, _, s), (_, w) in zip(sorted(found), want))


def test_neighbours_leave_cells_out_where_vectors_cluster(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 16)) * 4
    x = (centres[rng.integers(0, 40, 12_000)] + rng.normal(size=(12_000, 16))).astype(np.float32)
    book = ann.fit(x[:6000].astype(np.float64), 40, 2, 4.0)
    share = ann.share_to_visit(x[:6000], book, 20, 0.985)
    assert share < 0.5
    asked = rng.choice(len(x), 100, replace=False)
    got = ann.search(vectors(spark, x), F.col("vec_id").isin(asked.tolist()), cell_rows=300, sample_rows=6000).collect()
    d, hits = x.astype(np.float64), []
    for q in asked:
        s = d @ d[q]
        s[q] = -np.inf
        hits.append(len({r["vec_id"] for r in got if r["query_id"] == q} & set(np.lexsort((np.arange(len(s)), -s))[:20].tolist())))
    assert np.mean(hits) / 20 >= 0.95


def test_components(spark):
    rng = random.Random(3)
    links = [(k, k + 1) for k in range(60)] + [(rng.randrange(100, 300), rng.randrange(100, 300)) for _ in range(150)] + [(7, 7)]
    root = {}

    def find(a):
        root.setdefault(a, a)
        while root[a] != a:
            a = root[a]
        return a

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {a: find(a) for ab in links if ab[0] != ab[1] for a in ab}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """A folder of small tables with nulls, repeated rows and a clashing column."""
    rng = random.Random(4)
    folder = str(tmp_path_factory.mktemp("sf"))
    words = ["kato", "muri", "pelo", "zanta", "brun", "delo"]
    texts = [" ".join(rng.choice(words) + rng.choice(["", "s", "r"]) for _ in range(60)) for _ in range(40)]
    rows = [(k, t, "xx", f"s{k % 3}", len(t), "u") for k, t in enumerate(texts)]
    rows += [(50, texts[0], "xx", "s1", 1, "u"), (51, None, None, None, None, None), (52, "", "xx", "s1", 0, "u"), (3, texts[3], "xx", "s0", 1, "u"), (53, texts[1] + " a.b@c.de", "xx", "s1", 1, "u"), (None, texts[5], "xx", "s1", 1, "u")]
    bad = [(60 + k, (" ".join(rng.choice(words).upper() + "!!" for _ in range(60))), "xx", "s1", 1, "u") for k in range(15)]
    spark.createDataFrame(rows + bad, "doc_id long, text string, lang string, source string, n_chars long, found string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(k, int(k < 60), 0) for k in [*range(40), *range(60, 75)]], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(0, "http://a.b/xx/1", "<html lang=xx>"), (1, None, None)], "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    return folder


def test_pipeline(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, small).collect(), docs.select(*corpus_pipeline.COLUMNS).schema)
        assert docs.columns == list(corpus_pipeline.COLUMNS), name
        ids = sorted(r["doc_id"] for r in docs.collect())
        if name == "language":
            assert 51 not in ids and 52 not in ids and ids.count(3) == 2
        if name == "quality":
            assert not set(range(60, 75)) & set(ids) and set(range(40)) <= set(ids)
        if name == "near_duplicates":
            assert 50 not in ids and ids.count(3) == 1 and len(set(ids)) == len(ids)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert not any("@" in t for t in texts.values())
    assert corpus_pipeline.run(spark, small).agg(F.count_distinct("doc_id")).first()[0] == len(texts)
    empty = spark.read.parquet(f"{small}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, small).count() == 0


def test_salted_joins_equal_plain_ones(spark):
    from tidemark.llm.shared import salted

    rng = random.Random(2)
    rows = [(k, "hot" if k % 3 == 0 else rng.choice("abcdefg")) for k in range(900)] + [(900, None), (901, "none")]
    df = spark.createDataFrame(rows, "id long, key string")
    table = spark.createDataFrame([("hot", 1), *[(c, ord(c)) for c in "abcdefg"]], "key string, v int")
    for how in ("left", "inner"):
        want = sorted(map(tuple, df.join(table, "key", how).select("id", "key", "v").collect()))
        assert sorted(map(tuple, salted(df, "key", table, "id", rows=20, how=how).select("id", "key", "v").collect())) == want


def test_blocks_of_a_dominant_cell(spark):
    """Every pair of a row and a query of a cell meets once, and no block is over its size by much, also where both sides have as many blocks."""
    rows = spark.range(4000, numPartitions=3).select(F.col("id").alias("vec_id"), F.when(F.col("id") < 3900, 0).otherwise(1).alias("cell"), F.lit(b"c").alias("codes"), F.lit(b"r").alias("raw"))
    asked = spark.range(1000, numPartitions=2).select(F.col("id").alias("query_id"), F.lit(b"q").alias("q"), F.when(F.col("id") < 990, 0).otherwise(1).alias("cell"))
    left, right = ann.dealt(asked, rows, 1000)
    sizes = {tuple(r)[:3]: r["count"] for r in right.groupBy("cell", "qb", "cb").count().collect()}
    assert len({k for k in sizes if k[0] == 0}) == 16 and max(sizes.values()) <= 1100 and max(r["count"] for r in left.groupBy("cell", "qb", "cb").count().collect()) <= 300
    met = left.join(right, ["cell", "qb", "cb"]).groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("query_id", "vec_id").alias("m")).collect()
    assert {(r["cell"], r["n"], r["m"]) for r in met} == {(0, 3900 * 990, 3900 * 990), (1, 1000, 1000)}
