"""The registered queries of operators 2, 3, 6 and 8 and of the pipeline against plain Python over the same tables."""

import math
import random
import zlib
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import language, packing, pii, quality, queries, simhash, toxicity, urls
from tidemark.llm.shared import fold, read, tokenizer_path

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    return {t: [r.asDict() for r in read(spark, SF, t).collect()] for t in ("documents", "labels", "pages")}


def remainder(i, n):
    return zlib.crc32(str(i).encode()) % n


def toxic_features(saved, thresholds):
    best = [*sorted((x for x in saved if x > 0), reverse=True), 0, 0][:2]
    over = [sum(x >= t for x in saved) for t in thresholds]
    return [*map(math.log1p, best), *map(math.log1p, over), *[k > 0 for k in over], -math.log1p(len(saved)), sum(x for x in saved if x > 0) / len(saved)]


def test_toxicity_query(spark):
    """Scores by the fitted dictionaries, and the thresholds and weights of fit(), worked out again from the windows' lengths."""
    sf = "/root/testdata/sf0.01"
    docs, labels = read(spark, sf, "documents"), read(spark, sf, "labels")
    model = toxicity.fit(docs, labels.where(fold("doc_id", 5) != 0))
    assert model.ordinary[:4] == model.toxic[:4] == b"\x37\xa4\x30\xec"  # zstandard's mark of a trained dictionary
    got = {r["doc_id"]: r for r in queries.op2_toxicity(spark, sf).collect()}
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    assert len(got) == len(texts)
    m, saved = model.measure(), {}
    for i, text in texts.items():
        b = b" " + " ".join(text.lower().split()).encode() + b" "
        own, at = [], 0
        while at < len(b):
            cut = b.find(b" ", at + model.window)
            cut = len(b) if cut < 0 else cut + 1
            own += [len(m.ordinary(b[max(0, k - 1) : min(cut, k + 4096)])) - len(m.toxic(b[max(0, k - 1) : min(cut, k + 4096)])) for k in range(at, cut, 4096)]
            at = cut
        saved[i] = own
        want = 1 / (1 + math.exp(-(model.weights[0] + float(np.dot(toxic_features(own, model.thresholds), model.weights[1:])))))
        r = got[i]
        assert abs(r["score"] - want) < 1e-9 and r["predicted"] == int(want >= 0.5) and r["held_out"] == (remainder(i, 5) == 0)
    learnt = {r["doc_id"]: r["toxic"] for r in labels.collect() if r["toxic"] in (0, 1) and remainder(r["doc_id"], 5) and r["doc_id"] in texts}
    best, y = np.array([max(0, *saved[i]) for i in learnt]), np.array(list(learnt.values()), float)
    for level, t in zip(toxicity.LEVELS, model.thresholds):
        share = lambda t: y[best >= t].mean() if (best >= t).any() else 1.0
        assert share(t) >= level and all(share(k) < level for k in range(1, t))
    x = np.array([[1.0, *toxic_features(saved[i], model.thresholds)] for i in learnt])
    p = 1 / (1 + np.exp(-x @ model.weights))
    assert np.abs(x.T @ (p - y) + model.weights).max() < 1e-3  # the penalised likelihood is at its peak


def test_calibrated_thresholds():
    best, y = np.array([0, 0, 1, 2, 2, 3, 4, 4]), np.array([0, 0, 0, 0, 1, 1, 1, 1.0])
    assert toxicity.calibrated(best, y, np.ones(8), (0.5, 0.8, 0.95, 1.0)) == (1, 2, 3, 3)
    assert toxicity.calibrated(best, y * 0, np.ones(8), (0.5,)) == (5,)  # no text saves five bytes


def test_both_dictionaries_are_trained():
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(400)]
    ordinary = [(" ".join(rng.choice(words) for _ in range(80))).encode() for _ in range(300)]
    own = ["".join(rng.choice("uvwxyz") for _ in range(12)).encode() for _ in range(20)]
    toxic = [t + b" " + own[k % 20] + b" " + u for k, (t, u) in enumerate(zip(ordinary[:150], ordinary[150:]))]
    runs = toxicity.own_runs(toxic, ordinary, (6, 8), 0.02, 10.0)
    # by hand: bytes of a toxic text that some piece covers which enough toxic texts hold, and none of the ordinary ones
    for t in toxic[:20]:
        marks = [False] * len(t)
        for n in (6, 8):
            for k in range(len(t) - n + 1):
                piece = t[k : k + n]
                if (held := sum(piece in u for u in toxic)) >= max(4, 0.02 * 150) and held / 150 > 10 * (sum(piece in u for u in ordinary) + 1) / 300:
                    marks[k : k + n] = [True] * n
        found = bytes(c if m else 10 for c, m in zip(t, marks)).split(b"\n")
        assert {r for r in found if r} <= set(runs)
    assert toxicity.trained(2048, ordinary, 64)[:4] == toxicity.trained(256, [b"".join(runs[k : k + 16]) for k in range(0, len(runs), 16)], 16)[:4] == b"\x37\xa4\x30\xec"
    assert toxicity.trained(2048, [], 64) is None is toxicity.trained(2048, [b"one sample only"], 64)


def test_url_query_and_miner(spark, tables):
    rng = random.Random(8)
    rows = []
    for _ in range(3000):
        items = {f"t{rng.randrange(12)}" for _ in range(4)}
        rows.append((sorted(items), rng.random() < (0.9 if {"t1", "t2"} <= items else 0.6 if "t3" in items else 0.2)))
    found = urls.mine(spark.createDataFrame(rows, "tokens array<string>, bad boolean"))
    base, sets = sum(b for _, b in rows) / len(rows), {}
    for items, bad in rows:
        for size in range(1, 5):
            for c in combinations(items, size):
                n = sets.setdefault(c, [0, 0])
                n[0] += 1
                n[1] += bad
    frequent = {c: n for c, n in sets.items() if n[1] >= 5}
    want = {}
    for c, (n, bad) in frequent.items():
        p = bad / n
        kl = p * math.log(p / base) + ((1 - p) * math.log((1 - p) / (1 - base)) if p < 1 else 0)
        if p >= 0.6 and p > base and n * kl >= math.log(len(frequent) / 0.05):
            want[c] = p
    want = {c: p for c, p in want.items() if not any(set(d) < set(c) and want[d] >= p for d in want)}
    got = {tuple(r["antecedent"]): r["confidence"] for r in found.rules.collect()}
    assert want and got.keys() == want.keys() and all(abs(got[c] - want[c]) < 1e-12 for c in got)
    asked = spark.createDataFrame([(str(k), items) for k, (items, _) in enumerate(rows[:400])], "url string, tokens array<string>")
    hits = {r["url"]: r["confidence"] for r in urls.matched(asked, found).collect()}
    brute = {str(k): max(ps) for k, (items, _) in enumerate(rows[:400]) if (ps := [p for c, p in want.items() if set(c) <= set(items)])}
    assert hits.keys() == brute.keys() and all(abs(hits[k] - brute[k]) < 1e-12 for k in hits)
    verdicts = {r["page_id"]: r for r in queries.op3_urls(spark, SF).collect()}
    for p in tables["pages"]:
        host, _, path = ("", "", "") if "://" not in (p["url"] or "") else p["url"].split("://", 1)[1].partition("/")
        host, path = host.lower(), "/" + path.split("?")[0].split("#")[0] if path or "/" in (p["url"] or "").split("://", 1)[-1] else ""
        fits = [k for k in queries.URL_RULES if (host == (h := k.split("/", 1)[0]) or host.endswith("." + h)) and path.startswith(k[len(h) :])]
        rule = max(fits, key=len) if fits else None
        assert verdicts[p["page_id"]]["rule"] == rule and (rule is None or verdicts[p["page_id"]]["verdict"] == queries.URL_RULES[rule])


def test_urls_of_odd_tables(spark):
    pages = spark.createDataFrame([(1, "http://a.b/" + "x/" * 50_000), (2, None)], "page_id long, url string")
    none = spark.createDataFrame([], "url string, bad boolean")
    got = {r["page_id"]: r for r in urls.judge(pages, {"b/x/": "block"}, none).collect()}
    assert got[1]["rule"] == "b/x/" and len(got[1]["path"]) == 100_001 and got[2]["verdict"] == "allow"
    assert urls.judge(pages.limit(0), {}, none).count() == 0 and urls.judge(pages, {}, none).count() == 2


def softmax(x):
    e = np.exp(np.array(x) - max(x))
    return e / e.sum()


def test_language_query(spark, tables):
    profiles = language.fit(read(spark, SF, "documents"))
    got = {r["doc_id"]: r for r in queries.op6_language(spark, SF).collect()}
    langs, docs = profiles.languages, {d["doc_id"]: d for d in tables["documents"]}
    t = {k: profiles.scores(d["text"] or "") for k, d in docs.items()}
    sure = {k: langs[int(np.argmax(v))] for k, v in t.items() if v and softmax(v).max() >= 0.9}
    evidence = [r.asDict() for r in language.page_evidence(read(spark, SF, "pages"), queries.document_number(F.col("path"))).collect()]
    known = lambda v: v if v is None or v in langs else "other"
    evidence = [e | {"declared": known(e["declared"]), "suffix": known(e["suffix"])} for e in evidence]
    paged = {e["doc"] for e in evidence}
    total = [sum(v == x for v in sure.values()) for x in langs]
    base = np.array([(c + 1) / (sum(total) + len(langs)) for c in total])

    def chances(c):
        values = [*langs, "other"]
        n = {v: np.array([sum(e[c] == v and sure.get(e["doc"]) == x for e in evidence) for x in langs], float) for v in values}
        all_ = sum(n.values())
        return {v: np.log((n[v] + 0.5) / (all_ + 0.5 * len(values))) for v in values} | {None: None}

    seen = [(e["host"], sure[e["doc"]]) for e in evidence if e["doc"] in sure and e["host"]] + [(d["source"], sure[k]) for k, d in docs.items() if k in sure and k not in paged]
    domain = lambda h: ".".join(h.split(".")[-2:])
    counts = lambda key, at: np.array([sum(key(h) == at and v == x for h, v in seen) for x in langs], float)

    def prior(h):
        if not any(h == g for g, _ in seen):
            return None
        d, own = counts(domain, domain(h)), counts(lambda x: x, h)
        d = (d + 5 * base) / (d.sum() + 5)
        return np.log((own + 10 * d) / (own.sum() + 10) / base)

    declared, suffix = chances("declared"), chances("suffix")
    for k, d in docs.items():
        own = [e for e in evidence if e["doc"] == k]
        mean = lambda xs: np.mean(xs, axis=0) if (xs := [x for x in xs if x is not None]) else 0.0
        more = mean([prior(e["host"]) for e in own]) + mean([declared[e["declared"]] for e in own]) + mean([suffix[e["suffix"]] for e in own]) if own else prior(d["source"])
        if t[k] is None:
            assert got[k]["lang"] is None and not got[k]["kept"]
            continue
        p = softmax(np.array(t[k]) + np.log(base) + (0 if more is None else more))
        assert abs(got[k]["posterior"] - p.max()) < 1e-6 and got[k]["lang"] == langs[int(np.argmax(p))] and got[k]["kept"] == (p.max() >= 0.5)


def test_every_language_has_a_profile(spark):
    rows = [(k, f"{chr(97 + k % 26)}{chr(97 + k // 26)}wort " * 12, f"l{k:03d}") for k in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    profiles = language.fit(docs)
    got = {r["doc_id"]: r["lang"] for r in language.identify(docs, profiles, host_col=None).collect()}
    assert len(profiles.languages) == 90 and got == {k: x for k, _, x in rows}
    with pytest.raises(ValueError):
        language.fit(docs, most_languages=80)


def test_quality_query(spark, tables):
    got = {r["doc_id"]: r for r in queries.op8_quality(spark, SF).collect()}
    label = {r["doc_id"]: r["quality"] for r in tables["labels"] if r["quality"] in (0, 1) and remainder(r["doc_id"], 3) != 1}
    x = {d["doc_id"]: np.array(quality.statistics(d["text"] or ""), float) for d in tables["documents"]}
    ids = [k for k in x if k in label]
    a, y = np.array([x[k] for k in ids]), np.array([label[k] for k in ids], float)
    folds = {r["doc_id"]: r["f"] for r in read(spark, SF, "documents").select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(4)).alias("f")).collect()}
    of = np.array([folds[k] for k in ids])
    dims, rng = a.shape[1], np.random.default_rng(11)
    omega, phase = rng.normal(0, np.sqrt(2 * 0.15 / dims * 4), (dims, 256)), rng.uniform(0, 2 * np.pi, 256)
    features = lambda m: np.c_[np.ones(len(m)), np.sqrt(2 / 256) * np.cos(np.clip((m - a.mean(0)) / np.maximum(a.std(0), 1e-6), -8, 8) @ omega + phase)]

    def ridge(f, t):
        g = f.T @ f
        return np.linalg.solve(g + (1e-3 * max(1.0, g[0, 0]) + 1e-3) * np.diag([0.0] + [1.0] * 256) + 1e-9 * np.eye(257), f.T @ t)

    f, out = features(a), np.zeros(len(ids))
    for k in range(4):
        out[of == k] = f[of == k] @ ridge(f[of != k], y[of != k])
    bins = np.clip(np.floor((out + 0.5) * 500), 0, 999)
    steps = [((b + 0.5) / 500 - 0.5, y[bins == b].sum(), (bins == b).sum()) for b in sorted(set(bins))]
    blocks = []
    for at, ones, n in steps:
        blocks.append([at * n, ones, n])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last)]
    want = np.interp(features(np.array([x[k] for k in got])) @ ridge(f, y), [b[0] / b[2] for b in blocks], [b[1] / b[2] for b in blocks])
    assert all(abs(got[k]["score"] - w) < 1e-6 and got[k]["held_out"] == (remainder(k, 3) == 1) for k, w in zip(got, want))


def test_pipeline_query(spark, tables):
    """The rows of run() follow from the operators' own results, applied in order in plain Python."""
    docs = read(spark, SF, "documents")
    kept = {r["doc_id"]: r["lang"] for r in queries.identified(spark, docs, SF).where("kept").collect()}
    rows = [d | {"lang": kept[d["doc_id"]]} for d in tables["documents"] if d["doc_id"] in kept]
    frame = lambda rs: spark.createDataFrame([tuple(r[c] for c in corpus_pipeline.COLUMNS) for r in rs], docs.select(*corpus_pipeline.COLUMNS).schema)
    good = {r["doc_id"] for r in quality.classify(frame(rows), read(spark, SF, "labels"), fold("doc_id", 3) != 1).where("predicted = 1").collect()}
    rows = [r for r in rows if r["doc_id"] in good]
    prints = {r["doc_id"]: simhash.fingerprint(r["text"] or "", 5) for r in rows}
    root = {k: k for k in prints}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in combinations(sorted(prints), 2):
        if (prints[a] ^ prints[b]).bit_count() <= 6:
            ra, rb = find(a), find(b)
            root[max(ra, rb)] = min(ra, rb)
    rows = [r for r in rows if find(r["doc_id"]) == r["doc_id"]]
    clean = {r["doc_id"]: r for r in pii.find(frame(rows), pii.Trees(spark)).select("doc_id", pii.redacted(F.col("text"), F.col("spans")).alias("text")).collect()}
    bpe = packing.ByteBpe(tokenizer_path("byte_bpe_50k.json"))
    want = {k: np.array([*bpe.encode(r["text"]), 1], "<u4").tobytes() for k, r in clean.items()}
    pieces, places = {}, {}
    for r in corpus_pipeline.run(spark, SF).collect():
        pieces.setdefault(r["doc_id"], []).append((r["start"], bytes(r["ids"])))
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert {k: b"".join(x for _, x in sorted(v)) for k, v in pieces.items()} == want
    for v in places.values():
        ends = [0, *np.cumsum([n for _, n in sorted(v)])]
        assert [a for a, _ in sorted(v)] == ends[:-1] and ends[-1] <= 2048
