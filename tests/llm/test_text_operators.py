"""Operators on text against brute force, with nulls, empties, long texts, repeats, ties, empty tables and clashing columns."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tokenizers
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import packing, pieces, pii, quality, repetition, simhash, toxicity

DOCS = "doc_id long, text string, fp string, _text int, key string, y int, component string, x double"
BPE, PIECES = (public_tokenizers.path(p) for p in ("byte_bpe_50k.json", "piece_bpe_32k.model"))


def docs_of(spark, texts):
    return spark.createDataFrame([(k, t, "a", 1, "b", 2, "c", 0.5) for k, t in texts], DOCS)


def some_texts(seed=1, n=60):
    rng = random.Random(seed)
    words = ["the", "of", "tion", "Éa", "wher.", "und", "x1", "#$%", "日本", "a\nb", "ab\tc", "🙂"]
    return [" ".join(rng.choice(words) for _ in range(rng.randrange(0, 80))) for _ in range(n)]


EDGE = [None, "", " ", "  \n ", "a", "x" * 5000, "<|endoftext|> a  b", "a" + " " * 40 + "b", "\x00 a"]


@pytest.fixture(scope="module")
def corpus(spark):
    texts = EDGE + some_texts() + some_texts()[:5] + ["long " * 30000]
    rows = list(enumerate(texts)) + [(3, texts[3]), (20, texts[20])]
    return rows, docs_of(spark, rows).cache()


def test_packing_round_trip(spark, corpus):
    rows, df = corpus
    tok = tokenizers.Tokenizer.from_file(BPE)
    out = packing.pack(df, BPE, max_tokens=256, group_tokens=3000).collect()
    want = Counter((k, tuple([*tok.encode(t or "", add_special_tokens=False).ids, 1])) for k, t in rows)
    by_seq, by_doc = {}, {}
    for r in out:
        ids = np.frombuffer(r["ids"], "<u4")
        assert len(ids) == r["length"] <= 256
        by_seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        by_doc.setdefault((r["doc_id"], r["doc_tokens"]), []).append((r["start"], tuple(ids.tolist())))
    for places in by_seq.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at & (at - 1) == 0 and at <= 256  # nothing to pad
    for (k, n), parts in by_doc.items():
        whole = next(w for w in want if w[0] == k and len(w[1]) == n)
        copies = want[whole]
        assert sum(len(p) for _, p in parts) == n * copies
        for start, p in parts:
            assert whole[1][start : start + len(p)] == p
    assert packing.pack(df.limit(0), BPE).count() == 0


def test_assign_uses_all_places():
    rng = random.Random(3)
    for _ in range(50):
        lengths = [rng.randrange(1, 700) for _ in range(rng.randrange(1, 40))]
        got, n = packing.assign(lengths, 256, 1.0, 1 / 256)
        fill = Counter()
        for _, _, size, s, _ in got:
            fill[s] += size
        assert len(fill) == n and sum(fill.values()) == sum(lengths) and all(v & (v - 1) == 0 for v in fill.values())


def test_assign_finds_the_one_with_room():
    lengths = [200] + [101] * 80 + [56] + [1] * 2160  # forty cheaper sequences have 54 places left, the dearest has 56
    got, n = packing.assign(lengths, 256, 1.0, 1 / 256)
    assert n == 41 and [(k, s) for d, s, k, *_ in got if d == 81] == [(56, 0)]


def test_pieces_match_the_library(spark, corpus):
    rows, df = corpus
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = Counter((r["doc_id"], r["n_tokens"], r["ids"], r["decoded"]) for r in pieces.encode(df, PIECES).collect())
    want = Counter()
    for k, t in rows:
        ids = [*sp.encode(t or ""), sp.eos_id()]
        want[(k, len(ids), " ".join(map(str, ids)), sp.decode(ids))] += 1
    assert got == want
    enc = pieces.encoder(PIECES)
    rng = random.Random(5)
    vocab = [p.replace("▁", " ") for p in list(enc.id_of)[:4000]]
    for _ in range(2000):
        t = "".join(rng.choice(vocab) for _ in range(rng.randrange(1, 12)))
        ids, plain = enc.encode(t)
        assert ids == " ".join(map(str, [*sp.encode(t), sp.eos_id()])) and plain == enc.decode(ids) == sp.decode([int(i) for i in ids.split()])
    small = pieces.encode(df, PIECES, texts=False).where("doc_id = 1").first()
    assert small["ids_sha256"] == hashlib.sha256(b"2").hexdigest() and pieces.encode(df.limit(0), PIECES).count() == 0


def test_pieces_decode_the_ids_given():
    enc = pieces.PieceEncoder(PIECES)
    assert enc.encode("a   b é  \U0001f9ff ")[1] == "a   b é  \U0001f9ff "
    enc._run = lambda n: [pieces.SPACE] * (n + 1)  # wrong ids for runs of spaces must show in the text
    ids, text = enc.encode("a   b")
    assert text == enc.decode(ids) != "a   b"


def brute_repeats(ws):
    n = len(ws)
    out = [0] * n
    for i in range(n):
        for j in range(n):
            k = 0
            while i != j and max(i, j) + k < n and ws[i + k] == ws[j + k]:
                k += 1
            out[i] = max(out[i], k)
    return out


def test_repetition_against_brute_force(spark):
    rng = random.Random(6)
    texts = [" ".join(rng.choice("abcd"[: rng.randrange(1, 5)]) for _ in range(rng.randrange(0, 40))) for _ in range(60)] + [None, "a\nb\na\n \n \na", "# |x|"]
    out = {r["doc_id"]: r for r in repetition.judge(docs_of(spark, list(enumerate(texts))), least_repeat=4, max_fraction=0.5, max_longest=9).collect()}
    for k, t in enumerate(texts):
        ws = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        depth = brute_repeats(ws)
        windows = Counter(tuple(ws[i : i + 3]) for i in range(len(ws) - 2))
        in_window = {i + d for i in range(len(ws) - 2) if windows[tuple(ws[i : i + 3])] > 1 for d in range(3)}
        covered = {i + d for i, m in enumerate(depth) if m >= 4 for d in range(m)}
        r = out[k]
        failed = len(ws) < 50 or 100 * len(in_window) > 50 * len(ws)
        assert (r["n_words"], r["n_repeat_words"], r["covered_words"], r["longest_repeat"]) == (len(ws), len(in_window), len(covered), max(depth, default=0))
        assert r["word_chars"] == sum(map(len, ws)) and r["base_failed"] == failed
    assert (out[61]["n_dup_lines"], out[62]["n_symbols"]) == (2, 3)
    long = {r["doc_id"]: r for r in repetition.judge(docs_of(spark, [(1, "w " * 50000), (2, " ".join(map(str, range(2000))))])).collect()}
    assert long[1]["base_failed"] and long[2]["kept"] and repetition.judge(docs_of(spark, [])).count() == 0


def brute_print(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    ws = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(ws[i : i + 4]) for i in range(len(ws) - 3)] or ([" ".join(ws)] if ws else [])
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if hs and 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_near_duplicates_against_brute_force(spark, corpus):
    rows, _ = corpus
    base = " ".join(f"w{k}" for k in range(200))
    near = [(500 + k, base.replace(f"w{k * 3} ", f"v{k} ")) for k in range(40)] + [(700 + k, base) for k in range(5)]
    rows = [(k, t) for k, t in rows if t is None or len(t) < 5000] + near
    got = simhash.near_duplicates(docs_of(spark, rows)).collect()
    fp = {k: brute_print(t) for k, t in rows}
    root = {k: k for k in fp}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(fp)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if bin(fp[a] ^ fp[b]).count("1") <= 4:
                ra, rb = find(a), find(b)
                root[max(ra, rb)] = min(ra, rb)
    assert len(got) == len(rows)
    for r in got:
        assert r["fingerprint"] == f"{fp[r['doc_id']]:016x}" and r["component_id"] == find(r["doc_id"])
    assert simhash.near_duplicates(docs_of(spark, [])).count() == 0


@pytest.mark.parametrize("budget", [1, 2, 4])
def test_ring_finds_every_pair_within_budget(budget):
    rng, ring = random.Random(8), simhash.Ring(budget)
    for _ in range(1500):
        x = sum(1 << b for b in rng.sample(range(64), rng.randrange(0, budget + 1)))
        starts = [s for s in range(ring.n) if len(ring.near(np.array([x], np.uint64), np.array([s])))]
        assert starts and all(any(x & m == 0 for m in ring.masks(s, chain)) for s in starts for chain in ring.chains)
        y = sum(1 << b for b in rng.sample(range(64), budget + 1))
        assert not any(len(ring.near(np.array([y], np.uint64), np.array([s]))) for s in range(ring.n))
    assert ring.chains == {1: [2], 2: [5], 4: [5, 8, 11]}[budget]


def groups_of(links, nodes):
    root = {k: k for k in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        ra, rb = find(a), find(b)
        root[max(ra, rb)] = min(ra, rb)
    return {k: find(k) for k in nodes}


@pytest.mark.parametrize("bounds, chains", [(simhash.Bounds(), [5]), (simhash.Bounds(block_rows=50, lags=8, groups=3, run_rows=20), [5, 8, 11]), (simhash.Bounds(block_rows=2000, lags=8, groups=10, run_rows=40), [5, 8, 11])])
def test_hot_keys_go_on_to_longer_chains(spark, monkeypatch, bounds, chains):
    used, links = [], simhash._links
    monkeypatch.setattr(simhash, "_links", lambda rows, ring, chain, *more: used.append(chain) or links(rows, ring, chain, *more))
    rng = random.Random(4)
    low = {rng.getrandbits(64) >> 44 for _ in range(400)}  # equal in 44 bits: hot in most chains, few links
    same = {(0xABCDEF << 40) | rng.getrandbits(26) << rng.randrange(0, 14) for _ in range(200)}
    pairs = {x ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 6))) for x in [*low, *same] if rng.random() < 0.2}
    fps = sorted(low | same | pairs)
    want = groups_of([(a, b) for i, a in enumerate(fps) for b in fps[:i] if (a ^ b).bit_count() <= 4], fps)
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in fps]
    found = simhash.near_links(spark.createDataFrame(signed, "fp long"), simhash.Ring(4), bounds).collect()
    found = [(r["a"] % (1 << 64), r["b"] % (1 << 64)) for r in found]
    assert used == chains and all((a ^ b).bit_count() <= 4 for a, b in found) and groups_of(found, fps) == want


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(s):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(s))) % 10 == 0


def base_spans(t):
    out = []
    for kind, p in PATTERNS.items():
        for m in re.finditer(p, t, re.A):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else True, "card": 16 <= len(d) <= 19 and luhn(d) if kind == "card" else True, "phone": 8 <= len(d) <= 15}[kind]
            if ok:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


@pytest.fixture(scope="module")
def trees(spark):
    return pii.Trees(spark, n=1500, rounds=4)


def test_personal_data(spark, trees):
    rng = random.Random(9)
    alphabet = "a.1@2-+ (3)0日🙂b5.9"
    texts = [None, "", "x@y.z@w.v", "x@a.b_c@d.e", "1.2.3.4.5.6.7.8 0000255.1.1.1 256.1.1.1", "4111 1111 1111 1111 4111-1111-1111-1112", "+1 (523) 555-1055. +1((((", "日a@b.c🙂 d@e.f", "a@" + "b." * 30000 + "c", "1" * 20000, "9." * 20000, "u" * 50000]
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 60))) for _ in range(400)]
    texts += [" ".join(f"u{k}@mail.example.com" for k in range(3000))]
    rows = list(enumerate(texts)) + [(4, texts[4])]
    got = pii.find(docs_of(spark, rows), trees).select("doc_id", "text", pii.spelled(F.col("base")).alias("b"), pii.spelled(F.col("spans")).alias("s"), pii.redacted(F.col("text"), F.col("spans")).alias("r")).collect()
    assert len(got) == len(rows)
    for r in got:
        want = base_spans(texts[r["doc_id"]] or "")
        assert [x for x in r["b"].split(",") if x] == want
        assert set(want) <= {x for x in r["s"].split(",") if x}
    by = {r["doc_id"]: r for r in got}
    assert by[7]["r"] == "日[EMAIL]🙂 [EMAIL]" and by[0]["r"] == "" and "u1@" not in by[412]["r"]
    assert pii.find(docs_of(spark, []), trees).count() == 0


def test_trees_add_what_the_patterns_miss(spark, trees):
    texts = [(1, "call (523) 555-1055 now"), (2, "write to anna at example dot com please"), (3, "order 2019-02-18 done"), (4, "we look at the. The end")]
    got = {r["doc_id"]: r["s"] for r in pii.find(docs_of(spark, texts), trees).select("doc_id", pii.spelled(F.col("spans")).alias("s")).collect()}
    assert got[1].startswith("phone:") and got[2].startswith("email:") and got[3] == got[4] == ""


def labelled(seed=10, n=700):
    rng = random.Random(seed)
    words = [a + b + c for a in ("the", "er", "tion", "an", "re") for b in ("on", "at", "is", "") for c in ("ed", "ing", "ly", "s")]
    bad = ["idiotic", "wretched", "loathsome", "vermin"]
    rows = []
    for k in range(n):
        ws = [rng.choice(words) for _ in range(rng.randrange(20, 120))]
        toxic, good = int(k % 5 == 0), int(k % 3 != 0)
        if toxic:
            for _ in range(4):
                ws.insert(rng.randrange(len(ws)), rng.choice(bad))
        if not good:
            ws = [w.upper() + "!!" for w in ws]
        rows.append((k, " ".join(ws), toxic, good))
    return rows


def test_toxicity_on_held_out_rows(spark):
    rows = labelled()
    lower = [(k, t.lower()) for k, t, _, _ in rows] + [(900, None), (901, ""), (902, "w" * 20000), (3, rows[3][1].lower())]
    y = spark.createDataFrame([(k, v) for k, _, v, _ in rows] + [(0, None), (5, 1)], "doc_id long, toxic int")
    got = toxicity.classify(docs_of(spark, lower), y, F.col("doc_id") % 4 != 1).collect()
    assert len(got) == len(lower)
    by = {r["doc_id"]: r for r in got}
    held = [k for k in range(len(rows)) if k % 4 == 1]
    assert np.mean([by[k]["predicted"] == rows[k][2] for k in held]) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got) and by[900]["score"] == by[901]["score"]
    alone = toxicity.classify(docs_of(spark, lower[:5]), y.where("toxic = 0"), F.lit(True)).collect()
    assert {r["predicted"] for r in alone} == {0} and toxicity.classify(docs_of(spark, []), y.limit(0), F.lit(True)).count() == 0


def test_quality_on_held_out_rows(spark):
    rows = labelled(11)
    docs = docs_of(spark, [(k, t) for k, t, _, _ in rows] + [(900, None), (901, ""), (902, "w" * 20000), (3, rows[3][1])])
    y = spark.createDataFrame([(k, v) for k, _, _, v in rows] + [(7, None)], "doc_id long, quality int")
    got = quality.classify(docs, y, F.col("doc_id") % 4 != 1).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == len(rows) + 4 and np.mean([by[k]["predicted"] == rows[k][3] for k in range(len(rows)) if k % 4 == 1]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)
    none = quality.classify(docs, y.limit(0), F.lit(True)).first()
    assert none["score"] == 0.5 and quality.classify(docs_of(spark, []), y, F.lit(True)).count() == 0
