"""Operators 11, 12 and 13 against plain Python."""

import bisect
import random
import re
import zlib
from collections import Counter
from math import floor, log

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import codes, lexical, slots
from tidemark.llm.shared import tokenizer_path

SF = "/root/testdata/sf0.001"
VOCABULARY = "byte_bpe_50k.json"


def best_fit(lengths, size):
    """Sequences of best-fit decreasing, a piece at a time."""
    room, n = [], 0
    for x in sorted(lengths, reverse=True):
        at = bisect.bisect_left(room, x)
        if at < len(room):
            free = room.pop(at)
        else:
            free, n = size, n + 1
        bisect.insort(room, free - x)
    return n


@pytest.mark.parametrize("seed", range(12))
def test_plan_is_best_fit(seed):
    rng = random.Random(seed)
    size = rng.choice([1, 7, 64, 1024])
    lengths = [min(size, 1 + int(rng.expovariate(1) * size * rng.choice([0.05, 0.3, 0.8]))) for _ in range(rng.choice([0, 1, 50, 3000]))]
    counts = Counter(lengths)
    runs, used = slots.planned(counts, size)
    assert used == best_fit(lengths, size)
    taken, ranks = {}, Counter()
    for n, rank, first, each, offset in sorted(runs):
        assert rank == ranks[n]
        total = min(counts[n] - rank, min((r[1] for r in runs if r[0] == n and r[1] > rank), default=counts[n]) - rank)
        for q in range(total):
            taken.setdefault(first + q // each, []).append((offset + q % each * n, n))
        ranks[n] += total
    assert ranks == counts
    assert sorted(taken) == list(range(used))
    for row in taken.values():
        row.sort()
        assert row[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(row, row[1:])) and sum(n for _, n in row) <= size


def check_pack(rows, texts, size):
    t = Tokenizer.from_file(tokenizer_path(VOCABULARY))
    want = Counter()
    for doc, text in texts:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        cuts = [0, *range(len(ids) % size or size, len(ids) + 1, size)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[doc, k, a, b - a, np.array(ids[a:b], "<u4").tobytes()] += 1
    assert Counter((r[0], r.piece, r.start, r.length, bytes(r.ids)) for r in rows) == want
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in by.values():
        s.sort()
        assert s[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(s, s[1:])) and sum(n for _, n in s) <= size
    assert len(by) == best_fit([r.length for r in rows], size)


@pytest.mark.parametrize("broadcast_rows", [0, slots.BROADCAST_ROWS])
def test_pack(spark, broadcast_rows):
    rng = random.Random(5)
    texts = [(i, " ".join(rng.choice(["sea", "tide", "x<|endoftext|>y", "größe", "12345"]) for _ in range(int(rng.expovariate(0.02))))) for i in range(300)]
    texts += [(7, None), (None, "no id"), (8, ""), (9, "tide " * 5000), *[(10, "same text")] * 90, *[(k, "equal length") for k in range(400, 600)]]
    docs = spark.createDataFrame([Row(doc_id=i, text=t, piece="p", task=1, length="l", ids=None) for i, t in texts], "doc_id long, text string, piece string, task int, length string, ids string").repartition(5)
    check_pack(slots.pack(docs, tokenizer_path(VOCABULARY), max_tokens=64, broadcast_rows=broadcast_rows).collect(), texts, 64)


def test_pack_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    check_pack(slots.pack(docs, tokenizer_path(VOCABULARY)).collect(), [(r.doc_id, r.text) for r in docs.collect()], 1024)
    assert slots.pack(docs.limit(0), tokenizer_path(VOCABULARY)).collect() == []
    import __spark_entry__

    got = {(r.doc_id, r.piece): r.ids_crc32 for r in __spark_entry__.queries()["op11_bestfit"](spark, SF).collect()}
    ids = {(r.doc_id, r.piece): zlib.crc32(r.ids) for r in slots.pack(docs, tokenizer_path(VOCABULARY)).collect()}
    assert got == ids


def brute_search(docs, items, k):
    word = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    of = lambda t: word.findall((t or "").translate(lower))
    counts = [Counter(of(t)) for _, t in docs]
    n_docs, n_terms = sum(bool(c) for c in counts), sum(c.total() for c in counts)
    df = Counter(t for c in counts for t in c)
    out = []
    for item, text in items:
        scored = []
        for (doc, _), c in zip(docs, counts):
            m = 50 + (50 * c.total() * n_docs) // n_terms if n_terms else 0
            s = sum(floor(1000 * log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(of(text)) if t in c)
            if s > 0:
                scored.append((-s, doc is None, doc))
        out += [(item, rank, doc, -s) for rank, (s, _, doc) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return Counter(out)


@pytest.mark.parametrize(("window", "shard_docs", "block_items"), [(4, 10, 2), (1024, 65_536, 1000), (3, 1, 1)])
def test_search(spark, window, shard_docs, block_items):
    rng = random.Random(window)
    words = ["sea", "SEA", "tide", "İ", "größe", "Größe", "a1", "b-2", "wind", "salt", " ", "x\x00y"]
    docs = [(i, " ".join(rng.choices(words, k=rng.randrange(12)))) for i in range(120)]
    docs += [(3, None), (None, "tide salt"), (None, "tide"), (5, ""), (6, "..."), *[(50, "tide salt sea")] * 40, (51, "tide " * 4000), *[(k, "salt") for k in range(200, 230)]]
    items = [(1, "Tide, salt!"), (2, None), (3, ""), (4, "nothing here"), (5, "größe GRÖSSE sea"), (5, "größe GRÖSSE sea"), (5, "wind"), (None, "a1 b 2 y x"), (7, "tide tide tide")]
    d = spark.createDataFrame([(*x, "z", 1, 2) for x in docs], "doc_id long, text string, item_id string, rank int, n int").repartition(4)
    i = spark.createDataFrame([(*x, "z", 1) for x in items], "item_id long, text string, doc_id string, score int")
    got = lexical.search(d, i, k=10, window=window, shard_docs=shard_docs, block_items=block_items)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert Counter(map(tuple, got.collect())) == brute_search(docs, items, 10)
    assert lexical.search(d.limit(0), i).collect() == [] == lexical.search(d, i.limit(0)).collect()


def test_wand_skips(spark):
    """Windows without a chance are not visited: with the best documents first, a rare term ends the search."""
    docs, per = 4096, 64
    place = np.concatenate([np.arange(docs), np.arange(64)])
    term = np.concatenate([np.zeros(docs, np.int64), np.ones(64, np.int64)])
    shard = lexical.Shard(np.arange(docs), np.zeros(docs, bool), np.full(docs, 100), place, term, np.ones(len(term), np.int64), np.array([1, 9000]), per)
    best, visited = lexical.Best(50), []
    add = best.add
    best.add = lambda *a: (visited.append(len(a[0])), add(*a))
    shard.search(np.array([0, 1]), best)
    assert len(visited) == 1 and best.doc.tolist() == list(range(50))


def brute_codes(rows, rounds=2, entries=64, parts=16):
    rows = [(i, None if v is None else np.floor(256 * np.array([np.nan if x is None else x for x in v], np.float64)), lab) for i, v, lab in rows]
    rows = [(i, v, lab) for i, v, lab in rows if v is not None and len(v) and np.isfinite(v).all()]
    commonest = max(Counter(len(v) for _, v, _ in rows).items(), key=lambda x: (x[1], x[0]))[0]
    rows = [(i, v.astype(int).reshape(parts, -1), lab) for i, v, lab in rows if len(v) == commonest]
    first = sorted((x for x in rows if x[0] is not None), key=lambda x: (x[0], x[1].ravel().tolist()))[:entries]
    books = [[x[1][p].tolist() for x in first] for p in range(parts)]

    def nearest(part, p):
        return min((sum((int(a) - b) ** 2 for a, b in zip(part, entry)), e) for e, entry in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            own = {}
            for _, v, _ in rows:
                own.setdefault(nearest(v[p], p)[1], []).append(v[p])
            for e, vs in own.items():
                books[p][e] = [int(sum(map(int, c))) // len(vs) for c in zip(*vs)]
    out, label = [], Counter()
    for i, v, lab in rows:
        found = [nearest(v[p], p) for p in range(parts)]
        label[lab] += sum(d for d, _ in found)
        out.append((i, bytes(e for _, e in found), sum(d for d, _ in found), lab))
    return Counter((i, c, err, label[lab]) for i, c, err, lab in out), books


def test_codes(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), rng.normal(0, 0.1, 32).astype(np.float32).tolist(), int(i) % 3 if i % 7 else None) for i in rng.permutation(300)]
    rows += [(5, rows[0][1], 1), (5, rows[1][1], 1), (900, None, 1), (901, [], 2), (902, [None, *[0.0] * 31], 2), (903, [float("nan"), *[0.0] * 31], 2), (904, [float("inf"), *[0.0] * 31], 0)]
    rows += [(None, rows[2][1], None), (-4, [0.5] * 16, 1), *[(1000, [0.25] * 32, 4)] * 60, *[(2000, rows[3][1], 4)] * 2]
    df = spark.createDataFrame([(*r, "x", 1.5, "y") for r in rows], "vec_id long, embedding array<float>, label int, code string, error double, was string").repartition(4)
    found = codes.compress(df, entries=20, rounds=2)
    want, books = brute_codes(rows, entries=20)
    assert found.codebooks.tolist() == books
    assert Counter((r.vec_id, bytes(r.code), r.error, r.label_error) for r in codes.with_label_error(found.rows).collect()) == want
    back = codes.restored(found.rows, found.codebooks).where("vec_id = 1000").first()
    assert len(back.restored) == 32 and all(abs(x - 0.25) < 0.05 for x in back.restored)


def test_codes_small(spark):
    schema = "vec_id long, embedding array<double>, label string"
    three = [(1, [float(k) for k in range(16)], "a"), (2, [0.0] * 16, None), (3, [-0.001] * 16, None)]
    found = codes.compress(spark.createDataFrame(three, schema))
    assert found.codebooks.shape == (16, 3, 1) and [r.error for r in found.rows.collect()] == [0, 0, 0]
    none = codes.compress(spark.createDataFrame([], schema))
    assert codes.with_label_error(none.rows).collect() == [] and none.codebooks.size == 0
    assert codes.compress(spark.createDataFrame([(None, [1.0] * 16, "a")], schema)).rows.collect() == []
    with pytest.raises(ValueError, match="equal parts"):
        codes.compress(spark.createDataFrame([(1, [1.0] * 15, "a")], schema))
    with pytest.raises(Exception, match="component"):
        codes.compress(spark.createDataFrame([(1, [2.0**21] * 16, "a")], schema))
    many = codes.compress(spark.createDataFrame([(k, [k / 256] * 16, "a") for k in range(300)], schema), entries=300)
    assert sorted(int.from_bytes(bytes(r.code)[:2], "big") for r in many.rows.collect()) == list(range(300))


def test_settled_rounds(spark):
    """A second round over parts that all stay adds nothing, so means and codes stay as they are."""
    df = spark.range(200).select(F.col("id").alias("vec_id"), F.array_repeat((F.col("id") % 4).cast("double"), 16).alias("embedding"), F.lit(1).alias("label"))
    one, five = (codes.compress(df, entries=4, rounds=k) for k in (1, 5))
    assert one.digest() == five.digest() and five.rows.agg(F.sum("error")).first()[0] == 0
