"""Spans that the boosted trees add: forms, overlaps against brute force, held-out recall, dense long texts."""

import random
import time

import pytest
from pyspark.sql import functions as F

from tidemark.llm import pii

FORMS = {
    "call (523)555-1055 now": "call [PHONE] now",
    "call 5235551055": "call [PHONE]",
    "phone: 555-1055": "phone: [PHONE]",
    "order 5235551055": "order 5235551055",
    "write to anna AT mail DOT example DOT com. He": "write to [EMAIL]. He",
    "host 10[.]0[.]23[.]1 up": "host [IP] up",
    "server 192 . 168 . 0 . 12": "server [IP]",
    "steps 1 . 2 . 3 . 4": "steps 1 . 2 . 3 . 4",
    "card 3782-822463-10005": "card [CARD]",
    "order 378282246310005": "order 378282246310005",
    "pay 4111_1111_1111_1111": "pay [CARD]",
    "since 2019-02-18": "since 2019-02-18",
    "CC BY-NC 4.0. Copyright 2019-2021": "CC BY-NC 4.0. Copyright 2019-2021",
    "1 000 000 000": "1 000 000 000",
    "we look at the. The end": "we look at the. The end",
}


@pytest.fixture(scope="module")
def trees(spark):
    return pii.Trees(spark)


def test_forms(spark, trees):
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(FORMS)], "doc_id long, text string, spans string")
    got = pii.find(docs, trees).select("text", pii.redacted(F.col("text"), F.col("spans")).alias("r")).collect()
    assert {r["text"]: r["r"] for r in got} == FORMS
    assert all(trees.recall[k] >= 0.9 and 0.5 <= trees.threshold[k] <= 1 for k in pii.KINDS)


def test_overlaps_against_brute_force(spark):
    rng = random.Random(2)
    rows = []
    for k in range(300):
        walls, cands, at = [], set(), 0
        for _ in range(rng.randrange(0, 4)):
            at += rng.randrange(1, 30)
            walls.append((at, at + rng.randrange(1, 60), "ip", 2.0))
        for _ in range(rng.randrange(0, 40)):
            a = rng.randrange(0, 120)
            cands.add((a, a + rng.randrange(1, 12), rng.choice(["card", "phone"]), rng.choice([0.5, 0.6, 0.75, 0.9])))
        unique = {}
        for c in sorted(cands):  # one chance for each span and kind
            unique.setdefault(c[:3], c)
        rows.append((k, walls, list(unique.values()) + list(unique.values())[:3]))
    kind = "array<struct<start:int,end:int,kind:string,p:double>>"
    got = spark.createDataFrame(rows, f"id long, walls {kind}, cands {kind}").select("id", pii.resolved(F.col("walls"), F.col("cands"), step=4).alias("r")).collect()
    by = {r["id"]: [tuple(x) for x in r["r"]] for r in got}
    for k, walls, cands in rows:
        meet = lambda a, b: a[0] < b[1] and b[0] < a[1]
        loses = lambda c: any(meet(c, w) for w in walls) or any(meet(c, o) and (-o[3], *o[:3]) < (-c[3], *c[:3]) for o in cands)
        assert by[k] == sorted({c for c in cands if not loses(c)}), k


def test_dense_long_text(spark, trees):
    text = " ".join(f"mail u{k}@mail.example.com or ({200 + k % 700}) 555-{1000 + k % 9000:04d}" for k in range(20_000))
    began = time.time()
    r = pii.find(spark.createDataFrame([(1, text)], "doc_id long, text string"), trees).select(F.size("base").alias("b"), F.size("spans").alias("s"), pii.redacted(F.col("text"), F.col("spans")).alias("r")).first()
    assert (r["b"], r["s"]) == (20_000, 40_000) and r["r"] == " ".join(["mail [EMAIL] or [PHONE]"] * 20_000)
    assert time.time() - began < 90


def test_blocks_give_any_part_of_a_text(spark):
    rng = random.Random(3)
    text = "".join(rng.choice("ab🙂é\n") for _ in range(5000))
    at = [tuple(sorted((rng.randrange(5001), rng.randrange(5001)))) for _ in range(200)] + [(0, 0), (1024, 1024), (1023, 1025), (0, 5000), (2048, 3072)]
    df = spark.createDataFrame([(text, a, b) for a, b in at], "text string, a int, b int")
    got = df.select("a", "b", pii.between(pii.blocks_of(F.col("text")), F.col("a"), F.col("b")).alias("t")).collect()
    assert all(r["t"] == text[r["a"] : r["b"]] for r in got)
