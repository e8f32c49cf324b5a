"""Quantiles by selection, suppression by rounds, average precision and the classifier against plain Python; arrivals; runs of their own."""

import random
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark import session
from tidemark.operators import detection, labels, metrics, ml
from tidemark.operators.quantiles import exact_quantiles
from tidemark.streaming import jobs


@pytest.mark.parametrize("accuracy", [10_000, 20])
def test_quantiles(spark, accuracy):
    rng = np.random.default_rng(accuracy)
    groups = {"normal": rng.normal(size=700), "ties": rng.integers(0, 3, 500), "one": [4.0], "two": [1.0, 2.0], "heavy": np.r_[np.zeros(900), rng.pareto(0.3, 100)], "same": np.full(50, 2.5), "wild": np.r_[rng.normal(size=50) * 1e-300, rng.normal(size=50) * 1e300]}
    rows = [(g, float(v), float(-v) if k % 3 else None) for g, vs in groups.items() for k, v in enumerate(vs)]
    rows += [("one", float("nan"), None), ("none", None, None), (None, 7.0, 8.0), (None, 9.0, float("nan"))]
    df = spark.createDataFrame(rows, "g string, x double, y double").repartition(5)
    qs = [0.0, 0.1, 0.5, 0.8, 0.95, 1.0]
    got = {r["g"]: r for r in exact_quantiles(df.where("g is not null"), ["g"], ["x", "y"], qs, accuracy=accuracy).collect()}
    want = {r["g"]: r for r in df.where("g is not null").groupBy("g").agg(*[F.percentile(F.when(~F.isnan(c), F.col(c)), F.array(*map(F.lit, qs))).alias(c) for c in ("x", "y")]).collect()}
    assert set(got) == {g for g, r in want.items() if r["x"] is not None}
    for g, r in got.items():
        assert r["x"] == want[g]["x"] and r["y"] == want[g]["y"], g
    assert exact_quantiles(df.limit(0), ["g"], ["x"], qs).collect() == []


def greedy(boxes, score_min, iou_max):
    kept = []
    for b in sorted({b for b in boxes if b[0] >= score_min}, key=lambda b: (-b[0], *b[1:])):
        def over(k, b=b):
            w, h = min(k[3], b[3]) - max(k[1], b[1]), min(k[4], b[4]) - max(k[2], b[2])
            inter = max(0, w) * max(0, h)
            union = (k[3] - k[1]) * (k[4] - k[2]) + (b[3] - b[1]) * (b[4] - b[2]) - inter
            return inter / union if union > 0 else 0.0
        if all(over(k) <= iou_max for k in kept):
            kept.append(b)
    return kept


@pytest.mark.parametrize("iou_max", [0.5, 0.3])
def test_suppression_by_rounds(spark, iou_max):
    rng = random.Random(int(iou_max * 10))

    def box(span):
        x, y, s = rng.uniform(0, span), rng.uniform(-span, span), rng.choice([0.3, 1, 5, 5.5, 40])
        return (round(rng.random(), 2), x, y, x + s * rng.choice([1, 1.3, 3]), y + s)

    images = {"crowd": [box(12) for _ in range(700)], "sparse": [box(500) for _ in range(100)], "stack": [(0.5 + k / 1000, 10.0, 10.0, 20.0 + k / 50, 20.0) for k in range(300)], "few": [box(3) for _ in range(4)], "low": [(0.1, 0.0, 0.0, 1.0, 1.0)]}
    images["few"] += [images["few"][0], (0.9, 1.0, 1.0, 1.0, 5.0), (0.8, 1.0, 1.0, 1.0, 5.0)]
    df = spark.createDataFrame([(k, *b) for k, bs in images.items() for b in bs], "im string, score double, x1 double, y1 double, x2 double, y2 double").repartition(4)
    for top in (None, 20):
        got = {}
        for r in detection.suppressed_in_rounds(df, ["im"], iou_max=iou_max, top=top).collect():
            got.setdefault(r["im"], []).append(tuple(r)[1:])
        assert "low" not in got
        for im, bs in images.items():
            if im != "low":
                assert [b[1:] for b in sorted(got[im])] == greedy(bs, 0.3, iou_max)[:top] and sorted(b[0] for b in got[im]) == list(range(1, len(got[im]) + 1))
    with pytest.raises(ValueError, match="above 0"):
        detection.suppressed_in_rounds(df, ["im"], iou_max=0.0)


def test_running_sums(spark):
    rng = random.Random(5)
    rows = [("hot" if k % 10 else rng.choice("ab"), k, rng.randrange(5)) for k in range(500)]
    got = {(r["k"], r["o"]): r["v_upto"] for r in metrics.running_sums(spark.createDataFrame(rows, "k string, o int, v int").repartition(7), ["k"], "o", ["v"]).collect()}
    assert got == {(k, o): sum(v for a, b, v in rows if a == k and b >= o) for k, o, _ in rows}


def test_classifier_by_newton(spark, tmp_path):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 3)) * [1, 20, 0.1] + [5, 0, 1]
    y = (x[:, 0] - 5 + rng.normal(size=400) > 0.8).astype(float)
    df = spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(x, y)] + [(None, 1.0, 1.0, 1.0), (float("nan"), 1.0, 1.0, 0.0)], "a double, b double, c double, y double")
    model = ml.fit_classifier(df, ["a", "b", "c"], "y")
    ml.save_classifier(model, str(tmp_path / "m"))
    got = np.array([r["probability"] for r in ml.classify(ml.load_classifier(str(tmp_path / "m")), df.where("a is not null and not isnan(a)")).collect()])
    z = np.c_[np.ones(400), (x - x.mean(0)) / x.std(0)]
    w, b = np.where(y == 1, 200 / y.sum(), 200 / (400 - y.sum())), np.zeros(4)
    for _ in range(30):
        p = 1 / (1 + np.exp(-z @ b))
        b -= np.linalg.solve((z.T * (w * p * (1 - p))) @ z + np.diag([0, 1, 1, 1]), z.T @ (w * (p - y)) + np.r_[0, b[1:]])
    assert np.allclose(np.sort(got), np.sort(1 / (1 + np.exp(-z @ b))), atol=1e-6)


def test_labels_keep_rows_of_groups_without_values(spark):
    df = spark.createDataFrame([("s", 1.0), ("t", None), ("t", float("nan")), (None, 5.0)], "season string, flh double")
    got = sorted(map(tuple, labels.quantile_labels(df, chlor=None, kd=None).select("season", "hab_label").collect()), key=str)
    assert got == [("s", 1), ("t", 0), ("t", 0), (None, None)]


def test_arrivals_leave_once_done(spark, tmp_path):
    land, archive, out, state = (str(tmp_path / n) for n in ("land", "archive", "out", "state"))
    schema = "id long"
    number = lambda: len(list((tmp_path / "land").glob("*.parquet")))

    def arrive(k):
        spark.range(k, k + 5).coalesce(1).write.mode("append").parquet(land)

    def go(enrich):
        stream = jobs.arrivals(spark, land, schema, archive=archive)
        jobs.enrich_arrivals(stream, enrich, out, state).awaitTermination()

    arrive(0)
    go(lambda b: b)
    assert number() == 1  # on record as done only now
    arrive(5)
    with pytest.raises(Exception, match="broken"):
        go(lambda b: b.withColumn("x", F.raise_error(F.lit("broken"))))
    arrive(10)
    go(lambda b: b)
    go(lambda b: b)
    assert sorted(r["id"] for r in spark.read.parquet(out).collect()) == list(range(15))
    arrive(15)
    go(lambda b: b)
    spark.streams.resetTerminated()
    left = {int(r["id"]) for r in spark.read.parquet(land).collect()}
    assert left <= set(range(10, 20)) and set(range(15, 20)) <= left  # the last batch's file stays
    assert len(list((tmp_path / "archive").rglob("*.parquet"))) >= 1


def test_runs_do_not_touch_each_other(spark):
    """Two runs at once: what one discards is its own; what is left is the caller's."""
    before, ready, go_on, left = session.mark(), threading.Event(), threading.Event(), {}

    def first():
        with session.run():
            df = session.written(spark.range(3))
            ready.set()
            go_on.wait(60)
            left["rows"] = df.count()

    t = threading.Thread(target=first)
    t.start()
    ready.wait(60)
    with session.run():
        kept, gone = session.written(spark.range(5)), session.written(spark.range(7))
        session.discard(spark, keep=[kept])
        assert kept.count() == 5
        with pytest.raises(Exception):
            gone.count()
    go_on.set()
    t.join()
    assert left["rows"] == 3
    assert session.mark() - before in (1, 2)
    session.discard(spark, before)
    assert session.mark() == before


@pytest.mark.parametrize("max_dets", [100, 4])
def test_matches_against_greedy(spark, max_dets):
    """Images of many boxes, of copies of one box, and with crowds: what each detection is at each level."""
    rng = random.Random(max_dets)
    levels = [0.5, 0.6, 0.75]

    def box(span):
        x, y, w, h = rng.uniform(-span, span), rng.uniform(0, span), rng.choice([1, 4, 4.2, 30]), rng.choice([1, 4, 5, 30])
        return (x, y, x + w, y + h)

    dets, truths = [], []
    for image in ("many", "few", "copies", "empty"):
        for category in (1, 2):
            n = {"many": 150, "few": 5, "copies": 40, "empty": 3}[image]
            own = [box({"many": 12, "few": 3, "copies": 1, "empty": 5}[image]) for _ in range(n)]
            if image == "copies":
                own = [own[0]] * n
            if image != "empty":
                truths += [(image, category, *b, int(rng.random() < 0.1)) for b in own]
            moved = [tuple(c + rng.choice([0, 0, 0.1, 0.5]) for c in b) for b in own] + [box(12) for _ in range(3)]
            dets += [(image, category, *b, round(rng.random(), 2)) for b in moved if b[2] > b[0] and b[3] > b[1]]
    truths += [("many", 1, -20.0, -20.0, 40.0, 40.0, 1), ("many", 1, 5.0, 5.0, 5.0, 9.0, 0), ("few", 3, 0.0, 0.0, 1.0, 1.0, 0)]
    dets.append(("none", 1, 0.0, 0.0, 0.0, 1.0, 0.5))

    def inter(a, b):
        return max(0.0, min(a[2], b[2]) - max(a[0], b[0])) * max(0.0, min(a[3], b[3]) - max(a[1], b[1]))

    area = lambda b: (b[2] - b[0]) * (b[3] - b[1])
    want = []
    for image, category in sorted({d[:2] for d in dets}):
        ds = sorted((d for d in dets if d[:2] == (image, category)), key=lambda d: (-d[6], d[2:6]))[:max_dets]
        real = sorted(t[2:6] for t in truths if t[:2] == (image, category) and not t[6])
        crowds = [t[2:6] for t in truths if t[:2] == (image, category) and t[6]]
        for level in levels:
            free = set(range(len(real)))
            for d in ds:
                b = d[2:6]
                over = [(o, k) for k in free if (u := area(b) + area(real[k]) - inter(b, real[k])) > 0 and (o := inter(b, real[k]) / u) >= level]
                if over:
                    free.remove(max(over)[1])
                    want.append((category, level, d[6], 1))
                elif not any(area(b) > 0 and inter(b, c) / area(b) >= level for c in crowds):
                    want.append((category, level, d[6], 0))
    d = spark.createDataFrame(dets, "image_id string, category_id int, x1 double, y1 double, x2 double, y2 double, score double").repartition(3)
    t = spark.createDataFrame(truths, "image_id string, category_id int, x1 double, y1 double, x2 double, y2 double, iscrowd int").repartition(3)
    got = [tuple(r) for r in detection.matches(d, t, max_dets=max_dets, ious=levels).collect()]
    assert sorted(got) == sorted(want)


def test_plateau_by_steps(spark):
    rng = random.Random(7)
    rows = [(k, e, rng.choice([1.0, 2.0, 0.5, float("nan"), None, rng.random()])) for k in range(20) for e in range(rng.randrange(1, 40))]
    got = {r["k"]: [(x["o"], x["lr_scale"]) for x in r["curve"]] for r in metrics.plateau(spark.createDataFrame(rows, "k int, e int, v double"), "e", "v", "k", patience=2, factor=0.5).collect()}
    for k in got:
        best, bad, scale, want = float("inf"), 0, 1.0, []
        for _, e, v in sorted((r for r in rows if r[0] == k), key=lambda r: r[1]):
            better = v is not None and v < best
            best, bad = (v, 0) if better else (best, bad + 1)
            if bad > 2:
                scale, bad = scale * 0.5, 0
            want.append((float(e), scale))
        assert got[k] == want
