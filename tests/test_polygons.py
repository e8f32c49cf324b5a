"""Overlay, dissolve, buffer and repair against areas by vertical slabs in plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import arrangement, polygons

RINGS = "array<array<array<double>>>"
BOX = [[0.0, 0.0], [10.0, 0.0], [10.0, 10.0], [0.0, 10.0]]


def directed(rings, oriented=True):
    out = []
    for k, r in enumerate(rings):
        area = sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(r, r[1:] + r[:1]))
        if oriented and (area > 0) != (k == 0):
            r = r[::-1]
        out += [(*p, *q) for p, q in zip(r, r[1:] + r[:1]) if p != q]
    return out


def slab_area(a, b, inside):
    """Area of where inside(winding of a, winding of b): between neighbouring x of all ends and crossings nothing crosses, so the middle tells."""
    edges = [(*e, 0) for e in a] + [(*e, 1) for e in b]
    xs = {v for e in edges for v in (e[0], e[2])}
    for i, e in enumerate(edges):
        for f in edges[:i]:
            d = (e[2] - e[0]) * (f[3] - f[1]) - (e[3] - e[1]) * (f[2] - f[0])
            if d:
                t = ((f[0] - e[0]) * (f[3] - f[1]) - (f[1] - e[1]) * (f[2] - f[0])) / d
                u = ((f[0] - e[0]) * (e[3] - e[1]) - (f[1] - e[1]) * (e[2] - e[0])) / d
                if 0 <= t <= 1 and 0 <= u <= 1:
                    xs.add(e[0] + t * (e[2] - e[0]))
    total, xs = 0.0, sorted(xs)
    for lo, hi in zip(xs, xs[1:]):
        m, w, crossed = (lo + hi) / 2, [0, 0], []
        for x1, y1, x2, y2, layer in edges:
            if min(x1, x2) < m < max(x1, x2):
                crossed.append((y1 + (m - x1) / (x2 - x1) * (y2 - y1), layer, 1 if x2 > x1 else -1))
        crossed.sort()
        for (y, layer, step), (above, *_) in zip(crossed, [*crossed[1:], (0, 0, 0)]):
            w[layer] += step
            if any(w) and inside(*w):
                total += (hi - lo) * (above - y)
    return total


def shape(rng, span, size, vertices):
    """A star-shaped polygon, whole coordinates."""
    cx, cy = rng.randrange(span), rng.randrange(span)
    turns = sorted(rng.random() * 2 * math.pi for _ in range(vertices))
    return [[float(round(cx + (0.3 + rng.random()) * size * math.cos(t))), float(round(cy + (0.3 + rng.random()) * size * math.sin(t)))] for t in turns]


@pytest.mark.parametrize("seed", range(2))
def test_dissolve(spark, seed):
    rng = random.Random(seed)
    many = {k: [[shape(rng, 60, rng.choice([4, 15, 40]), rng.choice([3, 5, 9]))] for _ in range(n)] for k, n in (("few", 4), ("many", 40))}
    many["few"] += [many["few"][0], [BOX, [[2.0, 2.0], [5.0, 2.0], [5.0, 5.0], [2.0, 5.0]]], [[[10.0, 0.0], [20.0, 0.0], [20.0, 10.0], [10.0, 10.0], [10.0, 0.0]]]]
    rows = [(k, rings) for k, shapes in many.items() for rings in shapes] + [("few", None), (None, [BOX]), ("few", [None, []]), ("few", [[[1.0, 1.0]]]), ("few", [[[1.0, 1.0], [2.0, 2.0]]])]
    df = spark.createDataFrame(rows, f"k string, rings {RINGS}").withColumn("key", F.lit(1)).repartition(4)
    edges = polygons.dissolved(df, F.col("k"), precision=1 / 64)
    got = {r["key"]: r["area"] for r in arrangement.measures(edges, 1 / 64).collect()}
    for k, shapes in many.items():
        # stars may cross themselves, and where they wind backwards they take away: windings add up in both
        want = slab_area([e for rings in shapes for e in directed(rings)], [], lambda a, b: a > 0)
        assert got[k] == pytest.approx(want, abs=0.01 * math.sqrt(want) + 0.5)
    assert got[None] == 100.0 if None in got else True
    closed = edges.select("key", F.col("x1").alias("x"), F.col("y1").alias("y"), F.lit(1).alias("n")).unionByName(edges.select("key", F.col("x2").alias("x"), F.col("y2").alias("y"), F.lit(-1).alias("n")))
    assert closed.groupBy("key", "x", "y").agg(F.sum("n").alias("n")).where("n != 0").count() == 0


def test_dissolve_shared_sides(spark):
    """A checkerboard's squares, and all squares: sides in common go, touching corners stay, whichever cells they fall into."""
    rows = [(name, [[[x, y], [x + 1.0, y], [x + 1.0, y + 1.0], [x, y + 1.0]]]) for name, keep in (("all", lambda i: True), ("checks", lambda i: i % 2 == 0)) for i in range(400) for x, y in [(float(i % 20), float(i // 20))] if keep(i + i // 20 * (name == "checks"))]
    edges = polygons.dissolved(spark.createDataFrame(rows, f"k string, rings {RINGS}"), F.col("k"), precision=0.25)
    got = {r["key"]: (r["area"], r["perimeter"]) for r in arrangement.measures(edges, 0.25).collect()}
    assert got == {"all": (400.0, 80.0), "checks": (200.0, 800.0)}
    found = arrangement.rings(edges, 0.25).collect()
    whole = [r for r in found if r["key"] == "all"]
    assert len(whole) == 1 and sorted(whole[0]["ring"]) == [[0.0, 0.0], [0.0, 20.0], [20.0, 0.0], [20.0, 20.0]]
    checks = [r for r in found if r["key"] == "checks"]
    assert len(checks) == 200 and all(r["area"] == 1.0 and len(r["ring"]) == 4 for r in checks)


@pytest.mark.parametrize("how", ["difference", "symmetric_difference"])
def test_combined(spark, how):
    rng = random.Random(9)
    a, b = [[shape(rng, 40, 20, 6)] for _ in range(6)], [[shape(rng, 40, 15, 5)] for _ in range(6)]
    frames = [spark.createDataFrame([(rings,) for rings in x], f"rings {RINGS}") for x in (a, b)]
    edges = polygons.combined(*frames, how, key=F.lit("x"), precision=1 / 64)
    inside = {"intersection": lambda a, b: a > 0 and b > 0, "union": lambda a, b: a > 0 or b > 0, "difference": lambda a, b: a > 0 and not b > 0, "symmetric_difference": lambda a, b: (a > 0) != (b > 0)}[how]
    want = slab_area([e for r in a for e in directed(r)], [e for r in b for e in directed(r)], inside)
    assert arrangement.measures(edges, 1 / 64).first()["area"] == pytest.approx(want, abs=1.0)


def test_overlay(spark):
    rng = random.Random(4)
    left = [(k, [shape(rng, 100, rng.choice([3, 12, 60]), rng.choice([3, 7, 40]))]) for k in range(25)] + [(100, None), (101, []), (102, [[[1.0, 1.0], [2.0, 2.0]]])]
    right = [(k, [shape(rng, 100, rng.choice([2, 25]), 5)]) for k in range(20)] + [(50, [[[-500.0, -500.0], [500.0, -500.0], [500.0, 500.0], [-500.0, 500.0]], BOX])]
    frames = [spark.createDataFrame([(k, r, 1.0) for k, r in x], f"{n} int, rings {RINGS}, xmin double") for x, n in ((left, "i"), (right, "j"))]
    edges = polygons.overlay(*frames, left_id="i", right_id="j", precision=1 / 64)
    got = {(r["key"]["i"], r["key"]["j"]): r["area"] for r in arrangement.measures(edges, 1 / 64).collect()}
    for i, a in left[:25]:
        for j, b in right:
            want = slab_area(directed(a), directed(b), lambda a, b: a > 0 and b > 0)
            assert got.pop((i, j), 0.0) == pytest.approx(want, abs=0.5)
    assert not got


def test_boxes_that_meet(spark):
    rng = random.Random(8)
    box = lambda: (lambda x, y, s: (x, y, x + s, y + s * rng.choice([0.0, 1.0, 3.0])))(rng.uniform(-50, 50), rng.uniform(-50, 50), rng.choice([0.0, 0.01, 1.0, 30.0, 1000.0]))
    a, b = [(k, *box()) for k in range(80)], [(k, *box()) for k in range(60)]
    a.append((500, 0.0, 0.0, 8.0, 8.0))
    b.append((500, 8.0, 8.0, 16.0, 16.0))
    frames = [spark.createDataFrame(x, f"{n} int, xmin double, ymin double, xmax double, ymax double") for x, n in ((a, "i"), (b, "j"))]
    got = [tuple(r)[:2] for r in polygons.boxes_that_meet(*frames, left_id="i", right_id="j").collect()]
    want = [(p[0], q[0]) for p in a for q in b if p[1] <= q[3] and q[1] <= p[3] and p[2] <= q[4] and q[2] <= p[4]]
    assert sorted(got) == sorted(want) and (500, 500) in want
    assert polygons.boxes_that_meet(frames[0].limit(0), frames[1], left_id="i", right_id="j").collect() == []


def test_valid(spark):
    rows = [("eight", [[[0.0, 0.0], [8.0, 8.0], [8.0, 0.0], [0.0, 8.0]]]), ("star", [[[math.cos(2 * math.pi * (2 * k % 5) / 5) * 100, math.sin(2 * math.pi * (2 * k % 5) / 5) * 100] for k in range(5)]]), ("square", [BOX, [[2.0, 2.0], [4.0, 2.0], [4.0, 4.0], [2.0, 4.0]]])]
    df = spark.createDataFrame(rows, f"k string, rings {RINGS}")
    for rule, inside in (("even_odd", lambda a, b: a % 2 == 1), ("nonzero", lambda a, b: a != 0)):
        got = {r["key"]: r["area"] for r in arrangement.measures(polygons.valid(df, F.col("k"), rule=rule, precision=0.01), 0.01).collect()}
        for k, rings in rows:
            assert got[k] == pytest.approx(slab_area(directed(rings, False), [], inside), rel=1e-3)


def test_buffer(spark):
    df = spark.createDataFrame([(1, [[0.0, 0.0], [30.0, 40.0]]), (2, [[5.0, 5.0]]), (3, None), (4, [[0.0, 0.0], [100.0, 0.0], [100.0, 100.0]]), (5, []), (6, [[1.0, 1.0], [None, 2.0], [1.0, 1.0]])], "k int, line array<array<double>>")
    got = {r["key"]: r["area"] for r in arrangement.measures(polygons.buffered(df, F.col("k"), 10.0, line="line", quad_segs=32, precision=0.01), 0.01).collect()}
    disc = math.pi * 100
    # the outer corner of a right angle adds a quarter disc, the inner one is counted twice
    want = {1: 1000 + disc, 2: disc, 4: 2 * 2000 + disc + disc / 4 - 100, 6: disc}
    assert set(got) == set(want) and all(got[k] == pytest.approx(v, rel=2e-3) for k, v in want.items())
    boxes = spark.createDataFrame([(1, [[*BOX, BOX[0]], [[4.0, 4.0], [6.0, 4.0], [6.0, 6.0], [4.0, 6.0]]])], f"k int, rings {RINGS}")
    area = {d: arrangement.measures(polygons.buffered(boxes, F.col("k"), d, rings="rings", quad_segs=32, precision=0.001), 0.001).first()["area"] for d in (0.5, 2.0)}
    assert area[0.5] == pytest.approx(100 + 20 + math.pi / 4 - 1, rel=1e-3) and area[2.0] == pytest.approx(100 + 80 + 4 * math.pi, rel=1e-3)
    with pytest.raises(ValueError, match="positive"):
        polygons.buffered(df, F.col("k"), 0.0, line="line")


def test_coastal_band(spark):
    """A coast of many segments, wide enough for several cells: points near it, and in the area, are in the band."""
    rng = random.Random(2)
    coast = [[float(x * 10), 50 + 25 * math.sin(x / 3) + rng.uniform(-5, 5)] for x in range(30)]
    lines = spark.createDataFrame([("a", coast[:16]), ("a", coast[15:])], "k string, line array<array<double>>")
    area = spark.createDataFrame([("a", [[[20.0, 0.0], [250.0, 10.0], [260.0, 90.0], [30.0, 80.0]]])], f"k string, rings {RINGS}")
    edges = polygons.coastal_band(lines, area, F.col("k"), 8.0, precision=0.01)
    found = arrangement.rings(edges, 0.01).collect()
    total = arrangement.measures(edges, 0.01).first()["area"]
    assert sum(r["area"] for r in found) == pytest.approx(total)

    def near(x, y):
        for (x1, y1), (x2, y2) in zip(coast, coast[1:]):
            t = max(0.0, min(1.0, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / ((x2 - x1) ** 2 + (y2 - y1) ** 2)))
            if math.hypot(x - x1 - t * (x2 - x1), y - y1 - t * (y2 - y1)) <= 8:
                return True
        return False

    def within(x, y, ring):
        return sum((p[1] > y) != (q[1] > y) and x < (q[0] - p[0]) * (y - p[1]) / (q[1] - p[1]) + p[0] for p, q in zip(ring, ring[1:] + ring[:1])) % 2 == 1

    quad, wrong = [[20.0, 0.0], [250.0, 10.0], [260.0, 90.0], [30.0, 80.0]], 0
    for _ in range(1500):
        x, y = rng.uniform(0, 280), rng.uniform(0, 100)
        wrong += (near(x, y) and within(x, y, quad)) != (sum(within(x, y, r["ring"]) for r in found) % 2 == 1)
    assert wrong <= 3  # arcs are chords


def test_empty(spark):
    none = spark.createDataFrame([], f"k string, rings {RINGS}")
    edges = polygons.dissolved(none, F.col("k"))
    assert edges.collect() == [] and arrangement.rings(edges, 0.1).collect() == []
