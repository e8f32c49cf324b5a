"""Components of links and of rasters against floods in plain Python."""

import random
from collections import Counter

import pytest

from tidemark.operators import components

EIGHT = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b]
FOUR = [(-1, 0), (1, 0), (0, -1), (0, 1)]


def flood(cells, start, steps):
    seen, todo = {start}, [start]
    while todo:
        i, j = todo.pop()
        for a, b in steps:
            if (n := (i + a, j + b)) in cells and n not in seen:
                seen.add(n)
                todo.append(n)
    return seen


def want(cells, least, outer):
    rows, cols = [i for i, _ in cells], [j for _, j in cells]
    ground = {(i, j) for i in range(min(rows) - 1, max(rows) + 2) for j in range(min(cols) - 1, max(cols) + 2)} - cells
    open_ = flood(ground, (min(rows) - 1, min(cols) - 1), FOUR)
    out, left = [], set(cells)
    while left:
        own = flood(cells, next(iter(left)), EIGHT)
        left -= own
        y, x = min(i for i, _ in own), min(j for _, j in own)
        h, w = max(i for i, _ in own) - y + 1, max(j for _, j in own) - x + 1
        if w * h >= least and (not outer or any((i + a, j + b) in open_ for i, j in own for a, b in FOUR)):
            out.append((x, y, w, h, len(own)))
    return Counter(out)


@pytest.mark.parametrize("outer", [True, False])
def test_boxes(spark, outer):
    rng = random.Random(3)
    spiral, i, j, step, reach = set(), 40, 40, 0, 1
    while reach < 40:  # one component with one long hole that is open at its end
        for _ in range(2):
            for _ in range(reach):
                spiral.add((i, j))
                i, j = i + (0, 1, 0, -1)[step % 4], j + (1, 0, -1, 0)[step % 4]
            step += 1
        reach += 2
    nest = {(i, j) for i in range(30) for j in range(100, 250) if min(i, 29 - i, j - 100, 249 - j) in (0, 3, 6, 7, 11)}
    shapes = {
        "holes": {(i, j) for i in range(1, 10) for j in range(1, 10)} - {(i, j) for i in range(3, 8) for j in range(3, 8)} | {(5, 5), (11, 11)},
        "spiral": spiral,
        "nest": nest,
        "sparse": {(rng.randrange(40), rng.randrange(300)) for _ in range(2500)},
        "dense": {(rng.randrange(-20, 20), rng.randrange(-140, 140)) for _ in range(7000)},
        "diagonal": {(k, k) for k in range(150)} | {(k, 150 - k) for k in range(150)},
        "line": {(0, j) for j in range(500)},
    }
    rows = [(k, *c) for k, cells in shapes.items() for c in cells]
    rows += rows[:50] + [(None, 1, 1), ("line", None, 3), ("line", 3, None)]
    rng.shuffle(rows)
    got = components.boxes(spark.createDataFrame(rows, "key string, i int, j int"), min_area=3, outer=outer).collect()
    for k, cells in shapes.items():
        assert Counter(tuple(r)[1:] for r in got if r["key"] == k) == want(cells, 3, outer), k
    assert not {r["key"] for r in got} - set(shapes)


def test_links(spark):
    rng = random.Random(1)
    links = [(k, k + 1) for k in range(300)] + [(1000, k) for k in range(1001, 1400)] + [(rng.randrange(2000, 2400), rng.randrange(2000, 2400)) for _ in range(250)] + [(5000, 5000), (7, 7)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        if a != b:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    got = {r["id"]: r["component"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_mosaic_reaches_over_tiles(spark):
    tiles = [("m", 0, 0, [0, 0, 0, 9], 2), ("m", 0, 2, [0, 0, 9, 9], 2), ("m", 2, 0, [0, 9, 0, 0], 2), ("n", 0, 0, [9, None, 9, 0], 2)]
    df = spark.createDataFrame(tiles, "m string, r int, c int, v array<int>, w int")
    from pyspark.sql import functions as F

    on = components.bright_pixels(df, key=F.col("m"), row=F.col("r"), col=F.col("c"), values=F.col("v"), width=F.col("w"), threshold=5, dilate=False)
    assert sorted(tuple(r) for r in components.boxes(on).collect()) == [("m", 1, 1, 3, 2, 4), ("n", 0, 0, 1, 2, 2)]
    assert components.boxes(on.limit(0)).collect() == []
