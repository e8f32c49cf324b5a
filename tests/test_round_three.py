"""What the findings of the third round were about, small."""

import pytest
from pyspark.sql import functions as F

from tidemark import session
from tidemark.functions import geo
from tidemark.operators import arrangement, detection, ranking
from tidemark.plans import registry
from tidemark.sources import store, tables


def test_shares_are_as_written(spark):
    """0.7 of 90 and 0.29 of 100 are whole numbers, and less than those in doubles."""
    df = spark.range(100).select(F.col("id").alias("k"), F.lit("a").alias("label"))
    n = {r["split"]: r["count"] for r in ranking.split_by_rank(df.where("k < 90"), F.col("k")).groupBy("split").count().collect()}
    assert n == {"train": 63, "val": 13, "test": 14}
    assert ranking.stratified(df, "label", F.col("k"), share=0.29).where("split = 'train'").count() == 29
    assert ranking.positional_split(df, ["k"], share=0.29).where("split = 'train'").count() == 29


@pytest.mark.parametrize(("value", "text"), [(0.0625, "0.062"), (1.0005, "1.000"), (2.5, "2.500"), (-3.0, "-3.000")])
def test_summary_lines_round_the_exact_value(spark, value, text):
    row = spark.createDataFrame([(value, None)], "lo double, gone double")
    assert {r["key"]: r["line"] for r in tables.summary_lines(row).collect()} == {"lo": f"lo,{text}", "gone": None}


def test_rings_are_worked_out_once(spark):
    """A unit square at a drawn place: its area is 1 only if all readers see the same draw."""
    square = geo.bound(F.rand(7) * 100, lambda r: F.array(F.array(r, r), F.array(r + 1, r), F.array(r + 1, r + 1), F.array(r, r + 1)))
    box = tuple(map(F.lit, (-1.0, -1.0, 200.0, 200.0)))
    for area in (geo.ring_area(square), geo.ring_area(geo.ring_in_box(square, box)), geo.ring_in_use(square).cast("double")):
        assert {round(r[0], 6) for r in spark.range(20).select(area).collect()} == {1.0}


def test_lines_are_parsed_and_joined_once(spark):
    """Two variants over one join, and one split a line."""
    df = registry.queries()["q_yolo_variants"](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1
    assert plan.count("split(") == 1


def test_boxes_are_placed_on_levels_that_there_are(spark):
    """Boxes of one level lie in the cells of that level only, and know how many these are."""
    rows = spark.createDataFrame([(10.0, 10.0, 60.0, 50.0)], "a double, b double, c double, d double")
    corners = ["a", "b", "c", "d"]
    placed = detection._placed(rows, corners, 1, detection._levels(rows, corners)).collect()
    assert {(r["_lx"], r["_ly"]) for r in placed} == {(5, 5)}
    assert {r["_n"] for r in placed} == {len(placed)} == {1}
    assert {r["_lx"] for r in detection._placed(rows, corners, 1, ([4, 5, 6, 7], [5])).collect()} == {5, 6}


def test_rounds_leave_other_tables(spark):
    """Suppression deletes its own rounds' tables, not its caller's."""
    mine = session.written(spark.range(3))
    rows = spark.createDataFrame([(1, 0.0, 0.0, 9.0, 9.0, 0.9), (1, 1.0, 0.0, 10.0, 9.0, 0.8)], "g int, x1 double, y1 double, x2 double, y2 double, score double")
    assert detection.suppressed_in_rounds(rows, ["g"]).count() == 1
    assert mine.count() == 3


def test_matches_are_one_row_a_detection(spark):
    """Ten levels of a detection are bits of one row until they are counted."""
    box = [(1, 1, 0.0, 0.0, 10.0, 10.0, 0.9), (1, 1, 50.0, 50.0, 60.0, 60.0, 0.8)]
    d = spark.createDataFrame(box, "image_id int, category_id int, x1 double, y1 double, x2 double, y2 double, score double")
    t = d.drop("score").withColumn("x1", F.col("x1") + 2)
    got = {r["score"]: r["hits"] for r in detection._graded(d, t, 100, detection.IOUS).collect()}
    assert got == {0.9: 0b1111111, 0.8: 0b1111111}  # they overlap by 0.8


def _squares(spark, n):
    """n small squares along a diagonal, far apart, of one key."""
    at = F.col("id") * 1000.0
    ring = F.array(*[F.array(at + a, at + b) for a, b in ((0, 0), (4, 0), (4, 4), (0, 4))])
    return arrangement.ring_edges(spark.range(n).select(F.array(ring).alias("r"), (F.col("id") % 1).alias("g")), F.col("g"), F.col("r"), 1.0)


def test_cells_follow_the_edges_not_their_box(spark):
    """Edges that do not fill their key's box: cells stay small, and so do the pairs in them."""
    assert {r["s"] for r in arrangement._gridded(_squares(spark, 200)).select("s").distinct().collect()} == {8}


def test_arrangements_broadcast_nothing(spark):
    edges = _squares(spark, 3)
    for df in (arrangement._gridded(edges), arrangement.wound(arrangement.noded(edges))):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def test_spread_files_move_by_task(spark, tmp_path):
    """Files of each task land in one folder below the path, none twice, and nothing pending stays."""
    rows = spark.range(0, 30, numPartitions=3).select(F.concat("id", F.lit(".txt")).alias("name"), F.lit(b"x").alias("content"))
    store.write_files(rows, str(tmp_path), spread=True)
    assert len(list(tmp_path.iterdir())) == 3
    assert sorted(p.name for p in tmp_path.glob("*/*.txt")) == sorted(f"{k}.txt" for k in range(30))


def test_label_files_make_room(spark):
    """Every image has its label file, and none lies on the disk any more once it was read."""
    from pathlib import Path

    df = registry.queries()["q_box_files"](spark, "/root/testdata/sf0.001")
    assert df.count() == spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").select("l_orderkey").distinct().count()
    assert not list(Path(session.shared_folder(spark).removeprefix("file:")).rglob("o*.txt"))


def test_files_go_through_the_disk(spark):
    rows = spark.createDataFrame([(f"{k}.txt", bytes([k, 0, 255]) * (k % 3)) for k in range(25)] + [("none", None)], "name string, content binary")
    got = {r["path"].rsplit("/", 1)[-1]: bytes(r["content"]) for r in store.through_files(rows, at_once=4).collect()}
    assert got == {r["name"]: bytes(r["content"] or b"") for r in rows.collect()}
    for name in ("../up", "_hidden"):
        with pytest.raises(Exception, match="not a file name"):
            store.through_files(rows.withColumn("name", F.lit(name))).collect()
    with pytest.raises(Exception, match="one file name"):
        store.through_files(rows.coalesce(1).withColumn("name", F.lit("a"))).collect()


def test_few_links_are_left_to_rounds(spark):
    """Runs of a block are one part before the rounds begin, none that lie apart are, and parts know touching runs of other batches."""
    from tidemark.operators import components

    px = spark.range(512 * 100).select(F.lit("a").alias("key"), (F.col("id") / 100).cast("int").alias("i"), (F.col("id") % 100).cast("int").alias("j")).where("(i + j) % 2 = 0")  # a chessboard
    rs = session.written(components.runs(px).withColumn("id", F.monotonically_increasing_id()))
    assert components.merged(rs, True).select("part").distinct().count() <= 8 < 25_600 == rs.count() == components.merged(rs, False).select("part").distinct().count()
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 700)
    try:
        assert [tuple(r) for r in components.boxes(px).collect()] == [("a", 0, 0, 100, 512, 25_600)]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
