"""What the findings of the fourth round were about, small."""

import hashlib

import pytest
from pyspark.sql import functions as F

from tidemark.functions import names
from tidemark.plans import registry
from tidemark.sources import store, tables


def documents(spark, path, texts):
    """A folder with documents of these texts, by their ids."""
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_empty_files_are_read(spark, tmp_path):
    """Files of empty and of missing texts, and of ids below zero."""
    texts = {0: "", 1: None, 2: "two", 3: "", -4: "minus"}
    got = registry.queries()["q_files_written"](spark, documents(spark, tmp_path, texts)).collect()
    want = {k: (t or "").encode() for k, t in texts.items()}
    assert {r["doc_id"]: (r["n_bytes"], r["md5"]) for r in got} == {k: (len(b), hashlib.md5(b).hexdigest()) for k, b in want.items()}
    assert len(got) == len(texts)


def test_files_of_a_folder(spark, tmp_path):
    """Files at any depth, with their lengths and contents, but no hidden ones."""
    for at, content in (("a.txt", b"a"), ("empty", b""), ("x/b.txt", b"bb"), ("x/y/c.txt", b"ccc"), ("_no/d", b"d"), ("x/.no", b"e"), ("x/_no/f", b"f")):
        (tmp_path / at).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / at).write_bytes(content)
    for path in (str(tmp_path), f"{tmp_path}/", f"file://{tmp_path}"):
        rows = store.read_files(spark, path).collect()
        assert {r["path"].removeprefix(path.rstrip("/")): (r["name"], r["length"], bytes(r["content"])) for r in rows} == {"/a.txt": ("a.txt", 1, b"a"), "/empty": ("empty", 0, b""), "/x/b.txt": ("b.txt", 2, b"bb"), "/x/y/c.txt": ("c.txt", 3, b"ccc")}
    listing = store.read_files(spark, str(tmp_path), content=False)
    assert listing.columns == ["path", "name", "length", "modified"] and sorted(r["length"] for r in listing.collect()) == [0, 1, 2, 3]


def test_spread_files_lie_in_folders(spark, tmp_path):
    """A task's files lie in folders of at most so many, no names go to the driver, and equal names are seen across folders and tasks."""
    rows = spark.range(0, 90, numPartitions=2).select(F.concat("id", F.lit(".txt")).alias("name"), F.lit(b"x").alias("content"))
    store.write_files(rows, str(tmp_path / "out"), spread=True, in_folder=40)
    assert sorted(len(list(p.iterdir())) for p in (tmp_path / "out").iterdir()) == [5, 5, 40, 40]
    assert store.read_files(spark, str(tmp_path / "out"), content=False).select("name").distinct().count() == 90
    for k in (1, 41, 80):  # in its folder, in another of its task, and of another task
        again = rows.withColumn("name", F.when(F.col("name") == f"{k}.txt", "0.txt").otherwise(F.col("name")))
        with pytest.raises(Exception, match="one file name"):
            store.write_files(again, str(tmp_path / "twice"), spread=True, in_folder=40)
        assert list((tmp_path / "twice").iterdir()) == []


def test_written_files_are_listed_by_tasks(spark, tmp_path):
    """The plan has no list of files in it, and a part for the folder and for each folder in it."""
    df = registry.queries()["q_files_written"](spark, documents(spark, tmp_path, {k: "a" for k in range(5)}))
    assert not df.inputFiles() and df.count() == 5


def test_packed_files_are_listed_by_tasks(spark, tmp_path):
    """Empty documents come through each kind of packing, and the plan has no list of files in it."""
    texts = {0: "", 1: "", 2: "", 3: "three", 4: None, -5: "minus", 6: "six" * 1000}
    df = registry.queries()["q_unpacked"](spark, documents(spark, tmp_path, texts))
    assert not df.inputFiles()
    want = {k: t.encode() for k, t in texts.items() if t is not None}
    got = df.collect()
    assert {r["doc_id"]: (r["n_bytes"], r["sha1"]) for r in got} == {k: (len(b), hashlib.sha1(b).hexdigest()) for k, b in want.items()}
    assert len(got) == len(want)


def test_folders_are_listed_by_tasks(spark, tmp_path):
    """Files of folders in a folder, empty ones too, without a list of them in the plan."""
    store.write_files(spark.createDataFrame([("a", b"x"), ("b", b"")], "name string, content binary"), str(tmp_path), spread=True)
    listing = tables.list_files(spark, str(tmp_path), recursive=True)
    assert not listing.inputFiles() and listing.columns == ["path", "name", "length", "modified"]
    assert {r["name"]: r["length"] for r in listing.collect()} == {"a": 1, "b": 0}


def test_product_files_are_listed_once(spark):
    """Ranges are drawn from a written listing, and a name is cut from its path without a search from each of its places."""
    df = registry.queries()["q_product_files"](spark, "/root/testdata/sf0.001")
    assert df.count() == spark.read.parquet("/root/testdata/sf0.001/part.parquet").where("p_partkey % 6 in (0, 2, 3)").count()
    rows = [("a/b.txt", "b.txt"), ("a/", ""), ("a", "a"), ("/x/y/z", "z"), ("", ""), (None, None)]
    named = spark.createDataFrame(rows, "path string, want string").withColumn("got", names.file_name(F.col("path")))
    assert "regexp" not in named._jdf.queryExecution().optimizedPlan().toString() and all(r["got"] == r["want"] for r in named.collect())
