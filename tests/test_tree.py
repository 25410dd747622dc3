"""The data source against the walk on the driver; manifests."""

import os

from pyspark.sql import functions as F
from siftline.sources import files, manifest
from siftline.sources.tree import TreeSource


def grown(root):
    for a in range(40):
        for b in range(25):
            folder = root / f"a{a}" / f"b{b}"
            folder.mkdir(parents=True)
            for c in range(10):
                (folder / (f"__init__{c}.py" if c == 1 else f".env{c}" if c == 2 else f"f{c}.txt" if c < 8 else f"p{c}.png")).write_text(f"mail u{a}-{b}-{c}@x.org" if c else "")
    (root / "top.txt").write_text("top")
    (root / ".gitignore").write_text("*.log\nb3/\n!f5.txt\n")
    (root / "a1" / ".gitignore").write_text("f4.txt\n")
    (root / "a1" / "node_modules").mkdir()
    (root / "a1" / "node_modules" / "x.txt").write_text("x")


def test_the_source_walks_in_tasks(spark, tmp_path):
    grown(tmp_path)
    spark.dataSource.register(TreeSource)
    want = sorted((r.file, r.text) if r.text else (r.file, "") for r in files.source_tree(spark, [str(tmp_path)]).collect())
    assert len(want) > 7_000
    for splits in (1, 60, 5000):
        df = spark.read.format("source_tree").option("splits", splits).load(str(tmp_path))
        assert sorted((r.file, r.text or "") for r in df.collect()) == want
        assert splits == 1 or df.rdd.getNumPartitions() > 40
    one = spark.read.format("source_tree").load(str(tmp_path / "top.txt")).collect()
    assert [(r.file, r.text) for r in one] == [(str(tmp_path / "top.txt"), "top")]
    assert spark.read.format("source_tree").load(str(tmp_path / "no such")).count() == 0


def test_the_stream_takes_what_is_new(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    spark.dataSource.register(TreeSource)

    def run():
        q = spark.readStream.format("source_tree").load(str(src)).select("file", "text").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted(r.text for r in spark.read.schema("file string, text string").parquet(f"{tmp_path}/out").collect())

    (src / "a.txt").write_text("one")
    assert run() == ["one"]
    (src / "sub").mkdir()
    (src / "sub" / "b.txt").write_text("two")
    assert run() == ["one", "two"]
    os.utime(src / "a.txt")
    assert run() == ["one", "one", "two"]


def test_manifests(spark):
    make = lambda *rows: manifest.manifest(spark.createDataFrame(rows, "file string, text string"))
    before = make(("a/x", "1"), ("a/y", None), ("b/x", "1"), ("b/y", "2"), ("c/z", "3"), ("top", "t"))
    now = make(("a/y", None), ("a/x", "1"), ("b/x", "1!"), ("b/y", "2"), ("b/n", ""), ("d/z", "3"), ("top", None))
    got = {r.file: r.change for r in manifest.changed_since(now, before).collect()}
    assert got == {"b/x": "changed", "b/n": "added", "c/z": "removed", "d/z": "added", "top": "changed"}
    assert manifest.changed_since(before, before).count() == 0
    docs = spark.createDataFrame([("a/x", "1", 5), ("b/x", "new", 6)], "file string, text string, digest int")
    assert [r.file for r in manifest.only_changed_content(docs, before).select("file", F.col("digest")).collect()] == ["b/x"]
