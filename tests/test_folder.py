"""The folder source: listings, offsets and files that are not opened again."""

import os

from pyarrow import fs as arrow_fs
from pyspark.sql import functions as F

from passagemill import api
from passagemill.operators.ingest import ingest
from passagemill.session import ship
from passagemill.sources import files, folder
from passagemill.streaming.ingest import stream_folder

OLD = 1_600_000_000


def _write(path, text, time=OLD):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    os.utime(path, (time, time))


def test_a_batch_walks_many_folders(spark, tmp_path):
    ship(spark)
    for i in range(90):
        _write(tmp_path / "box" / f"f{i}" / "deep" / f"{i}.txt", f"text {i}")
    _write(tmp_path / "box" / "index" / "x.txt", "left out")
    rows = files.list_files(spark, str(tmp_path / "box"), str(tmp_path / "box" / "index")).collect()
    assert sorted(r.doc_id for r in rows) == sorted(f"f{i}/deep/{i}.txt" for i in range(90))
    assert {r["size"] for r in rows} == {6, 7} and {r.mtime for r in rows} == {OLD * 10**6}
    plan = files.list_files(spark, str(tmp_path / "box")).select("doc_id")
    assert plan.rdd.getNumPartitions() > 64


def test_other_file_systems_are_listed_the_same(spark, tmp_path):
    """A file system that is not local has no links to follow; paths open by their URI."""
    for name in ("a.md", "sub/_b.csv", ".c/d.html", ".e.txt", "f.exe"):
        _write(tmp_path / "box" / name, "x")
    sub = arrow_fs.SubTreeFileSystem(str(tmp_path), arrow_fs.LocalFileSystem())
    tree = folder.Tree(sub, "box", "box/sub", uri="store://box")
    found = {e.doc_id: e.real for e in tree.walk("box")}
    assert found == {"a.md": "store://box/a.md", ".c/d.html": "store://box/.c/d.html"}
    by_uri = files.list_files(spark, f"file://{tmp_path}/box").collect()
    assert {r.doc_id for r in by_uri} == {"a.md", "sub/_b.csv", ".c/d.html"}
    one = files.list_files(spark, f"file://{tmp_path}/box/a.md").collect()
    assert [(r.doc_id, r.reason) for r in one] == [("a.md", None)]


def test_partitions_follow_bytes():
    entries = [folder.Entry(f"p{i:02}", "", "", "", "", size, 0, None) for i, size in enumerate([5, 5, 100, 1, 1, 1, 9])]
    assert [[e.size for e in p.entries] for p in folder.by_bytes(entries, 10, 3)] == [[5, 5], [100], [1, 1, 1], [9]]
    assert folder.by_bytes([], 10) == []


def test_offsets_stand_still_until_something_changes(tmp_path):
    box, kept = tmp_path / "box", str(tmp_path / "kept")
    box.mkdir()

    def stream():
        return folder.FolderStream(folder.Tree(arrow_fs.LocalFileSystem(), str(box)), str(box), kept, 1 << 20)

    def names(start, end):
        return sorted(e.doc_id for p in stream().partitions(start, end) for e in p.entries)

    nothing = stream().initialOffset()
    assert stream().latestOffset() == nothing
    _write(box / "a.txt", "one")
    _write(box / "b.txt", "two")
    first = stream().latestOffset()
    assert stream().latestOffset() == first and names(nothing, first) == ["a.txt", "b.txt"]
    _write(box / "b.txt", "TWO", OLD + 5)
    _write(box / "c.txt", "new")
    second = stream().latestOffset()
    assert names(first, second) == ["b.txt", "c.txt"] and names(first, first) == []
    stream().commit(first)
    assert names(first, second) == ["b.txt", "c.txt"]
    stream().commit(second)
    # Back to an earlier state is a change like any other.
    os.remove(box / "c.txt")
    _write(box / "b.txt", "two")
    third = stream().latestOffset()
    assert third["listing"] > second["listing"] and names(second, third) == ["b.txt"]


def test_unchanged_files_are_not_opened(spark, tmp_path):
    ship(spark)
    box, home = tmp_path / "box", str(tmp_path / "index")
    _write(box / "a.txt", "alpha words")
    _write(box / "b.txt", "beta words!")
    ingest(spark, str(box), home)
    # Same size and time: an opened file would show its new content.
    _write(box / "a.txt", "ALPHA WORDS")
    _write(box / "b.txt", "gamma words", OLD + 60)
    report = {r.doc_id: r.status for r in ingest(spark, str(box), home).collect()}
    assert report == {"a.txt": "skipped", "b.txt": "indexed"}
    index = api.open_index(spark, home)
    assert {r.text for r in index.live("children").collect()} == {"alpha words", "gamma words"}
    times = index.read_times().groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in times} == {"a.txt": 1, "b.txt": 2}
    # A file read just after its change is read again.
    fresh = spark.createDataFrame([("a.txt", "old", 5, 10, 11)], "doc_id string, file_sha256 string, size bigint, mtime bigint, seen bigint")
    listed = spark.createDataFrame([("a.txt", 5, 10, None)], "doc_id string, size bigint, mtime bigint, reason string")
    assert files.remembered(listed, fresh).collect()[0].file_sha256 is None
    later = fresh.withColumn("seen", F.lit(10 + files.RACY_MICROSECONDS + 1))
    assert files.remembered(listed, later).collect()[0].file_sha256 == "old"


def test_a_stream_runs_no_batch_without_a_change(spark, tmp_path):
    ship(spark)
    box, home, check = tmp_path / "box", str(tmp_path / "index"), str(tmp_path / "check")
    _write(box / "a.md", "# A\n\nalpha text")
    _write(box / "bad.html", "<i>none</i>")
    run = lambda: stream_folder(spark, str(box), home, check, buckets=3)
    run().awaitTermination()
    n = len(os.listdir(f"{home}/reports"))
    again = run()
    again.awaitTermination()
    assert len(os.listdir(f"{home}/reports")) == n and sum(p["numInputRows"] for p in again.recentProgress) == 0
    _write(box / "b.txt", "beta text")
    run().awaitTermination()
    index = api.open_index(spark, home)
    assert {r.doc_id for r in index.files().collect()} == {"a.md", "b.txt"} and index.buckets == 3
    reports = [(r.doc_id, r.status) for r in spark.read.parquet(f"{home}/reports").collect()]
    assert sorted(reports) == [("a.md", "indexed"), ("b.txt", "indexed"), ("bad.html", "refused")]
