from pyspark.sql import functions as F

from passagemill import api
from passagemill.operators.blocks import assign_offsets
from passagemill.operators.ingest import ingest
from passagemill.session import ship
from passagemill.streaming.ingest import newest, stream_blocks, stream_folder


def test_a_folder_is_indexed_as_it_grows(spark, tmp_path):
    ship(spark)
    folder, home = tmp_path / "in box", str(tmp_path / "index")
    (folder / "sub").mkdir(parents=True)
    (folder / "sub" / "a.md").write_text("# A\n\nalpha text", encoding="utf-8")
    (folder / "bad.html").write_text("<i>none</i>", encoding="utf-8")
    stream_folder(spark, str(folder), home, str(tmp_path / "check")).awaitTermination()
    (folder / "b.txt").write_text("beta text", encoding="utf-8")
    stream_folder(spark, str(folder), home, str(tmp_path / "check")).awaitTermination()
    index = api.open_index(spark, home)
    assert {r.doc_id for r in index.files().collect()} == {"sub/a.md", "b.txt"}
    reports = {(r.doc_id, r.status, r.reason) for r in spark.read.parquet(f"{home}/reports").collect()}
    assert ("bad.html", "refused", "no text") in reports
    assert api.ask(index, "beta", mode="bm25").hits.count() == 1


def test_a_streamed_folder_equals_an_ingested_one(spark, tmp_path):
    folder = tmp_path / "box"
    (folder / ".hid").mkdir(parents=True)
    for name in ("UP.TXT", "_u.md", ".hid/h.md", "a+b.txt", "c%20d.txt"):
        (folder / name).write_text(f"words of {name}", encoding="utf-8")
    (tmp_path / "away.md").write_text("not for here", encoding="utf-8")
    (folder / "link.md").symlink_to(tmp_path / "away.md")
    columns = ["doc_id", "status", "chunks", "reason"]
    plain = ingest(spark, str(folder), str(tmp_path / "one"), fail_fast=False).select(columns)
    stream_folder(spark, str(folder), str(tmp_path / "two"), str(tmp_path / "check")).awaitTermination()
    streamed = spark.read.parquet(f"{tmp_path}/two/reports").select(columns)
    assert sorted(map(str, plain.collect())) == sorted(map(str, streamed.collect()))
    assert sorted(r.status for r in streamed.collect()) == ["indexed"] * 5 + ["refused"]
    (folder / "UP.TXT").write_text("changed", encoding="utf-8")
    stream_folder(spark, str(folder), str(tmp_path / "two"), str(tmp_path / "check")).awaitTermination()
    index = api.open_index(spark, str(tmp_path / "two"))
    assert [r.text for r in index.live("children").where("doc_id = 'UP.TXT'").collect()] == ["changed"]


def test_the_newest_version_of_a_batch_counts_and_replaces(spark, tmp_path):
    def to_blocks(texts):
        return assign_offsets(texts.select(
            "doc_id", F.lit(0).alias("block_index"), F.lit("prose").alias("kind"), "text",
            F.lit("").alias("heading_path"), F.lit(0).alias("page"),
        ))

    schema = "doc_id string, text string, filename string, mime string, v int"
    source, home = str(tmp_path / "rows"), str(tmp_path / "index")

    def stream(rows):
        spark.createDataFrame([(d, t, "f", "text/plain", v) for d, t, v in rows], schema).write.mode("append").parquet(source)
        stream_blocks(
            spark.readStream.schema(schema).parquet(source), to_blocks, home, str(tmp_path / "check"), version=F.col("v"),
        ).awaitTermination()
        live = api.open_index(spark, home).live("children")
        return sorted((r.doc_id, r.text) for r in live.collect())

    first = stream([("a", "old text here", 1), ("a", "new words there", 2), ("b", "kept", None)])
    assert first == [("a", "new words there"), ("b", "kept")]
    assert stream([("a", "third", 3), ("a", "third", 3)]) == [("a", "third"), ("b", "kept")]


def test_texts_of_documents_that_come_once_are_not_exchanged(spark):
    schema = "doc_id string, text string, v int"
    once = spark.createDataFrame([("a", "one", 1), (None, "none", 1)], schema)
    assert "Exchange" not in newest(once, F.col("v"))._jdf.queryExecution().executedPlan().toString()
    twice = spark.createDataFrame([("a", "old", 1), ("a", "new", 2), (None, "x", 1), (None, "y", 3), ("b", "kept", None)], schema)
    assert sorted((r.doc_id or "", r.text, r.v) for r in newest(twice, F.col("v")).collect()) == [("", "y", 3), ("a", "new", 2), ("b", "kept", None)]
