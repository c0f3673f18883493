"""The embedding cache: filters without misses, few buckets opened."""

import re

from pyspark.sql import functions as F

from passagemill import api
from passagemill.functions.hashing import text_hash
from passagemill.operators import cache
from passagemill.operators.ingest import ingest
from passagemill.session import ship


def _hashes(spark, start, stop):
    return spark.range(start, stop).select(F.sha2(F.col("id").cast("string"), 256).alias("text_hash"))


def test_filters_hold_what_was_written_and_little_else(spark):
    buckets = 4
    parts = [cache.filter_rows(_hashes(spark, *r), r[1] - r[0], buckets) for r in ((0, 5000), (5000, 5200), (5200, 5201))]
    filters = parts[0].unionByName(parts[1]).unionByName(parts[2])
    assert filters.select("level").distinct().count() == 2
    made = cache.Cache(_hashes(spark, 0, 0), filters, buckets)
    assert cache.maybe_known(_hashes(spark, 0, 5201), made).count() == 5201
    wrong = cache.maybe_known(_hashes(spark, 100_000, 104_000), made).count()
    assert wrong < 0.05 * 4000
    assert cache.maybe_known(_hashes(spark, 0, 10), cache.Cache(made.rows, filters.limit(0), buckets)).count() == 0


def test_known_vectors_come_from_their_buckets_only(spark, tmp_path):
    rows = _hashes(spark, 0, 300).select(
        F.lit("m").alias("model_id"), F.lit("r").alias("model_revision"), "text_hash", F.array(F.lit(1.0)).alias("vector"))
    rows = rows.unionByName(rows.limit(5)).unionByName(rows.limit(9).withColumn("model_revision", F.lit("old")))
    made = cache.of_rows(rows, 16)
    made.rows.write.partitionBy("bucket").parquet(str(tmp_path / "rows"))
    made.rows = spark.read.parquet(str(tmp_path / "rows"))
    asked = _hashes(spark, 298, 302)
    found = cache.known(asked, made, "m", "r")
    assert sorted(r.text_hash for r in found.collect()) == sorted(r.text_hash for r in _hashes(spark, 298, 300).collect())
    plan = found._jdf.queryExecution().executedPlan().toString()
    opened = re.search(r"PartitionFilters: \[[^\]]*bucket#\d+ IN \(([\d,]+)\)", plan)
    assert opened and len(opened.group(1).split(",")) <= 3
    assert cache.known(asked, made, "m", "other").count() == 0
    # Nothing that may be known: no bucket is opened at all.
    fresh = cache.known(_hashes(spark, 9_000_000, 9_000_001), made, "m", "r")
    assert "IN (" not in fresh._jdf.queryExecution().executedPlan().toString() and fresh.count() == 0


def test_an_ingest_encodes_new_texts_only(spark, tmp_path):
    ship(spark)
    box, home = tmp_path / "box", str(tmp_path / "index")
    box.mkdir()
    (box / "a.md").write_text("# Same\n\nfirst words\n\nsecond words", encoding="utf-8")
    ingest(spark, str(box), home, buckets=5)
    (box / "b.md").write_text("# Same\n\nfirst words\n\nsecond words", encoding="utf-8")
    (box / "c.md").write_text("# Same\n\nthird words", encoding="utf-8")
    ingest(spark, str(box), home)
    index = api.open_index(spark, home)
    assert index.buckets == 5
    stored = index.table("embeddings").groupBy("gen").count().collect()
    assert {r.gen: r["count"] for r in stored} == {1: 1, 2: 1}
    assert index.live("children").where(F.col("vector").isNull()).count() == 0 and index.live("children").count() == 3
    index.compact()
    again = cache.known(index.live("children").select(text_hash(F.col("embed_text")).alias("text_hash")), index.cache(), index.model_id, index.model_revision)
    assert again.count() == 2
