"""Folders and tables that keep growing, indexed one micro-batch at a time.

Every batch is one generation of the index.  A batch that is run again after a
failure sees the same files, finds them unchanged in the manifest or writes its
generation anew, so replays do not double anything.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from passagemill.functions.hashing import hash_vector, text_hash
from passagemill.operators.index import BUCKETS, Index
from passagemill.operators.ingest import HASH_MODEL, HASH_REVISION, index_blocks, ingest_listed, split_unchanged
from passagemill.operators.topk import cut_lineage
from passagemill.schemas import LIMITS, Limits
from passagemill.sources import folder
from passagemill.sources.files import gate_files


def stream_folder(
    spark: SparkSession, path: str, index_dir: str, checkpoint: str,
    encode: Callable[[Column], Column] = hash_vector, limits: Limits = LIMITS, trigger: dict | None = None,
    buckets: int = BUCKETS,
) -> StreamingQuery:
    """Bring the index up to date with a folder at every tick of ``trigger`` (default: once).

    The stream gives the files whose size or time have changed since the tick before, listed as
    ``ingest`` lists them, with the same gates and ids; without a change no batch runs.  Indexed
    and refused files of each batch are rows under ``reports`` in the index; refused ones do not
    stop the stream.
    """
    spark.dataSource.register(folder.FolderSource)
    options = {"path": path, "skip": index_dir, "snapshots": f"{checkpoint}/listings"}
    listed = spark.readStream.format(folder.FORMAT).options(**options).load()

    def batch(part: DataFrame, number: int) -> None:
        report = ingest_listed(gate_files(part, limits), index_dir, encode, limits=limits, fail_fast=False, buckets=buckets)
        report.where("status <> 'skipped'").write.mode("overwrite").parquet(f"{index_dir}/reports/batch={number}")

    return _started(listed.writeStream.foreachBatch(batch), checkpoint, trigger)


def newest(rows: DataFrame, version: Column) -> DataFrame:
    """One row per ``doc_id``: that of the largest ``version`` (nulls last), then of the largest digest and row.

    Only rows of documents that come more than once are exchanged.
    """
    others = [c for c in rows.columns if c != "doc_id"]
    again = cut_lineage(rows.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("_again")))
    if again.isEmpty():
        return rows.select("doc_id", *others)
    rest = F.struct(*others)
    order = F.struct(version.isNotNull(), version, text_hash(F.col("text")), rest)
    same = F.col("doc_id").eqNullSafe(F.col("_again"))
    best = rows.join(again, same, "left_semi").groupBy("doc_id").agg(F.max_by(rest, order).alias("_row")).select("doc_id", "_row.*")
    return rows.join(again, same, "left_anti").select("doc_id", *others).unionByName(best)


def stream_blocks(
    rows: DataFrame, to_blocks: Callable[[DataFrame], DataFrame], index_dir: str, checkpoint: str,
    encode: Callable[[Column], Column] = hash_vector, limits: Limits = LIMITS,
    version: Column | None = None, trigger: dict | None = None, buckets: int = BUCKETS,
) -> StreamingQuery:
    """Index a stream of texts (doc_id, text, filename, mime) that ``to_blocks`` turns into blocks.

    Of the rows of one document in a micro-batch, that of the largest ``version`` counts; a
    later micro-batch replaces what an earlier one stored.
    """
    version = F.lit(0) if version is None else version

    def batch(part: DataFrame, number: int) -> None:
        index = Index(part.sparkSession, index_dir, HASH_MODEL, HASH_REVISION, limits.pipeline_version, buckets)
        part = cut_lineage(newest(part, version))
        sources = part.select(
            "doc_id", F.col("doc_id").alias("path"), F.col("doc_id").alias("path_order"), "filename", "mime",
            text_hash(F.col("text")).alias("file_sha256"),
        )
        changed = split_unchanged(sources, index.files() if index.exists else None, index).where("NOT skipped")
        texts = part.join(changed.select("doc_id"), "doc_id", "left_semi") if index.exists else part
        index_blocks(index, changed.drop("skipped"), to_blocks(texts), encode, limits=limits, fail_fast=False, parsed=True)

    return _started(rows.writeStream.foreachBatch(batch), checkpoint, trigger)


def _started(writer: DataStreamWriter, checkpoint: str, trigger: dict | None) -> StreamingQuery:
    return writer.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
