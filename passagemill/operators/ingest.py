"""Folder to index: gates, change detection, parsing, chunking, encoding, commit."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from passagemill.functions import text as X
from passagemill.functions.hashing import hash_vector, text_hash
from passagemill.operators.cache import filter_rows, known
from passagemill.operators.chunking import child_rows, parent_rows, passages, with_embed_text
from passagemill.operators.index import BUCKETS, Index
from passagemill.operators.skew import join_hot
from passagemill.operators.topk import cut_lineage
from passagemill.schemas import CHILD_COLUMNS, LIMITS, MIMES, PARENT_COLUMNS, IngestError, Limits
from passagemill.sources import files as S

EMBEDDINGS = "model_id string, model_revision string, text_hash string, vector array<float>"
_ORIGIN = ("source_path", "file_sha256", "filename", "mime", "pipeline_version")
HASH_MODEL, HASH_REVISION = "sha256-unit-vector", "1"


def split_unchanged(listed: DataFrame, manifest: DataFrame | None, index: Index) -> DataFrame:
    """Mark files whose digest, version and model match the manifest as ``skipped``."""
    if manifest is None:
        return listed.withColumn("skipped", F.lit(False))
    same = manifest.where(
        (F.col("pipeline_version") == index.pipeline_version)
        & (F.col("model_id") == index.model_id)
        & (F.col("model_revision") == index.model_revision)
    ).select("doc_id", "file_sha256", F.lit(True).alias("_same"))
    return listed.join(same, ["doc_id", "file_sha256"], "left").withColumn(
        "skipped", F.coalesce("_same", F.lit(False))
    ).drop("_same")


def chunk_gates(counts: DataFrame, limits: Limits = LIMITS) -> DataFrame:
    """Reason a document with (n_blocks, n_chunks) cannot be indexed, or null."""
    reason = (
        F.when(F.coalesce("n_blocks", F.lit(0)) == 0, "no text")
        .when(F.coalesce("n_chunks", F.lit(0)) == 0, "no chunks")
        .when(F.col("n_chunks") > limits.max_chunks, "parser produced too many chunks")
    )
    return counts.withColumn("reason", F.coalesce("reason", reason))


def missing_texts(children: DataFrame, found: DataFrame | None) -> DataFrame:
    """Distinct texts of children (text_hash, embed_text) without a row in ``found``."""
    distinct = children.groupBy("text_hash").agg(F.first("embed_text").alias("embed_text"))
    return distinct if found is None else distinct.join(found.select("text_hash"), "text_hash", "left_anti")


def attach_vectors(children: DataFrame, vectors: DataFrame) -> DataFrame:
    """Vectors (text_hash, vector) to children; copies of one text may be many, so hot hashes are broadcast."""
    return join_hot(children, vectors, "text_hash", "left")


def index_blocks(
    index: Index, sources: DataFrame, blocks: DataFrame, encode: Callable[[Column], Column],
    count: X.TokenCounter = X.whitespace_tokens, limits: Limits = LIMITS, fail_fast: bool = True, parsed: bool = False,
) -> DataFrame:
    """Index documents (doc_id, path, path_order, file_sha256, filename, mime) from their blocks.

    Returns (doc_id, path, path_order, status, chunks, reason) of all of them.  With
    ``fail_fast`` the documents before the first refused one are indexed and then
    its reason is raised; otherwise refused ones are reported and the rest indexed.
    ``parsed`` says that ``blocks`` are cheap to make again from written rows, so they are not
    written themselves and the exchange that made them serves the sections too.
    """
    if not sources.groupBy("doc_id").count().where("count > 1").isEmpty():
        raise IngestError(index.path, "a document comes twice in one batch")
    blocks = blocks if parsed else cut_lineage(blocks)
    readable = blocks.where(~S.is_unreadable(F.col("kind")))
    # What a document says of itself joins where its passages lie by document already, so they are
    # exchanged no further; texts to embed are made of two columns again.
    origin = sources.select(
        "doc_id", F.col("doc_id").alias("source_path"), "file_sha256", "filename", "mime",
        F.lit(limits.pipeline_version).alias("pipeline_version"),
    )
    cut = cut_lineage(passages(readable, count, limits).drop("embed_text").join(origin, "doc_id"))
    per_block = blocks.groupBy("doc_id").agg(
        F.count("*").alias("n_blocks"),
        F.max(F.when(S.is_unreadable(F.col("kind")), F.col("text"))).alias("reason"),
    )
    per_chunk = cut.where("is_first").groupBy("doc_id").agg(F.count("*").alias("n_chunks"))
    judged = chunk_gates(
        sources.select("doc_id", "path", "path_order").join(per_block, "doc_id", "left").join(per_chunk, "doc_id", "left"),
        limits,
    )
    judged = cut_lineage(judged)
    failure = first_failure(judged) if fail_fast else None
    good = judged.where(F.col("reason").isNull())
    if failure is not None:
        good = good.where(F.col("path_order") < failure.path_order)
    good = good.select("doc_id")
    origin = origin.join(good, "doc_id")
    if good.isEmpty():
        return _raise_or(failure, judged)
    gen = index.claim()
    if failure is not None or not judged.where(F.col("reason").isNotNull()).isEmpty():
        cut = cut.join(good, "doc_id", "left_semi")
    children = child_rows(with_embed_text(cut), *_ORIGIN).withColumn("text_hash", text_hash(F.col("embed_text")))
    cache = index.cache()
    found = None if cache is None else cut_lineage(known(children.select("text_hash"), cache, index.model_id, index.model_revision))
    fresh = missing_texts(children, found).select(
        F.lit(index.model_id).alias("model_id"), F.lit(index.model_revision).alias("model_revision"),
        "text_hash", encode(F.col("embed_text")).cast("array<float>").alias("vector"),
    )
    index.write("embeddings", fresh, gen)
    written = index.spark.read.schema(EMBEDDINGS).parquet(f"{index.path}/embeddings/gen={gen}")
    made = written.agg(F.count("*").alias("n"), F.min(F.size("vector")).alias("least"), F.max(F.size("vector")).alias("most")).collect()[0]
    if made.least != made.most:
        raise IngestError(index.path, "the encoder made vectors of different lengths")
    dim = made.least if made.least is not None else index.dim
    index.check_dim(dim)
    index.write("filters", filter_rows(written.select("text_hash"), made.n, index.buckets), gen)
    vectors = written.select("text_hash", "vector")
    vectors = attach_vectors(children.drop("embed_text"), vectors if found is None else vectors.unionByName(found))
    vectors = with_embed_text(vectors).withColumn("dl", F.size(X.index_terms(F.col("embed_text"))).cast("bigint"))
    index.write("children", vectors.select(*CHILD_COLUMNS, "dl", "vector"), gen)
    stored = with_embed_text(index.spark.read.parquet(f"{index.path}/children/gen={gen}"))
    if not stored.where(F.col("vector").isNull()).isEmpty():
        raise IngestError(index.path, "the encoder left texts without a vector")
    index.write("parents", parent_rows(cut, *_ORIGIN).select(*PARENT_COLUMNS), gen)
    index.write_postings(stored, gen)
    index.write_cells(stored, gen)
    manifest = origin.select(
        "doc_id", "source_path", "file_sha256", "pipeline_version",
        F.lit(index.model_id).alias("model_id"), F.lit(index.model_revision).alias("model_revision"),
    )
    if index.exists:
        index.write("superseded", index.superseded_by(good), gen)
    index.write("files", manifest, gen)
    index.commit(gen, dim)
    return _raise_or(failure, judged)


def first_failure(judged: DataFrame):
    rows = judged.where(F.col("reason").isNotNull()).orderBy("path_order").select("path", "path_order", "reason").limit(1)
    found = rows.collect()
    return found[0] if found else None


def _raise_or(failure, judged: DataFrame) -> DataFrame:
    if failure is not None:
        raise IngestError(failure.path, failure.reason)
    return judged.select(
        "doc_id", "path", "path_order",
        F.when(F.col("reason").isNull(), "indexed").otherwise("refused").alias("status"),
        F.when(F.col("reason").isNull(), F.col("n_chunks")).otherwise(F.lit(0)).alias("chunks"), "reason",
    )


def ingest(
    spark: SparkSession, path: str, index_dir: str,
    encode: Callable[[Column], Column] = hash_vector, count: X.TokenCounter = X.whitespace_tokens,
    model_id: str = HASH_MODEL, model_revision: str = HASH_REVISION,
    limits: Limits = LIMITS, fail_fast: bool = True, buckets: int = BUCKETS,
) -> DataFrame:
    """Bring an index up to date with a folder or a file; ``buckets`` counts for a new index.

    Unchanged files are skipped, without being opened where size and time tell; changed ones replace all their rows.  Files gone
    from disk keep theirs.  Returns (doc_id, status, chunks, reason) in path order.
    """
    listing = S.list_files(spark, path, index_dir, limits)
    return ingest_listed(listing, index_dir, encode, count, model_id, model_revision, limits, fail_fast, buckets)


def ingest_listed(
    listing: DataFrame, index_dir: str,
    encode: Callable[[Column], Column] = hash_vector, count: X.TokenCounter = X.whitespace_tokens,
    model_id: str = HASH_MODEL, model_revision: str = HASH_REVISION,
    limits: Limits = LIMITS, fail_fast: bool = True, buckets: int = BUCKETS,
) -> DataFrame:
    """The same for files already listed, however they were found."""
    index = Index(listing.sparkSession, index_dir, model_id, model_revision, limits.pipeline_version, buckets)
    listing = cut_lineage(listing.withColumn("seen", F.lit(time.time_ns() // 1000)))
    digested = S.with_digest(listing, index.read_times())
    listed = cut_lineage(split_unchanged(digested, index.files() if index.exists else None, index))
    index.keep_times(listed.where(F.col("opened") & F.col("file_sha256").isNotNull()))
    failure = first_failure(listed) if fail_fast else None
    usable = listed if failure is None else listed.where(F.col("path_order") < failure.path_order)
    changed = usable.where(F.col("reason").isNull() & ~F.col("skipped"))
    mimes = [r.mime for r in changed.select("mime").distinct().collect()]
    report = listed.where(F.col("reason").isNotNull() | F.col("skipped")).select(
        "doc_id", "path", "path_order",
        F.when(F.col("reason").isNull(), "skipped").otherwise("refused").alias("status"),
        F.lit(0).cast("bigint").alias("chunks"), "reason",
    )
    if mimes:
        ordered = sorted(mimes, key=list(MIMES.values()).index)
        blocks = S.parse_files(changed, ordered)
        report = report.unionByName(index_blocks(index, changed, blocks, encode, count, limits, fail_fast))
    if failure is not None:
        raise IngestError(failure.path, failure.reason)
    return report.orderBy("path_order").select("doc_id", "status", "chunks", "reason")
