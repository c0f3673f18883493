"""The whole path: stream documents into an index, then search the stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagemill import api
from passagemill.functions import text as X
from passagemill.operators import retrieval
from passagemill.operators.blocks import assign_offsets
from passagemill.operators.postings import search
from passagemill.operators.topk import scratch_path
from passagemill.plans import common as C
from passagemill.plans import search as P
from passagemill.plans import texts  # noqa: F401 - defines the SQL of the chunker
from passagemill.streaming.ingest import stream_blocks

QUERIES = {}
SQL = {}


def _to_blocks(texts: DataFrame) -> DataFrame:
    lines = F.filter(F.transform(F.split("text", "\n"), X.strip), lambda line: line != "")
    rows = texts.select(
        "doc_id", F.posexplode(lines).alias("block_index", "text"), F.lit("prose").alias("kind"),
        F.col("filename").alias("heading_path"), F.lit(0).alias("page"),
    )
    return assign_offsets(rows)


def _stream(spark: SparkSession, documents: DataFrame, home: str, checkpoint: str) -> None:
    rows = documents.select(
        F.col("doc_id").cast("string").alias("doc_id"), "text", F.col("source").alias("filename"), F.lit("text/plain").alias("mime"))
    stream_blocks(rows, _to_blocks, f"{home}/index", f"{home}/{checkpoint}").awaitTermination()


def _streamed_index(spark: SparkSession, sf: str):
    home = scratch_path(spark)
    schema = C.table(spark, sf, "documents").schema
    # A glob, so that one file and a folder of files are read alike.
    _stream(spark, spark.readStream.schema(schema).parquet(f"{sf}/documents.parque[t]"), home, "first")
    return api.open_index(spark, f"{home}/index")


SQL["stream_ingest_search"] = C.sql(
    "SELECT qid, rank, chunk_id, round(score, 6) AS score FROM lexical_chunk_child", "lexical_chunk_child")


def stream_ingest_search(spark: SparkSession, sf: str) -> DataFrame:
    """BM25 over the postings of an index that a stream has just built."""
    found = search(_streamed_index(spark, sf).postings(), C.queries(spark, sf))
    return found.select(
        "qid", F.col("rank").cast("bigint").alias("rank"), "chunk_id", F.round("score", 6).alias("score")
    )


QUERIES["stream_ingest_search"] = stream_ingest_search


# --- answers of the stored index: real chunks, stored postings, cells and lookups -----------------

_STORED = {
    "child": (("chunk_child",), "SELECT chunk_id, parent_id, doc_id, embed_text, child_index FROM chunk_child"),
    # Vectors are stored in single precision.
    "child_vector": (("child",), f"""
        SELECT chunk_id, parent_id, doc_id, [(x / sqrt(list_sum([y * y FOR y IN raw])))::FLOAT FOR x IN raw]::DOUBLE[] AS v
        FROM (SELECT *, {C.sql_hash_vector('embed_text', 'd:')} AS raw FROM child)"""),
    "parent": (("chunk_parent",), """
        SELECT parent_id, p.text, p.source AS heading_path, p.doc_id::VARCHAR AS source_path, sha256(d.text) AS file_sha256,
               start_char, start_char + length(p.text) AS end_char FROM chunk_parent p JOIN documents d USING (doc_id)"""),
}
_EMIT = P._EMIT.replace("0 AS start_char", "start_char")


def _stored_sql(main: str, *needs: str, **other) -> str:
    changed = _STORED | other
    saved = {k: C.CTES[k] for k in changed}
    C.CTES.update(changed)
    try:
        return C.sql(main, *needs)
    finally:
        C.CTES.update(saved)


def _index_hits(name: str, mode: str) -> None:
    ranked, needs = P._RANKED[mode]
    SQL[name] = _stored_sql(_EMIT.format(ranked=ranked), *needs, "parent")

    def run(spark: SparkSession, sf: str) -> DataFrame:
        return P.hits_columns(retrieval.retrieve(_streamed_index(spark, sf).corpus(), C.queries(spark, sf), mode).hits)

    QUERIES[name] = run


_index_hits("index_rrf_hits", "rrf")
_index_hits("index_cascade_hits", "cascade")

_REVISED = "CASE WHEN doc_id % 5 = 0 THEN 'revised ' || substr(text, 1, 300) ELSE text END"
SQL["stream_replace_search"] = _stored_sql(
    "SELECT qid, rank, chunk_id, round(score, 6) AS score FROM lexical_chunk_child", "lexical_chunk_child",
    line=((), C.CTES["line"][1].replace("FROM documents)", f"FROM (SELECT doc_id, source, {_REVISED} AS text FROM documents))")))


def stream_replace_search(spark: SparkSession, sf: str) -> DataFrame:
    """BM25 after a second stream has replaced every fifth document: postings without the superseded passages."""
    index = _streamed_index(spark, sf)
    revised = F.concat(F.lit("revised "), F.substring("text", 1, 300))
    home = index.path.removesuffix("/index")
    again = C.table(spark, sf, "documents").where("doc_id % 5 = 0").select("doc_id", revised.alias("text"), "source")
    again.write.parquet(f"{home}/again")
    _stream(spark, spark.readStream.schema(again.schema).parquet(f"{home}/again"), home, "second")
    index.refresh()
    return P._rounded(search(index.postings(), C.queries(spark, sf)))


QUERIES["stream_replace_search"] = stream_replace_search
