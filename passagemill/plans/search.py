"""Search queries: lexical, dense, fused, reranked, cascaded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagemill.functions.hashing import hash_vector
from passagemill.operators import cells, fusion, lexical, postings, rerank, retrieval
from passagemill.operators.dense import dense_topk
from passagemill.operators.topk import cut_lineage
from passagemill.plans import common as C

QUERIES = {}
SQL = {}


def _add(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return keep


def _rounded(df: DataFrame, id_column: str = "chunk_id") -> DataFrame:
    return df.select(
        "qid", F.col("rank").cast("bigint").alias("rank"), id_column, F.round("score", 6).alias("score")
    )


@_add("lex_term_df", C.sql("SELECT term, df FROM df_doc_chunk", "df_doc_chunk"))
def lex_term_df(spark: SparkSession, sf: str) -> DataFrame:
    return lexical.term_df(C.document_chunks(spark, sf))


@_add("lex_doc_stats", C.sql(
    "SELECT n_all::BIGINT AS n, round(avgdl, 6) AS avgdl FROM stats_doc_chunk", "stats_doc_chunk"))
def lex_doc_stats(spark: SparkSession, sf: str) -> DataFrame:
    return lexical.corpus_stats(C.document_chunks(spark, sf)).select("n", F.round("avgdl", 6).alias("avgdl"))


@_add("lex_postings", C.sql("""
    SELECT chunk_id, term, count(*) AS tf, max(len(terms)) AS dl, string_agg(pos - 1, ' ' ORDER BY pos) AS positions
    FROM (SELECT chunk_id, terms, unnest(terms) AS term, generate_subscripts(terms, 1) AS pos FROM terms_doc_chunk)
    GROUP BY chunk_id, term""", "terms_doc_chunk"))
def lex_postings(spark: SparkSession, sf: str) -> DataFrame:
    rows = postings.posting_rows(postings.of_chunks(C.document_chunks(spark, sf)))
    return rows.withColumn("positions", F.array_join(F.col("positions").cast("array<string>"), " "))


SQL_DOC_FILTER = C.sql("""
    SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank, chunk_id,
           round(score, 6) AS score
    FROM score_child JOIN labels ON labels.doc_id = score_child.doc_id
    WHERE score_child.doc_id = qid QUALIFY rank <= 20""", "score_child")
_BM25 = C.sql(
    "SELECT qid, rank, chunk_id, round(score, 6) AS score FROM lexical_doc_chunk", "lexical_doc_chunk"
)


@_add("bm25_top20", _BM25)
def bm25_top20(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(lexical.bm25_topk(C.document_chunks(spark, sf), C.queries(spark, sf), carry=("chunk_id",)))


@_add("bm25_postings_top20", _BM25)
def bm25_postings_top20(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(postings.search(postings.of_chunks(C.document_chunks(spark, sf)), C.queries(spark, sf)))


@_add("bm25_postings_filter", SQL_DOC_FILTER)
def bm25_postings_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Filtered search opens only the ranges that hold the filter's document."""
    return _rounded(postings.search(postings.of_chunks(C.line_children(spark, sf)), _filtered_queries(spark, sf)))


def _filtered_queries(spark: SparkSession, sf: str) -> DataFrame:
    """Each benchmark item asked of the labelled document its number falls on."""
    labels = C.table(spark, sf, "labels").select(F.col("doc_id").alias("qid"), F.col("doc_id").cast("string").alias("only"))
    return C.queries(spark, sf).join(labels, "qid").select("qid", "q", F.col("only").alias("doc_filter"))


@_add("bm25_doc_filter", SQL_DOC_FILTER)
def bm25_doc_filter(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(lexical.bm25_topk(C.line_children(spark, sf), _filtered_queries(spark, sf)))


def _label_queries(vectors: DataFrame) -> DataFrame:
    """One query per label: the mean of its vectors."""
    parts = vectors.select(
        F.col("label").cast("bigint").alias("qid"), F.posexplode("embedding").alias("i", "x")
    )
    means = parts.groupBy("qid", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return means.groupBy("qid").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("vector")
    )


_CENTROIDS = """
    WITH part AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
    mean AS (SELECT label AS qid, i, avg(x) AS x FROM part GROUP BY ALL),
    centroid AS (SELECT qid::BIGINT AS qid, list(x ORDER BY i) AS qv FROM mean GROUP BY qid),
    sim AS (SELECT qid, vec_id AS chunk_id, label, round(list_cosine_similarity(qv, embedding::DOUBLE[]), 9) AS score
            FROM centroid, embeddings)
    SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank, chunk_id,
           round(score, 6) AS score FROM sim {where} QUALIFY rank <= 20"""


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    return C.spread(C.table(spark, sf, "embeddings")).select(
        F.col("vec_id").alias("chunk_id"), F.col("label").alias("doc_id"), F.col("embedding").alias("vector")
    )


@_add("dense_top20", _CENTROIDS.format(where=""))
def dense_top20(spark: SparkSession, sf: str) -> DataFrame:
    asked = _label_queries(C.table(spark, sf, "embeddings")).withColumn("doc_filter", F.lit(None).cast("string"))
    return _rounded(dense_topk(_vectors(spark, sf), asked, carry=("chunk_id",)))


@_add("dense_filtered", _CENTROIDS.format(where="WHERE label = qid"))
def dense_filtered(spark: SparkSession, sf: str) -> DataFrame:
    asked = _label_queries(C.table(spark, sf, "embeddings")).withColumn("doc_filter", F.col("qid").cast("string"))
    return _rounded(dense_topk(_vectors(spark, sf), asked, carry=("chunk_id",)))


@_add("dense_cells_top20", _CENTROIDS.format(where=""))
def dense_cells_top20(spark: SparkSession, sf: str) -> DataFrame:
    """The same from clustered cells, of which those below a query's floor stay closed."""
    asked = _label_queries(C.table(spark, sf, "embeddings")).withColumn("doc_filter", F.lit(None).cast("string"))
    return _rounded(cells.search(cells.of_vectors(_vectors(spark, sf)), asked))


@_add("dense_cells_filtered", _CENTROIDS.format(where="WHERE label = qid"))
def dense_cells_filtered(spark: SparkSession, sf: str) -> DataFrame:
    asked = _label_queries(C.table(spark, sf, "embeddings")).withColumn("doc_filter", F.col("qid").cast("string"))
    return _rounded(cells.search(cells.of_vectors(_vectors(spark, sf), cell_rows=64), asked))


@_add("hash_embed", f"""
    SELECT doc_id, {", ".join(f"round(v[{i + 1}], 9) AS v{i}" for i in range(8))} FROM (
        SELECT doc_id, [x / sqrt(list_sum([y * y FOR y IN raw])) FOR x IN raw] AS v FROM (
            SELECT doc_id, {C.sql_hash_vector("text", "d:")} AS raw FROM documents))""")
def hash_embed(spark: SparkSession, sf: str) -> DataFrame:
    rows = C.documents(spark, sf, "doc_id", "text").select("doc_id", hash_vector(F.col("text")).alias("v"))
    return rows.select("doc_id", *[F.round(F.col("v")[i], 9).alias(f"v{i}") for i in range(8)])


def _found(spark: SparkSession, sf: str, mode: str) -> DataFrame:
    corpus, asked = C.corpus(spark, sf), C.queries(spark, sf)
    return cut_lineage(
        retrieval.search_legs(corpus, asked, mode, lambda q: hash_vector(q, query=True))
    )


@_add("candidate_lists", C.sql(
    "SELECT qid, leg::BIGINT AS leg, rank, chunk_id, parent_id FROM found", "found"))
def candidate_lists(spark: SparkSession, sf: str) -> DataFrame:
    return _found(spark, sf, "rrf").select(
        "qid", F.col("leg").cast("bigint").alias("leg"), F.col("rank").cast("bigint").alias("rank"),
        "chunk_id", "parent_id",
    )


@_add("rrf_parents", C.sql(
    "SELECT qid, rank, parent_id, round(score, 9) AS score FROM fused_parent", "fused_parent"))
def rrf_parents(spark: SparkSession, sf: str) -> DataFrame:
    fused = fusion.fuse(fusion.parent_lists(_found(spark, sf, "rrf")), "parent_id")
    return fused.select("qid", F.col("rank").cast("bigint").alias("rank"), "parent_id", F.round("score", 9).alias("score"))


@_add("rrf_children", C.sql(
    "SELECT qid, rank, chunk_id, round(score, 9) AS score FROM fused_child", "fused_child"))
def rrf_children(spark: SparkSession, sf: str) -> DataFrame:
    fused = fusion.fuse(_found(spark, sf, "rrf"), "chunk_id")
    return fused.select("qid", F.col("rank").cast("bigint").alias("rank"), "chunk_id", F.round("score", 9).alias("score"))


@_add("best_child", C.sql("SELECT qid, parent_id, child_id FROM best", "best"))
def best_child(spark: SparkSession, sf: str) -> DataFrame:
    found = _found(spark, sf, "rrf")
    return fusion.best_children(found, fusion.fuse(found, "chunk_id"))


_EMIT = """SELECT r.qid AS qid, r.rank AS rank, r.parent_id AS parent_id, text AS parent_text, heading_path, source_path,
    file_sha256, 0 AS page_start, 0 AS page_end, 0 AS start_char, end_char, child_id, round(score, 9) AS score, confident
    FROM ({ranked}) r JOIN parent p ON p.parent_id = r.parent_id"""
_RANKED = {
    "dense": ("""SELECT qid, rank, parent_id, child_id, 1.0::DOUBLE / rank AS score, false AS confident
              FROM (SELECT * FROM plist WHERE leg = 0 AND rank <= 5) JOIN best_dense USING (qid, parent_id)""",
              ("plist", "best_dense")),
    "bm25": ("""SELECT qid, rank, parent_id, child_id, 1.0::DOUBLE / rank AS score, false AS confident
             FROM (SELECT * FROM plist WHERE leg = 1 AND rank <= 5) JOIN best_lexical USING (qid, parent_id)""",
             ("plist", "best_lexical")),
    "rrf": ("""SELECT qid, rank, parent_id, child_id, score, false AS confident
            FROM (SELECT * FROM fused_parent WHERE rank <= 5) JOIN best USING (qid, parent_id)""",
            ("fused_parent", "best")),
    "rerank": ("SELECT qid, rank, parent_id, child_id, score, false AS confident FROM reranked WHERE rank <= 5",
               ("reranked",)),
}
C.CTES["best_dense"] = (("found",), """
    SELECT qid, parent_id, chunk_id AS child_id FROM found WHERE leg = 0
    QUALIFY row_number() OVER (PARTITION BY qid, parent_id ORDER BY rank) = 1""")
C.CTES["best_lexical"] = (("found",), """
    SELECT qid, parent_id, chunk_id AS child_id FROM found WHERE leg = 1
    QUALIFY row_number() OVER (PARTITION BY qid, parent_id ORDER BY rank) = 1""")
C.CTES["slow"] = (("reranked", "agreed"), """
    SELECT *, max(score) OVER (PARTITION BY qid) AS top FROM reranked
    WHERE qid NOT IN (SELECT qid FROM agreed)""")
C.CTES["tau_row"] = (("reranked", "parent", "golden"), """
    SELECT score AS tau FROM (
        SELECT r.score, row_number() OVER (ORDER BY r.score) AS i, count(*) OVER () AS n
        FROM reranked r JOIN parent p USING (parent_id) JOIN golden g USING (qid)
        WHERE r.rank = 1 AND g.must_contain IS NOT NULL AND contains(p.text, g.must_contain) AND p.source_path = g.doc_id)
    WHERE i = n - CAST(ceil(0.95::DOUBLE * n) AS BIGINT) + 1""")
C.CTES["golden"] = (("query",), """
    SELECT qid, q, found.doc_id::VARCHAR AS doc_id, CASE WHEN found.doc_id IS NOT NULL THEN q END AS must_contain,
           CASE WHEN found.doc_id IS NULL THEN 'unanswerable' WHEN lang = 'en' THEN 'lexical' ELSE 'semantic' END AS kind
    FROM query LEFT JOIN (SELECT item_id, min(d.doc_id) AS doc_id FROM benchmark b JOIN documents d
                          ON contains(d.text, b.text) GROUP BY item_id) found ON found.item_id = qid
    LEFT JOIN documents USING (doc_id)""")
C.CTES["cascade_fitted"] = (("slow", "tau_row", "agreed", "best"), """
    SELECT qid, rank, parent_id, child_id, score, count(*) OVER (PARTITION BY qid) = 1 AS confident FROM slow
    WHERE score >= top - abs(top) * 0.15::DOUBLE AND rank <= 5
      AND NOT coalesce(top < (SELECT tau FROM tau_row), false)
    UNION ALL
    SELECT qid, 1, parent_id, child_id, score, true FROM agreed JOIN best USING (qid, parent_id)""")
_CASCADE = """
    SELECT qid, rank, parent_id, child_id, score, count(*) OVER (PARTITION BY qid) = 1 AS confident FROM slow
    WHERE score >= top - abs(top) * 0.15::DOUBLE AND rank <= 5
    UNION ALL
    SELECT qid, 1, parent_id, child_id, score, true FROM agreed JOIN best USING (qid, parent_id)"""
_RANKED["cascade"] = (_CASCADE, ("slow", "agreed", "best"))


def hits_columns(hits: DataFrame) -> DataFrame:
    return hits.drop("mode").withColumn("rank", F.col("rank").cast("bigint")).withColumn("score", F.round("score", 9))


def _mode(name: str, mode: str) -> None:
    ranked, needs = _RANKED[mode]

    @_add(name, C.sql(_EMIT.format(ranked=ranked), *needs, "parent"))
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return hits_columns(retrieval.retrieve(C.corpus(spark, sf), C.queries(spark, sf), mode).hits)


_mode("mode_dense", "dense")
_mode("mode_bm25", "bm25")
_mode("mode_rrf", "rrf")
_mode("rerank_top5", "rerank")
_mode("cascade_hits", "cascade")


@_add("score_band", C.sql("""
    SELECT qid, rank, parent_id, score FROM (SELECT *, max(score) OVER (PARTITION BY qid) AS top FROM reranked)
    WHERE score >= top - abs(top) * 0.15::DOUBLE AND rank <= 5""", "reranked"))
def score_band(spark: SparkSession, sf: str) -> DataFrame:
    corpus, asked = C.corpus(spark, sf), C.queries(spark, sf)
    found = _found(spark, sf, "rrf")
    pairs = retrieval.rerank_pairs(
        corpus, asked, fusion.fuse(found, "chunk_id"), found
    )
    return rerank.apply_band(rerank.rescore(pairs)).select(
        "qid", F.col("rank").cast("bigint").alias("rank"), "parent_id", "score"
    )
