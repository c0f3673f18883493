"""Batches of queries to ranked parent passages, in five modes."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagemill.functions import text as X
from passagemill.functions.hashing import hash_vector
from passagemill.operators import cells as clustered
from passagemill.operators import fusion, rerank
from passagemill.operators.dense import dense_topk
from passagemill.operators.lexical import bm25_topk
from passagemill.operators.postings import Postings, search
from passagemill.operators.topk import cut_lineage
from passagemill.schemas import HIT_COLUMNS, LIMITS, NO_CONFIDENT_HIT, QueryError

Encoder = Callable[[Column], Column]


@dataclass
class Corpus:
    """What a search reads.

    ``children`` (chunk_id, parent_id, doc_id, embed_text, vector) and ``parents``
    are tables; ``postings`` and ``cells`` give the inverted and clustered ones where they are stored.
    """

    children: DataFrame
    parents: DataFrame
    postings: Callable[[], Postings] | None = None
    cells: Callable[[], clustered.Cells] | None = None
    tau: float | None = None
    buckets: int | None = None

    def lookup(self, rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
        """Join ``wanted``, a few rows per query, to stored rows by id.

        It is written first, so that its true size decides how Spark joins it; of bucketed
        tables only the partitions of its ids are opened.
        """
        wanted = cut_lineage(wanted)
        if self.buckets is not None and "bucket" in rows.columns:
            # At most ``buckets`` numbers, whatever the batch holds.
            code = F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int").alias("bucket")
            rows = rows.where(F.col("bucket").isin([r.bucket for r in wanted.select(code).distinct().collect()] or [-1]))
        return rows.join(wanted, key)

    def of(self, found: DataFrame) -> Corpus:
        """The corpus with the parents of these candidates alone, written, for several modes to fetch theirs from."""
        ids = found.select("parent_id").distinct()
        return replace(self, parents=cut_lineage(self.lookup(self.parents, "parent_id", ids)))


@dataclass
class Retrieval:
    """``hits`` in rank order per query and one ``status`` row (qid, mode, reason) per query."""

    hits: DataFrame
    status: DataFrame
    legs: DataFrame | None = field(default=None, repr=False)
    ordered: DataFrame | None = field(default=None, repr=False)


def batch(queries: DataFrame) -> DataFrame:
    """Complete a query table to (qid, q, doc_filter); an empty filter is none."""
    if "doc_filter" not in queries.columns:
        queries = queries.withColumn("doc_filter", F.lit(None).cast("string"))
    return queries.withColumn("doc_filter", F.when(F.col("doc_filter") != "", F.col("doc_filter")))


def require_text(queries: DataFrame) -> None:
    if queries.where(F.col("q").isNull() | X.is_blank(F.col("q"))).limit(1).count():
        raise QueryError("empty query")


def search_legs(
    corpus: Corpus, queries: DataFrame, mode: str, encode: Encoder, limits=LIMITS
) -> DataFrame:
    """Candidates of the lists the mode needs; the encoder is not run for bm25."""
    dense = lexical = None
    if mode != "bm25":
        vectors = queries.withColumn("vector", encode(F.col("q")))
        if corpus.cells is not None:
            dense = clustered.search(corpus.cells(), vectors, limits.dense_k)
        else:
            dense = dense_topk(corpus.children, vectors, limits.dense_k)
    if mode != "dense":
        if corpus.postings is not None:
            lexical = search(corpus.postings(), queries, limits.lexical_k)
        else:
            lexical = bm25_topk(corpus.children, queries, limits.lexical_k)
    return fusion.candidates(dense, lexical)


def emit(corpus: Corpus, ranked: DataFrame, mode: str) -> DataFrame:
    """Fetch the parents of ranked rows; texts are read for these rows only."""
    bucket = [c for c in ("bucket",) if c in corpus.parents.columns]
    parents = corpus.parents.select(
        *bucket, "parent_id", F.col("text").alias("parent_text"), "heading_path", "source_path",
        "file_sha256", "page_start", "page_end", "start_char", "end_char",
    )
    return (
        corpus.lookup(parents, "parent_id", ranked)
        .withColumn("mode", F.lit(mode))
        .select(*HIT_COLUMNS)
    )


def rerank_pairs(
    corpus: Corpus, queries: DataFrame, fused_children: DataFrame, found: DataFrame, limits=LIMITS
) -> DataFrame:
    """The first fused children of each query with their texts."""
    owner = found.select("qid", "chunk_id", "parent_id").distinct()
    top = (
        fused_children.where(F.col("rank") <= limits.rerank_k)
        .select("qid", "chunk_id", F.col("rank").alias("fused_rank"))
        .join(owner, ["qid", "chunk_id"])
        .join(queries.select("qid", "q"), "qid")
    )
    columns = [c for c in ("bucket", "chunk_id", "embed_text") if c in corpus.children.columns]
    return corpus.lookup(corpus.children.select(*columns), "chunk_id", top)


def rank_mode(
    corpus: Corpus,
    queries: DataFrame,
    found: DataFrame,
    mode: str,
    reranker: rerank.Reranker | None,
    limits=LIMITS,
    ordered: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """Ranked parents (qid, rank, parent_id, child_id, score, confident), abstaining queries and
    all parents as the reranker ordered them.  Pairs are scored once and written; ``ordered``
    takes over those of another mode."""
    # One exchange by query; every grouping and window below has the query in its key.
    found = found.repartition("qid")
    lists = fusion.parent_lists(found)
    fused_children = fusion.fuse(found, "chunk_id", limits.rrf_k)

    def listed(parents: DataFrame, confident: bool) -> DataFrame:
        kept = parents.where(F.col("rank") <= limits.max_parents)
        return kept.join(fusion.best_children(found, fused_children), ["qid", "parent_id"]).select(
            "qid", "rank", "parent_id", "child_id", "score", F.lit(confident).alias("confident")
        )

    if mode == "dense":
        return listed(fusion.list_scores(lists, fusion.DENSE), False), None, None
    if mode == "bm25":
        return listed(fusion.list_scores(lists, fusion.LEXICAL), False), None, None
    fused_parents = fusion.fuse(lists, "parent_id", limits.rrf_k)
    if mode == "rrf":
        return listed(fused_parents, False), None, None
    if reranker is None:
        raise QueryError("reranker is not available")

    def reranked(children: DataFrame) -> DataFrame:
        return cut_lineage(rerank.rescore(rerank_pairs(corpus, queries, children, found, limits), reranker))

    columns = ["qid", "rank", "parent_id", "child_id", "score", "confident"]
    if mode == "rerank":
        ordered = reranked(fused_children) if ordered is None else ordered
        top = ordered.where(F.col("rank") <= limits.max_parents)
        return top.withColumn("confident", F.lit(False)).select(*columns), None, ordered
    # Agreed queries leave here, so the reranker never sees them.
    fast, slow_only = None, lambda rows: rows
    if mode == "cascade":
        winners = fusion.agreed(fused_parents, limits.agree_top, limits.fast_gap)
        fast = listed(winners.withColumn("rank", F.lit(1)), True)
        slow_only = lambda rows: rows.join(winners.select("qid"), "qid", "left_anti")
    ordered = reranked(slow_only(fused_children)) if ordered is None else slow_only(ordered)
    abstained = rerank.below_threshold(ordered, corpus.tau)
    slow = rerank.apply_band(
        ordered.join(abstained, "qid", "left_anti"), limits.score_band, limits.max_parents
    ).select(*columns)
    return (slow if fast is None else slow.unionByName(fast.select(*columns))), abstained, ordered


def retrieve(
    corpus: Corpus,
    queries: DataFrame,
    mode: str = "cascade",
    reranker: rerank.Reranker | None = rerank.keyword_overlap,
    encode: Encoder = lambda q: hash_vector(q, query=True),
    found: DataFrame | None = None,
    limits=LIMITS,
    ordered: DataFrame | None = None,
) -> Retrieval:
    """Answer a batch of queries (qid, q[, doc_filter]).

    The candidate lists are small and shared by every later step, so they are
    materialised once; pass ``found`` and ``ordered`` to reuse those of another mode.
    """
    queries = batch(queries)
    require_text(queries)
    if found is None:
        found = cut_lineage(search_legs(corpus, queries, mode, encode, limits))
    if mode in ("dense", "bm25"):
        found = found.where(F.col("leg") == (fusion.DENSE if mode == "dense" else fusion.LEXICAL))
    ranked, abstained, ordered = rank_mode(corpus, queries, found, mode, reranker, limits, ordered)
    hits = emit(corpus, ranked, mode)
    status = queries.select("qid", F.lit(mode).alias("mode"))
    if abstained is None:
        status = status.withColumn("reason", F.lit(""))
    else:
        marked = abstained.withColumn("reason", F.lit(NO_CONFIDENT_HIT))
        status = status.join(marked, "qid", "left").fillna("", ["reason"])
    return Retrieval(hits, status, found, ordered)
