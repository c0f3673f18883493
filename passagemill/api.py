"""Entry points: ingest a folder, ask questions, score a golden set."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagemill.functions.hashing import hash_vector
from passagemill.operators import evaluation, rerank, retrieval
from passagemill.operators.index import Index
from passagemill.operators.ingest import HASH_MODEL, HASH_REVISION, ingest
from passagemill.operators.retrieval import Retrieval
from passagemill.operators.topk import cut_lineage
from passagemill.schemas import MODES, QueryError

__all__ = ["ask", "evaluate", "ingest", "open_index", "report", "span_score", "time_modes"]


def _query_vector(q):
    return hash_vector(q, query=True)


def open_index(
    spark: SparkSession, index_dir: str, model_id: str = HASH_MODEL, model_revision: str = HASH_REVISION
) -> Index:
    return Index(spark, index_dir, model_id, model_revision)


def ask(
    index: Index, text: str, doc_id: str | None = None, mode: str = "cascade",
    encode=_query_vector, reranker=rerank.keyword_overlap,
) -> Retrieval:
    """Answer one question; a batch is the same call on ``retrieval.retrieve``."""
    if not text or not text.strip():
        raise QueryError("empty query")
    rows = index.spark.createDataFrame([(0, text, doc_id)], "qid bigint, q string, doc_filter string")
    return retrieval.retrieve(index.corpus(reranker), rows, mode, reranker, encode)


def time_modes(corpus, golden: DataFrame, encode=_query_vector, reranker=rerank.keyword_overlap, modes=MODES) -> DataFrame:
    """Milliseconds of each golden query asked alone, per mode: (qid, mode, ms).

    A latency is that of one query, so this asks them one at a time; it is meant
    for the few dozen rows of a hand-written set.
    """
    spark = golden.sparkSession
    rows = golden.select("qid", "q").orderBy("qid").collect()
    samples = []
    for mode in modes:
        for row in rows:
            one = spark.createDataFrame([(row.qid, row.q)], "qid bigint, q string")
            start = time.perf_counter()
            retrieval.retrieve(corpus, one, mode, reranker, encode).hits.collect()
            samples.append((row.qid, mode, (time.perf_counter() - start) * 1000.0))
    return spark.createDataFrame(samples, "qid bigint, mode string, ms double")


def evaluate(
    corpus, golden: DataFrame, encode=_query_vector, reranker=rerank.keyword_overlap,
    timings: DataFrame | None = None, save_tau=None,
) -> tuple[DataFrame, float | None, dict[str, Retrieval]]:
    """Scores of all modes over a golden set, the fitted threshold, and the answers.

    The four modes without a threshold run first; the threshold is fitted on the
    rerank scores and stored through ``save_tau``; the cascade then runs with it,
    or with the stored one when nothing could be fitted.
    """
    asked = golden.select("qid", "q")
    answers: dict[str, Retrieval] = {}
    asking = retrieval.batch(asked)
    retrieval.require_text(asking)
    found = cut_lineage(retrieval.search_legs(corpus, asking, "rrf", encode))
    near = corpus.of(found)
    for mode in [m for m in MODES if m != "cascade"]:
        answers[mode] = retrieval.retrieve(near, asked, mode, reranker, encode, found)
    fitted = evaluation.fit_tau(evaluation.rank_one_scores(golden, answers["rerank"].hits)).collect()
    tau = fitted[0].tau if fitted else None
    if tau is not None:
        corpus.tau = near.tau = tau
        if save_tau is not None:
            save_tau(tau)
    ordered = answers["rerank"].ordered
    answers["cascade"] = retrieval.retrieve(near, asked, "cascade", reranker, encode, found, ordered=ordered)
    hits = status = None
    for answer in answers.values():
        hits = answer.hits if hits is None else hits.unionByName(answer.hits)
        status = answer.status if status is None else status.unionByName(answer.status)
    graded = evaluation.grade(golden, hits, status)
    return cut_lineage(evaluation.roll_up(graded, timings)), tau, answers


def span_score(
    golden: DataFrame, scores: DataFrame, answers: dict[str, Retrieval], written: DataFrame
) -> tuple[float | None, int]:
    """Share of golden rows with an ``expect`` that the texts ``written`` (q, answer) hold, and their number.

    A row counts when the mode that the scores choose has found its passage; an abstention has not.
    """
    live = evaluation.pick_live(scores).collect()[0].mode
    texts = golden.select("qid", "q").join(written, "q").select("qid", "answer")
    row = evaluation.span_hit(golden, texts, answers[live].hits).collect()[0]
    return row.span_hit, row.span_n


def report(scores: DataFrame, tau: float | None, span: tuple[float | None, int] = (None, 0)) -> dict:
    """The evaluation as one JSON-ready dict."""
    order = F.create_map(*[F.lit(x) for m in MODES for x in (m, MODES.index(m))])
    rows = scores.orderBy(order[F.col("mode")], F.col("kind") != "all", "kind").collect()
    live = evaluation.pick_live(scores).collect()[0].mode
    by_mode = {r.mode: r for r in rows if r.kind == "all"}
    chosen = by_mode[live]
    verdict = (
        f"{live} is served: recall@5 {chosen.recall:.2f}, MRR {chosen.mrr:.2f}, "
        f"abstain {chosen.abstain:.2f}, median {chosen.p50:.0f} ms."
    )
    if span[0] is not None:
        verdict += f" Answers hold the expected span in {span[0]:.2f} of {span[1]} rows"
        verdict += ", which is weak." if span[0] < 0.5 else "."
    return {
        "tau": tau, "live_mode": live, "span_hit": span[0], "span_n": span[1], "verdict": verdict,
        "scores": [r.asDict() for r in rows],
    }
