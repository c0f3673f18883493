"""Second-stage scoring of (query, passage) pairs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passagemill.schemas import LIMITS

# Scores a query column against a passage column; a pandas UDF around a model fits too.
Reranker = Callable[[Column, Column], Column]


def scorer_name(reranker: Reranker) -> str:
    """What a threshold is kept under: ``scorer_id`` of the hook, else where it is defined."""
    named = getattr(reranker, "scorer_id", None)
    return named or f"{getattr(reranker, '__module__', '')}.{getattr(reranker, '__qualname__', repr(type(reranker)))}"


def keyword_overlap(query: Column, text: Column) -> Column:
    """Deterministic scorer: number of distinct lower-case words in common."""
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit("[\\p{L}\\p{N}_]+"), 0)
    return F.size(F.array_intersect(words(query), words(text))).cast("double")


def rescore(pairs: DataFrame, reranker: Reranker = keyword_overlap) -> DataFrame:
    """Pairs (qid, q, chunk_id, parent_id, embed_text, fused_rank) to parents in order.

    A parent takes the score of its best child; equal scores keep the fused order.
    """
    scored = pairs.withColumn("score", reranker(F.col("q"), F.col("embed_text")))
    per_parent = Window.partitionBy("qid", "parent_id").orderBy(F.desc("score"), F.asc("fused_rank"))
    per_query = Window.partitionBy("qid").orderBy(F.desc("score"), F.asc("fused_rank"))
    return (
        scored.withColumn("_n", F.row_number().over(per_parent))
        .where("_n = 1")
        .withColumn("rank", F.row_number().over(per_query))
        .select("qid", "parent_id", F.col("chunk_id").alias("child_id"), "score", "rank")
    )


def apply_band(
    ranked: DataFrame, band: float = LIMITS.score_band, most: int = LIMITS.max_parents
) -> DataFrame:
    """Keep parents within the band below the top score, at most ``most``.

    ``confident`` tells whether exactly one was kept.
    """
    whole = Window.partitionBy("qid")
    kept = (
        ranked.withColumn("_top", F.max("score").over(whole))
        .where(F.col("score") >= F.col("_top") - F.abs("_top") * F.lit(band))
        .where(F.col("rank") <= most)
    )
    return kept.withColumn("confident", F.count("*").over(whole) == 1).drop("_top")


def below_threshold(ranked: DataFrame, tau: float | None) -> DataFrame:
    """Queries whose best score is under the stored threshold: they abstain."""
    best = ranked.where("rank = 1")
    return best.where(F.lit(False) if tau is None else F.col("score") < F.lit(float(tau))).select("qid")
