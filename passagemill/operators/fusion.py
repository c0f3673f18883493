"""Ranked lists of children to ranked parents: ordering, fusion, agreement.

A candidate row is (qid, leg, rank, chunk_id, parent_id); leg 0 is the dense
list, leg 1 the lexical one.  A batch holds at most two lists of k rows per
query, so these windows run on small, evenly keyed data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from passagemill.schemas import LIMITS

DENSE, LEXICAL = 0, 1


def candidates(dense: DataFrame | None, lexical: DataFrame | None) -> DataFrame:
    """Union of the lists that were searched."""
    legs = [
        df.select("qid", F.lit(leg).alias("leg"), "rank", "chunk_id", "parent_id")
        for leg, df in ((DENSE, dense), (LEXICAL, lexical))
        if df is not None
    ]
    return legs[0] if len(legs) == 1 else legs[0].unionByName(legs[1])


def parent_lists(found: DataFrame) -> DataFrame:
    """Parents of each list by the first of their children: (qid, leg, rank, parent_id)."""
    first = found.groupBy("qid", "leg", "parent_id").agg(F.min("rank").alias("at"))
    w = Window.partitionBy("qid", "leg").orderBy("at")
    return first.select("qid", "leg", "parent_id", F.row_number().over(w).alias("rank"))


def fuse(lists: DataFrame, key: str, k: int = LIMITS.rrf_k) -> DataFrame:
    """Reciprocal-rank fusion of lists (qid, leg, rank, key) without repeats.

    Ties keep the order of first sight: the dense list before the lexical one.
    """
    scored = lists.groupBy("qid", key).agg(
        F.sum(1.0 / (F.lit(k) + F.col("rank"))).alias("score"),
        F.min(F.struct("leg", "rank")).alias("seen"),
        F.min(F.when(F.col("leg") == DENSE, F.col("rank"))).alias("dense_rank"),
        F.min(F.when(F.col("leg") == LEXICAL, F.col("rank"))).alias("lexical_rank"),
    )
    w = Window.partitionBy("qid").orderBy(F.desc("score"), F.asc("seen"))
    return scored.withColumn("rank", F.row_number().over(w))


def list_scores(lists: DataFrame, leg: int) -> DataFrame:
    """Parents of one list scored by the reciprocal of their rank."""
    return lists.where(F.col("leg") == leg).select(
        "qid", "parent_id", "rank", (1.0 / F.col("rank")).alias("score")
    )


def best_children(found: DataFrame, fused_children: DataFrame) -> DataFrame:
    """For each parent its child of highest fused score, ties by first sight."""
    owner = found.select("qid", "chunk_id", "parent_id").distinct()
    w = Window.partitionBy("qid", "parent_id").orderBy(F.desc("score"), F.asc("seen"))
    return (
        fused_children.join(owner, ["qid", "chunk_id"])
        .withColumn("_n", F.row_number().over(w))
        .where("_n = 1")
        .select("qid", "parent_id", F.col("chunk_id").alias("child_id"))
    )


def agreed(fused_parents: DataFrame, top: int = LIMITS.agree_top, gap: float = LIMITS.fast_gap) -> DataFrame:
    """Queries whose winner is near the top of both lists with a distant runner-up."""
    w = Window.partitionBy("qid").orderBy("rank")
    led = fused_parents.withColumn("next_score", F.lead("score").over(w)).where("rank = 1")
    return led.where(
        (F.col("dense_rank") <= top)
        & (F.col("lexical_rank") <= top)
        & (F.col("next_score").isNull() | (F.col("next_score") < F.col("score") * gap))
    ).select("qid", "parent_id", "score")
