"""Scoring retrieval against a golden set."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from passagemill.operators.order import order_statistic
from passagemill.schemas import LIMITS, NO_CONFIDENT_HIT

# Which mode wins when recall, rank and speed are equal.
PREFERENCE = {"rerank": 0, "rrf": 1, "cascade": 2, "dense": 3, "bm25": 4}
# Slack in recall and in median time when picking the live mode.
RECALL_SLACK, TIME_FACTOR, TIME_SLACK_MS = 0.05, 1.25, 50.0


def matches(hits: DataFrame, golden: DataFrame) -> DataFrame:
    """Hits that contain their query's needle and come from its document."""
    wanted = golden.where((F.coalesce("must_contain", F.lit("")) != "") & (F.coalesce("doc_id", F.lit("")) != ""))
    return hits.join(wanted.select("qid", "doc_id", "must_contain"), "qid").where(
        F.col("parent_text").contains(F.col("must_contain")) & (F.col("source_path") == F.col("doc_id"))
    )


def grade(golden: DataFrame, hits: DataFrame, status: DataFrame, k: int = LIMITS.recall_k) -> DataFrame:
    """One row per query and mode: hit within k, reciprocal rank, abstention."""
    first = matches(hits, golden).groupBy("qid", "mode").agg(F.min("rank").alias("first_rank"))
    answerable = F.coalesce("must_contain", F.lit("")) != ""
    return (
        status.join(golden.select("qid", "kind", answerable.alias("answerable")), "qid")
        .join(first, ["qid", "mode"], "left")
        .select(
            "qid", "mode", "kind", "answerable",
            F.coalesce(F.col("first_rank") <= k, F.lit(False)).cast("double").alias("hit"),
            F.coalesce(1.0 / F.col("first_rank"), F.lit(0.0)).alias("reciprocal"),
            (F.col("reason") == NO_CONFIDENT_HIT).cast("double").alias("abstained"),
        )
    )


def roll_up(graded: DataFrame, timings: DataFrame | None = None) -> DataFrame:
    """Scores per mode over all rows and per kind: recall, mrr, abstain, n, p50.

    Recall and mrr average answerable rows only and are 0 where there are none.
    ``timings`` (qid, mode, ms) adds the lower median per group.
    """
    scored = graded.groupingSets([["mode"], ["mode", "kind"]], "mode", "kind").agg(
        F.grouping("kind").alias("_all"),
        F.coalesce(F.avg(F.when(F.col("answerable"), F.col("hit"))), F.lit(0.0)).alias("recall"),
        F.coalesce(F.avg(F.when(F.col("answerable"), F.col("reciprocal"))), F.lit(0.0)).alias("mrr"),
        F.avg("abstained").alias("abstain"),
        F.count("*").alias("n"),
    )
    scored = scored.withColumn("kind", F.when(F.col("_all") == 1, "all").otherwise(F.col("kind"))).drop("_all")
    if timings is None:
        return scored.withColumn("p50", F.lit(0.0))
    timed = graded.select("qid", "mode", F.explode(F.array(F.col("kind"), F.lit("all"))).alias("kind")).join(timings, ["qid", "mode"])
    middle = lower_median(timed, ["mode", "kind"], "ms").drop("n")
    return scored.join(middle, ["mode", "kind"], "left").fillna(0.0, ["p50"])


def rank_one_scores(golden: DataFrame, rerank_hits: DataFrame) -> DataFrame:
    """Scores of first hits of the rerank mode that are right."""
    return matches(rerank_hits.where("rank = 1"), golden).select("qid", "score")


def fit_tau(scores: DataFrame, keep: float = LIMITS.tau_keep) -> DataFrame:
    """The score that keeps ``keep`` of the values, from the top; no row if there are none.

    It is the value at index n - ceil(keep * n) in ascending order.
    """
    return order_statistic(scores, [], "score", lambda n: n - F.ceil(F.lit(keep) * n) + 1, "tau").select("tau")


def pick_live(scores: DataFrame) -> DataFrame:
    """The mode to serve: recall near the best, then fast, then best ranked.

    At most one row per mode is left, so the global window holds five rows.
    """
    w = Window.partitionBy(F.lit(1))
    preference = F.create_map(*[F.lit(x) for pair in PREFERENCE.items() for x in pair])
    overall = scores.where(F.col("kind") == "all").withColumn("_best", F.max("recall").over(w))
    eligible = overall.where(F.col("recall") + RECALL_SLACK >= F.col("_best"))
    near = eligible.withColumn("_fast", F.min("p50").over(w)).where(
        F.col("p50") <= F.col("_fast") * TIME_FACTOR + TIME_SLACK_MS
    )
    order = [F.desc("mrr"), F.asc("p50"), F.coalesce(preference[F.col("mode")], F.lit(9)).asc()]
    return near.orderBy(*order).limit(1).select("mode", "recall", "mrr", "p50")


def span_hit(golden: DataFrame, answers: DataFrame, hits: DataFrame) -> DataFrame:
    """Share of rows with an ``expect`` whose answer holds it, case aside.

    Only queries with a right hit among the first k are credited; ``answers`` is
    (qid, answer).
    """
    graded = golden.where(F.coalesce("expect", F.lit("")) != "")
    right = matches(hits, golden).where(F.col("rank") <= LIMITS.recall_k).select("qid").distinct()
    credited = right.join(answers, "qid")
    got = F.coalesce(F.contains(F.lower("answer"), F.lower("expect")), F.lit(False))
    return graded.join(credited, "qid", "left").agg(
        F.avg(got.cast("double")).alias("span_hit"), F.count("*").alias("span_n")
    )


def lower_median(samples: DataFrame, groups: list[str], value: str) -> DataFrame:
    """Middle sample per group, the lower one of an even count."""
    return order_statistic(samples, groups, value, lambda n: F.floor((n + 1) / 2), "p50")
