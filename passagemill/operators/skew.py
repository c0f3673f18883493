"""Joins that stay even when few keys hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hot_keys(left: DataFrame, key: str, share: int = 1000) -> DataFrame:
    """Keys with more than 1/``share`` of all rows: fewer than ``share`` of them, whatever the data."""
    counted = left.groupBy(key).agg(F.count("*").alias("_n"))
    total = left.agg(F.count("*").alias("_total"))
    limit = total.collect()[0]["_total"] / share
    return counted.where(F.col("_n") > F.lit(max(limit, 1.0))).select(key)


def join_hot(left: DataFrame, right: DataFrame, key: str, how: str = "inner", share: int = 1000) -> DataFrame:
    """Join on a key unique in ``right``: hot keys by broadcast, the others by shuffle.

    The broadcast side has fewer than ``share`` rows, and no shuffled key holds
    more than 1/``share`` of the rows.
    """
    hot = F.broadcast(hot_keys(left, key, share))
    few = F.broadcast(right.join(hot, key, "left_semi"))
    spread = left.join(hot, key, "left_anti").join(right, key, how)
    return spread.unionByName(left.join(hot, key, "left_semi").join(few, key, how))
