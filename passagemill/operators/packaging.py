"""Hits as text: display lines, answer prompts, extractive answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _pages(prefix: str, none: str) -> Column:
    span = F.concat(F.lit(prefix), F.col("page_start").cast("string"), F.lit("-"), F.col("page_end").cast("string"))
    return F.when(F.col("page_start") > 0, span).otherwise(F.lit(none))


def format_hit() -> Column:
    """One hit as shown on a terminal: a line of facts, then the passage."""
    facts = F.format_string(
        "%.4f  %s  %s  %s  %s  chars %d-%d  %s",
        F.bround("score", 4),
        F.when(F.col("confident"), "confident").otherwise("uncertain"),
        F.col("source_path"), F.col("heading_path"), _pages("p.", "p.-"),
        F.col("start_char"), F.col("end_char"), F.substring("file_sha256", 1, 12),
    )
    return F.concat(facts, F.lit("\n"), F.col("parent_text"))


def api_hits(hits: DataFrame) -> DataFrame:
    """The columns a client of the service sees."""
    return hits.select(
        "qid", "rank", "parent_id", F.col("parent_text").alias("text"), F.col("heading_path").alias("heading"),
        F.col("source_path").alias("source"), "page_start", "page_end", "score", "confident",
    )


def prompts(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """Numbered passages, then the question: (qid, prompt).  At most five hits per query."""
    head = F.concat(
        F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.col("source_path"), F.lit(" "),
        F.col("heading_path"), F.lit(" "), _pages("pp. ", ""), F.lit("\n"), F.col("parent_text"),
    )
    packed = hits.groupBy("qid").agg(
        F.array_join(F.array_sort(F.collect_list(F.struct("rank", head.alias("part"))))["part"], "\n\n").alias("body")
    )
    return packed.join(queries.select("qid", "q"), "qid").select(
        "qid", F.concat("body", F.lit("\n\nQuestion: "), "q").alias("prompt")
    )


def extractive_answers(hits: DataFrame) -> DataFrame:
    """The first hit as the answer, where no writer is configured: (qid, answer)."""
    return hits.where("rank = 1").select("qid", F.col("parent_text").alias("answer"))
