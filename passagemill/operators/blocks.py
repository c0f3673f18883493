"""Operators over rows of blocks: offsets, heading stacks, sections, page chrome."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passagemill.functions import text as X


def _by_doc(order: str = "block_index"):
    return Window.partitionBy("doc_id").orderBy(order)


def drop_blank(blocks: DataFrame, col: str = "text") -> DataFrame:
    return blocks.where(~X.is_blank(F.col(col)))


def number_blocks(blocks: DataFrame, order: str = "position") -> DataFrame:
    """Dense 0-based ``block_index`` within a document."""
    return blocks.withColumn("block_index", F.row_number().over(_by_doc(order)) - 1)


def assign_offsets(blocks: DataFrame) -> DataFrame:
    """Character span of each block in the newline-joined text of its document."""
    running = _by_doc().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.length("text") + 1).over(running) - 1
    return blocks.withColumn("end_char", end.cast("int")).withColumn(
        "start_char", F.col("end_char") - F.length("text")
    )


def stack_any_depth(rows: DataFrame, order: str = "position", level: str = "level", name: str = "name") -> DataFrame:
    """``stack_headings`` for levels of any depth: a fold over the headings of a document, which are its only rows gathered.

    Each heading's path is joined to its row, and rows between headings take the last one.
    """
    heads = rows.where(F.col(level).isNotNull()).select("doc_id", F.struct(F.col(order).alias("at"), F.col(level).alias("l"), F.col(name).alias("name")).alias("h"))
    none = F.array().cast("array<string>")

    def push(state: Column, h: Column) -> Column:
        kept = F.slice(state["stack"], F.lit(1), F.greatest(F.lit(0), h["l"].cast("int") - 1))
        stack = F.when(F.coalesce(h["name"], F.lit("")) != "", F.concat(kept, F.array(h["name"]))).otherwise(kept)
        return F.struct(stack.alias("stack"), F.concat(state["paths"], F.array(X.heading_path(stack))).alias("paths"))

    listed = heads.groupBy("doc_id").agg(F.sort_array(F.collect_list("h")).alias("hs"))
    start = F.struct(none.alias("stack"), none.alias("paths"))
    paths = F.aggregate("hs", start, push, lambda s: s["paths"])
    each = listed.select("doc_id", F.explode(F.arrays_zip(F.col("hs.at").alias(order), paths.alias("_own"))).alias("p"))
    own = each.select("doc_id", F.col(f"p.{order}").alias(order), F.col("p._own").alias("_own"))
    upto = _by_doc(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = rows.join(own, ["doc_id", order], "left").withColumn("heading_path", F.coalesce(F.last("_own", ignorenulls=True).over(upto), F.lit("")))
    return found.drop("_own")


def stack_headings(
    rows: DataFrame, order: str = "position", level: str = "level", name: str = "name", deepest: int = 6
) -> DataFrame:
    """Add ``heading_path``: the headings in force at each row of a document, for formats of ``deepest`` levels.

    A heading of level L keeps at most L-1 entries of the stack and pushes its
    name (an empty name only truncates).  With N the running number of pushes,
    the depth is ``N + min(0, L_i - 1 - N_before_i)`` over the headings so far,
    and the entry at depth k is the last name pushed there, so the stack needs
    one sort of the document and no sequential code.  ``level`` is null on rows
    that are not headings.
    """
    upto = _by_doc(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    push = (F.col(level).isNotNull() & (F.coalesce(F.col(name), F.lit("")) != "")).cast("int")
    out = rows.withColumn("_pushed", F.sum(push).over(upto))
    slack = F.when(F.col(level).isNotNull(), F.col(level) - 1 - (F.col("_pushed") - push))
    out = out.withColumn(
        "_depth", F.col("_pushed") + F.least(F.lit(0), F.coalesce(F.min(slack).over(upto), F.lit(0)))
    )
    at_depth = [
        F.last(F.when((push == 1) & (F.col("_depth") == k), F.col(name)), ignorenulls=True).over(upto)
        for k in range(1, deepest + 1)
    ]
    out = out.withColumn("_stack", F.array(*at_depth))
    path = X.heading_path(F.slice("_stack", F.lit(1), F.col("_depth").cast("int")))
    return out.withColumn("heading_path", path).drop("_pushed", "_depth", "_stack")


def mark_sections(blocks: DataFrame) -> DataFrame:
    """Number runs of blocks that belong together as ``section_id`` (0-based).

    A run shares one heading path; a table or code block is always alone and
    rows of data never mix with other kinds.
    """
    w = _by_doc()
    kind, before = F.col("kind"), F.lag("kind").over(w)
    alone = kind.isin("table", "code") | before.isin("table", "code")
    mixes = (kind == "row") != (before == "row")
    moved = F.col("heading_path") != F.lag("heading_path").over(w)
    starts = F.when(before.isNull() | alone | mixes | moved, 1).otherwise(0)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        drop_blank(blocks)
        .withColumn("_starts", starts)
        .withColumn("section_id", (F.sum("_starts").over(upto) - 1).cast("int"))
        .drop("_starts")
    )


def section_kind(kind: Column) -> Column:
    """The one kind of a group of blocks, or ``prose`` when they differ."""
    return F.when(F.min(kind) == F.max(kind), F.min(kind)).otherwise(F.lit("prose"))


def sections(blocks: DataFrame) -> DataFrame:
    """One row per section with its joined text, span and page range.

    A section is part of one document, whose size is gated at ingest, so the
    collected group is bounded; the grouping reuses the ``doc_id`` partitioning.
    """
    ordered = F.array_sort(F.collect_list(F.struct("block_index", "text")))
    return (
        mark_sections(blocks)
        .groupBy("doc_id", "section_id")
        .agg(
            section_kind(F.col("kind")).alias("kind"),
            F.min("heading_path").alias("heading_path"),
            F.min("start_char").alias("start_char"),
            F.min("page").alias("page_start"),
            F.max("page").alias("page_end"),
            F.count("*").alias("n_blocks"),
            ordered.alias("_ordered"),
        )
        .withColumn("text", F.array_join(F.col("_ordered.text"), "\n"))
        .drop("_ordered")
    )


def page_lines(pages: DataFrame) -> DataFrame:
    """Explode pages (doc_id, page, text) into their visible, stripped lines."""
    split = F.split(F.col("text"), "\\r\\n|[\\n\\r\\x{b}\\x{c}\\x{1c}-\\x{1e}\\x{85}\\x{2028}\\x{2029}]")
    return (
        pages.select("doc_id", "page", F.posexplode(split).alias("line_no", "line"))
        .withColumn("line", X.strip(F.col("line")))
        .where(F.col("line") != "")
    )


def page_chrome(pages: DataFrame, longest: int = 80) -> DataFrame:
    """Short lines found on more than half of the pages of a document."""
    lines = page_lines(pages).where(F.length("line") < longest)
    counted = lines.groupBy("doc_id", "line").agg(F.countDistinct("page").alias("n_pages_with"))
    totals = pages.groupBy("doc_id").agg(F.count("*").alias("n_pages"))
    return counted.join(totals, "doc_id").where(
        (F.col("n_pages") >= 2) & (F.col("n_pages_with") * 2 > F.col("n_pages"))
    )


def drop_page_chrome(pages: DataFrame) -> DataFrame:
    """Rewrite pages without their repeated short lines.

    A document with no such line keeps its pages as they are; one with any loses
    the blank lines of every page too.
    """
    banned = page_chrome(pages).select("doc_id", "line")
    kept = page_lines(pages).join(banned, ["doc_id", "line"], "left_anti")
    rebuilt = kept.groupBy("doc_id", "page").agg(
        F.array_join(F.array_sort(F.collect_list(F.struct("line_no", "line")))["line"], "\n").alias("_clean")
    )
    touched = banned.select("doc_id").distinct().withColumn("_touched", F.lit(True))
    return (
        pages.join(touched, "doc_id", "left")
        .join(rebuilt, ["doc_id", "page"], "left")
        .withColumn(
            "text",
            F.when(F.col("_touched"), F.coalesce(F.col("_clean"), F.lit(""))).otherwise(F.col("text")),
        )
        .drop("_touched", "_clean")
    )
