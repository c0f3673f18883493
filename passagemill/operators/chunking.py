"""Blocks to parent and child passages.

One shuffle, by document, serves the section windows and the section grouping, a
second one the final de-duplication; everything between them is row-local.  Long texts are
cut into pieces in the JVM, the packer sees only token counts, and passages are
re-joined from pieces, so no step copies a whole section once per passage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passagemill.functions import text as X
from passagemill.functions.hashing import content_id
from passagemill.operators.blocks import sections
from passagemill.operators.packing import NO_TARGET, pack
from passagemill.schemas import LIMITS, Limits

_WHOLE = -1


def _recut(units: Column, too_long: Column, pattern: str) -> Column:
    """Cut every flagged string of an array further; keep the others."""
    return F.flatten(
        F.zip_with(units, too_long, lambda u, t: F.when(t, X.pieces(u, pattern)).otherwise(F.array(u)))
    )


def _long(units: Column, count: X.TokenCounter, cap: int) -> Column:
    return F.transform(count(units), lambda n: n > cap)


def _parent_pieces(df: DataFrame, count: X.TokenCounter, limits: Limits) -> DataFrame:
    """Add ``pieces`` array<struct<raw, unit>> to sections that need cutting, else null."""
    cap = limits.parent_max
    cut = (~F.col("kind").isin("table", "code")) & (F.col("n") > cap)
    rows = F.col("kind") == "row"
    out = df.withColumn(
        "_units",
        F.when(cut & rows, X.pieces(F.col("text"), X.LINES)).when(cut, X.pieces(F.col("text"), X.PARAGRAPHS)),
    )
    long_units = _long(F.col("_units"), count, cap)
    out = out.withColumn(
        "_units",
        F.when(rows, F.col("_units")).otherwise(_recut(F.col("_units"), long_units, X.SENTENCES)),
    )
    out = out.withColumn("_long", F.when(~rows, _long(F.col("_units"), count, cap)))

    # Both arrays are zipped before the lambda: a column named inside one may be
    # computed again for every element.
    def split_words(z: Column, i: Column) -> Column:
        words = F.transform(X.pieces(z["u"], X.WORDS), lambda w: F.struct(w.alias("raw"), i.alias("unit")))
        return F.when(z["long"], words).otherwise(
            F.array(F.struct(z["u"].alias("raw"), F.lit(_WHOLE).alias("unit")))
        )

    no_long = F.transform("_units", lambda u: F.lit(False))
    zipped = F.arrays_zip(F.col("_units").alias("u"), F.coalesce("_long", no_long).alias("long"))
    return out.withColumn("pieces", F.flatten(F.transform(zipped, split_words))).drop("_units", "_long")


def _child_pieces(df: DataFrame, count: X.TokenCounter, limits: Limits) -> DataFrame:
    """Add ``pieces`` array<struct<raw, unit>> to parents that need cutting, else null."""
    text, kind = F.col("text"), F.col("kind")
    lines = X.pieces(text, X.LINES)
    units = (
        F.when(kind == "table", lines)
        .when(F.col("token_count") <= limits.child_max, F.lit(None))
        .when(kind.isin("code", "row"), lines)
        .otherwise(X.pieces(text, X.SENTENCES))
    )
    as_piece = lambda u: F.struct(u.alias("raw"), F.lit(_WHOLE).alias("unit"))
    return df.withColumn("pieces", F.transform(units, as_piece))


def _pack_pieces(
    df: DataFrame, count: X.TokenCounter, target: Column, cap: Column, overlap: Column
) -> DataFrame:
    """Turn ``pieces`` into ``spans`` array<struct<first, last, start, raw>>, null where there are none."""
    table = F.col("kind") == "table"
    out = (
        df.withColumn("raws", F.col("pieces.raw"))
        .withColumn("counts", count(F.col("raws")))
        .withColumn("visible", F.transform("raws", lambda r: ~X.is_blank(r)))
        .withColumn("head", F.when(table, F.array_position("visible", F.lit(True)).cast("int") - 1))
    )
    packed = pack(
        F.col("counts"),
        F.col("pieces.unit"),
        F.col("visible"),
        F.coalesce("head", F.lit(-1)),
        F.transform("raws", F.length),
        F.when(table, F.lit(NO_TARGET)).otherwise(target),
        F.when(table, cap - F.coalesce(F.get("counts", F.col("head")), F.lit(0))).otherwise(cap),
        F.when(table, F.lit(-1)).otherwise(overlap),
    )
    out = out.withColumn("packed", packed)

    def join_pieces(b: Column) -> Column:
        return F.transform(
            b["packed"],
            lambda w: F.struct(
                w["first"].alias("first"),
                w["start"].alias("start"),
                F.array_join(F.slice(b["raws"], w["first"] + 1, w["last"] - w["first"] + 1), "").alias("raw"),
            ),
        )

    # Naming ``packed`` twice keeps the optimizer from moving the function call
    # into the lambda's argument, where it could not run.
    spans = F.when(F.col("packed").isNotNull(), X.let(F.struct("raws", "packed"), join_pieces))
    return (
        out.withColumn("spans", spans)
        .withColumn("header", F.get("raws", F.col("head")))
        .withColumn("lead", F.array_join(F.slice("raws", 1, F.col("head") + 1), ""))
        .drop("pieces", "raws", "counts", "visible", "packed", "head")
    )


def _stripped(raw: Column, start: Column) -> Column:
    body = X.strip(raw)
    return F.struct(
        body.alias("text"),
        (start + X.leading_blanks(raw)).alias("start"),
        (start + X.leading_blanks(raw) + F.length(body)).alias("end"),
    )


def _parent_spans() -> Column:
    """Passages of a section: the section itself, or one per packed window."""
    whole = F.struct(F.col("text"), F.lit(0).alias("start"), F.length("text").alias("end"))
    single = F.when(F.col("kind") == "row", _stripped(F.col("text"), F.lit(0))).otherwise(whole)
    return F.when(F.col("spans").isNull(), F.array(single)).otherwise(
        F.transform("spans", lambda s: _stripped(s["raw"], s["start"]))
    )


def _child_spans() -> Column:
    """Passages of a parent; later row groups of a table repeat its header line."""

    def groups(t: Column) -> Column:
        def one(s: Column, i: Column) -> Column:
            first = _stripped(F.concat(t["lead"], s["raw"]), F.lit(0))
            rows = F.regexp_replace(s["raw"], "\\n+$", "")
            later = F.struct(
                F.concat(t["header"], F.lit("\n"), X.strip(rows)).alias("text"),
                s["start"].alias("start"),
                (s["start"] + F.length(rows)).alias("end"),
            )
            return F.when(i == 0, first).otherwise(later)

        body = X.strip(t["header"])
        at = F.length(t["lead"]) - t["size"]
        lone = F.struct(body.alias("text"), at.alias("start"), (at + F.length(body)).alias("end"))
        return F.when(F.size(t["spans"]) == 0, F.array(lone)).otherwise(F.transform(t["spans"], one))

    top = F.struct(
        "spans", F.regexp_replace("header", "\\n+$", "").alias("header"), F.col("lead"), F.length("header").alias("size")
    )
    table = X.let(top, groups)
    cut = F.transform("spans", lambda s: _stripped(s["raw"], s["start"]))
    whole = F.array(_stripped(F.col("text"), F.lit(0)))
    return (
        F.when(F.col("kind") == "table", table).when(F.col("spans").isNotNull(), cut).otherwise(whole)
    )


def parents_of(
    section_rows: DataFrame, count: X.TokenCounter = X.whitespace_tokens, limits: Limits = LIMITS
) -> DataFrame:
    """Parent passages of sections, before de-duplication; row-local."""
    df = section_rows.withColumn("n", X.count_one(F.col("text"), count))
    df = _parent_pieces(df, count, limits)
    overlap = F.when(F.col("kind") == "row", F.lit(-1)).otherwise(F.lit(limits.parent_overlap))
    df = _pack_pieces(df, count, F.lit(limits.parent_target), F.lit(limits.parent_max), overlap)
    df = df.select(
        "doc_id", "section_id", "kind", "heading_path", "page_start", "page_end",
        F.col("start_char").alias("section_start"),
        F.posexplode(_parent_spans()).alias("window_id", "span"),
    ).where(F.col("span.text") != "")
    start = (F.col("section_start") + F.col("span.start")).cast("int")
    return df.select(
        "doc_id", "section_id", "window_id", "kind", "heading_path", "page_start", "page_end",
        F.col("span.text").alias("text"),
        start.alias("start_char"),
        (start + F.length("span.text")).cast("int").alias("end_char"),
        X.count_one(F.col("span.text"), count).alias("token_count"),
        content_id(
            F.lit(limits.pipeline_version), F.col("doc_id"), F.col("span.text"), start
        ).alias("parent_id"),
    )


def passages(
    blocks: DataFrame, count: X.TokenCounter = X.whitespace_tokens, limits: Limits = LIMITS
) -> DataFrame:
    """One row per child passage, kept or not, with its parent's columns.

    The parent's text rides on its first child only, and not where it is that child's.  ``is_first`` marks the
    first of equal children in a document and ``parent_kept`` the parents some
    such child belongs to; ``child_rows`` and ``parent_rows`` read off both
    tables, so nothing is joined back.
    """
    df = _child_pieces(parents_of(sections(blocks), count, limits), count, limits)
    overlap = F.when(F.col("kind") == "code", F.lit(limits.child_overlap)).when(
        F.col("kind") == "row", F.lit(0)
    ).otherwise(F.lit(limits.child_overlap))
    df = _pack_pieces(df, count, F.lit(limits.child_target), F.lit(limits.child_max), overlap)
    df = df.select(
        "doc_id", "section_id", "window_id", "kind", "heading_path", "page_start", "page_end",
        "parent_id", "text", "start_char", "end_char", "token_count",
        F.posexplode(_child_spans()).alias("piece_id", "span"),
    ).where(F.col("span.text") != "")
    embed = X.embed_text(F.col("heading_path"), F.col("span.text"))
    df = df.select(
        "doc_id", "section_id", "window_id", "piece_id", "kind", "heading_path", "page_start",
        "page_end", "parent_id",
        F.when((F.col("piece_id") == 0) & (F.col("text") != F.col("span.text")), F.col("text")).alias("parent_text"),
        F.col("start_char").alias("parent_start"),
        F.col("end_char").alias("parent_end"),
        F.col("token_count").alias("parent_tokens"),
        F.col("span.text").alias("text"),
        (F.col("start_char") + F.col("span.start")).cast("int").alias("start_char"),
        (F.col("start_char") + F.col("span.end")).cast("int").alias("end_char"),
        content_id(F.lit(limits.pipeline_version), F.col("doc_id"), embed).alias("chunk_id"),
    )
    # Made again after the exchange, which then carries the text of a child once.
    df = with_embed_text(index_passages(df))
    return df.withColumn("token_count", X.count_one(F.col("embed_text"), count))


def with_embed_text(df: DataFrame) -> DataFrame:
    return df.withColumn("embed_text", X.embed_text(F.col("heading_path"), F.col("text")))


def index_passages(df: DataFrame) -> DataFrame:
    """Mark first occurrences and surviving parents, then number both from 0."""
    order = ["section_id", "window_id", "piece_id"]
    same_child = Window.partitionBy("doc_id", "chunk_id").orderBy(*order)
    same_parent = Window.partitionBy("doc_id", "parent_id")
    upto = Window.partitionBy("doc_id").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    # The packer leaves no partitioning behind; one exchange by document serves all three windows.
    df = df.repartition("doc_id").withColumn("is_first", F.row_number().over(same_child) == 1)
    df = df.withColumn("parent_kept", F.max("is_first").over(same_parent))
    opens = (F.col("piece_id") == 0) & F.col("parent_kept")
    return df.withColumn("child_index", (F.sum(F.col("is_first").cast("int")).over(upto) - 1).cast("int")).withColumn(
        "parent_index", (F.sum(opens.cast("int")).over(upto) - 1).cast("int")
    )


def child_rows(df: DataFrame, *more: str) -> DataFrame:
    return df.where("is_first").select(
        "chunk_id", "parent_id", "doc_id", "text", "embed_text", "heading_path",
        F.col("kind").alias("block_type"), "start_char", "end_char", "page_start", "page_end",
        "child_index", "parent_index", "token_count", *more,
    )


def parent_rows(df: DataFrame, *more: str) -> DataFrame:
    return df.where(F.col("parent_kept") & (F.col("piece_id") == 0)).select(
        "parent_id", "doc_id", F.coalesce("parent_text", "text").alias("text"), "heading_path",
        F.col("kind").alias("block_type"),
        F.col("parent_start").alias("start_char"), F.col("parent_end").alias("end_char"),
        "page_start", "page_end", "parent_index", F.col("parent_tokens").alias("token_count"), *more,
    )
