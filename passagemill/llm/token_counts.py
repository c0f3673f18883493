"""Exact length histogram of a corpus under a tokenizer.

Documents are encoded inside tasks and leave them only as counts per encoded length.
From the histogram, sums from the long end answer for every context limit how many
documents exceed it, how many tokens there are, and how many remain if every document
is truncated to the limit; the share of documents up to the limit gives every quantile.

Defined cases: a null text counts as an empty one (length 0); no document gives no row;
repeated rows count each.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from passagemill.llm.common import slices, text_bytes

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pre-tokenizer pattern that belongs to the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Lengths that share a block of the two-level suffix sum.
BLOCK = 4096


@lru_cache(maxsize=2)
def encoding(ranks: bytes):
    """The byte-level encoder for the bytes of a rank file, once per worker."""
    import tiktoken

    table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})


def vocabulary_bytes(path: str = VOCABULARY) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def document_lengths(docs: DataFrame, id_column: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, n_tokens) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary_bytes(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(shared.value).encode_ordinary
        for part in slices(batches, text):
            counts = [len(encode(t.decode())) for t in text_bytes(part.column(text))]
            yield pa.record_batch([part.column(id_column), pa.array(counts, pa.int64())], [id_column, "n_tokens"])

    rows = docs.select(F.col(id_column), F.col(text).cast("string").alias(text))
    return rows.mapInArrow(run, f"`{id_column}` {rows.schema[id_column].dataType.simpleString()}, n_tokens bigint")


def length_histogram(docs: DataFrame, text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(n_tokens, docs): one row per length that occurs; counted in the task before the shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary_bytes(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(shared.value).encode_ordinary
        for part in slices(batches, text):
            lengths = np.array([len(encode(t.decode())) for t in text_bytes(part.column(text))], dtype=np.int64)
            values, counts = np.unique(lengths, return_counts=True)
            yield pa.record_batch([pa.array(values), pa.array(counts.astype(np.int64))], ["n_tokens", "docs"])

    rows = docs.select(F.col(text).cast("string").alias(text))
    return rows.mapInArrow(run, "n_tokens bigint, docs bigint").groupBy("n_tokens").agg(F.sum("docs").alias("docs"))


def context_limits(histogram: DataFrame) -> DataFrame:
    """For each length as a context limit: what fits, what exceeds it and what truncation leaves.

    Columns: ``context_limit``; ``docs_at`` of that length; ``docs_over`` longer ones;
    ``tokens_over`` their whole length; ``truncated_tokens`` the corpus cut to the limit;
    ``lost_tokens`` the rest; ``total_tokens``; ``quantile`` the share of documents up to the
    limit.  Limits between two lengths follow from the row below them, since no document
    ends there.  Sums run over blocks of lengths and then inside each block, so no task
    sees all lengths.
    """
    rows = histogram.select(
        F.col("n_tokens").alias("context_limit"), F.col("docs").alias("docs_at"),
        (F.col("n_tokens") * F.col("docs")).alias("tokens_at"),
        F.floor(F.col("n_tokens") / BLOCK).alias("block"),
    )
    later = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = rows.groupBy("block").agg(F.sum("docs_at").alias("d"), F.sum("tokens_at").alias("t")).select(
        "block", F.coalesce(F.sum("d").over(later), F.lit(0)).alias("docs_beyond"),
        F.coalesce(F.sum("t").over(later), F.lit(0)).alias("tokens_beyond"),
        F.sum("d").over(whole).alias("all_docs"), F.sum("t").over(whole).alias("total_tokens"),
    )
    inside = Window.partitionBy("block").orderBy(F.desc("context_limit")).rowsBetween(Window.unboundedPreceding, -1)
    over = rows.join(blocks, "block").select(
        "context_limit", "docs_at",
        (F.coalesce(F.sum("docs_at").over(inside), F.lit(0)) + F.col("docs_beyond")).alias("docs_over"),
        (F.coalesce(F.sum("tokens_at").over(inside), F.lit(0)) + F.col("tokens_beyond")).alias("tokens_over"),
        "all_docs", "total_tokens",
    )
    lost = F.col("tokens_over") - F.col("context_limit") * F.col("docs_over")
    return over.select(
        "context_limit", "docs_at", "docs_over", "tokens_over", (F.col("total_tokens") - lost).alias("truncated_tokens"),
        lost.alias("lost_tokens"), "total_tokens",
        ((F.col("all_docs") - F.col("docs_over")) / F.col("all_docs")).alias("quantile"),
    )
