"""The embedding cache: vectors by text hash, in buckets, behind blocked Bloom filters.

Every write leaves, besides its vectors, a filter per bucket of about ten bits for each text.
A filter is cut into blocks of 512 bits, a row each, so a probe is a join on (bucket, level,
block) with a small table; ``level`` says into how many blocks (a power of two) the writes of
about one size are cut.  Texts that no filter may hold are new; only the buckets of the others
are opened.  A filter never misses a text that is there; about one new text in fifty is looked
up in vain.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagemill.operators.topk import cut_lineage

#: Bits of a block in words of 64, bits set for a text, texts of a block.
WORDS, PROBES, KEYS = 8, 4, 51


@dataclass
class Cache:
    """``rows`` (text_hash, vector, model_id, model_revision, bucket) and ``filters`` (bucket, level, block, w0 to w7)."""

    rows: DataFrame
    filters: DataFrame
    buckets: int


def bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _seal(key: str) -> Column:
    """A second hash of the key, apart from the one of its bucket."""
    return F.xxhash64(key, F.lit("filter"))


def _places(key: str) -> list[Column]:
    """The bits of a block that a key sets, 0 to 511."""
    return [F.shiftrightunsigned(_seal(key), 9 * i).bitwiseAND(511).cast("int") for i in range(PROBES)]


def _block(key: str, level: Column) -> Column:
    """The block of a key, from the bits that no place uses."""
    size = F.call_function("shiftleft", F.expr("1L"), level)
    return F.pmod(F.shiftrightunsigned(_seal(key), 9 * PROBES), size)


def filter_rows(hashes: DataFrame, n: int, buckets: int, key: str = "text_hash") -> DataFrame:
    """Filters of ``n`` distinct keys: one row per block that holds any of them."""
    level = max(0, math.ceil(math.log2(max(1.0, n / buckets / KEYS))))
    places = _places(key)

    def word(w: int) -> Column:
        bits = [F.when(F.shiftright(p, 6) == w, F.expr("1L")).otherwise(F.expr("0L")) for p in places]
        out = F.lit(0).cast("bigint")
        for p, bit in zip(places, bits):
            out = out.bitwiseOR(F.call_function("shiftleft", bit, p.bitwiseAND(63)))
        return F.bit_or(out).alias(f"w{w}")

    keyed = hashes.select(key, bucket_of(key, buckets).alias("bucket"), F.lit(level).alias("level"))
    return keyed.groupBy("bucket", "level", _block(key, F.lit(level)).alias("block")).agg(*[word(w) for w in range(WORDS)])


def maybe_known(hashes: DataFrame, cache: Cache, key: str = "text_hash") -> DataFrame:
    """(key, bucket) of the distinct keys that some filter may hold."""
    keyed = hashes.select(key).distinct().withColumn("bucket", bucket_of(key, cache.buckets))
    levels = [r.level for r in cache.filters.select("level").distinct().collect()]  # one per power of two
    if not levels:
        return keyed.limit(0)
    probes = keyed.withColumn("level", F.explode(F.array(*[F.lit(x) for x in sorted(levels)])))
    probes = probes.withColumn("block", _block(key, F.col("level")))
    met = probes.join(cache.filters.select("bucket", "level", "block", *[f"w{w}" for w in range(WORDS)]), ["bucket", "level", "block"])
    words = F.array(*[F.col(f"w{w}") for w in range(WORDS)])
    for place in _places(key):
        bit = F.call_function("shiftleft", F.expr("1L"), place.bitwiseAND(63))
        met = met.where(F.get(words, F.shiftright(place, 6)).bitwiseAND(bit) != 0)
    return met.select(key, "bucket").distinct()


def known(hashes: DataFrame, cache: Cache, model_id: str, revision: str) -> DataFrame:
    """(text_hash, vector) of the given hashes that the cache holds for the model, one row each."""
    wanted = cut_lineage(maybe_known(hashes, cache))
    # At most ``buckets`` numbers, whatever the batch holds.
    numbers = [r.bucket for r in wanted.select("bucket").distinct().collect()]
    rows = cache.rows.where(F.col("bucket").isin(numbers)) if numbers else cache.rows.limit(0)
    mine = rows.where((F.col("model_id") == model_id) & (F.col("model_revision") == revision))
    return mine.join(wanted, ["bucket", "text_hash"]).select("text_hash", "vector").dropDuplicates(["text_hash"])


def of_rows(rows: DataFrame, buckets: int) -> Cache:
    """A cache of rows that no index holds yet."""
    rows = cut_lineage(rows.withColumn("bucket", bucket_of("text_hash", buckets)))
    return Cache(rows, cut_lineage(filter_rows(rows.select("text_hash").distinct(), rows.count(), buckets)), buckets)
