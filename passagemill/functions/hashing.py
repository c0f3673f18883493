"""Content ids and the deterministic encoder, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from passagemill.functions.text import let


def content_id(*parts: Column) -> Column:
    """First 16 hex digits of the sha256 over the parts, each closed by NUL."""
    sealed = [x for part in parts for x in (part.cast("string"), F.lit("\0"))]
    return F.substring(F.sha2(F.concat(*sealed).cast("binary"), 256), 1, 16)


def text_hash(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def hash_vector(text: Column, query: bool = False, dim: int = 8) -> Column:
    """Unit vector read off the sha256 of the text; queries and passages differ.

    Stands in for a model wherever none is installed: same text, same vector,
    on every engine and machine.
    """
    digest = F.sha2(F.concat(F.lit("q:" if query else "d:"), text).cast("binary"), 256)

    def numbers(hexed: Column) -> Column:
        return F.array(*[
            F.conv(F.substring(hexed, (i % 32) * 2 + 1, 2), 16, 10).cast("double") / F.lit(127.5) - F.lit(1.0)
            for i in range(dim)
        ])

    return unit(let(digest, numbers))


def unit(vector: Column) -> Column:
    """Scale to length one; a zero vector stays as it is."""

    def scaled(v: Column) -> Column:
        total = F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
        norm = F.when(total == 0.0, F.lit(1.0)).otherwise(F.sqrt(total))
        return let(norm, lambda n: F.transform(v, lambda x: x.cast("double") / n))

    return let(vector, scaled)
