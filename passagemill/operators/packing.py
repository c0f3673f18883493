"""Greedy packing of consecutive units into windows of a bounded token count.

The choice of each window depends on the one before, which no SQL window can
say, so one small Arrow function works on arrays of token counts.  Texts stay in
the JVM: Python sees integers only and gives back index pairs.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NO_TARGET = 2**31 - 1
WINDOWS = T.ArrayType(
    T.StructType([T.StructField(name, T.IntegerType()) for name in ("first", "last", "start")])
)


def windows(counts, target: int, cap: int, overlap: int | None) -> list[tuple[int, int]]:
    """Inclusive index pairs; ``overlap`` None means windows share nothing.

    A window takes units until it holds ``target`` tokens or the next would pass
    ``cap``.  With an overlap the next window goes back over as many trailing
    units as fit in it, at least one, yet always moves on.
    """
    total = [0, *accumulate(counts)]
    n, start, out = len(total) - 1, 0, []
    while start < n:
        fits = bisect_right(total, total[start] + cap) - 1
        full = bisect_left(total, total[start] + target)
        stop = min(n, max(start + 1, min(fits, full)))
        out.append((start, stop - 1))
        if stop == n:
            break
        follow = stop
        if overlap is not None:
            follow -= 1
            while follow > 0:
                held = total[stop] - total[follow]
                if held >= overlap or (held and total[stop] - total[follow - 1] > overlap):
                    break
                follow -= 1
        start = max(follow, start + 1)
    return out


def merge_cut_units(counts, units, cap: int) -> list[tuple[int, int]]:
    """Join the words of each cut unit into runs of at most ``cap`` tokens.

    ``units`` is -1 for a whole unit, else the number of the unit a word is from.
    """
    out, i = [], 0
    while i < len(counts):
        j = i + 1
        if units[i] >= 0:
            while j < len(counts) and units[j] == units[i]:
                j += 1
        out.extend((i + a, i + b) for a, b in windows(counts[i:j], NO_TARGET, cap, None))
        i = j
    return out


def _pack(counts, units, visible, header, target, cap, overlap):
    keep = [i for i, v in enumerate(visible) if v and i != header]
    n = [int(counts[i]) for i in keep]
    spans = merge_cut_units(n, [int(units[i]) for i in keep], cap) if max(units, default=-1) >= 0 else None
    if spans is None:
        found = windows(n, target, cap, overlap)
        return [(keep[a], keep[b]) for a, b in found]
    found = windows([sum(n[a : b + 1]) for a, b in spans], target, cap, overlap)
    return [(keep[spans[a][0]], keep[spans[b][1]]) for a, b in found]


@F.pandas_udf(WINDOWS)
def _pack_column(
    counts: pd.Series, units: pd.Series, visible: pd.Series, header: pd.Series, lengths: pd.Series,
    target: pd.Series, cap: pd.Series, overlap: pd.Series,
) -> pd.Series:
    out = []
    for c, u, v, h, size, t, m, o in zip(counts, units, visible, header, lengths, target, cap, overlap):
        if c is None:
            out.append(None)
            continue
        at = [0, *accumulate(int(x) for x in size)]
        found = _pack(c, u, v, h, int(t), int(m), int(o) if o >= 0 else None)
        out.append([{"first": a, "last": b, "start": at[a]} for a, b in found])
    return pd.Series(out, dtype=object)


def pack(
    counts: Column, units: Column, visible: Column, header: Column, lengths: Column,
    target: Column, cap: Column, overlap: Column,
) -> Column:
    """Windows over each row's arrays, with the offset at which each starts.

    The piece numbered ``header`` (-1 for none) is in no window.  Null arrays give
    null; an overlap of -1 means windows share nothing.
    """
    return _pack_column(counts, units, visible, header, lengths, target, cap, overlap)


def pack_counts(counts: Column, target: int, cap: int, overlap: int | None) -> Column:
    """Windows over arrays of plain counts, all units visible and of no length."""
    return pack(
        counts,
        F.transform(counts, lambda _: F.lit(-1)),
        F.transform(counts, lambda _: F.lit(True)),
        F.lit(-1),
        F.transform(counts, lambda _: F.lit(0)),
        F.lit(target), F.lit(cap), F.lit(-1 if overlap is None else overlap),
    )
