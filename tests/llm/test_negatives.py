"""Hard negatives against all pairs, and the bounds against exact scores."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from passagemill.llm import negatives

SCHEMA = "vec_id long, embedding array<double>, label int, id long, norm string, v string"


def plain(rows, low=30, high=90, positives=5, k=10):
    """All pairs, for rows that all take part."""
    whole = {i: (label, [int(np.floor(256 * c)) for c in v]) for i, v, label in rows}
    out = set()
    for a, (label, v) in whole.items():
        if a % 10:
            continue
        scored = sorted(((-sum(x * y for x, y in zip(v, w)), i, other) for i, (other, w) in whole.items() if i != a))
        for p, i, _ in [s for s in scored if s[2] == label][:positives]:
            near = [s for s in scored if s[2] != label and low * -p <= 100 * -s[0] <= high * -p][:k]
            out |= {(a, i, r + 1, j, -p, -n) for r, (n, j, _) in enumerate(near)}
    return out


def clustered(n, dim, spread, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dim))
    points = centres[rng.integers(0, 6, n)] + spread * rng.normal(size=(n, dim))
    return [(i, [float(c) for c in p], int(rng.integers(0, 3))) for i, p in enumerate(points)]


def mined(spark, rows, parts=7):
    table = spark.createDataFrame([(i, v, label, 1, "x", "y") for i, v, label in rows], SCHEMA).repartition(parts)
    return {tuple(r) for r in negatives.mine(table, F.col("id") % 10 == 0).collect()}


@pytest.mark.parametrize("spread", [0.05, 1.0])
def test_equals_all_pairs(spark, monkeypatch, spread):
    monkeypatch.setattr(negatives, "ANCHORS", 16)
    monkeypatch.setattr(negatives, "GROUP", 100)
    monkeypatch.setattr(negatives, "RUN", 8)
    rows = clustered(400, 8, spread, 2)
    rows += [(1000 + i, rows[i][1], rows[i][2]) for i in range(30)]  # ties
    wanted = plain(rows)
    assert wanted and mined(spark, rows) == wanted


def test_rows_that_take_no_part(spark):
    rows = clustered(60, 5, 0.3, 4)
    wanted = mined(spark, rows)
    assert wanted
    odd = [(None, [1.0] * 5, 0), (700, None, 0), (710, [1.0] * 5, None), (720, [1.0, None, 1.0, 1.0, 1.0], 0), (730, [float("nan")] * 5, 0),
           (740, [float("inf")] * 5, 0), (750, [1.0] * 3, 0), (760, [], 0), (770, [1e200] * 5, 0)]
    assert mined(spark, rows + odd + rows[:20]) == wanted
    assert mined(spark, []) == set() and mined(spark, rows[:1]) == set() and mined(spark, odd[:3]) == set()
    # Of an id with several rows the smallest label and then the smallest vector stands.
    assert mined(spark, rows + [(3, [9.0] * 5, 7)]) == wanted
    # Zero vectors score 0, which is within the window of a positive of score 0.
    zeros = [(0, [0.0, 0.0], 1), (1, [1.0, 1.0], 1), (2, [1.0, 0.0], 2)]
    assert mined(spark, zeros) == {(0, 1, 1, 2, 0, 0)}


def test_large_scores_are_exact(spark):
    big = [(i, [float(3_000_000 + 1000 * i), float(i), -float(i)], i % 2) for i in range(12)]
    wanted = plain(big, 30, 90)
    assert mined(spark, big) == wanted
    # Rows of one label repeat these at 0.7 of the length, so that windows are met.
    big += [(20 + i, [0.7 * c for c in v], 5) for i, v, _ in big]
    wanted = plain(big)
    assert wanted and mined(spark, big) == wanted


def block(rows, references):
    x = np.array(rows, dtype=np.int64)
    norm = np.sqrt((x.astype(float) ** 2).sum(axis=1))
    angles = np.arccos(np.clip(x @ references.T / np.maximum(norm, 1e-300)[:, None], -1, 1)).astype(np.float32)
    return pa.record_batch({
        "id": pa.array(range(len(x))), "label": pa.array([0] * len(x)), "v": pa.array(x.tolist()), "norm": pa.array(norm),
        "angles": pa.array(angles.tolist(), pa.list_(pa.float32())),
    })


def test_bounds_hold_and_refuse_rows():
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(8, 16)) * 300
    rows = np.floor(centres[rng.integers(0, 8, 600)] + 4 * rng.normal(size=(600, 16)))
    references = centres / np.linalg.norm(centres, axis=1)[:, None]
    made = negatives.Block(block(rows, references))
    scored = 0
    for a in range(0, 600, 60):
        anchor = made.whole[a]
        exact = made.whole @ anchor
        upper, lower = negatives.bounds(made.angles, made.angles, made.norm, made.norm, made.angles[a], float(made.norm[a]))
        assert (exact <= upper).all() and (exact >= lower).all()
        window = (int(0.8 * exact.max()), int(exact.max()))
        found = made.reached(np.ones(600, dtype=bool), [window], made.angles[a], float(made.norm[a]))
        assert set(np.flatnonzero(exact >= window[0])) <= set(found.tolist())
        scored += len(found)
    assert scored < 0.5 * 10 * 600  # clustered rows: most are refused by their angles
