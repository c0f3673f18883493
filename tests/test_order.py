"""Order statistics and heading stacks against plain versions."""

import math
import random

import pytest
from pyspark.sql import functions as F

from passagemill.operators.blocks import stack_any_depth, stack_headings
from passagemill.operators.order import order_statistic


@pytest.mark.parametrize("few", [20, 4096])
def test_values_by_rank(spark, few):
    rng = random.Random(4)
    values = {"even": [rng.random() for _ in range(3000)], "ties": [float(rng.randint(0, 3)) for _ in range(2500)],
              "wide": [10 ** rng.uniform(-300, 300) for _ in range(2000)], "one": [5.0] * 900, "few": [2.0, 1.0], None: [3.0, 9.0, 4.0]}
    rows = [(g, v) for g, vs in values.items() for v in vs] + [("none", None), ("few", None)]
    table = spark.createDataFrame(rows, "g string, x double").repartition(5)
    for share in (0.0, 0.5, 0.93, 1.0):
        got = order_statistic(table, ["g"], "x", lambda n: F.greatest(F.lit(1), F.ceil(n * share)), "v", few)  # noqa: B023
        want = {g: (sorted(vs)[max(1, math.ceil(len(vs) * share)) - 1], len(vs)) for g, vs in values.items()}
        assert {r.g: (r.v, r.n) for r in got.collect()} == want
    whole = order_statistic(table, [], "x", lambda n: n, "v", few).collect()
    assert whole == [(max(v for _, v in rows if v is not None), sum(map(len, values.values())))]
    assert order_statistic(table.limit(0), [], "x", lambda n: n).count() == 0


def _plain(rows):
    stack, out = [], {}
    for at, level, name in rows:
        if level is not None:
            stack = stack[: max(0, level - 1)] + ([name] if name else [])
        out[at] = " > ".join(stack)
    return out


def test_headings_of_any_depth(spark):
    rng = random.Random(6)
    docs = {d: [(i, rng.choice([None, None, *range(1, deep + 1)]), rng.choice(["", None, "a", f"h{i}"])) for i in range(80)]
            for d, deep in (("deep", 40), ("six", 6), ("one", 1))}
    docs["none"] = [(0, None, "x"), (1, None, None)]
    rows = [(d, at, level, name) for d, listed in docs.items() for at, level, name in listed]
    table = spark.createDataFrame(rows, "doc_id string, position int, level int, name string").repartition(3)
    want = {(d, at): path for d, listed in docs.items() for at, path in _plain(listed).items()}
    assert {(r.doc_id, r.position): r.heading_path for r in stack_any_depth(table).collect()} == want
    flat = stack_headings(table.where("doc_id <> 'deep'")).collect()
    assert {(r.doc_id, r.position): r.heading_path for r in flat} == {k: v for k, v in want.items() if k[0] != "deep"}
