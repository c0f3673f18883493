"""Cells of vectors against the comparison of all of them."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from passagemill.operators import cells
from passagemill.operators.dense import dense_topk
from passagemill.schemas import QueryError

STORED = "chunk_id string, doc_id string, parent_id string, vector array<float>"
ASKED = "qid bigint, vector array<double>, doc_filter string"


def _stored(spark, spread=0.1, n=400, dim=6):
    rng = np.random.default_rng(5)
    middle = rng.normal(size=(8, dim))
    points = middle[rng.integers(0, 8, n)] + spread * rng.normal(size=(n, dim))
    rows = [(f"c{i:04}", f"d{i % 30}", f"p{i // 3}", [float(x) for x in p]) for i, p in enumerate(points)]
    rows += [(f"t{i}", "d1", "p", rows[2][3]) for i in range(9)] + [("z0", "d2", "p", [0.0] * dim), ("z1", "d3", "p", None)]
    return spark.createDataFrame(rows, STORED).repartition(3), middle


def _asked(spark, middle):
    rows = [(i, [float(x) for x in m], "d4" if i == 3 else "" if i == 4 else None) for i, m in enumerate(middle)]
    rows += [(90, [0.0] * len(middle[0]), None), (91, [-float(x) for x in middle[0]], None), (92, [float(x) for x in middle[1]], "none")]
    return spark.createDataFrame(rows, ASKED)


def _rows(df):
    return sorted((r.qid, r["rank"], r.chunk_id, r.parent_id, round(r.score, 7)) for r in df.collect())


@pytest.mark.parametrize("spread", [0.05, 2.0])
def test_cells_equal_all_comparisons(spark, spread):
    vectors, middle = _stored(spark, spread)
    asked = _asked(spark, middle)
    made = cells.of_vectors(vectors, cell_rows=25)
    assert made.cells.count() > 10
    want = _rows(dense_topk(vectors, asked, 6))
    assert want and _rows(cells.search(made, asked, 6)) == want


def test_far_cells_are_not_read(spark):
    vectors, middle = _stored(spark)
    asked = _asked(spark, middle).where("qid < 3")
    made = cells.of_vectors(vectors, cell_rows=25)
    opened, pairs = cells.opened_share(made, asked, 6)
    assert 0 < opened < 0.4 * pairs
    plan = cells.search(made, asked, 6)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*cell#\d+ (IN|INSET) ", plan)


def test_a_bound_is_never_below_a_score(spark):
    vectors, middle = _stored(spark, 0.5)
    made = cells.of_vectors(vectors, cell_rows=40)
    asked = [(i, m) for i, m in enumerate(np.random.default_rng(9).normal(size=(20, 6)))]
    bound = {}
    table = made.table()
    df = spark.createDataFrame([(i, [float(x) for x in m]) for i, m in asked], "qid bigint, vector array<double>")
    for r in df.mapInArrow(cells._bounds(table, 5), "qid bigint, cell int, bound double, first boolean").collect():
        bound[r.qid, r.cell] = r.bound
    for block in made.blocks.collect():
        x = cells.unit_rows(np.array(block.vectors, dtype=float).reshape(len(block.ids), -1))
        for i, m in asked:
            assert (x @ cells.unit_rows(m[None])[0] <= bound[i, block.cell] + 1e-9).all()


def test_superseded_vectors_leave_cells(spark):
    vectors, middle = _stored(spark)
    made = cells.of_vectors(vectors, cell_rows=25)
    stored = cells.Cells(made.blocks.withColumn("gen", F.lit(1)), made.cells)
    dead = spark.createDataFrame([("d1", 1), ("d7", 1), ("d9", 2)], "doc_id string, dead int")
    asked = _asked(spark, middle)
    want = _rows(dense_topk(vectors.where("doc_id NOT IN ('d1', 'd7')"), asked, 6))
    assert _rows(cells.search(cells.without(stored, dead), asked, 6)) == want
    assert cells.without(stored, dead.where("dead = 2")) is stored


def test_nothing_stored_asked_or_alike(spark):
    vectors, middle = _stored(spark)
    asked = _asked(spark, middle)
    assert cells.search(cells.of_vectors(vectors.limit(0)), asked, 6).count() == 0
    assert cells.search(cells.of_vectors(vectors), asked.limit(0), 6).count() == 0
    with pytest.raises(Exception, match="width"):
        cells.search(cells.of_vectors(vectors), spark.createDataFrame([(1, [1.0, 2.0], None)], ASKED), 6).count()
    odd = spark.createDataFrame([("a", "d", "p", [1.0]), ("b", "d", "p", [1.0, 2.0])], STORED)
    with pytest.raises(QueryError, match="width"):
        cells.of_vectors(odd)
