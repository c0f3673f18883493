"""Exact nearest passages by cosine similarity."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagemill.operators.topk import query_slices, rank_topk, task_topk, union_all
from passagemill.schemas import LIMITS, QueryError


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    flat = pa.concat_arrays([chunk.flatten() for chunk in column.chunks])
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _unit_rows(m: np.ndarray) -> np.ndarray:
    norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return m / np.where(norm == 0.0, 1.0, norm)


def _search_slice(vectors: DataFrame, queries: DataFrame, k: int, carry: list[str]) -> DataFrame:
    rows = queries.select("qid", "vector", "doc_filter").orderBy("qid").collect()
    wanted = _unit_rows(np.array([r.vector for r in rows], dtype=np.float64).reshape(len(rows), -1))
    filters = [r.doc_filter or None for r in rows]
    dim = wanted.shape[1]
    if filters and all(filters):
        vectors = vectors.where(F.col("doc_id").cast("string").isin(sorted(set(filters))))

    def score(table: pa.Table) -> np.ndarray:
        column = table.column("vector")
        if any(len(c.flatten()) != len(c) * dim for c in column.chunks):
            raise QueryError("stored vectors and query vectors differ in width")
        out = wanted @ _unit_rows(_matrix(column, dim)).T
        doc = None
        for q, only in enumerate(filters):
            if only:
                if doc is None:
                    doc = np.array([str(d) for d in table.column("doc_id").to_pylist()])
                out[q, doc != only] = -np.inf
        return out

    columns = list(dict.fromkeys([*carry, "doc_id", "vector"] if any(filters) else [*carry, "vector"]))
    return task_topk(
        vectors.where(F.col("vector").isNotNull()).select(*columns), [r.qid for r in rows], k, carry, score
    )


def dense_topk(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = LIMITS.dense_k,
    carry: tuple[str, ...] = ("chunk_id", "parent_id"),
) -> DataFrame:
    """Best ``k`` rows of ``vectors`` per query (qid, vector, doc_filter).

    Every vector is compared, so the result is exact; a task multiplies its
    vectors with the query matrix and keeps k per query.
    """
    parts = [_search_slice(vectors, part, k, list(carry)) for part in query_slices(queries)]
    return rank_topk(union_all(parts), k, carry[0])
