"""Approximate nearest neighbours by a permutation index.

A vector is represented by its nearest pivots in order.  Vectors are dealt to blocks of
bounded size; each block posts its vectors in one inverted file per pivot, with the place
the pivot has in the vector's order.  A query reads the files of its own pivots, which sums
the footrule distance between the two orders for every vector met; the share of a block
with the smallest distance is compared exactly, in double precision.

Largest inner product is turned into smallest angle by one more component: with M the
largest norm of all rows, a vector x is followed by sqrt(M^2 - |x|^2) and a query by 0.

Rows that repeat an id and its vector are one before anything is dealt or counted.  An id with
several different vectors keeps them all and is as near as the nearest of them, on the side of
the queries as well; places among the best are places of ids.

Pivots come from a bounded sample of the rows; every row is indexed.  Queries are dealt to
blocks as well and each pair of blocks is one group of work, so nothing grows with the
data but the number of groups, and only ``k`` rows per query leave a group.

Defined cases: vectors that are null, zero, of another length than most, or that hold null
or non-finite components take no part; a null id neither; with fewer than ``k`` candidates
all are returned; ties go to the smaller id; equal vectors have equal scores and footrules,
so ties keep the smaller ids.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PIVOTS, PREFIX = 512, 64
#: Vectors and queries per block; sample from which pivots are drawn.
BLOCK, QUERY_BLOCK, SAMPLE = 8192, 1024, 4096
#: Share of a block that is compared exactly, by smallest footrule.
SHARE = 0.4


def usable(vectors: DataFrame, id_column: str, column: str) -> DataFrame:
    """(id, v): double vectors of the most frequent length that can be compared."""
    v = F.col(column).cast("array<double>")
    rows = vectors.select(F.col(id_column).cast("bigint").alias("id"), v.alias("v"))
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(F.col("id").isNotNull() & F.col("v").isNotNull() & ~odd & F.exists("v", lambda x: x != 0))
    common = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("v") == (common["n"] if common else 0)).dropDuplicates(["id", "v"])


def nearest_pivots(points: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """Per row the numbers of its nearest pivots (by cosine), nearest first; ties to the smaller number."""
    near = np.round(points @ pivots.T, 12)
    return np.argsort(-near, axis=1, kind="stable")[:, :prefix]


class Postings:
    """The inverted files of one block: for each pivot the vectors near it and its place in their orders."""

    def __init__(self, orders: np.ndarray, n_pivots: int):
        n, self.prefix = orders.shape
        flat = orders.ravel()
        by_pivot = np.argsort(flat, kind="stable")
        self.vector = (by_pivot // self.prefix).astype(np.int64)
        self.place = (by_pivot % self.prefix).astype(np.int64)
        self.start = np.searchsorted(flat[by_pivot], np.arange(n_pivots + 1))
        self.n = n

    def footrule(self, order: np.ndarray) -> np.ndarray:
        """Per vector the sum over the query's pivots of the distance between places; a pivot
        that a vector does not have stands at the end of its order."""
        parts = [slice(self.start[p], self.start[p + 1]) for p in order]
        rows = np.concatenate([self.vector[s] for s in parts])
        places = np.concatenate([self.place[s] for s in parts])
        mine = np.repeat(np.arange(len(order)), [s.stop - s.start for s in parts])
        saved = (self.prefix - mine) - np.abs(places - mine)
        missing_all = float(np.sum(self.prefix - np.arange(len(order))))
        return missing_all - np.bincount(rows, weights=saved, minlength=self.n)


def enough(ids: np.ndarray, near: np.ndarray, keep: int, least: int) -> int:
    """How many of the rows ``near`` to keep: ``keep``, or more until ``least`` different ids are among them."""
    firsts = np.sort(np.unique(ids[near], return_index=True)[1])
    return max(keep, int(firsts[min(least, len(firsts)) - 1]) + 1)


def kth_best(ids: np.ndarray, scores: np.ndarray, k: int) -> float:
    """The score of the k-th best id; rows of one id count as the best of them."""
    order = np.argsort(ids, kind="stable")
    starts = np.flatnonzero(np.concatenate([[True], ids[order][1:] != ids[order][:-1]]))
    best = np.maximum.reduceat(scores[order], starts)
    return float(np.partition(best, len(best) - k)[len(best) - k]) if len(best) > k else -np.inf


def search(
    vectors: DataFrame, queries: DataFrame, k: int = 20, id_column: str = "vec_id", column: str = "embedding",
    n_pivots: int = PIVOTS, prefix: int = PREFIX, share: float = SHARE, block: int = BLOCK,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows of largest inner product with each query but itself."""
    rows = usable(vectors, id_column, column)
    asked = usable(queries, id_column, column)
    facts = rows.agg(F.count("*"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).first()
    n, largest = int(facts[0]), float(facts[1] or 0.0)
    n_queries = asked.count()
    sample = rows.orderBy(F.xxhash64("id", "v", F.lit("pivot")), "id", "v").limit(SAMPLE).collect()  # SAMPLE rows at most
    base = np.array([r["v"] for r in sample], dtype=np.float64).reshape(len(sample), len(sample[0]["v"]) if sample else 1)

    def lift(x: np.ndarray, query: bool) -> np.ndarray:
        square = np.einsum("ij,ij->i", x, x)
        extra = np.zeros(len(x)) if query else np.sqrt(np.maximum(0.0, largest - square))
        lifted = np.column_stack([x, extra])
        return lifted / np.maximum(1e-300, np.sqrt(np.einsum("ij,ij->i", lifted, lifted)))[:, None]

    lifted = np.unique(lift(base, False), axis=0) if len(base) else np.zeros((0, 1))
    pivots = lifted[np.random.default_rng(7).permutation(len(lifted))[:n_pivots]]
    prefix = min(prefix, len(pivots))
    shared = vectors.sparkSession.sparkContext.broadcast(pivots)

    def pack(which: str, query: bool):
        """A block as one row: ids, vectors and orders as bytes."""

        def run(table: pa.Table) -> pa.Table:
            ids = table.column("id").to_numpy()
            x = np.array(table.column("v").combine_chunks().values.to_numpy(zero_copy_only=False), dtype=np.float64)
            x = x.reshape(len(ids), -1)
            by_id = np.lexsort((*x.T[::-1], ids))
            ids, x = ids[by_id], x[by_id]
            orders = nearest_pivots(lift(x, query), shared.value, prefix).astype(np.int16)
            return pa.table({
                which: pa.array([table.column("part")[0].as_py()], pa.int64()), "ids": pa.array([ids.astype(np.int64).tobytes()]),
                "vectors": pa.array([x.tobytes()]), "orders": pa.array([orders.tobytes()]),
            })

        return run

    def blocks(df: DataFrame, count: int, size: int, which: str, query: bool) -> tuple[DataFrame, int]:
        parts = max(1, -(-count // size))
        # Dealt by a hash of id and vector: neither, however common, makes a block large.
        dealt = df.withColumn("part", F.pmod(F.xxhash64("id", "v", F.lit(which)), F.lit(parts)).cast("bigint"))
        schema = f"{which} bigint, ids binary, vectors binary, orders binary"
        return dealt.groupBy("part").applyInArrow(pack(which, query), schema), parts

    index, n_blocks = blocks(rows, n, block, "b", False)
    wanted, n_asked = blocks(asked, n_queries, QUERY_BLOCK, "q", True)
    # Each pair of an index block and a query block is one key; both sides are packed rows.
    index = index.withColumn("q", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_asked - 1).cast("bigint"))))
    wanted = wanted.withColumn("b", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_blocks - 1).cast("bigint"))))

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if left.num_rows and right.num_rows:
            (ids, x, orders), (qids, qx, qorders) = (
                (np.frombuffer(t.column("ids")[0].as_py(), dtype=np.int64), np.frombuffer(t.column("vectors")[0].as_py()),
                 np.frombuffer(t.column("orders")[0].as_py(), dtype=np.int16)) for t in (left, right)
            )
            x, qx = x.reshape(len(ids), -1), qx.reshape(len(qids), -1)
            orders, qorders = orders.reshape(len(ids), -1).astype(np.int64), qorders.reshape(len(qids), -1).astype(np.int64)
            files = Postings(orders, len(shared.value))
            # A rough product finds what may be among the best; single precision where it can hold the values.
            real, error = (np.float32, 1e-5) if largest < 1e30 else (np.float64, 1e-9)
            rough_x = x.astype(real)
            small = np.int16 if prefix * prefix < 1 << 15 else np.int64  # short integers sort by radix
            keep = min(len(ids), max(4 * k + 1, int(np.ceil(share * len(ids)))))
            repeated = bool((ids[1:] == ids[:-1]).any())
            for qid, q, order in zip(qids, qx, qorders):
                distance = files.footrule(order)
                # Rows lie in the order of their ids, so a stable sort gives ties to the smaller id.
                near = np.argsort(distance.astype(small), kind="stable")
                near = near[: enough(ids, near, keep, 4 * k + 1) if repeated else keep]
                near = near[ids[near] != qid]
                if len(near) > k:
                    rough = rough_x.take(near, axis=0) @ q.astype(real)
                    slack = error * np.sqrt(largest * (q @ q))
                    bound = kth_best(ids[near], rough, k) if repeated else np.partition(rough, len(near) - k)[len(near) - k]
                    near = near[rough >= bound - slack]
                exact = (x[near] * q).sum(axis=1)
                best = np.lexsort((ids[near], -exact))
                if repeated:
                    best = best[np.sort(np.unique(ids[near[best]], return_index=True)[1])]
                best = best[:k]
                found.append((np.full(len(best), qid), ids[near[best]], exact[best]))
        a, b, c = (np.concatenate([f[i] for f in found]) if found else np.zeros(0) for i in range(3))
        return pa.table({"query_id": pa.array(a.astype(np.int64)), "vec_id": pa.array(b.astype(np.int64)), "score": pa.array(c.astype(np.float64))})

    pairs = index.groupBy("b", "q").cogroup(wanted.groupBy("b", "q"))
    found = pairs.applyInArrow(compare, "query_id bigint, vec_id bigint, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    # Different vectors of one id are one candidate with the best of their scores.
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = found.withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
