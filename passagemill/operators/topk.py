"""Best-k per query, found inside tasks before anything is shuffled.

Scoring a corpus against a batch of queries makes queries x passages numbers.
Each task keeps only its best k per query, so a shuffle carries at most
k x queries rows per task, whatever the corpus holds.  The order is total
(score, then id), which makes the kept rows of a task enough for the exact
answer over all tasks.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Scores are compared at this many decimals, so that sums taken in another order
# (another engine, another batch size) still rank the same.
SCORE_DECIMALS = 9
BATCH_CELLS = 4_000_000
MAX_BATCH_QUERIES = 2048


class TaskTopK:
    """The best k rows per query among the batches a task has seen."""

    def __init__(self, k: int, id_column: str):
        self.k, self.id_column = k, id_column
        self.table: pa.Table | None = None
        self.floor: np.ndarray | None = None  # the k-th best score of each query, once there is one

    def offer(self, scores: np.ndarray, rows: pa.Table) -> None:
        """``scores`` is queries x rows; -inf marks a row that is no candidate."""
        n = scores.shape[1]
        if n == 0:
            return
        if self.floor is None:
            self.floor = np.full(len(scores), -np.inf)
        least = self.floor.copy()
        if n > self.k:
            open_ = np.flatnonzero(least == -np.inf)
            some = np.where(np.isfinite(scores[open_]), scores[open_], -np.inf)
            least[open_] = np.partition(some, n - self.k, axis=1)[:, n - self.k]
        # Scores are rounded where they are near the best only, so the bound leaves room for that.
        query, row = np.nonzero(scores >= (least - 10.0**-SCORE_DECIMALS)[:, None])
        value = scores[query, row]
        finite = np.isfinite(value)
        query, row, value = query[finite], row[finite], np.round(value[finite], SCORE_DECIMALS)
        if len(row) == 0:
            return
        found = rows.take(pa.array(row))
        found = found.append_column("_query", pa.array(query.astype(np.int64)))
        found = found.append_column("_score", pa.array(value))
        self.table = self._best(found if self.table is None else pa.concat_tables([self.table, found]))
        query, value = self.table.column("_query").to_numpy(), self.table.column("_score").to_numpy()
        held = np.bincount(query, minlength=len(scores))
        full = held >= self.k
        self.floor[full] = value[np.cumsum(held)[full] - 1]

    def _best(self, table: pa.Table) -> pa.Table:
        if table.num_rows == 0:
            return table
        ids = np.array(table.column(self.id_column).to_pylist())
        query = table.column("_query").to_numpy()
        order = np.lexsort((ids, -table.column("_score").to_numpy(), query))
        query = query[order]
        first = np.r_[True, query[1:] != query[:-1]]
        start = np.maximum.accumulate(np.where(first, np.arange(len(query)), 0))
        return table.take(pa.array(order[np.arange(len(query)) - start < self.k]))


def blocks(n_rows: int, n_queries: int) -> Iterator[slice]:
    """Row ranges that keep a score matrix within a fixed size."""
    step = max(64, BATCH_CELLS // max(1, n_queries))
    return (slice(i, min(i + step, n_rows)) for i in range(0, n_rows, step))


def task_topk(
    source: DataFrame,
    qids: list[int],
    k: int,
    carry: list[str],
    score: Callable[[pa.Table], np.ndarray],
) -> DataFrame:
    """Rows (qid, *carry, score): the best ``k`` per query of every task.

    ``score`` maps a table of rows to a queries x rows array; ``carry[0]`` is the
    id that breaks ties.
    """
    names = np.array(qids, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = TaskTopK(k, carry[0])
        for batch in batches:
            table = pa.Table.from_batches([batch])
            for part in blocks(table.num_rows, len(names)):
                rows = table.slice(part.start, part.stop - part.start)
                best.offer(score(rows), rows.select(carry))
        if best.table is not None and best.table.num_rows:
            out = best.table.select(carry)
            out = out.add_column(0, "qid", pa.array(names[best.table.column("_query").to_numpy()]))
            out = out.append_column("score", best.table.column("_score").combine_chunks())
            yield from out.combine_chunks().to_batches()

    fields = ", ".join(f"`{c}` {source.schema[c].dataType.simpleString()}" for c in carry)
    return source.mapInArrow(run, f"qid bigint, {fields}, score double")


def rank_topk(scored: DataFrame, k: int, id_column: str, group: str = "qid") -> DataFrame:
    """Add the 1-based ``rank`` by score, ties by id, and keep the first ``k``."""
    w = Window.partitionBy(group).orderBy(F.desc("score"), F.asc(id_column))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def query_slices(queries: DataFrame, most: int = MAX_BATCH_QUERIES) -> list[DataFrame]:
    """The batch itself when it is small, else hashed slices of about half ``most``.

    A slice becomes the in-memory side of a scan, so its size is checked here; a
    larger batch costs more scans, never a larger task.
    """
    if queries.limit(most + 1).count() <= most:
        return [queries]
    n = -(-2 * queries.count() // most)
    return [queries.where(F.pmod(F.xxhash64("qid"), F.lit(n)) == i) for i in range(n)]


def union_all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write a result that several later steps share and read it back.

    The table lies in the cluster's checkpoint folder, so it survives the loss of
    executors, is computed once, and its size is known to the optimizer.
    """
    path = scratch_path(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch_path(spark: SparkSession) -> str:
    """A new name in the folder the cluster shares for intermediate tables."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = _own_folder()
    return f"{folder.rstrip('/')}/passagemill-{uuid.uuid4().hex}"


@lru_cache(maxsize=1)
def _own_folder() -> str:
    """Where no checkpoint folder is configured: one machine, so a folder of its own."""
    folder = tempfile.mkdtemp(prefix="passagemill-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder
