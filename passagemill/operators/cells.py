"""Exact nearest passages from clustered cells.

Vectors are dealt to the cell of their nearest centre and stored by cell, in blocks of bounded
size.  A cell knows its centre, its number of vectors and its radius, the largest angle of a
vector to the centre.  No vector of a cell is nearer to a query than the angle to the centre less
the radius, so the cosine of that bounds the cell.  The nearest cells of each query that together
hold k vectors are opened first; their k-th best score is a floor, and a cell whose bound is below
the floor of every query is not read: cells are partitions of the table.

Centres come from a bounded sample of the vectors, which decides how well cells can be told apart,
never what is found.  A zero vector has the score 0 with every query and lies in a cell of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagemill.operators.topk import SCORE_DECIMALS, cut_lineage, rank_topk, scratch_path
from passagemill.schemas import LIMITS, QueryError

#: Vectors that a cell is made for, cells of a table at most, vectors of a stored block.
CELL_ROWS, MOST_CELLS, BLOCK_ROWS = 1024, 1024, 4096
#: Vectors that the centres are fitted to, and rounds of fitting.
SAMPLE, ROUNDS = 16384, 8
#: Queries that a task compares with a block at a time.
QUERY_GROUP = 256
#: What rounding can take from an angle and from a bound.
ANGLE_SLACK, SLACK = 1e-7, 1e-8


@dataclass
class Cells:
    """``blocks`` (cell, chunk, ids, parent_ids, doc_ids, vectors end to end) and ``cells`` (cell, centre, radius, n)."""

    blocks: DataFrame
    cells: DataFrame

    def table(self) -> list:
        """All cells; at most ``MOST_CELLS`` and one for each build."""
        return self.cells.select("cell", "centre", "radius", "n").orderBy("cell").collect()


def unit_rows(m: np.ndarray) -> np.ndarray:
    norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return m / np.where(norm == 0.0, 1.0, norm)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    flat = column.flatten()
    if len(flat) != len(column) * dim:
        raise QueryError("stored vectors differ in width")
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def centres(sample: np.ndarray, count: int) -> np.ndarray:
    """Unit centres by spherical k-means from far-apart first ones; the same for the same sample."""
    points = np.unique(unit_rows(sample), axis=0)
    points = points[(points * points).sum(axis=1) > 0]
    if not len(points):
        return np.zeros((0, sample.shape[1]))
    count = min(count, len(points))
    found = points[np.random.default_rng(11).permutation(len(points))[:count]]
    for _ in range(ROUNDS):
        nearest = np.argmax(points @ found.T, axis=1)
        sums = np.zeros_like(found)
        np.add.at(sums, nearest, points)
        alive = (sums * sums).sum(axis=1) > 0
        found = np.where(alive[:, None], unit_rows(sums), found)
    return found


def build(vectors: DataFrame, cell_rows: int = CELL_ROWS, first: int = 0) -> tuple[DataFrame, DataFrame]:
    """(blocks, cells) of (chunk_id, doc_id, vector[, parent_id]); cells are numbered from ``first`` on."""
    spark = vectors.sparkSession
    owner = F.col("parent_id") if "parent_id" in vectors.columns else F.lit(None).cast("string").alias("parent_id")
    rows = vectors.where(F.col("vector").isNotNull()).select("chunk_id", F.col("doc_id").cast("string").alias("doc_id"), owner, "vector")
    n = rows.count()
    drawn = rows.orderBy(F.xxhash64("chunk_id"), "chunk_id").select("vector").limit(SAMPLE).collect()
    dim = len(drawn[0].vector) if drawn else 0
    if any(len(r.vector) != dim for r in drawn):
        raise QueryError("stored vectors differ in width")
    sample = np.array([r.vector for r in drawn], dtype=np.float64).reshape(len(drawn), max(dim, 1))
    middle = centres(sample, min(MOST_CELLS, -(-n // cell_rows)))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = unit_rows(_matrix(batch.column("vector"), dim))
                likeness = x @ middle.T if len(middle) else np.zeros((len(x), 1))
                nearest = likeness.argmax(axis=1)
                angle = np.arccos(np.clip(likeness[np.arange(len(x)), nearest], -1.0, 1.0))
                zero = ~(x != 0).any(axis=1)
                cell = np.where(zero, len(middle), nearest) + first
                yield pa.record_batch(
                    [*batch.columns, pa.array(cell.astype(np.int32)), pa.array(np.where(zero, -1.0, angle))], [*batch.schema.names, "cell", "angle"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    dealt = cut_lineage(rows.mapInArrow(deal, f"{kinds}, cell int, angle double"))
    sizes = cut_lineage(dealt.groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("radius")))
    known = spark.createDataFrame(
        [(i + first, [float(c) for c in m]) for i, m in enumerate(middle)] + [(len(middle) + first, [])], "cell int, centre array<double>")
    chunks = sizes.select("cell", F.ceil(F.col("n") / BLOCK_ROWS).alias("chunks"))
    placed = dealt.join(F.broadcast(chunks), "cell").withColumn("chunk", F.pmod(F.xxhash64("chunk_id"), "chunks").cast("int"))
    ids, parents = (rows.schema[c].dataType.simpleString() for c in ("chunk_id", "parent_id"))

    def pack(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        whole = pa.array(np.array([0, table.num_rows], dtype=np.int32))
        listed = {out: pa.ListArray.from_arrays(whole, table.column(c).combine_chunks()) for out, c in (
            ("ids", "chunk_id"), ("parent_ids", "parent_id"), ("doc_ids", "doc_id"))}
        flat = _matrix(table.column("vector").combine_chunks(), dim).astype(np.float32).ravel()
        ends = pa.array(np.array([0, len(flat)], dtype=np.int32))
        return pa.table({"cell": table.column("cell")[:1], "chunk": table.column("chunk")[:1], **listed,
                         "vectors": pa.ListArray.from_arrays(ends, pa.array(flat))})

    schema = f"cell int, chunk int, ids array<{ids}>, parent_ids array<{parents}>, doc_ids array<string>, vectors array<float>"
    return placed.groupBy("cell", "chunk").applyInArrow(pack, schema), sizes.join(known, "cell")


def of_vectors(vectors: DataFrame, cell_rows: int = CELL_ROWS) -> Cells:
    """Cells of vectors that no index holds yet, written as an index would."""
    blocks, cells = build(vectors, cell_rows)
    path = scratch_path(vectors.sparkSession)
    blocks.write.partitionBy("cell").parquet(path)
    written = vectors.sparkSession.read.schema(blocks.schema).parquet(path)
    return Cells(written.select(*blocks.columns), cut_lineage(cells))


def without(made: Cells, dead: DataFrame, generation: str = "gen") -> Cells:
    """Cells without the vectors of superseded (doc_id, dead) pairs; only blocks that hold some change."""
    key = [generation, "cell", "chunk"]
    held = made.blocks.select(*key, F.posexplode("doc_ids").alias("at", "doc_id"))
    gone = held.join(dead, (held["doc_id"] == dead["doc_id"]) & (held[generation] == dead["dead"]), "left_semi")
    lost = cut_lineage(gone.groupBy(*key).agg(F.collect_set("at").alias("lost")))
    if lost.isEmpty():
        return made
    columns = made.blocks.columns
    hit = made.blocks.join(lost, key).withColumn("dim", (F.size("vectors") / F.size("ids")).cast("int"))
    for name in ("ids", "parent_ids", "doc_ids"):
        hit = hit.withColumn(f"_{name}", F.filter(name, lambda _, i: ~F.array_contains("lost", i)))
    hit = hit.withColumn("vectors", F.filter("vectors", lambda _, i: ~F.array_contains("lost", F.floor(i / F.col("dim")).cast("int"))))
    hit = hit.drop("ids", "parent_ids", "doc_ids").withColumnsRenamed({f"_{c}": c for c in ("ids", "parent_ids", "doc_ids")})
    left = made.blocks.join(lost.select(*key), key, "left_anti").select(*columns).unionByName(hit.where(F.size("ids") > 0).select(*columns))
    # A cell's radius still holds; its count says how many vectors are sure to be found in it.
    fewer = lost.groupBy("cell").agg(F.sum(F.size("lost")).alias("fewer"))
    cells = made.cells.join(fewer, "cell", "left").withColumn("n", F.col("n") - F.coalesce("fewer", F.lit(0))).drop("fewer")
    return Cells(left, cells)


def _bounds(cells: list, k: int):
    """Per query every cell with its bound, and whether it is among the nearest that hold k vectors."""
    numbers = np.array([c.cell for c in cells], dtype=np.int32)
    held = np.array([c.n for c in cells], dtype=np.int64)
    radius = np.array([c.radius for c in cells])
    real = radius >= 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        middle = np.array([c.centre for c in cells if c.radius >= 0], dtype=np.float64)
        for batch in batches:
            if not batch.num_rows:
                continue
            asked = batch.column("vector")
            if len(middle) and len(asked.flatten()) != len(asked) * middle.shape[1]:
                raise QueryError("stored vectors and query vectors differ in width")
            bound = np.zeros((len(asked), len(cells)))
            if len(middle):
                q = unit_rows(_matrix(asked, middle.shape[1]))
                angle = np.arccos(np.clip(q @ middle.T, -1.0, 1.0)) - radius[real] - ANGLE_SLACK
                bound[:, real] = np.where((q != 0).any(axis=1)[:, None], np.cos(np.maximum(angle, 0.0)), 0.0)
            order = np.argsort(-bound, axis=1, kind="stable")
            before = np.cumsum(held[order], axis=1) - held[order]
            first = np.zeros_like(bound, dtype=bool)
            np.put_along_axis(first, order, before < k, axis=1)
            each = pa.array(np.repeat(np.arange(len(asked)), len(cells)))
            yield pa.record_batch(
                [batch.column("qid").take(each), pa.array(np.tile(numbers, len(asked))), pa.array(bound.ravel()), pa.array(first.ravel())],
                ["qid", "cell", "bound", "first"])

    return run


def _compare(k: int):
    """Best k vectors of one block for each query of one group."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        kinds = [left.schema.field(c).type.value_type for c in ("ids", "parent_ids")]
        found: list[list] = [[], [], [], []]
        if left.num_rows and right.num_rows:
            ids, owners, docs = (np.array(left.column(c)[0].as_py(), dtype=object) for c in ("ids", "parent_ids", "doc_ids"))
            asked = np.array(right.column("vector").to_pylist(), dtype=np.float64)
            x = unit_rows(left.column("vectors")[0].values.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), -1))
            scores = np.round(unit_rows(asked) @ x.T, SCORE_DECIMALS)
            for row, qid, only in zip(scores, right.column("qid").to_pylist(), right.column("doc_filter").to_pylist()):
                rows = np.flatnonzero(docs == only) if only else np.arange(len(ids))
                if len(rows) > k:
                    rows = rows[row[rows] >= np.partition(row[rows], len(rows) - k)[len(rows) - k]]
                best = sorted(rows, key=lambda i: (-row[i], ids[i]))[:k]
                for column, value in zip(found, ([qid] * len(best), ids[best], owners[best], row[best])):
                    column.extend(value)
        return pa.table({
            "qid": pa.array(found[0], pa.int64()), "chunk_id": pa.array(found[1], kinds[0]), "parent_id": pa.array(found[2], kinds[1]),
            "score": pa.array(found[3], pa.float64()),
        })

    return run


def _found(made: Cells, queries: DataFrame, k: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Results of the opened cells, all pairs of a query and a cell with their bounds, and those opened."""
    cells = made.table()
    ids, owner = (made.blocks.schema[c].dataType.elementType.simpleString() for c in ("ids", "parent_ids"))
    schema = f"qid bigint, chunk_id {ids}, parent_id {owner}, score double"
    asked = queries.select(
        F.col("qid").cast("bigint").alias("qid"), F.col("vector").cast("array<double>").alias("vector"),
        F.when(F.col("doc_filter") != "", F.col("doc_filter")).alias("doc_filter"))
    asked = cut_lineage(asked)
    bounds = asked.select("qid", "vector").mapInArrow(_bounds(cells, k), "qid bigint, cell int, bound double, first boolean")
    batch = asked.agg(F.count("*").alias("queries"), F.count("doc_filter").alias("narrow")).collect()[0]
    if batch.narrow:
        # Cells that hold the document of a filter; others cannot answer it, and all of them come first.
        narrow = asked.where(F.col("doc_filter").isNotNull()).select("qid", "doc_filter")
        places = made.blocks.select("cell", F.explode("doc_ids").alias("doc_filter")).distinct()
        allowed = places.join(narrow, "doc_filter").select("qid", "cell")
        held = bounds.join(allowed, ["qid", "cell"], "left_semi").withColumn("first", F.lit(True))
        bounds = bounds.join(narrow, "qid", "left_anti").unionByName(held)
    bounds = cut_lineage(bounds)
    groups = max(1, -(-batch.queries // QUERY_GROUP))
    group = F.pmod(F.xxhash64("qid"), F.lit(groups)).cast("int")

    def opened(pairs: DataFrame) -> DataFrame:
        keys = cut_lineage(pairs.select("qid", "cell", group.alias("g")))
        # At most as many numbers as there are cells: the scan opens these partitions only.
        numbers = [r.cell for r in keys.select("cell").distinct().collect()]
        near = made.blocks.where(F.col("cell").isin(numbers)) if numbers else made.blocks.limit(0)
        left = near.select("cell", "chunk", "ids", "parent_ids", "doc_ids", "vectors").join(keys.select("cell", "g").distinct(), "cell")
        # Each block meets the queries of its cell.
        right = keys.join(asked, "qid").join(near.select("cell", "chunk").distinct(), "cell").select(
            "qid", "vector", "doc_filter", F.col("cell").alias("of"), F.col("chunk").alias("part"), F.col("g").alias("group"))
        return left.groupBy("cell", "chunk", "g").cogroup(right.groupBy("of", "part", "group")).applyInArrow(_compare(k), schema)

    early = cut_lineage(opened(bounds.where("first")))
    floors = rank_topk(early, k, "chunk_id").where(F.col("rank") == k).select("qid", F.col("score").alias("floor"))
    later = bounds.where("NOT first").join(floors, "qid", "left")
    later = later.where(F.col("floor").isNull() | (F.col("bound") + SLACK >= F.col("floor")))
    return early.unionByName(opened(later)), bounds, bounds.where("first").select("qid", "cell").unionByName(later.select("qid", "cell"))


def search(made: Cells, queries: DataFrame, k: int = LIMITS.dense_k) -> DataFrame:
    """Best ``k`` vectors per query (qid, vector, doc_filter) by cosine: (qid, chunk_id, parent_id, score, rank)."""
    return rank_topk(_found(made, queries, k)[0], k, "chunk_id")


def opened_share(made: Cells, queries: DataFrame, k: int = LIMITS.dense_k) -> tuple[int, int]:
    """Pairs of a query and a cell that are opened, and all of them."""
    _, bounds, opened = _found(made, queries, k)
    return opened.count(), bounds.count()
