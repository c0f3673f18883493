"""Hard negatives by angular triangle filtering.

Vectors become integers (``floor(256 x)``) and a score is their integer inner product, so
results are exact.  With every row its norm and its angles to a few reference directions are
stored.  For an anchor at angles p_i and a row at angles t_i the angle between the two lies
between ``max |t_i - p_i|`` and ``min(t_i + p_i, 2 pi - t_i - p_i)``; the cosines of both, times
the norms and rounded outwards, bound the score.  Only rows whose bounds reach the scores that
still matter (for positives the k-th best so far, for negatives the windows below the positive
scores and the k-th best in each) are multiplied out.  Runs of neighbouring rows share bounds,
so that most of a run is refused at once where the rows cluster.

Anchors are dealt to blocks and rows to groups; every pair of a block and a group is one stream
of rows, anchors first, that keeps k rows per anchor and window.  A task holds one block of
anchors and one batch of rows, whatever the labels are, and what leaves it is bounded by its
anchors.

Defined cases: rows with a null id, label or vector, with null or non-finite components, of
another length than most, or with a squared norm of 2^62 or more (their scores need not fit
64 bits) take no part; rows that repeat an id are one, that of the smallest label and then the
smallest vector; a zero vector scores 0; ties go to the smaller id; an anchor without positives
and a positive without negatives in its window give no row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passagemill.llm.common import cut_lineage

SCALE = 256.0
#: Reference directions and the sample of rows that they are chosen from.
REFERENCES, SAMPLE = 16, 2048
#: Anchors of a block, rows of a group, rows that share their bounds.
ANCHORS, GROUP, RUN = 256, 8192, 64
#: Angles are stored in single precision; this covers their rounding and that of arccos near 1.
ANGLE_SLACK = 1e-6
LARGEST = float(1 << 62)


def integer_rows(vectors: DataFrame, id_column: str, label: str | Column, column: str) -> DataFrame:
    """(id, label, v): the rows that take part, one per id."""
    v = F.col(column).cast("array<double>")
    label = F.col(label) if isinstance(label, str) else label
    rows = vectors.select(F.col(id_column).cast("bigint").alias("id"), label.alias("label"), v.alias("x"))
    odd = F.exists("x", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) >= 2.0**31 / SCALE))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull() & (F.size("x") > 0) & ~odd)
    rows = rows.select("id", "label", F.transform("x", lambda x: F.floor(SCALE * x).cast("bigint")).alias("v"))
    square = F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c)
    rows = rows.where(square < LARGEST)
    common = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    rows = rows.where(F.size("v") == (common["n"] if common else 0))
    return rows.groupBy("id").agg(F.min(F.struct("label", "v")).alias("r")).select("id", "r.label", "r.v")


def directions(rows: DataFrame, count: int, sample: int) -> np.ndarray:
    """Unit vectors far from each other, out of a bounded sample; any choice gives the same results."""
    drawn = rows.orderBy(F.xxhash64("id", F.lit("direction")), "id").select("v").limit(sample).collect()
    x = np.array([r["v"] for r in drawn], dtype=np.float64)
    norm = np.sqrt((x * x).sum(axis=1)) if len(x) else np.zeros(0)
    x = x[norm > 0] / norm[norm > 0, None] if len(x) else np.zeros((0, 1))
    chosen: list[int] = []
    nearest = np.full(len(x), -np.inf)
    while len(chosen) < min(count, len(x)):
        at = int(np.argmin(nearest))
        if chosen and nearest[at] > 1 - 1e-9:
            break
        chosen.append(at)
        nearest = np.maximum(nearest, x @ x[at])
    return x[chosen]


def matrix(column: pa.Array, kind) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(kind, copy=False).reshape(len(column), -1)


def with_angles(rows: DataFrame, references: np.ndarray) -> DataFrame:
    """Add the norm and the angles (float) to each reference; a zero vector is at a right angle to all."""
    kind = rows.schema["label"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column("v"), np.float64)
                norm = np.sqrt((x * x).sum(axis=1))
                cosine = (x @ references.T) / np.where(norm > 0, norm, 1.0)[:, None]
                angle = np.arccos(np.clip(cosine, -1.0, 1.0)).astype(np.float32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(references)), pa.array(angle.ravel()))
                yield pa.record_batch([*batch.columns, pa.array(norm), lists], [*batch.schema.names, "norm", "angles"])

    return rows.mapInArrow(run, f"id bigint, label {kind}, v array<bigint>, norm double, angles array<float>")


def bounds(
    low: np.ndarray, high: np.ndarray, shortest: np.ndarray, longest: np.ndarray, angles: np.ndarray, norm: float,
) -> tuple[np.ndarray, np.ndarray]:
    """Scores that rows can have at most and at least with an anchor, given the ranges of their angles and norms."""
    if low.shape[1] == 0:
        reach = longest * norm * (1 + 1e-9) + 1
        return reach, -reach
    apart = np.maximum(low - angles, angles - high).max(axis=1)
    open_ = np.minimum(high + angles, 2 * np.pi - low - angles).min(axis=1)
    most = np.cos(np.clip(apart - ANGLE_SLACK, 0.0, np.pi))
    least = np.cos(np.clip(open_ + ANGLE_SLACK, 0.0, np.pi))
    slack = longest * norm * 1e-9 + 1
    upper = np.where(most >= 0, most * longest, most * shortest) * norm + slack
    lower = np.where(least >= 0, least * shortest, least * longest) * norm - slack
    return upper, lower


class Block:
    """A batch of rows: integers, angles, and runs of neighbours with their common ranges."""

    def __init__(self, batch: pa.RecordBatch, run: int = RUN):
        angles = matrix(batch.column("angles"), np.float64)
        ids = batch.column("id").to_numpy()
        if angles.shape[1]:
            nearest = angles.argmin(axis=1)
            order = np.lexsort((ids, angles[np.arange(len(ids)), nearest], nearest))
        else:
            order = np.argsort(ids, kind="stable")
        self.ids, self.angles = ids[order], angles[order]
        self.norm = batch.column("norm").to_numpy()[order]
        self.labels = np.array(batch.column("label").to_pylist(), dtype=object)[order]
        self.whole = matrix(batch.column("v"), np.int64)[order]
        self.real = self.whole.astype(np.float64)
        starts = np.arange(0, len(ids), run)
        self.sizes = np.diff(np.append(starts, len(ids)))
        self.low = np.minimum.reduceat(self.angles, starts, axis=0) if angles.shape[1] else self.angles[starts]
        self.high = np.maximum.reduceat(self.angles, starts, axis=0) if angles.shape[1] else self.angles[starts]
        self.shortest, self.longest = np.minimum.reduceat(self.norm, starts), np.maximum.reduceat(self.norm, starts)
        # Labels as numbers of this block.
        self.names = {name: i for i, name in enumerate(dict.fromkeys(self.labels))}
        self.codes = np.array([self.names[x] for x in self.labels])

    def reached(self, wanted: np.ndarray, windows: list[tuple[float, float]], angles: np.ndarray, norm: float) -> np.ndarray:
        """Rows of the mask whose score may lie in one of the windows."""

        def overlap(upper: np.ndarray, lower: np.ndarray) -> np.ndarray:
            met = np.zeros(len(upper), dtype=bool)
            for least, most in windows:
                met |= (upper >= least) & (lower <= most)
            return met

        runs = overlap(*bounds(self.low, self.high, self.shortest, self.longest, angles, norm))
        rows = np.flatnonzero(np.repeat(runs, self.sizes) & wanted)
        own = self.angles[rows]
        return rows[overlap(*bounds(own, own, self.norm[rows], self.norm[rows], angles, norm))]

    def scores(self, rows: np.ndarray, anchor: np.ndarray, norm: float) -> np.ndarray:
        """Integer inner products; doubles hold them exactly where the norms say so."""
        if len(rows) and float(self.norm[rows].max()) * norm < 2.0**52:
            return (self.real[rows] @ anchor.astype(np.float64)).astype(np.int64)
        return self.whole[rows] @ anchor


@dataclass
class Best:
    """The best k rows of a window of scores so far."""

    least: int
    most: int
    k: int
    ids: np.ndarray
    scores: np.ndarray

    @classmethod
    def within(cls, least: int, most: int, k: int) -> Best:
        return cls(least, most, k, np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))

    def floor(self) -> int:
        """A row below this cannot come in."""
        return max(self.least, int(self.scores[-1])) if len(self.scores) == self.k else self.least

    def offer(self, ids: np.ndarray, scores: np.ndarray) -> None:
        met = (scores >= self.floor()) & (scores <= self.most)
        if not met.any():
            return
        ids, scores = np.concatenate([self.ids, ids[met]]), np.concatenate([self.scores, scores[met]])
        order = np.lexsort((ids, -scores))[: self.k]
        self.ids, self.scores = ids[order], scores[order]


class Positives:
    """The first k other rows of an anchor's label."""

    schema = "anchor_id bigint, positive_id bigint, positive_score bigint"

    def __init__(self, anchors: list[dict], k: int):
        self.anchors = anchors
        self.best = [Best.within(-(1 << 62), 1 << 62, k) for _ in anchors]
        self.scored = self.seen = 0

    def feed(self, block: Block) -> None:
        for a, best in zip(self.anchors, self.best):
            wanted = (block.codes == block.names.get(a["label"], -1)) & (block.ids != a["id"])
            rows = block.reached(wanted, [(best.floor(), best.most)], a["angles"], a["norm"])
            self.seen, self.scored = self.seen + int(wanted.sum()), self.scored + len(rows)
            best.offer(block.ids[rows], block.scores(rows, a["v"], a["norm"]))

    def finish(self) -> pa.RecordBatch:
        sizes = [len(b.ids) for b in self.best]
        return pa.record_batch([
            pa.array(np.repeat(np.array([a["id"] for a in self.anchors], dtype=np.int64), sizes)),
            pa.array(np.concatenate([b.ids for b in self.best])), pa.array(np.concatenate([b.scores for b in self.best])),
        ], ["anchor_id", "positive_id", "positive_score"])


class Negatives:
    """The first k rows of other labels in the window of each positive."""

    schema = "anchor_id bigint, positive_id bigint, positive_score bigint, negative_id bigint, negative_score bigint"

    def __init__(self, anchors: list[dict], k: int, low: int, high: int):
        self.anchors = anchors
        self.best = []
        for a in anchors:
            windows = {p["positive_score"]: (-(-low * p["positive_score"] // 100), high * p["positive_score"] // 100) for p in a["positives"]}
            self.best.append({p: Best.within(*w, k) for p, w in windows.items() if w[0] <= w[1]})
        self.scored = self.seen = 0

    def feed(self, block: Block) -> None:
        for a, best in zip(self.anchors, self.best):
            wanted = block.codes != block.names.get(a["label"], -1)
            rows = block.reached(wanted, [(b.floor(), b.most) for b in best.values()], a["angles"], a["norm"])
            self.seen, self.scored = self.seen + int(wanted.sum()), self.scored + len(rows)
            if len(rows):
                ids, scores = block.ids[rows], block.scores(rows, a["v"], a["norm"])
                for b in best.values():
                    b.offer(ids, scores)

    def finish(self) -> pa.RecordBatch:
        out: list[list] = [[], [], [], [], []]
        for a, best in zip(self.anchors, self.best):
            for p in a["positives"]:
                if found := best.get(p["positive_score"]):
                    fixed = (a["id"], p["positive_id"], p["positive_score"])
                    for column, value in zip(out, (*([x] * len(found.ids) for x in fixed), found.ids.tolist(), found.scores.tolist())):
                        column.extend(value)
        names = ["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"]
        return pa.record_batch([pa.array(c, pa.int64()) for c in out], names)


def streamed(index: DataFrame, anchors: DataFrame, n: int, n_anchors: int, make) -> DataFrame:
    """Every block of anchors against every group of rows; ``make`` builds what a stream keeps."""
    n_blocks, n_groups = max(1, -(-n_anchors // ANCHORS)), max(1, -(-n // GROUP))
    block = F.pmod(F.xxhash64("id", F.lit("block")), F.lit(n_blocks))
    group = F.pmod(F.xxhash64("id", F.lit("group")), F.lit(n_groups))
    every = lambda count: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(count - 1).cast("bigint")))
    rows = index.withColumn("g", group).withColumn("q", every(n_blocks)).withColumn("role", F.lit(1))
    asked = anchors.withColumn("q", block).withColumn("g", every(n_groups)).withColumn("role", F.lit(0))
    both = rows.unionByName(asked, allowMissingColumns=True).repartition("q", "g").sortWithinPartitions("q", "g", "role")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, state = None, [], None
        for batch in batches:
            keys = np.column_stack([batch.column(c).to_numpy() for c in ("q", "g", "role")])
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1 if len(keys) else np.zeros(0, dtype=int)
            for start, stop in zip([0, *cuts], [*cuts, len(keys)]):
                if start == stop:
                    continue
                part, (q, g, role) = batch.slice(start, stop - start), keys[start]
                if at != (q, g):
                    if state is not None:
                        yield state.finish()
                    at, held, state = (q, g), [], None
                if role == 0:
                    held.extend(part.to_pylist())
                    continue
                if state is None and held:
                    for a in held:
                        a["v"], a["angles"] = np.array(a["v"], dtype=np.int64), np.array(a["angles"], dtype=np.float64)
                    state = make(held)
                if state is not None:
                    state.feed(Block(part))
        if state is not None:
            yield state.finish()

    return both.mapInArrow(run, make.schema)


class _Make:
    """Builds a stream's state and knows its output columns."""

    def __init__(self, kind, *given):
        self.kind, self.given, self.schema = kind, given, kind.schema

    def __call__(self, anchors: list[dict]):
        return self.kind(anchors, *self.given)


def mine(
    vectors: DataFrame, anchor: Column, id_column: str = "vec_id", label: str | Column = "label", column: str = "embedding",
    positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``anchor`` is a condition on the column ``id``; a negative's score is between ``low`` and
    ``high`` percent of the positive's.
    """
    rows = cut_lineage(integer_rows(vectors, id_column, label, column))
    index = cut_lineage(with_angles(rows, directions(rows, REFERENCES, SAMPLE)))
    asked = index.where(anchor)
    n, n_asked = index.count(), asked.count()
    found = streamed(index, asked, n, n_asked, _Make(Positives, positives))
    best = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    top = found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= positives)
    # At most ``positives`` entries in a list.
    listed = top.groupBy("anchor_id").agg(F.collect_list(F.struct("positive_id", "positive_score")).alias("positives"))
    told = cut_lineage(asked.join(listed, asked["id"] == listed["anchor_id"]).drop("anchor_id"))
    near = streamed(index, told, n, n_asked, _Make(Negatives, negatives, low, high))
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    ranked = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


#: The same in SQL, for ``embeddings``: labels shifted where the id is divisible by 7, anchors every hundredth id.
SQL = """
        WITH rows AS MATERIALIZED (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                   list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
            FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        pairs AS MATERIALIZED (
            SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, list_inner_product(a.v, r.v)::BIGINT AS score
            FROM rows a JOIN rows r ON a.vec_id % 100 = 0 AND r.vec_id <> a.vec_id),
        positive AS (
            SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM pairs WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
        SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank,
               vec_id AS negative_id, positive_score, score AS negative_score
        FROM positive JOIN pairs USING (anchor_id)
        WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
        QUALIFY rank <= 10"""
