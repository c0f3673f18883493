"""Language identification by the nearest of several centroids per language.

A text is a vector of hashed byte n-grams (runs of letters, ASCII case folded), weighted
by TF-IDF and normalised.  Each language has several centroids, clustered by cosine from
a bounded sample of labelled rows; a text gets the language of its nearest centroid, and
is rejected when even that one is further away than all but ``REJECTED`` of the training
texts of that language and a similar length are from theirs.

Document frequencies and the bounds of rejection cover all training rows; only clustering
uses a sample, of about ``SAMPLE`` rows per language chosen by a hash of the id.

Defined cases: a null text, or one without a letter, is ``und`` with score 0 and is
rejected; without any training row every text is ``und``; ties go to the language that
sorts first; rows with a null language or null id are never learnt from.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagemill.llm.common import cut_lineage, slices, text_bytes

BUCKETS = 8192
#: Labelled rows per language that clustering may see, centroids per language and rounds.
SAMPLE, CENTROIDS, ROUNDS = 1500, 3, 8
#: More distinct labels than this are refused; it bounds what is broadcast.
MOST_LANGUAGES = 10_000
#: Rejection: below this quantile of the training rows' cosines, counted in this many bins.  Where
#: a language has fewer than 1 / REJECTED rows of a length, shorter ones are counted with them; where
#: those are too few as well, the rows of all languages; fewer rows than that tell no quantile.
REJECTED, BINS = 0.002, 4096
#: Cosines are compared within classes of length: powers of two of the n-gram count.
LENGTHS = 24
_FOLD = np.array([c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256)], dtype=np.uint32)


def has_letter(raw: bytes) -> bool:
    return any(map(str.isalpha, raw.decode()))


def _buckets(data: np.ndarray, n: int) -> np.ndarray:
    """Hashed n-grams that start at each byte but the last n - 1."""
    gram = np.zeros(max(0, len(data) - n + 1), dtype=np.uint32)
    for k in range(n):
        gram = gram * np.uint32(0x01000193) + data[k : len(data) - n + 1 + k] + np.uint32(n)
    gram *= np.uint32(0x9E3779B1)
    return gram >> np.uint32(32 - int(np.log2(BUCKETS)))


def term_counts(raw: bytes) -> np.ndarray:
    """How often each hashed n-gram of 1 to 3 bytes occurs; words are padded by blanks."""
    data = _FOLD[np.frombuffer(b" " + raw + b" ", dtype=np.uint8)]
    keep = np.ones(len(data), dtype=bool)
    keep[1:] = (data[1:] != 32) | (data[:-1] != 32)  # runs of separators count as one
    data = data[keep]
    counts = np.bincount(_buckets(data, 2), minlength=BUCKETS) + np.bincount(_buckets(data, 3), minlength=BUCKETS)
    return counts + np.bincount(_buckets(data[data != 32], 1), minlength=BUCKETS)


def vector(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(counts).astype(np.float32) * idf
    norm = float(np.sqrt(v @ v))
    return v / norm if norm else v


def _length_class(counts: np.ndarray) -> int:
    return min(LENGTHS - 1, int(np.log2(max(1, int(counts.sum())))))


@dataclass(frozen=True)
class Model:
    languages: list[str]
    owner: np.ndarray  # centroid -> language
    centroids: np.ndarray
    idf: np.ndarray
    floor: np.ndarray  # least cosine by language and class of length

    def nearest(self, raws: list[bytes]) -> Iterator[tuple[int, int, float, int]]:
        """(row, language, cosine, class of length) of the texts that can be judged."""
        known = [i for i, raw in enumerate(raws) if self.languages and has_letter(raw)]
        for lo in range(0, len(known), 512):
            part = known[lo : lo + 512]
            counts = [term_counts(raws[i]) for i in part]
            near = np.stack([vector(c, self.idf) for c in counts]) @ self.centroids.T
            for i, c, row in zip(part, counts, near):
                best = int(np.argmax(row))
                score = float(min(1.0, max(0.0, row[best])))
                yield i, int(self.owner[best]), score, _length_class(c)

    def predict(self, raws: list[bytes]) -> list[tuple[str, float, bool]]:
        out: list[tuple[str, float, bool]] = [("und", 0.0, True)] * len(raws)
        for i, language, score, length in self.nearest(raws):
            out[i] = (self.languages[language], score, score < self.floor[language, length])
        return out


def _document_frequency(docs: DataFrame, text: str) -> tuple[np.ndarray, int]:
    """In how many rows each hashed n-gram occurs, and the number of rows; summed by bucket in Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS + 1, dtype=np.int64)
        for part in slices(batches, text):
            for raw in text_bytes(part.column(text)):
                total[:BUCKETS] += term_counts(raw) > 0
                total[BUCKETS] += 1
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    rows = docs.select(text).mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    frequency = np.zeros(BUCKETS + 1, dtype=np.int64)
    for bucket, n in rows.collect():  # at most BUCKETS + 1 rows
        frequency[bucket] = n
    return frequency[:BUCKETS], int(frequency[BUCKETS])


def cluster(vectors: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """Spherical k-means from spread-out starting rows; at most ``k`` unit centroids."""
    chosen = [0]
    nearest = vectors @ vectors[0]
    while len(chosen) < min(k, len(vectors)):
        far = int(np.argmin(nearest))
        if nearest[far] > 1 - 1e-6:
            break
        chosen.append(far)
        nearest = np.maximum(nearest, vectors @ vectors[far])
    centroids = vectors[chosen].copy()
    for _ in range(rounds):
        side = np.argmax(vectors @ centroids.T, axis=1)
        for c in range(len(centroids)):
            if (side == c).any():
                mean = vectors[side == c].sum(axis=0)
                centroids[c] = mean / max(1e-12, float(np.sqrt(mean @ mean)))
    return centroids


def lowest(counts: np.ndarray) -> list[float | None]:
    """Per class of length the cosine below which at most ``REJECTED`` of the counted rows lie, from
    counts by (class, bin); none where the class and all shorter ones have too few rows."""
    out: list[float | None] = []
    for length in range(LENGTHS):
        pool = np.zeros(BINS + 1, dtype=np.int64)
        for c in range(length, -1, -1):
            pool += counts[c]
            if pool.sum() * REJECTED >= 1:
                break
        enough = pool.sum() * REJECTED >= 1
        out.append(int(np.argmax(np.cumsum(pool) > REJECTED * pool.sum())) / BINS if enough else None)
    return out


def _floors(rows: DataFrame, model: Model) -> np.ndarray:
    """The bounds of rejection by (language, class of length), from all rows."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            found = [(language, length * (BINS + 1) + int(score * BINS)) for _, language, score, length in shared.value.nearest(text_bytes(part.column("text")))]
            places, times = np.unique(np.array(found, dtype=np.int64).reshape(-1, 2), axis=0, return_counts=True)
            yield pa.record_batch([pa.array(places[:, 0]), pa.array(places[:, 1]), pa.array(times.astype(np.int64))], ["language", "place", "n"])

    def bound(table: pa.Table) -> pa.Table:
        counts = np.zeros(LENGTHS * (BINS + 1), dtype=np.int64)
        counts[table.column("place").to_numpy()] = table.column("n").to_numpy()
        return pa.table({"language": table.column("language").slice(0, 1), "floor": pa.array([lowest(counts.reshape(LENGTHS, -1))], pa.list_(pa.float64()))})

    counted = rows.select("text").mapInArrow(run, "language bigint, place bigint, n bigint").groupBy("language", "place").agg(F.sum("n").alias("n"))
    counted = cut_lineage(counted)
    pooled = counted.groupBy("place").agg(F.sum("n").alias("n")).select(F.lit(-1).cast("bigint").alias("language"), "place", "n")
    found = counted.unionByName(pooled).groupBy("language").applyInArrow(bound, "language bigint, floor array<double>")
    floors = dict(found.collect())  # a row per language
    every = floors.get(-1, [None] * LENGTHS)
    own = [floors.get(k, [None] * LENGTHS) for k in range(len(model.languages))]
    return np.array([[next((x for x in pair if x is not None), 0.0) for pair in zip(row, every)] for row in own])


def fit(
    docs: DataFrame, learn: Column, id_column: str = "doc_id", text: str = "text", label: str = "lang", sample: int = SAMPLE,
) -> Model:
    """Learn from the rows where ``learn`` holds and the label is known."""
    rows = docs.where(learn & F.col(label).isNotNull() & F.col(id_column).isNotNull() & F.col(text).isNotNull()).select(
        F.col(id_column).alias("id"), F.col(text).cast("string").alias("text"), F.col(label).cast("string").alias("label")
    )
    frequency, n = _document_frequency(rows, "text")
    idf = (np.log((1.0 + n) / (1.0 + frequency)) + 0.1).astype(np.float32)
    sizes = cut_lineage(rows.groupBy("label").agg(F.count("*").alias("rows")))
    if sizes.count() > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} distinct labels: these are not languages")
    # About `sample` rows of each language: those whose hash falls under the language's share.
    chance = (F.xxhash64(F.col("id").cast("string"), F.lit("sample")) / 2.0**64 + 0.5) < sample / F.col("rows")
    drawn = rows.join(F.broadcast(sizes), "label").where(chance).select("label", "id", "text")

    def learn_language(table: pa.Table) -> pa.Table:
        order = np.argsort(np.array(table.column("id").cast(pa.string()).to_pylist()), kind="stable")
        raws = [raw for raw in text_bytes(table.column("text").combine_chunks().take(pa.array(order))) if has_letter(raw)]
        names, arrays = [], []
        if raws:
            centroids = cluster(np.stack([vector(term_counts(raw), idf) for raw in raws]), CENTROIDS)
            names = [table.column("label")[0].as_py()] * len(centroids)
            arrays = [c.astype(np.float32).tobytes() for c in centroids]
        return pa.table({"label": pa.array(names, pa.string()), "centroid": pa.array(arrays, pa.binary())})

    learnt = drawn.groupBy("label").applyInArrow(learn_language, "label string, centroid binary")
    found = sorted(learnt.collect(), key=lambda r: (r["label"], r["centroid"]))  # languages x CENTROIDS rows
    languages = sorted({r["label"] for r in found})
    if not found:
        return Model([], np.zeros(0, dtype=int), np.zeros((0, BUCKETS), dtype=np.float32), idf, np.zeros((0, LENGTHS)))
    model = Model(
        languages, np.array([languages.index(r["label"]) for r in found]),
        np.stack([np.frombuffer(r["centroid"], dtype=np.float32) for r in found]), idf, np.zeros((len(languages), LENGTHS)),
    )
    return replace(model, floor=_floors(rows, model))


def identify(docs: DataFrame, model: Model, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, lang_pred, score, rejected) of every row; ``score`` is the cosine to the nearest centroid."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text):
            found = shared.value.predict(text_bytes(part.column(text)))
            yield pa.record_batch([
                part.column(id_column), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()),
                pa.array([bool(f[2]) for f in found], pa.bool_()),
            ], [id_column, "lang_pred", "score", "rejected"])

    rows = docs.select(F.col(id_column), F.col(text).cast("string").alias(text))
    kind = rows.schema[id_column].dataType.simpleString()
    return rows.mapInArrow(run, f"`{id_column}` {kind}, lang_pred string, score double, rejected boolean")


def keep_identified(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows, with all their columns, whose text is not rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text):
            found = shared.value.predict(text_bytes(part.column(text)))
            yield part.filter(pa.array([not f[2] for f in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
