"""BM25 search.

``bm25_topk`` scans passages once: a pass counts the query's units in each and writes the
counts, and these are scored in-task, k per query.  ``postings.search`` gives the
same scores from an inverted table.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagemill.functions import text as X
from passagemill.operators.topk import cut_lineage, query_slices, rank_topk, task_topk, union_all
from passagemill.schemas import BM25_B, BM25_K1, IDF_FLOOR, LIMITS


def tokenized(chunks: DataFrame, text: str = "embed_text") -> DataFrame:
    """Add ``terms`` and the passage length ``dl``."""
    return chunks.withColumn("terms", X.index_terms(F.col(text))).withColumn(
        "dl", F.size("terms").cast("bigint")
    )


def term_df(chunks: DataFrame, text: str = "embed_text") -> DataFrame:
    """In how many passages each term occurs; repeats inside one count once."""
    once = tokenized(chunks, text).select(F.explode(F.array_distinct("terms")).alias("term"))
    return once.groupBy("term").agg(F.count("*").alias("df"))


def corpus_stats(chunks: DataFrame, text: str = "embed_text") -> DataFrame:
    """One row: number of passages and their mean length."""
    return tokenized(chunks, text).agg(
        F.count("*").alias("n"), F.avg("dl").alias("avgdl")
    )


def query_units(queries: DataFrame) -> DataFrame:
    """Scored units of each query: (qid, phrase array<string>, weight).

    A unit is one word; an underscore word is the phrase of its parts.  A word
    given twice counts twice, which is its ``weight``.
    """
    words = queries.select("qid", F.explode(X.query_words(F.col("q"))).alias("word"))
    phrases = words.select("qid", X.index_terms(F.col("word")).alias("phrase"))
    return phrases.where(F.size("phrase") > 0).groupBy("qid", "phrase").agg(F.count("*").alias("weight"))


def idf(df: Column, n: Column) -> Column:
    value = F.log((n - df + 0.5) / (df + 0.5))
    return F.when(value > 0, value).otherwise(F.lit(IDF_FLOOR))


def saturation(tf: Column, dl: Column, avgdl: Column) -> Column:
    return tf * (BM25_K1 + 1.0) / (tf + BM25_K1 * (1.0 - BM25_B + BM25_B * dl / avgdl))


@dataclass
class _Model:
    """A query batch as arrays: distinct units, and per query its (unit, weight) list."""

    qids: list[int]
    filters: list[str | None]
    phrases: list[tuple[str, ...]]
    weights: list[list[tuple[int, float]]]
    terms: list[str]

    @classmethod
    def of(cls, queries: DataFrame) -> _Model:
        units = query_units(queries).groupBy("qid").agg(
            F.collect_list(F.struct("phrase", "weight")).alias("units")
        )
        rows = queries.join(units, "qid", "left").select("qid", "doc_filter", "units").orderBy("qid").collect()
        index: dict[tuple[str, ...], int] = {}
        weights = []
        for row in rows:
            listed = sorted((tuple(u.phrase), u.weight) for u in row.units or [])
            weights.append([(index.setdefault(p, len(index)), float(w)) for p, w in listed])
        return cls(
            [r.qid for r in rows],
            [r.doc_filter or None for r in rows],
            list(index),
            weights,
            sorted({t for p in index for t in p}),
        )


class PhraseTree:
    """Finds phrases, given as lists of word codes below ``words``, in a stream of codes.

    Phrases are the paths of one tree, followed by all places of the stream at once, so the work
    grows with the stream and the longest phrase, not with the number of phrases.
    """

    def __init__(self, phrases: list[tuple[int, list[int]]], words: int):
        # A node is numbered as it is met; the last entry of ``root`` stands for a word of no phrase.
        self.root = np.full(words + 1, -1, dtype=np.int64)
        steps: dict[int, int] = {}
        ends: dict[int, int] = {}
        nodes = self.longest = 0
        for number, (first, *rest) in phrases:
            if self.root[first] < 0:
                self.root[first], nodes = nodes, nodes + 1
            node = int(self.root[first])
            for c in rest:
                key = node * words + c
                if key not in steps:
                    steps[key], nodes = nodes, nodes + 1
                node = steps[key]
            ends[node] = number
            self.longest = max(self.longest, 1 + len(rest))
        self.words = words
        self.keys = np.array(sorted(steps), dtype=np.int64)
        self.to = np.array([steps[k] for k in sorted(steps)], dtype=np.int64)
        self.ends = np.full(nodes, -1, dtype=np.int64)
        self.ends[list(ends)] = list(ends.values())

    def find(self, code: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number and row of every place where a phrase of two words or more stands within a row; -1 is no word."""
        at = np.flatnonzero(self.root[code] >= 0)
        node = self.root[code[at]]
        numbers, rows = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        for step in range(1, self.longest):
            inside = at + step < len(code)
            at, node = at[inside], node[inside]
            follow = code[at + step]
            same = (follow >= 0) & (row[at + step] == row[at])
            at, node = at[same], node[same]
            key = node * self.words + follow[same]
            place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            met = self.keys[place] == key
            at, node = at[met], self.to[place[met]]
            number = self.ends[node]
            numbers.append(number[number >= 0])
            rows.append(row[at[number >= 0]])
        return np.concatenate(numbers), np.concatenate(rows)


class _UnitCounter:
    """Counts the units of a model in batches of token arrays."""

    def __init__(self, model: _Model):
        self.terms = pa.array(model.terms, pa.string())
        code = {t: i for i, t in enumerate(model.terms)}
        self.single = np.full(len(model.terms), -1, dtype=np.int64)
        longer = []
        for unit, phrase in enumerate(model.phrases):
            if len(phrase) == 1:
                self.single[code[phrase[0]]] = unit
            else:
                longer.append((unit, [code[t] for t in phrase]))
        self.longer = PhraseTree(longer, len(model.terms))
        self.n_units = len(model.phrases)

    def __call__(self, terms: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted by unit: unit, row and frequency of every unit found in a row."""
        flat = terms.flatten()
        row = np.repeat(np.arange(len(terms)), pc.list_value_length(terms).fill_null(0).to_numpy(zero_copy_only=False))
        code = pc.index_in(flat, value_set=self.terms).fill_null(-1).to_numpy(zero_copy_only=False)
        unit = np.where(code >= 0, self.single[code], -1) if len(self.single) else np.full(len(code), -1)
        longer, at = self.longer.find(code, row)
        key = np.concatenate([unit[unit >= 0], longer]) * len(terms) + np.concatenate([row[unit >= 0], at])
        key, tf = np.unique(key, return_counts=True)
        return key // max(1, len(terms)), key % max(1, len(terms)), tf


def _list_array(column: pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def _counted(tokens: DataFrame, model: _Model, carry: list[str]) -> DataFrame:
    """Passages that hold a unit, (carry..., dl, units, tfs), written, so that texts are tokenised once.

    Each task adds a row of totals, whose units begin with -1: ``dl`` is the length of all its
    passages, ``tfs`` their number and then in how many of them each unit stands.
    """
    count = _UnitCounter(model)
    names = [*carry, "dl", "units", "tfs"]

    def lists(edge: np.ndarray, values: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), pa.array(values.astype(np.int32)))

    def run(batches):
        df = np.zeros(count.n_units, dtype=np.int64)
        rows = length = 0
        types = None
        for batch in batches:
            terms = batch.column("terms")
            types = [batch.schema.field(c).type for c in carry]
            unit, row, tf = count(terms)
            df += np.bincount(unit, minlength=count.n_units)
            rows += len(terms)
            dl = pc.list_value_length(terms).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            length += int(dl.sum())
            order = np.argsort(row, kind="stable")
            held, first = np.unique(row[order], return_index=True)
            edge = np.r_[first, len(row)]
            kept = [batch.column(c).take(pa.array(held)) for c in carry]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(dl[held]), lists(edge, unit[order]), lists(edge, tf[order])], names)
        if types is not None:
            seen = np.flatnonzero(df)
            edge = np.array([0, len(seen) + 1])
            yield pa.RecordBatch.from_arrays(
                [*(pa.nulls(1, t) for t in types), pa.array([length]), lists(edge, np.r_[-1, seen]), lists(edge, np.r_[rows, df[seen]])], names)

    fields = "".join(f"`{c}` {tokens.schema[c].dataType.simpleString()}, " for c in carry)
    return cut_lineage(tokens.select(*carry, "terms").mapInArrow(run, f"{fields}dl bigint, units array<int>, tfs array<int>"))


def _is_total() -> Column:
    return F.get("units", F.lit(0)) == -1


def _unit_statistics(counted: DataFrame, n_units: int) -> tuple[np.ndarray, int, float]:
    """Document frequency of each unit, passage count and mean length, from the tasks' totals."""
    entries = counted.where(_is_total()).select("dl", F.explode(F.arrays_zip("units", "tfs")).alias("e"))
    totals = entries.groupBy(F.col("e.units").alias("unit")).agg(F.sum("e.tfs").alias("rows"), F.sum("dl").alias("length")).collect()
    df = np.zeros(n_units, dtype=np.int64)
    n, length = 0, 0
    for row in totals:
        if row.unit < 0:
            n, length = row.rows, row.length
        else:
            df[row.unit] = row.rows
    return df, n, (length / n if n else 0.0)


def term_rows(tokens: DataFrame, terms: list[str], carry: str) -> tuple[DataFrame, list[int]]:
    """Rows (``carry``, units) of the ``tokens`` that hold one of the distinct ``terms``, by their
    places in the list, and in how many rows each term stands."""
    listed = _Model([], [], [(t,) for t in terms], [], terms)
    counted = _counted(tokens, listed, [carry])
    df, _, _ = _unit_statistics(counted, len(terms))
    return counted.where(~_is_total()).select(carry, "units"), df.tolist()


def _search_slice(chunks: DataFrame, queries: DataFrame, k: int, text: str, carry: list[str]) -> DataFrame:
    model = _Model.of(queries)
    filters, weights = model.filters, model.weights
    columns = list(dict.fromkeys([*carry, "doc_id"] if any(filters) else carry))
    counted = _counted(tokenized(chunks, text), model, columns)
    n_units = len(model.phrases)
    df, n, avgdl = _unit_statistics(counted, n_units)
    raw = np.log((n - df + 0.5) / (df + 0.5)) if n else np.zeros(len(df))
    unit_idf = np.where(raw > 0, raw, IDF_FLOOR)
    held = counted.where(~_is_total())
    if filters and all(filters):
        held = held.where(F.col("doc_id").cast("string").isin(sorted(set(filters))))

    def score(rows: pa.Table) -> np.ndarray:
        units, dl = _list_array(rows.column("units")), rows.column("dl").to_numpy()
        row = np.repeat(np.arange(len(units)), pc.list_value_length(units).to_numpy(zero_copy_only=False))
        unit, tf = units.flatten().to_numpy(), _list_array(rows.column("tfs")).flatten().to_numpy()
        order = np.argsort(unit, kind="stable")
        unit, row, tf = unit[order], row[order], tf[order].astype(np.int64)
        value = unit_idf[unit] * tf * (BM25_K1 + 1.0) / (
            tf + BM25_K1 * (1.0 - BM25_B + BM25_B * dl[row] / avgdl)
        )
        edge = np.searchsorted(unit, np.arange(n_units + 1))
        out = np.zeros((len(weights), len(units)))
        doc = None
        for q, listed in enumerate(weights):
            for u, w in listed:
                part = slice(edge[u], edge[u + 1])
                out[q, row[part]] += w * value[part]
            if filters[q]:
                if doc is None:
                    doc = np.array([str(d) for d in rows.column("doc_id").to_pylist()])
                out[q, doc != filters[q]] = 0.0
        out[out <= 0.0] = -np.inf
        return out

    return task_topk(held, model.qids, k, carry, score)


def bm25_topk(
    chunks: DataFrame,
    queries: DataFrame,
    k: int = LIMITS.lexical_k,
    text: str = "embed_text",
    carry: tuple[str, ...] = ("chunk_id", "parent_id"),
) -> DataFrame:
    """Best ``k`` passages per query (qid, q, doc_filter) with score and rank.

    A filter narrows what is returned; frequencies and lengths stay those of the
    whole corpus.
    """
    parts = [_search_slice(chunks, part, k, text, list(carry)) for part in query_slices(queries)]
    return rank_topk(union_all(parts), k, carry[0])
