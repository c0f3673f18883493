"""BM25 over block-max postings.

Passages are cut, as a task meets them, into ranges of bounded size.  The postings of a term in
a range are one row: local numbers of the passages, frequencies, positions, and the ``tops``,
the (frequency, length) pairs that no other passage of the row beats.  Their saturation bounds
what the row can add to a score, whatever the mean length is by then.  One more row per range
lists its passages, so scores, ties and owners are settled inside a range.

A search reads the small head of each row first.  Heads give the document frequencies and, per
query and range, an upper bound.  The range with the largest bound of each query is scored; the
k-th best score found is a floor, and ranges whose bound is below it are never opened.  Sums and
the best k stay in the task that holds the range: what is exchanged is rows of postings, at most
k results per query and range, and one bound per query and range.  Queries are dealt to groups,
so a task holds one range and one group, however large the batch.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passagemill.operators.lexical import PhraseTree, idf, query_units, saturation, tokenized
from passagemill.operators.topk import SCORE_DECIMALS, cut_lineage, rank_topk
from passagemill.schemas import BM25_B, BM25_K1, LIMITS

#: A range holds at most so many passages and terms (a longer passage is a range of its own).
RANGE_ROWS, RANGE_TERMS = 4096, 1 << 20
#: Queries that a task scores against a range at a time.
QUERY_GROUP = 256
#: Bounds are sums in another order than scores; they may be lower by rounding only.
SLACK = 1e-6

BLOCK = "range string, term string, n int, tops array<struct<tf:int,dl:int>>, at array<int>, tf array<int>, positions array<int>"


@dataclass
class Postings:
    """``blocks`` (one row per range and term) and ``ranges`` (one row per range).

    ``stored`` are the blocks as they lie and the ranges that have lost passages, where there are any.
    """

    blocks: DataFrame
    ranges: DataFrame
    buckets: int | None = None
    stored: tuple[DataFrame, DataFrame] | None = None

    def stats(self):
        """Number of passages and their mean length, from one small row per range."""
        held = F.size(F.filter("chunk_ids", lambda c: c.isNotNull()))
        one = self.ranges.agg(F.sum(held).alias("n"), F.sum("length").alias("length")).collect()[0]
        n = one.n or 0
        return n, (one.length / n if n else 0.0)

    def of_terms(self, terms: DataFrame) -> DataFrame:
        """Blocks of the terms (term).  Stored blocks lie in buckets; only those of the terms are opened."""
        blocks = self.blocks if self.stored is None else self.stored[0]
        if self.buckets is not None and "bucket" in blocks.columns:
            # At most ``buckets`` numbers, whatever the batch holds.
            code = F.pmod(F.xxhash64("term"), F.lit(self.buckets)).cast("int").alias("bucket")
            wanted = [r.bucket for r in terms.select(code).distinct().collect()]
            blocks = blocks.where(F.col("bucket").isin(wanted)) if wanted else blocks.limit(0)
        blocks = blocks.join(terms, "term")
        # Lost passages are taken out of these blocks alone, once for the search.
        return blocks if self.stored is None else cut_lineage(_shortened(blocks, self.stored[1]))


def inverted(chunks: DataFrame, text: str = "embed_text", most: int = RANGE_ROWS) -> DataFrame:
    """Blocks and, with a null ``term``, range rows; nothing is shuffled.

    A block and its range come out of one task, so both must be taken from one written table.
    """
    extra = [c for c in ("parent_id",) if c in chunks.columns]
    source = tokenized(chunks, text).select("chunk_id", F.col("doc_id").cast("string").alias("doc_id"), *extra, "terms")
    kinds = {f.name: f.dataType.simpleString() for f in source.schema}
    schema = (
        f"{BLOCK}, length bigint, chunk_ids array<{kinds['chunk_id']}>, doc_ids array<string>, "
        f"parent_ids array<{kinds.get('parent_id', 'string')}>, dls array<int>"
    )
    salt = uuid.uuid4().hex[:12]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            for part in _bounded(batch, most):
                name = f"{salt}-{task}-{number}"
                number += 1
                both = pa.concat_tables([_blocks(part, name), _range(part, name)], promote_options="default")
                yield from both.select(names).combine_chunks().to_batches()

    names = ["range", "term", "n", "tops", "at", "tf", "positions", "length", "chunk_ids", "doc_ids", "parent_ids", "dls"]
    return source.mapInArrow(run, schema)


def _bounded(batch: pa.RecordBatch, rows: int) -> Iterator[pa.RecordBatch]:
    if not batch.num_rows:
        return
    ends = np.cumsum(_sizes(batch.column("terms")))
    start = 0
    while start < batch.num_rows:
        reach = int(np.searchsorted(ends, (ends[start - 1] if start else 0) + RANGE_TERMS, side="right"))
        stop = min(max(start + 1, reach), start + rows)
        yield batch.slice(start, stop - start)
        start = stop


def _sizes(lists: pa.Array) -> np.ndarray:
    return pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def _int_lists(values: np.ndarray, starts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.r_[starts, len(values)].astype(np.int32)), pa.array(values.astype(np.int32)))


def _range(batch: pa.RecordBatch, name: str) -> pa.Table:
    sizes = _sizes(batch.column("terms"))
    whole = np.array([0, len(sizes)], dtype=np.int32)
    listed = {c: pa.ListArray.from_arrays(pa.array(whole), batch.column(c)) for c in batch.schema.names if c != "terms"}
    owner = listed.get("parent_id", pa.nulls(1, pa.list_(pa.string())))
    return pa.table({
        "range": pa.array([name]), "length": pa.array([int(sizes.sum())]), "chunk_ids": listed["chunk_id"],
        "doc_ids": listed["doc_id"], "parent_ids": owner, "dls": _int_lists(sizes, np.array([0])),
    })


def _blocks(batch: pa.RecordBatch, name: str) -> pa.Table:
    terms = batch.column("terms")
    sizes = _sizes(terms)
    coded = terms.flatten().dictionary_encode()
    row = np.repeat(np.arange(len(sizes)), sizes)
    position = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    codes = coded.indices.to_numpy() if len(coded) else np.zeros(0, dtype=np.int64)
    order = np.lexsort((row, codes))  # stable, so positions stay in order
    key = codes[order].astype(np.int64) * len(sizes) + row[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, dtype=np.int64)
    tf = np.diff(np.r_[first, len(key)])
    at, code = row[order][first], codes[order][first]
    begin = np.flatnonzero(np.r_[True, code[1:] != code[:-1]]) if len(code) else np.zeros(0, dtype=np.int64)
    tops_tf, tops_dl, tops_begin = frontier(code, tf, sizes[at])
    tops = pa.StructArray.from_arrays([pa.array(tops_tf.astype(np.int32)), pa.array(tops_dl.astype(np.int32))], ["tf", "dl"])
    return pa.table({
        "range": pa.array([name] * len(begin), pa.string()),
        "term": coded.dictionary.take(pa.array(code[begin])) if len(begin) else pa.array([], pa.string()),
        "n": pa.array(np.diff(np.r_[begin, len(code)]).astype(np.int32)),
        "tops": pa.ListArray.from_arrays(pa.array(np.r_[tops_begin, len(tops_tf)].astype(np.int32)), tops),
        "at": _int_lists(at, begin), "tf": _int_lists(tf, begin), "positions": _int_lists(position[order], first[begin]),
    })


def frontier(code: np.ndarray, tf: np.ndarray, dl: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per code (ascending) the (tf, dl) that no pair of higher tf and no larger dl beats, and where each code starts."""
    order = np.lexsort((dl, -tf, code))
    code, tf, dl = code[order].astype(np.int64), tf[order], dl[order].astype(np.int64)
    if not len(code):
        return tf, dl, np.zeros(0, dtype=np.int64)
    # Later codes lie wholly below earlier ones, so one running minimum serves all.
    lowered = dl - code * (int(dl.max()) + 1)
    seen = np.r_[np.iinfo(np.int64).max, np.minimum.accumulate(lowered)[:-1]]
    kept = lowered < seen
    code = code[kept]
    return tf[kept], dl[kept], np.flatnonzero(np.r_[True, code[1:] != code[:-1]])


def of_chunks(chunks: DataFrame, text: str = "embed_text", most: int = RANGE_ROWS) -> Postings:
    """Postings of passages that no index holds yet."""
    return split(cut_lineage(inverted(chunks, text, most)))


def split(rows: DataFrame) -> Postings:
    blocks = rows.where(F.col("term").isNotNull()).select("range", "term", "n", "tops", "at", "tf", "positions")
    return Postings(blocks, rows.where(F.col("term").isNull()).select("range", "length", "chunk_ids", "doc_ids", "parent_ids", "dls"))


def posting_rows(postings: Postings) -> DataFrame:
    """One row per term and passage: (chunk_id, term, tf, dl, positions)."""
    each = postings.blocks.select("range", "term", "at", "tf", "positions").join(
        postings.ranges.select("range", "chunk_ids", "dls"), "range")
    # Positions follow each other; a passage's begin where those before it end.
    each = each.withColumn("ends", F.aggregate(
        "tf", F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x))))
    rows = each.select("range", "term", "chunk_ids", "dls", "positions", "ends", F.posexplode(F.arrays_zip("at", "tf")).alias("i", "p"))
    return rows.select(
        F.get("chunk_ids", F.col("p.at")).alias("chunk_id"), "term", F.col("p.tf").cast("bigint").alias("tf"),
        F.get("dls", F.col("p.at")).cast("bigint").alias("dl"),
        F.slice("positions", F.get("ends", F.col("i")) + 1, F.col("p.tf")).alias("positions"),
    )


def without(postings: Postings, dead: DataFrame, generation: Column) -> Postings:
    """Postings without the passages of superseded (doc_id, dead) pairs; ``generation`` is that of a range row.

    Only ranges that hold such passages are opened and written anew; their heads count what is left.
    """
    held = postings.ranges.select("range", generation.alias("gen"), F.posexplode("doc_ids").alias("at", "doc_id"))
    gone = held.join(dead, (held["doc_id"] == dead["doc_id"]) & (held["gen"] == dead["dead"]), "left_semi")
    lost = cut_lineage(gone.groupBy("range").agg(F.sort_array(F.collect_list("at")).alias("lost")))
    if lost.isEmpty():
        return postings
    ranges = postings.ranges
    # Passages keep their numbers in the range; a lost one has no id and no length.
    blank = lambda c: F.transform(c, lambda x, i: F.when(~F.array_contains("lost", i), x))
    dls = F.transform("dls", lambda x, i: F.when(F.array_contains("lost", i), 0).otherwise(x))
    shorter = cut_lineage(ranges.join(lost, "range").select(
        "range", F.aggregate(dls, F.lit(0).cast("bigint"), lambda a, x: a + x).alias("length"), blank("chunk_ids").alias("chunk_ids"),
        blank("doc_ids").alias("doc_ids"), blank("parent_ids").alias("parent_ids"), dls.alias("dls"), "lost"))
    left = ranges.select(*[c for c in shorter.columns if c != "lost"]).join(cut_lineage(lost.select("range")), "range", "left_anti")
    return Postings(
        _shortened(postings.blocks, shorter), left.unionByName(shorter.drop("lost")), postings.buckets, (postings.blocks, shorter))


def _shortened(blocks: DataFrame, shorter: DataFrame) -> DataFrame:
    """Blocks without the passages that their range has lost; the others as they are.

    A task takes the blocks of one range and the range's lengths once, whatever the number of its terms.
    """
    columns = ["range", "term", "n", "tops", "at", "tf", "positions", *(c for c in blocks.columns if c == "bucket")]
    blocks, hit = blocks.select(*columns), cut_lineage(shorter.select("range"))
    touched = blocks.join(hit, "range", "left_semi")
    kept = touched.groupBy("range").cogroup(shorter.select("range", "lost", "dls").groupBy("range")).applyInArrow(
        _drop, BLOCK + (", bucket int" if "bucket" in columns else ""))
    return blocks.join(hit, "range", "left_anti").unionByName(kept)


def _drop(left: pa.Table, right: pa.Table) -> pa.Table:
    """The blocks of one range without its lost passages; a term that has none left goes."""
    if not left.num_rows or not right.num_rows:
        return left.slice(0, 0)
    flat = {c: pc.list_flatten(left.column(c)).to_numpy().astype(np.int64) for c in ("at", "tf", "positions")}
    row = np.repeat(np.arange(left.num_rows), _sizes(left.column("at")))
    gone = np.zeros(len(right.column("dls")[0]), dtype=bool)
    gone[right.column("lost")[0].values.to_numpy()] = True
    dl = right.column("dls")[0].values.to_numpy().astype(np.int64)
    keep = ~gone[flat["at"]]
    row, at, tf, positions = row[keep], flat["at"][keep], flat["tf"][keep], flat["positions"][np.repeat(keep, flat["tf"])]
    begin = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.zeros(0, dtype=np.int64)
    first = np.cumsum(tf) - tf
    tops_tf, tops_dl, tops_begin = frontier(row, tf, dl[at])
    tops = pa.StructArray.from_arrays([pa.array(tops_tf.astype(np.int32)), pa.array(tops_dl.astype(np.int32))], ["tf", "dl"])
    out = left.take(pa.array(row[begin]))
    for name, values in (
        ("n", pa.array(np.diff(np.r_[begin, len(row)]).astype(np.int32))),
        ("tops", pa.ListArray.from_arrays(pa.array(np.r_[tops_begin, len(tops_tf)].astype(np.int32)), tops)),
        ("at", _int_lists(at, begin)), ("tf", _int_lists(tf, begin)), ("positions", _int_lists(positions, first[begin])),
    ):
        out = out.set_column(out.schema.get_field_index(name), name, values)
    return out


# --- search ---------------------------------------------------------------------------


def _phrase_blocks(postings: Postings, units: DataFrame) -> DataFrame:
    """Blocks of phrases: where their terms stand one after the other.  A phrase is named by its terms.

    A task puts the places of a range's words in order once and follows all phrases whose first word is there.
    """
    phrases = units.where("size > 1").select("unit", "phrase").distinct()
    met = postings.of_terms(phrases.select(F.explode("phrase").alias("term")).distinct())
    asked = met.select("range", "term").join(phrases.withColumn("term", F.get("phrase", F.lit(0))), "term").select(F.col("range").alias("of"), "unit", "phrase")
    schema = "range string, unit string, n int, tops array<struct<tf:int,dl:int>>, at array<int>, tf array<int>"
    left = met.select("range", "term", "at", "tf", "positions")
    return cut_lineage(left.groupBy("range").cogroup(asked.groupBy("of")).applyInArrow(_match, schema))


def _match(left: pa.Table, right: pa.Table) -> pa.Table:
    """The phrases of one range that stand somewhere in it."""
    code = {t: i for i, t in enumerate(left.column("term").to_pylist())}
    units = right.column("unit").to_pylist()
    phrases = [(i, [code[t] for t in p]) for i, p in enumerate(right.column("phrase").to_pylist()) if all(t in code for t in p)]
    at, tf, position = (pc.list_flatten(left.column(c)).to_numpy().astype(np.int64) for c in ("at", "tf", "positions"))
    row = np.repeat(at, tf)
    # One place more than any row has, so that a row's last word is not before the next row's first.
    place = row * ((int(position.max()) if len(position) else 0) + 2) + position
    word = np.repeat(np.repeat(np.arange(left.num_rows), _sizes(left.column("at"))), tf)
    order = np.argsort(place)
    place, row, word = place[order], row[order], word[order]
    # Words that do not follow each other are parted by a gap.
    to = np.arange(len(place)) + np.cumsum(np.r_[False, np.diff(place) > 1][: len(place)])
    stream, rows = np.full(int(to[-1]) + 1 if len(to) else 0, -1, dtype=np.int64), np.zeros(int(to[-1]) + 1 if len(to) else 0, dtype=np.int64)
    stream[to], rows[to] = word, row
    unit, held = PhraseTree(phrases, max(1, len(code))).find(stream, rows)
    wide = int(held.max()) + 1 if len(held) else 1
    key, tf = np.unique(unit * wide + held, return_counts=True)
    unit, at = key // wide, key % wide
    begin = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]]) if len(unit) else np.zeros(0, dtype=np.int64)
    most = np.maximum.reduceat(tf, begin) if len(begin) else tf
    tops = pa.StructArray.from_arrays([pa.array(most.astype(np.int32)), pa.array(np.zeros(len(most), dtype=np.int32))], ["tf", "dl"])
    return pa.table({
        "range": pa.array([left.column("range")[0].as_py() for _ in begin], pa.string()), "unit": pa.array([units[u] for u in unit[begin]], pa.string()),
        "n": pa.array(np.diff(np.r_[begin, len(unit)]).astype(np.int32)),
        "tops": pa.ListArray.from_arrays(pa.array(np.arange(len(most) + 1, dtype=np.int32)), tops),
        "at": _int_lists(at, begin), "tf": _int_lists(tf, begin),
    })


def _score(avgdl: float, k: int):
    """Best k passages per query of one range and one group of queries."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[list] = [[], [], [], []]
        listed = left.filter(pc.is_valid(left.column("chunk_ids"))).to_pylist()
        if listed and right.num_rows:
            ids, docs, owners = (np.array(listed[0][c] or [None] * len(listed[0]["dls"]), dtype=object) for c in ("chunk_ids", "doc_ids", "parent_ids"))
            norm = BM25_K1 * (1.0 - BM25_B + BM25_B * np.array(listed[0]["dls"], dtype=np.float64) / avgdl) if avgdl else np.zeros(len(ids))
            blocks = left.filter(pc.is_valid(left.column("unit")))
            values = {}
            for unit, at, tf in zip(*(blocks.column(c).to_pylist() for c in ("unit", "at", "tf"))):
                at, tf = np.array(at), np.array(tf, dtype=np.float64)
                values[unit] = at, tf * (BM25_K1 + 1.0) / (tf + norm[at])
            for row in right.to_pylist():
                scores = np.zeros(len(ids))
                for part in sorted(row["gains"], key=lambda g: g["unit"]):
                    if part["unit"] in values:
                        at, value = values[part["unit"]]
                        scores[at] += part["gain"] * value
                if row["doc_filter"]:
                    scores[docs != row["doc_filter"]] = 0.0
                scores = np.round(scores, SCORE_DECIMALS)
                rows = np.flatnonzero(scores > 0)
                if len(rows) > k:
                    rows = rows[scores[rows] >= np.partition(scores[rows], len(rows) - k)[len(rows) - k]]
                best = sorted(rows, key=lambda i: (-scores[i], ids[i]))[:k]
                for column, value in zip(found, ([row["qid"]] * len(best), ids[best], owners[best], scores[best])):
                    column.extend(value)
        kinds = [left.schema.field(c).type.value_type for c in ("chunk_ids", "parent_ids")]
        return pa.table({
            "qid": pa.array(found[0], pa.int64()), "chunk_id": pa.array(found[1], kinds[0]), "parent_id": pa.array(found[2], kinds[1]),
            "score": pa.array(found[3], pa.float64()),
        })

    return run


def search(postings: Postings, queries: DataFrame, k: int = LIMITS.lexical_k) -> DataFrame:
    """Best ``k`` passages per query (qid, q, doc_filter): (qid, chunk_id, parent_id, score, rank).

    A filter narrows what is returned; frequencies and lengths stay those of the whole corpus.
    """
    return rank_topk(_found(postings, queries, k)[0], k, "chunk_id")


def _found(postings: Postings, queries: DataFrame, k: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Results of the opened ranges, all pairs of a query and a range with their bounds, and those opened."""
    n, avgdl = postings.stats()
    filters = queries.select("qid", F.when(F.col("doc_filter") != "", F.col("doc_filter")).alias("doc_filter"))
    units = query_units(queries).join(filters, "qid").select(
        "qid", "doc_filter", "phrase", "weight", F.size("phrase").alias("size"), F.array_join("phrase", " ").alias("unit"))
    units = cut_lineage(units)
    batch = units.agg(F.count_distinct("qid").alias("queries"), F.max("size").alias("longest"), F.count("doc_filter").alias("narrow")).collect()[0]
    single = postings.of_terms(units.where("size = 1").select(F.col("unit").alias("term")).distinct()).withColumnRenamed("term", "unit")
    columns = ["range", "unit", "n", "tops", "at", "tf"]
    blocks = single.select(*columns)
    if (batch.longest or 0) > 1:
        blocks = blocks.unionByName(_phrase_blocks(postings, units).select(*columns))
    heads = cut_lineage(blocks.select("range", "unit", "n", "tops"))
    frequency = heads.groupBy("unit").agg(F.sum("n").alias("df"))
    gains = cut_lineage(units.join(frequency, "unit").select(
        "qid", "doc_filter", "unit", (F.col("weight") * idf(F.col("df"), F.lit(float(n)))).alias("gain")))
    reach = F.array_max(F.transform("tops", lambda t: saturation(t["tf"], t["dl"], F.lit(avgdl or 1.0))))
    bounds = heads.select("range", "unit", reach.alias("reach")).join(gains, "unit")
    bounds = bounds.groupBy("qid", "doc_filter", "range").agg(F.sum(F.col("gain") * F.col("reach")).alias("bound"))
    if batch.narrow:
        # Ranges that hold the document of a filter; others cannot answer it.
        places = postings.ranges.select("range", F.explode(F.array_distinct("doc_ids")).alias("doc_filter"))
        held = bounds.where(F.col("doc_filter").isNotNull()).join(places, ["range", "doc_filter"], "left_semi")
        bounds = bounds.where(F.col("doc_filter").isNull()).unionByName(held.select(*bounds.columns))
    best = Window.partitionBy("qid").orderBy(F.desc("bound"), "range")
    bounds = cut_lineage(bounds.select("qid", "range", "bound", (F.row_number().over(best) == 1).alias("first")))
    groups = max(1, -(-batch.queries // QUERY_GROUP))
    group = F.pmod(F.xxhash64("qid"), F.lit(groups)).cast("int")
    asked = gains.groupBy("qid", "doc_filter").agg(F.collect_list(F.struct("unit", "gain")).alias("gains")).withColumn("g", group)

    def opened(pairs: DataFrame) -> DataFrame:
        pairs = pairs.select("qid", "range")
        keys = pairs.select("range", group.alias("g")).distinct()
        rows = blocks.select("range", "unit", "at", "tf").join(keys, "range")
        lists = postings.ranges.select("range", "chunk_ids", "doc_ids", "parent_ids", "dls").join(keys, "range")
        left = rows.unionByName(lists, allowMissingColumns=True)
        right = pairs.join(asked, "qid")
        ids = postings.ranges.schema["chunk_ids"].dataType.elementType.simpleString()
        owner = postings.ranges.schema["parent_ids"].dataType.elementType.simpleString()
        schema = f"qid bigint, chunk_id {ids}, parent_id {owner}, score double"
        return left.groupBy("range", "g").cogroup(right.groupBy("range", "g")).applyInArrow(_score(avgdl, k), schema)

    early = cut_lineage(opened(bounds.where("first")))
    floors = rank_topk(early, k, "chunk_id").where(F.col("rank") == k).select("qid", F.col("score").alias("floor"))
    later = bounds.where("NOT first").join(floors, "qid", "left")
    later = later.where(F.col("floor").isNull() | (F.col("bound") + SLACK >= F.col("floor")))
    return early.unionByName(opened(later)), bounds, bounds.where("first").select("qid", "range").unionByName(later.select("qid", "range"))


def opened_share(postings: Postings, queries: DataFrame, k: int = LIMITS.lexical_k) -> tuple[int, int]:
    """Pairs of a query and a range with any of its terms that are opened, and all of them."""
    _, bounds, opened = _found(postings, queries, k)
    return opened.count(), bounds.count()
