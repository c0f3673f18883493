"""Similarity self-join on word n-grams: rare-first prefix filtering, verified once per pair.

A document is the set of its distinct n-word shingles (fewer words: all of them as one).
Two link when 100 * |intersection| >= 80 * |union|.  The result is one row per document
with the component it belongs to under these links.

* **Classes.**  Documents with equal sets form a class, named by a 128-bit digest of the
  set; from there on a class is one node, however many copies it has.
* **Rare first.**  A table of hashed shingle counts over all documents orders shingles from
  rare to frequent (ties by hash).  The table has a fixed size; collisions change the
  order, and so the speed, but every order is one for all documents and gives right results.
* **Prefix.**  Of a set of n, the first n - ceil(0.8 n) + 1 shingles are posted: two sets that
  link share one of these.  The length filter compares sizes, the positional filter what
  the two places leave for common shingles, the suffix filter how the sets are spread over
  ``CELLS`` ranges of hashes; all bound the intersection from above and drop no link.
* **Stars, then the rest.**  Pairs within a posting list are quadratic in its length, and
  a component needs no pair of nodes that it has joined already.  So each list first
  compares its members with ``STARS`` of them, and components are contracted; only then
  are the pairs of each list formed whose nodes are still in different components.  No
  list is cut.
* **Verification.**  A candidate pair is kept once and its full sets are intersected exactly.

Links, components and sets stay in Spark; each round writes its tables to the shared
folder, so a lost executor costs no earlier round.

Defined cases: documents without words, null ones included, have no shingles and are alone
in their component; rows that repeat an id are documents each, and components are named by
the smallest id among their rows (null ids are not named); an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passagemill.llm.common import cut_lineage, slices, text_bytes, to_list_array
from passagemill.llm.shingles import shingle_hashes, word_hashes

SHINGLE, NUMERATOR, DENOMINATOR = 5, 80, 100
#: Cells of the count table that orders shingles, and ranges of the suffix filter.
COUNT_BITS, CELLS = 20, 128
#: Centres with which the members of a posting list are compared first.
STARS = 3
#: Members of a slice of a long posting list, about, where all pairs of a list are wanted.
SLICE = 512
#: Bits of the map by which ids are found in a scan.
FILTER_BITS = 26
_CHUNK_BITS = 16


def shingle_sets(raws: list[bytes], n: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingles of each text."""
    words, lengths = word_hashes(raws)
    flat = shingle_hashes(words, n)
    out, start = [], 0
    for length in lengths.tolist():
        if length >= n:
            own = np.sort(flat[start : start + length - n + 1])
            fresh = own[1:] != own[:-1]
            out.append(own if fresh.all() else own[np.concatenate([[True], fresh])])
        elif length:
            out.append(shingle_hashes(words[start : start + length], length))
        else:
            out.append(flat[:0])
        start += length
    return out


def digest(shingles: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(shingles.tobytes()) if len(shingles) else None


def _cells(shingles: np.ndarray) -> np.ndarray:
    return np.bincount((shingles >> np.uint64(57)).astype(np.int64), minlength=CELLS)


def _keys(docs: DataFrame, id_column: str, text: str) -> DataFrame:
    """(id, n, node, cells) of every row, and the task's shingle counts as further rows (part, counts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << COUNT_BITS, dtype=np.uint32)
        low = np.uint64((1 << COUNT_BITS) - 1)

        def rows(ids, n, node, cells, part, packed):
            return pa.record_batch([
                ids, pa.array(n, pa.int64()), pa.array(node, pa.binary()), pa.array(cells, pa.list_(pa.int32())),
                pa.array(part, pa.int32()), pa.array(packed, pa.binary()),
            ], ["id", "n", "node", "cells", "part", "counts"])

        for part in slices(batches, text):
            sets = shingle_sets(text_bytes(part.column(text)))
            counts += np.bincount((np.concatenate(sets) & low).astype(np.int64), minlength=len(counts)).astype(np.uint32)
            none = [None] * len(sets)
            cells = [_cells(s) if len(s) else None for s in sets]
            yield rows(part.column(id_column), [len(s) for s in sets], [digest(s) for s in sets], cells, none, none)
        chunks = [(i, c) for i, c in enumerate(counts.reshape(-1, 1 << _CHUNK_BITS)) if c.any()]
        none = [None] * len(chunks)
        packed = [zlib.compress(c.astype("<u4").tobytes(), 1) for _, c in chunks]
        yield rows(pa.array(none, pa.int64()), none, none, none, [i for i, _ in chunks], packed)

    rows = docs.select(F.col(id_column).cast("bigint").alias(id_column), F.col(text).cast("string").alias(text))
    return rows.mapInArrow(run, "id bigint, n bigint, node binary, cells array<int>, part int, counts binary")


def _order_table(keys: DataFrame) -> np.ndarray:
    """Shingle counts by cell, summed over all tasks by chunks of the table."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, packed in zip(batch.column("part").to_pylist(), batch.column("counts")):
                counts = np.frombuffer(zlib.decompress(packed.as_py()), dtype="<u4")
                total[part] = total[part] + counts if part in total else counts.astype(np.int64)
        yield pa.record_batch([
            pa.array(list(total), pa.int32()), pa.array([zlib.compress(c.tobytes(), 1) for c in total.values()], pa.binary())
        ], ["part", "counts"])

    parts = 1 << (COUNT_BITS - _CHUNK_BITS)
    summed = keys.where("part is not null").select("part", "counts").repartition(parts, "part").mapInArrow(add, "part int, counts binary")
    table = np.zeros((parts, 1 << _CHUNK_BITS), dtype=np.int64)
    for part, packed in summed.collect():  # the table has a fixed size
        table[part] = np.frombuffer(zlib.decompress(packed), dtype=np.int64)
    return np.minimum(table.ravel(), np.iinfo(np.uint32).max).astype(np.uint32)


def prefix_length(n: int) -> int:
    """How many shingles of a set of ``n`` must be posted: all but ceil(0.8 n) - 1."""
    return n - -(-NUMERATOR * n // DENOMINATOR) + 1


def _postings(docs: DataFrame, counts: np.ndarray, text: str) -> DataFrame:
    """(shingle, node, size, place): the rare-first prefix of each set, once per task and node."""
    shared = docs.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, seen = np.uint64((1 << COUNT_BITS) - 1), set()
        for part in slices(batches, text):
            prefixes, nodes, sizes = [], [], []
            for own in shingle_sets(text_bytes(part.column(text))):
                node = digest(own)
                if node is None or node in seen:
                    continue
                seen.add(node)
                p = prefix_length(len(own))
                rarity = shared.value[(own & low).astype(np.int64)]
                if p < len(own):  # sets are sorted by hash, so a stable sort settles ties
                    own = own[np.argsort(rarity, kind="stable")[:p]]
                prefixes.append(own[:p])
                nodes.append(node)
                sizes.append(len(rarity))
            lengths = np.array([len(p) for p in prefixes], dtype=np.int64)
            if not len(lengths):
                continue
            place = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            node = pa.array(nodes, pa.binary()).take(pa.array(np.repeat(np.arange(len(nodes)), lengths)))
            yield pa.record_batch([
                pa.array(np.concatenate(prefixes).view(np.int64)), node, pa.array(np.repeat(np.array(sizes, dtype=np.int32), lengths)),
                pa.array(place.astype(np.int32)),
            ], ["shingle", "node", "size", "place"])

    rows = docs.select(F.col(text).cast("string").alias(text))
    return rows.mapInArrow(run, "shingle bigint, node binary, size int, place int")


def _shared_postings(postings: DataFrame) -> DataFrame:
    """Postings of shingles that more than one node has, each node once."""
    each = Window.partitionBy("shingle").orderBy("node")
    every = Window.partitionBy("shingle")
    marked = postings.withColumn("before", F.lag("node").over(each)).withColumn(
        "many", F.min("node").over(every) != F.max("node").over(every)
    )
    return marked.where(F.col("many") & (F.col("before").isNull() | (F.col("before") != F.col("node")))).drop("before", "many")


def _bitmap(ids: DataFrame) -> np.ndarray:
    """A bit per hash of the ids, of fixed size."""
    place = F.pmod(F.xxhash64("id"), F.lit(1 << FILTER_BITS)) + 1
    parts = ids.select(place.alias("h")).groupBy(F.bitmap_bucket_number("h").alias("bucket"))
    bits = np.zeros((1 << FILTER_BITS) // 8, dtype=np.uint8)
    for bucket, part in parts.agg(F.bitmap_construct_agg(F.bitmap_bit_position("h"))).collect():
        bits[(bucket - 1) * 4096 : bucket * 4096] = np.frombuffer(part, dtype=np.uint8)
    return bits


def _sets(docs: DataFrame, wanted: DataFrame, id_column: str, text: str) -> DataFrame:
    """(node, shingles) of the wanted (id, node) rows, and perhaps of some that are not wanted.

    The ids pass through a bitmap of fixed size, so that the texts need not be shuffled to
    find some of them; what it lets through besides is never asked for."""
    shared = docs.sparkSession.sparkContext.broadcast(_bitmap(wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            h = batch.column("h").to_numpy()
            chosen = batch.filter(pa.array((shared.value[h >> 3] >> (h & 7).astype(np.uint8)) & 1 == 1))
            for part in slices(iter([chosen]), text):
                sets = [(digest(s), s) for s in shingle_sets(text_bytes(part.column(text)))]
                sets = list({d: s for d, s in sets if d is not None and d not in seen}.items())
                seen.update(d for d, _ in sets)
                if sets:
                    shingles = to_list_array(np.concatenate([s for _, s in sets]).view(np.int64), np.array([len(s) for _, s in sets]))
                    yield pa.record_batch([pa.array([d for d, _ in sets], pa.binary()), shingles], ["node", "shingles"])

    rows = docs.select(F.col(id_column).cast("bigint").alias("id"), F.col(text).cast("string").alias(text))
    rows = rows.select(F.pmod(F.xxhash64("id"), F.lit(1 << FILTER_BITS)).alias("h"), text)
    made = cut_lineage(rows.mapInArrow(run, "node binary, shingles array<bigint>"))
    # A node can come from several tasks if rows repeat an id.
    repeated = not made.groupBy("node").count().where("count > 1").isEmpty()
    return made.dropDuplicates(["node"]) if repeated else made


def _least_overlap(a: Column, b: Column) -> Column:
    """The intersection that sets of these sizes need."""
    return F.ceil((a.cast("bigint") + b) * NUMERATOR / F.lit(float(NUMERATOR + DENOMINATOR)))


def _may_link(size_a: Column, size_b: Column, place_a: Column, place_b: Column) -> Column:
    """Length and positional filter for a shingle that both have at these places.

    The pair is found at each prefix shingle that both have, and one time is enough: taken as
    the first, it leaves no more common shingles than follow it in the shorter rest.  Where
    that is too few, the pair does not link or is found at the shingle that is the first."""
    length = F.least(size_a, size_b).cast("bigint") * DENOMINATOR >= F.greatest(size_a, size_b).cast("bigint") * NUMERATOR
    at_most = F.least(size_a - place_a, size_b - place_b)
    return length & (at_most >= _least_overlap(size_a, size_b))


def _spread_alike(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Suffix filter: the (a, b) pairs whose sets are spread over the ranges so that they may link."""
    left = nodes.select(F.col("node").alias("a"), F.col("cells").alias("ca"))
    right = nodes.select(F.col("node").alias("b"), F.col("cells").alias("cb"))
    total = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda s, x: s + x)
    common = total(F.zip_with("ca", "cb", lambda x, y: F.least(x, y)))
    joined = pairs.join(left, "a").join(right, "b")
    return joined.where(common >= _least_overlap(total(F.col("ca")), total(F.col("cb")))).select("a", "b")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The (a, b) pairs that link, by their whole sets."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    joined = pairs.join(left, "a").join(right, "b")
    return joined.where(DENOMINATOR * both >= NUMERATOR * (F.size("sa") + F.size("sb") - both)).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node reachable over the (a, b) edges, for nodes that have one.

    Labels spread to neighbours and are then followed one step, until none changes; each
    round is written, so its plan does not grow."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = cut_lineage(both)
    state = cut_lineage(both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("node"), F.least("a", "least").alias("label")))
    while True:
        told = both.join(state.withColumnRenamed("node", "a"), "a").groupBy("b").agg(F.min("label").alias("told"))
        heard = state.join(told.withColumnRenamed("b", "node"), "node").select("node", "label", F.least("label", "told").alias("new"))
        ahead = heard.select(F.col("node").alias("new"), F.col("new").alias("next"))
        step = cut_lineage(heard.join(ahead, "new").select("node", "label", F.least("new", "next").alias("new")))
        state = step.select("node", F.col("new").alias("label"))
        if step.where("label != new").isEmpty():
            return state


def _relabel(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """Labels after more (node, node) links are taken in."""
    if labels is None:
        return components(links)
    old = labels.select(F.col("node").alias("a"), F.col("label").alias("b")).where("a != b")
    return components(links.unionByName(old))


def _labelled(postings: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Postings with the component of their node; lists of one component are done and go."""
    if labels is None:
        return postings.withColumn("label", F.col("node"))
    rows = postings.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    every = Window.partitionBy("shingle")
    return rows.withColumn("open", F.min("label").over(every) != F.max("label").over(every)).where("open").drop("open")


def _star_pairs(postings: DataFrame) -> DataFrame:
    """Each node of a list with the list's centres: the nodes that share most of their prefix.

    Near copies of one text each have rare shingles of their own in their prefix, which the
    text itself has not; so it shares more than they do and is the centre that joins them."""
    shared = postings.groupBy("node").agg(F.count("*").alias("shared"), F.first("size").alias("of"))
    ranked = postings.join(shared.select("node", (F.col("shared") / F.col("of")).alias("share")), "node")
    order = Window.partitionBy("shingle").orderBy(F.desc("share"), F.xxhash64("node"), "node")
    until = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    here = F.struct("node", "size", "place")
    starred = ranked.select("*", F.array(*(F.nth_value(here, k + 1).over(until) for k in range(STARS))).alias("centres"))
    starred = starred.select("node", "size", "place", F.explode("centres").alias("c")).where("c is not null and node != c.node")
    starred = starred.where(_may_link(F.col("size"), F.col("c.size"), F.col("place"), F.col("c.place")))
    return _pairs(starred.select(F.col("node").alias("x"), F.col("c.node").alias("y")))


def _rest_pairs(rows: DataFrame) -> DataFrame:
    """The pairs of each list whose nodes are still in different components."""
    left, right = rows.alias("l"), rows.alias("r")
    join = left.join(
        right,
        (F.col("l.shingle") == F.col("r.shingle")) & (F.col("l.label") < F.col("r.label"))
        & _may_link(F.col("l.size"), F.col("r.size"), F.col("l.place"), F.col("r.place")),
    )
    return _pairs(join.select(F.col("l.node").alias("x"), F.col("r.node").alias("y")))


def _every_pair(postings: DataFrame) -> DataFrame:
    """All pairs of each list.  A long list is cut into slices by node; any two of them, and each with
    itself, meet under a key of their own, so no key has more than about two slices."""
    parts = postings.groupBy("shingle").agg(F.ceil(F.count("*") / F.lit(SLICE)).cast("int").alias("parts"))
    rows = postings.join(parts, "shingle").withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    left = rows.withColumn("other", F.explode(F.sequence(F.col("own"), F.col("parts") - 1))).alias("l")
    right = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("own")))).alias("r")
    join = left.join(
        right,
        (F.col("l.shingle") == F.col("r.shingle")) & (F.col("l.own") == F.col("r.other")) & (F.col("l.other") == F.col("r.own"))
        & ((F.col("l.own") < F.col("r.own")) | (F.col("l.node") < F.col("r.node")))
        & _may_link(F.col("l.size"), F.col("r.size"), F.col("l.place"), F.col("r.place")),
    )
    return _pairs(join.select(F.col("l.node").alias("x"), F.col("r.node").alias("y")))


def _pairs(df: DataFrame) -> DataFrame:
    return df.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def join(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) of every row."""
    keys = cut_lineage(_keys(docs, id_column, text))
    rows = keys.where("part is null").select("id", "n", "node", "cells")
    postings = cut_lineage(_shared_postings(_postings(docs, _order_table(keys), text)))
    classes = rows.where("node is not null").groupBy("node").agg(F.min("id").alias("id"))
    posted = postings.select("node").distinct()
    nodes = rows.join(posted, "node", "left_semi").groupBy("node").agg(F.min("id").alias("id"), F.first("cells").alias("cells"))
    nodes = cut_lineage(nodes)

    def links_among(pairs: DataFrame) -> DataFrame:
        """Each candidate pair kept once, filtered and verified."""
        pairs = cut_lineage(_spread_alike(pairs.distinct(), nodes))
        used = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        return cut_lineage(_verified(pairs, _sets(docs, nodes.join(used, "node", "left_semi"), id_column, text)))

    links = links_among(_star_pairs(postings))
    labels = None if links.isEmpty() else components(links)
    links = links_among(_rest_pairs(_labelled(postings, labels)))
    if not links.isEmpty():
        labels = _relabel(labels, links)
    named = rows.select("id", "n", "node")
    if labels is None:
        named = named.join(classes.select("node", F.col("id").alias("least")), "node", "left")
    else:
        group = classes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        least = group.groupBy("label").agg(F.min("id").alias("least"))
        named = named.join(group.join(least, "label").select("node", "least"), "node", "left")
    return named.select(F.col("id").alias(id_column), F.col("n").alias("n_shingles"), F.coalesce("least", "id").alias("component_id"))


def linked(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(id, n_shingles, class, n_links) of every row and (a, b), a < b, of all classes that link.

    ``class`` is the digest of a row's set in hexadecimal, null without words; ``n_links`` is the
    number of classes that its class links with.  Unlike ``join`` this compares all candidates,
    also those that a component has joined already, and so can grow with the square of a group."""
    keys = cut_lineage(_keys(docs, id_column, text))
    rows = keys.where("part is null").select("id", "n", "node", "cells")
    postings = cut_lineage(_shared_postings(_postings(docs, _order_table(keys), text)))
    posted = postings.select("node").distinct()
    nodes = rows.join(posted, "node", "left_semi").groupBy("node").agg(F.min("id").alias("id"), F.first("cells").alias("cells"))
    nodes = cut_lineage(nodes)
    pairs = cut_lineage(_spread_alike(_every_pair(postings).distinct(), nodes))
    used = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    links = cut_lineage(_verified(pairs, _sets(docs, nodes.join(used, "node", "left_semi"), id_column, text)))
    counts = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links"))
    members = rows.join(counts, "node", "left").select(
        F.col("id").alias(id_column), F.col("n").alias("n_shingles"), F.lower(F.hex("node")).alias("class"), F.coalesce("n_links", F.lit(0)).alias("n_links")
    )
    return members, links.select(F.lower(F.hex("a")).alias("a"), F.lower(F.hex("b")).alias("b"))


def keep_one(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows, with all their columns, of one document of each component: that with the
    smallest id, and of rows that repeat it the first.  Documents without words all stay."""
    own = "_row"  # a name that no column of the documents has
    while own.lower() in {c.lower() for c in docs.columns}:
        own += "_"
    numbered = cut_lineage(docs.withColumn(own, F.monotonically_increasing_id()))
    found = join(numbered, own, text)
    firsts = found.join(numbered.select(own, F.col(id_column).alias("_id")), own)
    # The smallest id of a component, nulls last; equal ones by their row.
    chosen = firsts.groupBy("component_id").agg(F.min(F.struct(F.col("_id").isNull(), "_id", F.col(own).alias("at"))).alias("first"))
    return numbered.join(chosen.select(F.col("first.at").alias(own)), own, "left_semi").drop(own)
