"""Benchmark decontamination by SimHash fingerprints of item-sized windows.

Words are ASCII-lower-cased runs without white space; a shingle is five of them.  An item
matches a document where a window of as many words as the item has a weighted shingle
similarity of 0.8 or more with it: the sum of the smaller counts over the sum of the
larger ones.

1. A window that reaches the threshold shares at least 80 % of the item's shingles, so only
   windows in which that many shingles belong to some item can match; they are found by a
   lookup of every shingle of every document and running sums.  All other windows have
   been ruled out exactly and need no fingerprint.
2. The windows left get a SimHash of 64 bits, each shingle counted as often as it occurs.
3. Fingerprints are cut into blocks; two within ``RADIUS`` bits differ by at most
   ``RADIUS // BLOCKS`` in some block.  A table per block leads from each value to the
   items within that distance, so every item within the radius is found.
4. Candidates are verified by the exact similarity.

The benchmark is the side that every task holds; its size is checked against ``MOST_ITEM_WORDS``.

Defined cases: items of fewer than five words, null ones included, hold no shingle and
match nothing; so do null and empty documents; a document shorter than an item is one
window; repeated rows are matched each; of equally similar windows the first is reported.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagemill.llm.common import slices, text_bytes
from passagemill.llm.shingles import shingle_hashes, word_hashes

SHINGLE, NUMERATOR, DENOMINATOR = 5, 80, 100
RADIUS, BLOCKS, BLOCK_BITS = 20, 4, 16
#: Most words of all benchmark items together; more are refused rather than sent to every task.
MOST_ITEM_WORDS = 5_000_000
_FILTER_BITS = 20


def fingerprints(hashes: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """SimHash of each range of shingles: per bit whether most shingles have it (ties: not)."""
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    running = np.zeros((len(hashes) + 1, 64), dtype=np.int32)
    np.cumsum(bits, axis=0, dtype=np.int32, out=running[1:])
    ones = running[stops] - running[starts]
    return np.packbits(2 * ones > (stops - starts)[:, None], axis=1, bitorder="little").view("<u8")[:, 0]


@dataclass(frozen=True)
class Benchmark:
    ids: list
    words: np.ndarray  # words of each item
    counts: list[Counter]  # shingle -> how often
    prints: np.ndarray
    shingles: np.ndarray  # all, sorted
    size_bounds: np.ndarray  # per shingle: the word counts of the items that have it, as bounds and list
    size_list: np.ndarray
    tables: list[tuple[np.ndarray, np.ndarray]]  # per block: value -> items, as bounds and list
    maybe: np.ndarray  # bit per low bits of a shingle

    def near(self, fingerprint: int) -> list[int]:
        """Items within the radius of a fingerprint, by the block tables."""
        found: set[int] = set()
        for block, (bounds, items) in enumerate(self.tables):
            value = (fingerprint >> (BLOCK_BITS * block)) & ((1 << BLOCK_BITS) - 1)
            found.update(items[bounds[value] : bounds[value + 1]].tolist())
        return sorted(i for i in found if (fingerprint ^ int(self.prints[i])).bit_count() <= RADIUS)


def _neighbours(bits: int, radius: int) -> np.ndarray:
    """All values of so many bits that have at most ``radius`` of them set."""
    return np.array([sum(1 << b for b in chosen) for r in range(radius + 1) for chosen in combinations(range(bits), r)])


def prepare(items: list[tuple]) -> Benchmark:
    """The benchmark's shingles, fingerprints and block tables from (id, text) pairs."""
    ids, words, hashes = [], [], []
    for item_id, text in items:
        found, _ = word_hashes([(text or "").encode()])
        if len(found) >= SHINGLE:
            ids.append(item_id)
            words.append(len(found))
            hashes.append(shingle_hashes(found, SHINGLE))
    if sum(words) > MOST_ITEM_WORDS:
        raise ValueError(f"a benchmark of {sum(words)} words is too large to hold in every task; split it into runs")
    flat = np.concatenate(hashes) if hashes else np.zeros(0, dtype=np.uint64)
    lengths = np.array([len(h) for h in hashes], dtype=np.int64)
    stops = np.cumsum(lengths)
    prints = fingerprints(flat, stops - lengths, stops) if len(flat) else np.zeros(0, dtype=np.uint64)
    masks = _neighbours(BLOCK_BITS, RADIUS // BLOCKS)
    tables = []
    for block in range(BLOCKS):
        value = ((prints >> np.uint64(BLOCK_BITS * block)) & np.uint64((1 << BLOCK_BITS) - 1)).astype(np.int64)
        keys = (value[:, None] ^ masks[None, :]).ravel()
        order = np.argsort(keys, kind="stable")
        bounds = np.searchsorted(keys[order], np.arange((1 << BLOCK_BITS) + 1))
        tables.append((bounds.astype(np.int64), (order // len(masks)).astype(np.int32)))
    maybe = np.zeros(1 << _FILTER_BITS, dtype=bool)
    maybe[(flat & np.uint64((1 << _FILTER_BITS) - 1)).astype(np.int64)] = True
    pairs = sorted({(s, size) for h, size in zip(hashes, words) for s in h.tolist()})
    shingles = np.unique(flat)
    bounds = np.searchsorted(np.array([s for s, _ in pairs], dtype=np.uint64), shingles)
    return Benchmark(
        ids, np.array(words, dtype=np.int64), [Counter(h.tolist()) for h in hashes], prints, shingles,
        np.append(bounds, len(pairs)), np.array([size for _, size in pairs], dtype=np.int64), tables, maybe,
    )


def _similarity(a: Counter, b: Counter) -> tuple[int, int]:
    """Sum of the smaller and of the larger counts."""
    common = sum(min(n, b[s]) for s, n in a.items() if s in b)
    return common, sum(a.values()) + sum(b.values()) - common


def _windows(bench: Benchmark, n: int, at: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the item-sized windows over ``n`` shingles in which enough belong to items of
    that size; ``at`` are the places of benchmark shingles and ``place`` their numbers."""
    per = bench.size_bounds[place + 1] - bench.size_bounds[place]
    first = np.repeat(bench.size_bounds[place] - (np.cumsum(per) - per), per)
    sizes, where = bench.size_list[first + np.arange(len(first))], np.repeat(at, per)
    starts, stops = [], []
    for size in np.unique(sizes).tolist():
        span = min(size - SHINGLE + 1, n)
        least = -(-NUMERATOR * (size - SHINGLE + 1) // DENOMINATOR)
        own = where[sizes == size]
        if len(own) < least:
            continue
        # Only windows that begin within a span of one of these shingles hold any.
        begin = np.unique((own[:, None] - np.arange(span)).ravel())
        begin = begin[(begin >= 0) & (begin <= n - span)]
        held = np.searchsorted(own, begin + span) - np.searchsorted(own, begin)
        begin = begin[held >= least]
        starts.append(begin)
        stops.append(begin + span)
    none = np.zeros(0, dtype=np.int64)
    return np.concatenate([none, *starts]), np.concatenate([none, *stops])


def match_document(bench: Benchmark, hashes: np.ndarray, at: np.ndarray, place: np.ndarray) -> list[tuple]:
    """(item, start word, window words, distance, similarity): the best window of each item that matches."""
    n = len(hashes)
    starts, stops = _windows(bench, n, at, place)
    best: dict[int, tuple] = {}
    done: set[tuple[int, int]] = set()
    order = np.argsort(starts, kind="stable")
    starts, stops = starts[order], stops[order]
    lo = 0
    while lo < len(starts):
        # Fingerprints of windows that begin near each other share one table of running sums.
        hi = int(np.searchsorted(starts, starts[lo] + 4096))
        base = int(starts[lo])
        prints = fingerprints(hashes[base : int(stops[lo:hi].max())], starts[lo:hi] - base, stops[lo:hi] - base)
        for start, stop, fingerprint in zip(starts[lo:hi].tolist(), stops[lo:hi].tolist(), prints.tolist()):
            if (start, stop) in done:
                continue
            done.add((start, stop))
            window = None
            for item in bench.near(fingerprint):
                if stop - start != min(int(bench.words[item]) - SHINGLE + 1, n):
                    continue
                window = window or Counter(hashes[start:stop].tolist())
                common, union = _similarity(window, bench.counts[item])
                if DENOMINATOR * common >= NUMERATOR * union:
                    distance = (fingerprint ^ int(bench.prints[item])).bit_count()
                    row = (common / union, -start, item, start, stop - start + SHINGLE - 1, distance)
                    if item not in best or row[:2] > best[item][:2]:
                        best[item] = row
        lo = hi
    return [
        (bench.ids[item], start, words, distance, score)
        for score, _, item, start, words, distance in sorted(best.values(), key=lambda r: r[2])
    ]


def _leaks(bench: Benchmark, raws: list[bytes]) -> Iterator[tuple[int, list[tuple]]]:
    """(place in ``raws``, matches) of the texts that match something."""
    words, lengths = word_hashes(raws)
    flat = shingle_hashes(words, SHINGLE)
    if not len(flat) or not len(bench.ids):
        return
    at = np.flatnonzero(bench.maybe[(flat & np.uint64((1 << _FILTER_BITS) - 1)).astype(np.int64)])
    place = np.minimum(np.searchsorted(bench.shingles, flat[at]), len(bench.shingles) - 1)
    hit = bench.shingles[place] == flat[at]
    at, place = at[hit], place[hit]
    ends = np.cumsum(lengths)
    owner = np.searchsorted(ends, at, side="right")
    for i in np.unique(owner).tolist():
        start, stop = ends[i] - lengths[i], ends[i] - SHINGLE + 1
        # Shingles that run over the end of a text into the next are not its own.
        own = (owner == i) & (at < stop)
        if own.any() and (found := match_document(bench, flat[start:stop], at[own] - start, place[own])):
            yield i, found


def load_benchmark(benchmark: DataFrame, id_column: str = "item_id", text: str = "text") -> Benchmark:
    """Collect the items, after their size is checked, and prepare them."""
    rows = benchmark.select(F.col(id_column).cast("bigint"), F.col(text).cast("string").alias("text")).where("text is not null")
    volume = rows.agg(F.sum(F.length("text").cast("bigint"))).first()[0] or 0
    if volume > 16 * MOST_ITEM_WORDS:
        raise ValueError(f"a benchmark of {volume} characters is too large to hold in every task; split it into runs")
    return prepare(sorted((tuple(r) for r in rows.collect()), key=lambda r: (r[0] is None, r[0], r[1])))


def contaminated(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, item_id, start_word, n_words, distance, similarity): the best window of each item in each document."""
    shared = docs.sparkSession.sparkContext.broadcast(load_benchmark(benchmark))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text):
            rows = [(i, *match) for i, found in _leaks(shared.value, text_bytes(part.column(text))) for match in found]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
            column = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.record_batch(
                [part.column(id_column).take(column[0]), *column[1:]],
                [id_column, "item_id", "start_word", "n_words", "distance", "similarity"],
            )

    rows = docs.select(F.col(id_column), F.col(text).cast("string").alias(text))
    kind = rows.schema[id_column].dataType.simpleString()
    return rows.mapInArrow(
        run, f"`{id_column}` {kind}, item_id bigint, start_word bigint, n_words bigint, distance bigint, similarity double"
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows, with all their columns, that hold no passage of the benchmark."""
    shared = docs.sparkSession.sparkContext.broadcast(load_benchmark(benchmark))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text):
            keep = np.ones(part.num_rows, dtype=bool)
            keep[[i for i, _ in _leaks(shared.value, text_bytes(part.column(text)))]] = False
            yield part.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
