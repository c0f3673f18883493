"""Sampled segmentations over a piece vocabulary, and their lossless decoding.

Every text is a lattice whose nodes are the places between characters and whose edges
are pieces.  Forward filtering sums, from the left, the weight of all segmentations of
each prefix; backward sampling then walks from the end and draws each piece in
proportion to the segmentations that end with it.  Draws are a hash of the row's key
and the place in the text, so a row always gets the same segmentation, on any
partitioning and after any retry.

A piece weighs ``-sharpness * ln(rank + 2)`` for its rank among the vocabulary's scores.
As no piece goes on over a blank or a line end that follows other characters, the lattice
falls into chunks; equal chunks of a slice are filtered once and all are sampled
together in numpy.  A character that no piece covers, and a literal U+2581, is written as
the byte pieces of its UTF-8 form, which makes decoding exact for any text.

Defined cases: a null text gives null pieces and decodes to null; an empty one gives
none; a null key is the key 0; equal keys with equal texts give equal results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagemill.llm.common import mix64, slices, to_list_array

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SHARPNESS = 2.0
#: The sign that stands for a blank inside pieces, and what stands for a literal one in a
#: task: half a surrogate pair, which no text can hold.
BLANK, LITERAL = "\u2581", "\ud800"
_CHUNK = re.compile(f"{BLANK}+[^{BLANK}\n{LITERAL}]*|[^{BLANK}\n{LITERAL}]+|[\n{LITERAL}]")
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_SPREAD = np.uint64(0xD6E8FEB86659FD93)
_TABLE_BITS = 20
_CELLS = 200_000
#: Bytes of text per slice: bounds the lattice held at a time.
SLICE = 4 << 20


class Pieces:
    """The vocabulary in arrays: hashed pieces for lookups, bytes for decoding."""

    def __init__(self, model: bytes, sharpness: float):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(n)]
        normal = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        order = sorted(normal, key=lambda i: -sp.get_score(i))
        self.byte_id = np.zeros(256, dtype=np.int32)
        self.decoded: list[bytes] = []
        for i, name in enumerate(names):
            if sp.is_byte(i):
                self.byte_id[int(name[3:5], 16)] = i
                self.decoded.append(bytes([int(name[3:5], 16)]))
            else:
                self.decoded.append(b"" if sp.is_control(i) or sp.is_unknown(i) else name.replace(BLANK, " ").encode())
        self.weight = np.full(n + 1, -np.inf)
        self.weight[order] = -sharpness * np.log(np.arange(len(order)) + 2.0)
        self.fallback = -sharpness * np.log(n + 2.0) * 4
        self.longest = max(len(names[i]) for i in normal)
        self.powers = np.array([pow(int(_PRIME), k, 1 << 64) for k in range(self.longest + 1)], dtype=np.uint64)
        codes = [np.frombuffer(names[i].encode("utf-32-le"), dtype=np.uint32) for i in normal]
        hashes = np.array([self._hash(c) for c in codes], dtype=np.uint64)
        assert len(set(hashes.tolist())) == len(hashes)
        slot = ((hashes * _SPREAD) >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)
        # What collides in one table goes to the next.
        self.tables = []
        left = np.arange(len(normal))
        while len(left):
            table = np.full(1 << _TABLE_BITS, -1, dtype=np.int32)
            table[slot[left][::-1]] = left[::-1]
            self.tables.append(table)
            left = left[table[slot[left]] != left]
        self.hashes, self.ids = hashes, np.array(normal, dtype=np.int32)

    def _hash(self, codes: np.ndarray) -> int:
        h = np.uint64(len(codes))
        with np.errstate(over="ignore"):
            for c in codes:
                h = h * _PRIME + np.uint64(c) + np.uint64(1)
        return int(h)

    def lookup(self, hashes: np.ndarray) -> np.ndarray:
        """Piece ids of substring hashes; -1 where there is none."""
        slot = ((hashes * _SPREAD) >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)
        found = np.full(len(hashes), -1, dtype=np.int32)
        for table in self.tables:
            entry = table[slot]
            some = np.flatnonzero(entry >= 0)
            some = some[self.hashes[entry[some]] == hashes[some]]
            found[some] = self.ids[entry[some]]
        return found

    def lattice(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For rows of equal padded length: per end and piece length, the share of the weight
        (cumulated over lengths) and the piece id (-1: byte pieces).  Padding is code 0."""
        n, width = codes.shape
        most = min(self.longest, width)
        # Log weights of short chunks are small enough for single precision.
        real = np.float32 if width <= 64 else np.float64
        weight = self.weight.astype(real)
        score = np.full((n, width, most), -np.inf, dtype=real)
        ids = np.full((n, width, most), -1, dtype=np.int32)
        shifted = codes.astype(np.uint64) + np.uint64(1)
        rolling = np.zeros_like(shifted)
        with np.errstate(over="ignore"):
            for k in range(1, most + 1):
                # rolling[:, i] is the hash of the k codes that start at i, without the length.
                rolling = rolling[:, : width - k + 1] * _PRIME + shifted[:, k - 1 :]
                at = self.lookup((rolling + np.uint64(k) * self.powers[k]).ravel()).reshape(rolling.shape)
                ids[:, k - 1 :, k - 1] = at
                score[:, k - 1 :, k - 1] = weight[at]  # [-1] is -inf
        uncovered = ids[:, :, 0] < 0
        score[:, :, 0][uncovered] = self.fallback
        before = np.full((n, width + most), -np.inf, dtype=real)  # column most + t: the weight of the first t codes
        before[:, most] = 0.0
        share = np.empty((n, width, most), dtype=np.float32)
        for t in range(width):
            each = before[:, t + 1 : most + t + 1][:, ::-1] + score[:, t, :]
            top = each.max(axis=1, keepdims=True)
            part = np.cumsum(np.exp((each - top).astype(np.float32, copy=False)), axis=1)
            total = part[:, -1:]
            if t + 1 < width:
                before[:, most + t + 1] = (top + np.log(total))[:, 0]
            share[:, t, :] = part / total
        return share, ids


@lru_cache(maxsize=2)
def pieces(model: bytes, sharpness: float) -> Pieces:
    return Pieces(model, sharpness)


class _Numbers(dict):
    def __missing__(self, key):
        self[key] = n = len(self)
        return n


def sample(vocabulary: Pieces, texts: list[str], seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of all texts one after the other, and how many belong to each."""
    numbers = _Numbers()
    chunk_of: list[int] = []
    chunks_in = np.zeros(len(texts), dtype=np.int64)
    for i, text in enumerate(texts):
        if text:
            found = _CHUNK.findall((" " + text).replace(BLANK, LITERAL).replace(" ", BLANK))
            chunk_of.extend(map(numbers.__getitem__, found))
            chunks_in[i] = len(found)
    if not chunk_of:
        return np.zeros(0, dtype=np.int32), np.zeros(len(texts), dtype=np.int64)
    chunk = np.array(chunk_of, dtype=np.int64)
    del chunk_of
    names = list(numbers)
    length = np.array(list(map(len, names)), dtype=np.int64)
    first = np.concatenate([[0], np.cumsum(length)])  # where a distinct chunk's codes begin
    codes = np.frombuffer("".join(names).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    row = np.repeat(np.arange(len(texts)), chunks_in)
    begin = np.concatenate([[0], np.cumsum(length[chunk])[:-1]])  # place in the slice ...
    row_begin = np.concatenate([[0], np.cumsum(np.bincount(row, weights=length[chunk], minlength=len(texts)).astype(np.int64))[:-1]])
    begin = begin - row_begin[row]  # ... and in the row's own text
    seed = seeds[row]

    # Distinct chunks of about one length are filtered together, so many at a time that they stay in cache.
    groups: list[np.ndarray] = []
    width_class = np.where(length <= 6, 6, np.where(length <= 10, 10, 2 ** np.ceil(np.log2(np.maximum(length, 11))).astype(np.int64)))
    for width in np.unique(width_class).tolist():
        members = np.flatnonzero(width_class == width)
        step = max(1, _CELLS // (width * min(width, vocabulary.longest)))
        groups += [members[lo : lo + step] for lo in range(0, len(members), step)]
    group_of, local_of = np.empty(len(names), dtype=np.int64), np.empty(len(names), dtype=np.int64)
    for g, members in enumerate(groups):
        group_of[members], local_of[members] = g, np.arange(len(members))
    groups_at = group_of[chunk].astype(np.uint16 if len(groups) < 1 << 16 else np.int64)  # short integers sort by radix
    by_group = np.argsort(groups_at, kind="stable")
    bounds = np.searchsorted(groups_at[by_group], np.arange(len(groups) + 1))

    out_chunk, out_step, out_id, out_code = [], [], [], []
    for g, members in enumerate(groups):
        widest = int(length[members].max())
        padded = np.zeros((len(members), widest), dtype=np.uint32)
        padded[np.arange(widest) < length[members][:, None]] = codes[_ranges(first[members], length[members])]
        share, ids = vocabulary.lattice(padded)
        most = share.shape[2]
        share, ids = share.reshape(-1, most), ids.reshape(-1, most)
        here = by_group[bounds[g] : bounds[g + 1]]
        local = local_of[chunk[here]]
        at = length[chunk[here]]
        k = 0
        while len(here):
            cell = local * widest + at - 1
            draw = mix64(seed[here] ^ mix64((begin[here] + at).astype(np.uint64) * _PRIME))
            u = (draw >> np.uint64(40)).astype(np.float32) * np.float32(2.0**-24)
            take = np.minimum((share.take(cell, axis=0) <= u[:, None]).sum(axis=1), most - 1)
            got = ids[cell, take]
            out_chunk.append(here), out_step.append(np.full(len(here), k)), out_id.append(got)
            out_code.append(np.where(got < 0, padded[local, at - 1], 0))
            at = at - take - 1
            on = np.flatnonzero(at > 0)
            here, local, at = here[on], local[on], at[on]
            k += 1
    chunk_at, step_at = np.concatenate(out_chunk), np.concatenate(out_step)
    # Steps run from the end of a chunk: put pieces in reading order.
    per_chunk = np.bincount(chunk_at, minlength=len(chunk))
    place = np.cumsum(per_chunk)[chunk_at] - 1 - step_at
    piece, code = np.empty(len(place), dtype=np.int32), np.empty(len(place), dtype=np.uint32)
    piece[place], code[place] = np.concatenate(out_id), np.concatenate(out_code)
    chunk_at = np.repeat(np.arange(len(chunk)), per_chunk)
    row_at = row[chunk_at]
    spelled = np.flatnonzero(piece < 0)
    if not len(spelled):
        return piece, np.bincount(row_at, minlength=len(texts))
    bytes_of = [(BLANK if c == ord(LITERAL) else chr(c)).encode() for c in code[spelled].tolist()]
    repeat = np.ones(len(piece), dtype=np.int64)
    repeat[spelled] = [len(b) for b in bytes_of]
    out = np.repeat(piece, repeat)
    out[np.repeat(piece < 0, repeat)] = vocabulary.byte_id[np.frombuffer(b"".join(bytes_of), dtype=np.uint8)]
    return out, np.bincount(np.repeat(row_at, repeat), minlength=len(texts))


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of the given lengths, one range after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths - starts, lengths)


def decode_ids(vocabulary: Pieces, ids: list[int]) -> str:
    """The text of a segmentation: the pieces' bytes without the blank put in front."""
    return b"".join(map(vocabulary.decoded.__getitem__, ids)).decode("utf-8", "replace")[1:]


def encode(
    docs: DataFrame, key: str = "doc_id", text: str = "text", model: str = MODEL, sharpness: float = SHARPNESS,
) -> DataFrame:
    """(key, n_pieces, n_bytes, pieces): a sampled segmentation per row; ``n_bytes`` are byte pieces."""
    with open(model, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = pieces(shared.value, sharpness)
        is_byte = np.zeros(len(vocabulary.decoded), dtype=bool)
        is_byte[vocabulary.byte_id] = True
        for part in slices(batches, text, SLICE):
            texts = part.column(text).to_pylist()
            seeds = part.column("_seed").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            ids, counts = sample(vocabulary, ["" if t is None else t for t in texts], seeds)
            counts = counts.astype(np.int64)
            ends = np.concatenate([[0], np.cumsum(counts)])
            spelled = np.concatenate([[0], np.cumsum(is_byte[ids])])
            lists = to_list_array(ids.astype(np.int32), counts)
            null = part.column(text).is_null()
            yield pa.record_batch([
                part.column(key), pa.array(counts), pa.array(spelled[ends[1:]] - spelled[ends[:-1]]),
                pa.compute.if_else(null, pa.scalar(None, lists.type), lists),
            ], [key, "n_pieces", "n_bytes", "pieces"])

    rows = docs.select(F.col(key), F.col(text).cast("string").alias(text))
    rows = rows.withColumn("_seed", F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit("0"))))
    kind = rows.schema[key].dataType.simpleString()
    return rows.mapInArrow(run, f"`{key}` {kind}, n_pieces bigint, n_bytes bigint, pieces array<int>")


def decode(encoded: DataFrame, key: str = "doc_id", column: str = "pieces", model: str = MODEL) -> DataFrame:
    """(key, text): the exact text of each row of pieces."""
    with open(model, "rb") as f:
        shared = encoded.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = pieces(shared.value, SHARPNESS)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                texts = [None if ids is None else decode_ids(vocabulary, ids) for ids in part.column(column).to_pylist()]
                yield pa.record_batch([part.column(key), pa.array(texts, pa.string())], [key, "text"])

    kind = encoded.schema[key].dataType.simpleString()
    return encoded.select(key, column).mapInArrow(run, f"`{key}` {kind}, text string")


def round_trip(
    docs: DataFrame, key: str = "doc_id", text: str = "text", model: str = MODEL, sharpness: float = SHARPNESS,
    carry: tuple[str, ...] = (), slice_bytes: int = SLICE,
) -> DataFrame:
    """``encode`` with the columns ``carry`` of the input and a column ``lossless``: whether
    decoding the pieces gives the text back.  Smaller slices take less memory and, as fewer
    equal chunks meet in one, more time; the pieces are the same."""
    with open(model, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = pieces(shared.value, sharpness)
        for part in slices(batches, text, slice_bytes):
            texts = part.column(text).to_pylist()
            seeds = part.column("_seed").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            ids, counts = sample(vocabulary, ["" if t is None else t for t in texts], seeds)
            counts = counts.astype(np.int64)
            ends = np.cumsum(counts).tolist()
            same, start = [], 0
            for t, end in zip(texts, ends):
                same.append(t is None or decode_ids(vocabulary, ids[start:end].tolist()) == t)
                start = end
            lists = to_list_array(ids.astype(np.int32), counts)
            lists = pa.compute.if_else(part.column(text).is_null(), pa.scalar(None, lists.type), lists)
            yield pa.record_batch(
                [part.column(c) for c in (key, *carry)] + [pa.array(counts), lists, pa.array(same, pa.bool_())],
                [key, *carry, "n_pieces", "pieces", "lossless"],
            )

    rows = docs.select(key, *carry, F.col(text).cast("string").alias(text))
    rows = rows.withColumn("_seed", F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit("0"))))
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in (key, *carry))
    return rows.mapInArrow(run, f"{kinds}, n_pieces bigint, pieces array<int>, lossless boolean")
