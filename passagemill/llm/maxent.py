"""Language-model scores by a hashed maximum-entropy model.

A token is predicted along a path of classes: a softmax over 16 classes given the history, one
over the 16 classes inside that given the history, and so on; the last factor is the token's
share of its leaf.  Weights belong to hashed features of the history (the word before, the one
before that, the two together, and a constant) in the class reached.  Frequent tokens have a
leaf of their own, placed by rank; the others take classes by how they end and a leaf by their
hash.  What the training texts do not hold has the share that Good and Turing give it, spread
over one token more than occur once, so an unseen token is as likely as in the base model; all
factors sum to one (over all leaves; a few hold no token), so a score is a log probability.

What is gathered grows with the input.  With V distinct training tokens a path has half as many
classes as V has hexadecimal digits (three at least), so there are at least ``sqrt(V)`` leaves and
half of them belong to single tokens; with N training tokens each of its softmaxes has about
``ROWS * N ** GROWTH`` rows.  A pass over the blocks works on softmaxes of ``PASS_BYTES``
together, or one, and that much is broadcast: 2 MB a softmax for 4 million tokens, 64 MB for
7 thousand millions.

1. ``encode``: each task turns its texts into blocks: numbers into a block's own
   vocabulary.  Texts are tokenised once; later steps read blocks.
2. Counts of tokens in the training fold are summed over all blocks, and each block gets
   the counts of its own vocabulary back by a join on the token.
3. ``train``: in each of ``ROUNDS`` rounds every task takes a part of the training blocks,
   makes AdaGrad steps from the weights so far, and the tasks' weights are averaged by how
   often each row was updated.  Tasks are so many that what they send stays a fixed part of
   the input.
4. ``score``: blocks are scored in batches of sparse feature rows.

Tokens are compared by 64-bit hashes.  Defined cases: a null or empty text is the end token
alone; null ids belong to no held-out fold; repeated rows count each; without a training
row nothing is known and both scores follow from counts of 0.
"""

from __future__ import annotations

import math
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from passagemill.llm.common import cut_lineage, mix64, scratch_path, slices, text_bytes
from passagemill.llm.shingles import word_hashes_and_tails
from passagemill.operators.topk import union_all

#: Tokens per block, about; a longer text is a block of its own.
BLOCK_TOKENS = 1_000_000
#: Classes inside a class, and bits of a class's number.
FAN, BITS = 16, 4
#: Rows of a softmax's table for N training tokens (rounded up to a power of two).
ROWS, GROWTH = 64, 0.4
#: Bytes of the tables that one pass over the blocks works on, or one table.
PASS_BYTES = 128 << 20
#: Training tokens a task must have for each row of the tables: bounds what tasks send.
TOKENS_A_ROW = 32
ROUNDS, BATCH, RATE = 2, 8192, 0.25
#: Counts are grouped by their logarithm in so many steps a doubling, to find the frequent tokens.
STEPS = 32
END = np.uint64(0)
#: Hashed features; besides them there is a constant, with rows of its own at the end of each table.
_FEATURES = 3
_SALTS = [np.uint64(x) for x in (0x8CB92BA72F3D8DD7, 0xABC98388FB8FAC03, 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)]


def tokenise(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token hashes of all texts with an end after each, each token's last bytes, and tokens per text."""
    words, counts, tails = word_hashes_and_tails(raws)
    words = np.where(words == END, np.uint64(1), words)
    ends = np.cumsum(counts)
    return np.insert(words, ends, END), np.insert(tails, ends, np.uint16(0)), counts + 1


@dataclass(frozen=True)
class Facts:
    """What is known about the training tokens besides each one's count."""

    tokens: int  # N
    distinct: int  # V
    single: int  # tokens that occur once
    own: np.ndarray  # the frequent tokens, in order of their hashes
    own_leaf: np.ndarray  # and their leaves
    leaf_tokens: np.ndarray  # training tokens per leaf

    @property
    def depth(self) -> int:
        return depth_for(self.distinct)

    @property
    def rows(self) -> int:
        """Hashed rows of each softmax's table."""
        return 1 << max(10, math.ceil(math.log2(ROWS * max(1, self.tokens) ** GROWTH)))

    @property
    def unknown(self) -> float:
        """Probability that the next token is one of the ``single`` + 1 that the training texts do not hold."""
        return (self.single + 1) / (self.tokens + self.distinct + 1)

    def leaves(self, tokens: np.ndarray, tails: np.ndarray) -> np.ndarray:
        """The leaf of each token; the hexadecimal digits of its number are the path of classes."""
        half = FAN**self.depth // 2
        ending = mix64(tails.astype(np.uint64) + _SALTS[0]) % np.uint64(half // FAN)
        out = half + (ending * np.uint64(FAN) + tokens % np.uint64(FAN)).astype(np.int64)
        if len(self.own):
            place = np.minimum(np.searchsorted(self.own, tokens), len(self.own) - 1)
            hit = self.own[place] == tokens
            out[hit] = self.own_leaf[place[hit]]
        return out

    def passes(self) -> list[list[int]]:
        """The softmaxes, by level, that passes over the blocks work on together."""
        bytes_each = [(self.rows + FAN**level) * FAN * 4 for level in range(self.depth)]
        out: list[list[int]] = []
        for level, size in enumerate(bytes_each):
            if out and sum(bytes_each[k] for k in out[-1]) + size <= PASS_BYTES:
                out[-1].append(level)
            else:
                out.append([level])
        return out


def depth_for(distinct: int) -> int:
    return max(3, math.ceil(math.log2(max(1, distinct)) / (2 * BITS)))


def encode(docs: DataFrame, learn: Column, id_column: str, text: str) -> DataFrame:
    """Blocks: ids, training flags and token counts of the texts, the block's distinct tokens with
    their training counts, and the texts as numbers into them."""

    def pack(ids, flags, sizes, tokens, tails):
        words, first, numbers = np.unique(np.concatenate(tokens), return_index=True, return_inverse=True)
        sizes, flags = np.concatenate(sizes), np.concatenate(flags)
        trained = np.bincount(numbers[np.repeat(flags, sizes)], minlength=len(words))
        return pa.record_batch([
            pa.array([pa.concat_arrays(ids).to_pylist()], pa.list_(pa.int64())), pa.array([flags.astype(np.uint8).tobytes()]),
            pa.array([sizes.astype(np.int64).tobytes()]), pa.array([words.view(np.int64)], pa.list_(pa.int64())),
            pa.array([np.concatenate(tails)[first].astype(np.int32)], pa.list_(pa.int32())),
            pa.array([trained], pa.list_(pa.int64())), pa.array([numbers.astype(np.int32).tobytes()]),
        ], ["ids", "train", "sizes", "words", "tails", "trained", "numbers"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[], [], [], [], []]
        n = 0
        for part in slices(batches, text):
            tokens, tails, sizes = tokenise(text_bytes(part.column(text)))
            if n and n + len(tokens) > BLOCK_TOKENS:
                yield pack(*held)
                held, n = [[], [], [], [], []], 0
            new = (part.column("id"), part.column("learn").to_numpy(zero_copy_only=False), sizes, tokens, tails)
            for column, value in zip(held, new):
                column.append(value)
            n += len(tokens)
        if n:
            yield pack(*held)

    rows = docs.select(F.col(id_column).cast("bigint").alias("id"), F.col(text).cast("string").alias(text), learn.alias("learn"))
    return rows.mapInArrow(
        run, "ids array<bigint>, train binary, sizes binary, words array<bigint>, tails array<int>, trained array<bigint>, numbers binary"
    )


def _written(blocks: DataFrame) -> DataFrame:
    """The blocks as a table in the shared folder, in small row groups (a row can hold megabytes)."""
    path = scratch_path(blocks.sparkSession)
    # Sizes are looked at after each row; by default the first time after 100 rows, which may be gigabytes.
    rows = blocks.write.option("compression", "zstd").option("parquet.block.size", 8 << 20).option("parquet.page.size.row.check.min", 1)
    rows.parquet(path)
    return blocks.sparkSession.read.schema(blocks.schema).parquet(path)


def _corpus_counts(blocks: DataFrame) -> tuple[DataFrame, Facts]:
    """(block, known, known_counts): the places of a block's words that are training tokens, and
    how often each occurs in the training texts of the whole corpus; and the facts."""
    entries = blocks.select(F.explode(F.arrays_zip("words", "tails", "trained")).alias("e"))
    entries = entries.select(F.col("e.words").alias("word"), F.col("e.tails").alias("tail"), F.col("e.trained").alias("trained"))
    totals = cut_lineage(entries.groupBy("word").agg(F.sum("trained").alias("c"), F.first("tail").alias("tail")).where("c > 0"))
    step = F.floor(F.log2("c") * STEPS)
    by_step = totals.groupBy(step.alias("step")).agg(F.sum("c").alias("c"), F.count("*").alias("v"), F.count_if(F.col("c") == 1).alias("single"))
    steps = sorted(by_step.collect(), key=lambda r: -r["step"])  # at most 64 * STEPS rows
    tokens, distinct, single = (sum(r[k] for r in steps) for k in ("c", "v", "single"))
    half, reached, least = FAN ** depth_for(distinct) // 2, 0, None
    for r in steps:
        reached += r["v"]
        if reached > half:
            break
        least = r["step"]
    # At most ``half`` rows, which is 8 * sqrt(V) or less.
    top = [] if least is None else totals.where(step >= least).select("c", "word").collect()
    ranked = np.array([r["word"] for r in sorted(top, key=lambda r: (-r["c"], r["word"]))], dtype=np.int64).view(np.uint64)
    order = np.argsort(ranked)
    bare = Facts(tokens, distinct, single, ranked[order], order, np.zeros(0))
    shared = blocks.sparkSession.sparkContext.broadcast(bare)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(2 * half, dtype=np.int64)
        for batch in batches:
            leaf = shared.value.leaves(batch.column("word").to_numpy().view(np.uint64), batch.column("tail").to_numpy())
            np.add.at(sums, leaf, batch.column("c").to_numpy())
        some = np.flatnonzero(sums)
        yield pa.record_batch([pa.array(some), pa.array(sums[some])], ["leaf", "c"])

    leaf_tokens = np.zeros(2 * half, dtype=np.int64)
    for leaf, c in totals.mapInArrow(tally, "leaf bigint, c bigint").groupBy("leaf").agg(F.sum("c")).collect():  # a row per leaf
        leaf_tokens[leaf] = c
    facts = Facts(tokens, distinct, single, bare.own, bare.own_leaf, leaf_tokens)
    places = blocks.select("block", F.posexplode("words").alias("place", "word"))
    counted = places.join(totals.select("word", "c"), "word")
    # A block's words are as many as its tokens at most, so no group is larger than a block.
    back = counted.groupBy("block").agg(F.collect_list(F.struct("place", "c")).alias("counts"))
    return cut_lineage(back.select("block", F.col("counts.place").alias("known"), F.col("counts.c").alias("known_counts"))), facts


Tables = dict[int, np.ndarray]


def zero(facts: Facts, levels: list[int]) -> Tables:
    """A table per level: hashed rows, and a constant's row for every class above."""
    return {level: np.zeros((facts.rows + FAN**level, FAN), dtype=np.float32) for level in levels}


class Start:
    """Tables that a task begins with.  Where they arrive they lie in an unnamed file, not in the task's
    memory: a task that changes a copy holds the tables once, and reads the others again for the difference."""

    def __init__(self, tables: Tables):
        self.tables = tables

    def __setstate__(self, state: dict) -> None:
        self.tables = {}
        with tempfile.TemporaryFile() as file:  # a mapping outlives the file's closing
            for level, table in state["tables"].items():
                at = file.tell()
                file.write(memoryview(table))
                file.flush()
                self.tables[level] = np.asarray(np.memmap(file, table.dtype, "r", at, table.shape))
                file.seek(0, 2)


class Histories:
    """Hashes of the features of the history, for any tokens of a block; before a text begins there are ends."""

    def __init__(self, numbers: np.ndarray, words: np.ndarray, sizes: np.ndarray):
        first = np.cumsum(sizes) - sizes
        # The end is a block's number 0: its hash is the smallest, and every text has one.
        zero = numbers[:1] * 0  # of the same type
        self.one = np.concatenate([zero, numbers[:-1]])
        self.one[first] = 0
        self.two = np.concatenate([zero, self.one[:-1]])
        self.two[first] = 0
        self.salted = [mix64(words ^ salt) for salt in _SALTS[1:3]]

    def features(self, at: np.ndarray) -> np.ndarray:
        h = np.empty((len(at), _FEATURES), dtype=np.uint64)
        h[:, 0] = self.salted[0][self.one[at]]
        h[:, 1] = self.salted[1][self.two[at]]
        h[:, 2] = mix64(h[:, 0] * _SALTS[3] + h[:, 1])
        return h


def rows_of(h: np.ndarray, leaf: np.ndarray, facts: Facts, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the level's table for each token, the constant's first, and the class to be predicted."""
    below = BITS * (facts.depth - 1 - level)
    goal = leaf >> below
    above = goal >> BITS
    out = np.empty((len(h), 1 + _FEATURES), dtype=np.int32)
    out[:, 0] = facts.rows + above
    mixed = (h + above[:, None].astype(np.uint64) * _SALTS[2]) * _SALTS[3]
    out[:, 1:] = mixed >> np.uint64(65 - facts.rows.bit_length())
    return out, goal & (FAN - 1)


def softmax(table: np.ndarray, rows: np.ndarray) -> np.ndarray:
    logits = table.take(rows[:, 0], axis=0)
    for k in range(1, rows.shape[1]):
        logits += table.take(rows[:, k], axis=0)
    np.clip(logits, -40, 40, out=logits)  # so that no exponential leaves single precision
    np.exp(logits, out=logits)
    logits /= (logits @ np.ones(FAN, dtype=np.float32))[:, None]
    return logits


def gradient(table: np.ndarray, rows: np.ndarray, goal: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows that the batch uses, how often, and the gradient of its negative log likelihood in each."""
    each = softmax(table, rows)
    each[np.arange(len(goal)), goal] -= 1
    # One sort of whole numbers, short ones if they suffice, with the token below the row, is faster than sorting places.
    bits = len(goal).bit_length()
    kind = np.uint32 if len(table).bit_length() + bits <= 32 else np.int64
    keys = ((rows.astype(kind) << kind(bits)) | np.arange(len(goal), dtype=kind)[:, None]).ravel()
    keys.sort()
    name = keys >> kind(bits)
    first = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]]))
    times = np.diff(first, append=len(name))
    return name[first].astype(np.int64), times, run_sums(each, (keys & kind((1 << bits) - 1)).astype(np.int64), first, times)


def run_sums(values: np.ndarray, at: np.ndarray, first: np.ndarray, times: np.ndarray) -> np.ndarray:
    """What ``np.add.reduceat(values[at], first)`` gives, to the bit; most runs are short, and those are added together."""
    total = values.take(at[first], axis=0)
    for n in range(2, 6):
        some = np.flatnonzero(times == n)
        if len(some):
            rest = values.take(at[first[some] + 1], axis=0)
            for k in range(2, n):
                rest += values.take(at[first[some] + k], axis=0)
            total[some] += rest
    long = np.flatnonzero(times > 5)
    if len(long):
        edge = np.cumsum(times[long]) - times[long]
        total[long] = np.add.reduceat(values.take(at[np.repeat(times > 5, times)], axis=0), edge, axis=0)
    return total


def _step(table: np.ndarray, energy: np.ndarray, used: np.ndarray, rows: np.ndarray, goal: np.ndarray) -> None:
    """One AdaGrad step (an accumulated square per row)."""
    name, times, total = gradient(table, rows, goal)
    squares = energy[name] + np.einsum("ij,ij->i", total, total) / FAN
    energy[name] = squares
    total *= (RATE / np.sqrt(squares))[:, None]
    total = np.subtract(table.take(name, axis=0), total, out=total)  # take is faster than an index
    table[name] = total
    used[name] += times


def _read(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    words = np.asarray(row["words"], dtype=np.int64).view(np.uint64)
    return (
        np.frombuffer(row["numbers"], dtype=np.int32), words, np.frombuffer(row["sizes"], dtype=np.int64),
        np.frombuffer(row["train"], dtype=np.uint8).astype(bool),
    )


def _rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Block rows one at a time, with lists as arrays."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = {}
            for name, column in zip(batch.schema.names, batch.columns):
                value = column[i]
                is_list = pa.types.is_list(column.type)
                if name == "ids":
                    row[name] = value.values
                elif is_list:
                    row[name] = value.values.to_numpy() if value.is_valid else np.zeros(0, dtype=np.int64)
                elif pa.types.is_binary(column.type):
                    row[name] = value.as_buffer()  # not a copy
                else:
                    row[name] = value.as_py()
            yield row


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Jobs that run inside send blocks to Python one or two at a time; else tens of them, once in the JVM and once in Python."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "8m")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def learn(rows: Iterator[dict], start: Tables, facts: Facts, turn: int) -> tuple[Tables, Tables]:
    """The tables after a task's steps in a round, and how often each of their rows was updated."""
    tables = {level: np.array(table) for level, table in start.items()}
    energy = {level: np.full(len(t), 1.0, dtype=np.float32) for level, t in tables.items()}
    used = {level: np.zeros(len(t), dtype=np.int32) for level, t in tables.items()}
    for row in rows:
        _learn_block(row, tables, energy, used, facts, turn)
    return tables, used


def _learn_block(row: dict, tables: Tables, energy: Tables, used: Tables, facts: Facts, turn: int) -> None:
    numbers, words, sizes, flags = _read(row)
    leaf = facts.leaves(words, row["tails"])
    # A short first round over a part of the texts gives all tasks a common start.
    part = np.arange(len(sizes)) % 8 == 0
    chosen = flags & (part if turn == 0 else ~part)
    history = Histories(numbers, words, sizes)
    take = np.flatnonzero(np.repeat(chosen, sizes))
    for lo in range(0, len(take), BATCH):
        at = take[lo : lo + BATCH]
        h, goal = history.features(at), leaf[numbers[at]]
        for level, table in tables.items():
            _step(table, energy[level], used[level], *rows_of(h, goal, facts, level))


def train(blocks: DataFrame, facts: Facts, levels: list[int]) -> Tables:
    """Weights of the levels after all rounds; each training text is used once."""
    spark = blocks.sparkSession
    weights = zero(facts, levels)
    chunk_rows = 1 << 11
    # A task sends its tables once a round, so tasks are fewer where tables are large.
    tasks = max(1, facts.tokens // (TOKENS_A_ROW * sum(len(t) for t in weights.values())))
    parts = blocks.select("numbers", "words", "tails", "sizes", "train").coalesce(tasks)
    for turn in range(ROUNDS):
        shared = spark.sparkContext.broadcast((Start(weights), facts))

        def run(batches: Iterator[pa.RecordBatch], turn: int = turn, shared=shared) -> Iterator[pa.RecordBatch]:
            start, known = shared.value
            tables, used = learn(_rows_of(batches), start.tables, known, turn)
            for level, table in tables.items():
                for lo in range(0, len(table), chunk_rows):
                    s = slice(lo, lo + chunk_rows)
                    if used[level][s].any():
                        moved = (table[s] - start.tables[level][s]).astype(np.float16)
                        yield pa.record_batch([
                            pa.array([level]), pa.array([lo]), pa.array([moved.tobytes()]), pa.array([used[level][s].tobytes()])
                        ], ["level", "start", "moved", "used"])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[tuple[int, int], list[np.ndarray]] = {}
            for batch in batches:
                for level, lo, moved, used in zip(*(batch.column(c).to_pylist() for c in ("level", "start", "moved", "used"))):
                    u = np.frombuffer(used, dtype=np.int32).astype(np.int64)
                    m = np.frombuffer(moved, dtype=np.float16).astype(np.float64).reshape(len(u), FAN) * u[:, None]
                    if (level, lo) in sums:
                        sums[level, lo][0] += m
                        sums[level, lo][1] += u
                    else:
                        sums[level, lo] = [m, u]
            for (level, lo), (m, u) in sums.items():
                mean = (m / np.maximum(1, u)[:, None]).astype(np.float32)
                yield pa.record_batch([pa.array([level]), pa.array([lo]), pa.array([mean.tobytes()])], ["level", "start", "mean"])

        moved = parts.mapInArrow(run, "level bigint, start bigint, moved binary, used binary")
        means = moved.repartition("level", "start").mapInArrow(add, "level bigint, start bigint, mean binary")
        with small_batches(spark):
            means = means.toArrow()  # each row of the tables, once; the driver's JVM passes batches on as they come
        for row in _rows_of(means.to_batches()):
            mean, lo = np.frombuffer(row["mean"], dtype=np.float32).reshape(-1, FAN), row["start"]
            weights[row["level"]][lo : lo + len(mean)] += mean
        shared.destroy()
    return weights


def score(docs: DataFrame, learn: Column, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score) of every row; scores are log10 probabilities.

    ``base_score`` is the add-one unigram model over the training tokens; ``score`` the model's."""
    blocks = encode(docs, learn, id_column, text).withColumn("block", F.monotonically_increasing_id())
    blocks = _written(blocks)
    counts, facts = _corpus_counts(blocks)
    counted = blocks.drop("trained").join(counts, "block", "left")
    counted = counted.select("block", "ids", "numbers", "words", "tails", "sizes", "train", "known", "known_counts")
    parts = [_scored(counted, facts, train(blocks, facts, levels), id_column) for levels in facts.passes()]
    if len(parts) == 1:
        return parts[0].drop("block", "place")
    sums = [F.first(c).alias(c) for c in (id_column, "n_tokens", "n_known", "train_tokens", "base_score")]
    return union_all(parts).groupBy("block", "place").agg(*sums, F.sum("score").alias("score")).drop("block", "place")


def _scored(counted: DataFrame, facts: Facts, weights: Tables, id_column: str) -> DataFrame:
    """The texts with the part of their score that these levels give; the first one adds the factors outside them."""
    shared = counted.sparkSession.sparkContext.broadcast((weights, facts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, facts = shared.value
        base_all = math.log10(facts.tokens + facts.distinct + 1)
        for row in _rows_of(batches):
            numbers, words, sizes, _ = _read(row)
            leaf = facts.leaves(words, row["tails"])
            counts = np.zeros(len(words), dtype=np.int64)
            counts[row["known"]] = row["known_counts"]
            known = counts > 0
            base = np.log10(counts + 1.0) - base_all
            outside = np.zeros(len(words))
            if 0 in tables:
                share = counts[known] / facts.leaf_tokens[leaf[known]]
                outside[known] = np.log10(share) + (math.log10(1 - facts.unknown) if known.any() else 0)
                outside[~known] = math.log10(facts.unknown / (facts.single + 1))
            history = Histories(numbers, words, sizes)
            each = outside[numbers]
            seen = np.flatnonzero(known[numbers])
            for lo in range(0, len(seen), BATCH):
                at = seen[lo : lo + BATCH]
                h, leaves = history.features(at), leaf[numbers[at]]
                for level, table in tables.items():
                    rows, goal = rows_of(h, leaves, facts, level)
                    each[at] += np.log10(np.maximum(softmax(table, rows)[np.arange(len(at)), goal], 1e-30))
            starts = np.cumsum(sizes) - sizes
            yield pa.record_batch([
                pa.array(np.full(len(sizes), row["block"])), pa.array(np.arange(len(sizes), dtype=np.int32)), row["ids"], pa.array(sizes),
                pa.array(np.add.reduceat(known[numbers].astype(np.int64), starts)),
                pa.array(np.full(len(sizes), facts.tokens, dtype=np.int64)), pa.array(np.add.reduceat(base[numbers], starts)),
                pa.array(np.add.reduceat(each, starts)),
            ], ["block", "place", id_column, "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return counted.mapInArrow(
        run,
        f"block bigint, place int, `{id_column}` bigint, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
    )
