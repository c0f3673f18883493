"""Chat formatting on the level of tokens.

Each turn is encoded by itself: its role and its text become ordinary tokens and reserved
ids, which no text can produce, mark where a turn, its text and its end lie.  Control
strings inside texts (those of this template and of other common ones) are broken by a
sign that reading takes out again, so the decoded output can be split by its marks as
well.  Offsets are running sums over a conversation's turns, and the loss mask of a stretch
of tokens is the running sum of +1 and -1 at the bounds of the assistant's texts.

The output is one row per turn, in order: a conversation of any length never has to fit
into one row.  ``read_back`` goes over those rows as a stream.

Defined cases: a null text is empty; a null role is the empty role; turns of a
conversation are ordered by turn (nulls first), then role and text, so ties and repeated
rows have one order; a null conversation id is a conversation of its own.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from passagemill.llm.common import slices, to_list_array
from passagemill.llm.token_counts import VOCABULARY, encoding, vocabulary_bytes

#: Reserved ids follow the vocabulary; their strings are the template's marks.
MARKS = {"<|turn|>": 50257, "<|text|>": 50258, "<|close|>": 50259}
TURN, TEXT, CLOSE = MARKS.values()
#: Control strings of common templates; they are escaped like this template's own.
FOREIGN = (
    "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<unk>", "<pad>", "<|endoftext|>", "<|im_start|>",
    "<|im_end|>", "<|system|>", "<|user|>", "<|assistant|>", "<|begin_of_text|>", "<|end_of_text|>", "<|eot_id|>",
    "<|start_header_id|>", "<|end_header_id|>", "<start_of_turn>", "<end_of_turn>",
)
_BREAK = "\\"
_CONTROL = re.compile("(?=" + "|".join(map(re.escape, (*MARKS, *FOREIGN))) + ")(.)", re.S)
_BROKEN = re.compile(r"\\(\\?)")


def escape(text: str) -> str:
    """The text with its break signs doubled and one put into every control string."""
    return _CONTROL.sub(r"\1\\", text.replace(_BREAK, _BREAK * 2))


def unescape(text: str) -> str:
    """Undo ``escape``: of two signs one stays, a single one goes."""
    return _BROKEN.sub(r"\1", text)


def _ordered() -> Window:
    return Window.partitionBy("conv_id").orderBy("turn", "role", "text")


def format_turns(conversations: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per turn: (conv_id, seq, start, ids, mask_bounds, n_chars, trainable).

    ``seq`` counts from 0 within the conversation, ``start`` is the turn's first token there,
    ``ids`` its tokens with the marks spliced in, ``mask_bounds`` the token offsets (from
    ``start``) between which the loss counts; null where it does not.
    """
    shared = conversations.sparkSession.sparkContext.broadcast(vocabulary_bytes(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(shared.value).encode_ordinary
        for part in slices(batches, "text"):
            ids: list[int] = []
            sizes, begins, ends, chars = [], [], [], []
            for role, text in zip(part.column("role").to_pylist(), part.column("text").to_pylist()):
                role, body = escape(role), escape(text)
                head, tail = encode(role), encode(body)
                ids += [TURN, *head, TEXT, *tail, CLOSE]
                sizes.append(len(head) + len(tail) + 3)
                begins.append(len(head) + 2)
                ends.append(len(head) + 2 + len(tail))
                chars.append(len(role) + len(body) + sum(map(len, MARKS)))
            columns = [part.column(c) for c in ("conv_id", "turn", "role", "text")]
            arrays = [
                to_list_array(np.array(ids, dtype=np.int32), np.array(sizes)), pa.array(sizes, pa.int32()),
                pa.array(begins, pa.int32()), pa.array(ends, pa.int32()), pa.array(chars, pa.int64()),
            ]
            yield pa.record_batch(columns + arrays, ["conv_id", "turn", "role", "text", "ids", "n", "b", "e", "n_chars"])

    rows = conversations.select(
        "conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    encoded = rows.mapInArrow(
        run, f"conv_id {types['conv_id']}, turn {types['turn']}, role string, text string, ids array<int>, n int, "
        "b int, e int, n_chars bigint",
    )
    before = _ordered().rowsBetween(Window.unboundedPreceding, -1)
    learn = F.col("role") == "assistant"
    return encoded.select(
        "conv_id", (F.row_number().over(_ordered()) - 1).alias("seq"),
        F.coalesce(F.sum(F.col("n").cast("bigint")).over(before), F.lit(0)).alias("start"), "ids",
        F.when(learn, F.array("b", "e")).alias("mask_bounds"), "n_chars",
    )


def loss_mask(lengths: np.ndarray, bounds: list[list[int] | None]) -> np.ndarray:
    """The mask over consecutive turns' tokens: a running sum of the marks at the bounds."""
    starts = np.concatenate([[0], np.cumsum(lengths)])
    change = np.zeros(starts[-1] + 1, dtype=np.int8)
    for start, bound in zip(starts[:-1].tolist(), bounds):
        if bound is not None and bound[0] < bound[1]:
            change[start + bound[0]] += 1
            change[start + bound[1]] -= 1
    return np.cumsum(change[:-1]) > 0


class _Reading:
    """One conversation being read: digests that grow with each turn."""

    def __init__(self, conv_id):
        self.conv_id, self.turns, self.loss_chars, self.chars = conv_id, 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def row(self) -> tuple:
        return self.conv_id, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def read_back(formatted: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per conversation, from the formatted tokens alone.

    Turns are found by the reserved ids, decoded and unescaped; the text under the loss mask
    is decoded from the masked tokens.  Rows of a conversation arrive in order and only its
    running digests are kept.
    """
    shared = formatted.sparkSession.sparkContext.broadcast(vocabulary_bytes(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = encoding(shared.value).decode_bytes
        marks = {number: mark for mark, number in MARKS.items()}
        now: _Reading | None = None
        done: list[tuple] = []

        def flush():
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            return pa.record_batch([
                pa.array([r[0] for r in done], kind), pa.array([r[1] for r in done], pa.int64()),
                pa.array([r[2] for r in done]), pa.array([r[3] for r in done], pa.int64()),
                pa.array([r[4] for r in done]), pa.array([r[5] for r in done], pa.int64()),
            ], names)

        for batch in batches:
            kind = batch.schema.field("conv_id").type
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                ids, bounds = part.column("ids").to_pylist(), part.column("mask_bounds").to_pylist()
                lengths = np.array([len(x) for x in ids], dtype=np.int64)
                mask = loss_mask(lengths, bounds)
                start = 0
                for conv_id, tokens in zip(part.column("conv_id").to_pylist(), ids):
                    if now is None or conv_id != now.conv_id:
                        if now is not None:
                            done.append(now.row())
                        now = _Reading(conv_id)
                    cut = tokens.index(TEXT)
                    if tokens[0] != TURN or tokens[-1] != CLOSE:
                        raise ValueError(f"conversation {conv_id}: a turn without its marks")
                    role, body = decode(tokens[1:cut]).decode(), decode(tokens[cut + 1 : -1]).decode()
                    now.turns += 1
                    now.chars += len(role) + len(body) + sum(len(marks[t]) for t in (TURN, TEXT, CLOSE))
                    now.all.update(f"{unescape(role)}\n{unescape(body)}\n".encode())
                    under = mask[start : start + len(tokens)]
                    if under.any():
                        learned = unescape(decode([t for t, m in zip(tokens, under.tolist()) if m]).decode())
                        now.loss_chars += len(learned)
                        now.loss.update(learned.encode())
                    start += len(tokens)
            if len(done) >= 1000:
                yield flush()
                done = []
        if now is not None:
            done.append(now.row())
            yield flush()

    kind = formatted.schema["conv_id"].dataType.simpleString()
    rows = formatted.select("conv_id", "seq", "ids", "mask_bounds")
    # Not relied upon: that the rows still lie as the numbering left them (they may come from a table).
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "seq")
    return ordered.mapInArrow(
        run, f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint",
    )
