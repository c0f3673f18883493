"""License scan: phrases by one automaton, expressions by a shunting-yard parser.

A text is folded to its words (ASCII case ignored, everything that is neither an ASCII
letter or digit nor a non-ASCII character separates) and an Aho-Corasick automaton over
the folded text finds the phrases, so white space and punctuation inside a notice do not
matter.  A second, small automaton finds ``SPDX-License-Identifier:`` tags in the text
itself; the expression behind a tag is read by operator precedence (``with`` binds
closest, then ``and``, then ``or``; brackets group).

Defined cases: a null or empty text has no word, no phrase and the score 0; repeated rows
are scanned each; texts are scanned whole, whatever their length.  An expression that
does not parse contributes no label and lowers the score of its tag.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagemill.llm.common import slices, text_bytes

#: The base phrases (words) and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Notice phrases of this scan: (label, how much a match says about the licence, 0 to 1).
NOTICES = {
    "released under the mit license": ("mit", 0.95),
    "licensed under the mit license": ("mit", 0.95),
    "permission is hereby granted free of charge to any person obtaining a copy": ("mit", 0.95),
    "licensed under the apache license version 2 0": ("apache-2.0", 0.95),
    "apache license version 2 0": ("apache-2.0", 0.9),
    "gnu general public license": ("gpl", 0.9),
    "gnu lesser general public license": ("lgpl", 0.95),
    "gnu affero general public license": ("agpl", 0.95),
    "mozilla public license": ("mpl", 0.9),
    "eclipse public license": ("epl", 0.9),
    "redistribution and use in source and binary forms": ("bsd", 0.9),
    "bsd license": ("bsd", 0.7),
    "isc license": ("isc", 0.7),
    "boost software license": ("bsl", 0.9),
    "creative commons": ("cc", 0.6),
    "licensed under cc by 4 0": ("cc-by", 0.9),
    "licensed under cc by sa 4 0": ("cc-by-sa", 0.9),
    "licensed under cc by nc 4 0": ("cc-by-nc", 0.9),
    "cc0 1 0": ("cc0", 0.8),
    "released into the public domain": ("public-domain", 0.8),
    "the unlicense": ("unlicense", 0.7),
    "all rights reserved": ("proprietary", 0.6),
}
BASE_WEIGHT = 0.7
TAG = b"spdx-license-identifier:"
TAG_WEIGHT, BAD_TAG_WEIGHT = 1.0, 0.4
#: Families whose licences ask no more than notices; an expression is permissive if its terms allow it.
PERMISSIVE = ("mit", "apache", "bsd", "isc", "bsl", "cc0", "unlicense", "zlib", "cc-by-4", "0bsd", "x11")
_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
_TOKEN = re.compile(rb"[()]|[a-z0-9][a-z0-9.+:-]*")
_RANK = {"or": 1, "and": 2, "with": 3}


def parse_expression(tokens: list[str]) -> list[str] | None:
    """The expression in postfix order; None if it is not well formed."""
    output: list[str] = []
    waiting: list[str] = []
    operand_next = True
    for token in tokens:
        if token == "(":
            if not operand_next:
                return None
            waiting.append(token)
        elif token == ")":
            if operand_next:
                return None
            while waiting and waiting[-1] != "(":
                output.append(waiting.pop())
            if not waiting:
                return None
            waiting.pop()
        elif token in _RANK:
            if operand_next:
                return None
            while waiting and waiting[-1] != "(" and _RANK[waiting[-1]] >= _RANK[token]:
                output.append(waiting.pop())
            waiting.append(token)
            operand_next = True
        else:
            if not operand_next:
                return None
            output.append(token)
            operand_next = False
    if operand_next or "(" in waiting:
        return None
    return output + waiting[::-1]


def evaluate_expression(postfix: list[str]) -> tuple[set[str], bool] | None:
    """The licences that an expression names and whether it can be met by permissive ones alone.

    ``or`` leaves the choice, ``and`` needs both sides, ``with`` adds an exception to the
    licence on its left and changes nothing about it.  None if ``with`` joins expressions.
    """
    stack: list[tuple[set[str], bool, bool]] = []  # names, permissive, is a single identifier
    for token in postfix:
        if token not in _RANK:
            stack.append(({token}, token.startswith(PERMISSIVE), True))
            continue
        right, left = stack.pop(), stack.pop()
        if token == "with":
            if not (left[2] and right[2]):
                return None
            stack.append((left[0], left[1], False))
        elif token == "and":
            stack.append((left[0] | right[0], left[1] and right[1], False))
        else:
            stack.append((left[0] | right[0], left[1] or right[1], False))
    names, permissive, _ = stack.pop()
    return names, permissive


@lru_cache(maxsize=1)
def _automata():
    import ahocorasick

    phrases = ahocorasick.Automaton()
    for phrase in {**BASE, **NOTICES}:
        phrases.add_word(f" {phrase} ", phrase)
    phrases.make_automaton()
    tags = ahocorasick.Automaton()
    tags.add_word(TAG.decode(), len(TAG))
    tags.make_automaton()
    return phrases, tags


def _expression_after(low: bytes, start: int) -> list[str]:
    """The tokens of an expression up to the end of its line, comment closers left out.

    Without brackets or operators between them, words after an identifier belong to the text."""
    end = low.find(b"\n", start)
    line = low[start : end if end >= 0 else len(low)]
    tokens: list[str] = []
    depth, operand = 0, False
    for match in _TOKEN.finditer(line):
        token = match.group().decode()
        if operand and token not in _RANK and token != ")":
            break
        if token == ")" and not depth:
            break
        depth += (token == "(") - (token == ")")
        operand = token == ")" or (token not in _RANK and token != "(")
        tokens.append(token.rstrip(".:-") if token not in "()" else token)
    return tokens


def scan_text(raw: bytes) -> tuple:
    """(n_words, n_base, first_word, last_word, base_labels, labels, expressions, permissive, score)."""
    phrases, tags = _automata()
    words = raw.translate(_FOLD).split()
    base, labels, doubt = [], set(), 1.0
    base_labels: set[str] = set()
    folded = " " + b" ".join(words).decode("latin-1") + " "
    counted, blanks = 0, 0  # matches come in order of their ends, so blanks are counted once
    for end, phrase in phrases.iter(folded):
        if phrase in BASE:
            blanks += folded.count(" ", counted, end + 1)
            counted = end + 1
            base.append(blanks - len(phrase.split()) - 1)
            base_labels.add(BASE[phrase])
            doubt *= 1 - BASE_WEIGHT
        if phrase in NOTICES:
            label, weight = NOTICES[phrase]
            labels.add(label)
            doubt *= 1 - weight
    expressions: list[str] = []
    permissive = None
    if b"-" in raw and TAG in (low := raw.lower()):
        for end, _ in tags.iter(low.decode("latin-1")):
            postfix = parse_expression(_expression_after(low, end + 1))
            value = evaluate_expression(postfix) if postfix else None
            if value is None:
                doubt *= 1 - BAD_TAG_WEIGHT
                continue
            doubt *= 1 - TAG_WEIGHT
            labels |= value[0]
            permissive = value[1] if permissive is None else permissive and value[1]
            expressions.append(" ".join(postfix))
    return (
        len(words), len(base), min(base, default=None), max(base, default=None), ",".join(sorted(base_labels)),
        ",".join(sorted(labels | base_labels)), expressions, permissive, 1 - doubt,
    )


_FIELDS = (
    ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
    ("base_labels", pa.string()), ("labels", pa.string()), ("expressions", pa.list_(pa.string())),
    ("permissive", pa.bool_()), ("score", pa.float64()),
)


def scan(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document with its licence evidence.

    ``base_labels`` and the word positions come from the base phrases; ``labels`` adds the
    notices and the identifiers of tags; ``expressions`` are the parsed tags in postfix
    order and ``permissive`` whether all of them can be met by permissive licences (null
    without a tag); ``score`` joins the evidence as independent chances.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text):
            columns = list(zip(*map(scan_text, text_bytes(part.column(text)))))
            arrays = [pa.array(values, kind) for values, (_, kind) in zip(columns, _FIELDS)]
            yield pa.record_batch([part.column(id_column), *arrays], [id_column, *(name for name, _ in _FIELDS)])

    rows = docs.select(F.col(id_column), F.col(text).cast("string").alias(text))
    return rows.mapInArrow(
        run,
        f"`{id_column}` {rows.schema[id_column].dataType.simpleString()}, n_words bigint, n_base bigint, "
        "first_word bigint, last_word bigint, base_labels string, labels string, expressions array<string>, "
        "permissive boolean, score double",
    )
