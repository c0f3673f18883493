"""Models as hooks: loaded once per Python worker, called with batches of bounded size.

An encoder or a reranker is a function from columns to a column.  ``encoder`` and ``reranker``
make one from a loader, a function that returns a model: a callable on a list of texts (or two
lists).  A worker keeps the models it has loaded by their names, over all its tasks, and feeds
them at most ``batch_size`` texts at a time; repeated texts of a batch are asked once.  Nulls are
not given to the model and stay null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

BATCH_SIZE = 256

_loaded: dict[str, Callable] = {}


def loaded(name: str, load: Callable[[], Callable]) -> Callable:
    """The model of that name, loaded if this worker has not done so."""
    if name not in _loaded:
        _loaded[name] = load()
    return _loaded[name]


def in_batches(model: Callable[..., Sequence], inputs: list[tuple], size: int) -> list:
    """Results of distinct inputs without nulls, asked ``size`` at a time, in the order of the inputs."""
    asked = list(dict.fromkeys(x for x in inputs if not any(v is None for v in x)))
    found = {}
    for start in range(0, len(asked), size):
        part = asked[start : start + size]
        results = list(model(*map(list, zip(*part))))
        if len(results) != len(part):
            raise ValueError(f"the model returned {len(results)} results for {len(part)} inputs")
        found |= dict(zip(part, results))
    return [found.get(x) for x in inputs]


def encoder(name: str, load: Callable[[], Callable[[list[str]], Sequence]], batch_size: int = BATCH_SIZE) -> Callable[[Column], Column]:
    """A hook for ``encode``: texts to vectors (array<float>)."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = loaded(name, load)
        for texts in batches:
            vectors = in_batches(model, [(t,) for t in texts], batch_size)
            yield pd.Series([None if v is None else [float(x) for x in v] for v in vectors], dtype=object)

    return lambda text: run(text)


def reranker(name: str, load: Callable[[], Callable[[list[str], list[str]], Sequence]], batch_size: int = BATCH_SIZE) -> Callable[[Column, Column], Column]:
    """A hook for ``rerank``: pairs of a query and a passage to scores.  Thresholds are kept under ``name``."""

    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = loaded(name, load)
        for queries, passages in batches:
            scores = in_batches(model, list(zip(queries, passages)), batch_size)
            yield pd.Series([None if s is None else float(s) for s in scores], dtype="float64")

    def score(query: Column, passage: Column) -> Column:
        return run(query, passage)

    score.scorer_id = name
    return score


def counter(name: str, load: Callable[[], Callable[[list[str]], Sequence]], batch_size: int = BATCH_SIZE) -> Callable[[Column], Column]:
    """A hook for ``count``: the tokens of every string of an array."""

    @F.pandas_udf("array<int>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = loaded(name, load)
        for lists in batches:
            flat = [(t,) for texts in lists if texts is not None for t in texts]
            counts = iter(in_batches(model, flat, batch_size))
            yield pd.Series([None if texts is None else [next(counts) for _ in texts] for texts in lists], dtype=object)

    return lambda texts: run(texts)
