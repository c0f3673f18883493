"""Model hooks: loads, batches, nulls and results."""

import os

import pytest
from pyspark.sql import functions as F

from passagemill.functions.text import whitespace_tokens
from passagemill.operators import models
from passagemill.operators.rerank import rescore, scorer_name
from passagemill.session import ship


def _logged(folder, make):
    """A loader that leaves a file for each load, named by its worker."""

    def load():
        model, calls = make(folder), len(os.listdir(folder))
        open(os.path.join(folder, f"load-{os.getpid()}-{calls}-{os.urandom(4).hex()}"), "w").close()
        return model

    return load


def test_a_model_is_loaded_once_per_worker_and_fed_batches(spark, tmp_path):
    ship(spark)
    folder = str(tmp_path)

    def lengths(_):
        def model(texts):
            assert len(texts) == len(set(texts)) <= 7
            return [[len(t), t.count("a")] for t in texts]

        return model

    encode = models.encoder(f"lengths-{folder}", _logged(folder, lengths), 7)
    texts = spark.range(400).select(F.concat(F.lit("a" * 3), (F.col("id") % 90).cast("string")).alias("t")).repartition(9)
    texts = texts.unionByName(spark.createDataFrame([(None,), ("",)], "t string"))
    for _ in range(2):
        rows = texts.select("t", encode(F.col("t")).alias("v")).collect()
        assert len(rows) == 402
        assert all(r.v == (None if r.t is None else [len(r.t), r.t.count("a")]) for r in rows)
    workers = [f.split("-")[1] for f in os.listdir(folder)]
    assert workers and len(workers) == len(set(workers))


def test_a_batched_scorer_reranks(spark, tmp_path):
    ship(spark)
    score = models.reranker("shared letters", _logged(str(tmp_path), lambda _: lambda q, p: [len(set(a) & set(b)) for a, b in zip(q, p)]), 2)
    assert scorer_name(score) == "shared letters"
    pairs = spark.createDataFrame(
        [(0, "abc", f"c{i}", f"p{i % 3}", t, i) for i, t in enumerate(["x", "ab", "abc", "c", "b", "cab"])],
        "qid bigint, q string, chunk_id string, parent_id string, embed_text string, fused_rank int")
    rows = rescore(pairs, score).orderBy("rank").collect()
    assert [(r.parent_id, r.child_id, r.score) for r in rows] == [("p2", "c2", 3.0), ("p1", "c1", 2.0), ("p0", "c3", 1.0)]


def test_a_batched_counter_counts(spark, tmp_path):
    ship(spark)
    count = models.counter("words", _logged(str(tmp_path), lambda _: lambda texts: [len(t.split()) for t in texts]), 3)
    lists = spark.createDataFrame([(["a b", "", "c"],), ([],), (None,), (["d e f"] * 5,)], "texts array<string>")
    got = lists.select(count(F.col("texts")).alias("a"), whitespace_tokens(F.col("texts")).alias("b")).collect()
    assert all(r.a == r.b for r in got)


def test_a_model_must_answer_every_input():
    with pytest.raises(ValueError, match="1 results for 2"):
        models.in_batches(lambda texts: [1], [("a",), ("b",)], 5)
    assert models.in_batches(lambda a, b: [x + y for x, y in zip(a, b)], [("a", "b"), (None, "x"), ("a", "b")], 5) == ["ab", None, "ab"]
