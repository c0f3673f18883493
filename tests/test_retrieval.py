import sqlite3

import pytest
from pyspark.sql import functions as F

from passagemill.functions import text as X
from passagemill.operators import evaluation, fusion, rerank, retrieval
from passagemill.operators.dense import dense_topk
from passagemill.operators.lexical import bm25_topk
from passagemill.operators.skew import join_hot
from passagemill.schemas import QueryError

CAND = "qid bigint, leg int, rank int, chunk_id string, parent_id string"


def _found(spark, *lists):
    """Each query is a pair of candidate lists given as (chunk, parent)."""
    rows = [
        (qid, leg, i + 1, c, p)
        for qid, legs in enumerate(lists) for leg, listed in enumerate(legs) for i, (c, p) in enumerate(listed)
    ]
    return spark.createDataFrame(rows, CAND)


def _corpus(spark, texts, tau=None):
    children = spark.createDataFrame([(c, p, p, t) for c, p, t in texts], "chunk_id string, parent_id string, doc_id string, embed_text string")
    parents = spark.createDataFrame(
        [(p, t, "H", "guide.md", "abc", 1, 2, 4, 4 + len(t)) for _, p, t in texts],
        "parent_id string, text string, heading_path string, source_path string, file_sha256 string, "
        "page_start int, page_end int, start_char int, end_char int",
    )
    return retrieval.Corpus(children, parents.dropDuplicates(["parent_id"]), tau=tau)


def test_fusion_sums_ranks_and_keeps_first_sight_on_ties(spark):
    found = _found(spark, ([("1", "a"), ("2", "b")], [("1", "a"), ("3", "c")]))
    fused = fusion.fuse(fusion.parent_lists(found), "parent_id").orderBy("rank").collect()
    assert [(r.parent_id, r.score) for r in fused] == [
        ("a", pytest.approx(2 / 61)), ("b", pytest.approx(1 / 62)), ("c", pytest.approx(1 / 62)),
    ]


def test_agreement_needs_both_lists_and_a_distant_second(spark):
    wide = ([("1", "A"), ("2", "B")], [("1", "A"), ("3", "C")])
    tied = ([("1", "A"), ("2", "B")], [("2", "B"), ("1", "A")])
    late = ([(str(i), f"P{i}") for i in range(4)], [("9", "Q"), ("8", "R"), ("7", "S"), ("3", "P3")])
    alone = ([("1", "A")], [("1", "A")])
    found = _found(spark, wide, tied, late, alone)
    got = fusion.agreed(fusion.fuse(fusion.parent_lists(found), "parent_id")).collect()
    assert {(r.qid, r.parent_id) for r in got} == {(0, "A"), (3, "A")}


def _score(q, text):
    return F.when(text.contains("alpha"), 1.0).when(text.contains("beta"), 0.9).otherwise(0.2)


def test_cascade_fast_path_band_threshold_and_ties(spark):
    fast = ([("c1", "A"), ("c2", "B")], [("c1", "A"), ("c3", "C")])
    band = ([("c1", "A"), ("c2", "B")], [("c2", "B"), ("c1", "A")])
    far = ([("c1", "A"), ("c3", "C")], [("c3", "C"), ("c1", "A")])
    queries = spark.createDataFrame([(0, "x"), (1, "x"), (2, "x")], "qid bigint, q string")
    texts = [("c1", "A", "alpha"), ("c2", "B", "beta"), ("c3", "C", "gamma")]
    found = _found(spark, fast, band, far)
    asked = []

    def watch(q, text):
        asked.append(1)
        return _score(q, text)

    hits = retrieval.retrieve(_corpus(spark, texts), queries, "cascade", watch, found=found)
    rows = {(h.qid, h["rank"]): (h.parent_id, h.confident, h.score) for h in hits.hits.collect()}
    assert rows[(0, 1)][:2] == ("A", True) and rows[(0, 1)][2] == pytest.approx(2 / 61)
    assert rows[(1, 1)] == ("A", False, 1.0) and rows[(1, 2)] == ("B", False, 0.9)
    assert rows[(2, 1)] == ("A", True, 1.0) and len(rows) == 4
    held = retrieval.retrieve(_corpus(spark, texts, tau=1.5), queries, "cascade", _score, found=found)
    assert {h.qid for h in held.hits.collect()} == {0}
    assert {s.qid: s.reason for s in held.status.collect()} == {0: "", 1: "no_confident_hit", 2: "no_confident_hit"}
    other = retrieval.retrieve(_corpus(spark, texts), queries, "anything", _score, found=found)
    assert {(h.qid, h.parent_id) for h in other.hits.where("qid = 0").collect()} == {(0, "A"), (0, "B")}
    with pytest.raises(QueryError, match="reranker"):
        retrieval.retrieve(_corpus(spark, texts), queries, "rerank", None, found=found)
    with pytest.raises(QueryError, match="empty query"):
        retrieval.retrieve(_corpus(spark, texts), queries.withColumn("q", F.lit(" \t")), "bm25", found=found)


def test_bm25_equals_sqlite_full_text_search(spark):
    docs = [
        "The quick brown fox", "A foo_bar walks; foo bar foo_bar", "Crème brûlée, the dessert", "fox fox fox the den",
        "bar foo the end", "the the the", "quick foo thinking", "nothing here",
    ] * 3 + ["the unique résumé of foo bar"]
    asked = ["the fox", "foo_bar", "creme RESUME", "quick quick brown", "_", "the end of foo"]
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE t USING fts5(body, tokenize='unicode61')")
    db.executemany("INSERT INTO t(rowid, body) VALUES (?, ?)", list(enumerate(docs)))
    chunks = spark.createDataFrame([(i, i, d) for i, d in enumerate(docs)], "chunk_id bigint, doc_id bigint, embed_text string")
    queries = spark.createDataFrame([(i, q, None) for i, q in enumerate(asked)], "qid bigint, q string, doc_filter string")
    got = {}
    for r in bm25_topk(chunks, queries, 100, carry=("chunk_id",)).collect():
        got.setdefault(r.qid, {})[r.chunk_id] = r.score
    for i, q in enumerate(asked):
        match = " OR ".join(f'"{w}"' for w in __import__("re").findall(r"\w+", q))
        want = {r: -s for r, s in db.execute("SELECT rowid, bm25(t) FROM t WHERE t MATCH ?", (match,))}
        assert got.get(i, {}) == pytest.approx(want, abs=1e-8)


def test_dense_search_is_exact_and_filters(spark):
    import random

    rng = random.Random(3)
    vectors = [(f"c{i:03}", f"d{i % 5}", [rng.uniform(-1, 1) for _ in range(6)]) for i in range(200)]
    asked = [(q, [rng.uniform(-1, 1) for _ in range(6)], "d2" if q == 1 else None) for q in range(3)]
    got = dense_topk(
        spark.createDataFrame(vectors, "chunk_id string, doc_id string, vector array<float>").repartition(5),
        spark.createDataFrame(asked, "qid bigint, vector array<double>, doc_filter string"), 7, ("chunk_id",),
    ).collect()
    norm = lambda v: sum(x * x for x in v) ** 0.5
    for qid, v, only in asked:
        sims = sorted(
            (-sum(a * b for a, b in zip(v, w)) / norm(v) / norm(w), c) for c, d, w in vectors if only in (None, d)
        )[:7]
        assert [c for _, c in sims] == [r.chunk_id for r in sorted(got, key=lambda r: r["rank"]) if r.qid == qid]


def test_evaluation_rules(spark):
    score = lambda values: spark.createDataFrame([(float(v),) for v in values], "score double")
    assert [r.tau for r in evaluation.fit_tau(score(range(20))).collect()] == [1.0]
    assert evaluation.fit_tau(score([])).collect() == []
    assert [r.tau for r in evaluation.fit_tau(score([3, 3, 1])).collect()] == [1.0]
    schema = "mode string, kind string, recall double, mrr double, p50 double"

    def pick(*rows):
        lines = [(m, "all", r, mrr, p) for m, r, p, mrr in rows] + [("dense", "lexical", 9.0, 9.0, 0.0)]
        return evaluation.pick_live(spark.createDataFrame(lines, schema)).collect()[0].mode

    assert pick(("cascade", 0.9, 10.0, 0.5), ("rerank", 0.92, 40.0, 0.5)) == "cascade"
    assert pick(("cascade", 0.8, 10.0, 0.5), ("rerank", 0.92, 40.0, 0.5)) == "rerank"
    assert pick(("cascade", 0.9, 40.0, 0.5), ("rerank", 0.9, 40.0, 0.5)) == "rerank"
    samples = spark.createDataFrame([("a", 4.0), ("a", 1.0), ("a", 2.0), ("a", 3.0), ("b", 7.0)], "g string, ms double")
    assert {r.g: r.p50 for r in evaluation.lower_median(samples, ["g"], "ms").collect()} == {"a": 2.0, "b": 7.0}
    golden = spark.createDataFrame(
        [(0, "d", "needle", "lexical"), (1, None, None, "unanswerable")],
        "qid bigint, doc_id string, must_contain string, kind string",
    )
    hits = spark.createDataFrame(
        [(0, "m", 1, "no", "d"), (0, "m", 2, "a needle", "e"), (0, "m", 3, "a needle", "d"), (1, "m", 1, "x", "d")],
        "qid bigint, mode string, rank int, parent_text string, source_path string",
    )
    status = spark.createDataFrame([(0, "m", ""), (1, "m", "no_confident_hit")], "qid bigint, mode string, reason string")
    rows = {r.kind: r for r in evaluation.roll_up(evaluation.grade(golden, hits, status)).collect()}
    assert (rows["all"].recall, rows["all"].mrr, rows["all"].abstain, rows["all"].n) == (1.0, pytest.approx(1 / 3), 0.5, 2)
    assert (rows["unanswerable"].recall, rows["unanswerable"].abstain) == (0.0, 1.0)


def test_hot_keys_join_to_the_same_rows(spark):
    left = spark.range(3000).select(F.when(F.col("id") < 1000, 0).otherwise(F.col("id")).alias("k"), "id")
    right = spark.range(0, 3000, 2).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    want = left.join(right, "k", "left")
    got = join_hot(left, right, "k", "left", share=50)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_text_functions(spark):
    import unicodedata

    for low, high in ((0, 0x9F), (0xBF, 0x131), (0x400, 0x482), (0x3400, 0xA66E)):
        assert all(unicodedata.is_normalized("NFKC", chr(c)) and unicodedata.category(chr(c))[0] != "M" for c in range(low, high + 1))
    cases = {
        "Ａ­B\x00": "AB", "inter-\nnational": "international", "inter-\n national": "international",
        "inter-\nNational": "inter-\nNational", "AB-12-XL": "AB-12-XL", "a   b\n\n\n\nc": "a b\n\nc",
        "  x \t \n  \n　y\xa0\r\nz\rw ": "x\n\ny\nz\nw", "\x1c a \x1f\n\x0bb": "a\nb",
    }
    df = spark.createDataFrame(list(cases), "string").select("value", X.normalize_text(F.col("value")).alias("n"))
    assert {r.value: r.n for r in df.collect()} == cases
    code = spark.createDataFrame(["foo-\nbar"], "string").select(X.normalize_text(F.col("value"), True).alias("n"))
    assert code.collect()[0].n == "foo-\nbar"
    terms = spark.createDataFrame(["Crème foo_bar été Ünïx-7"], "string")
    row = terms.select(X.index_terms(F.col("value")).alias("t"), X.query_words(F.col("value")).alias("w")).collect()[0]
    assert row.t == ["creme", "foo", "bar", "ete", "unix", "7"] and "foo_bar" in row.w


def test_rerank_keeps_fused_order_on_ties(spark):
    pairs = spark.createDataFrame(
        [(0, "a b", "c1", "P", "a x", 2), (0, "a b", "c2", "Q", "b y", 1), (0, "a b", "c3", "P", "A b", 3)],
        "qid bigint, q string, chunk_id string, parent_id string, embed_text string, fused_rank int",
    )
    got = rerank.rescore(pairs).orderBy("rank").collect()
    assert [(r.parent_id, r.child_id, r.score) for r in got] == [("P", "c3", 2.0), ("Q", "c2", 1.0)]
