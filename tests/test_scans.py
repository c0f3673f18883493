"""Scans of passages that no index holds: each text is read, hashed and tokenised once."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from passagemill import api
from passagemill.functions import text as X
from passagemill.functions.hashing import hash_vector
from passagemill.operators import lexical, retrieval
from passagemill.operators.topk import TaskTopK
from passagemill.plans import common as C
from passagemill.plans import scoring

DOCS = "doc_id bigint, source string, text string"


def test_a_text_is_hashed_before_its_lines_are_dealt_out(spark, tmp_path):
    rows = [(1, "s", "one\n two \n\none"), (2, "s", None), (3, None, "three")]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    lines = C.line_children(spark, str(tmp_path))
    above = lines._jdf.queryExecution().optimizedPlan().toString().split("Generate")[0]
    assert " text#" not in above and "(text#" not in above
    got = {(r.doc_id, r.child_index, r.embed_text) for r in lines.collect()}
    assert got == {(1, 0, "s\none"), (1, 1, "s\ntwo"), (3, 0, "three")}


def test_strip_looks_at_the_ends_and_removes_what_python_removes(spark):
    odd = [chr(p) for p in range(0x10000) if not 0xD800 <= p <= 0xDFFF]
    rows = spark.createDataFrame([(f"{c}a{c} b{c}\n{c}",) for c in odd] + [("",), (" \n",), (None,)], "s string")
    got = rows.select("s", X.strip(F.col("s")).alias("t"))
    assert all(r.t == (None if r.s is None else r.s.strip()) for r in got.collect())
    assert "regexp" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_best_rows_of_many_batches_are_those_of_all(spark):
    rng = np.random.default_rng(3)
    scores = rng.integers(0, 60, size=(4, 3000)) / 7.0
    scores[1, ::3] = np.nan
    scores[2, 5:] = -np.inf
    scores[3] = np.sort(scores[3])
    ids = rng.permutation(3000)
    best = TaskTopK(6, "id")
    for lo in range(0, 3000, 250):
        best.offer(scores[:, lo : lo + 250].copy(), pa.table({"id": ids[lo : lo + 250]}))
    got = list(zip(*(best.table.column(c).to_pylist() for c in ("_query", "id", "_score"))))
    want = []
    for q, row in enumerate(np.round(scores, 9)):
        some = sorted((-s, i) for s, i in zip(row, ids) if np.isfinite(s))[:6]
        want += [(q, i, -s) for s, i in some]
    assert got == want


def test_passages_are_tokenised_once(spark):
    texts = [(i, i % 3, f"alpha {'beta ' * (i % 4)}gamma{i}" if i % 5 else None) for i in range(40)]
    chunks = spark.createDataFrame(texts, "chunk_id bigint, doc_id bigint, embed_text string").repartition(5)
    asked = spark.createDataFrame([(1, "beta alpha", None), (2, "gamma7", "1"), (3, "nowhere", None)], "qid bigint, q string, doc_filter string")
    found = lexical.bm25_topk(chunks, asked, k=4, carry=("chunk_id",))
    assert "regexp_extract_all" not in found._jdf.queryExecution().optimizedPlan().toString()
    n, lengths = 40, [len((t or "").split()) for _, _, t in texts]
    mean, want = sum(lengths) / n, []
    for qid, words, only in ((1, ["alpha", "beta"], None), (2, ["gamma7"], 1)):
        scored = []
        for (i, doc, t), dl in zip(texts, lengths):
            total = 0.0
            for w in words:
                df = sum(w in (u or "").split() for _, _, u in texts)
                idf = np.log((n - df + 0.5) / (df + 0.5))
                tf = (t or "").split().count(w)
                total += max(idf, 0) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean)) if idf > 0 else 1e-6 * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean))
            if total > 0 and only in (None, doc):
                scored.append((-round(total, 9), i))
        want += [(qid, i, pytest.approx(-s, abs=2e-9)) for s, i in sorted(scored)[:4]]
    assert [(r.qid, r.chunk_id, r.score) for r in found.orderBy("qid", "rank").collect()] == want


def test_term_rows_give_rows_and_frequencies(spark):
    rows = [(1, ["a", "b", "a"]), (2, ["c"]), (3, None), (4, []), (5, ["b"]), (5, ["b"])]
    tokens = spark.createDataFrame(rows, "doc_id bigint, terms array<string>").repartition(3)
    found, df = lexical.term_rows(tokens, ["a", "b", "x"], "doc_id")
    assert sorted((r.doc_id, r.units) for r in found.collect()) == [(1, [0, 1]), (5, [1]), (5, [1])]
    assert df == [1, 3, 0]


def test_items_are_found_word_for_word(spark):
    texts = [(1, "say the quick brown fox now"), (2, "quick fox brown"), (3, None), (4, "xthe quick brown foxy"), (4, "brown"), (5, "ab")]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    items = spark.createDataFrame([(7, "the quick brown fox"), (8, "b"), (9, "no such words here"), (10, None)], "qid bigint, q string")
    got = sorted((r.qid, r.doc_id) for r in scoring._containing(docs, items.where("q IS NOT NULL")).distinct().collect())
    assert got == [(7, 1), (7, 4), (8, 1), (8, 2), (8, 4), (8, 5)]


def test_all_modes_of_an_evaluation_fetch_parents_from_the_candidates(spark, monkeypatch):
    texts = [(f"c{i}", f"p{i}", f"word{i} shared text number {i}") for i in range(60)]
    children = spark.createDataFrame([(c, p, p, t) for c, p, t in texts], "chunk_id string, parent_id string, doc_id string, embed_text string")
    parents = spark.createDataFrame(
        [(p, t, "H", p, "abc", 0, 0, 0, len(t)) for _, p, t in texts],
        "parent_id string, text string, heading_path string, source_path string, file_sha256 string, "
        "page_start int, page_end int, start_char int, end_char int")
    corpus = retrieval.Corpus(children.withColumn("vector", hash_vector(F.col("embed_text"))), parents)
    golden = spark.createDataFrame(
        [(1, "word3", "p3", "word3", "word3", "lexical"), (2, "word9", None, None, "word9", "unanswerable")],
        "qid bigint, q string, doc_id string, must_contain string, expect string, kind string")
    reads = []
    lookup = retrieval.Corpus.lookup

    def counted(self, rows, key, wanted):
        reads.append((key, self.parents is parents))
        return lookup(self, rows, key, wanted)

    monkeypatch.setattr(retrieval.Corpus, "lookup", counted)
    scores, tau, answers = api.evaluate(corpus, golden)
    assert reads.count(("parent_id", True)) == 1 and corpus.tau == tau == 1.0
    monkeypatch.undo()
    for mode, answer in answers.items():
        alone = retrieval.retrieve(corpus, golden.select("qid", "q"), mode).hits
        assert sorted(map(tuple, alone.collect())) == sorted(map(tuple, answer.hits.collect()))
