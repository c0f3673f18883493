"""Block-max postings against the scan of all passages."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from passagemill.operators import postings
from passagemill.operators.lexical import PhraseTree, bm25_topk

ASK = "qid bigint, q string, doc_filter string"


def _chunks(spark, topics=6, each=60):
    """Passages in runs of one topic, so that ranges differ, with repeats for ties and empty ones."""
    rng = random.Random(7)
    rows = []
    for t in range(topics):
        for i in range(each):
            own = [f"t{t}w{rng.randint(0, 12)}" for _ in range(rng.randint(1, 20))]
            shared = [f"s{int(rng.paretovariate(0.7)) % 30}" for _ in range(rng.randint(0, 15))]
            words = own + shared
            rng.shuffle(words)
            rows.append((f"c{len(rows):04}", f"d{len(rows) // 5}", f"p{len(rows) // 2}", " ".join(words)))
    rows += [(f"x{i}", "d0", "p0", rows[3][3]) for i in range(25)] + [("z0", "d1", "p1", ""), ("z1", "d1", "p1", "... !"), ("z2", "d1", "p1", None)]
    return spark.createDataFrame(rows, "chunk_id string, doc_id string, parent_id string, embed_text string").coalesce(2)


ASKED = [
    (0, "t0w1 t0w2", None), (1, "s1", None), (2, "s1 s2 t3w4 t3w4", None), (3, "t1w1_s1 s3", None), (4, "absent", None),
    (5, "s1 s2 s3 t2w2", "d25"), (6, "t5w1 t0w1", ""), (7, "s1_s1 t4w3_t4w1_s2", None), (8, "!!", None), (9, "t0w1", "nowhere"),
]


def _rows(df):
    return sorted((r.qid, r["rank"], r.chunk_id, r.parent_id, round(r.score, 7)) for r in df.collect())


@pytest.mark.parametrize("most", [16, 4096])
def test_search_equals_the_scan(spark, most):
    chunks = _chunks(spark)
    asked = spark.createDataFrame(ASKED, ASK)
    want = _rows(bm25_topk(chunks, asked, 7))
    assert want and _rows(postings.search(postings.of_chunks(chunks, most=most), asked, 7)) == want


def test_batches_of_any_size_have_one_plan_and_equal_answers(spark):
    chunks = _chunks(spark, 3, 30)
    made = postings.of_chunks(chunks, most=32)
    texts = [" ".join(f"t{i % 3}w{(i * k) % 13}" for k in (1, 3)) + f" s{i % 9}" for i in range(2049)]
    plans, answers = [], []
    for n in (33, 2049):
        asked = spark.createDataFrame([(i, q, None) for i, q in enumerate(texts[:n])], ASK)
        found = postings.search(made, asked, 5)
        plans.append(found._jdf.queryExecution().executedPlan().toString().count("FlatMapCoGroups"))
        answers.append([r for r in _rows(found) if r[0] < 33])
        if n == 33:
            assert answers[0] == _rows(bm25_topk(chunks, asked, 5))
    assert plans[0] == plans[1] and answers[0] == answers[1]


def test_ranges_below_the_floor_stay_closed(spark):
    made = postings.of_chunks(_chunks(spark), most=30)
    asked = spark.createDataFrame([(t, f"t{t}w1 t{t}w2 t{t}w3 s1", None) for t in range(6)], ASK)
    opened, pairs = postings.opened_share(made, asked, 5)
    assert 0 < opened < 0.6 * pairs
    plan = postings.search(made, asked, 5)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(qid" in plan and "chunk_id" not in plan.split("hashpartitioning(qid")[1].split(")")[0]


def test_superseded_passages_leave_postings(spark):
    chunks = _chunks(spark, 3, 40)
    made = postings.of_chunks(chunks, most=50)
    dead = spark.createDataFrame([("d2", 1), ("d9", 1), ("d11", 2)], "doc_id string, dead int")
    left = postings.without(made, dead, F.lit(1))
    rest = chunks.where("doc_id NOT IN ('d2', 'd9')")
    asked = spark.createDataFrame(ASKED, ASK)
    assert _rows(postings.search(left, asked, 9)) == _rows(bm25_topk(rest, asked, 9))
    assert postings.without(made, dead.where("dead = 2"), F.lit(1)) is made


def test_nothing_stored_or_asked(spark):
    chunks = _chunks(spark, 1, 5)
    asked = spark.createDataFrame(ASKED, ASK)
    assert postings.search(postings.of_chunks(chunks.limit(0)), asked, 5).count() == 0
    assert postings.search(postings.of_chunks(chunks), asked.limit(0), 5).count() == 0


def test_tops_are_what_no_other_pair_beats():
    rng = np.random.default_rng(2)
    code = np.sort(rng.integers(0, 9, 300))
    tf, dl = rng.integers(1, 6, 300), rng.integers(1, 40, 300)
    got_tf, got_dl, begin = postings.frontier(code, tf, dl)
    ends = [*begin[1:], len(got_tf)]
    for k, c in enumerate(np.unique(code)):
        pairs = set(zip(tf[code == c].tolist(), dl[code == c].tolist()))
        best = {p for p in pairs if not any(o != p and o[0] >= p[0] and o[1] <= p[1] for o in pairs)}
        assert set(zip(got_tf[begin[k] : ends[k]].tolist(), got_dl[begin[k] : ends[k]].tolist())) == best


def test_superseded_passages_are_taken_out_once_per_range(spark):
    chunks = _chunks(spark, topics=2)
    stored = postings.of_chunks(chunks, most=16)
    dead = spark.createDataFrame([("d0", 7), ("d3", 7), ("d4", 6)], "doc_id string, dead bigint")
    live = postings.without(stored, dead, F.lit(7).cast("bigint"))
    # No block carries the lengths of its whole range: they meet once, in the task of the range.
    plan = live.blocks._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "MapInArrow run" not in plan and "MapInArrow drop" not in plan
    key = ["chunk_id", "term", "tf", "dl", "positions"]
    kept = postings.of_chunks(chunks.where("doc_id NOT IN ('d0', 'd3')"), most=16)
    assert sorted(map(str, postings.posting_rows(live).select(key).collect())) == sorted(map(str, postings.posting_rows(kept).select(key).collect()))
    terms = spark.createDataFrame([("s1",), ("t0w1",), ("absent",)], "term string")
    some = live.of_terms(terms).select("range", "term", "n", "tops", "at", "tf", "positions")
    assert sorted(map(str, some.collect())) == sorted(map(str, live.blocks.where("term IN ('s1', 't0w1', 'absent')").select(some.columns).collect()))
    assert live.stats()[0] == kept.stats()[0]


def test_a_tree_of_phrases_finds_what_each_phrase_alone_finds():
    rng = np.random.default_rng(3)
    code, row = rng.integers(-1, 4, 600), np.sort(rng.integers(0, 60, 600))
    phrases = list(dict.fromkeys(tuple(int(x) for x in rng.integers(0, 4, n)) for n in (2, 2, 3, 3, 3, 4, 5, 2, 3)))
    number, at = PhraseTree(list(enumerate(map(list, phrases))), 4).find(code, row)
    wanted = sorted(
        (u, row[i]) for u, p in enumerate(phrases) for i in range(len(code) - len(p) + 1)
        if tuple(code[i : i + len(p)]) == p and row[i] == row[i + len(p) - 1])
    assert sorted(zip(number.tolist(), at.tolist())) == wanted
    assert not len(PhraseTree([], 4).find(code, row)[0])


def test_phrases_of_a_range_are_matched_in_one_task(spark):
    left = pa.table({
        "range": ["r", "r"], "term": ["a", "b"], "at": [[0, 2], [0, 1, 2]], "tf": [[2, 1], [1, 1, 2]],
        "positions": [[0, 1, 5], [2, 0, 4, 6]]})
    right = pa.table({"of": ["r"] * 4, "unit": ["a b", "a a", "b b", "a c"], "phrase": [["a", "b"], ["a", "a"], ["b", "b"], ["a", "c"]]})
    found = postings._match(left, right).sort_by("unit").to_pylist()
    assert [(r["unit"], r["n"], r["at"], r["tf"], r["tops"][0]["tf"]) for r in found] == [("a a", 1, [0], [1], 1), ("a b", 2, [0, 2], [1, 1], 1)]
