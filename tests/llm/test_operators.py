"""The operators against plain versions, on small tables with nulls, ties, repeats and odd columns."""

from __future__ import annotations

import collections
import hashlib
import math
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from passagemill.llm import (
    chat, decontaminate, language, licenses, maxent, ngram_join, permutations, sentence_pieces, token_counts, warc,
)
from passagemill.llm.common import crc_fold

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_tokens string, label string, node string, id string"


def table(spark, texts, langs=None):
    """Documents with columns whose names the operators use inside."""
    rows = [(i, t, langs[k] if langs else None, None, None, "x", "y", "z", "w") for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


TEXTS = [
    (0, None), (1, ""), (2, " \n "), (3, "one"), (4, "one"), (5, "The quick brown fox jumps over the lazy dog again"),
    (6, "the QUICK brown fox jumps over the lazy dog again"), (7, "été über ▁ naïve 日本 😀 \\ </s>"), (8, "a b c d e f " * 3000),
    (8, "a b c d e f " * 3000), (None, "no id"), (9, "x" * 5000),
]


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, TEXTS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return table(spark, [])


def test_limits_follow_from_all_lengths(spark, docs, empty):
    lengths = sorted(r.n_tokens for r in token_counts.document_lengths(docs).collect())
    encode = token_counts.encoding(token_counts.vocabulary_bytes()).encode_ordinary
    assert lengths == sorted(len(encode(t or "")) for _, t in TEXTS)
    rows = token_counts.context_limits(token_counts.length_histogram(docs)).collect()
    assert sorted(r.context_limit for r in rows) == sorted(set(lengths))
    for r in rows:
        assert r.truncated_tokens == sum(min(n, r.context_limit) for n in lengths)
        assert r.docs_over == sum(n > r.context_limit for n in lengths)
        assert r.quantile == pytest.approx(sum(n <= r.context_limit for n in lengths) / len(lengths))
    assert token_counts.context_limits(token_counts.length_histogram(empty)).count() == 0


def test_pieces_are_reproducible_and_lossless(spark, docs, empty):
    first = sentence_pieces.encode(docs)
    again = sentence_pieces.encode(docs.repartition(5))
    key = lambda df: sorted((str(r.doc_id), r.pieces) for r in df.collect())
    assert key(first) == key(again)
    back = sorted((str(r.doc_id), r.text) for r in sentence_pieces.decode(first).collect())
    assert [t for _, t in back] == [t for _, t in sorted(((str(i), t) for i, t in TEXTS), key=lambda x: (x[0], x[1] or ""))]
    assert all(r.lossless for r in sentence_pieces.round_trip(docs).collect())
    assert sentence_pieces.round_trip(empty).count() == 0


def test_draws_follow_the_lattice():
    """Frequencies of the segmentations of one short word against all of them, enumerated."""
    with open(sentence_pieces.MODEL, "rb") as f:
        v = sentence_pieces.pieces(f.read(), 0.5)
    names = {}
    for i, raw in enumerate(v.decoded):
        if math.isfinite(v.weight[i]):
            names[raw.decode().replace(" ", "▁")] = i
    word, found = "▁then", []

    def walk(at, ids, weight):
        if at == len(word):
            found.append((tuple(ids), weight))
        for end in range(at + 1, len(word) + 1):
            if word[at:end] in names:
                i = names[word[at:end]]
                walk(end, [*ids, i], weight + v.weight[i])

    walk(0, [], 0.0)
    total = sum(math.exp(w) for _, w in found)
    n = 20000
    ids, counts = sentence_pieces.sample(v, ["then"] * n, np.arange(n, dtype=np.uint64))
    ends = np.cumsum(counts)
    seen = collections.Counter(tuple(x.tolist()) for x in np.split(ids, ends[:-1]))
    assert set(seen) <= {s for s, _ in found}
    for s, w in found:
        assert seen[s] / n == pytest.approx(math.exp(w) / total, abs=0.015)


def test_language_model_base_is_exact_and_score_is_a_probability(spark, docs, empty):
    learn = ~crc_fold("doc_id", 7, 2)
    got = sorted(maxent.score(docs, learn).collect(), key=lambda r: (str(r.doc_id), r.n_tokens))
    split = lambda t: (t or "").encode().lower().split() + [None]
    counts = collections.Counter()
    for i, t in TEXTS:
        if i is None or zlib.crc32(str(i).encode()) % 7 != 2:
            counts.update(split(t))
    n, v = sum(counts.values()), len(counts)
    want = sorted(((i, split(t)) for i, t in TEXTS), key=lambda x: (str(x[0]), len(x[1])))
    for r, (i, words) in zip(got, want, strict=True):
        assert (r.doc_id, r.n_tokens, r.train_tokens) == (i, len(words), n)
        assert r.n_known == sum(counts[w] > 0 for w in words)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words))
        assert r.score < 0
    assert maxent.score(empty, learn).count() == 0
    assert maxent.score(docs, F.lit(False)).where("n_known > 0").count() == 0


def _facts(words, counts):
    order = np.argsort(words)
    return maxent.Facts(
        int(counts.sum()), len(words), int((counts == 1).sum()), words[order], np.arange(len(words))[order], np.zeros(maxent.FAN**3, dtype=np.int64)
    )


def test_language_model_gradients_equal_finite_differences():
    rng = np.random.default_rng(3)
    words = rng.integers(1, 1 << 62, size=60).astype(np.uint64)
    words[0] = maxent.END
    words.sort()
    numbers = rng.integers(0, 60, size=200)
    facts = _facts(words, np.bincount(numbers, minlength=60))
    history = maxent.Histories(numbers, words, np.array([120, 80]))
    leaf = facts.leaves(words, np.zeros(60, dtype=np.int32))
    for level in range(facts.depth):
        rows, goal = maxent.rows_of(history.features(np.arange(200)), leaf[numbers], facts, level)
        table = rng.normal(size=(facts.rows + maxent.FAN**level, maxent.FAN))

        def loss(t, rows=rows, goal=goal):
            z = t[rows].sum(axis=1)
            return (np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(goal)), goal]).sum()

        name, times, total = maxent.gradient(table, rows, goal)
        assert times.sum() == rows.size and len(set(name.tolist())) == len(name)
        for k in (0, len(name) // 2, len(name) - 1):
            for klass in (0, 7, int(goal[0])):
                up, down = table.copy(), table.copy()
                up[name[k], klass] += 1e-5
                down[name[k], klass] -= 1e-5
                assert total[k, klass] == pytest.approx((loss(up) - loss(down)) / 2e-5, abs=1e-4)


def test_language_model_equals_a_plain_walk_and_sums_to_one(spark, monkeypatch):
    """Scores by dictionaries from the trained tables, over all tokens that may follow; and by one pass for each softmax."""
    rng = np.random.default_rng(11)
    texts = [(i, " ".join(f"w{int(x)}" for x in rng.zipf(1.5, size=int(rng.integers(1, 30))) % 40)) for i in range(80)] + [(900, None)]
    docs, learn = table(spark, texts).coalesce(1), ~crc_fold("doc_id", 7, 2)
    blocks = maxent._written(maxent.encode(docs, learn, "doc_id", "text").withColumn("block", F.lit(0).cast("long")))
    _, facts = maxent._corpus_counts(blocks)
    weights = maxent.train(blocks, facts, [0, 1, 2])
    hash_of = lambda w: maxent.tokenise([w])[0][0] if w else maxent.END
    split = lambda t: [*(t or "").encode().split(), None]
    counts = collections.Counter(w for i, t in texts if zlib.crc32(str(i).encode()) % 7 != 2 for w in split(t))
    known = list(counts)
    tails = np.array([maxent.tokenise([w])[1][0] if w else 0 for w in known])
    leaf = dict(zip(known, facts.leaves(np.array([hash_of(w) for w in known]), tails)))
    mass = collections.Counter()
    for w in known:
        mass[leaf[w]] += counts[w]
    assert facts.tokens == sum(counts.values()) and facts.single == sum(c == 1 for c in counts.values())

    def p(a, b, w):
        if w not in counts:
            return facts.unknown / (facts.single + 1)
        vocabulary = np.array(sorted({maxent.END, hash_of(a), hash_of(b), np.uint64(7)}))
        at = [int(np.searchsorted(vocabulary, hash_of(x))) for x in (a, b)]
        history = maxent.Histories(np.array([*at, 0]), vocabulary, np.array([3]))
        h = history.features(np.array([2]))
        out = (1 - facts.unknown) * counts[w] / mass[leaf[w]]
        for level in range(facts.depth):
            rows, goal = maxent.rows_of(h, np.array([leaf[w]]), facts, level)
            z = weights[level][rows[0]].astype(float).sum(axis=0)
            out *= np.exp(z[goal[0]]) / np.exp(z).sum()
        return out

    for passes in (128 << 20, 1):
        monkeypatch.setattr(maxent, "PASS_BYTES", passes)
        assert len(facts.passes()) == (1 if passes > 1 else facts.depth)
        for r in maxent.score(docs, learn).collect():
            words = [None, None, *split(dict(texts)[r.doc_id])]
            assert r.score == pytest.approx(sum(math.log10(p(a, b, w)) for a, b, w in zip(words, words[1:], words[2:])), rel=1e-4)
    # Over all paths of classes, a leaf without a token included, each softmax sums to one.
    for a, b in ((None, None), (None, b"w1"), (b"w1", b"w2"), (b"w1", b"unknown"), (b"unknown", b"unknown")):
        one = sum(p(a, b, w) for w in known)
        vocabulary = np.array(sorted({maxent.END, hash_of(a), hash_of(b)}))
        at = [int(np.searchsorted(vocabulary, hash_of(x))) for x in (a, b)]
        h = maxent.Histories(np.array([*at, 0]), vocabulary, np.array([3])).features(np.array([2]))
        leaves = np.arange(maxent.FAN**facts.depth)
        paths = np.ones(len(leaves))
        for level in range(facts.depth):
            rows, goal = maxent.rows_of(np.repeat(h, len(leaves), axis=0), leaves, facts, level)
            paths *= maxent.softmax(weights[level], rows)[np.arange(len(leaves)), goal]
        assert paths.sum() == pytest.approx(1, rel=1e-4)
        empty = paths[[k for k in leaves if k not in mass]].sum()
        assert one + (1 - facts.unknown) * empty + facts.unknown == pytest.approx(1, rel=1e-4)


def test_language_model_tells_any_two_words_apart_by_their_history(spark):
    filler = " ".join(f"f{k}" for k in range(200))  # more words than any fixed number of frequent ones had room for
    texts = [(i, filler) for i in range(8)] + [(10 + i, "red mapple") for i in range(4)] + [(20 + i, "blue dimple") for i in range(4)]
    texts += [(30, "red mapple"), (31, "red dimple"), (32, "blue dimple"), (33, "blue mapple")]
    rows = {r.doc_id: r for r in maxent.score(table(spark, texts), F.col("doc_id") < 30).collect()}
    assert rows[30].base_score == pytest.approx(rows[31].base_score)
    assert rows[30].score > rows[31].score + 0.3 and rows[32].score > rows[33].score + 0.3


def test_licence_phrases_and_expressions(spark, docs, empty):
    raw = b"Under the MIT\n  License. Apache--License!\nSPDX-License-Identifier: (GPL-2.0 OR MIT) AND Apache-2.0 WITH exc-1\n"
    n_words, n_base, first, last, base, labels, expressions, permissive, score = licenses.scan_text(raw)
    words = raw.translate(licenses._FOLD).split()
    places = [k for k in range(len(words) - 1) for p in licenses.BASE if words[k : k + len(p.split())] == p.encode().split()]
    assert (n_words, n_base, first, last, base) == (len(words), len(places), min(places), max(places), "apache,mit")
    assert expressions == ["gpl-2.0 mit or apache-2.0 exc-1 with and"] and permissive and score > 0.9
    assert labels == "apache,apache-2.0,gpl-2.0,mit"
    for bad in ("mit or", "( mit", "mit )", "and mit", "mit mit"):
        assert licenses.parse_expression(bad.split()) is None
    rows = {(r.doc_id, r.n_words): r for r in licenses.scan(docs).collect()}
    assert rows[(0, 0)].labels == "" and rows[(0, 0)].score == 0
    assert licenses.scan(empty).count() == 0


def test_many_licence_phrases_in_one_text_take_linear_time():
    raw = b"the mit license general public license apache license word " * 20_000
    began = time.monotonic()
    found = licenses.scan_text(raw)
    assert time.monotonic() - began < 10
    words = raw.split()
    phrases = [p.encode().split() for p in licenses.BASE]
    places = [k for k in range(len(words)) for p in phrases if words[k : k + len(p)] == p]
    assert found[:4] == (len(words), len(places), min(places), max(places)) and found[4] == "apache,gpl,mit"


def test_neighbours_are_found_and_ordered(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 16)).astype(np.float32)
    x[50:60] = x[40]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    rows += [(1000, None, 0), (1001, [0.0] * 16, 0), (1002, [float("nan")] * 16, 0), (1003, [1.0], 0), (None, x[0].tolist(), 0)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, b int")
    found = permutations.search(vectors, vectors.where("vec_id % 20 = 0"), k=20, block=150)
    by = collections.defaultdict(list)
    for r in found.collect():
        by[r.query_id].append(r)
    hits = 0
    for q in range(0, 400, 20):
        exact = (x.astype(float) * x[q].astype(float)).sum(axis=1)
        best = sorted((i for i in range(400) if i != q), key=lambda i: (-exact[i], i))[:20]
        mine = sorted(by[q], key=lambda r: r.rank)
        assert [r.rank for r in mine] == list(range(1, 21))
        assert [r.vec_id for r in mine] == sorted((r.vec_id for r in mine), key=lambda i: (-exact[i], i))
        assert all(r.score == exact[r.vec_id] for r in mine)
        hits += len({r.vec_id for r in mine} & set(best))
    assert set(by) == set(range(0, 400, 20)) and hits >= 0.9 * 20 * 20
    assert permutations.search(vectors.limit(0), vectors.limit(0)).count() == 0
    few = vectors.where("vec_id < 3")
    assert permutations.search(few, few.where("vec_id = 0")).count() == 2


def test_an_id_with_many_rows_takes_one_place_among_the_neighbours(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(500, x[0].tolist())] * 200  # copies of one row
    rows += [(501, (x[20] + 0.01 * rng.normal(size=16)).tolist()) for _ in range(300)]  # different vectors of one id
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    found = collections.defaultdict(dict)
    for r in permutations.search(vectors, vectors.where("vec_id % 20 = 0"), k=20, block=10_000, share=1.0).collect():
        assert r.vec_id not in found[r.query_id]
        found[r.query_id][r.vec_id] = (r.rank, r.score)
    best = collections.defaultdict(dict)
    for q in range(0, 300, 20):
        for i, v in rows:
            if i != q:
                best[q][i] = max(best[q].get(i, -math.inf), float((np.array(v) * x[q]).sum()))
        want = sorted(best[q], key=lambda i: (-best[q][i], i))[:20]
        assert [i for i, _ in sorted(found[q].items(), key=lambda f: f[1][0])] == want
        assert all(s == pytest.approx(best[q][i]) for i, (_, s) in found[q].items())
    for blocks in (50, 200):  # the usual share, over several blocks
        few = permutations.search(vectors, vectors.where("vec_id in (0, 20)"), k=20, block=blocks)
        assert sorted(r["count"] for r in few.groupBy("query_id").count().collect()) == [20, 20]


def test_chat_reads_back_what_was_said(spark):
    own = "</s>[INST] ok [/INST]"
    rows = [
        (1, 0, "user", own), (1, 1, "assistant", own), (2, 0, "user", None), (2, 1, None, "\\x <|turn|> \\\\"),
        (2, 1, "assistant", "a"), (2, 1, "assistant", "a"), (2, 2, "assistant", "<<s>é"), (None, None, "user", "z"),
    ]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("ids", F.lit(1))
    got = {r.conv_id: r for r in chat.read_back(chat.format_turns(frame)).collect()}
    by = collections.defaultdict(list)
    for c, t, role, text in rows:
        by[c].append((t if t is not None else -1, role or "", text or ""))
    for c, turns in by.items():
        turns.sort()
        said = "".join(text for _, role, text in turns if role == "assistant")
        digest = hashlib.sha256("".join(f"{role}\n{text}\n" for _, role, text in turns).encode()).hexdigest()
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars) == (len(turns), digest, len(said))
        assert got[c].loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
    for text in ("", "\\", "\\\\", own, "<<SYS>>", "<\\/s>", "<|turn|><|text|>", "[[INST]"):
        assert chat.unescape(chat.escape(text)) == text
        assert not any(mark in chat.escape(text) for mark in (*chat.MARKS, *chat.FOREIGN))
    assert chat.read_back(chat.format_turns(frame.limit(0))).count() == 0


def _brute_components(texts):
    sets = []
    for _, t in texts:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    parent = list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    least = {}
    for i, (name, _) in enumerate(texts):
        if name is not None:
            least[find(i)] = min(name, least.get(find(i), name))
    return [(name, len(sets[i]), least.get(find(i)) if sets[i] else name) for i, (name, _) in enumerate(texts)]


def test_components_equal_all_pairs(spark, docs, empty):
    rng = np.random.default_rng(3)
    vocabulary = [f"w{k}" for k in range(400)]
    texts = list(TEXTS)
    for group in range(12):
        base = rng.choice(vocabulary, size=int(rng.integers(20, 120))).tolist()
        for _ in range(12):
            copy = list(base)
            for _ in range(int(rng.integers(0, 5))):
                copy[int(rng.integers(len(copy)))] = str(rng.choice(vocabulary))
            texts.append((len(texts) + 100, " ".join(copy)))
    got = ngram_join.join(table(spark, texts).repartition(4))
    key = lambda rows: sorted(rows, key=str)
    assert key(tuple(r) for r in got.collect()) == key(_brute_components(texts))
    assert ngram_join.join(empty).count() == 0
    kept = ngram_join.keep_one(table(spark, texts))
    assert kept.columns == docs.columns
    alone = [r for r in _brute_components([(i, t) for i, (_, t) in enumerate(texts)]) if r[0] == r[2]]
    assert kept.count() == len(alone)


def test_all_links_between_different_texts_are_returned(spark, empty, monkeypatch):
    monkeypatch.setattr(ngram_join, "SLICE", 4)
    rng = np.random.default_rng(8)
    base = [f"w{k}" for k in range(90)]
    texts = [(0, " ".join(base)), (1, " ".join(base)), (2, None), (3, "alone")]
    for i in range(15):  # a group whose members link with most of each other
        copy = list(base)
        copy[int(rng.integers(90))] = f"own{i}"
        texts.append((10 + i, " ".join(copy)))
    members, links = ngram_join.linked(table(spark, texts).repartition(3))
    names = {r.doc_id: r for r in members.collect()}
    sets = {i: frozenset(tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)) for i, t in texts if t and len(t) > 9}
    want = {
        tuple(sorted((names[i]["class"], names[j]["class"]))) for i in sets for j in sets
        if sets[i] != sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])
    }
    got = [tuple(r) for r in links.collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 30
    assert names[0]["class"] == names[1]["class"] and names[2]["class"] is None and names[3].n_links == 0
    assert all(r.n_links == sum(r["class"] in pair for pair in want) for r in names.values())
    assert all(df.count() == 0 for df in ngram_join.linked(empty))


def test_benchmark_windows_equal_a_scan_of_all(spark, empty):
    rng = np.random.default_rng(5)
    vocabulary = [f"v{k}" for k in range(300)]
    items = [(k, " ".join(rng.choice(vocabulary, size=int(rng.integers(8, 40))))) for k in range(15)] + [(90, None), (91, "too short")]
    texts = list(TEXTS)
    for k in range(60):
        words = rng.choice(vocabulary, size=int(rng.integers(3, 90))).tolist()
        leak = items[k % 15][1].split()
        if k % 2:
            if k % 3 == 0:
                leak[0] = "changed"
            at = int(rng.integers(len(words)))
            words[at:at] = leak
        texts.append((100 + k, " ".join(words)))
    frame = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(table(spark, texts), frame).collect()}
    want = set()
    for name, t in texts:
        words = (t or "").lower().split()
        for item, passage in items:
            p = (passage or "").split()
            if len(p) < 5:
                continue
            b = collections.Counter(tuple(p[j : j + 5]) for j in range(len(p) - 4))
            for start in range(max(1, len(words) - len(p) + 1)):
                w = words[start : start + len(p)]
                a = collections.Counter(tuple(w[j : j + 5]) for j in range(len(w) - 4))
                if sum((a & b).values()) * 100 >= 80 * sum((a | b).values()) > 0:
                    want.add((name, item))
    assert got == want and len(want) >= 25
    kept = decontaminate.keep_clean(table(spark, texts), frame)
    assert {r.doc_id for r in kept.collect()} == {n for n, _ in texts} - {n for n, _ in want}
    assert decontaminate.contaminated(empty, frame).count() == 0
    assert decontaminate.contaminated(table(spark, texts), frame.limit(0)).count() == 0


def test_fingerprints_within_the_radius_are_all_found():
    rng = np.random.default_rng(0)
    items = [(k, " ".join(f"u{x}" for x in rng.integers(0, 500, size=20))) for k in range(50)]
    bench = decontaminate.prepare(items)
    for k in range(50):
        for bits in (0, 7, decontaminate.RADIUS):
            mask = sum(1 << int(b) for b in rng.choice(64, size=bits, replace=False))
            assert k in bench.near(int(bench.prints[k]) ^ mask)


def test_languages_are_told_apart(spark, data, docs, empty):
    rows = spark.read.parquet(f"{data}/documents.parquet")
    model = language.fit(rows, ~crc_fold("doc_id", 4, 2))
    found = language.identify(rows, model).join(rows.select("doc_id", "lang"), "doc_id").where(crc_fold("doc_id", 4, 2)).collect()
    assert sum(r.lang_pred == r.lang for r in found) >= 0.95 * len(found)
    odd = {(r.doc_id, r.lang_pred == "und") for r in language.identify(docs, model).collect()}
    assert {(0, True), (1, True), (2, True), (3, False)} <= odd
    assert language.identify(empty, model).count() == 0
    nothing = language.fit(docs, F.lit(True))  # no label is known
    assert {r.lang_pred for r in language.identify(docs, nothing).collect()} == {"und"}
    kept = language.keep_identified(docs, model)
    assert kept.columns == docs.columns and kept.where("doc_id in (0, 1, 2)").count() == 0


def _odd_text(rng):
    letters = rng.choice(list("bcdfghjklmnpqrstvwxz"), size=4, replace=False)
    return " ".join("".join(rng.choice(letters, size=6)) for _ in range(40))


def test_bounds_of_rejection_come_from_all_labelled_rows(spark):
    rng = np.random.default_rng(4)
    words = [["the", "quick", "fox", "runs", "over", "lazy", "dogs", "and", "barks"], ["el", "perro", "corre", "sobre", "una", "casa", "y", "ladra", "mucho"]]
    plain = lambda n, start: [(start + i, " ".join(rng.choice(words[i % 2], size=45))) for i in range(n)]
    texts = plain(2800, 0) + [(5000 + i, _odd_text(rng)) for i in range(6)]
    model = language.fit(table(spark, texts, ["ab"[i % 2] for i, _ in texts]), F.lit(True))  # each row is in the sample
    later = table(spark, texts + plain(400, 10_000) + [(20_000 + i, _odd_text(rng)) for i in range(40)])
    gone = [r.doc_id for r in language.identify(later, model).collect() if r.rejected]
    labelled = sum(i < 10_000 for i in gone)
    assert 0 < labelled <= language.REJECTED * len(texts)
    assert sum(10_000 <= i < 20_000 for i in gone) <= 0.02 * 400 and sum(i >= 20_000 for i in gone) >= 0.9 * 40


def test_a_quantile_is_taken_by_class_and_needs_enough_rows():
    counts = np.zeros((language.LENGTHS, language.BINS + 1), dtype=np.int64)
    counts[3, 100], counts[3, 200] = 1, 999
    counts[5, 50] = 3
    got = language.lowest(counts)
    assert got[:3] == [None] * 3 and got[3] == got[4] == 200 / language.BINS
    assert got[5] == 50 / language.BINS  # counted with the shorter ones: 2 of 1003 may lie below, 3 may not
    assert language.lowest(counts * 0) == [None] * language.LENGTHS


def test_archives_give_back_what_was_written(spark, tmp_path):
    long, short = "é" * 700, "s" * 999
    rows = [
        (1, "http://a/", long), (2, "http://b/ x", long), (3, None, long), (4, "u", short), (5, "u", short), (6, "u", None),
        (None, "n", long), (3, None, long), (7, "big", "".join(map(str, range(3_200_000)))),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("key", F.lit(0)).repartition(3)
    path = str(tmp_path / "archive")
    warc.write_archives(pages, path)
    got = collections.Counter(tuple(r) for r in warc.read_archives(spark, path).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect())
    want = collections.Counter()
    for page, _, html in rows:
        raw = (html or "").encode()
        target = 3 if html == long and page in (1, 2) else None
        want[(page, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if target else "response", target)] += 1
    assert got == want
    warc.write_archives(pages.limit(0), str(tmp_path / "none"))
    assert warc.read_archives(spark, str(tmp_path / "none")).count() == 0
    record = warc.build_record(1, "u", b"abc", hashlib.sha1(b"abc").hexdigest(), None)
    with pytest.raises(warc.FormatError):
        warc.parse_record(record.replace(b"abc", b"abd"))
    with pytest.raises(warc.FormatError):
        list(warc.members(memoryview(warc.member(record)[:-20])))


def test_one_of_each_group_stays_with_all_its_columns(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(5, text, 1, "a"), (3, text + " end", 2, "b"), (9, "something else entirely here now", 3, "c"), (None, "", 4, "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _row long, _ROW_ string")
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect()), key=str) == sorted(rows[1:], key=str)
