"""Evaluation, presentation and index-maintenance queries."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagemill import api
from passagemill.functions import text as X
from passagemill.functions.hashing import content_id, hash_vector, text_hash
from passagemill.operators import evaluation, fusion, ingest, lexical, packaging, postings, retrieval
from passagemill.operators.cache import known, of_rows
from passagemill.operators.index import orphans
from passagemill.operators.topk import cut_lineage, query_slices, union_all
from passagemill.plans import common as C
from passagemill.plans import search as P
from passagemill.schemas import LIMITS, Limits

QUERIES = {}
SQL = {}


def _add(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return keep


# --- the golden set ---------------------------------------------------------------------


def _containing(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Pairs (qid, doc_id) where the document holds the item's text word for word.

    A text that contains an item contains each of its inner words whole, so the
    rarest inner word is an exact join key; only its few documents are searched.
    Items too short to have an inner word are looked for row by row instead.
    """
    words = items.withColumn("terms", X.index_terms(F.col("q")))
    inner = words.where(F.size("terms") > 2).select(
        "qid", "q", F.explode(F.array_distinct(F.slice("terms", F.lit(2), F.size("terms") - 2))).alias("term")
    )
    # The words of a batch of items, counted by task and written without the others, so that texts are tokenised once.
    terms = sorted(r.term for r in inner.select("term").distinct().collect())
    tokens = docs.select("doc_id", X.index_terms(F.col("text")).alias("terms"))
    rows, df = lexical.term_rows(tokens, terms, "doc_id")
    frequency = items.sparkSession.createDataFrame(
        pa.table({"term": pa.array(terms, pa.string()), "unit": pa.array(range(len(terms)), pa.int32()), "df": pa.array(df, pa.int64())})
    )
    rarest = cut_lineage(
        inner.join(F.broadcast(frequency), "term")
        .groupBy("qid", "q")
        .agg(F.min_by("unit", F.struct("df", "term")).alias("unit"))
    )
    units = rows.select("doc_id", F.explode("units").alias("unit"))
    pairs = cut_lineage(units.join(F.broadcast(rarest), "unit").select("qid", "q", "doc_id"))
    found = docs.join(F.broadcast(pairs) if _few(pairs) else pairs, "doc_id").where(F.col("text").contains(F.col("q")))
    short = [(r.qid, r.q) for r in words.where(F.size("terms") <= 2).select("qid", "q").collect()]
    out = found.select("qid", "doc_id")
    if short:
        held = F.array(*[F.when(F.col("text").contains(q), F.lit(qid)) for qid, q in short])
        rows = docs.select(F.explode(held).alias("qid"), "doc_id").where(F.col("qid").isNotNull())
        out = out.unionByName(rows)
    return out


def _few(pairs: DataFrame, most: int = 100_000) -> bool:
    return pairs.limit(most + 1).count() <= most


def golden(spark: SparkSession, sf: str) -> DataFrame:
    """Benchmark items as a golden set: answerable by the first document that holds them."""
    docs = C.documents(spark, sf, "doc_id", "text", "lang")
    items = C.queries(spark, sf).select("qid", "q")
    pairs = union_all([_containing(docs, part) for part in query_slices(items)])
    first = pairs.groupBy("qid").agg(F.min("doc_id").alias("doc_id"))
    lang = docs.select("doc_id", "lang").join(F.broadcast(first), "doc_id")
    return cut_lineage(items.join(lang, "qid", "left").select(
        "qid", "q", F.col("doc_id").cast("string").alias("doc_id"),
        F.when(F.col("doc_id").isNotNull(), F.col("q")).alias("must_contain"),
        F.substring_index("q", " ", 1).alias("expect"),
        F.when(F.col("doc_id").isNull(), "unanswerable").when(F.col("lang") == "en", "lexical").otherwise("semantic").alias("kind"),
    ))


@_add("golden_set", C.sql("SELECT qid, doc_id, must_contain, kind FROM golden", "golden"))
def golden_set(spark: SparkSession, sf: str) -> DataFrame:
    return golden(spark, sf).select("qid", "doc_id", "must_contain", "kind")


def _timings(spark: SparkSession, sf: str, asked: DataFrame) -> DataFrame:
    """Latencies taken from the events table: one value per query and mode."""
    modes = F.array(*[F.struct(F.lit(m).alias("mode"), F.lit(i).alias("i")) for i, m in enumerate(P._RANKED)])
    rows = asked.select("qid", F.explode(modes).alias("m"))
    events = C.table(spark, sf, "events").select("event_id", F.col("value").alias("ms"))
    return rows.withColumn("event_id", F.col("qid") * 5 + F.col("m.i")).join(events, "event_id").select(
        "qid", F.col("m.mode").alias("mode"), "ms"
    )


for _name, (_ranked, _needs) in P._RANKED.items():
    C.CTES[f"ranked_{_name}"] = (_needs, _ranked) if _name != "cascade" else (
        ("cascade_fitted",), "SELECT * FROM cascade_fitted")
C.CTES["all_hits"] = (tuple(f"ranked_{m}" for m in P._RANKED), " UNION ALL ".join(
    f"SELECT '{m}' AS mode, qid, rank, parent_id, child_id, score, confident FROM ranked_{m}" for m in P._RANKED))
C.CTES["mode_name"] = ((), "SELECT * FROM (VALUES " + ", ".join(f"('{m}', {i})" for i, m in enumerate(P._RANKED)) + ") t(mode, i)")
C.CTES["abstained"] = (("slow", "tau_row"), """
    SELECT DISTINCT qid FROM slow WHERE top < (SELECT tau FROM tau_row)""")
C.CTES["graded"] = (("all_hits", "parent", "golden", "mode_name", "abstained"), """
    SELECT g.qid, m.mode, m.i, kind, must_contain IS NOT NULL AS answerable,
           CASE WHEN first_rank <= 5 THEN 1.0::DOUBLE ELSE 0 END AS hit, coalesce(1.0::DOUBLE / first_rank, 0) AS reciprocal,
           CASE WHEN m.mode = 'cascade' AND g.qid IN (SELECT qid FROM abstained) THEN 1.0::DOUBLE ELSE 0 END AS abstained
    FROM golden g CROSS JOIN mode_name m LEFT JOIN (
        SELECT h.qid, h.mode, min(h.rank) AS first_rank FROM all_hits h JOIN parent p USING (parent_id) JOIN golden x ON x.qid = h.qid
        WHERE x.must_contain IS NOT NULL AND contains(p.text, x.must_contain) AND p.source_path = x.doc_id
        GROUP BY h.qid, h.mode) f ON f.qid = g.qid AND f.mode = m.mode""")
C.CTES["scored"] = (("graded",), """
    SELECT mode, CASE WHEN grouping(kind) = 1 THEN 'all' ELSE kind END AS kind,
           coalesce(avg(hit) FILTER (answerable), 0) AS recall, coalesce(avg(reciprocal) FILTER (answerable), 0) AS mrr,
           avg(abstained) AS abstain, count(*) AS n, coalesce(quantile_disc(value, 0.5), 0) AS p50
    FROM graded LEFT JOIN events ON event_id = qid * 5 + i GROUP BY GROUPING SETS ((mode), (mode, kind))""")


def _scores(spark: SparkSession, sf: str):
    asked = golden(spark, sf)
    return api.evaluate(C.corpus(spark, sf), asked, timings=_timings(spark, sf, asked))


@_add("eval_rollup", C.sql("""
    SELECT mode, kind, round(recall, 9) AS recall, round(mrr, 9) AS mrr, round(abstain, 9) AS abstain, n, p50 FROM scored""", "scored"))
def eval_rollup(spark: SparkSession, sf: str) -> DataFrame:
    scores, _, _ = _scores(spark, sf)
    return scores.select(
        "mode", "kind", *[F.round(c, 9).alias(c) for c in ("recall", "mrr", "abstain")], "n", "p50"
    )


@_add("live_pick", C.sql("""
    SELECT mode, round(recall, 9) AS recall, round(mrr, 9) AS mrr, p50 FROM (
        SELECT *, min(p50) OVER () AS fast FROM (SELECT *, max(recall) OVER () AS best FROM scored WHERE kind = 'all')
        WHERE recall + 0.05::DOUBLE >= best)
    WHERE p50 <= fast * 1.25::DOUBLE + 50
    ORDER BY mrr DESC, p50, CASE mode WHEN 'rerank' THEN 0 WHEN 'rrf' THEN 1 WHEN 'cascade' THEN 2 WHEN 'dense' THEN 3 ELSE 4 END
    LIMIT 1""", "scored"))
def live_pick(spark: SparkSession, sf: str) -> DataFrame:
    scores, _, _ = _scores(spark, sf)
    return evaluation.pick_live(cut_lineage(scores)).select(
        "mode", F.round("recall", 9).alias("recall"), F.round("mrr", 9).alias("mrr"), "p50"
    )


def _mode_hits(spark: SparkSession, sf: str, mode: str, tau: float | None = None) -> DataFrame:
    return retrieval.retrieve(C.corpus(spark, sf, tau), C.queries(spark, sf), mode).hits


@_add("tau_fit", C.sql("SELECT tau FROM tau_row", "tau_row"))
def tau_fit(spark: SparkSession, sf: str) -> DataFrame:
    hits = _mode_hits(spark, sf, "rerank")
    return evaluation.fit_tau(cut_lineage(evaluation.rank_one_scores(golden(spark, sf), hits)))


@_add("tau_abstain", C.sql("""
    SELECT qid, CASE WHEN qid IN (SELECT qid FROM slow WHERE top < (SELECT quantile_disc(score, 0.5) FROM reranked WHERE rank = 1))
                     THEN 'no_confident_hit' ELSE '' END AS reason FROM query""", "slow", "reranked", "query"))
def tau_abstain(spark: SparkSession, sf: str) -> DataFrame:
    """Abstention with the middle top score as the threshold."""
    asked = C.queries(spark, sf)
    first = retrieval.retrieve(C.corpus(spark, sf), asked, "rerank")
    best = first.hits.where("rank = 1").select(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY score)").alias("tau"))
    tau = best.collect()[0].tau
    second = retrieval.retrieve(C.corpus(spark, sf, tau), asked, "cascade", found=first.legs)
    return second.status.select("qid", "reason")


@_add("span_hit", C.sql("""
    SELECT avg(CASE WHEN contains(lower(answer), lower(split_part(q, ' ', 1))) AND g.qid IN (
                   SELECT h.qid FROM ranked_rrf h JOIN parent p USING (parent_id) JOIN golden x ON x.qid = h.qid
                   WHERE contains(p.text, x.must_contain) AND p.source_path = x.doc_id)
               THEN 1.0::DOUBLE ELSE 0 END) AS span_hit, count(*) AS span_n
    FROM golden g LEFT JOIN (SELECT h.qid, p.text AS answer FROM ranked_rrf h JOIN parent p USING (parent_id) WHERE h.rank = 1) a
         ON a.qid = g.qid""", "golden", "ranked_rrf", "parent"))
def span_hit(spark: SparkSession, sf: str) -> DataFrame:
    hits = cut_lineage(_mode_hits(spark, sf, "rrf"))
    return evaluation.span_hit(golden(spark, sf), packaging.extractive_answers(hits), hits)


@_add("latency_p50", """
    SELECT CASE WHEN grouping(event_type) = 1 THEN 'all' ELSE event_type END AS event_type,
           quantile_disc(value, 0.5) AS p50, count(value) AS n FROM events GROUP BY GROUPING SETS ((event_type), ())""")
def latency_p50(spark: SparkSession, sf: str) -> DataFrame:
    events = C.table(spark, sf, "events").select("event_type", "value")
    per = evaluation.lower_median(events, ["event_type"], "value")
    overall = evaluation.lower_median(events.withColumn("event_type", F.lit("all")), ["event_type"], "value")
    return per.unionByName(overall)


# --- hits as text -------------------------------------------------------------------------

C.CTES["rrf_hit"] = (P._RANKED["rrf"][1] + ("parent",), P._EMIT.format(ranked=P._RANKED["rrf"][0]))


@_add("prompt_pack", C.sql("""
    SELECT qid, string_agg('[' || rank || '] ' || source_path || ' ' || heading_path || ' ' || chr(10) || parent_text,
                           chr(10) || chr(10) ORDER BY rank) || chr(10) || chr(10) || 'Question: ' || any_value(q) AS prompt
    FROM rrf_hit JOIN query USING (qid) GROUP BY qid""", "rrf_hit", "query"))
def prompt_pack(spark: SparkSession, sf: str) -> DataFrame:
    return packaging.prompts(_mode_hits(spark, sf, "rrf"), C.queries(spark, sf))


@_add("hit_lines", C.sql("""
    SELECT qid, rank, printf('%.4f', score) || '  uncertain  ' || source_path || '  ' || heading_path || '  p.-  chars 0-'
           || end_char || '  ' || substr(file_sha256, 1, 12) || chr(10) || parent_text AS line FROM rrf_hit""", "rrf_hit"))
def hit_lines(spark: SparkSession, sf: str) -> DataFrame:
    hits = _mode_hits(spark, sf, "rrf")
    return hits.select("qid", F.col("rank").cast("bigint").alias("rank"), packaging.format_hit().alias("line"))


@_add("api_hits", C.sql("""
    SELECT qid, rank, parent_id, parent_text AS text, heading_path AS heading, source_path AS source, page_start, page_end,
           score, confident FROM rrf_hit""", "rrf_hit"))
def api_hits(spark: SparkSession, sf: str) -> DataFrame:
    return packaging.api_hits(P.hits_columns(_mode_hits(spark, sf, "rrf")))


@_add("query_units", C.sql("""
    SELECT qid, term AS phrase, weight FROM query_term""", "query_term"))
def query_units(spark: SparkSession, sf: str) -> DataFrame:
    return lexical.query_units(C.queries(spark, sf)).select("qid", F.array_join("phrase", " ").alias("phrase"), "weight")


# Benchmark words joined by underscores in pairs, so that every unit is a phrase of two.
C.CTES["pair"] = (("query",), f"""
    SELECT qid, terms[2 * i - 1] AS a, terms[2 * i] AS b, count(*) AS weight FROM (
        SELECT qid, terms, unnest(range(1, len(terms) // 2 + 1)) AS i FROM (SELECT qid, {C.sql_terms('q')} AS terms FROM query))
    GROUP BY ALL""")
C.CTES["pair_tf"] = (("terms_doc_chunk", "pair"), """
    SELECT chunk_id, a, b, count(*) AS tf, any_value(dl) AS dl FROM (
        SELECT chunk_id, len(terms) AS dl, unnest(terms[:-2]) AS a, unnest(terms[2:]) AS b FROM terms_doc_chunk WHERE len(terms) > 1)
    WHERE (a, b) IN (SELECT (a, b) FROM pair) GROUP BY chunk_id, a, b""")
_PHRASE = C.sql("""
    SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank, chunk_id, round(score, 6) AS score
    FROM (SELECT qid, chunk_id, round(sum(weight
              * CASE WHEN ln((n_all - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) > 0
                     THEN ln((n_all - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) ELSE 1e-6 END
              * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 9) AS score
          FROM pair_tf JOIN pair USING (a, b) JOIN (SELECT a, b, count(*) AS df FROM pair_tf GROUP BY a, b) USING (a, b),
               stats_doc_chunk GROUP BY qid, chunk_id)
    QUALIFY rank <= 20""", "pair_tf", "pair", "stats_doc_chunk")


def _phrase_queries(spark: SparkSession, sf: str) -> DataFrame:
    terms = X.index_terms(F.col("q"))
    joined = X.let(terms, lambda t: F.transform(
        F.filter(F.transform(t, lambda x, i: F.when(i % 2 == 1, F.concat(F.get(t, i - 1), F.lit("_"), x))), lambda x: x.isNotNull()),
        lambda x: x,
    ))
    return C.queries(spark, sf).withColumn("q", F.array_join(joined, " "))


@_add("bm25_phrases", _PHRASE)
def bm25_phrases(spark: SparkSession, sf: str) -> DataFrame:
    return P._rounded(lexical.bm25_topk(C.document_chunks(spark, sf), _phrase_queries(spark, sf), carry=("chunk_id",)))


@_add("bm25_postings_phrases", _PHRASE)
def bm25_postings_phrases(spark: SparkSession, sf: str) -> DataFrame:
    return P._rounded(postings.search(postings.of_chunks(C.document_chunks(spark, sf)), _phrase_queries(spark, sf)))


# --- index maintenance --------------------------------------------------------------------


class _Identity:
    pipeline_version, model_id, model_revision = LIMITS.pipeline_version, ingest.HASH_MODEL, ingest.HASH_REVISION


@_add("manifest_skip", """
    SELECT d.doc_id, coalesce(quality = 1 AND toxic = 0, false) AS skipped FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def manifest_skip(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled documents are in the manifest; poor ones with an old digest, toxic ones by another model."""
    docs = C.documents(spark, sf, "doc_id", "text").select("doc_id", text_hash(F.col("text")).alias("file_sha256"))
    labels = C.table(spark, sf, "labels")
    manifest = docs.join(labels, "doc_id").select(
        "doc_id", F.when(F.col("quality") == 1, F.col("file_sha256")).otherwise("old").alias("file_sha256"),
        F.lit(LIMITS.pipeline_version).alias("pipeline_version"),
        F.when(F.col("toxic") == 1, "other").otherwise(_Identity.model_id).alias("model_id"),
        F.lit(_Identity.model_revision).alias("model_revision"),
    )
    return ingest.split_unchanged(docs, manifest, _Identity).select("doc_id", "skipped")


@_add("orphan_delete", C.sql("""
    SELECT doc_id, chunk_id FROM child WHERE doc_id IN (SELECT doc_id FROM labels) AND length(embed_text) % 2 = 1""", "child"))
def orphan_delete(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled documents are ingested again and keep their children of even length."""
    stored = C.line_children(spark, sf).select("doc_id", "chunk_id", "embed_text")
    again = C.table(spark, sf, "labels").select("doc_id")
    keep = stored.join(again, "doc_id", "left_semi").where(F.length("embed_text") % 2 == 0)
    return orphans(stored, keep.select("doc_id", "chunk_id"), again).select("doc_id", "chunk_id")


def _cache(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    children = C.line_children(spark, sf).withColumn("text_hash", text_hash(F.col("embed_text")))
    cache = children.where(F.length("embed_text") % 3 > 0).dropDuplicates(["text_hash"]).select(
        F.lit("m").alias("model_id"), F.when(F.length("embed_text") % 3 == 1, "r").otherwise("old").alias("model_revision"),
        "text_hash", hash_vector(F.col("embed_text")).alias("vector"),
    )
    made = cut_lineage(cache)
    return children, known(children.select("text_hash"), of_rows(made, 16), "m", "r")


@_add("cache_misses", C.sql("""
    SELECT sha256(embed_text) AS text_hash, any_value(embed_text) AS embed_text FROM child
    WHERE length(embed_text) % 3 <> 1 GROUP BY 1""", "child"))
def cache_misses(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.missing_texts(*_cache(spark, sf))


@_add("cache_join", C.sql(f"""
    SELECT chunk_id, {", ".join(f"CASE WHEN known THEN round(v[{i + 1}], 9) END AS v{i}" for i in range(8))} FROM (
        SELECT chunk_id, length(embed_text) % 3 = 1 AS known, [x / sqrt(list_sum([y * y FOR y IN raw])) FOR x IN raw] AS v FROM (
            SELECT chunk_id, embed_text, {C.sql_hash_vector('embed_text', 'd:')} AS raw FROM child))""", "child"))
def cache_join(spark: SparkSession, sf: str) -> DataFrame:
    children, found = _cache(spark, sf)
    joined = ingest.attach_vectors(children, found)
    return joined.select("chunk_id", *[F.round(F.get("vector", F.lit(i)), 9).alias(f"v{i}") for i in range(8)])


_TIGHT = Limits(max_chunks=20)


@_add("chunk_gates", C.sql("""
    SELECT doc_id, count(*) AS n_chunks, CASE WHEN count(*) > 20 THEN 'parser produced too many chunks' END AS reason
    FROM child GROUP BY doc_id""", "child"))
def chunk_gates(spark: SparkSession, sf: str) -> DataFrame:
    counts = C.line_children(spark, sf).groupBy("doc_id").agg(F.count("*").alias("n_chunks"))
    counts = counts.select("doc_id", F.col("n_chunks").alias("n_blocks"), "n_chunks", F.lit(None).cast("string").alias("reason"))
    return ingest.chunk_gates(counts, _TIGHT).select("doc_id", "n_chunks", "reason")


@_add("child_counts", C.sql("SELECT doc_id, count(*) AS n, min(chunk_id) AS first_id FROM child GROUP BY doc_id", "child"))
def child_counts(spark: SparkSession, sf: str) -> DataFrame:
    return C.line_children(spark, sf).groupBy("doc_id").agg(F.count("*").alias("n"), F.min("chunk_id").alias("first_id"))


# Queries that are passages themselves: the longest line of each source, searched among bare
# lines with one encoder for both sides, so that both lists can agree on a winner.
_SELF = {
    "child": (("line",), f"""
        SELECT {C.sql_id("1", "doc_id", "line")} AS chunk_id, {C.sql_id("1", "doc_id", "text", "0")} AS parent_id, doc_id,
               line AS embed_text FROM (SELECT * FROM line QUALIFY row_number() OVER (PARTITION BY doc_id, line ORDER BY pos) = 1)"""),
    "query": (("line",), """
        SELECT row_number() OVER (ORDER BY source) - 1 AS qid, q FROM (
            SELECT source, first(line ORDER BY length(line) DESC, line) AS q FROM line GROUP BY source)"""),
    "query_vector": (("query",), f"SELECT qid, {C.sql_hash_vector('q', 'd:')} AS qv FROM query"),
}


def _self_corpus(spark: SparkSession, sf: str):
    lines = F.array_distinct(F.filter(F.transform(F.split("text", "\n"), X.strip), lambda line: line != ""))
    docs = C.documents(spark, sf, "doc_id", "text").select("doc_id", C.parent_id().alias("parent_id"), lines.alias("lines"))
    rows = docs.select("doc_id", "parent_id", F.explode("lines").alias("embed_text"))
    children = rows.withColumn(
        "chunk_id", content_id(F.lit(LIMITS.pipeline_version), F.col("doc_id"), F.col("embed_text"))
    ).withColumn("vector", hash_vector(F.col("embed_text")))
    corpus = C.corpus(spark, sf)
    corpus.children = children
    longest = C.document_lines(spark, sf).groupBy("source").agg(
        F.min_by("line", F.struct(-F.length("line"), "line")).alias("q")
    )
    asked = cut_lineage(longest).selectExpr("row_number() OVER (ORDER BY source) - 1 AS qid", "q")
    return corpus, retrieval.batch(asked.select(F.col("qid").cast("bigint").alias("qid"), "q"))


def _self_sql(main: str, *needs: str) -> str:
    saved = {k: C.CTES[k] for k in _SELF}
    C.CTES.update(_SELF)
    try:
        return C.sql(main, *needs)
    finally:
        C.CTES.update(saved)


@_add("agreement_fast_path", _self_sql("SELECT qid, parent_id, round(score, 9) AS score FROM agreed", "agreed"))
def agreement_fast_path(spark: SparkSession, sf: str) -> DataFrame:
    corpus, asked = _self_corpus(spark, sf)
    found = cut_lineage(retrieval.search_legs(corpus, asked, "cascade", hash_vector))
    fused = fusion.fuse(fusion.parent_lists(found), "parent_id")
    return fusion.agreed(fused).select("qid", "parent_id", F.round("score", 9).alias("score"))


@_add("cascade_fast_and_slow", _self_sql(P._EMIT.format(ranked=P._RANKED["cascade"][0]), *P._RANKED["cascade"][1], "parent"))
def cascade_fast_and_slow(spark: SparkSession, sf: str) -> DataFrame:
    corpus, asked = _self_corpus(spark, sf)
    return P.hits_columns(retrieval.retrieve(corpus, asked, "cascade", encode=hash_vector).hits)
