"""How the test tables map to the engine's model, in Spark and in SQL.

A document is a parent passage; each of its distinct lines is a child under the
heading of its source.  Benchmark items are the query batch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from passagemill.functions import text as X
from passagemill.functions.hashing import content_id, hash_vector, text_hash
from passagemill.operators.retrieval import Corpus
from passagemill.schemas import LIMITS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Share out an input of fewer splits than cores; larger inputs stay as read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select(*columns))


def document_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents as passages."""
    return documents(spark, sf_dir, "doc_id", "text").select(
        F.col("doc_id").alias("chunk_id"), "doc_id", F.col("text").alias("embed_text")
    )


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("qid"), F.col("text").alias("q"), F.lit(None).cast("string").alias("doc_filter")
    )


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One prose block per visible line, in order: (doc_id, source, block_index, line)."""
    lines = F.filter(
        F.transform(F.split("text", "\n"), X.strip), lambda line: line != ""
    )
    return documents(spark, sf_dir, "doc_id", "source", "text").select(
        "doc_id", "source", F.posexplode(lines).alias("block_index", "line")
    )


def line_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Children without a shuffle: equal lines of a document are dropped row-locally."""
    lines = F.array_distinct(
        F.filter(F.transform(F.split("text", "\n"), X.strip), lambda line: line != "")
    )
    # Before the lines are dealt out, so that a text is hashed once and not copied to each of its lines.
    docs = documents(spark, sf_dir, "doc_id", "source", "text").select(
        "doc_id", "source", parent_id().alias("parent_id"), lines.alias("lines")
    )
    rows = docs.select("doc_id", "source", "parent_id", F.posexplode("lines").alias("child_index", "line"))
    embed = X.embed_text(F.col("source"), F.col("line"))
    return rows.select(
        content_id(F.lit(LIMITS.pipeline_version), F.col("doc_id"), embed).alias("chunk_id"),
        "parent_id", "doc_id", "child_index", embed.alias("embed_text"),
    )


def parent_id() -> Column:
    return content_id(F.lit(LIMITS.pipeline_version), F.col("doc_id"), F.col("text"), F.lit(0))


def corpus(spark: SparkSession, sf_dir: str, tau: float | None = None) -> Corpus:
    children = line_children(spark, sf_dir).withColumn("vector", hash_vector(F.col("embed_text")))
    parents = documents(spark, sf_dir, "doc_id", "source", "text").select(
        parent_id().alias("parent_id"), F.col("doc_id").cast("string").alias("doc_id"), "text",
        F.col("source").alias("heading_path"), F.col("doc_id").cast("string").alias("source_path"),
        text_hash(F.col("text")).alias("file_sha256"),
        F.lit(0).alias("page_start"), F.lit(0).alias("page_end"),
        F.lit(0).alias("start_char"), F.length("text").alias("end_char"),
    )
    return Corpus(children, parents, tau=tau)


# --- SQL ------------------------------------------------------------------------------

TERM = r"[\p{L}\p{N}\p{Co}]+"
BLANK = r"\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def sql_strip(e: str) -> str:
    return f"regexp_replace({e}, '^[{BLANK}]+|[{BLANK}]+$', '', 'g')"


def sql_terms(e: str) -> str:
    return f"regexp_extract_all(strip_accents(lower({e})), '{TERM}')"


def sql_id(*parts: str) -> str:
    sealed = " || ".join(f"({p})::VARCHAR || chr(0)" for p in parts)
    return f"substr(sha256({sealed}), 1, 16)"


def sql_hash_vector(e: str, prefix: str) -> str:
    h = f"sha256('{prefix}' || {e})"
    parts = ", ".join(
        f"CAST('0x' || substr({h}, {2 * i + 1}, 2) AS INTEGER)::DOUBLE / 127.5::DOUBLE - 1.0::DOUBLE" for i in range(8)
    )
    return f"[{parts}]::DOUBLE[]"


# Named common table expressions and what each one reads.
CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "line": ((), f"""
        SELECT doc_id, source, text, pos, {sql_strip('raw')} AS line FROM (
            SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS raw,
                   generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)
        WHERE {sql_strip('raw')} <> ''"""),
    "child": (("line",), f"""
        SELECT {sql_id("1", "doc_id", "source || chr(10) || line")} AS chunk_id,
               {sql_id("1", "doc_id", "text", "0")} AS parent_id,
               doc_id, source || chr(10) || line AS embed_text,
               row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS child_index
        FROM (SELECT * FROM line QUALIFY row_number() OVER (PARTITION BY doc_id, line ORDER BY pos) = 1)"""),
    "parent": ((), f"""
        SELECT {sql_id("1", "doc_id", "text", "0")} AS parent_id, text, source AS heading_path,
               doc_id::VARCHAR AS source_path, sha256(text) AS file_sha256, length(text) AS end_char
        FROM documents"""),
    "query": ((), "SELECT item_id AS qid, text AS q FROM benchmark"),
    "doc_chunk": ((), "SELECT doc_id AS chunk_id, doc_id, text AS embed_text FROM documents"),
    "query_vector": (("query",), f"SELECT qid, {sql_hash_vector('q', 'q:')} AS qv FROM query"),
    "child_vector": (("child",), f"SELECT chunk_id, parent_id, doc_id, {sql_hash_vector('embed_text', 'd:')} AS v FROM child"),
    "dense": (("query_vector", "child_vector"), """
        SELECT qid, chunk_id, parent_id, score,
               row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank
        FROM (SELECT qid, chunk_id, parent_id, round(list_cosine_similarity(qv, v), 9) AS score
              FROM query_vector, child_vector)
        QUALIFY rank <= 20"""),
    "query_term": (("query",), f"""
        SELECT qid, term, count(*) AS weight FROM (SELECT qid, unnest({sql_terms('q')}) AS term FROM query)
        GROUP BY qid, term"""),
}


def _bm25_ctes(source: str, extra: str = "") -> dict[str, tuple[tuple[str, ...], str]]:
    """Statistics and scores over one table of passages; names carry its suffix."""
    s = source
    parent = "parent_id" if source.endswith("child") else "chunk_id AS parent_id"
    return {
        f"terms_{s}": ((s,), f"SELECT chunk_id, doc_id, {parent}, {sql_terms('embed_text')} AS terms FROM {s}"),
        f"stats_{s}": ((f"terms_{s}",), f"SELECT count(*)::DOUBLE AS n_all, avg(len(terms)) AS avgdl FROM terms_{s}"),
        f"tf_{s}": ((f"terms_{s}",), f"""
            SELECT chunk_id, doc_id, parent_id, dl, term, count(*) AS tf FROM (
                SELECT chunk_id, doc_id, parent_id, len(terms) AS dl, unnest(terms) AS term FROM terms_{s})
            GROUP BY ALL"""),
        f"df_{s}": ((f"tf_{s}",), f"SELECT term, count(*) AS df FROM tf_{s} GROUP BY term"),
        f"score_{s}": ((f"tf_{s}", f"df_{s}", f"stats_{s}", "query_term"), f"""
            SELECT qid, chunk_id, doc_id, parent_id, round(sum(weight
                * CASE WHEN ln((n_all - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) > 0
                       THEN ln((n_all - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) ELSE 1e-6 END
                * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 9) AS score
            FROM tf_{s} JOIN query_term USING (term) JOIN df_{s} USING (term), stats_{s}
            GROUP BY qid, chunk_id, doc_id, parent_id"""),
        f"lexical_{s}": ((f"score_{s}",), f"""
            SELECT qid, chunk_id, parent_id, score,
                   row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank
            FROM score_{s} QUALIFY rank <= 20"""),
    }


CTES.update(_bm25_ctes("child"))
CTES.update(_bm25_ctes("chunk_child"))
CTES.update(_bm25_ctes("doc_chunk"))


def _fused(name: str, key: str, lists: str) -> dict[str, tuple[tuple[str, ...], str]]:
    return {
        name: ((lists,), f"""
            SELECT qid, {key}, score, seen, dense_rank, lexical_rank,
                   row_number() OVER (PARTITION BY qid ORDER BY score DESC, seen) AS rank
            FROM (SELECT qid, {key}, sum(1.0::DOUBLE / (60 + rank)) AS score, min(leg * 1000 + rank) AS seen,
                         min(rank) FILTER (leg = 0) AS dense_rank, min(rank) FILTER (leg = 1) AS lexical_rank
                  FROM {lists} GROUP BY qid, {key})"""),
    }


CTES["found"] = (("dense", "lexical_child"), """
    SELECT qid, 0 AS leg, rank, chunk_id, parent_id FROM dense
    UNION ALL SELECT qid, 1, rank, chunk_id, parent_id FROM lexical_child""")
CTES["plist"] = (("found",), """
    SELECT qid, leg, parent_id, row_number() OVER (PARTITION BY qid, leg ORDER BY first_rank) AS rank
    FROM (SELECT qid, leg, parent_id, min(rank) AS first_rank FROM found GROUP BY ALL)""")
CTES.update(_fused("fused_parent", "parent_id", "plist"))
CTES.update(_fused("fused_child", "chunk_id", "found"))
CTES["best"] = (("fused_child", "found"), """
    SELECT qid, parent_id, chunk_id AS child_id FROM fused_child
    JOIN (SELECT DISTINCT qid, chunk_id, parent_id FROM found) USING (qid, chunk_id)
    QUALIFY row_number() OVER (PARTITION BY qid, parent_id ORDER BY score DESC, seen) = 1""")
CTES["agreed"] = (("fused_parent",), """
    SELECT qid, parent_id, score FROM (
        SELECT *, lead(score) OVER (PARTITION BY qid ORDER BY rank) AS next_score FROM fused_parent)
    WHERE rank = 1 AND dense_rank <= 3 AND lexical_rank <= 3
      AND (next_score IS NULL OR next_score < score * 0.6::DOUBLE)""")
CTES["overlap"] = (("fused_child", "found", "child", "query"), """
    SELECT qid, chunk_id AS child_id, parent_id, f.rank AS fused_rank,
           len(list_intersect(list_distinct(regexp_extract_all(lower(q), '[\\p{L}\\p{N}_]+')),
                              list_distinct(regexp_extract_all(lower(embed_text), '[\\p{L}\\p{N}_]+'))))::DOUBLE AS score
    FROM fused_child f JOIN (SELECT chunk_id, parent_id, embed_text FROM child) USING (chunk_id) JOIN query USING (qid)
    WHERE f.rank <= 12""")
CTES["reranked"] = (("overlap",), """
    SELECT qid, parent_id, child_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, fused_rank) AS rank
    FROM (SELECT * FROM overlap
          QUALIFY row_number() OVER (PARTITION BY qid, parent_id ORDER BY score DESC, fused_rank) = 1)""")


def sql(main: str, *needs: str) -> str:
    """A query preceded by the common table expressions it needs, in order."""
    done: list[str] = []

    def add(name: str) -> None:
        if name in done:
            return
        for need in CTES[name][0]:
            add(need)
        done.append(name)

    for name in needs:
        add(name)
    if not done:
        return main
    recursive = "RECURSIVE " if any(n.endswith("_walk") for n in done) else ""
    return f"WITH {recursive}" + ",\n".join(f"{n} AS ({CTES[n][1]})" for n in done) + "\n" + main
