"""Text, source and chunking queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from passagemill.functions import text as X
from passagemill.functions.hashing import content_id, text_hash
from passagemill.operators import blocks as B
from passagemill.operators.chunking import child_rows, index_passages, parent_rows, passages
from passagemill.operators.packing import pack_counts
from passagemill.plans import common as C
from passagemill.schemas import LIMITS
from passagemill.sources import markup

QUERIES = {}
SQL = {}


def _add(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return keep


def _tidy_sql(e: str, hyphens: bool = True) -> str:
    """Clean-up of a text that its normal form leaves as it is."""
    e = f"regexp_replace(replace(replace({e}, chr(0), ''), chr(173), ''), '\\r\\n?', chr(10), 'g')"
    if hyphens:
        e = f"regexp_replace({e}, '([A-Za-z])-\\n[{C.BLANK}]*([a-z])', '\\1\\2', 'g')"
    e = f"regexp_replace({e}, '[ \\t]+', ' ', 'g')"
    inline = C.BLANK.replace(r"\x{9}-\x{d}", r"\x{9}\x{b}-\x{d}")
    e = f"regexp_replace({e}, '(^|\\n)[{inline}]+', '\\1', 'g')"
    e = f"regexp_replace({e}, '[{inline}]+(\\n|$)', '\\1', 'g')"
    e = f"regexp_replace({e}, '\\n{{3,}}', chr(10) || chr(10), 'g')"
    return C.sql_strip(e)


# Documents with line-break hyphens, doubled blanks and blank lines put in.
_ROUGH_SQL = "replace(replace(replace(text, ', ', '-' || chr(13) || chr(10) || '  '), ' de ', ' ' || chr(9) || ' de  '), '.' || chr(10), '.' || chr(10) || ' ' || chr(10) || chr(10) || chr(10))"


def _rough(text):
    text = F.replace(text, F.lit(", "), F.lit("-\r\n  "))
    text = F.replace(text, F.lit(" de "), F.lit(" \t de  "))
    return F.replace(text, F.lit(".\n"), F.lit(".\n \n\n\n"))


@_add("normalize_text", f"SELECT doc_id, {_tidy_sql(_ROUGH_SQL)} AS text FROM documents")
def normalize_text(spark: SparkSession, sf: str) -> DataFrame:
    docs = C.documents(spark, sf, "doc_id", "text")
    return docs.select("doc_id", X.normalize_text(_rough(F.col("text"))).alias("text"))


@_add("normalize_code", f"SELECT doc_id, {_tidy_sql(_ROUGH_SQL, hyphens=False)} AS text FROM documents")
def normalize_code(spark: SparkSession, sf: str) -> DataFrame:
    docs = C.documents(spark, sf, "doc_id", "text")
    return docs.select("doc_id", X.normalize_text(_rough(F.col("text")), code=True).alias("text"))


@_add("dehyphenate", f"""
    SELECT doc_id, regexp_replace(replace(text, ' ', '-' || chr(10)), '([A-Za-z])-\\n[{C.BLANK}]*([a-z])', '\\1\\2', 'g') AS text
    FROM documents""")
def dehyphenate(spark: SparkSession, sf: str) -> DataFrame:
    docs = C.documents(spark, sf, "doc_id", "text")
    return docs.select("doc_id", X.join_hyphens(F.replace("text", F.lit(" "), F.lit("-\n"))).alias("text"))


@_add("token_counts", f"""
    SELECT doc_id, len(regexp_extract_all(text, '[^{C.BLANK}]+'))::BIGINT AS tokens FROM documents""")
def token_counts(spark: SparkSession, sf: str) -> DataFrame:
    docs = C.documents(spark, sf, "doc_id", "text")
    return docs.select("doc_id", X.count_one(F.col("text"), X.whitespace_tokens).cast("bigint").alias("tokens"))


# Sentence pieces: a mark after each end of sentence, then a cut at the marks.
_SENTENCE_CTE = f"""
    SELECT doc_id, i, piece, sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY i) - length(piece) AS start
    FROM (SELECT doc_id, unnest(parts) AS piece, generate_subscripts(parts, 1) AS i FROM (
        SELECT doc_id, string_split(regexp_replace(regexp_replace(body, '([.!?][{C.BLANK}]+)', '\\1' || chr(1), 'g'),
            '(\\n+)', '\\1' || chr(1), 'g'), chr(1)) AS parts FROM doc_section))"""
C.CTES["doc_section"] = (("line",), """
    SELECT doc_id, any_value(source) AS source, string_agg(line, chr(10) ORDER BY pos) AS body FROM line GROUP BY doc_id""")
C.CTES["sentence"] = (("doc_section",), _SENTENCE_CTE)


@_add("sentence_spans", C.sql(f"""
    SELECT doc_id, start::BIGINT AS start_char, md5({C.sql_strip('piece')}) AS sentence FROM sentence
    WHERE {C.sql_strip('piece')} <> ''""", "sentence"))
def sentence_spans(spark: SparkSession, sf: str) -> DataFrame:
    lines = F.filter(F.transform(F.split("text", "\n"), X.strip), lambda line: line != "")
    docs = C.documents(spark, sf, "doc_id", "text").select("doc_id", F.array_join(lines, "\n").alias("text"))
    cut = docs.select("doc_id", F.posexplode(X.pieces(F.col("text"), X.SENTENCES)).alias("i", "piece"))
    w = Window.partitionBy("doc_id").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = cut.withColumn("start_char", F.sum(F.length("piece")).over(w) - F.length("piece"))
    return placed.where(~X.is_blank(F.col("piece"))).select(
        "doc_id", "start_char", F.md5(X.strip(F.col("piece"))).alias("sentence")
    )


def _as_txt(spark: SparkSession, sf: str) -> DataFrame:
    return C.documents(spark, sf, "doc_id", "source", "text").select(
        "doc_id", F.concat("source", F.lit(".txt")).alias("filename"), _rough(F.col("text")).alias("text")
    )


@_add("txt_blocks", f"""
    WITH clean AS (SELECT doc_id, source, {_tidy_sql(_ROUGH_SQL)} AS text FROM documents),
    para AS (SELECT doc_id, source, {C.sql_strip('p')} AS text, i FROM (
        SELECT doc_id, source, unnest(parts) AS p, generate_subscripts(parts, 1) AS i
        FROM (SELECT doc_id, source, regexp_split_to_array(text, '\\n[{C.BLANK}]*\\n') AS parts FROM clean)))
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS position, 'prose' AS kind, text,
           source AS heading_path FROM para WHERE text <> ''""")
def txt_blocks(spark: SparkSession, sf: str) -> DataFrame:
    rows = markup.txt_blocks(_as_txt(spark, sf))
    return rows.select("doc_id", F.col("position").cast("bigint").alias("position"), "kind", "text", "heading_path")


_MD_TURN = """'## ' || role || chr(10) || chr(10) || text || chr(10) || '* turn ' || turn || chr(10) ||
    '| turn | role |' || chr(10) || '|:---|---:|' || chr(10) || '| ' || turn || ' | ' || role || ' |' || chr(10) ||
    '```' || chr(10) || '# no heading' || chr(10) || '  ' || role || '-' || chr(10) || 'x' || chr(10) || '```'"""


@_add("md_blocks", """
    WITH part AS (
        SELECT conv_id, turn, role, 0 AS n, 'prose' AS kind, text FROM conversations UNION ALL
        SELECT conv_id, turn, role, 1, 'list', 'turn ' || turn FROM conversations UNION ALL
        SELECT conv_id, turn, role, 2, 'table', 'turn | role' || chr(10) || turn || ' | ' || role FROM conversations UNION ALL
        SELECT conv_id, turn, role, 3, 'code', '# no heading' || chr(10) || role || '-' || chr(10) || 'x' FROM conversations)
    SELECT conv_id AS doc_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, n) - 1 AS block_index, kind, text,
           'Talk ' || conv_id || ' > ' || role AS heading_path FROM part""")
def md_blocks(spark: SparkSession, sf: str) -> DataFrame:
    turns = C.spread(C.table(spark, sf, "conversations"))
    turn = F.col("turn").cast("string")
    body = F.concat(
        F.lit("## "), "role", F.lit("\n\n"), "text", F.lit("\n* turn "), turn,
        F.lit("\n| turn | role |\n|:---|---:|\n| "), turn, F.lit(" | "), "role",
        F.lit(" |\n```\n# no heading\n  "), "role", F.lit("-\nx\n```"),
    )
    files = turns.groupBy("conv_id").agg(
        F.array_join(F.array_sort(F.collect_list(F.struct("turn", body.alias("body"))))["body"], "\n\n").alias("all")
    ).select(
        F.col("conv_id").alias("doc_id"), F.lit("talk.md").alias("filename"),
        F.concat(F.lit("# Talk "), F.col("conv_id").cast("string"), F.lit("\n"), "all").alias("text"),
    )
    numbered = B.number_blocks(markup.md_blocks(files))
    return numbered.select("doc_id", F.col("block_index").cast("bigint").alias("block_index"), "kind", "text", "heading_path")


_HTML_TEXT = "replace(replace(replace(replace(string_agg(piece, '' ORDER BY i), '&quot;', '\"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&')"


@_add("html_blocks", f"""
    WITH bare AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?s)<(script|style)>.*?</(script|style)>', '', 'g'),
                                                '(?s)<!--.*?-->', '', 'g') AS html FROM pages),
    piece AS (SELECT page_id, unnest(parts) AS piece, generate_subscripts(parts, 1) AS i
              FROM (SELECT page_id, regexp_extract_all(html, '<[^>]*>|[^<]+') AS parts FROM bare)),
    marked AS (SELECT *, sum(CASE WHEN regexp_matches(piece, '^<(p|h1|li)>$') THEN 1 ELSE 0 END)
                             OVER (PARTITION BY page_id ORDER BY i) AS run FROM piece),
    closed AS (SELECT page_id, run, arg_min(piece, i) AS opens,
                      min(i) FILTER (regexp_matches(piece, '^</(p|h1|li)>$')) AS stop FROM marked WHERE run > 0 GROUP BY page_id, run),
    raw AS (SELECT m.page_id, m.run, opens, any_value(stop) AS stop, {_HTML_TEXT} AS raw
            FROM marked m JOIN closed c ON c.page_id = m.page_id AND c.run = m.run
            WHERE i < stop AND piece NOT LIKE '<%' GROUP BY m.page_id, m.run, opens),
    text AS (SELECT page_id, run, opens, {_tidy_sql('raw')} AS text FROM raw),
    pathed AS (SELECT *, last_value(CASE WHEN opens = '<h1>' THEN text END IGNORE NULLS)
                             OVER (PARTITION BY page_id ORDER BY run) AS heading FROM text)
    SELECT page_id AS doc_id, row_number() OVER (PARTITION BY page_id ORDER BY run) - 1 AS block_index,
           CASE WHEN opens = '<li>' THEN 'list' ELSE 'prose' END AS kind, text, coalesce(heading, '') AS heading_path
    FROM pathed WHERE opens <> '<h1>' AND text <> ''""")
def html_blocks(spark: SparkSession, sf: str) -> DataFrame:
    pages = C.spread(C.table(spark, sf, "pages")).select(
        F.col("page_id").alias("doc_id"), F.lit("page.html").alias("filename"), F.col("html").alias("text")
    )
    numbered = B.number_blocks(markup.html_blocks(pages))
    return numbered.select("doc_id", F.col("block_index").cast("bigint").alias("block_index"), "kind", "text", "heading_path")


@_add("csv_rows", """
    SELECT s_nationkey::BIGINT AS doc_id, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS position,
           'row' AS kind, 's_suppkey: ' || s_suppkey || '; s_name: ' || s_name || ', "' || s_nationkey || '"; col: x; more' AS text,
           'nation-' || s_nationkey AS heading_path FROM supplier""")
def csv_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = C.spread(C.table(spark, sf, "supplier"))
    line = F.concat(
        F.col("s_suppkey").cast("string"), F.lit(',"'), "s_name", F.lit(', ""'),
        F.col("s_nationkey").cast("string"), F.lit('"""'), F.lit(",,x,more"),
    )
    ordered = F.array_sort(F.collect_list(F.struct("s_suppkey", line.alias("line"))))["line"]
    files = rows.groupBy("s_nationkey").agg(F.array_join(ordered, "\n").alias("body")).select(
        F.col("s_nationkey").cast("bigint").alias("doc_id"),
        F.concat(F.lit("nation-"), F.col("s_nationkey").cast("string"), F.lit(".csv")).alias("filename"),
        F.concat(F.lit("s_suppkey,s_name,s_blank,\n"), "body", F.lit("\n")).alias("text"),
    )
    out = markup.csv_blocks(files)
    return out.select("doc_id", F.col("position").cast("bigint").alias("position"), "kind", "text", "heading_path")


def _line_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return C.document_lines(spark, sf).select(
        "doc_id", "block_index", F.lit("prose").alias("kind"), F.col("line").alias("text"),
        F.col("source").alias("heading_path"), F.lit(0).alias("page"),
    )


@_add("block_offsets", C.sql("""
    SELECT doc_id, row_number() OVER w - 1 AS block_index,
           (sum(length(line) + 1) OVER w - length(line) - 1)::BIGINT AS start_char,
           (sum(length(line) + 1) OVER w - 1)::BIGINT AS end_char
    FROM line WINDOW w AS (PARTITION BY doc_id ORDER BY pos)""", "line"))
def block_offsets(spark: SparkSession, sf: str) -> DataFrame:
    return B.assign_offsets(_line_blocks(spark, sf)).select(
        "doc_id", *[F.col(c).cast("bigint").alias(c) for c in ("block_index", "start_char", "end_char")]
    )


_KIND_SQL = """CASE WHEN length(text) % 7 = 0 THEN 'table' WHEN length(text) % 5 = 0 THEN 'code'
    WHEN length(text) % 3 = 0 THEN 'row' WHEN length(text) % 2 = 0 THEN 'list' ELSE 'prose' END"""


def _turn_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Turns as blocks; every second pair shares a heading, and kinds follow the text length."""
    n = F.length("text")
    kind = (
        F.when(n % 7 == 0, "table").when(n % 5 == 0, "code").when(n % 3 == 0, "row")
        .when(n % 2 == 0, "list").otherwise("prose")
    )
    rows = C.spread(C.table(spark, sf, "conversations")).select(
        F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("block_index"), kind.alias("kind"), "text",
        F.concat(F.lit("part "), F.floor(F.col("turn") / 4).cast("string")).alias("heading_path"),
        (F.col("turn") + 1).cast("int").alias("page"),
    )
    return B.assign_offsets(rows)


@_add("sections", f"""
    WITH block AS (SELECT conv_id AS doc_id, turn, {_KIND_SQL} AS kind, 'part ' || (turn // 4) AS heading_path, text,
                          sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn) - length(text) - 1 AS start_char
                   FROM conversations),
    flagged AS (SELECT *, CASE WHEN prev IS NULL OR kind IN ('table', 'code') OR prev IN ('table', 'code')
                                 OR (kind = 'row') <> (prev = 'row') OR heading_path <> prev_heading THEN 1 ELSE 0 END AS opens
                FROM (SELECT *, lag(kind) OVER w AS prev, lag(heading_path) OVER w AS prev_heading
                      FROM block WINDOW w AS (PARTITION BY doc_id ORDER BY turn))),
    numbered AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY turn) - 1 AS section_id FROM flagged)
    SELECT doc_id, section_id::BIGINT AS section_id, CASE WHEN min(kind) = max(kind) THEN min(kind) ELSE 'prose' END AS kind,
           min(heading_path) AS heading_path, min(start_char)::BIGINT AS start_char, min(turn) + 1 AS page_start,
           max(turn) + 1 AS page_end, count(*) AS n_blocks, string_agg(text, chr(10) ORDER BY turn) AS text
    FROM numbered GROUP BY doc_id, section_id""")
def sections(spark: SparkSession, sf: str) -> DataFrame:
    rows = B.sections(_turn_blocks(spark, sf))
    return rows.select(
        "doc_id", "kind", "heading_path", "text", "n_blocks",
        *[F.col(c).cast("bigint").alias(c) for c in ("section_id", "start_char", "page_start", "page_end")],
    )


def _stack_sql(levels: int) -> str:
    return f"""
    WITH RECURSIVE step AS (SELECT conv_id AS doc_id, turn, 1 + (length(text) % {levels}) AS level, role || ' ' || turn AS name,
                                   row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations),
    walk AS (SELECT doc_id, turn, n, [name] AS stack FROM step WHERE n = 1
             UNION ALL
             SELECT s.doc_id, s.turn, s.n, list_append(w.stack[1:s.level - 1], s.name) FROM walk w
             JOIN step s ON s.doc_id = w.doc_id AND s.n = w.n + 1)
    SELECT doc_id, turn, array_to_string(stack, ' > ') AS heading_path FROM walk"""


def _headings(spark: SparkSession, sf: str, levels: int) -> DataFrame:
    return C.spread(C.table(spark, sf, "conversations")).select(
        F.col("conv_id").alias("doc_id"), "turn", (1 + F.length("text") % levels).alias("level"),
        F.concat("role", F.lit(" "), F.col("turn").cast("string")).alias("name"),
    )


@_add("heading_stack", _stack_sql(12))
def heading_stack(spark: SparkSession, sf: str) -> DataFrame:
    return B.stack_any_depth(_headings(spark, sf, 12), order="turn").select("doc_id", "turn", "heading_path")


@_add("heading_stack_six", _stack_sql(6))
def heading_stack_six(spark: SparkSession, sf: str) -> DataFrame:
    """The six levels of Markdown and HTML, by windows alone."""
    return B.stack_headings(_headings(spark, sf, 6), order="turn").select("doc_id", "turn", "heading_path")


@_add("embed_text", C.sql("SELECT doc_id, child_index, embed_text FROM child", "child"))
def embed_text(spark: SparkSession, sf: str) -> DataFrame:
    return C.line_children(spark, sf).select("doc_id", F.col("child_index").cast("bigint").alias("child_index"), "embed_text")


@_add("content_ids", C.sql(
    "SELECT doc_id, child_index, chunk_id, parent_id, sha256(embed_text) AS text_hash FROM child", "child"))
def content_ids(spark: SparkSession, sf: str) -> DataFrame:
    return C.line_children(spark, sf).select(
        "doc_id", F.col("child_index").cast("bigint").alias("child_index"), "chunk_id", "parent_id",
        text_hash(F.col("embed_text")).alias("text_hash"),
    )


def _line_passages(spark: SparkSession, sf: str) -> DataFrame:
    """Lines as candidate children of parents of three lines each, repeats included."""
    rows = C.document_lines(spark, sf)
    embed = X.embed_text(F.col("source"), F.col("line"))
    return index_passages(rows.select(
        "doc_id", F.lit(0).alias("section_id"), F.floor(F.col("block_index") / 3).alias("window_id"),
        (F.col("block_index") % 3).alias("piece_id"),
        F.floor(F.col("block_index") / 3).alias("parent_id"), F.col("block_index"),
        content_id(F.lit(LIMITS.pipeline_version), F.col("doc_id"), embed).alias("chunk_id"),
    ))


C.CTES["candidate"] = (("line",), f"""
    SELECT doc_id, n, n // 3 AS parent_id, {C.sql_id("1", "doc_id", "source || chr(10) || line")} AS chunk_id,
           row_number() OVER (PARTITION BY doc_id, line ORDER BY n) = 1 AS is_first
    FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS n FROM line)""")


@_add("dedupe_children", C.sql("SELECT doc_id, n AS block_index, chunk_id FROM candidate WHERE is_first", "candidate"))
def dedupe_children(spark: SparkSession, sf: str) -> DataFrame:
    rows = _line_passages(spark, sf).where("is_first")
    return rows.select("doc_id", F.col("block_index").cast("bigint").alias("block_index"), "chunk_id")


@_add("prune_parents", C.sql("""
    SELECT doc_id, parent_id, row_number() OVER (PARTITION BY doc_id ORDER BY parent_id) - 1 AS parent_index
    FROM (SELECT DISTINCT doc_id, parent_id FROM candidate WHERE is_first)""", "candidate"))
def prune_parents(spark: SparkSession, sf: str) -> DataFrame:
    rows = _line_passages(spark, sf).where((F.col("piece_id") == 0) & F.col("parent_kept"))
    return rows.select("doc_id", "parent_id", F.col("parent_index").cast("bigint").alias("parent_index"))


@_add("reindex", C.sql("""
    SELECT doc_id, chunk_id, row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS child_index,
           dense_rank() OVER (PARTITION BY doc_id ORDER BY parent_id) - 1 AS parent_index
    FROM candidate WHERE is_first""", "candidate"))
def reindex(spark: SparkSession, sf: str) -> DataFrame:
    rows = _line_passages(spark, sf).where("is_first")
    return rows.select(
        "doc_id", "chunk_id", *[F.col(c).cast("bigint").alias(c) for c in ("child_index", "parent_index")]
    )


def _pack_ctes(prefix: str, source: str, group: str, target: int, cap: int, overlap: int | None) -> None:
    """Greedy windows in SQL over rows (group..., i from 0, n >= 1): every start's window, then the walk."""
    g = group
    on = lambda a, b: " AND ".join(f"{a}.{c} = {b}.{c}" for c in g.split(", "))
    C.CTES[f"{prefix}_cum"] = ((source,), f"""
        SELECT {g}, i, n, (sum(n) OVER (PARTITION BY {g} ORDER BY i))::BIGINT AS upto, count(*) OVER (PARTITION BY {g}) AS m
        FROM {source}""")
    # A unit is in the window of s when all before it leave room: total with it fits, total without it is below target.
    C.CTES[f"{prefix}_stop"] = ((f"{prefix}_cum",), f"""
        SELECT {", ".join("s." + c for c in g.split(", "))}, s.i AS s, any_value(s.m) AS m,
               greatest(s.i + 1, coalesce(max(e.i) + 1, 0)) AS stop
        FROM {prefix}_cum s LEFT JOIN {prefix}_cum e ON {on("s", "e")} AND e.i >= s.i AND s.n <= {cap}
             AND e.upto - (s.upto - s.n) <= {cap} AND (e.i = s.i OR e.upto - e.n - (s.upto - s.n) < {target})
        GROUP BY {", ".join("s." + c for c in g.split(", "))}, s.i""")
    back = "p.stop" if overlap is None else f"""greatest(p.s + 1, least(p.stop - 1, coalesce((
            SELECT min(b.i) FROM {prefix}_cum b JOIN {prefix}_cum z ON {on("b", "z")} AND z.i = p.stop - 1
            WHERE {on("b", "p")} AND z.upto - (b.upto - b.n) <= {overlap}), p.stop - 1)))"""
    C.CTES[f"{prefix}_next"] = ((f"{prefix}_stop", f"{prefix}_cum"), f"SELECT p.*, {back} AS next FROM {prefix}_stop p")
    C.CTES[f"{prefix}_walk"] = ((f"{prefix}_next",), f"""
        SELECT {g}, s, stop, next, m, 0 AS w FROM {prefix}_next WHERE s = 0
        UNION ALL
        SELECT {", ".join("n." + c for c in g.split(", "))}, n.s, n.stop, n.next, n.m, k.w + 1
        FROM {prefix}_walk k JOIN {prefix}_next n ON {on("n", "k")} AND n.s = k.next WHERE k.stop < k.m""")


C.CTES["line_count"] = (("line",), f"""
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS i,
           len(regexp_extract_all(line, '[^{C.BLANK}]+')) AS n FROM line""")
_pack_ctes("plain", "line_count", "doc_id", LIMITS.child_target, LIMITS.child_max, None)
_pack_ctes("lapped", "line_count", "doc_id", LIMITS.child_target, LIMITS.child_max, LIMITS.child_overlap)


def _packed(name: str, prefix: str, overlap: int | None) -> None:
    @_add(name, C.sql(
        f"SELECT doc_id, w::BIGINT AS window_id, s::BIGINT AS first, (stop - 1)::BIGINT AS last FROM {prefix}_walk",
        f"{prefix}_walk"))
    def run(spark: SparkSession, sf: str) -> DataFrame:
        lines = F.filter(F.transform(F.split("text", "\n"), X.strip), lambda line: line != "")
        rows = C.documents(spark, sf, "doc_id", "text").select("doc_id", X.whitespace_tokens(lines).alias("counts"))
        found = rows.select(
            "doc_id",
            F.posexplode(pack_counts(F.col("counts"), LIMITS.child_target, LIMITS.child_max, overlap)).alias("window_id", "w"),
        )
        return found.select(
            "doc_id", F.col("window_id").cast("bigint").alias("window_id"),
            F.col("w.first").cast("bigint").alias("first"), F.col("w.last").cast("bigint").alias("last"),
        )


_packed("pack_windows", "plain", None)
_packed("pack_windows_overlap", "lapped", LIMITS.child_overlap)

# --- the whole chunker: documents are one section of prose each --------------------------

C.CTES["unit"] = (("sentence",), f"""
    SELECT doc_id, i AS sentence_no, start, piece, len(regexp_extract_all(piece, '[^{C.BLANK}]+')) AS n
    FROM sentence WHERE {C.sql_strip('piece')} <> ''""")
# A sentence over the parent cap is cut on words; every word is one token, so runs of 900 words.
C.CTES["word"] = (("unit",), """
    SELECT doc_id, sentence_no, k, word, start + sum(length(word)) OVER (PARTITION BY doc_id, sentence_no ORDER BY k) - length(word) AS off
    FROM (SELECT doc_id, sentence_no, start, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS k
          FROM (SELECT doc_id, sentence_no, start, regexp_extract_all(piece, '[^ ]+ *') AS ws FROM unit WHERE n > 900))""")
C.CTES["parent_unit"] = (("unit", "word"), """
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY off) - 1 AS i, off, raw, n FROM (
        SELECT doc_id, start AS off, piece AS raw, n FROM unit WHERE n <= 900 UNION ALL
        SELECT doc_id, min(off), string_agg(word, '' ORDER BY k), count(*) FROM word GROUP BY doc_id, sentence_no, k // 900)
    WHERE doc_id IN (SELECT doc_id FROM unit GROUP BY doc_id HAVING sum(n) > 900)""")
_pack_ctes("pwin", "parent_unit", "doc_id", LIMITS.parent_target, LIMITS.parent_max, LIMITS.parent_overlap)
_STRIP_RAW = C.sql_strip("raw")
C.CTES["chunk_parent"] = (("pwin_walk", "parent_unit", "doc_section", "unit"), f"""
    SELECT doc_id, w, {_STRIP_RAW} AS text, off::BIGINT AS start_char,
           {C.sql_id("1", "doc_id", _STRIP_RAW, "off::BIGINT")} AS parent_id,
           len(regexp_extract_all(raw, '[^{C.BLANK}]+')) AS tokens, source
    FROM (SELECT d.doc_id, 0 AS w, body AS raw, 0 AS off, source FROM doc_section d
          WHERE d.doc_id NOT IN (SELECT doc_id FROM parent_unit)
          UNION ALL
          SELECT k.doc_id, k.w, string_agg(u.raw, '' ORDER BY u.i), min(u.off), any_value(d.source)
          FROM pwin_walk k JOIN parent_unit u ON u.doc_id = k.doc_id AND u.i >= k.s AND u.i < k.stop
               JOIN doc_section d ON d.doc_id = k.doc_id GROUP BY k.doc_id, k.w)""")
C.CTES["child_unit"] = (("chunk_parent",), f"""
    SELECT doc_id, w, row_number() OVER (PARTITION BY doc_id, w ORDER BY i) - 1 AS i, off, raw,
           len(regexp_extract_all(raw, '[^{C.BLANK}]+')) AS n
    FROM (SELECT doc_id, w, i, piece AS raw, sum(length(piece)) OVER (PARTITION BY doc_id, w ORDER BY i) - length(piece) AS off
          FROM (SELECT doc_id, w, unnest(parts) AS piece, generate_subscripts(parts, 1) AS i FROM (
              SELECT doc_id, w, string_split(regexp_replace(regexp_replace(text, '([.!?][{C.BLANK}]+)', '\\1' || chr(1), 'g'),
                  '(\\n+)', '\\1' || chr(1), 'g'), chr(1)) AS parts FROM chunk_parent WHERE tokens > 280)))
    WHERE {_STRIP_RAW} <> ''""")
_pack_ctes("cwin", "child_unit", "doc_id, w", LIMITS.child_target, LIMITS.child_max, LIMITS.child_overlap)
C.CTES["cwin_walk"] = (C.CTES["cwin_walk"][0], C.CTES["cwin_walk"][1].replace("AS w FROM", "AS v FROM").replace("k.w + 1", "k.v + 1"))
C.CTES["chunk_child"] = (("cwin_walk", "child_unit", "chunk_parent"), f"""
    SELECT doc_id, chunk_id, parent_id, embed_text, start_char, end_char, body,
           row_number() OVER (PARTITION BY doc_id ORDER BY w, v) - 1 AS child_index FROM (
        SELECT doc_id, w, v, parent_id, {_STRIP_RAW} AS body, source || chr(10) || {_STRIP_RAW} AS embed_text,
               {C.sql_id("1", "doc_id", "source || chr(10) || " + _STRIP_RAW)} AS chunk_id,
               start_char + off AS start_char, start_char + off + length({_STRIP_RAW}) AS end_char
        FROM (SELECT doc_id, w, 0 AS v, parent_id, source, start_char, text AS raw, 0 AS off FROM chunk_parent WHERE tokens <= 280
              UNION ALL
              SELECT k.doc_id, k.w, k.v, any_value(p.parent_id), any_value(p.source), any_value(p.start_char),
                     string_agg(u.raw, '' ORDER BY u.i), min(u.off)::BIGINT
              FROM cwin_walk k JOIN child_unit u ON u.doc_id = k.doc_id AND u.w = k.w AND u.i >= k.s AND u.i < k.stop
                   JOIN chunk_parent p ON p.doc_id = k.doc_id AND p.w = k.w GROUP BY k.doc_id, k.w, k.v)
        QUALIFY row_number() OVER (PARTITION BY doc_id, embed_text ORDER BY w, v) = 1)""")


def document_passages(spark: SparkSession, sf: str) -> DataFrame:
    return passages(B.assign_offsets(_line_blocks(spark, sf)))


@_add("chunk_parents", C.sql("""
    SELECT doc_id, parent_id, start_char, start_char + length(text) AS end_char, tokens::BIGINT AS token_count, text,
           source AS heading_path, row_number() OVER (PARTITION BY doc_id ORDER BY w) - 1 AS parent_index
    FROM chunk_parent WHERE (doc_id, parent_id) IN (SELECT (doc_id, parent_id) FROM chunk_child)""",
    "chunk_parent", "chunk_child"))
def chunk_parents(spark: SparkSession, sf: str) -> DataFrame:
    rows = parent_rows(document_passages(spark, sf))
    return rows.select(
        "doc_id", "parent_id", "text", "heading_path",
        *[F.col(c).cast("bigint").alias(c) for c in ("start_char", "end_char", "token_count", "parent_index")],
    )


@_add("chunk_children", C.sql(f"""
    SELECT doc_id, chunk_id, parent_id, embed_text, start_char::BIGINT AS start_char, end_char::BIGINT AS end_char,
           child_index, len(regexp_extract_all(embed_text, '[^{C.BLANK}]+'))::BIGINT AS token_count FROM chunk_child""",
    "chunk_child"))
def chunk_children(spark: SparkSession, sf: str) -> DataFrame:
    rows = child_rows(document_passages(spark, sf))
    return rows.select(
        "doc_id", "chunk_id", "parent_id", "embed_text",
        *[F.col(c).cast("bigint").alias(c) for c in ("start_char", "end_char", "child_index", "token_count")],
    )


C.CTES["page"] = (("line",), """
    SELECT doc_id, n // 2 + 1 AS page, n, line FROM (
        SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS n FROM line)""")
C.CTES["banned"] = (("page",), """
    SELECT doc_id, line, n_pages_with, n_pages FROM (
        SELECT doc_id, line, count(DISTINCT page) AS n_pages_with FROM page WHERE length(line) < 80 GROUP BY doc_id, line)
    JOIN (SELECT doc_id, count(DISTINCT page) AS n_pages FROM page GROUP BY doc_id) USING (doc_id)
    WHERE n_pages >= 2 AND n_pages_with * 2 > n_pages""")


def _pages(spark: SparkSession, sf: str) -> DataFrame:
    """Documents printed two lines to a page."""
    lines = C.document_lines(spark, sf).withColumn("page", F.floor(F.col("block_index") / 2) + 1)
    text = F.array_join(F.array_sort(F.collect_list(F.struct("block_index", "line")))["line"], "\n")
    return lines.groupBy("doc_id", "page").agg(text.alias("text"))


@_add("page_chrome", C.sql("SELECT doc_id, line, n_pages_with, n_pages FROM banned", "banned"))
def page_chrome(spark: SparkSession, sf: str) -> DataFrame:
    return B.page_chrome(_pages(spark, sf)).select("doc_id", "line", "n_pages_with", "n_pages")


@_add("drop_page_chrome", C.sql("""
    SELECT doc_id, page, coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (keep), '') AS text FROM (
        SELECT page.*, banned.line IS NULL AS keep FROM page LEFT JOIN banned USING (doc_id, line))
    GROUP BY doc_id, page""", "page", "banned"))
def drop_page_chrome(spark: SparkSession, sf: str) -> DataFrame:
    return B.drop_page_chrome(_pages(spark, sf)).select("doc_id", "page", "text")
