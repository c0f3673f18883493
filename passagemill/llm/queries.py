"""The named queries of this package and the SQL for those that SQL can say."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagemill.llm import (
    chat, decontaminate, language, licenses, maxent, negatives, ngram_join, permutations, sentence_pieces,
    sharding, token_counts, warc, whitening,
)
from passagemill.llm.common import crc_fold, cut_lineage, read, scratch_path


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and tokens at, over and under every context limit."""
    histogram = cut_lineage(token_counts.length_histogram(read(spark, sf_dir, "documents", "text")))
    return token_counts.context_limits(histogram)


def op2_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sampled segmentation of every document and whether it decodes to its text."""
    return sentence_pieces.round_trip(read(spark, sf_dir, "documents", "doc_id", "text"))


def op3_maxent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's log probability under models learnt outside one fold of the ids."""
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    held_out = crc_fold("doc_id", 7, 2)
    scored = maxent.score(docs, ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence evidence of every document."""
    return licenses.scan(read(spark, sf_dir, "documents", "doc_id", "text"))


def op5_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows of every vector whose id is divisible by 20."""
    vectors = read(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return permutations.search(vectors, vectors.where("vec_id % 20 = 0"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, and one of control strings only, read back from its formatted tokens."""
    rows = read(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    own = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", own), (-1, 1, "assistant", own)], "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.format_turns(rows.unionByName(extra)))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of every document under links of 0.8 or more."""
    return ngram_join.join(read(spark, sf_dir, "documents", "doc_id", "text"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best window of each benchmark item in each document that holds it."""
    return decontaminate.contaminated(read(spark, sf_dir, "documents", "doc_id", "text"), read(spark, sf_dir, "benchmark", "item_id", "text"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of every document, learnt outside one fold of the ids."""
    docs = read(spark, sf_dir, "documents", "doc_id", "text", "lang")
    model = language.fit(docs, ~crc_fold("doc_id", 4, 2))
    found = language.identify(docs, model)
    return found.select("doc_id", crc_fold("doc_id", 4, 2).alias("held_out"), "lang_pred", "score", "rejected")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as the archives give it back."""
    path = scratch_path(spark)
    warc.write_archives(read(spark, sf_dir, "pages", "page_id", "url", "html"), path)
    return warc.read_archives(spark, path, payload=False)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first eight whitened components of every vector."""
    white = whitening.whiten(read(spark, sf_dir, "embeddings", "vec_id", "embedding"))
    return white.withColumn("deviation", F.col("deviation").try_cast("bigint"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to ten hard negatives of each of the five nearest positives of every hundredth vector."""
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(read(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"), F.col("id") % 100 == 0, label=shifted)


def op13_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard and slot of every document, counts at most one apart."""
    placed = sharding.assign(read(spark, sf_dir, "documents", "doc_id", "text"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "home")


QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_sentence_pieces": op2_sentence_pieces,
    "op3_maxent_lm": op3_maxent_lm,
    "op4_license_scan": op4_license_scan,
    "op5_permutation_index": op5_permutation_index,
    "op6_chat_format": op6_chat_format,
    "op7_ngram_join": op7_ngram_join,
    "op8_decontamination": op8_decontamination,
    "op9_language_id": op9_language_id,
    "op10_warc": op10_warc,
    "op11_whitening": op11_whitening,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_ring_shards": op13_ring_shards,
    "pipeline": corpus_pipeline.run,
}

SQL = {
    "op12_hard_negatives": negatives.SQL,
    "op13_ring_shards": sharding.SQL,
    "op10_warc": """
        WITH p AS (SELECT page_id, url, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS d,
                          octet_length(encode(coalesce(html, '')))::BIGINT AS n FROM pages),
             g AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS last FROM p)
        SELECT page_id, coalesce(array_to_string(list_filter(regexp_split_to_array(url, '[ \\t\\r\\n]+'), lambda x: x <> ''), ' '), '') AS url,
               n AS payload_bytes, d AS payload_digest,
               CASE WHEN n >= 1000 AND last <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN n >= 1000 AND last <> page_id THEN last END AS refers_to
        FROM g""",
    "op6_chat_format": """
        WITH rows AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
            UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
        marked AS (
            -- A backslash is doubled; one is put behind the first character of every control string.
            SELECT *, length(role) + length(text) + length(regexp_replace(text, '[^\\\\]', '', 'g'))
                + length(regexp_replace(role, '[^\\\\]', '', 'g'))
                + len(regexp_extract_all(text, '<\\|(?:turn|text|close|endoftext|im_start|im_end|system|user|assistant|begin_of_text|end_of_text|eot_id|start_header_id|end_header_id)\\|>|</?s>|\\[/?INST\\]|<</?SYS>>|<unk>|<pad>|<(?:start|end)_of_turn>'))
                + len('<|turn|>') + len('<|text|>') + len('<|close|>') AS chars FROM rows)
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               sum(chars)::BIGINT AS formatted_chars
        FROM marked GROUP BY conv_id""",
}
