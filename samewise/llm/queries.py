"""The registered queries of this subpackage: each applies its operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from samewise.llm.substring_dedup import substring_dedup

    return substring_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), digest=True)


OP1_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) >= 13)),
firsts AS (SELECT k, min(doc_id) AS m FROM p GROUP BY k),
gone AS (SELECT DISTINCT doc_id, i + j AS i FROM (SELECT p.doc_id, p.i FROM p JOIN firsts USING (k) WHERE m < p.doc_id), range(13) r(j)),
each AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS t, count(*) AS n FROM each ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT w.doc_id, len(ws) AS n_words, len(ws) - coalesce(kept.n, 0) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)
"""


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from samewise.llm.token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from samewise.llm.sentencepieces import encoded

    return encoded(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model")).drop("ids")


def op4_embedding_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    from samewise.llm.embedding_dedup import embedding_links

    return embedding_links(table(spark, sf_dir, "embeddings"))


OP4_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
reach AS (SELECT vec_id AS x, vec_id AS y FROM v UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x),
least AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x),
counts AS (SELECT x, count(*) AS n FROM links GROUP BY x)
SELECT v.vec_id, coalesce(counts.n, 0)::BIGINT AS n_links, least.component_id, v.vec_id = least.component_id AS kept
FROM v JOIN least ON least.x = v.vec_id LEFT JOIN counts ON counts.x = v.vec_id
"""


def op5_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from samewise.llm.minhash_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def held_out() -> Column:
    """crc32 of doc_id as text, modulo 5, is 0; a null id counts as held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(True))


def toxicity_model(spark: SparkSession, docs: DataFrame, sf_dir: str):
    from samewise.llm.toxicity import fit

    return fit(docs, table(spark, sf_dir, "labels").where(~held_out()))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from samewise.llm.toxicity import toxicity

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity(docs, toxicity_model(spark, docs, sf_dir))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_media_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    from samewise.llm.media_audio import audio_roundtrip

    return audio_roundtrip(table(spark, sf_dir, "documents")).drop("seek_offsets")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from samewise.llm.warc import warc_roundtrip

    return warc_roundtrip(table(spark, sf_dir, "pages"))


OP8_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages), f AS (SELECT payload, min(page_id) AS first FROM p GROUP BY payload),
b AS (SELECT page_id, payload, first, array_to_string(list_transform(range(1, 41), lambda h: lpad(bin(instr('0123456789abcdef', substr(sha1(payload), h, 1)) - 1), 4, '0')), '') AS bits FROM p JOIN f USING (payload))
SELECT page_id, strlen(payload) AS payload_bytes, array_to_string(list_transform(range(0, 32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_sum(list_transform(range(1, 6), lambda k: CAST(substr(bits, 5 * j + k, 1) AS INT) * CAST(pow(2, 5 - k) AS INT)))::INT, 1)), '') AS payload_digest,
CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM b
"""


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from samewise.llm.quality import fit, quality

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality(docs, fit(docs)).drop("text")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from samewise.llm.packing import best_fit_packing

    return best_fit_packing(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {f.__name__: f for f in (op1_substring_dedup, op2_token_counts, op3_sentencepiece, op4_embedding_links, op5_minhash_dedup, op6_toxicity, op7_media_audio, op8_warc, op9_quality, op10_best_fit_packing)}
ORACLES: dict[str, str] = {"op1_substring_dedup": OP1_SQL, "op4_embedding_links": OP4_SQL, "op8_warc": OP8_SQL}
