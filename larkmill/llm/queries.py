"""The registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import audio, decontaminate, lm_scores, neardup, packing, quality, secrets, sentences, toxicity, urls
from .common import materialize

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.digest(toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels"))))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(packing.pack(table(spark, sf_dir, "documents"), with_ids=False))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.digest(quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels"))))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan_secrets(table(spark, sf_dir, "documents")))


def op6_chroma_prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    prints = materialize(audio.fingerprints(audio.rendered(table(spark, sf_dir, "embeddings"))), "audio-prints")
    return audio.digest(audio.align(prints))


def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.digest(urls.judge(table(spark, sf_dir, "pages")))


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op9_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.dedup(table(spark, sf_dir, "documents"))


def op10_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores.score(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_toxicity": op2_toxicity,
    "op3_packing": op3_packing,
    "op4_quality": op4_quality,
    "op5_secrets": op5_secrets,
    "op6_chroma_prints": op6_chroma_prints,
    "op7_urls": op7_urls,
    "op8_ngram_jaccard": op8_ngram_jaccard,
    "op9_sentence_spans": op9_sentence_spans,
    "op10_lm_scores": op10_lm_scores,
}

_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

ORACLE: dict[str, str] = {
    "op1_decontaminate": rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWERED}, '{_WORD}') AS ws FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS i, regexp_extract_all({_LOWERED}, '{_WORD}') AS ws FROM benchmark),
bw AS (SELECT DISTINCT i, n, array_to_string(ws[s + 1 : s + n], ' ') AS k
       FROM (SELECT i, ws, least(10, len(ws)) AS n, unnest(range(0, greatest(1, len(ws) - 9))) AS s FROM b WHERE len(ws) > 0)),
g AS (SELECT r, n, s, array_to_string(ws[s + 1 : s + n], ' ') AS k
      FROM (SELECT r, ws, n, unnest(range(0, len(ws) - n + 1)) AS s FROM d, (SELECT DISTINCT n FROM bw) WHERE len(ws) >= n)),
h AS (SELECT r, s, g.n, i FROM g JOIN bw USING (n, k)),
p AS (SELECT r, count(DISTINCT pos) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS pos FROM h) GROUP BY r),
q AS (SELECT r, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items FROM (SELECT DISTINCT r, i FROM h) GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (r) LEFT JOIN q USING (r)""",
}
