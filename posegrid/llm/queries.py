"""The operators of this package as queries over the given tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from posegrid.llm import bpe, centroids, decontamination, licenses, order_minhash, pii, quality, simhash, substring_dedup, token_counts, toxicity, url_filter, whitening
from posegrid.llm.labelled import held_out


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(path: str | None = None) -> str:
    """Content of a tokenizer file; by default the public byte-level one of 50,000 merges."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.substring_dedup(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit_quality(docs, _read(spark, sf_dir, "labels"))
    out = quality.score_quality(docs, model)
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_digests(_read(spark, sf_dir, "documents"), vocabulary())


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontamination.find_overlaps(docs, _read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.explode("overlaps").alias("o")).select("doc_id", "o.*")


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return licenses.scan_licenses(docs, licenses.fit_licenses(docs))


def op6_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.edit_probe(_read(spark, sf_dir, "documents"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(_read(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(_read(spark, sf_dir, "documents"))
    counts = [F.expr(f"cast(size(filter(base, x -> x.rank = {k})) as bigint)").alias(f"n_{name}") for k, name in enumerate(pii.KINDS)]
    return found.select("doc_id", *counts, F.expr(f"sha2(cast({pii.span_text('base')} as binary), 256)").alias("base_sha256"), F.expr(pii.span_text("spans")).alias("spans"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_dedup(_read(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit_toxicity(docs, _read(spark, sf_dir, "labels"))
    out = toxicity.score_toxicity(docs, model)
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def piece_model(path: str | None = None) -> bytes:
    """Bytes of a sentencepiece model; by default the public one of 32,000 pieces."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    with open(path, "rb") as f:
        return f.read()


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(_read(spark, sf_dir, "embeddings"), k=40)


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_read(spark, sf_dir, "documents").select("doc_id", "text"), piece_model())


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_read(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_substring_dedup, op2_quality, op3_bpe, op4_decontamination, op5_licenses, op6_order_minhash, op7_url_filter, op8_pii, op9_simhash, op10_toxicity, op11_centroids, op12_token_counts, op13_whitening)}

#: Exact for tables of the size of the correctness check; windows are compared as text.
OP1_SQL = r"""
WITH words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
windows AS (
  SELECT doc_id, s, array_to_string(w[s:s + 19], ' ') AS t FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 19)) AS s FROM words WHERE len(w) >= 20)),
ranked AS (SELECT doc_id, s, row_number() OVER (PARTITION BY t ORDER BY doc_id, s) AS k FROM windows),
gone AS (SELECT DISTINCT doc_id, s + o AS i FROM ranked, (SELECT unnest(generate_series(0, 19)) AS o) WHERE k > 1),
each AS (SELECT doc_id, unnest(w) AS word, unnest(generate_series(1, len(w))) AS i FROM words),
kept AS (
  SELECT e.doc_id, count(g.i) AS n_removed, string_agg(CASE WHEN g.i IS NULL THEN e.word END, ' ' ORDER BY e.i) AS t
  FROM each e LEFT JOIN gone g ON e.doc_id = g.doc_id AND e.i = g.i GROUP BY e.doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(k.n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256
FROM words d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""

ORACLE_SQL = {"op1_substring_dedup": OP1_SQL, "op7_url_filter": url_filter.SQL, "op11_centroids": centroids.sql()}
