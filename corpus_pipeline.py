"""A training-text pipeline: each stage takes (spark, docs, sf_dir), gets what its predecessor
kept, and is written as Parquet before the next one reads it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from posegrid.llm import bpe, decontamination, pii, similar_sets, toxicity
from posegrid.llm.queries import vocabulary
from posegrid.session import shared_dir


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a calibrated probability of toxicity under 0.5. Null texts are scored as empty ones;
    repeated rows have one score; an empty table stays empty."""
    model = toxicity.fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score_toxicity(docs, model, out_col="_score").where("_score < 0.5").drop("_score")


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each near-duplicate group: texts linked where
    their sets of five-word shingles have a Jaccard similarity of at least 0.8, by SimHash and, for
    what its 3 bits can't reach, by shared prefixes; every link is verified on the sets.
    Documents without an id belong to no group and stay."""
    groups = similar_sets.similar_groups(docs, shingle=5, least=0.8)
    stay = groups.where("doc_id = component_id").select("doc_id").distinct()
    return docs.join(stay, "doc_id", "left_semi").unionByName(docs.where("doc_id IS NULL"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a verified overlap with a benchmark item. Null and empty texts have none and stay;
    repeated rows go or stay together."""
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind and n_chars brought up to date."""
    return pii.redact(docs)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the text decoded from them, a row for each row.
    Null texts are encoded as empty ones, with no tokens."""
    return bpe.bpe_digests(docs, vocabulary())


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("bpe", bpe_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    at = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{name}")
        docs = spark.read.parquet(f"{at}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: Trained and iterative stages can't be said in SQL; tests hold each against a plain version.
ORACLE_SQL = None
