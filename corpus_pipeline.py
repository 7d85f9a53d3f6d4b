"""A corpus pipeline of five stages over ``documents``: toxic documents go, one of
each group of near copies stays, personal data is masked, sources are mixed to
their target weights, and what is left is tokenised.

Stages take (spark, docs, sf_dir) and return a DataFrame; each result is written
as Parquet in the shared folder and read again as the next stage's docs. All but
the last return the columns of documents, with n_chars kept in step with the text.

Further columns pass through the first four stages as they are, whatever their names.
Null and empty texts are never toxic or copies, hold no personal data, have no tokens
and so no leaf of the mixture unless documents with tokens share it; rows without an id
are treated like others and leave without one; of repeated rows near_dedup keeps one.
Empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlog.llm import bpe, mixing, neardup, pii, toxicity
from strandlog.llm.common import stored, table, unused


def clean_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"), ~toxicity.held_out())
    score = unused("score", docs.columns)
    return toxicity.apply(docs, model, score).where(F.col(score) < toxicity.CUT).drop(score)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles, similarity 0.8; the document with the smallest id stays."""
    return neardup.deduplicated(docs, 5)


def mask_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redacted(docs).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the digests of ids and decoded bytes."""
    return bpe.encode(docs, ids=True, digests=True)


STAGES = [("toxicity", clean_toxicity), ("near_dedup", near_dedup), ("pii", mask_pii), ("mixing", mix_sources), ("byte_bpe", tokenise)]
#: Learnt models, components and tokens are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
