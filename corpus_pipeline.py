"""The training-data pipeline over ``documents``: each stage works on what the one before kept.

quality (4) drops documents that the classifier rejects; lines (5) cuts passages that an
earlier document has; copies (1) keeps one document of each group of near copies; leaks (7)
drops documents that hold a benchmark item; mixture (9) realises the weights of the sources
and adds how often each document is used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spoor.llm import decontam, mixing, quality, simhash, winnow
from spoor.llm.common import held_out, stored, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches the threshold; empty texts are scored like any other."""
    known = table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id")))
    scored = quality.score(docs, quality.fit(docs, known), name="_score")
    return scored.where(F.col("_score") >= quality.THRESHOLD).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, later repeats cut out; ``n_chars`` follows the text."""
    return winnow.drop_repeats(docs).withColumn("n_chars", F.length("text").cast("long")).select(
        *docs.columns
    )


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: SimHash groups by operator 1, then, of what they
    left, texts whose shingle sets are alike but whose fingerprints are further apart."""
    groups = simhash.near_groups(docs)
    firsts = groups.where(F.col("id").eqNullSafe(F.col("component"))).select("id").distinct()
    return simhash.one_of_each(docs, among=firsts)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the mixture with ``repeats`` and ``block``."""
    return mixing.mix(docs)


STAGES = [
    ("quality", keep_quality),
    ("lines", drop_repeated_lines),
    ("copies", drop_copies),
    ("leaks", drop_leaks),
    ("mixture", mix_sources),
]
# SQL cannot state the classifier; tests compare the stages with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to the table of documents; each result is stored and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
