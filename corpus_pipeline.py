"""A training-corpus pipeline over `documents`: five stages, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.functions.workers import stored
from tidegraph.llm import langid, mixing, pieces, quality, simhash

#: A text stays if its language holds at least this part of its n-grams, and if its quality is at least so probable.
LEAST_HELD, LEAST_QUALITY = 0.3, 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a learned language; those without letters or of n-grams that no learned language holds go.

    Learned from labelled documents; all rows are judged by their text alone. Where nothing can be learned, only texts without letters go.
    """
    model = langid.train(docs.select("doc_id", "text", "lang"))
    if not model.languages:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    told = langid.predict(docs, model, tuple(docs.columns), "__")
    return told.filter((F.col("__lang_pred") != langid.UNKNOWN) & (F.col("__held") >= LEAST_HELD)).select(*docs.columns)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose combined, calibrated probability of good quality is at least one half."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs, model, tuple(docs.columns), "__").filter(F.col("__score") >= LEAST_QUALITY).select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of exact or near copies: SimHash candidates, five-word shingles of similarity 0.8 or more."""
    return simhash.without_near_copies(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as the mix of sources takes them: some left out, some repeated."""
    return mixing.mixed_documents(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document of the mix."""
    return pieces.encode_digest(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", language),
    ("quality classifier", good_quality),
    ("SimHash near-dedup", one_of_each),
    ("mixing sources", mixture),
    ("SentencePiece", encoded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


#: Learned models decide, which SQL can't express; tests hold the stages against brute force.
ORACLE_SQL = None
