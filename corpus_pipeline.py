"""A training-corpus pipeline; its stages are operators of ``adeptus.llm``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next one's ``docs``.  All but the
last return the columns of ``docs``.  Labels and the tokenizer are the only
other inputs.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adeptus.llm import bpe, mixing, neardup, quality, toxicity
from adeptus.llm.queries import QUALITY_TRAIN, TOXICITY_TRAIN, fold
from adeptus.llm.shared import written

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is 0.5 or more."""
    sample = quality.labelled_sample(docs, _labels(spark, sf_dir), "quality", fold("k", 3) != 1, QUALITY_TRAIN)
    scored = quality.score(docs, quality.fit(sample), carry=docs.columns, out="__score")
    return scored.filter("__score >= 0.5").drop("__score")


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.5."""
    sample = quality.labelled_sample(docs, _labels(spark, sf_dir), "toxic", fold("k", 5) != 0, TOXICITY_TRAIN, by_label=True)
    scored = toxicity.score(docs, toxicity.fit(sample), carry=docs.columns, out="__score")
    return scored.filter("__score < 0.5").drop("__score")


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each near-duplicate class."""
    return neardup.deduplicated(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn so that source, language and topic have their target shares, as many tokens as before.

    Documents of rare cells are repeated, with their ids.
    """
    return mixing.sampled(docs, mixing.chances(docs, budget=mixing.BUDGET, power=mixing.POWER))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, round_trip): ids packed as little-endian 32-bit, and whether they decode to the text."""
    carried = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    encoded = bpe.encode(carried, RANKS, public_tokenizers.PATTERN, carry=["doc_id", "text"])
    return bpe.decode(encoded, RANKS).select(
        "doc_id", "n_tokens", "ids", (F.col("decoded") == F.encode("text", "UTF-8")).alias("round_trip"))


STAGES = [
    ("quality", quality_stage),
    ("toxicity", toxicity_stage),
    ("near_dedup", near_dedup_stage),
    ("mixing", mixing_stage),
    ("byte_bpe", bpe_stage),
]

#: Trained classifiers and near-duplicate classes can't be expressed in SQL; tests/llm has the brute-force checks.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, from the table of documents."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
