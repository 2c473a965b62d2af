"""The corpus pipeline: quality rules, line dedup, near-duplicates, mixing, piece encoding.

Each stage takes (spark, docs, sf_dir) and gives a frame that is written as
Parquet and read again as the next stage's documents.
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from loadcast.llm import linededup, mixing, neardup, quality, sentencepieces  # noqa: E402
from loadcast.llm.queries import TOKENIZERS  # noqa: E402
from loadcast.sources.scratch import materialize  # noqa: E402


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base test and the learned rules."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that stand, nearly alike, in an earlier one; those left without a word go."""
    had = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    marked = linededup.dedup_lines(docs, counts=True, min_chars=1)
    return marked.filter(had | (F.col("n_dropped") == 0)).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return neardup.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often, and as much of them, as the target weights of the sources ask for."""
    return mixing.mix(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every row that is left."""
    vocabulary = sentencepieces.Vocabulary.load(f"{TOKENIZERS}/piece_bpe_32k.model")
    return sentencepieces.encode(docs, vocabulary)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near-duplicates", near_dedup),
    ("mixing", mix_sources),
    ("piece encoding", encode_pieces),
]

# The learned rules, the fuzzy lines and the lattice have no SQL; the operators' tests hold each against a plain version on rows of their own.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
