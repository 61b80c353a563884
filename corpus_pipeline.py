"""The corpus pipeline: documents in, clean pieces out.

Each stage takes (spark, docs, sf_dir), works on every row that its predecessor kept, and returns a DataFrame, which `run` writes as
Parquet and rereads as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyledger.llm import decontaminate, near_dup, substring_dup, tokens, toxicity
from keyledger.llm.common import Scratch


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal model rejects go."""
    return toxicity.remove_toxic(docs, toxicity.train_from_tables(docs, sf_dir))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one with the smallest doc_id. 5-word shingles, Jaccard of 0.8 or more."""
    return near_dup.keep_one(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of over 50 words stay in the first document that has them; n_chars follows the text."""
    cut = substring_dup.remove_repeats(docs)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.remove_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of what is left."""
    return tokens.encode(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("substring_dedup", cut_repeated_passages),
    ("decontamination", drop_contaminated),
    ("sentencepiece", encode),
]

#: SQL expresses neither the fitted model nor the alignment; the stages are tested against plain versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to documents. A stage's table goes as soon as the next one's is written."""
    scratch = Scratch(spark, "pipeline")
    docs = saved = None
    for name, stage in STAGES:
        docs = spark.read.parquet(f"{sf_dir}/documents.parquet") if docs is None else docs
        now = scratch.save(stage(spark, docs, sf_dir), name)
        if saved is not None:
            scratch.drop(saved)
        docs = saved = now
    return docs
