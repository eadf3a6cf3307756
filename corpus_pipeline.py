"""A training-corpus pipeline: five stages over documents, in order.

Toxic documents go; lines that repeat an earlier similar line go, and with them
the documents of which no line is left; of each group of near copies one
document stays; sources are mixed to their target weights, by
repeating or leaving out documents; the texts become token ids.  Each stage
keeps the columns of documents, but for the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronogrid.llm import bpe, line_dedup, mixing, near_dedup, toxicity
from chronogrid.llm.shared import cut


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the grammar, fitted on the labels, does not reject."""
    return toxicity.keep_clean(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without redundant lines; those that only had such lines go,
    as all they hold stands in earlier documents.  n_chars follows the text."""
    out = line_dedup.drop_redundant(docs)
    return out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else out


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, 80 %)."""
    return near_dedup.dedup_near(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks for."""
    return mixing.mix_sources(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and the digests of ids and decoded text."""
    return bpe.digests(docs, bpe.vocabulary("word_bpe_49k.json"), with_ids=True)


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_lines), ("near_dedup", drop_copies), ("mixing", mix), ("bpe", encode)]
#: Rounding to copies and the tokenizer are not for SQL; tests hold the stages
#: against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
