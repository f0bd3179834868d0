"""Cleans `documents` for training: five operators one after the other.

quality rules -> line dedup -> near-dedup -> benchmark decontamination -> BPE encoding. Each stage
works on all that its predecessor kept, is written as Parquet and read again; all but the last return
the columns of `documents`. Stages with Python code bound the session's Arrow batches by bytes, unless it does so itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.llm import bpe_automaton, decontamination, line_dedup, near_copies, quality, simhash
from lacuna.llm.common import bound_batches
from lacuna.llm.queries import tokenizer_path
from lacuna.staging import new_path, remove, temporary


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, without the lines that they remove; n_chars follows the text."""
    judged = quality.judge(docs).where("kept")
    return judged.withColumn("n_chars", F.when(F.col("n_removed_chars") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))).select(docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the boilerplate lines of their hosts; n_chars follows the text."""
    cleaned = line_dedup.drop_boilerplate(docs)
    return cleaned.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))).select(docs.columns)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates. Rows that repeat an id as a whole
    count as one; a row with a null id stays only if its whole group has none. Near duplicates are linked by op8's SimHash
    (at most three differing bits) or, what so small a distance misses, by a Jaccard similarity of at least 0.8 in word 5-grams."""
    bound_batches(spark)
    return simhash.keep_first(docs, grouped=near_copies.copies)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of `benchmark`."""
    bound_batches(spark)
    return decontamination.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept documents with their token ids and the hashes of the encoding and of what it decodes to."""
    bound_batches(spark)
    return bpe_automaton.encode(docs, tokenizer_path(), ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", keep_quality),
    ("line_dedup", drop_lines),
    ("simhash", keep_one_of_each),
    ("decontamination", decontaminate),
    ("bpe_encoding", encode),
]

#: SQL can express neither fingerprints, alignments nor BPE; tests/llm hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = new_path(spark, name)
        with temporary(spark):  # what a stage wrote on its way, and its input, go when it is done
            made = stage(spark, docs, sf_dir)
            made.write.parquet(path)
        docs = spark.read.schema(made.schema).parquet(path)
        if before:
            remove(spark, before)
        before = path
    return docs
