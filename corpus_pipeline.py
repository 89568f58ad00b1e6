"""A training corpus from `documents`: language ID, line dedup, near-duplicate groups,
benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as Parquet and
reads again as the next stage's docs.  All but the last return the columns of docs.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memspark.llm import decontaminate, jaccard, langid, lines, packing
from memspark.llm.common import discard, distinct_rows, read, small_batches, written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with an identified language, by a model of these documents' own lang labels; texts
    that are null or without letters, and those of a calibrated score under 0.35, go."""
    small_batches(spark)
    return langid.keep_identified(docs, langid.train(docs), min_score=0.35)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that match an earlier line (80 of 100 words, or
    of 100 character 3-grams of lines of few words); n_chars follows.  A
    document of which only white space is left goes, and of equal rows all but
    one."""
    small_batches(spark)
    kept, _, removed = lines.rewritten(distinct_rows(docs), percent=80, min_words=1, grams=16)
    kept = kept.where((F.col(removed) == 0) | F.col("text").rlike(r"\S"))
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.when(F.col(removed) == 0, F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return kept.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles of Jaccard similarity 0.8 or more."""
    small_batches(spark)
    return jaccard.one_of_each_group(docs, words=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of `benchmark`, up to a tenth of its bytes edited."""
    small_batches(spark)
    return decontaminate.drop_leaks(docs, read(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 4096 tokens."""
    small_batches(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), 2, keep_encoder=False)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("packing", packed),
]

#: The first, fourth and fifth stage (a trained model, alignments, a tokenizer) have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages' result; a stage's table goes when the next one is written."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if hasattr(before, "written_to"):
            discard(before)
    return docs
