"""The registered queries of the operators: thin calls with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, binpacking, conversations, decontaminate, jaccard, langid, lines, media, packing, repeats, token_counts, token_files, toxicity
from .common import read, written
from .sql import ORACLE_SQL  # noqa: F401


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    held = langid.in_fold(4, 2)
    model = toxicity.train(docs, labels.where(~held))
    return toxicity.score(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted")


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_groups(read(spark, sf_dir, "documents"), words=3, percent=90)


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_features(written(media.store_media(read(spark, sf_dir, "documents")), "media"))


def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(read(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.read_ids(token_files.write_ids(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 2))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2)


def op9_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"), min_words=1, grams=16)


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held = langid.in_fold(3, 1)
    return langid.predict(docs, langid.train(docs.where(~held))).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.digests(conversations.repair(conversations.damaged(read(spark, sf_dir, "conversations")), F.col("present")))


def op12_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binpacking.pack(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 0)


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = alignment.align(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    return found.select("doc_id", *alignment.NUMBERS, F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256)).alias("groups_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_toxicity": op2_toxicity,
    "op3_jaccard": op3_jaccard,
    "op4_media": op4_media,
    "op5_repeats": op5_repeats,
    "op6_token_counts": op6_token_counts,
    "op7_token_files": op7_token_files,
    "op8_packing": op8_packing,
    "op9_lines": op9_lines,
    "op10_langid": op10_langid,
    "op11_conversations": op11_conversations,
    "op12_bins": op12_bins,
    "op13_alignment": op13_alignment,
}
