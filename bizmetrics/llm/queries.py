"""Registered queries of the training-data operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bizmetrics.llm import (
    bpe, exact, language, licenses, ngram_join, packing, phrases, pii, quality, search, substrings, tokenfile, warc,
)
from bizmetrics.llm.shared import scratch, store


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_links(_documents(spark, sf_dir), ngram_join.Similarity(3, 90, 100))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_documents(spark, sf_dir), _tokenizer("byte_bpe_multi_50k.tiktoken"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_documents(spark, sf_dir))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeated(_documents(spark, sf_dir)).drop("kept_text")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(_documents(spark, sf_dir))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "token-files")
    tokenfile.write(_documents(spark, sf_dir), path, _tokenizer("byte_bpe_50k.json"))
    return tokenfile.checksums(tokenfile.read(spark, path))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_documents(spark, sf_dir), _tokenizer("byte_bpe_50k.json"))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(_documents(spark, sf_dir))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(_documents(spark, sf_dir))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive all pages, copy the archive with one record in 256 damaged, audit the copy."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    primary, replica = scratch(spark, "warc"), scratch(spark, "warc-replica")
    warc.write(pages, primary)
    damaged = F.substring(F.md5("id"), 1, 2) == "07"
    warc.copy(
        warc.files(spark, primary), replica,
        F.when(damaged, F.concat(F.lit("warc"), F.expr("substring(record, 5)"))).otherwise(F.col("record")),
    )
    found = store(warc.records(warc.files(spark, primary)).drop("record"), "warc-records")
    kind = pages.schema["page_id"].dataType
    return warc.audit(found, warc.files(spark, replica)).select(
        F.when(F.col("id") != "", F.col("id")).cast(kind).alias("page_id"),
        "length", "sha256", "replica_ok", "replica_sha256",
    )


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_documents(spark, sf_dir))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(_documents(spark, sf_dir))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.ranked(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_ngram_jaccard_join": op1,
        "op2_byte_bpe": op2,
        "op3_license_scan": op3,
        "op4_substring_dedup": op4,
        "op5_quality_rules": op5,
        "op6_token_files": op6,
        "op7_best_fit_packing": op7,
        "op8_language_id": op8,
        "op9_exact_dedup": op9,
        "op10_warc_fixity": op10,
        "op11_phrase_collocations": op11,
        "op12_personal_data": op12,
        "op13_lexical_search": op13,
    }
