"""A corpus, cleaned and packed: quality rules, duplicates, passages, sequences.

Each stage takes what its predecessor wrote, judges all of it, and writes what it keeps; all
but the last return the columns of ``documents``. Scratch tables of a stage are deleted when
the next one starts, as its result has been written by then.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bizmetrics.llm import exact, ngram_join, packing, quality, shared, substrings

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
NEAR = ngram_join.Similarity(words=5, num=80, den=100)
TOKENIZER = "byte_bpe_50k.json"
_scratch: list[str] = []


def _stage(function: Callable) -> Callable:
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        shared.delete(spark, _scratch)
        _scratch.clear()
        since = shared.mark()
        result = function(spark, docs, sf_dir)
        _scratch.extend(shared.taken(since))
        return result

    run_stage.__doc__, run_stage.__name__ = function.__doc__, function.__name__
    return run_stage


@_stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the counts or the perplexity band reject go. A null text has no words
    and goes; rows that repeat an id are judged by their own texts."""
    judged = quality.quality(docs, carry=COLUMNS[1:])
    return judged.filter("kept").select(*COLUMNS)


@_stage
def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z lower-cased) the row with the largest doc_id stays; of rows that
    repeat id and text exactly one; null texts are equal to empty ones."""
    return exact.exact_groups(docs, carry=COLUMNS[1:]).filter("kept").select(*COLUMNS)


@_stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents one stays: that with the smallest doc_id, of equal
    ids that with the smallest hash of its text; a null id comes last. Texts without words are
    in no group. Rows that repeat id and text are one document, and stay or go together."""
    linked = ngram_join.ngram_links(docs, NEAR, detail=True)
    alone = linked.filter("root is null").select("doc_id", "fp")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "fp")).alias("one")
    chosen = linked.filter("root is not null").groupBy("root").agg(first).select("one.doc_id", "one.fp")
    stay = alone.union(chosen).select(F.col("doc_id").alias("stays"), F.col("fp").alias("stays_fp")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("stays")) & (F.xxhash64("text") == F.col("stays_fp"))
    return docs.join(stay, same, "left_semi").select(*COLUMNS)


@_stage
def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages that a document with a smaller id has too go; a document of which
    no word is left goes. Untouched texts stay as they are; a null one becomes empty."""
    cut = substrings.remove_repeated(docs, carry=("lang", "source", "n_chars"))
    return cut.filter("n_removed = 0 or n_removed < n_words").select(
        "doc_id", F.col("kept_text").alias("text"), "lang", "source",
        F.when(F.col("n_removed") > 0, F.length("kept_text").cast(docs.schema["n_chars"].dataType))
        .otherwise(F.col("n_chars")).alias("n_chars"),
    )


@_stage
def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, tokenized and packed; an empty text is its end id."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_dedup),
    ("n-gram Jaccard join", near_dedup),
    ("substring dedup", substring_dedup),
    ("best-fit packing", best_fit_packing),
]

# The perplexity model and the tokenizer are not SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = shared.store(stage(spark, docs, sf_dir), name.replace(" ", "-").lower())
    return STAGES[-1][1](spark, docs, sf_dir)
