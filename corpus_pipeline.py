"""The corpus pipeline over ``documents``: five operators, each on all that the one before it kept.

Quality rules drop documents, near-duplicate groups keep one document, repeated passages lose their bytes,
contaminated documents go, and what is left is packed into training sequences. Every stage takes
``(spark, docs, sf_dir)`` and, but for the last, returns the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom import shared
from edgeloom.llm import decontaminate, packing, quality, simhash, substring_dedup


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are probably good."""
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group: fingerprints within 4 bits, or five-word shingles alike to 0.8 or more."""
    return simhash.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of over 50 words, or 400 bytes, that occur elsewhere too; ``n_chars`` follows the text."""
    rows = substring_dedup.remove_repeats(docs, substring_dedup.PASSAGE, whole_characters=True, passages_only=True)
    text = F.decode("kept", "UTF-8")
    new = {"text": text, "n_chars": F.length(text).cast("long")}
    return rows.select(*(new.get(c, F.col("doc").getField(c)).alias(c) for c in docs.columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of any benchmark item."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequences, places and token ids."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("decontamination", decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: SQL has no tokenizer and no fingerprints by bit majority; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each stage's result is a table that the next one reads.

    A stage's own tables go when its result is stored, and that when the next one's is.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    *filters, (_, last) = STAGES
    for name, stage in filters:
        place = shared.new_folder(spark, name)
        with shared.dropped_at_end(spark):
            result = stage(spark, docs, sf_dir)
            result.write.parquet(place)
        docs = spark.read.schema(result.schema).parquet(place)
        if before is not None:
            shared.drop(spark, before)
        before = place
    return last(spark, docs, sf_dir)
