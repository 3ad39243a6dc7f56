"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom.llm import oracles


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from edgeloom.llm import toxicity

    docs = _table(spark, sf_dir, "documents")
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1
    train = toxicity.join_labels(docs, _table(spark, sf_dir, "labels").where(~held_out).select("doc_id", "toxic"))
    scored = toxicity.score(docs, toxicity.fit(train)).withColumn("held_out", F.coalesce(held_out, F.lit(False)))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from edgeloom.llm.url_filter import judge

    good = F.expr("case when quality = 1 and toxic = 0 then 1 when quality is not null and toxic is not null then 0 end")
    labels = _table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), good.alias("good"))
    return judge(_table(spark, sf_dir, "pages"), labels)


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from edgeloom.llm.decontaminate import contamination

    found = contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest, "contaminated")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from edgeloom.llm.packing import pack

    packed = pack(_table(spark, sf_dir, "documents"))
    place = ("doc_id", "piece", "start", F.col("length").cast("long").alias("length"))
    return packed.select(*place, F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from edgeloom.llm.substring_dedup import PASSAGE, remove_repeats

    rows = remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"), passage=PASSAGE)
    return rows.select("doc.doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "n_passage")


def op6_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from edgeloom.llm.token_planes import token_digests

    return token_digests(_table(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from edgeloom.llm.simhash import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from edgeloom.llm import chat

    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
                                  F.lit("</s>[INST] ok [/INST]").alias("text"))
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.chat_digests(chat.format_chats(rows.withColumn("parts", chat.text_part(F.col("text")))))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from edgeloom.llm.warc import archive_records

    return archive_records(_table(spark, sf_dir, "pages"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from edgeloom.llm.quality import judge

    judged = judge(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return judged.select("doc.doc_id", *counts, "base_failed", "kept", "quality")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from edgeloom.llm.vector_codes import compress

    return compress(_table(spark, sf_dir, "embeddings"))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from edgeloom.llm.centroids import clustered

    return clustered(_table(spark, sf_dir, "embeddings"))


def op13_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from edgeloom.llm.embedding_dedup import near_vectors

    return near_vectors(_table(spark, sf_dir, "embeddings"))


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return oracles.oracle_sql()
