"""The operators' queries over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vicinia.llm import toxicity

    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), label="toxic", sample=6000)
    return toxicity.score(docs, model, threshold=0.7)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vicinia.llm.simhash import near_duplicates

    out = near_duplicates(table(spark, sf_dir, "documents"), distance=3, width=3)
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vicinia.llm.suffix_dedup import dedup

    return dedup(table(spark, sf_dir, "documents"), least=100, with_text=False).drop("spans")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vicinia.llm.sharding import shard

    out = shard(table(spark, sf_dir, "documents"), shards=16)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vicinia.llm.line_dedup import removed

    out = removed(table(spark, sf_dir, "documents"), pairs=True)
    return out.select(F.col("id").alias("doc_id"), "chunk", "n_lines", "n_chars", F.col("kept_id").alias("kept_doc_id"), "kept_chunk")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vicinia.llm.substring_dedup import removed

    out = removed(table(spark, sf_dir, "documents"), least=16)
    return out.select(F.col("id").alias("doc_id"), "level", "begin", "end", F.col("kept_id").alias("kept_doc_id"), "kept_begin")


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vicinia.llm.cdc import fingerprints

    return fingerprints(table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vicinia.llm.decontamination import matches

    out = matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), least=0.8, radius=23)
    return out.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), "similarity", "begin", "end")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vicinia.llm import quality

    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"), label="quality", sample=4000)
    return quality.score(docs, model, threshold=0.5)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from vicinia.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer=public_tokenizers.path("byte_bpe_50k.json"), capacity=1024, end_id=2)


def op11_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vicinia.llm.superminhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), percent=85, width=3)


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vicinia.llm.collocations import collocations

    return collocations(table(spark, sf_dir, "documents"), least=30, percent=80, most=2000)


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vicinia.llm.resampling import resample

    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), width=1, buckets=10_000, least_words=20, percent=10, seed=2024)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_toxicity, op2_simhash, op3_suffix_dedup, op4_sharding, op5_line_dedup, op6_substring_dedup, op7_fingerprints, op8_decontamination, op9_quality, op10_packing, op11_superminhash, op12_collocations, op13_resampling)}


def oracle_sql() -> dict[str, str]:
    from vicinia.llm import oracles

    return {"op5_line_dedup": oracles.OP5, "op11_superminhash": oracles.OP11, "op12_collocations": oracles.OP12, "op13_resampling": oracles.OP13}
