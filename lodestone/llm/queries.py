"""The registered queries of this folder: thin uses of the operators over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import discriminant, divergence, htmlmain, kneser_ney, licenses, lsa, mixing, negatives, quality, secrets, simhash, tokens, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """Where a public tokenizer's vocabulary file lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmlmain.main_texts(_table(spark, sf_dir, "pages"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(_table(spark, sf_dir, "documents"))


def op3_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.lm_scores(_table(spark, sf_dir, "documents"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lsa.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(_table(spark, sf_dir, "documents"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.licenses(_table(spark, sf_dir, "documents"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets(_table(spark, sf_dir, "documents")).drop("matches")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.write_tokens(_table(spark, sf_dir, "documents"), vocabulary()).documents()


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(_table(spark, sf_dir, "documents"))


def op12_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discriminant.classified(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids, label = F.col("vec_id"), F.col("label")
    return negatives.hard_negatives(_table(spark, sf_dir, "embeddings"), ids % 100 == 0, label=F.when(ids % 7 == 0, (label + 1) % 10).otherwise(label))


def queries() -> dict:
    return {f.__name__: f for f in (op1_main_text, op2_mix_sources, op3_lm_scores, op4_simhash, op5_toxicity, op6_decontaminate, op7_quality_rules, op8_licenses, op9_secrets, op10_token_files, op11_divergence, op12_quality_classifier, op13_hard_negatives)}


def oracle_sql() -> dict[str, str]:
    return {"op11_divergence": divergence.SQL, "op13_hard_negatives": negatives.SQL}
