"""Registered queries of the training-data operators: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import decontaminate, fill_middle, license_scan, minhash_forest, mixing, ngram_join, passages, quality_classifier, quality_rules, sharding, token_shards, turn_repair, warc
from corpusloom.llm.common import table

SHARDS = [f"shard-{i:02d}" for i in range(64)]


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.scan(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", *decontaminate.digest(F.col("contamination")))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_classifier.fit_on_train(docs, table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", "text").withColumn("score", quality_classifier.score(model, F.col("text")))
    predicted = (F.col("score") >= quality_classifier.THRESHOLD).cast("int")
    return scored.select("doc_id", quality_classifier.held_out(F.col("doc_id")).alias("held_out"), "score", predicted.alias("predicted"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", license_scan.scan(F.col("text")).alias("r"))
    return docs.select("doc_id", *license_scan.digest(F.col("r")))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return sharding.assign(docs, SHARDS, ["doc_id"]).select("doc_id", "slot", "shard")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "shard_1", "shard_2", "position_1", "position_2")


def op8_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.find(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_shards.verified(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.convert(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return turn_repair.report(turn_repair.damage(turns), turns)


def op12_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_forest.join(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", fill_middle.transform(F.col("doc_id"), F.col("text")).alias("r"))
    return docs.select("doc_id", *fill_middle.digest(F.col("r")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}
