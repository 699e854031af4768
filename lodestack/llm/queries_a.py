"""Queries of the operators on single documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestack.llm import chat, mixing, ordermin, packing, quality, secrets, toxicity
from lodestack.llm.common import sf_table


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(sf_table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(sf_table(spark, sf_dir, "documents"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(sf_table(spark, sf_dir, "documents"))


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(sf_table(spark, sf_dir, "documents"))


def op6_toxicity_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = sf_table(spark, sf_dir, "documents"), sf_table(spark, sf_dir, "labels")
    return toxicity.score(docs, toxicity.fit(docs, labels), labels)


def op7_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordermin.fingerprints(sf_table(spark, sf_dir, "documents"))


def op9_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.read_back(chat.windows(chat.with_probe(sf_table(spark, sf_dir, "conversations"))))
