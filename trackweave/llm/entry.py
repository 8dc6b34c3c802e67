"""Queries of the subpackage for the driver: ``opN_<name>`` and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import cpjoin, decontam, langid, licenses, lm, mixing, packing, quality, rlz, runs, sharding, toxicity, turns
from .common import read, shared_dir

Query = Callable[[SparkSession, str], DataFrame]


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.report(read(spark, sf_dir, "documents"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rlz.report(read(spark, sf_dir, "documents"))


def op4_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.report(read(spark, sf_dir, "documents"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.report(read(spark, sf_dir, "documents"))


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(read(spark, sf_dir, "documents"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cpjoin.report(read(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op9_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/slot-map-{uuid.uuid4().hex}"
    return sharding.shard(read(spark, sf_dir, "documents"), 24, map_path=path)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(read(spark, sf_dir, "documents"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.report(read(spark, sf_dir, "documents"))


def op12_repair_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.report(read(spark, sf_dir, "conversations"))


def op13_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.report(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def queries() -> dict[str, Query]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    from . import oracles

    return oracles.ORACLES
