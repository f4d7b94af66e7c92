"""The numbered queries over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from strideflow.llm import alignment, decontaminate, jpeg, language_id, licenses, line_crf, mixing, near_dup, sharding, simhash, spelling, token_files, warc
from strideflow.llm.common import table


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jpeg.media_round_trip(table(spark, sf_dir, "documents"))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.licenses(table(spark, sf_dir, "documents"), licenses.CONTRACT_PHRASES)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_crf.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language(table(spark, sf_dir, "documents"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash(table(spark, sf_dir, "documents"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignment(table(spark, sf_dir, "documents"), *map(public_tokenizers.path, ("byte_bpe_50k.json", "piece_bpe_32k.model")))


QUERIES = {
    "op1_media": op1_media,
    "op2_near_duplicates": op2_near_duplicates,
    "op3_licenses": op3_licenses,
    "op4_mixing": op4_mixing,
    "op5_quality": op5_quality,
    "op6_warc": op6_warc,
    "op7_decontamination": op7_decontamination,
    "op8_language": op8_language,
    "op9_sharding": op9_sharding,
    "op10_token_files": op10_token_files,
    "op11_spelling": op11_spelling,
    "op12_simhash": op12_simhash,
    "op13_alignment": op13_alignment,
}
ORACLES = {"op4_mixing": mixing.ORACLE_SQL, "op6_warc": warc.ORACLE_SQL}
