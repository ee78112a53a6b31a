"""The operators of this subpackage as queries over the tables of a folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontamination, language, licenses, nearcopies, packing, pii, substrings, topk, toxicity
from .common import pick, table
from .oracle import SQL, TRAP


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.predict(docs, language.fit(docs))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.topk(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.createDataFrame([(-1, 0, "user", TRAP), (-1, 1, "assistant", TRAP)], "conv_id long, turn long, role string, text string")
    rows = pick(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")
    return chat.read_back(chat.format_turns(rows.unionByName(own))).drop("problem")


def op7_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearcopies.groups(table(spark, sf_dir, "documents"), size=4)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(table(spark, sf_dir, "documents"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_toxicity": op2_toxicity,
    "op3_packing": op3_packing,
    "op4_topk": op4_topk,
    "op5_chat_format": op5_chat_format,
    "op6_language_id": op6_language_id,
    "op7_minhash_dedup": op7_minhash_dedup,
    "op8_pii": op8_pii,
    "op9_licenses": op9_licenses,
    "op10_substring_dedup": op10_substring_dedup,
}

#: Where SQL can express the whole result.
ORACLE_SQL: dict[str, str] = SQL
