"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanway.llm.common import table
from spanway.llm.hmm import score_texts
from spanway.llm.maxscore import OP6_SQL, search
from spanway.llm.minhash import OP3_SQL, document_components
from spanway.llm.mixing import OP5_SQL, weigh
from spanway.llm.pii import find_personal_data
from spanway.llm.sharding import OP2_SQL, place_documents
from spanway.llm.token_counts import count_tokens
from spanway.llm.token_files import token_digest
from spanway.llm.toxicity import score_documents
from spanway.llm.winnowing import OP8_SQL, decontaminate


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(table(spark, sf_dir, "documents"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return place_documents(table(spark, sf_dir, "documents"))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_components(table(spark, sf_dir, "documents"))


def op4_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weigh(table(spark, sf_dir, "documents"))


def op6_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digest(table(spark, sf_dir, "documents"), vocabulary())


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), vocabulary())


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op2_sharding": op2_sharding,
    "op3_near_duplicates": op3_near_duplicates,
    "op4_language_model": op4_language_model,
    "op5_mixing": op5_mixing,
    "op6_vector_search": op6_vector_search,
    "op7_token_files": op7_token_files,
    "op8_decontamination": op8_decontamination,
    "op9_toxicity": op9_toxicity,
    "op10_token_counts": op10_token_counts,
}

ORACLE: dict[str, str] = {
    "op2_sharding": OP2_SQL,
    "op3_near_duplicates": OP3_SQL,
    "op5_mixing": OP5_SQL,
    "op6_vector_search": OP6_SQL,
    "op8_decontamination": OP8_SQL,
}
