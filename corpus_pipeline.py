"""The corpus pipeline: toxic documents go, one of each group of near duplicates
stays, documents that hold benchmark passages go, sources are mixed, and what is
left is placed on shards.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next stage's docs.  All but the last return the columns
of documents; the last adds slot and shard.

Cases: null and empty texts pass every filter but mixing's draw; a null id is kept, and
hashed as the empty string where a hash decides; repeated rows are near duplicates, of which
one stays; of ties the least id, and then the first row, stays; an empty table gives no rows,
and the last stage's columns; columns beyond those of documents are kept by all stages,
whatever their names, but ``slot`` and ``shard``, which the last stage sets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spanway.llm.common import stored, table
from spanway.llm.minhash import one_of_each
from spanway.llm.mixing import sample
from spanway.llm.sharding import assign
from spanway.llm.toxicity import civil_documents
from spanway.llm.winnowing import clean_documents


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labels of the documents that it is given."""
    return civil_documents(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Flattened less than by default, so that more of the clean documents stay."""
    return sample(docs, power=0.9)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return assign(docs)


STAGES = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

#: Recurrent networks and connected components are beyond SQL; the tests hold each stage against a brute-force one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
