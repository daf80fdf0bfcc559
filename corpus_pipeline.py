"""A training corpus from raw documents: quality, near duplicates, leaks, secrets, tokens.

Every stage takes all rows its predecessor kept. All but the last return the columns of the
documents: the first three drop rows (rejected texts, all but one document of each group of near
duplicates, documents that hold a test item), the fourth replaces secrets in the texts, and the
last adds token ids and the text that they decode to.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimspark.llm import bpe, decontaminate, near_copies, quality, secrets
from claimspark.session import materialize

#: The learnt stages cannot be written in SQL.
ORACLE_SQL = None


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep(docs, quality.train(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_copies.deduplicate(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def replace_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs).withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    back = bpe.decode(bpe.encode(docs.drop("n_chars")).drop("text"))
    return back.withColumn("n_tokens", F.size("ids").cast("long")).withColumn("text", F.col("decoded").cast("string")).drop("decoded")


STAGES = [
    ("quality classifier", keep_quality),
    ("SimHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_leaks),
    ("secret scans", replace_secrets),
    ("byte-level BPE", tokenize),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs
