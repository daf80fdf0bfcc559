"""Column names and key types that used to end in errors."""

import pytest
from pyspark.sql import functions as F

from claimspark.llm import bpe, decontaminate

SF = "/root/testdata/sf0.001"


def test_bpe_with_every_internal_name(spark):
    docs = spark.createDataFrame([(1, "some text", "a", "b", "c")], "doc_id long, text string, _text_bytes string, __bytes string, decoded string")
    back = bpe.decode(bpe.encode(docs)).first()
    assert bytes(back.decoded) == b"some text" and back._text_bytes == "a" and back["__bytes"] == "b"


@pytest.mark.parametrize("kind", ["smallint", "int", "decimal(12,2)", "string"])
def test_items_of_any_key_type(spark, kind):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    plain = decontaminate.leaks(docs, items)
    typed = decontaminate.leaks(docs, items.withColumn("item_id", F.col("item_id").cast(kind)))
    assert typed.schema["item_id"].dataType.simpleString() == kind
    key = lambda df: sorted((r.doc_id, r.item_id) for r in df.select("doc_id", F.col("item_id").cast("long")).collect())
    assert key(plain) and key(typed) == key(plain)
