"""Stored analyses: what many fields of a record read is evaluated once a row."""

from pyspark.sql import functions as F

from claimspark.sources import accounts


def test_the_report_and_its_stages_are_looked_up_once(spark):
    df = spark.createDataFrame([('{"fiveStageSecurity":{"stages":[{"status":"PASSED"}]}}',)], "raw string")
    out = accounts.parse_stored_analysis(df, "raw", F.lit("2024-06-01 00:00:00").cast("timestamp"))
    assert out.columns == ["raw", "analysis"]
    assert out.select(F.variant_get("analysis", "$.fiveStageSecurity.stage1_exif.status", "string")).first() is not None
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("$.fiveStageSecurity") == 1 and plan.count("$.stages[0]") == 1
