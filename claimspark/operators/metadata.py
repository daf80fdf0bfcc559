"""Container and tag rules over extracted metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import text as T


def container_scan(df: DataFrame, body: str = "body") -> DataFrame:
    """Editing-software verdict of a container's text.

    Adds ``transferred`` (messenger or air-drop marker), ``keyword`` (editing or download
    tool), ``signal`` (generic editing phrase, ignored for transferred media) and
    ``passed``. The whole text is searched.
    """
    # Each step is bound as an array of one: a filter on the verdict would else lower the text anew for every word.
    found = F.transform(F.array(F.lower(F.col(body))), lambda low: F.struct(
        low.alias("low"), T.any_keyword(low, K.TRANSFER_MARKERS).alias("transferred"), T.first_keyword(low, K.EDITING_KEYWORDS).alias("keyword")))
    found = F.transform(found, lambda f: F.struct(f["transferred"].alias("transferred"), f["keyword"].alias("keyword"), F.when(
        f["keyword"].isNull() & ~f["transferred"], T.first_keyword(f["low"], K.GENERIC_EDIT_SIGNALS)).alias("signal")))
    found = F.transform(found, lambda f: F.struct(f["transferred"].alias("transferred"), f["keyword"].alias("keyword"), f["signal"].alias("signal"),
                                                  (f["keyword"].isNull() & f["signal"].isNull()).alias("passed")))
    return df.withColumn("_found", F.get(found, F.lit(0))).withColumns(
        {c: F.col(f"_found.{c}") for c in ("transferred", "keyword", "signal", "passed")}).drop("_found")


def capture_metadata(df: DataFrame, body: str = "body") -> DataFrame:
    """Adds ``capture_text``, ``capture_ts``, ``gps_lat`` and ``gps_lon`` found in the text."""
    out = df.withColumn("capture_text", T.extract_capture_ts(F.col(body))).withColumn("_gps", T.extract_iso6709(F.col(body)))
    return (out.withColumn("capture_ts", T.parse_capture_ts(F.col("capture_text")))
            .withColumn("gps_lat", F.col("_gps.lat")).withColumn("gps_lon", F.col("_gps.lon")).drop("_gps"))


def tag_rules(df: DataFrame, tags: str = "tags", transferred: str = "transferred") -> DataFrame:
    """Verdict over an extracted tag map: adds ``passed``, ``finding`` and ``evidence``."""
    m = F.col(tags)
    first_tag = lambda names: F.coalesce(*[F.nullif(m[n], F.lit("")) for n in names])
    software = F.nullif(F.trim(first_tag(K.SOFTWARE_TAGS)), F.lit(""))
    values = F.lower(F.array_join(F.map_values(m), " "))
    moved = F.col(transferred)
    out = df.withColumn("_sw", software).withColumn("_values", values)
    out = out.withColumn("_kw", T.first_keyword(F.col("_values"), K.TAG_VALUE_KEYWORDS))
    has_sw = F.col("_sw").isNotNull()
    empty = m.isNull() | (F.size(m) == 0)
    sw_ok = moved | F.contains(F.lower("_sw"), F.lit("whatsapp"))
    finding = (F.when(empty & moved, "transfer_without_tags").when(empty, "tags_absent")
               .when(has_sw & sw_ok, "transfer_software").when(has_sw, "software_tag")
               .when(F.col("_kw").isNotNull(), "editing_keyword").when(moved, "transfer_clean").otherwise("capture_verified"))
    evidence = (F.when(empty, None).when(has_sw, F.col("_sw")).when(F.col("_kw").isNotNull(), F.col("_kw"))
                .when(~moved, F.coalesce(F.trim(first_tag(K.DATETIME_TAGS)), F.lit("Recorded"))))
    return (out.withColumn("finding", finding).withColumn("evidence", evidence)
            .withColumn("passed", ~F.col("finding").isin("software_tag", "editing_keyword")).drop("_sw", "_values", "_kw"))
