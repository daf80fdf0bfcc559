"""Numbering, neighbour access and top-k that stay safe when one key holds most rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

BUCKET_WIDTH = 4096


def split_hot(df: DataFrame, keys: list[str], limit: int) -> tuple[DataFrame, DataFrame | None]:
    """(rows of keys with at most ``limit`` rows, rows of the larger keys or None).

    The check reads only the key columns and combines counts map-side. Without a large
    key the input is returned untouched; otherwise the list of large keys has at most
    ``rows / limit`` entries and AQE decides whether it is broadcast.
    """
    large = df.groupBy(*keys).count().where(F.col("count") > limit).select(*keys)
    if large.isEmpty():
        return df, None
    large = materialize(large)
    return df.join(large, keys, "left_anti"), df.join(large, keys, "left_semi")


def with_positions(df: DataFrame, keys: list[str], order: str, width: int = BUCKET_WIDTH) -> DataFrame:
    """Add ``pos`` (0-based rank by ``order`` within the key) and ``n`` (rows of the key).

    ``order`` is an integer that is unique within the key, so a window over
    ``(key, order div width)`` never sees more than ``width`` rows. Only keys spanning
    several buckets need the offset join, and their offsets come from bucket counts.
    """
    rows = df.withColumn("_b", F.floor(F.col(order) / F.lit(width)))
    cell = Window.partitionBy(*keys, "_b")
    local = (rows.withColumn("_rn", F.row_number().over(cell.orderBy(order)))
             .withColumn("_cb", F.count(F.lit(1)).over(cell)))
    whole = Window.partitionBy(*keys)
    offsets = (rows.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_c"))
               .withColumn("_nb", F.count(F.lit(1)).over(whole))
               .withColumn("_n", F.sum("_c").over(whole))
               .withColumn("_off", F.sum("_c").over(
                   whole.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)))
               .where(F.col("_nb") > 1)
               .select(*keys, "_b", F.coalesce("_off", F.lit(0)).alias("_off"), "_n"))
    return (local.join(offsets, [*keys, "_b"], "left")
            .withColumn("pos", (F.col("_rn") - 1 + F.coalesce("_off", F.lit(0))).cast("int"))
            .withColumn("n", F.coalesce("_n", "_cb").cast("int"))
            .drop("_b", "_rn", "_cb", "_off", "_n"))


def with_previous(df: DataFrame, keys: list[str], pos: str, cols: dict[str, str],
                  width: int = BUCKET_WIDTH) -> DataFrame:
    """Add the values of the row at ``pos - 1``; ``pos`` is dense within the key.

    Each row goes to its own bucket of ``width`` positions, and the last row of a bucket
    also to the next one, so ``lag`` works inside bounded windows after one shuffle.
    """
    p = F.col(pos)
    own = F.floor(p / F.lit(width))
    edge = (p % F.lit(width)) == width - 1
    spread = df.withColumn("_cell", F.explode(F.when(edge, F.array(own, own + 1)).otherwise(F.array(own))))
    w = Window.partitionBy(*keys, "_cell").orderBy(pos)
    for source, target in cols.items():
        spread = spread.withColumn(target, F.lag(source).over(w))
    return spread.where(F.col("_cell") == own).drop("_cell")


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "_rank") -> DataFrame:
    """First ``k`` rows of every key. Spark limits each map task to ``k`` rows per key
    before the shuffle, so a hot key sends ``k`` rows per task and not all of its rows."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def two_smallest(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """One row per key with its two smallest distinct values ``c1 < c2`` (``c2`` may be NULL)."""
    few = top_per_key(df.select(*keys, value).distinct(), keys, [F.col(value)], 2)
    both = few.groupBy(*keys).agg(F.min(value).alias("c1"), F.max(value).alias("c2"))
    return both.withColumn("c2", F.when(F.col("c2") != F.col("c1"), F.col("c2")))
