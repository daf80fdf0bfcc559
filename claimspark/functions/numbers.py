"""Rounding, clamping and numeric lookups."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K


def half_up(x: Column) -> Column:
    """Round to the nearest integer, halves towards plus infinity."""
    return F.floor(x + F.lit(0.5)).cast("bigint")


def half_even(x: Column, scale: int = 0) -> Column:
    """Round halves to the even neighbour."""
    return F.bround(x, scale)


def clamp(x: Column, lo, hi) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), x))


def clamp_parts(parts: Column, hi: int) -> Column:
    """Damaged-part count in ``1..hi``; NULL, NaN and 0 count as one part."""
    n = F.coalesce(F.when(F.isnan(parts.cast("double")), None).otherwise(parts), F.lit(1))
    return clamp(n, 1, hi)


def choose(key: Column, table: dict, default) -> Column:
    """Value of ``key`` in a small constant table, else ``default``."""
    out = None
    for k, v in table.items():
        hit = key == F.lit(k)
        out = F.when(hit, F.lit(v)) if out is None else out.when(hit, F.lit(v))
    return out.otherwise(default)


def severity_score(severity: Column, version: int) -> Column:
    """Numeric severity: version 1 is case sensitive, version 2 lower-cases first."""
    if version == 1:
        return choose(severity, K.SEVERITY_SCORE_V1, F.lit(K.SEVERITY_SCORE_V1_DEFAULT))
    return choose(F.lower(F.coalesce(severity, F.lit("none"))), K.SEVERITY_SCORE_V2, F.lit(0))
