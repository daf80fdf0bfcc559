"""Distances: perceptual-hash bits, histograms, great circle, boxes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K

UNPARSABLE = 999


def hash_bits(hex16: Column) -> Column:
    """64-bit pattern of a 16-digit hex hash as BIGINT; NULL when it does not parse.

    The two 32-bit halves are parsed separately because a 64-bit unsigned value does
    not fit a signed BIGINT cast.
    """
    clean = F.lower(hex16)
    half = lambda start: F.conv(F.substring(clean, start, 8), 16, 10).cast("bigint")
    return F.when(clean.rlike("^[0-9a-f]{16}$"),
                  F.shiftleft(half(1), 32).bitwiseOR(half(9)))


def bits_hex(bits: Column) -> Column:
    return F.lower(F.lpad(F.hex(bits), 16, "0"))


def bit_distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b)).cast("int")


def hamming(hex_a: Column, hex_b: Column) -> Column:
    """Hamming distance of two hex hashes, 999 when either is unreadable."""
    return F.coalesce(bit_distance(hash_bits(hex_a), hash_bits(hex_b)), F.lit(UNPARSABLE))


def hist_intersection(a: Column, b: Column) -> Column:
    """Shared mass of two normalised histograms; 0 when either is missing."""
    shared = F.aggregate(F.zip_with(a, b, lambda x, y: F.least(x, y)), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), F.coalesce(shared, F.lit(0.0))).otherwise(F.lit(0.0))


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    p1, p2 = F.radians(lat1), F.radians(lat2)
    sin2 = lambda d: F.pow(F.sin(F.radians(d) / 2), 2)
    a = sin2(lat2 - lat1) + F.cos(p1) * F.cos(p2) * sin2(lon2 - lon1)
    return F.lit(2 * K.EARTH_RADIUS_M) * F.atan2(F.sqrt(a), F.sqrt(F.lit(1.0) - a))


def box_iou(a, b) -> Column:
    """Intersection over union of two xyxy boxes given as 4 columns each."""
    ax1, ay1, ax2, ay2 = a
    bx1, by1, bx2, by2 = b
    pos = lambda c: F.greatest(F.lit(0.0), c)
    inter = pos(F.least(ax2, bx2) - F.greatest(ax1, bx1)) * pos(F.least(ay2, by2) - F.greatest(ay1, by1))
    area = lambda x1, y1, x2, y2: pos(x2 - x1) * pos(y2 - y1)
    union = area(*a) + area(*b) - inter
    return F.when(union > 0, inter / union).otherwise(F.lit(0.0))
