"""Frame-signal statistics over pixel, spectrum, track and block tables.

Pixel tables are long: one row per ``claim_id, frame_index, y, x``. All statistics are
map-side combined aggregations; windows are keyed by pixel or block position.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.numbers import clamp
from ..functions.similarity import bit_distance

FRAME = ["claim_id", "frame_index"]


# ---- perceptual hashes -------------------------------------------------------------
def pack_bits(flags: Column) -> Column:
    """64 booleans to one BIGINT, first flag in the highest bit."""
    weighted = F.transform(flags, lambda b: b.cast("bigint"))
    return F.aggregate(weighted, F.lit(0).cast("bigint"), lambda acc, b: F.shiftleft(acc, 1).bitwiseOR(b))


def bits_above(values: Column, level: Column) -> Column:
    """Packed bits of the values above ``level``.

    The level is bound as a field of a one-element array. Used directly inside the inner
    lambda, its expression would be evaluated again for every value.
    """
    bound = F.array(F.struct(values.alias("values"), level.alias("level")))
    return F.get(F.transform(bound, lambda s: pack_bits(F.transform(s["values"], lambda v: v > s["level"]))), F.lit(0))


def average_hash(tile: Column) -> Column:
    """Bits of an 8x8 tile (64 values) above its mean."""
    return bits_above(tile, F.aggregate(tile, F.lit(0.0), lambda s, v: s + v) / F.size(tile))


def median_hash(values: Column) -> Column:
    """Bits of 64 values above their median."""
    middle = lambda o: (F.get(o, F.lit(31)) + F.get(o, F.lit(32))) / 2
    return bits_above(values, F.get(F.transform(F.array(F.array_sort(values)), middle), F.lit(0)))


def difference_hash(tile: Column) -> Column:
    """Bits of an 8-row, 9-column tile (72 values): is a value larger than its left neighbour?"""
    at = lambda i: F.get(tile, i)
    cell = lambda i: (F.floor(i / 8) * 9 + i % 8).cast("int")
    return pack_bits(F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: at(cell(i) + 1) > at(cell(i))))


def _dct(k: int, pos: Column, n: int) -> Column:
    return F.cos((pos * 2 + 1) * F.lit(math.pi * k / (2 * n)))


def dct_coefficients(pixels: DataFrame, keys: list[str], n: int, wanted: list[tuple[int, int]]) -> DataFrame:
    """Unscaled DCT-II coefficients of ``n`` x ``n`` tiles as columns ``c_<row>_<col>``.

    The transform is separable: one weighted sum per row and column frequency, then one
    per coefficient over the row results. Both combine map-side, so no tile is gathered.
    """
    rows, cols = sorted({u for u, _ in wanted}), sorted({v for _, v in wanted})
    across = pixels.groupBy(*keys, "y").agg(
        *[F.sum(F.col("v") * _dct(v, F.col("x"), n)).alias(f"_h{v}") for v in cols], F.sum(F.col("v") * F.col("v")).alias("_e"))
    down = across.select("*", *[_dct(u, F.col("y"), n).alias(f"_r{u}") for u in rows])
    return down.groupBy(*keys).agg(*[F.sum(F.col(f"_h{v}") * F.col(f"_r{u}")).alias(f"c_{u}_{v}") for u, v in wanted],
                                   F.sum("_e").alias("energy"))


def dct_hash(pixels: DataFrame, n: int = 8) -> DataFrame:
    """Perceptual hash per frame: the 8x8 lowest frequencies above their median."""
    wanted = [(u, v) for u in range(8) for v in range(8)]
    coef = dct_coefficients(pixels, FRAME, n, wanted)
    values = coef.select(*FRAME, F.array(*[F.col(f"c_{u}_{v}") for u, v in wanted]).alias("_vals"))
    return values.select(*FRAME, median_hash(F.col("_vals")).alias("bits"))


# ---- colour -----------------------------------------------------------------------
def color_signature(pixels: DataFrame) -> DataFrame:
    """96-bin histogram of H (0..179), S and V (0..255) over all frames of a claim, sum 1."""
    bin_of = lambda c, span, base: (F.floor(F.col(c) * 32 / span) + base).cast("int")
    bins = F.array(bin_of("h", 180, 0), bin_of("s", 256, 32), bin_of("b", 256, 64))
    counts = (pixels.select("claim_id", F.explode(bins).alias("bin"))
              .groupBy("claim_id", "bin").agg(F.count(F.lit(1)).alias("k")))
    dense = counts.groupBy("claim_id").agg(
        F.map_from_entries(F.collect_list(F.struct("bin", "k"))).alias("m"), F.sum("k").alias("total"))
    share = lambda i: F.coalesce(F.col("m")[i], F.lit(0)) / F.col("total")
    return dense.select("claim_id", F.transform(F.sequence(F.lit(0), F.lit(95)), share).alias("color_sig"))


def color_cast(pixels: DataFrame) -> DataFrame:
    """Distance of the mean (a, b) from neutral, empty hue bins and mean saturation per frame."""
    by_hue = pixels.groupBy(*FRAME, "h").agg(F.count(F.lit(1)).alias("k"), *[F.sum(c).alias(c) for c in ("a", "bb", "s")])
    mean = lambda c: F.sum(c) / F.sum("k")
    out = by_hue.groupBy(*FRAME).agg(mean("a").alias("_a"), mean("bb").alias("_b"), mean("s").alias("saturation"),
                                     (F.lit(180) - F.count(F.lit(1))).alias("empty_hues"))
    cast = F.sqrt(F.pow(F.col("_a") - 128, 2) + F.pow(F.col("_b") - 128, 2))
    return (out.withColumn("cast", cast).drop("_a", "_b")
            .withColumn("color_rejected", (F.col("empty_hues") >= 150) & ((F.col("cast") >= 60) | (F.col("saturation") >= 230))))


# ---- motion and replay ----------------------------------------------------------------
def static_feed(pixels: DataFrame, threshold: float = K.STATIC_FEED_THRESHOLD) -> DataFrame:
    """Mean absolute difference of consecutive frames; a frozen feed or single frame fails."""
    w = Window.partitionBy("claim_id", "y", "x").orderBy("frame_index")
    diffs = pixels.withColumn("_d", F.abs(F.col("v") - F.lag("v").over(w)))
    per_pair = diffs.groupBy(*FRAME).agg(F.avg("_d").alias("pair_diff"))
    return (per_pair.groupBy("claim_id").agg(F.avg("pair_diff").alias("mean_diff"))
            .withColumn("passed", F.coalesce(F.col("mean_diff") >= threshold, F.lit(False))))


def spectral_peak_ratio(spectrum: DataFrame) -> DataFrame:
    """Peak over mean magnitude outside the central 8% box of a shifted spectrum.

    Reads ``claim_id, frame_index, y, x, magnitude, height, width``.
    """
    half = lambda side: F.greatest(F.lit(4), F.floor(F.col(side) * 0.08))
    inside = lambda p, side: (F.col(p) >= F.floor(F.col(side) / 2) - half(side)) & (F.col(p) < F.floor(F.col(side) / 2) + half(side))
    outer = F.when(~(inside("y", "height") & inside("x", "width")), F.col("magnitude"))
    out = spectrum.groupBy(*FRAME).agg(F.max(outer).alias("_p"), F.avg(outer).alias("_m"))
    ratio = F.coalesce(F.col("_p") / (F.col("_m") + 1e-6), F.lit(0.0))
    return (out.select(*FRAME, ratio.alias("peak_ratio"))
            .withColumn("moire", clamp((F.col("peak_ratio") - K.PEAK_RATIO_FLOOR) / K.PEAK_RATIO_SPAN, 0.0, 1.0))
            .withColumn("status", F.when(F.col("moire") >= K.PEAK_WARNING, "WARNING").otherwise("PASSED")))


def planar_ratio(tracks: DataFrame) -> DataFrame:
    """Mean inlier share of frame pairs with at least ten tracked points.

    Reads ``claim_id, pair, detected_points`` per pair row or one row per point with
    ``tracked`` and ``inlier`` flags.
    """
    pairs = tracks.groupBy("claim_id", "pair").agg(
        F.count(F.lit(1)).alias("points"), F.count_if("tracked").alias("good"),
        F.count_if(F.col("tracked") & F.col("inlier")).alias("inliers"))
    usable = (F.col("points") >= K.PLANAR_MIN_TRACKED) & (F.col("good") >= K.PLANAR_MIN_TRACKED)
    return (pairs.groupBy("claim_id").agg(F.avg(F.when(usable, F.col("inliers") / F.col("good"))).alias("planar"))
            .withColumn("planar", F.coalesce("planar", F.lit(0.0)))
            .withColumn("status", F.when(F.col("planar") >= K.PLANAR_WARNING, "WARNING").otherwise("PASSED")))


def screen_replay(moire: DataFrame, planar: DataFrame) -> DataFrame:
    """Replay score per claim: half mean moire, half planar share, with single-signal limits."""
    mean = moire.groupBy("claim_id").agg(F.avg("moire").alias("moire"))
    out = mean.join(planar.select("claim_id", "planar"), "claim_id", "left").withColumn("planar", F.coalesce("planar", F.lit(0.0)))
    score = 0.5 * F.col("moire") + 0.5 * F.col("planar")
    return (out.withColumn("screen_score", score)
            .withColumn("detected", (F.col("screen_score") >= K.REPLAY_SCORE) | (F.col("moire") >= K.REPLAY_PEAK)
                        | (F.col("planar") >= K.REPLAY_PLANAR)))


# ---- tampering ------------------------------------------------------------------------
def noise_blocks(residual: DataFrame, block: int = 16, grid: int = 4) -> DataFrame:
    """Noise inconsistency, peak block noise and patch variance ratio per frame.

    Reads ``claim_id, frame_index, y, x, v, height, width`` with ``v`` the noise residual.
    """
    cells = lambda side, size: F.greatest(F.lit(1), F.floor(F.col(side) / size))
    by, bx = F.floor(F.col("y") / block), F.floor(F.col("x") / block)
    blocks = (residual.where((by < cells("height", block)) & (bx < cells("width", block)))
              .groupBy(*FRAME, by.alias("by"), bx.alias("bx")).agg(F.stddev_pop("v").alias("sd"))
              .groupBy(*FRAME).agg(F.stddev_pop("sd").alias("inconsistency"), F.max("sd").alias("peak_noise")))
    py, px = F.floor(F.col("y") / cells("height", grid)), F.floor(F.col("x") / cells("width", grid))
    patches = (residual.where((py < grid) & (px < grid)).groupBy(*FRAME, py.alias("py"), px.alias("px"))
               .agg(F.var_pop("v").alias("pv")).groupBy(*FRAME)
               .agg(F.max("pv").alias("max_patch_var"), F.min("pv").alias("_min")))
    return (blocks.join(patches, FRAME)
            .withColumn("noise_ratio", F.col("max_patch_var") / (F.col("_min") + 1e-4)).drop("_min"))


def recompression_error(pixels: DataFrame) -> DataFrame:
    """Scaled mean error against a recompressed frame, and the spread between two qualities.

    Reads integer pixel values ``v, v90, v75``. Differences take at most 256 values, so
    the peak scaling works on a per-frame histogram after one aggregation.
    """
    d90, d75 = F.abs(F.col("v") - F.col("v90")), F.abs(F.col("v") - F.col("v75"))
    x = d90 - d75
    hist = pixels.groupBy(*FRAME, d90.cast("int").alias("d")).agg(
        F.count(F.lit(1)).alias("k"), F.sum(x).alias("sx"), F.sum(x * x).alias("sxx"))
    peak = F.greatest(F.lit(1), F.max("d").over(Window.partitionBy(*FRAME)))
    scaled = F.least(F.lit(255), F.floor(F.col("d") * 255 / F.col("_peak")))
    n = F.sum("k")
    spread = F.sqrt(F.greatest(F.lit(0.0), F.sum("sxx") / n - F.pow(F.sum("sx") / n, 2)))
    return (hist.withColumn("_peak", peak).groupBy(*FRAME)
            .agg((F.sum(scaled * F.col("k")) / n).alias("mean_error"), spread.alias("quality_spread")))


def integrity_score(noise: Column, error: Column, spread: Column) -> Column:
    return clamp(F.lit(100.0) - (noise * 2.2 + error * 0.4 + spread * 1.2), 0.0, 100.0)


def tamper_verdict(df: DataFrame) -> DataFrame:
    """Ordered tamper rules over frame metrics; transferred media has relaxed limits.

    Reads ``color_rejected, noise_ratio, max_patch_var, peak_noise, inconsistency,
    mean_error, quality_spread, transferred``; adds ``integrity, rule, passed``.
    """
    moved, c = F.col("transferred"), F.col
    out = df.withColumn("integrity", integrity_score(c("inconsistency"), c("mean_error"), c("quality_spread")))
    limit = lambda relaxed, usual: F.when(moved, relaxed).otherwise(usual)
    rule = (F.when(c("color_rejected"), "color_filter")
            .when((c("noise_ratio") > limit(75.0, 45.0)) & (c("max_patch_var") > 18.0), "noise_ratio")
            .when(~moved & ((c("peak_noise") > 55.0) | ((c("peak_noise") > 38.0) & (c("integrity") < 60.0))), "peak_noise")
            .when(~moved & (c("inconsistency") > 15.0), "inconsistency")
            .when(c("mean_error") > limit(65.0, 40.0), "recompression")
            .when(~moved & (c("integrity") < 55.0), "integrity"))
    return out.withColumn("rule", rule).withColumn("passed", F.col("rule").isNull())


def copy_move(blocks: DataFrame) -> DataFrame:
    """First copied block pair per claim: textured inner blocks, at least two apart, whose
    hashes differ in at most two bits.

    Words within two bits agree on at least one of three bands, so candidates come from an
    equi-join on (frame, band, key). Reads ``claim_id, frame_index, r, c, std, bits``.
    """
    inner = blocks.where(F.col("r").between(1, 6) & F.col("c").between(1, 6) & (F.col("std") >= K.BLOCK_MIN_STD))
    part = lambda i: F.shiftrightunsigned("bits", 22 * i).bitwiseAND(F.lit((1 << 22) - 1))
    keyed = inner.select(*FRAME, (F.col("r") * 8 + F.col("c")).alias("cell"), "r", "c", "bits",
                         F.posexplode(F.array(*[part(i) for i in range(3)])).alias("band", "key"))
    a, b = keyed.alias("a"), keyed.alias("b")
    same = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in (*FRAME, "band", "key")]
    apart = F.greatest(F.abs(F.col("a.r") - F.col("b.r")), F.abs(F.col("a.c") - F.col("b.c"))) >= K.BLOCK_MIN_GAP
    dist = bit_distance(F.col("a.bits"), F.col("b.bits"))
    hits = a.join(b, [*same, F.col("a.cell") < F.col("b.cell")]).where(apart & (dist <= K.BLOCK_COPY_RADIUS))
    first = F.min(F.struct(F.col("a.frame_index").alias("frame_index"), F.col("a.cell").alias("block_a"),
                           F.col("b.cell").alias("block_b"), dist.alias("distance")))
    return hits.groupBy("a.claim_id").agg(first.alias("m")).select("claim_id", "m.*")


def temporal_splice(blocks: DataFrame) -> DataFrame:
    """First block per claim that changes while its eight neighbours stay still."""
    w = Window.partitionBy("claim_id", "r", "c").orderBy("frame_index")
    moved = (blocks.withColumn("_prev", F.lag("bits").over(w)).where(F.col("_prev").isNotNull())
             .withColumn("_d", bit_distance(F.col("bits"), F.col("_prev"))))
    steps = [(dr, dc) for dr in (-1, 0, 1) for dc in (-1, 0, 1)]
    targets = F.array(*[F.struct((F.col("r") + dr).alias("tr"), (F.col("c") + dc).alias("tc"),
                                 F.lit(dr == 0 and dc == 0).alias("own")) for dr, dc in steps])
    votes = (moved.select(*FRAME, "_d", F.inline(targets))
             .where(F.col("tr").between(1, 6) & F.col("tc").between(1, 6))
             .groupBy(*FRAME, "tr", "tc").agg(F.max(F.when(F.col("own"), F.col("_d"))).alias("target_distance"),
                                              F.avg(F.when(~F.col("own"), F.col("_d"))).alias("neighbour_mean")))
    hits = votes.where((F.col("target_distance") >= K.SPLICE_TARGET) & (F.col("neighbour_mean") <= K.SPLICE_NEIGHBOURS))
    return (hits.groupBy("claim_id").agg(F.min(F.struct("frame_index", "tr", "tc", "target_distance", "neighbour_mean")).alias("m"))
            .select("claim_id", "m.*"))


# ---- faces ---------------------------------------------------------------------------
def face_boxes(faces: DataFrame) -> DataFrame:
    """Plausible face boxes: size, aspect and skin share. Reads ``w, h, frame_width, frame_height, skin_pct``."""
    side = lambda s, f: F.col(s).between(40, F.floor(F.col(f) * 0.90))
    aspect = F.col("w") / F.greatest(F.lit(1), F.col("h"))
    return faces.where(side("w", "frame_width") & side("h", "frame_height") & aspect.between(0.5, 1.6) & (F.col("skin_pct") >= 15.0))


def skin_texture_variance(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """Variance of the Laplacian over skin pixels when there are at least 40, else over all."""
    skin = F.col("skin")
    out = pixels.groupBy(*keys).agg(F.count_if(skin).alias("_k"), F.var_pop(F.when(skin, F.col("laplacian"))).alias("_s"),
                                    F.var_pop("laplacian").alias("_a"))
    return out.select(*keys, F.when(F.col("_k") >= 40, F.col("_s")).otherwise(F.col("_a")).alias("variance"))


def band_energy_ratio(spectrum: DataFrame, keys: list[str]) -> DataFrame:
    """Energy share of frequencies beyond 0.45 of the normalised radius. Reads ``u, v, magnitude, height, width``."""
    e = F.col("magnitude") * F.col("magnitude")
    far = F.sqrt(F.pow(F.col("v") / F.greatest(F.lit(1), F.col("width")), 2)
                 + F.pow(F.col("u") / F.greatest(F.lit(1), F.col("height")), 2)) > 0.45
    return spectrum.groupBy(*keys).agg((F.sum(F.when(far, e).otherwise(0.0)) / (F.sum(e) + 1e-9)).alias("band_ratio"))


def local_frequency_stats(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """Spread over 8x8 blocks of the energy share at frequencies with row + column >= 6.

    An orthonormal DCT preserves energy, so only the 21 lower coefficients are computed
    and the upper share is the rest. Reads ``y, x, v`` and the keys.
    """
    low = [(u, v) for u in range(8) for v in range(8) if u + v < 6]
    blocks = pixels.select(*keys, F.floor(F.col("y") / 8).alias("by"), F.floor(F.col("x") / 8).alias("bx"),
                           (F.col("y") % 8).alias("y"), (F.col("x") % 8).alias("x"), "v")
    coef = dct_coefficients(blocks, [*keys, "by", "bx"], 8, low)
    scale = lambda u, v: (1 / 8 if u == 0 else 1 / 4) * (1 / 8 if v == 0 else 1 / 4)
    low_energy = sum((F.col(f"c_{u}_{v}") * F.col(f"c_{u}_{v}") * scale(u, v) for u, v in low), F.lit(0.0))
    share = (F.col("energy") - low_energy) / (F.col("energy") + 1e-9)
    return coef.groupBy(*keys).agg(F.stddev_pop(share).alias("local_spread"), F.count(F.lit(1)).alias("blocks"))


def liveness_verdict(faces: DataFrame) -> DataFrame:
    """Liveness per claim from ``variance, band_ratio, local_spread`` of its face crops.

    Crops with variance >= 900 are ignored. No crop at all passes; only ignored ones fail.
    """
    used = F.col("variance") < K.LIVENESS_IGNORED
    on = lambda c: F.when(used, F.col(c))
    out = faces.groupBy("claim_id").agg(
        F.count("variance").alias("faces"), F.count_if(used).alias("usable"), F.min(on("variance")).alias("min_variance"),
        F.min(on("band_ratio")).alias("min_band"), F.max(on("local_spread")).alias("max_local"))
    soft = F.col("min_variance") < K.LIVENESS_LOW_VARIANCE
    rule = (F.when(F.col("faces") == 0, "no_face").when(F.col("usable") == 0, "face_required")
            .when(F.col("min_variance") < K.LIVENESS_VARIANCE, "smooth_skin")
            .when((F.col("min_band") < K.LIVENESS_MIN_BAND) & soft, "band_suppressed")
            .when((F.col("max_local") > K.LIVENESS_MAX_LOCAL) & soft, "local_discrepancy").otherwise("live"))
    return (out.withColumn("rule", rule).withColumn("passed", F.col("rule").isin("no_face", "live"))
            .select("claim_id", "faces", "usable", "min_variance", "rule", "passed"))
