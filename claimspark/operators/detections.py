"""Damage detections: filtering, de-duplication, severity joins, summaries.

A detection row has ``claim_id, det_seq, label, confidence, x1, y1, x2, y2,
frame_index, frame_width, frame_height``; ``det_seq`` is the arrival order within the
claim and breaks confidence ties.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.similarity import box_iou
from ..functions.text import allowed_classes, normalize_bool, normalize_severity, with_label_norm
from ..session import materialize
from .skew import split_hot, top_per_key

BOX = ("x1", "y1", "x2", "y2")


def valid_payload(detections: Column) -> Column:
    """True when the list is present and every entry has a four-element ``bbox``."""
    ok = F.forall(detections, lambda d: F.coalesce(F.size(d["bbox"]) == 4, F.lit(False)))
    return F.coalesce(ok, F.lit(False))


def filter_detections(det: DataFrame, context: DataFrame | None = None,
                      min_confidence: float = K.MIN_CONFIDENCE) -> DataFrame:
    """Confident detections of the classes the claimant reported (all when unspecified)."""
    out = with_label_norm(det.where(F.col("confidence") >= min_confidence))
    if context is None:
        return out
    wanted = context.select("claim_id", allowed_classes(F.col("reported_damage_type")).alias("_allowed"))
    return (out.join(wanted, "claim_id", "left")
            .where(F.col("_allowed").isNull() | F.array_contains("_allowed", F.col("label_norm")))
            .drop("_allowed"))


def rescale_boxes(det: DataFrame, detector_width: Column, detector_height: Column) -> DataFrame:
    """Detector coordinates to source pixels, plus the same box as fractions of the frame."""
    sx = F.col("frame_width") / detector_width
    sy = F.col("frame_height") / detector_height
    out = det
    for c, s, side in (("x1", sx, "frame_width"), ("y1", sy, "frame_height"),
                       ("x2", sx, "frame_width"), ("y2", sy, "frame_height")):
        out = (out.withColumn(c, F.col(c) * s)
               .withColumn(f"{c}_rel", F.col(c) / F.greatest(F.lit(1), F.col(side))))
    return out


def sample_interval(fps: Column, target_fps: int = 5) -> Column:
    usable = F.when((fps > 0) & (fps <= 240), fps).otherwise(F.lit(30.0))
    return F.greatest(F.lit(1), F.floor(usable / target_fps)).cast("int")


def sample_every(frames: DataFrame, fps: Column) -> DataFrame:
    """Frames whose 1-based index is a multiple of the sampling interval."""
    return frames.where(F.pmod(F.col("frame_index"), sample_interval(fps)) == 0)


def even_positions(total: Column, n: int) -> Column:
    """``n`` evenly spaced frame indices from first to last (half-even, distinct)."""
    if n <= 1:
        return F.array(F.lit(0).cast("bigint"))
    step = (total - 1) / F.lit(float(n - 1))
    spaced = F.array_distinct(F.transform(
        F.sequence(F.lit(0), F.lit(n - 1)),
        lambda i: F.bround(i * (total - 1) / F.lit(float(n - 1)), 0).cast("bigint")))
    return F.when(total <= 0, F.array().cast("array<bigint>")).when(
        total == 1, F.array(F.lit(0).cast("bigint"))).otherwise(spaced)


def _same_area(a: Column, b: Column) -> Column:
    """Do two observations with the same label show the same damage area? Unlabelled ones never do."""
    iou = box_iou([a[c] for c in BOX], [b[c] for c in BOX])
    dx, dy = a["_cx"] - b["_cx"], a["_cy"] - b["_cy"]
    moved = (iou >= K.OTHER_FRAME_IOU) | (F.sqrt(dx * dx + dy * dy) <= K.CENTRE_DISTANCE)
    return a["_known"] & F.when(a["frame_index"] == b["frame_index"], iou >= K.SAME_FRAME_IOU).otherwise(moved)


def _close_boxes(px: float):
    return lambda a, b: (F.abs(a["x1"] - b["x1"]) < px) & (F.abs(a["y1"] - b["y1"]) < px)


def greedy_keep(rows: DataFrame, keys: list[str], order: list[Column], conflict,
                max_items: int | None, fold_limit: int | None = 2048) -> DataFrame:
    """Walk each key's rows in order and keep a row unless a kept one conflicts with it.

    Keys with at most ``fold_limit`` rows are folded in one array. Larger keys never
    meet in one task: every round takes the first remaining row of each key (a map-side
    combined minimum), keeps it and removes it with everything it conflicts with. The
    first remaining row is always kept by the greedy walk, so both ways agree.
    ``max_items=None`` keeps all survivors; ``fold_limit=None`` says that no key is large.
    """
    fields = [c for c in rows.columns if c not in keys]
    ordered = rows.withColumn("_ord", F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)]))
    item = F.struct("_ord", *fields)
    small, large = (ordered, None) if fold_limit is None else split_hot(ordered, keys, fold_limit)

    packed = small.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("items"))
    kind = packed.schema["items"].dataType

    def step(kept: Column, cand: Column) -> Column:
        clash = F.exists(kept, lambda k: conflict(k, cand))
        full = F.lit(False) if max_items is None else F.size(kept) >= max_items
        return F.when(full | clash, kept).otherwise(F.array_append(kept, cand))

    kept = packed.select(*keys, F.posexplode(F.aggregate("items", F.array().cast(kind), step)).alias("keep_idx", "d"))
    out = kept.select(*keys, "keep_idx", *[F.col(f"d.{c}").alias(c) for c in fields])
    if large is None:
        return out
    rest = large.select(*keys, item.alias("d"))
    rest, rounds = materialize(rest), 0
    while (max_items is None or rounds < max_items) and not rest.isEmpty():
        first = materialize(rest.groupBy(*keys).agg(F.min("d").alias("top")))
        out = out.unionByName(first.select(*keys, F.lit(rounds).alias("keep_idx"),
                                           *[F.col(f"top.{c}").alias(c) for c in fields]))
        rest = materialize(rest.join(first, keys)
                           .where((F.col("d._ord") != F.col("top._ord")) & ~conflict(F.col("top"), F.col("d")))
                           .select(*keys, "d"))
        rounds += 1
    return out


def dedupe_detections(det: DataFrame, max_items: int = K.MAX_DETECTIONS, fold_limit: int = 2048) -> DataFrame:
    """Distinct damage areas per claim, best confidence first, at most ``max_items``.

    Only equal labels conflict, so each (claim, label) is folded by itself and the first
    ``max_items`` of a claim are taken from what remains. ``keep_idx`` is the position of a
    detection in the retained list.
    """
    cols = ["claim_id", "det_seq", "label", "confidence", *BOX, "frame_index", "frame_width", "frame_height"]
    cols += [c for c in det.columns if c not in cols and c != "label_norm"]
    order = [-F.col("confidence"), F.col("det_seq")]
    share = lambda lo, hi, side: (F.col(lo) + F.col(hi)) / 2 / F.greatest(F.lit(1), F.col(side))
    rows = (with_label_norm(det.select(*cols)).withColumn("_cx", share("x1", "x2", "frame_width"))
            .withColumn("_cy", share("y1", "y2", "frame_height")).withColumn("_known", F.col("label_norm").isNotNull()))
    kept = greedy_keep(rows, ["claim_id", "label_norm"], order, _same_area, max_items, fold_limit).drop("keep_idx", "_cx", "_cy", "_known")
    first = top_per_key(kept, ["claim_id"], order, max_items, "_place")
    return first.withColumn("keep_idx", (F.col("_place") - 1).cast("int")).drop("_place")


def suppress_close_boxes(boxes: DataFrame, key: str, order: str, px: float, fold_limit: int = 2048) -> DataFrame:
    """Keep a box unless an earlier kept one starts within ``px`` pixels in x and in y.

    Boxes of one grid cell of that width exclude each other. In a large key every round
    takes the first open box of each cell, keeps those without an earlier open box nearby
    and removes what these exclude. The number of rounds follows the longest chain of
    neighbours, and no cell is ever paired with itself. ``order`` is unique within the key.
    """
    small, large = split_hot(boxes, [key], fold_limit)
    out = greedy_keep(small, [key], [F.col(order)], _close_boxes(px), None, None)
    if large is None:
        return out
    fields = [c for c in boxes.columns if c != key]
    cell = lambda c: F.floor(F.col(c) / px).cast("bigint")
    open_ = materialize(large.select(key, F.struct(order, *[c for c in fields if c != order]).alias("d"), cell("x1").alias("cx"), cell("y1").alias("cy")))
    kept, near = None, F.explode(F.sequence(F.lit(-1), F.lit(1)))
    while not open_.isEmpty():
        first = open_.groupBy(key, "cx", "cy").agg(F.min("d").alias("top"))
        spread = first.select(key, "top", (F.col("cx")).alias("cx"), (F.col("cy")).alias("cy"), near.alias("dx")).select(
            key, "top", (F.col("cx") + F.col("dx")).alias("cx"), "cy", near.alias("dy")).select(key, "top", "cx", (F.col("cy") + F.col("dy")).alias("cy"))
        spread = materialize(spread)
        met = spread.join(open_, [key, "cx", "cy"]).where(_close_boxes(px)(F.col("top"), F.col("d")))
        blocked = met.where(F.col(f"d.{order}") < F.col(f"top.{order}")).select(key, F.col(f"top.{order}").alias("_o")).distinct()
        tops = first.withColumn("_o", F.col(f"top.{order}"))
        won = materialize(tops.join(blocked, [key, "_o"], "left_anti").select(key, "top", "_o"))
        kept = won if kept is None else kept.unionByName(won)
        gone = (spread.withColumn("_o", F.col(f"top.{order}")).join(won.select(key, "_o"), [key, "_o"], "left_semi").join(open_, [key, "cx", "cy"])
                .where(_close_boxes(px)(F.col("top"), F.col("d"))).select(key, F.col(f"d.{order}").alias("_g")).distinct())
        open_ = materialize(open_.withColumn("_g", F.col(f"d.{order}")).join(gone, [key, "_g"], "left_anti").drop("_g"))
    place = F.row_number().over(Window.partitionBy(key).orderBy("_o")) - 1
    rest = kept.select(key, place.alias("keep_idx"), *[F.col(f"top.{c}").alias(c) for c in fields])
    return out.unionByName(rest)


def best_frame(det: DataFrame, frames: DataFrame | None = None) -> DataFrame:
    """Frame with the largest confidence sum per claim; the earliest frame wins ties.

    With ``frames`` (sampled frames), claims without detections fall back to their first one.
    """
    sums = (det.groupBy("claim_id", "frame_index").agg(F.round(F.sum("confidence"), 9).alias("s")))
    best = sums.groupBy("claim_id").agg(
        F.min(F.struct((-F.col("s")).alias("s"), F.col("frame_index"))).alias("m")
    ).select("claim_id", F.col("m.frame_index").alias("best_frame"), (-F.col("m.s")).alias("confidence_sum"))
    if frames is None:
        return best
    first = frames.groupBy("claim_id").agg(F.min("frame_index").alias("first_frame"))
    return first.join(best, "claim_id", "left").select(
        "claim_id", F.coalesce("best_frame", "first_frame").alias("best_frame"),
        F.coalesce("confidence_sum", F.lit(0.0)).alias("confidence_sum"))


def detection_id(label: Column, idx: Column) -> Column:
    return F.concat_ws("-", label, idx.cast("string"))


def attach_severity(kept: DataFrame, results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(detections with their severity, detections without a usable result).

    Of several results for one id the last (largest ``result_seq``) wins. A missing or
    invalid severity is never defaulted: those rows go to the second frame.
    """
    last = (results.groupBy("claim_id", "detection_id")
            .agg(F.max_by(F.struct("severity", "note"), "result_seq").alias("r")))
    joined = (kept.withColumn("detection_id", detection_id(F.col("label"), F.col("keep_idx")))
              .join(last, ["claim_id", "detection_id"], "left")
              .withColumn("severity", normalize_severity(F.col("r.severity")))
              .withColumn("severity_note", F.col("r.note")).drop("r"))
    return joined.where(F.col("severity").isNotNull()), joined.where(F.col("severity").isNull())


def ids_complete(requested: DataFrame, returned: DataFrame) -> DataFrame:
    """Per request: are the returned ids exactly the requested ones, each once?"""
    want = requested.select("claim_id", "detection_id").distinct().withColumn("wanted", F.lit(1))
    got = returned.groupBy("claim_id", "detection_id").agg(F.count(F.lit(1)).alias("times"))
    return (want.join(got, ["claim_id", "detection_id"], "full")
            .groupBy("claim_id").agg(
                F.count_if(F.col("times").isNull()).alias("missing"),
                F.count_if(F.col("wanted").isNull()).alias("unexpected"),
                F.count_if(F.col("times") > 1).alias("duplicated"))
            .withColumn("complete", (F.col("missing") == 0) & (F.col("unexpected") == 0) & (F.col("duplicated") == 0)))


def first_by_label(kept: DataFrame, items: DataFrame, idx: str, values: list[str]) -> DataFrame:
    """Attach to each detection the first item (by ``idx``) carrying the same label."""
    first = (items.groupBy("claim_id", "label")
             .agg(F.min_by(F.struct(*values), idx).alias("_first")))
    return (kept.join(first, ["claim_id", "label"], "left")
            .select(*kept.columns, *[F.col(f"_first.{v}").alias(v) for v in values]))


def detection_summary(kept: DataFrame, claims: DataFrame | None = None) -> DataFrame:
    """Summary line, severity counts and peak confidence of the retained detections.

    The first ``MAX_DETECTIONS`` of a claim count, as de-duplication leaves no more. With
    ``claims`` (``claim_id``) a claim without detections gets a row that says so.
    """
    kept = top_per_key(kept, ["claim_id"], [F.col("keep_idx")], K.MAX_DETECTIONS, "_place")
    pct = F.floor(F.col("confidence") * 100).cast("bigint")
    line = F.concat(F.col("label"), F.lit(" ("), pct.cast("string"), F.lit("%)"))
    sev = F.lower(F.col("severity"))
    counts = [F.count_if(sev == s).alias(f"n_{s}") for s in K.SEVERITIES]
    out = (kept.groupBy("claim_id").agg(
        F.array_sort(F.collect_list(F.struct("keep_idx", line.alias("line")))).alias("lines"),
        F.max(pct).alias("peak_pct"), F.count(F.lit(1)).alias("areas"), *counts)
        .withColumn("summary", F.concat(F.lit("Detected: "), F.array_join(F.col("lines")["line"], ", ")))
        .drop("lines"))
    if claims is None:
        return out
    numbers = ["peak_pct", "areas", *[f"n_{s}" for s in K.SEVERITIES]]
    return claims.select("claim_id").distinct().join(out, "claim_id", "left").fillna(0, numbers).fillna(K.NO_DAMAGE, ["summary"])


def replay_flag(results: DataFrame) -> DataFrame:
    """Screen-replay verdict of a claim from per-detection flags.

    A flag counts from 0.60 confidence. The reported confidence is the largest among the
    flagged results, or among all when none is flagged; evidence (first four entries)
    belongs to the first strongest flagged result.
    """
    conf = F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("replay_confidence"))), F.lit(0.0))
    rows = results.withColumn("_c", conf).withColumn(
        "_f", normalize_bool(F.col("replay_suspected").cast("string")) & (conf >= K.REPLAY_FLAG_CONFIDENCE))
    strongest = F.min(F.when(F.col("_f"), F.struct((-F.col("_c")).alias("c"), F.col("keep_idx"), F.col("replay_evidence"))))
    return (rows.groupBy("claim_id").agg(F.bool_or("_f").alias("flagged"), strongest.alias("s"),
                                         F.max("_c").alias("any_conf"))
            .select("claim_id", "flagged",
                    F.when(F.col("flagged"), -F.col("s.c")).otherwise(F.col("any_conf")).alias("confidence"),
                    F.when(F.col("flagged"), F.slice("s.replay_evidence", 1, 4))
                    .otherwise(F.array().cast("array<string>")).alias("evidence")))


def single_source(det: DataFrame, key: str, image: str) -> DataFrame:
    """Requests whose detections all come from one image."""
    return det.groupBy(key).agg((F.min(image) == F.max(image)).alias("single_source"))
