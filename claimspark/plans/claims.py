"""End-to-end plans: evidence verification, damage analysis, claim finalisation."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.crypto import canonical_json
from ..operators import audit, detections, ledger, matching, metadata, outcome, pricing, risk, signals
from ..session import materialize

CHECK_COLUMNS = ["claim_id", "stage", "check_no", "raw_status", "error_code"]
Stage = Callable[[DataFrame], DataFrame]


def check(df: DataFrame, stage: int, check_no: int, passed: Column, error_code: str) -> DataFrame:
    """One audit check row per claim row."""
    return df.select("claim_id", F.lit(stage).alias("stage"), F.lit(check_no).alias("check_no"),
                     F.when(passed, "PASSED").otherwise("FAILED").alias("raw_status"), F.lit(error_code).alias("error_code"))


def verify_claims(claims: DataFrame, stages: list[Stage]) -> DataFrame:
    """Run audit stages in order; only claims that passed a stage reach the next one.

    Each stage maps surviving ``claim_id`` rows to check rows (see :func:`check`). The
    check table of a stage is written once, because survivors and roll-up both read it; so are
    the survivors, or every later stage would run the joins of all stages before it.
    Stage 5 has no provider and stays SKIPPED. Returns the rolled-up five stages.
    """
    alive, done = claims.select("claim_id"), []
    for stage in stages:
        rows = materialize(stage(alive).select(*CHECK_COLUMNS))
        done.append(rows)
        alive = materialize(alive.join(rows.where(F.col("raw_status") == "FAILED").select("claim_id").distinct(), "claim_id", "left_anti"))
    return audit.audit_rollup(reduce(DataFrame.unionByName, done))


@dataclass(frozen=True)
class Evidence:
    """What is known of claims; every table has ``claim_id``.

    ``containers``: ``body``. ``pixels``: ``frame_index, y, x, v``. ``hashes`` and ``history``: frames as
    :func:`matching.rule_matches` reads them. ``spectra``, ``tracks``, ``blocks``, ``faces``: as read by
    :func:`signals.spectral_peak_ratio`, :func:`signals.planar_ratio`, :func:`signals.copy_move` and
    :func:`signals.liveness_verdict`. ``metrics``: per frame what :func:`signals.tamper_verdict` reads, but ``transferred``;
    or a function of pixels that gives it, which then sees only those of the claims in question.
    """

    containers: DataFrame
    pixels: DataFrame
    hashes: DataFrame
    history: DataFrame
    spectra: DataFrame
    tracks: DataFrame
    blocks: DataFrame
    metrics: DataFrame | Callable[[DataFrame], DataFrame]
    faces: DataFrame


def forensic_checks(e: Evidence, static_threshold: float = K.STATIC_FEED_THRESHOLD) -> list[Stage]:
    """The checks of a verification run in order, for :func:`verify_claims`.

    Readable frames and container text; motion and duplicates; screen replay, copied or spliced blocks and
    tampered frames; faces. Each reads the evidence of the claims that reach it. A claim without any pixels
    fails the first check; other evidence that is missing fails nothing, and no container text is an empty one.
    """
    def stage(number: int, check_no: int, code: str, failed: Callable[[Callable, DataFrame], DataFrame]) -> Stage:
        def run(alive: DataFrame) -> DataFrame:
            of = lambda df: df.join(alive, "claim_id", "left_semi")
            bad = failed(of, alive).select("claim_id").distinct().withColumn("_bad", F.lit(True))
            return check(alive.join(bad, "claim_id", "left"), number, check_no, F.col("_bad").isNull(), code)

        return run

    def tampered(of, alive):
        moved = metadata.container_scan(of(e.containers)).select("claim_id", "transferred")
        metrics = e.metrics(of(e.pixels)) if callable(e.metrics) else of(e.metrics)
        frames = metrics.join(moved, "claim_id", "left").withColumn("transferred", F.coalesce("transferred", F.lit(False)))
        return signals.tamper_verdict(frames).where(~F.col("passed"))

    matched = lambda of, alive: matching.rule_matches(materialize(of(e.hashes)), e.history)
    replayed = lambda of, alive: signals.screen_replay(signals.spectral_peak_ratio(of(e.spectra)), signals.planar_ratio(of(e.tracks))).where("detected")
    altered = lambda of, alive: (signals.copy_move(of(e.blocks)).select("claim_id")
                                 .unionByName(signals.temporal_splice(of(e.blocks)).select("claim_id")))
    return [
        stage(1, 0, K.FRAMES_CODE, lambda of, alive: alive.join(e.pixels.select("claim_id").distinct(), "claim_id", "left_anti")),
        stage(1, 1, K.STAGE_DEFAULT_CODES[1], lambda of, alive: metadata.container_scan(of(e.containers)).where(~F.col("passed"))),
        stage(2, 0, K.STATIC_CODE, lambda of, alive: signals.static_feed(of(e.pixels), static_threshold).where(~F.col("passed"))),
        stage(2, 1, K.STAGE_DEFAULT_CODES[2], matched),
        stage(3, 0, K.SCREEN_CODE, replayed),
        stage(3, 1, K.BLOCKS_CODE, altered),
        stage(3, 2, K.STAGE_DEFAULT_CODES[3], tampered),
        stage(4, 0, K.STAGE_DEFAULT_CODES[4], lambda of, alive: signals.liveness_verdict(of(e.faces)).where(~F.col("passed"))),
    ]


def analyse_detections(det: DataFrame, context: DataFrame, severities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(retained detections with severity, detections lacking a severity result)."""
    kept = detections.dedupe_detections(detections.filter_detections(det, context))
    return detections.attach_severity(materialize(kept), severities)


def finalise_claims(kept: DataFrame, context: DataFrame, gateway: DataFrame) -> DataFrame:
    """Price, score and decide every claim of ``context``.

    ``gateway``: ``claim_id, gateway_status, legacy_status, overall_status, replay_flagged``.
    """
    cost = pricing.repair_estimate(kept, context).select("claim_id", "items", "total_cost")
    score = risk.risk_score(kept, context).select("claim_id", "total_score", "risk_level", "overall_confidence")
    rows = cost.join(score, "claim_id").join(gateway, "claim_id", "left")
    return outcome.settlement_option(outcome.claim_outcome(rows)).select(
        "claim_id", "items", "outcome", "stored_status", "fraud_score", "risk_level", "overall_confidence",
        "estimated_cost", "eligible", "cash_payout")


def seal_claims(final: DataFrame, evidence: DataFrame, stored: DataFrame | None = None, secret: bytes = b"",
                key_id: str | None = None) -> DataFrame:
    """Receipts binding each decision to its evidence digest (``claim_id, file_sha256, arrival``)."""
    payload = canonical_json(claim_id=F.col("claim_id"), file_sha256=F.col("file_sha256"), outcome=F.col("outcome"),
                             total_cost=F.col("estimated_cost"))
    rows = final.join(evidence, "claim_id").select("claim_id", "arrival", payload.alias("payload_json"))
    return ledger.finalise_receipts(stored, rows, "arrival", secret, key_id)
