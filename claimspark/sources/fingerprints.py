"""The evidence fingerprint table: one row per frame, claim scalars on the first frame only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.similarity import hamming
from ..operators.ledger import first_writer
from ..operators.skew import with_positions, with_previous
from ..schemas import FINGERPRINTS

BUCKETS = 1024
HASHES = ("phash", "dhash", "ahash")
SCALARS = ("color_sig", "motion_sig", "capture_timestamp", "gps_lat", "gps_lon")


def evolve_schema(df: DataFrame, ddl: str = FINGERPRINTS) -> DataFrame:
    """Add the columns of ``ddl`` that are missing, as NULL; extra columns stay."""
    target = StructType.fromDDL(ddl)
    missing = [f for f in target if f.name not in df.columns]
    return df.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in missing])


def read_fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """Stored frames of any schema age."""
    return evolve_schema(spark.read.option("mergeSchema", "true").parquet(path))


def read_hashes(spark: SparkSession, path: str) -> DataFrame:
    """Non-empty perceptual hashes only; column pruning and the filter reach the scan."""
    return spark.read.parquet(path).select("phash").where(F.col("phash") != "")


def write_fingerprints(frames: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Append frames, one directory per hash bucket of the claim."""
    (frames.withColumn("bucket", F.pmod(F.xxhash64("claim_id"), F.lit(buckets)).cast("int"))
     .write.mode("append").partitionBy("bucket").parquet(path))


def explode_fingerprints(claims: DataFrame) -> DataFrame:
    """Claim fingerprints (hash lists) to frame rows; scalars appear on frame 0 only.

    The perceptual hash list decides the number of frames. A missing difference or
    average hash stays NULL.
    """
    at = lambda c: F.get(F.col(c), F.col("frame_index"))
    rows = claims.select("*", F.posexplode("phash_seq").alias("frame_index", "phash"))
    on_first = lambda c: F.when(F.col("frame_index") == 0, F.col(c)).alias(c)
    json = lambda c: F.when(F.col("frame_index") == 0, F.to_json(c)).alias(c)
    return rows.select("claim_id", "file_sha256", "frame_index", "phash", at("dhash_seq").alias("dhash"),
                       at("ahash_seq").alias("ahash"), json("color_sig"), json("motion_sig"),
                       *[on_first(c) for c in SCALARS[2:]])


def append_fingerprints(stored: DataFrame, claims: DataFrame, order: str) -> tuple[DataFrame, DataFrame]:
    """(frame rows to append, conflicting submissions).

    The same digest again is a no-op; another digest for a finalised claim is a conflict.
    """
    digests = stored.groupBy("claim_id").agg(F.max_by("file_sha256", "frame_index").alias("file_sha256"))
    judged = first_writer(claims, digests, "claim_id", "file_sha256", order)
    fresh = judged.where(F.col("verdict") == "new")
    return explode_fingerprints(fresh), judged.where(F.col("verdict") == "conflict").select("claim_id", order, "file_sha256")


def group_fingerprints(frames: DataFrame) -> DataFrame:
    """Frame rows to ordered hash sequences in long form: ``claim_id, kind, pos, n, hash``.

    Empty and missing hashes are skipped; ``pos`` counts the others in frame order and ``n`` is
    the length of the sequence. No row gathers a claim's frames, so a claim of any length has
    the same form. :func:`claim_scalars` has the values of the claim.
    """
    df = evolve_schema(frames)
    kinds = F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).alias("hash")) for c in HASHES])
    rows = df.select("claim_id", "frame_index", F.inline(kinds)).where(F.col("hash") != "")
    return with_positions(rows, ["claim_id", "kind"], "frame_index").select("claim_id", "kind", "pos", "n", "hash")


def claim_scalars(frames: DataFrame) -> DataFrame:
    """Digest of the last frame and first non-NULL scalars of each claim, without collecting its frames."""
    df = evolve_schema(frames)
    first = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct("frame_index", F.col(c).alias("v"))))["v"].alias(c)
    return df.groupBy("claim_id").agg(F.max_by("file_sha256", "frame_index").alias("file_sha256"), *[first(c) for c in SCALARS])


def motion_signature(frames: DataFrame, column: str = "phash") -> DataFrame:
    """Hamming distance of every frame hash to the previous non-empty one (long form)."""
    rows = with_positions(frames.where(F.col(column) != "").select("claim_id", "frame_index", column), ["claim_id"], "frame_index")
    pairs = with_previous(rows, ["claim_id"], "pos", {column: "_prev"}).where(F.col("pos") > 0)
    return pairs.select("claim_id", "pos", hamming(F.col(column), F.col("_prev")).alias("distance"))
