"""Offline claims and the upload queue of an account."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from .skew import top_per_key

# Queue state after each action.
ACTION_STATE = {"queued": "pending", "retried": "pending", "started": "processing",
                "uploaded": "done", "invalid": "rejected", "failed": "failed"}


def owner_of(owner: Column) -> Column:
    return F.coalesce(F.nullif(owner.cast("string"), F.lit("")), F.lit(K.DEFAULT_OWNER))


def evict_oldest(claims: DataFrame, keep: int = K.MAX_OFFLINE_CLAIMS) -> DataFrame:
    """The ``keep`` most recently modified claims of every owner."""
    return top_per_key(claims, ["owner_id"], [F.desc("last_modified"), F.desc("claim_id")], keep).drop("_rank")


def claim_history(writes: DataFrame, keep: int = K.MAX_HISTORY_CLAIMS) -> DataFrame:
    """Latest write per (owner, claim), newest first, at most ``keep`` per owner."""
    cols = [c for c in writes.columns if c not in ("owner_id", "claim_id", "written_at")]
    last = (writes.groupBy("owner_id", "claim_id").agg(F.max(F.struct("written_at", *cols)).alias("w"))
            .select("owner_id", "claim_id", "w.*"))
    return top_per_key(last, ["owner_id"], [F.desc("written_at"), F.desc("claim_id")], keep, rank="position")


def queue_ids(claims: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pending ids, failed ids): a failed upload stays pending for the next attempt."""
    ids = lambda cond: claims.where(cond).select("owner_id", "claim_id").distinct()
    return ids(F.col("queued") | F.col("failed")), ids(F.col("failed"))


def queued_union(pending: DataFrame, failed: DataFrame) -> DataFrame:
    return pending.unionByName(failed).distinct()


def pending_not_failed(pending: DataFrame, failed: DataFrame) -> DataFrame:
    return pending.join(failed, ["owner_id", "claim_id"], "left_anti")


def orphan_entries(queue: DataFrame, claims: DataFrame) -> DataFrame:
    """Queued ids without a stored claim."""
    return queue.join(claims.select("owner_id", "claim_id"), ["owner_id", "claim_id"], "left_anti")


def storage_usage(claims: DataFrame) -> DataFrame:
    """Bytes, share of the storage limit and queue sizes per owner, in one aggregation."""
    q, f = F.col("queued"), F.col("failed")
    return (claims.groupBy("owner_id").agg(
        F.sum("size_bytes").alias("total_size"), F.count_if(q | f).alias("queued_claims"),
        F.count_if(q & ~f).alias("pending_uploads"), F.count_if(f).alias("failed_uploads"))
        .withColumn("usage_percentage", F.col("total_size") * 100.0 / F.lit(K.MAX_STORAGE_BYTES)))


def queue_state(events: DataFrame) -> DataFrame:
    """State of every queued claim: that of its last action, plus its failure count.

    Every action sets the state regardless of the one before, so no ordered fold of a
    claim's events is needed.
    """
    from ..functions.numbers import choose

    last = F.max(F.struct("event_ts", "event_seq", "action"))
    return (events.groupBy("claim_id").agg(last.alias("l"), F.count_if(F.col("action") == "failed").alias("failures"))
            .select("claim_id", choose(F.col("l.action"), ACTION_STATE, F.lit("pending")).alias("queue_state"),
                    "failures", F.col("l.event_seq").alias("last_seq")))
