"""Transaction ledger, first-writer-wins tables, receipts, merges and manifests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import crypto

IDENTITY = ("claim_id", "owner_id")


def fold_events(events: DataFrame) -> DataFrame:
    """First arrival, latest state and event count of each (request, claim, owner).

    Folded rows of disjoint event sets can be folded again by :func:`settle`, so a stream
    only appends them.
    """
    outcome = F.col("outcome_json") if "outcome_json" in events.columns else F.lit(None).cast("string")
    arrival = F.struct("updated_at", "event_id")
    return events.groupBy("request_id", *IDENTITY).agg(
        F.min(arrival).alias("first_seen"),
        F.max(F.struct("updated_at", "event_id", "state", outcome.alias("outcome_json"))).alias("latest"),
        F.count(F.lit(1)).alias("events"))


def settle(folded: DataFrame) -> DataFrame:
    """Current row per request from folded rows, several per identity allowed."""
    per_identity = folded.groupBy("request_id", *IDENTITY).agg(
        F.min("first_seen").alias("first_seen"), F.max("latest").alias("latest"), F.sum("events").alias("events"))
    winner = F.min(F.struct("first_seen", *IDENTITY, "latest", "events"))
    return (per_identity.groupBy("request_id").agg(winner.alias("w"), F.sum("events").alias("all_events"))
            .select("request_id", "w.claim_id", "w.owner_id", F.col("w.latest.state").alias("state"),
                    F.col("w.latest.outcome_json").alias("outcome_json"),
                    F.col("w.first_seen.updated_at").alias("created_at"),
                    F.col("w.latest.updated_at").alias("updated_at"),
                    (F.col("all_events") - F.col("w.events")).alias("collisions")))


def latest_transactions(events: DataFrame) -> DataFrame:
    """Current row per request: creation time of the first event, state of the last.

    The (claim, owner) of the first event owns the request. Later events of another
    identity are ignored and counted in ``collisions``. Arrival order is
    ``(updated_at, event_id)``.
    """
    return settle(fold_events(events))


def split_domain(rows: DataFrame, column: str = "state", domain: tuple[str, ...] = K.TRANSACTION_STATES) -> tuple[DataFrame, DataFrame]:
    """(rows whose value belongs to the domain, the others); a NULL belongs to none.

    For offline claims pass ``status`` with ``OFFLINE_STATUSES`` or, for what may be queued,
    ``QUEUEABLE_STATUSES``.
    """
    known = F.coalesce(F.col(column).isin(*domain), F.lit(False))
    return rows.where(known), rows.where(~known)


def request_collisions(events: DataFrame) -> DataFrame:
    """Identities that tried to reuse a request id they do not own."""
    groups = fold_events(events)
    owner = (groups.groupBy("request_id").agg(F.min(F.struct("first_seen", *IDENTITY)).alias("w"))
             .select("request_id", F.struct("w.claim_id", "w.owner_id").alias("owning")))
    return (groups.join(owner, "request_id").where(F.struct(*IDENTITY) != F.col("owning"))
            .select("request_id", *IDENTITY, "events"))


def upsert_transactions(stored: DataFrame, events: DataFrame | None) -> DataFrame:
    """Fold new events into a stored ledger of :func:`fold_events` rows; the result is such a ledger.

    Without events the stored rows are folded to one per identity.

    The folded form keeps arrival order and the events of every identity, so collisions and
    ties survive any number of upserts. :func:`settle` gives the current rows.
    """
    both = stored if events is None else stored.unionByName(fold_events(events))
    return both.groupBy("request_id", *IDENTITY).agg(
        F.min("first_seen").alias("first_seen"), F.max("latest").alias("latest"), F.sum("events").alias("events"))


def ledger_page(ledger: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """One page, newest first; the limit is clamped to 1..100 and the offset to >= 0."""
    return (ledger.orderBy(F.desc("updated_at"), "request_id")
            .offset(max(offset, 0)).limit(min(max(limit, 1), 100)))


def first_writer(incoming: DataFrame, stored: DataFrame | None, key: str, content: str, order: str) -> DataFrame:
    """Classify each incoming row as ``new``, ``same`` or ``conflict``.

    The stored content of the key decides; without one the first incoming row does, by
    order, then content. Exactly one row of a key is ``new``; equal content is ``same``.
    """
    pick = F.struct(F.col(order).alias("o"), F.col(content).alias("c"))
    first = incoming.groupBy(key).agg(F.min(pick).alias("_first"))
    rows = incoming.join(first, key)
    # exact copies of the winning row differ in nothing, so any one of them is the new one
    copy = F.row_number().over(Window.partitionBy(key, order, content).orderBy(F.lit(1)))
    rows = rows.withColumn("_copy", F.when(pick == F.col("_first"), copy))
    if stored is not None:
        rows = rows.join(stored.select(key, F.col(content).alias("_stored")), key, "left")
    else:
        rows = rows.withColumn("_stored", F.lit(None).cast(incoming.schema[content].dataType))
    binding = F.coalesce("_stored", "_first.c")
    verdict = (F.when(F.col("_stored").isNull() & (F.col("_copy") == 1), "new")
               .when(F.col(content) == binding, "same").otherwise("conflict"))
    return rows.withColumn("verdict", verdict).drop("_first", "_stored", "_copy")


def append_results(stored: DataFrame, incoming: DataFrame, order: str = "created_at") -> DataFrame:
    """Terminal results to insert: claims without a stored one, first submission each."""
    fresh = incoming.join(stored.select("claim_id"), "claim_id", "left_anti")
    cols = [c for c in incoming.columns if c != "claim_id"]
    return (fresh.groupBy("claim_id").agg(F.min(F.struct(F.col(order).alias("_o"), *cols)).alias("r"))
            .select("claim_id", *[F.col(f"r.{c}").alias(c) for c in cols]))


def lookup_results(requests: DataFrame, stored: DataFrame) -> DataFrame:
    """Stored result per request: FOUND, NONE, or FORBIDDEN for another account's claim."""
    have = stored.select("claim_id", F.col("owner_id").alias("_owner"), "response_json")
    status = (F.when(F.col("_owner").isNull(), "NONE").when(F.col("_owner") != F.col("owner_id"), "FORBIDDEN").otherwise("FOUND"))
    return (requests.join(have, "claim_id", "left").withColumn("access", status)
            .withColumn("response_json", F.when(F.col("access") == "FOUND", F.col("response_json"))).drop("_owner"))


def finalise_receipts(stored: DataFrame | None, incoming: DataFrame, order: str,
                      secret: bytes = b"", key_id: str | None = None, schema: str | None = None) -> DataFrame:
    """Receipts of finalised payloads; a different payload for the same claim is a conflict.

    Reads ``claim_id, payload_json``. A repeated payload returns the stored receipt
    unchanged, whatever key is configured now. With the payloads' ``schema`` their canonical
    form is compared and signed, so the order of keys and blanks do not matter.
    """
    if schema is not None:
        canonical = lambda df: df.withColumn("payload_json", crypto.canonical_text(F.col("payload_json"), schema))
        incoming, stored = canonical(incoming), stored if stored is None else canonical(stored)
    rows = first_writer(incoming, stored, "claim_id", "payload_json", order)
    made = rows.withColumn("_r", crypto.receipt(F.col("payload_json"), secret, key_id))
    cols = ["receipt", "algorithm", "key_id"]
    if stored is not None:
        old = stored.select("claim_id", F.struct(*cols).alias("_old"))
        made = made.join(old, "claim_id", "left").withColumn("_r", F.coalesce("_old", "_r")).drop("_old")
    ok = F.col("verdict") != "conflict"
    return made.select(*incoming.columns, "verdict", *[F.when(ok, F.col(f"_r.{c}")).alias(c) for c in cols])


def merge_fingerprints(src: DataFrame, dst: DataFrame) -> DataFrame:
    """Row-by-row merge decision on ``(claim_id, frame_index)``.

    ``insert`` for keys absent at the destination, ``conflict`` when the stored
    (digest, hash) differs, ``keep`` otherwise. Destination-only rows are ``keep``.
    """
    key = ["claim_id", "frame_index"]
    body = lambda df, name: df.select(*key, F.struct("file_sha256", "phash").alias(name))
    joined = body(src, "s").join(body(dst, "d"), key, "full")
    verdict = (F.when(F.col("d").isNull(), "insert").when(F.col("s").isNotNull() & ~F.col("s").eqNullSafe(F.col("d")), "conflict")
               .otherwise("keep"))
    return joined.select(*key, verdict.alias("verdict"), F.coalesce("d", "s").alias("row")).select(
        *key, "verdict", "row.file_sha256", "row.phash")


def merge_report(src: DataFrame, dst: DataFrame) -> DataFrame:
    return merge_fingerprints(src, dst).groupBy("verdict").agg(F.count(F.lit(1)).alias("rows"))


def apply_merge(src: DataFrame, dst: DataFrame) -> DataFrame:
    """Destination plus the absent source rows; existing rows never change."""
    fresh = src.join(dst.select("claim_id", "frame_index"), ["claim_id", "frame_index"], "left_anti")
    return dst.unionByName(fresh, allowMissingColumns=True)


def inventory(tables: dict[str, DataFrame]) -> DataFrame:
    """Row count per table in one job."""
    counts = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table_name"), "rows")
              for name, df in tables.items()]
    return reduce(DataFrame.unionByName, counts)


def verify_manifest(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """Compare file digests with a manifest; hex case does not matter."""
    joined = expected.select("path", F.upper("sha256").alias("want")).join(
        actual.select("path", F.upper("sha256").alias("got")), "path", "full")
    verdict = (F.when(F.col("want").isNull(), "UNLISTED").when(F.col("got").isNull(), "MISSING")
               .when(F.col("want") == F.col("got"), "OK").otherwise("MISMATCH"))
    return joined.select("path", verdict.alias("verdict"))


def exact_duplicates(evidence: DataFrame, digest: str, ident: str) -> DataFrame:
    """Digests seen more than once: number of copies and the smallest id (the original).

    Copies combine map-side; a digest shared by most rows still yields one row.
    """
    return (evidence.groupBy(digest).agg(F.count(F.lit(1)).alias("copies"), F.min(ident).alias("first_id"))
            .where(F.col("copies") > 1))
