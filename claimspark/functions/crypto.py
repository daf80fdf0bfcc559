"""Digests, canonical JSON and receipts, all computed by Spark expressions."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SIGNED, UNSIGNED = "HMAC-SHA256", "SHA-256-UNSIGNED-DEVELOPMENT"


def digest(content: Column) -> Column:
    """SHA-256 of text or bytes as lower-case hex."""
    return F.sha2(content.cast("binary"), 256)


def canonical_json(**fields: Column) -> Column:
    """Compact JSON object with keys in sorted order and NULLs kept; for nested values see :func:`sorted_keys`."""
    ordered = F.struct(*[fields[k].alias(k) for k in sorted(fields)])
    return F.to_json(ordered, {"ignoreNullFields": "false"})


def sorted_keys(value: Column, kind: T.DataType) -> Column:
    """The value with the fields of every struct and the keys of every map in sorted order, at any depth."""
    if isinstance(kind, T.StructType):
        inner = [sorted_keys(value[f.name], f.dataType).alias(f.name) for f in sorted(kind, key=lambda f: f.name)]
        return F.when(value.isNotNull(), F.struct(*inner)) if inner else value
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: sorted_keys(x, kind.elementType))
    if isinstance(kind, T.MapType):
        entry = lambda e: F.struct(e["key"].alias("key"), sorted_keys(e["value"], kind.valueType).alias("value"))
        by_key = lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0)
        return F.map_from_entries(F.transform(F.array_sort(F.map_entries(value), by_key), entry))
    return value


def canonical_text(payload_json: Column, schema: str | T.DataType) -> Column:
    """Canonical form of JSON text of a known schema: sorted keys at any depth, no blanks, NULLs kept.

    Text that is no such JSON is its own canonical form.
    """
    kind = T.DataType.fromDDL(schema) if isinstance(schema, str) else schema
    value = F.from_json(payload_json, kind)
    return F.coalesce(F.to_json(sorted_keys(value, kind), {"ignoreNullFields": "false"}), payload_json)


def hmac_sha256(secret: bytes, message: Column) -> Column:
    """RFC 2104 HMAC built from two nested digests; only the key pads are literals."""
    key = hashlib.sha256(secret).digest() if len(secret) > 64 else secret
    key = key.ljust(64, b"\0")
    pad = lambda byte: F.lit(bytearray(b ^ byte for b in key))
    inner = F.unhex(F.sha2(F.concat(pad(0x36), message.cast("binary")), 256))
    return F.sha2(F.concat(pad(0x5C), inner), 256)


def receipt(payload_json: Column, secret: bytes = b"", key_id: str | None = None) -> Column:
    """Struct (receipt, algorithm, key_id): keyed when a secret is set, else labelled unsigned."""
    value = hmac_sha256(secret, payload_json) if secret else digest(payload_json)
    return F.struct(
        value.alias("receipt"),
        F.lit(SIGNED if secret else UNSIGNED).alias("algorithm"),
        F.lit((key_id or "").strip() or None).cast("string").alias("key_id"),
    )
