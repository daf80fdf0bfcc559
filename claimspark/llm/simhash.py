"""SimHash near-duplicates: fingerprints of word shingles, linked by tiled exact comparison.

Distinct fingerprints are sorted by the population counts of their four 16-bit parts and cut
into tiles. Two fingerprints within the radius differ by no more than the radius in the sum of
their parts' counts, so a tile pair whose count ranges lie further apart is skipped, first between
tiles in Spark, then between the rows of a tile pair. What remains is compared with exclusive-or
and bit counts. A tile pair returns a spanning forest of its links, never all pairs of a group.

Defined results: a null text is an empty one; a text without words has fingerprint zero and is
linked like any other; repeated rows share a fingerprint and a component; an empty table gives no
rows. Only key and text are read, so other columns' names do not matter. A null key is linked like
any other, and is a component only where no key is known.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimspark.session import materialize

from .common import text_bytes
from .graph import components

WORDS, SEED, RADIUS = 3, 42, 3
TILE, ROWS = 8192, 256  # fingerprints in a tile, and in a block of a tile
PARTS = 4


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """64 bits, each set if over half of the shingles' hashes have it."""
    w = text.lower().split()  # bytes: A-Z and ASCII white space only
    if not w:
        return 0
    shingles = [b" ".join(w)] if len(w) < words else map(b" ".join, zip(*[w[k:] for k in range(words)]))
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(s, SEED) for s in shingles), dtype=np.uint64)
    count = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 1 << 16):
        some = h[at : at + (1 << 16)]
        count += np.unpackbits(some.view(np.uint8).reshape(len(some), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(count * 2 > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long, for every row."""
    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), words) for t in b.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    kind = dict(docs.dtypes)[key]
    return docs.select(F.col(key).alias("doc_id"), text_bytes(text).alias("t")).mapInArrow(run, f"doc_id {kind}, fp long")


def _part_counts(fps: np.ndarray) -> np.ndarray:
    return np.bitwise_count(fps.view(np.uint16).reshape(len(fps), PARTS)).astype(np.int16)


def tiles(fps: DataFrame, size: int = TILE) -> DataFrame:
    """(tile, lo, hi, fps) from distinct fingerprints (fp); lo and hi bound the parts' counts."""
    part = lambda k: F.bit_count(F.shiftrightunsigned("fp", 16 * k).bitwiseAND(0xFFFF))
    order = [part(k) for k in range(PARTS)]
    n = fps.count()
    spread = fps.repartitionByRange(max(1, -(-n // size)), *order, F.col("fp")).sortWithinPartitions(*order, "fp")

    def run(batches):
        held, have = [], 0
        for b in batches:
            held.append(np.asarray(b.column(0)))
            have += len(held[-1])
            while have >= size:
                whole = np.concatenate(held)
                yield one(whole[:size])
                held, have = [whole[size:]], have - size
        if have:
            yield one(np.concatenate(held))

    def one(fp: np.ndarray) -> pa.RecordBatch:
        c = _part_counts(fp)
        return pa.RecordBatch.from_arrays([pa.array([c.min(axis=0).tolist()], pa.list_(pa.int32())), pa.array([c.max(axis=0).tolist()], pa.list_(pa.int32())),
                                           pa.array([fp.tobytes()], pa.binary())], names=["lo", "hi", "fps"])

    return materialize(spread.select("fp").mapInArrow(run, "lo array<int>, hi array<int>, fps binary").select(F.monotonically_increasing_id().alias("tile"), "*"))


def _gap(lo_a: Column, hi_a: Column, lo_b: Column, hi_b: Column) -> Column:
    return sum((F.greatest(F.lit(0), lo_b[k] - hi_a[k], lo_a[k] - hi_b[k]) for k in range(PARTS)), F.lit(0))


def tile_pairs(cut: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): pairs of tiles, each with itself too, whose counts come within the radius.

    Ranges of the first part's count, widened by the radius, meet first at the larger lower end.
    """
    meta = cut.select("tile", "lo", "hi")
    side = lambda s: meta.select(*[F.col(c).alias(f"{c}_{s}") for c in meta.columns]).withColumn(
        f"v_{s}", F.explode(F.sequence(F.col(f"lo_{s}")[0], F.col(f"hi_{s}")[0] + radius)))
    met = side("a").join(side("b"), F.col("v_a") == F.col("v_b"))
    first = F.col("v_a") == F.greatest(F.col("lo_a")[0], F.col("lo_b")[0])
    near = _gap(F.col("lo_a"), F.col("hi_a"), F.col("lo_b"), F.col("hi_b")) <= radius
    return met.filter(first & near & (F.col("tile_a") <= F.col("tile_b"))).select(F.col("tile_a").alias("a"), F.col("tile_b").alias("b"))


def near(x: np.ndarray, y: np.ndarray, same: bool, radius: int, rows: int = ROWS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of fingerprints within the radius, block by block."""
    def boxes(fp):
        c, starts = _part_counts(fp), np.arange(0, len(fp), rows)
        return np.minimum.reduceat(c, starts), np.maximum.reduceat(c, starts)

    (lo_x, hi_x), (lo_y, hi_y) = boxes(x), boxes(y)
    for k in range(len(lo_x)):
        gap = np.maximum(0, np.maximum(lo_y - hi_x[k], lo_x[k] - hi_y)).sum(axis=1)
        for j in np.flatnonzero(gap <= radius):
            if same and j < k:
                continue
            a, b = x[k * rows : (k + 1) * rows], y[j * rows : (j + 1) * rows]
            p, q = np.nonzero(np.bitwise_count(a[:, None] ^ b[None, :]) <= radius)
            if len(p):
                yield p + k * rows, q + j * rows


def _settle(label: np.ndarray, p: np.ndarray, q: np.ndarray) -> None:
    """Make the ends of all links have one label, the smallest of their component."""
    while len(p):
        a, b = label[p], label[q]
        apart = a != b
        if not apart.any():
            return
        p, q, a, b = p[apart], q[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (jump := label[label] != label).any():
            label[jump] = label[label[jump]]


def links(cut: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): links between fingerprints that connect what is within the radius, without cycles a tile pair."""
    def run(batches):
        for b in batches:
            for x, y, same in zip(b.column(0), b.column(1), b.column(2).to_pylist()):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                nodes = x if same else np.concatenate([x, y])
                label = np.arange(len(nodes))
                for p, q in near(x, y, same, radius):
                    _settle(label, p, q if same else q + len(x))
                child = np.flatnonzero(label != np.arange(len(nodes)))
                yield pa.RecordBatch.from_arrays([pa.array(nodes[child].view(np.int64)), pa.array(nodes[label[child]].view(np.int64))], names=["a", "b"])

    pairs = tile_pairs(cut, radius)
    blobs = lambda s: cut.select(F.col("tile").alias(f"t{s}"), F.col("fps").alias(f"f{s}"))
    full = pairs.join(blobs("a"), F.col("a") == F.col("ta")).join(blobs("b"), F.col("b") == F.col("tb"))
    return full.select("fa", "fb", (F.col("a") == F.col("b")).alias("same")).repartition(F.xxhash64("fa", "fb")).mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """(key, fp, component): every row with the smallest key that links of fingerprints reach."""
    found = materialize(fingerprints(docs, key, text))
    distinct = materialize(found.groupBy("fp").agg(F.min("doc_id").alias("doc")))
    roots = components(links(tiles(distinct.select("fp")), radius))
    rooted = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "doc", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("doc").alias("component")).withColumnRenamed("root", "r")
    by_fp = rooted.join(least, F.col("root") == F.col("r")).select(F.col("fp").alias("f"), "component")
    return found.join(by_fp, F.col("fp") == F.col("f")).select(F.col("doc_id").alias(key), "fp", "component")
