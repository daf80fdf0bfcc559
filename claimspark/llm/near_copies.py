"""Near copies by five-word shingles: SimHash candidates, linked after exact comparison of their shingle sets.

Two documents are near copies if the Jaccard similarity of their sets of five-word shingles is at
least 0.8; groups are the connected components. Equal sets are one node. A node has four 64-bit
SimHash fingerprints; nodes sorted by set size are cut into tiles, tile pairs whose sizes can reach
0.8 are compared, and those within ``RADIUS`` of 256 bits are candidates. The radius lies more
than four standard deviations beyond the distance expected at 0.8, so few pairs are missed.

Components of candidates are then compared exactly, all pairs of a component: small ones in one
unit, larger ones in blocks, each with the component's root, and after that the blocks that
are not yet one group with each other. A unit emits links that join, never all pairs.

Defined results: a null text is an empty one; texts without words are copies of each other; a text
of fewer than five words is one shingle. Words are those of ``common``, A-Z in lower case. Shingles
and sets are compared by 64-bit hashes. Only key and text are read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimspark.session import materialize

from .common import PRIME, U64, mix, text_bytes, unused_prefix, word_hashes
from .graph import components
from .simhash import _settle

WORDS = 5
PARTS = 4  # fingerprints of 64 bits
RADIUS, FIRST = 72, 42  # of all bits, and of those of the first two parts
TILE, ROWS = 4096, 256  # nodes in a tile, and in a block of a tile
MEMBERS, SHINGLES = 64, 65_536  # about so many in a unit of exact comparison
STEP = 1.26  # ratio of set sizes between buckets, more than the 1.25 that 0.8 allows


def similar(both, size_a, size_b):
    """Jaccard similarity of at least 0.8, in whole numbers."""
    return 5 * both >= 4 * (size_a + size_b - both)


def shingles(text: bytes) -> np.ndarray:
    """The sorted distinct hashes of five-word shingles."""
    w = word_hashes(text, lower=True)
    if not len(w):
        return w
    size = min(WORDS, len(w))
    total = np.full(len(w) - size + 1, size, dtype=U64)
    for k in range(size):
        total = total * U64(PRIME) + w[k : len(w) - size + 1 + k]
    return np.unique(mix(total))


def fingerprint(hashes: np.ndarray) -> np.ndarray:
    """``PARTS`` values of 64 bits, each bit set if over half of the hashes have it."""
    count = np.zeros(64 * PARTS, dtype=np.int64)
    seeds = np.arange(1, PARTS + 1, dtype=U64) * U64(PRIME)
    for at in range(0, len(hashes), 255):
        some = mix(hashes[at : at + 255, None] + seeds)
        count += np.unpackbits(some.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return np.packbits(count * 2 > len(hashes), bitorder="little").view(U64)


def nodes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, h, node, n, f0...): hash of the text, hash and size of its set, fingerprints; for every row."""
    names = ["doc_id", "h", "node", "n", *[f"f{k}" for k in range(PARTS)]]

    def run(batches):
        for b in batches:
            ids, sizes, fps = [], [], []
            for t in b.column(2):
                s = shingles(t.as_py())
                ids.append(xxhash.xxh3_64_intdigest(s.tobytes()))
                sizes.append(len(s))
                fps.append(fingerprint(s))
            long = lambda x: pa.array(np.array(x, dtype=U64).view(np.int64))
            f = np.array(fps, dtype=U64).reshape(len(fps), PARTS)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), long(ids), pa.array(sizes, pa.int64()), *[long(f[:, k].copy()) for k in range(PARTS)]], names=names)

    kind = dict(docs.dtypes)[key]
    schema = f"doc_id {kind}, " + ", ".join(f"{c} long" for c in names[1:])
    source = docs.select(F.col(key).alias("doc_id"), text_bytes(text).alias("t")).select("doc_id", F.xxhash64("t").alias("h"), "t")
    return source.mapInArrow(run, schema)


def tiles(distinct: DataFrame, size: int = TILE) -> DataFrame:
    """(tile, lo, hi, rows) from distinct nodes: runs in order of set size, rows of node, n and fingerprints."""
    n = distinct.count()
    columns = ["node", "n", *[f"f{k}" for k in range(PARTS)]]
    spread = distinct.select(*columns).repartitionByRange(max(1, -(-n // size)), "n", "node").sortWithinPartitions("n", "node")

    def one(x: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[0, 1]]), pa.array([x[-1, 1]]), pa.array([x.tobytes()], pa.binary())], names=["lo", "hi", "rows"])

    def run(batches):
        held, have = [], 0
        for b in batches:
            held.append(np.stack([np.asarray(c) for c in b.columns], axis=1))
            have += len(held[-1])
            while have >= size:
                whole = np.concatenate(held)
                yield one(whole[:size])
                held, have = [whole[size:]], have - size
        if have:
            yield one(np.concatenate(held))

    return materialize(spread.mapInArrow(run, "lo long, hi long, rows binary").select(F.monotonically_increasing_id().alias("tile"), "*"))


def close(x: np.ndarray, y: np.ndarray, same: bool, rows: int = ROWS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of rows within the radius whose sizes allow the similarity, block by block; rows are in order of size."""
    fx, fy = x[:, 2:].view(U64), y[:, 2:].view(U64)
    for i in range(0, len(x), rows):
        for j in range(i if same else 0, len(y), rows):
            a, b, na, nb = fx[i : i + rows], fy[j : j + rows], x[i : i + rows, 1], y[j : j + rows, 1]
            if 4 * na[0] > 5 * nb[-1] or 4 * nb[0] > 5 * na[-1]:
                continue
            apart = np.bitwise_count(a[:, None, 0] ^ b[None, :, 0])
            apart += np.bitwise_count(a[:, None, 1] ^ b[None, :, 1])
            p, q = np.nonzero(apart <= FIRST)
            if len(p):
                near = np.bitwise_count(a[p] ^ b[q]).sum(axis=1, dtype=np.int64) <= RADIUS
                near &= (4 * na[p] <= 5 * nb[q]) & (4 * nb[q] <= 5 * na[p])
                if near.any():
                    yield p[near] + i, q[near] + j


def candidates(cut: DataFrame) -> DataFrame:
    """(a, b): links between nodes that connect all candidates, without cycles in a tile pair."""
    bucket = lambda c: F.when(F.col(c) < 1, 0).otherwise(F.floor(F.log(F.col(c).cast("double")) / F.lit(float(np.log(STEP))))).cast("int")
    meta = cut.select("tile", "lo", "hi", bucket("lo").alias("first"), bucket("hi").alias("last"))
    side = lambda s: meta.select(*[F.col(c).alias(f"{c}_{s}") for c in meta.columns]).withColumn(
        f"v_{s}", F.explode(F.sequence(F.col(f"first_{s}"), F.col(f"last_{s}") + 1)))
    met = side("a").join(side("b"), F.col("v_a") == F.col("v_b"))
    reach = (F.col("lo_a") * 4 <= F.col("hi_b") * 5) & (F.col("lo_b") * 4 <= F.col("hi_a") * 5)
    pairs = met.filter((F.col("v_a") == F.greatest("first_a", "first_b")) & reach & (F.col("tile_a") <= F.col("tile_b"))).select("tile_a", "tile_b")
    blobs = lambda s: cut.select(F.col("tile").alias(f"t{s}"), F.col("rows").alias(f"r{s}"))
    full = pairs.join(blobs("a"), F.col("tile_a") == F.col("ta")).join(blobs("b"), F.col("tile_b") == F.col("tb"))

    def run(batches):
        for b in batches:
            for x, y, same in zip(b.column(0), b.column(1), b.column(2).to_pylist()):
                x, y = (np.frombuffer(v.as_py(), np.int64).reshape(-1, 2 + PARTS) for v in (x, y))
                ids = x[:, 0] if same else np.concatenate([x[:, 0], y[:, 0]])
                label = np.arange(len(ids))
                for p, q in close(x, y, same):
                    _settle(label, p, q if same else q + len(x))
                child = np.flatnonzero(label != np.arange(len(ids)))
                yield pa.RecordBatch.from_arrays([pa.array(ids[child]), pa.array(ids[label[child]])], names=["a", "b"])

    spread = full.select("ra", "rb", (F.col("tile_a") == F.col("tile_b")).alias("same"), "tile_a", "tile_b").repartition(F.xxhash64("tile_a", "tile_b"))
    return spread.select("ra", "rb", "same").mapInArrow(run, "a long, b long")


def linked(sets: list[np.ndarray], label: np.ndarray) -> Iterator[tuple[int, int]]:
    """Links of similar sets that join different labels; ``label`` ends as the groups' smallest place."""
    sizes = np.array([len(s) for s in sets])
    some = np.flatnonzero(sizes)
    if len(some) < 2:
        return
    value, place = np.unique(np.concatenate([sets[k] for k in some]), return_inverse=True)
    start = np.concatenate(([0], np.cumsum(sizes[some])))
    for k, x in enumerate(some):
        if (label[some] == label[some[0]]).all():
            return
        mark = np.zeros(len(value), dtype=np.int64)
        mark[place[start[k] : start[k + 1]]] = 1
        both = np.add.reduceat(mark[place], start[:-1])
        for y in some[similar(both, sizes[x], sizes[some])]:
            if label[x] != label[y]:
                label[label == max(label[x], label[y])] = min(label[x], label[y])
                yield int(x), int(y)


def exact_links(units: DataFrame) -> DataFrame:
    """(a, b) from rows (unit, node, label, t): links of similar texts of a unit whose labels differ."""
    def run(table: pa.Table) -> pa.Table:
        ids = table.column("node").to_numpy()
        _, label = np.unique(table.column("label").to_numpy(), return_inverse=True)
        found = [(ids[x], ids[y]) for x, y in linked([shingles(t.as_py()) for t in table.column("t")], label)]
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return units.groupBy("unit").applyInArrow(run, "a long, b long")


def verified_links(docs: DataFrame, distinct: DataFrame, roots: DataFrame, text: str = "text") -> DataFrame:
    """(a, b): links of similarity 0.8 or more between nodes, which connect all such nodes of a candidate component."""
    inside = roots.select("node", "root").unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    held = distinct.join(inside.withColumnRenamed("node", "c"), F.col("node") == F.col("c")).select("node", "root", "n", F.col("rep.h").alias("rep"))
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / MEMBERS, F.sum("n") / SHINGLES)).cast("long")
    total = held.groupBy("root").agg(blocks.alias("blocks")).withColumnRenamed("root", "r")
    held = materialize(held.join(total, F.col("root") == F.col("r")).drop("r"))
    texts = docs.select(text_bytes(text).alias("t")).withColumn("h", F.xxhash64("t"))
    member = texts.join(held, F.col("h") == F.col("rep")).dropDuplicates(["node"]).select("node", "root", "blocks", "t")
    member = materialize(member.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks"))))

    all_blocks = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    pivot = member.filter(F.col("node") == F.col("root")).withColumn("own", F.col("block")).withColumn("block", all_blocks).filter(F.col("block") != F.col("own"))
    unit = F.struct(F.col("root").alias("c"), F.lit("").alias("x"), F.col("block").cast("string").alias("y"))
    first = member.unionByName(pivot.drop("own")).select(unit.alias("unit"), "node", F.col("node").alias("label"), "t")
    done = materialize(exact_links(first))

    # groups of components of several blocks that are still apart: their blocks meet, except blocks within one group
    label = components(done).select(F.col("node").alias("k"), F.col("root").alias("label"))
    large = held.filter(F.col("blocks") > 1).select("node", "root", "n").join(label, F.col("node") == F.col("k"), "left").select(
        "node", "root", "n", F.coalesce("label", "node").alias("label"))
    counts = large.groupBy("root", "label").agg(blocks.alias("own"), F.count(F.lit(1)).alias("m"), F.sum("n").alias("size"))
    apart = counts.groupBy("root").agg(F.count(F.lit(1)).alias("groups"), F.ceil(F.greatest(
        F.sum(F.when(F.col("own") < 2, F.col("m"))) / MEMBERS, F.sum(F.when(F.col("own") < 2, F.col("size"))) / SHINGLES)).cast("long").alias("mixed"))
    apart = apart.filter("groups > 1").select(F.col("root").alias("r"), F.coalesce("mixed", F.lit(1)).alias("mixed"))
    counts = counts.select(F.col("root").alias("r2"), F.col("label").alias("l2"), "own")
    placed = large.join(apart, F.col("root") == F.col("r")).join(counts, (F.col("root") == F.col("r2")) & (F.col("label") == F.col("l2")))
    part = lambda of: F.pmod(F.xxhash64("node"), of).cast("string")
    alone = F.col("own") > 1
    placed = materialize(placed.select("node", "root", "label", F.when(alone, F.col("label")).alias("whole"), F.when(
        alone, F.concat(F.col("label").cast("string"), F.lit("."), part(F.col("own")))).otherwise(F.concat(F.lit("."), part(F.col("mixed")))).alias("place")))
    if placed.isEmpty():
        return done
    places = placed.select("root", "whole", "place").distinct()
    other = places.select(F.col("root").alias("r"), F.col("whole").alias("w"), F.col("place").alias("y"))
    meet = places.join(other, (F.col("root") == F.col("r")) & (F.col("place") <= F.col("y")) & ~F.coalesce(F.col("whole") == F.col("w"), F.lit(False)))
    unit = F.struct(F.col("r").alias("c"), F.col("place").alias("x"), F.col("y"))
    meet = meet.select(unit.alias("unit"), F.explode(F.array_distinct(F.array("place", "y"))).alias("at")).withColumn("rt", F.col("unit.c"))
    rows = placed.join(meet, (F.col("root") == F.col("rt")) & (F.col("place") == F.col("at"))).select("unit", F.col("node").alias("k"), "label")
    second = rows.join(member.select("node", "t"), F.col("k") == F.col("node")).select("unit", "node", "label", "t")
    return done.unionByName(materialize(exact_links(second)))


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, h, component, rep): every row with its group and the group's least struct of key and text hash."""
    found = materialize(nodes(docs, key, text))
    rep = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "h")))
    distinct = materialize(found.groupBy("node").agg(
        F.min(F.struct("h")).alias("rep"), rep.alias("least"), *[F.any_value(c).alias(c) for c in ("n", *[f"f{k}" for k in range(PARTS)])]))
    roots = components(candidates(tiles(distinct)))
    link = components(verified_links(docs, distinct, roots, text)).select(F.col("node").alias("k"), "root")
    rooted = materialize(distinct.join(link, F.col("node") == F.col("k"), "left").select("node", "least", F.coalesce("root", "node").alias("root")))
    least = rooted.groupBy("root").agg(F.min("least").alias("rep")).withColumnRenamed("root", "component")
    of_node = rooted.join(least, F.col("root") == F.col("component")).select(F.col("node").alias("k"), "component", "rep")
    return found.join(of_node, F.col("node") == F.col("k")).select("doc_id", "h", "component", "rep")


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of ``docs`` for each group of near copies, that of the least key and text hash; all columns kept.

    Rows without a key cannot stand for others and stay.
    """
    p = unused_prefix(docs)
    stay = groups(docs, key, text).select("rep").filter(F.col("rep").isNotNull()).distinct().select(F.col("rep.doc_id").alias(f"{p}key"), F.col("rep.h").alias(f"{p}stay"))
    first = docs.withColumn(f"{p}h", F.xxhash64(text_bytes(text))).join(
        stay, (F.col(key) == F.col(f"{p}key")) & (F.col(f"{p}h") == F.col(f"{p}stay")), "left_semi").dropDuplicates([key, f"{p}h"]).drop(f"{p}h")
    return first.unionByName(docs.filter(F.col(key).isNull()))
