"""Nearest neighbours by inner product from randomly rotated one-bit codes.

Each vector is centred, rotated and reduced to the signs of its coordinates, with two scalars: its
distance to the centre and the inner product of the rotated direction with its code. A query's
rotated coordinates become integers of a few bits, so inner products with codes are bit counts.
The estimate has an error bound; a vector is reranked with the exact inner product if its upper
bound reaches the query's k-th largest lower bound, so nothing is cut by a fixed candidate count.

Vectors are packed into blocks. Every query block meets every data block of its dimension; a task
takes a query block and a group of data blocks and keeps the best k of each query.

Defined results: rows without an id and vectors that are null, empty, zero or hold null or non-finite components take no
part; vectors of different lengths are not compared; repeated ids are candidates each on their own,
one of them (the least vector) is the query; ties go to the smaller id; fewer candidates than k give
fewer rows; an empty table gives none. Only id and vector are read, so other columns' names do not matter.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimspark.session import materialize


@dataclass(frozen=True)
class Settings:
    k: int = 20
    epsilon: float = 2.5  # the error bound in standard deviations of the estimate
    bits: int = 6  # of a query's coordinate
    data_block: int = 4096
    query_block: int = 1024
    group: int = 4  # data blocks a task takes, about
    rows: int = 128  # queries estimated at once
    seed: int = 11


def rotation(dim: int, seed: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed + dim).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def usable(vector: str) -> Column:
    v = F.col(vector).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(v) > 0) & ~bad & F.exists(v, lambda x: x != 0), F.lit(False))


def blocks(vectors: DataFrame, size: int, key: str, vector: str) -> DataFrame:
    """(block, dim, n, ids, vectors): rows packed as bytes, each block of one dimension."""
    def run(batches):
        held: dict[int, list] = {}
        for b in batches:
            lists = b.column(1)
            ends = np.asarray(lists.offsets)
            flat, dims = np.asarray(lists.values), np.diff(ends)
            ids = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for dim in np.unique(dims).tolist():
                some = np.flatnonzero(dims == dim)
                mine = held.setdefault(dim, [np.zeros(0, np.int64), np.zeros((0, dim))])
                mine[0] = np.concatenate([mine[0], ids[some]])
                mine[1] = np.concatenate([mine[1], flat[ends[some][:, None] + np.arange(dim)]])
                while len(mine[0]) >= size:
                    yield one(dim, mine[0][:size], mine[1][:size])
                    mine[0], mine[1] = mine[0][size:], mine[1][size:]
        for dim, (ids, x) in held.items():
            if len(ids):
                yield one(dim, ids, x)

    def one(dim, ids, x):
        return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([len(ids)], pa.int32()), pa.array([ids.tobytes()], pa.binary()),
                                           pa.array([np.ascontiguousarray(x).tobytes()], pa.binary())], names=["dim", "n", "ids", "vectors"])

    rows = vectors.filter(usable(vector) & F.col(key).isNotNull()).select(F.col(key).cast("long"), F.col(vector).cast("array<double>"))
    made = rows.mapInArrow(run, "dim int, n int, ids binary, vectors binary")
    return materialize(made.select(F.monotonically_increasing_id().alias("block"), "*"))


def centres(data: DataFrame) -> dict[int, np.ndarray]:
    """The mean of all vectors of each dimension; the driver gets one row a dimension and a block group."""
    def merge(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for dim, x in zip(b.column(0).to_pylist(), b.column(1)):
                total[dim] = total.get(dim, 0) + np.frombuffer(x.as_py())
        yield rows(total)

    def rows(total):
        return pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([t.tobytes() for t in total.values()], pa.binary())], names=["dim", "s"])

    def first(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for dim, x in zip(b.column(0).to_pylist(), b.column(1)):
                x = np.frombuffer(x.as_py()).reshape(-1, dim)
                total[dim] = total.get(dim, 0) + np.append(x.sum(axis=0), len(x))
        yield rows(total)

    sums = data.select("dim", "vectors").mapInArrow(first, "dim int, s binary").repartition(16).mapInArrow(merge, "dim int, s binary").repartition(1).mapInArrow(merge, "dim int, s binary")
    return {r.dim: np.frombuffer(r.s)[:-1] / np.frombuffer(r.s)[-1] for r in sums.collect()}


def encode(x: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed sign bits (rows of 64-bit words), distance to the centre, inner product of direction and code."""
    o = (x - centre) @ turn.T
    norm = np.linalg.norm(o, axis=1)
    o /= np.where(norm > 0, norm, 1)[:, None]
    bit = o > 0
    dim = x.shape[1]
    padded = np.zeros((len(x), -(-dim // 64) * 64), bool)
    padded[:, :dim] = bit
    return np.packbits(padded, axis=1, bitorder="little").view(np.uint64), norm, np.abs(o).sum(axis=1) / np.sqrt(dim)


def estimates(q: np.ndarray, codes: np.ndarray, norm: np.ndarray, fit: np.ndarray, centre: np.ndarray, turn: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Estimated inner products of queries and coded vectors, and the bound of each error."""
    dim = q.shape[1]
    r = q @ turn.T
    low = r.min(axis=1, keepdims=True)
    unit = np.maximum((r.max(axis=1, keepdims=True) - low) / (2**s.bits - 1), 1e-300)
    level = np.rint((r - low) / unit).astype(np.uint8)
    count = np.bitwise_count(codes).sum(axis=1, dtype=np.int32)
    total = np.zeros((len(q), len(codes)), np.float32)
    padded = np.zeros((len(q), codes.shape[1] * 64), np.uint8)
    for b in range(s.bits):
        padded[:, :dim] = level >> b & 1
        plane = np.packbits(padded, axis=1, bitorder="little").view(np.uint64)
        both = sum(np.bitwise_count(plane[:, w, None] & codes[None, :, w]).astype(np.uint16) for w in range(codes.shape[1]))
        total += both * np.float32(1 << b)
    ones = low * count + unit * total  # sum of the query's coordinates where the code has a one
    safe = np.where(fit > 0, fit, 1)
    about = (q @ centre)[:, None] + norm * (2 * ones - r.sum(axis=1, keepdims=True)) / (np.sqrt(dim) * safe)
    size = np.linalg.norm(q, axis=1)[:, None]
    spread = norm * np.sqrt(np.maximum(1 - fit**2, 0)) / safe / np.sqrt(max(dim - 1, 1))
    return about, s.epsilon * (size * spread + unit * norm / safe / np.sqrt(12)) + 1e-9 * (1 + np.abs(about))


def best(query: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Indices of each query's k best, nearest first, ties to the smaller id."""
    order = np.lexsort((ids, -score, query))
    q = query[order]
    start = np.flatnonzero(np.diff(q, prepend=-1))
    rank = np.arange(len(q)) - np.repeat(start, np.diff(np.append(start, len(q))))
    return order[rank < k]


def search(vectors: DataFrame, queries: DataFrame, s: Settings = Settings(), key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest of each query among the other rows."""
    data = blocks(vectors, s.data_block, key, vector)
    single = queries.filter(usable(vector)).groupBy(key).agg(F.min(vector).alias(vector))
    n = single.count()
    asked = blocks(single.repartition(max(1, -(-n // s.query_block)), key), s.query_block, key, vector)
    middle = centres(data)
    groups = max(1, data.count() // s.group)

    def run(batches):
        now, ids_q, held = None, None, None
        turns, coded = {}, None
        for b in batches:
            for q_block, group, dim, iq, vq, idd, vd in zip(*[b.column(k).to_pylist() for k in range(3)], *[b.column(k) for k in range(3, 7)]):
                if (q_block, group) != now:
                    if now is not None:
                        yield rows(ids_q, held)
                    now, held = (q_block, group), (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
                    ids_q, q = np.frombuffer(iq.as_py(), np.int64), np.frombuffer(vq.as_py()).reshape(-1, dim)
                    if dim not in turns:
                        turns[dim] = rotation(dim, s.seed)
                ids, x = np.frombuffer(idd.as_py(), np.int64), np.frombuffer(vd.as_py()).reshape(-1, dim)
                coded = encode(x, middle[dim], turns[dim])
                held = merge(held, ids_q, q, ids, x, coded, middle[dim], turns[dim])
        if now is not None:
            yield rows(ids_q, held)

    def merge(held, ids_q, q, ids, x, coded, centre, turn):
        found = [held]
        floor = np.full(len(q), -np.inf)  # each query's k-th best so far
        if len(held[0]):
            n = np.bincount(held[0], minlength=len(q))
            least = np.full(len(q), np.inf)
            np.minimum.at(least, held[0], held[2])
            floor[n >= s.k] = least[n >= s.k]
        for lo in range(0, len(q), s.rows):
            some = slice(lo, lo + s.rows)
            about, error = estimates(q[some], *coded, centre, turn, s)
            own = ids_q[some][:, None] == ids[None, :]
            low = np.where(own, -np.inf, about - error)
            limit = floor[some]
            if len(ids) > s.k:
                limit = np.maximum(limit, np.partition(low, len(ids) - s.k, axis=1)[:, len(ids) - s.k])
            i, j = np.nonzero((about + error >= limit[:, None]) & ~own)
            for at in range(0, len(i), 1 << 16):
                p, r = i[at : at + (1 << 16)] + lo, j[at : at + (1 << 16)]
                score = (q[p] * x[r]).sum(axis=1)
                top = best(p, ids[r], score, s.k)
                found.append((p[top], ids[r][top], score[top]))
        query, ids, score = (np.concatenate([f[k] for f in found]) for k in range(3))
        top = best(query, ids, score, s.k)
        return query[top], ids[top], score[top]

    def rows(ids_q, held):
        return pa.RecordBatch.from_arrays([pa.array(ids_q[held[0]], pa.int64()), pa.array(held[1], pa.int64()), pa.array(held[2], pa.float64())], names=["query_id", "vec_id", "score"])

    # blocks of one dimension meet by their numbers alone; the bytes are joined afterwards
    d = data.select(F.col("block").alias("d"), "dim", F.pmod(F.xxhash64("block"), F.lit(groups)).alias("g"))
    pairs = asked.select(F.col("block").alias("q"), "dim").join(d, "dim").select("q", "d", "g", "dim")
    full = pairs.join(asked.select(F.col("block").alias("qb"), F.col("ids").alias("iq"), F.col("vectors").alias("vq")), F.col("q") == F.col("qb"))
    full = full.join(data.select(F.col("block").alias("db"), F.col("ids").alias("id"), F.col("vectors").alias("vd")), F.col("d") == F.col("db"))
    dealt = full.select("q", "g", "dim", "iq", "vq", "id", "vd").repartition("q", "g").sortWithinPartitions("q", "g")
    near = dealt.mapInArrow(run, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return near.withColumn("rank", rank).filter(F.col("rank") <= s.k).select("query_id", "rank", "vec_id", "score")
