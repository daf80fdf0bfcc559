"""Centroid clustering with an equal-average, equal-variance search and exact integer arithmetic.

Components are scaled and floored to integers. The centroids are sorted by the sum of their
components; a vector scans outward from its own sum, nearest sum first. With d components, sums
S and deviations V (root of the summed squared differences from the mean), the squared distance is
at least (S - S')^2 / d + (V - V')^2. The first term alone ends a vector's scan, since later
centroids differ by more; both together reject one centroid; what is left gets its exact distance
in integers. Both tests leave room for rounding, so they never reject a nearest centroid.

A round is one pass over the table: tasks assign their rows and send a count and a sum for each
centroid, Spark adds these up, and the driver holds the centroids alone (k times d integers).

Defined results: vectors of another length, null vectors and vectors with null or non-finite components
take no part, nor do those with a scaled component of 2**27 or more in magnitude, whose distances a
long cannot hold. A null id is kept, hashes last. Repeated ids are vectors each on their own; among
starts of one id the smaller vector comes first. Fewer vectors than centroids give fewer centroids, an empty
table gives no rows. Distances that tie go to the smaller centroid number. Only id and vector are read,
so other columns' names do not matter.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimspark.session import materialize

LIMIT = float(2**27)


@dataclass(frozen=True)
class Settings:
    k: int = 16
    rounds: int = 3
    dim: int = 64
    scale: int = 64
    seed: str = "1"


class Search:
    """Nearest of a fixed set of integer centroids."""

    def __init__(self, centres: np.ndarray):
        order = np.argsort(centres.sum(axis=1), kind="stable")
        self.centres, self.number = centres[order], order
        self.sums = self.centres.sum(axis=1)
        self.spread = deviation(self.centres, self.sums)
        self.exact = 0  # distances computed, for measurement

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(centroid number, squared distance) of each row."""
        sums, k, dim = x.sum(axis=1), len(self.centres), x.shape[1]
        spread = deviation(x, sums)
        best, number = np.full(len(x), np.iinfo(np.int64).max), np.full(len(x), k)
        up = np.searchsorted(self.sums, sums)
        down = up - 1
        rows = np.arange(len(x))
        far = np.int64(2) ** 62
        while len(rows):
            above = np.where(up[rows] < k, self.sums[np.minimum(up[rows], k - 1)] - sums[rows], far)
            below = np.where(down[rows] >= 0, sums[rows] - self.sums[np.maximum(down[rows], 0)], far)
            gap, rise = np.minimum(above, below), above <= below
            floor = gap.astype(np.float64) ** 2 / dim
            on = (gap < far) & (floor * (1 - 1e-9) <= best[rows])
            rows, rise, floor = rows[on], rise[on], floor[on]
            at = np.where(rise, up[rows], down[rows])
            up[rows[rise]] += 1
            down[rows[~rise]] -= 1
            wide = np.abs(spread[rows] - self.spread[at]) - 1e-9 * (spread[rows] + self.spread[at])
            near = (floor + np.maximum(wide, 0) ** 2) * (1 - 1e-9) <= best[rows]
            r, c = rows[near], at[near]
            self.exact += len(r)
            d = ((x[r] - self.centres[c]) ** 2).sum(axis=1)
            better = (d < best[r]) | (d == best[r]) & (self.number[c] < number[r])
            best[r[better]], number[r[better]] = d[better], self.number[c[better]]
        return number, best


def deviation(x: np.ndarray, sums: np.ndarray) -> np.ndarray:
    return np.sqrt(((x - sums[:, None] / x.shape[1]) ** 2).sum(axis=1))


def integers(values: np.ndarray, scale: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.floor(values * scale)


def usable(vectors: DataFrame, s: Settings, key: str, vector: str) -> DataFrame:
    """(key, vector of doubles) of the rows that take part."""
    v = F.col(vector).cast("array<double>")
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (x * s.scale >= -LIMIT) & (x * s.scale < LIMIT))
    return vectors.select(F.col(key), v.alias(vector)).filter((F.size(vector) == s.dim) & F.coalesce(good, F.lit(False)))


def starts(rows: DataFrame, s: Settings, key: str, vector: str) -> np.ndarray:
    """The integer vectors with the least hashes; at most ``k`` rows reach the driver."""
    whole = F.transform(vector, lambda x: F.floor(x * s.scale))
    mark = F.sha2(F.concat(F.lit(f"{s.seed}:"), F.col(key).cast("string")).cast("binary"), 256)
    first = rows.select(mark.alias("mark"), whole.alias("v")).orderBy(F.asc_nulls_last("mark"), "v").limit(s.k).collect()
    return np.array([r.v for r in first], np.int64).reshape(-1, s.dim)


def matrix(batch: pa.RecordBatch, s: Settings) -> np.ndarray:
    """The vectors of a batch as integers."""
    return integers(batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, s.dim), s.scale).astype(np.int64)


def moved(rows: DataFrame, centres: np.ndarray, s: Settings) -> np.ndarray:
    """Every centroid with vectors becomes the floor of their mean."""
    def run(batches):
        search = Search(centres)
        n, total = np.zeros(len(centres), np.int64), np.zeros(centres.shape, np.int64)
        for b in batches:
            x = matrix(b, s)
            number, _ = search.nearest(x)
            n += np.bincount(number, minlength=len(n))
            for c in np.unique(number):
                total[c] += x[number == c].sum(axis=0)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(n[some]), pa.array(total[some].tolist(), pa.list_(pa.int64()))],
                                         names=["c", "n", "total"])

    parts = rows.mapInArrow(run, "c int, n long, total array<long>")
    sums = parts.groupBy("c").agg(F.sum("n").alias("n"), *[F.sum(F.get("total", F.lit(i))).alias(f"s{i}") for i in range(s.dim)])
    out = centres.copy()
    for r in sums.collect():
        out[r.c] = [t // r.n for t in r[2:]]
    return out


def cluster(vectors: DataFrame, s: Settings = Settings(), key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every usable vector."""
    rows = usable(vectors, s, key, vector)
    centres = starts(rows, s, key, vector)
    for _ in range(s.rounds if len(centres) else 0):
        centres = moved(rows, centres, s)

    def run(batches):
        search = Search(centres)
        for b in batches:
            number, distance = search.nearest(matrix(b, s))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(number, pa.int32()), pa.array(distance)], names=["key", "cluster", "distance"])

    kind = rows.schema[key].dataType.simpleString()
    dealt = materialize(rows.mapInArrow(run, f"key {kind}, cluster int, distance long")) if len(centres) else \
        rows.select(F.col(key).alias("key"), F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"))
    inertia = {r.cluster: r.d for r in dealt.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}
    marks = [(c, inertia[c], sum(inertia.values()), hashlib.sha256(",".join(map(str, centres[c])).encode()).hexdigest()) for c in sorted(inertia)]
    facts = vectors.sparkSession.createDataFrame(marks, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    # one row a centroid: k rows at most
    return dealt.join(F.broadcast(facts), "cluster").select(
        F.col("key").alias(key), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
