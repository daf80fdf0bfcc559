"""A persistent match index: fingerprints of stored claims, in bucketed tables that only grow.

Appending a batch writes what the batch adds; nothing stored is rewritten. Matching moves
the incoming claims' probes to the buckets of the band table, then the near values to the buckets of the
frame table: the stored side of these joins is neither exploded nor shuffled. What concerns all claims
(the two smallest claims of each weight class, pattern and end class) is a few rows per batch.

A claim is appended once it is complete. Appending the same frames again, after a failure or by a replayed
batch, changes no answer: keys and frames are written before the row that marks their sequence as
known, and readers drop repeated rows.

Every append adds a file to each bucket it touches. Compaction writes a new version with one file a bucket, in
as many buckets as the history has come to need, without repeated rows and with two claims a key. A version takes effect
with its manifest; until then, and in queries planned before, the earlier one answers.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.similarity import hash_bits
from ..operators import matching as M
from ..operators.skew import two_smallest
from ..session import at_once, committed, materialize

KIND = ["kind"]
#: Columns of the tables, those that they are bucketed by, and the keys of which a table keeps the two smallest claims.
TABLES = {
    "bands": ("kind string, key bigint, bits bigint", ["kind", "key"], None),
    "frames": ("kind string, bits bigint, fp string, pos int, n int", ["kind", "bits"], None),
    "groups": ("kind string, fp string, c1 bigint, c2 bigint", ["kind", "fp"], ["kind", "fp"]),
    "contents": ("kind string, fp string, h_dark bigint, h_bright bigint, h_mask string", ["kind", "fp"], None),
    "mask_rows": ("kind string, h_mask string, h_mask_n int, pos int, tone int", ["kind", "h_mask"], None),
    "mask_claims": ("kind string, h_mask string, c1 bigint, c2 bigint", [], ["kind", "h_mask"]),
    "class_claims": ("kind string, class string, c1 bigint, c2 bigint", [], ["kind", "class"]),
    "end_claims": ("kind string, last boolean, tone int, c1 bigint, c2 bigint", [], ["kind", "last", "tone"]),
}
MANIFEST = "version int, folder string, buckets int"


def folded(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The two smallest claims per key of rows that name two each."""
    claims = rows.select(*keys, F.explode(F.array_compact(F.array("c1", "c2"))).alias("claim_id"))
    return two_smallest(claims, keys, "claim_id")


class MatchIndex:
    """The index in ``path``, a folder that all executors reach; it is created if there is none.

    ``buckets`` counts when the folder is new; later its manifest says how many there are. A bucket should fit
    a task's memory; ``compact`` changes their number. One writer appends or compacts at a time.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 1024, columns: tuple[str, ...] = M.HASH_COLUMNS):
        self.spark, self.path, self.columns, self.version = spark, path.rstrip("/"), columns, -1
        if not self._versions():
            self._commit(0, self.path, buckets)
        self.refresh()

    def _versions(self) -> list[int]:
        return sorted(int(f.rsplit("/", 1)[1]) for f in committed(self.spark, f"{self.path}/manifests/*"))

    def _commit(self, version: int, folder: str, buckets: int) -> None:
        row = self.spark.createDataFrame([(version, folder, buckets)], MANIFEST)
        row.coalesce(1).write.parquet(f"{self.path}/manifests/{version}")

    def refresh(self) -> None:
        """Turn to the latest version; appending and matching do so by themselves."""
        latest = self._versions()[-1]
        if latest != self.version:
            manifest = self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifests/{latest}").first()
            self.version, self.buckets = latest, manifest.buckets
            self.name = self._open(manifest.folder, manifest.buckets)

    def _open(self, folder: str, buckets: int) -> str:
        name = f"match_index_{hashlib.sha256(folder.encode()).hexdigest()[:16]}"
        for table, (ddl, keys, _) in TABLES.items():
            layout = f"CLUSTERED BY ({', '.join(keys)}) SORTED BY ({', '.join(keys)}) INTO {buckets} BUCKETS" if keys else ""
            self.spark.sql(f"CREATE TABLE IF NOT EXISTS {name}_{table} ({ddl}) USING parquet {layout} LOCATION '{folder}/{table}'")
            self.spark.catalog.refreshTable(f"{name}_{table}")
        return name

    def table(self, name: str) -> DataFrame:
        return self.spark.table(f"{self.name}_{name}")

    def _add(self, name: str, rows: DataFrame) -> None:
        self._insert(self.name, self.buckets, name, rows)

    def _insert(self, index: str, buckets: int, name: str, rows: DataFrame) -> None:
        ddl, keys, _ = TABLES[name]
        rows = rows.select(*[c.split()[0] for c in ddl.split(", ")])
        # one file per bucket and batch
        rows = rows.repartition(buckets, *keys) if keys else rows.coalesce(1)
        rows.write.insertInto(f"{index}_{name}")
        # rows may come from another session (a micro-batch has its own), which keeps its own list of files
        self.spark.catalog.refreshTable(f"{index}_{name}")

    def _dealt(self, rows: DataFrame, key: str) -> DataFrame:
        """Rows dealt out as the buckets are, so that joins leave the stored side where it is."""
        return rows.repartition(self.buckets, "kind", key)

    # ---- writing ----------------------------------------------------------------------
    def append(self, frames: DataFrame) -> None:
        """Add complete claims: ``claim_id, frame_index`` and hash columns."""
        self.refresh()
        columns = [c for c in self.columns if c in frames.columns]
        rows = materialize(M.positioned(M.hash_frames(frames, columns)).drop("side"))
        content = F.concat_ws(" ", *[F.col(c).cast("string") for c in M.CONTENT])
        member = M._contents(rows, KIND).select("kind", "claim_id", content.alias("fp"))
        groups = materialize(two_smallest(member, ["kind", "fp"], "claim_id"))
        rep = materialize(rows.join(M.merged(groups).select("kind", F.col("c1").alias("claim_id"), "fp"), ["kind", "claim_id"]).drop("claim_id"))
        tones, masks, new = at_once(self.spark, [
            lambda: materialize(M.tones_of(rep, ["kind", "fp"])), lambda: materialize(M.masks_of(rep, ["kind", "fp"])),
            lambda: materialize(groups.join(self.table("contents").select("kind", "fp"), ["kind", "fp"], "left_anti").select("kind", "fp"))])

        fresh = rep.join(M.merged(new), ["kind", "fp"]).where(F.col("bits").isNotNull())
        values = M.distinct_values(self._dealt(fresh, "bits"), KIND).join(self.table("frames").select("kind", "bits"), ["kind", "bits"], "left_anti")
        # the files of known values are listed before those of this batch are among them
        bands = materialize(values.select("kind", "bits", F.explode(M.band_keys(F.col("bits"))).alias("key")))
        known = self.table("mask_rows").select("kind", "h_mask")
        added = {"bands": bands, "frames": fresh, "groups": groups,
                 "mask_rows": M.mask_rows_of(rep, masks, KIND, "fp").join(known, ["kind", "h_mask"], "left_anti"),
                 "mask_claims": M.mask_claims_of(masks, groups, KIND, "fp"), "class_claims": M.class_claims_of(tones, groups, KIND, "fp"),
                 "end_claims": M.end_claims_of(rep, groups, KIND, "fp")}
        at_once(self.spark, [lambda n=n, r=r: self._add(n, r) for n, r in added.items()])
        self._add("contents", new.join(tones, ["kind", "fp"], "left").join(masks, ["kind", "fp"], "left"))

    def compact(self, buckets: int | None = None) -> None:
        """Rewrite all tables as a new version, in ``buckets`` buckets (as many as before if not given).

        One pass over every table. A compaction that fails leaves the version in effect as it is. Folders of earlier versions
        are not deleted; they may go once no query reads them.
        """
        self.refresh()
        buckets, folder = buckets or self.buckets, f"{self.path}/versions/{uuid.uuid4().hex}"
        name = self._open(folder, buckets)
        kept = {t: folded(self.table(t), keys) if keys else self.table(t).distinct() for t, (_, _, keys) in TABLES.items()}
        at_once(self.spark, [lambda t=t, r=r: self._insert(name, buckets, t, r) for t, r in kept.items()])
        self._commit(self.version + 1, folder, buckets)
        self.refresh()

    # ---- reading ----------------------------------------------------------------------
    def pairs(self, incoming: M.Prepared) -> DataFrame:
        """Near values that no weight class answers: ``kind, l_bits, r_bits``. Only probes move."""
        values = M.distinct_values(incoming.frames.where(F.col("side") == "incoming"), KIND)
        return M.pairs_of_keys(values, self.table("bands"), on=("kind",), classes=True).distinct()

    def touched(self, pairs: DataFrame) -> DataFrame:
        """Stored frames with a value in ``pairs``: ``kind, h_fp, pos, h_n, r_bits``. Only the values move."""
        values = self._dealt(pairs.select("kind", F.col("r_bits").alias("bits")), "bits").distinct()
        held = self.table("frames").join(M.merged(values), ["kind", "bits"], "left_semi")
        return held.select("kind", F.col("fp").alias("h_fp"), "pos", F.col("n").alias("h_n"), F.col("bits").alias("r_bits")).distinct()

    def sides(self, incoming: M.Prepared, columns: list[str] | tuple[str, ...]) -> list[M.Side]:
        """(incoming, stored side, value pairs) per hash type, for the rules."""
        def met() -> tuple[DataFrame, ...]:
            pairs = materialize(self.pairs(incoming))
            frames = materialize(self.touched(pairs))
            fps = self._dealt(frames.select("kind", F.col("h_fp").alias("fp")), "fp").distinct()
            of_touched = lambda name: self.table(name).join(M.merged(fps), ["kind", "fp"], "left_semi")
            return pairs, frames, *at_once(self.spark, [
                lambda: materialize(folded(of_touched("groups"), TABLES["groups"][2])),
                lambda: materialize(of_touched("contents").distinct().where("h_mask is not null"))])

        names = ["mask_claims", "class_claims", "end_claims"]
        (pairs, frames, groups, contents), rows, *few = at_once(self.spark, [
            met, lambda: materialize(self.table("mask_rows").distinct()),
            *[lambda n=n: materialize(folded(self.table(n), TABLES[n][2])) for n in names]])
        small = dict(zip(names, few))

        def stored(kind: str) -> M.Stored:
            of = lambda df: M.merged(df.where(F.col("kind") == kind).drop("kind"))
            held = of(contents).withColumnRenamed("fp", "h_fp")
            return M.Stored(of(frames), of(groups).withColumnRenamed("fp", "h_fp"), held.select("h_fp", "h_dark", "h_bright"),
                            held.select("h_fp", "h_mask"), of(rows), *[of(small[n]) for n in ("mask_claims", "class_claims", "end_claims")])

        return [(incoming.sequences(c, "incoming"), stored(c), M.merged(pairs.where(F.col("kind") == c).drop("kind"))) for c in columns]

    def rule_matches(self, frames: DataFrame, legacy: DataFrame | None = None) -> DataFrame:
        """``claim_id, rule_no, hist_claim`` of the hash rules for incoming claims, as :func:`matching.rule_matches`."""
        self.refresh()
        columns = [c for c in self.columns if c in frames.columns]
        fresh = M.prepare(M.hash_frames(frames, columns, "incoming"))
        sides = self.sides(fresh, columns)
        out = M.hash_rule_matches(sides)
        if legacy is not None:
            bare, seen = legacy.select("claim_id", hash_bits(F.trim("phash")).alias("bits")), sides[0][0].frames
            out = out.unionByName(M._stack({0: M.legacy_match(seen, bare, M.hamming_pairs(seen, bare, classes=True))}))
        return out
