"""WARC archives: writing pages as segmented records, and putting the segments together again.

Writing gives each page an HTTP response whose body is chunked. Pages with equal payloads share one
response, that of the largest key; the others become revisits that refer to it. A block
longer than a segment is split: a first record and continuations that name it by identifier, carry
their segment number and, on the last, the total length. Records are gzip members; tasks pack them
into archives that Spark's text writer stores, one archive a file, with a zero byte (padding
to gzip readers) as line end. Any folder that Spark can write to will do.

Reading undoes this: whole records are decoded where they are read, so only segments carry bytes through the
shuffle. Segments are dealt out by the identifier of their first record, sorted by number, and stream through
a decoder that holds one chunk, whatever the length of the record. Numbers without a gap, the total length and
digests are verified; ``problem`` says what failed, null if nothing did. Revisits then take length and
digest from the response they refer to.

Defined results: a null payload is empty; a null key is smaller than any other, is written without a key and read as null;
rows repeated with the largest key of their payload are all responses; segments that come more than once
are used once and give as many rows; a null or odd url is left out or percent-encoded; an empty table
gives no rows. Only key, url and payload are read, so other columns' names do not matter.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import urllib.parse
import zlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimspark.session import materialize, new_dir

from .common import text_bytes


@dataclass(frozen=True)
class Settings:
    segment_bytes: int = 16 << 10
    chunk_bytes: int = 4 << 10
    archive_bytes: int = 16 << 20
    least_bytes: int = 0  # shorter payloads are never revisits
    level: int = 1
    date: str = "2024-01-01T00:00:00Z"
    salts: int = 16


# Fixed values of the format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CHUNKED = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
BARE = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def sha1_base32(data) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


# ---- writing ------------------------------------------------------------------------------
def planned(pages: DataFrame, s: Settings, key: str, url: str, text: str) -> DataFrame:
    """(id, key, url, payload, refers_to): the records to write. Revisits have no payload.

    Which rows are revisits follows from digests alone; payloads meet them by the record identifier, not
    by the payload, so a third of all rows with one payload is dealt out evenly.
    """
    rows = pages.select(F.col(key).alias("key"), F.col(url).cast("string").alias("url"), text_bytes(text).alias("payload"))
    mark = F.sha2("payload", 256)
    hexed = F.sha2(F.to_json(F.struct(F.col("key").cast("string"), "url", mark.alias("mark"))).cast("binary"), 256)
    cuts = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    rows = rows.withColumn("id", F.concat(F.lit("urn:uuid:"), F.concat_ws("-", *[F.substring(hexed, a, n) for a, n in cuts])))
    narrow = rows.filter(F.length("payload") >= s.least_bytes).select("id", "key", "url", mark.alias("mark"))
    groups = narrow.groupBy("mark").agg(F.max(F.struct("key", "url", "id")).alias("top"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    each = F.explode(F.sequence(F.lit(0), F.lit(s.salts - 1))).alias("salt")
    later = narrow.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(s.salts)).cast("int")).join(groups.select("mark", "top", each), ["mark", "salt"])
    later = materialize(later.filter(~F.col("key").eqNullSafe(F.col("top.key"))).select("id", "key", "url", F.col("top.id").alias("refers_to"), "mark"))
    first = rows.join(later.select("id"), "id", "left_anti").select("id", "key", "url", "payload", F.lit(None).cast("string").alias("refers_to"))
    return first.unionByName(later.select("id", "key", "url", F.lit(None).cast("binary").alias("payload"), "refers_to"))


def record(kind: str, ident: str, block: bytes, s: Settings, **fields: str) -> bytes:
    """One record as a gzip member."""
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: <{ident}>", f"WARC-Date: {s.date}", f"WARC-Block-Digest: sha1:{sha1_base32(block)}",
            "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    head += [f"{name.replace('_', '-')}: {value}" for name, value in fields.items() if value is not None]
    z = zlib.compressobj(s.level, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(["WARC/1.1", *head, "", ""]).encode()) + z.compress(block) + z.compress(b"\r\n\r\n") + z.flush()


def page_records(ident: str, key: str | None, url: str | None, payload: bytes | None, refers_to: str | None, s: Settings):
    """The records of one page: a revisit, a response, or a response and its continuations."""
    same = {"WARC_Target_URI": None if url is None else urllib.parse.quote(url, safe=":/?#[]@!$&'()*+,;=%-._~"),
            "Page_Key": None if key is None else urllib.parse.quote(key, safe="")}
    if refers_to is not None:
        yield record("revisit", ident, BARE, s, **same, WARC_Refers_To=f"<{refers_to}>", WARC_Profile=PROFILE)
        return
    body = [CHUNKED]
    for lo in range(0, len(payload), s.chunk_bytes):
        part = payload[lo : lo + s.chunk_bytes]
        body += [b"%x\r\n" % len(part), part, b"\r\n"]
    block = b"".join([*body, b"0\r\n\r\n"])
    same["WARC_Payload_Digest"] = f"sha1:{sha1_base32(payload)}"
    if len(block) <= s.segment_bytes:
        yield record("response", ident, block, s, **same)
        return
    parts = [block[lo : lo + s.segment_bytes] for lo in range(0, len(block), s.segment_bytes)]
    yield record("response", ident, parts[0], s, **same, WARC_Segment_Number="1")
    for n, part in enumerate(parts[1:], 2):
        last = {"WARC_Segment_Total_Length": str(len(block))} if n == len(parts) else {}
        yield record("continuation", f"{ident}.{n}", part, s, WARC_Segment_Origin_ID=f"<{ident}>", WARC_Segment_Number=str(n), **last)


def write(pages: DataFrame, path: str, s: Settings = Settings(), key: str = "page_id", url: str = "url", text: str = "html") -> None:
    """Write the archives of ``pages`` to a new folder."""
    def run(batches):
        held, size = [], 0
        for b in batches:
            for row in zip(*(b.column(k) for k in range(5))):
                for member in page_records(*(v.as_py() for v in row), s):
                    held.append(member)
                    size += len(member)
                    if size >= s.archive_bytes:
                        yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], names=["archive"])
                        held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], names=["archive"])

    rows = planned(pages, s, key, url, text).withColumn("key", F.col("key").cast("string"))
    packed = rows.select("id", "key", "url", "payload", "refers_to").mapInArrow(run, "archive binary")
    packed.select(F.col("archive").cast("string")).write.option("lineSep", "\0").option("maxRecordsPerFile", 1).text(path)


# ---- reading ------------------------------------------------------------------------------
def warc_records(raw: bytes):
    """(fields, block) of every record of one archive."""
    with gzip.GzipFile(fileobj=io.BytesIO(raw)) as members:
        data = io.BufferedReader(members, 1 << 16)
        while version := data.readline():
            if not version.startswith(b"WARC/"):
                raise ValueError(f"no WARC record: {version[:40]!r}")
            fields = {}
            while (line := data.readline()) not in (b"\r\n", b""):
                name, _, value = line.decode().partition(":")
                fields[name.strip().lower()] = value.strip()
            block = data.read(int(fields["content-length"]))
            if data.read(4) != b"\r\n\r\n":
                raise ValueError("a record ends early")
            yield fields, block


class HttpBody:
    """Decodes a response that comes in pieces; holds what is left of a head or a chunk's size line only."""

    def __init__(self, keep: bool):
        self.rest, self.state, self.left, self.total = bytearray(), "head", 0, 0
        self.n, self.sha, self.kept, self.problem = 0, hashlib.sha1(), [] if keep else None, None

    def take(self, part: bytes) -> None:
        self.n += len(part)
        self.sha.update(part)
        if self.kept is not None:
            self.kept.append(bytes(part))

    def line(self, at: int, end: bytes = b"\r\n") -> tuple[bytes, int] | None:
        stop = self.rest.find(end, at)
        return None if stop < 0 else (bytes(self.rest[at:stop]), stop + len(end))

    def feed(self, data: bytes) -> None:
        self.total += len(data)
        self.rest += data
        at, size = 0, len(self.rest)
        while self.problem is None:
            if self.state in ("data", "raw"):
                part = self.rest[at : at + self.left] if self.state == "data" else self.rest[at:]
                self.take(part)
                at, self.left = at + len(part), self.left - len(part)
                if self.state == "raw" or self.left:
                    break
                self.state = "end"
            found = self.line(at, b"\r\n\r\n" if self.state == "head" else b"\r\n")
            if self.state == "done" and at < size:
                self.problem = "bytes after the last chunk"
            if found is None:
                break
            (text, at), state = found, self.state
            if state == "head":
                self.state = "size" if b"\r\ntransfer-encoding: chunked" in text.lower() else "raw"
            elif state == "end":
                self.state, self.problem = "size", "a chunk is longer than its size" if text else None
            elif state == "size":
                try:
                    self.left = int(text.split(b";")[0], 16)
                    self.state = "data" if self.left else "trailer"
                except ValueError:
                    self.problem = "no chunk size"
            elif state == "trailer" and not text:
                self.state = "done"
        del self.rest[:at]

    def finish(self, expected: str | None) -> tuple[int, str, bytes | None, str | None]:
        """(bytes, digest, payload, problem)."""
        digest = base64.b32encode(self.sha.digest()).decode()
        if self.state not in ("done", "raw"):
            self.problem = self.problem or "the body ends early"
        if expected is not None and expected != digest:
            self.problem = self.problem or "payload digest differs"
        return self.n, digest, b"".join(self.kept) if self.kept is not None else None, self.problem


PIECES = ("id string, type string, key string, url string, refers_to string, digest string, segment int, total long, mark string, "
          "block binary, bytes long, payload binary, problem string")
RECORDS = "id string, type string, key string, url string, refers_to string, digest string, bytes long, payload binary, segments int, problem string"


def batch_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def arrow(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in ddl.split(", "))])


def pieces(spark: SparkSession, path: str, payload: bool = False) -> DataFrame:
    """Records as read: whole ones decoded (segment 0), segments with their block."""
    schema = arrow(PIECES)

    def piece(fields: dict, block: bytes) -> tuple:
        urn = lambda name: fields[name].strip("<>") if name in fields else None
        text = lambda name: urllib.parse.unquote(fields[name]) if name in fields else None
        stated = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
        mark, number = sha1_base32(block), int(fields.get("warc-segment-number", 0))
        wrong = "block digest differs" if fields.get("warc-block-digest", f"sha1:{mark}") != f"sha1:{mark}" else None
        head = (urn("warc-segment-origin-id") or urn("warc-record-id"), fields["warc-type"], text("page-key"), text("warc-target-uri"), urn("warc-refers-to"))
        if number:
            return (*head, stated, number, int(fields["warc-segment-total-length"]) if "warc-segment-total-length" in fields else None, mark, block, None, None, wrong)
        body = HttpBody(payload)
        body.feed(block)
        n, digest, kept, problem = body.finish(stated)
        return (*head, digest, 0, None, None, None, n, kept, wrong or problem)

    def run(batches):
        held, size = [], 0
        for b in batches:
            for raw in b.column(0):
                for fields, block in warc_records(raw.as_py()):
                    held.append(piece(fields, block))
                    size += len(block) + 500
                    if size >= 4 << 20:
                        yield batch_of(held, schema)
                        held, size = [], 0
        if held:
            yield batch_of(held, schema)

    files = spark.read.format("binaryFile").load(path).filter(F.col("length") > 0)
    return files.select("content").mapInArrow(run, PIECES)


def reassembled(parts: DataFrame, payload: bool = False) -> DataFrame:
    """One row a record (:data:`RECORDS`): segments in order of their numbers, verified and decoded."""
    schema = arrow(RECORDS)

    class Joined:
        """A record whose segments arrive in order; copies of a segment arrive one after the other."""

        def __init__(self, row: tuple):
            self.first, self.body, self.at, self.total, self.mark = row, HttpBody(payload), 0, None, None
            self.copies, self.stated = [0], None
            self.problem = None if row[6] == 1 else "the first segment is missing"

        def add(self, row: tuple) -> None:
            _, _, _, _, _, stated, number, total, mark, block, _, _, problem = row
            self.problem = self.problem or problem
            if number == self.at:
                self.copies[-1] += 1
                if mark != self.mark:
                    self.problem = self.problem or "copies of a segment differ"
                return
            if number != self.at + 1:
                self.problem = self.problem or "a segment is missing"
            self.at, self.mark, self.stated = number, mark, self.stated or stated
            self.total = total if total is not None else self.total
            self.copies.append(1)
            self.body.feed(block)

        def rows(self) -> list[tuple]:
            if self.total != self.body.total:
                self.problem = self.problem or ("the last segment is missing" if self.total is None else "total length differs")
            n, digest, kept, problem = self.body.finish(self.stated)
            if len(set(self.copies[1:])) > 1:
                self.problem = self.problem or "some segments come more often than others"
            return [(*self.first[:5], digest, n, kept, self.at, self.problem or problem)] * self.copies[1]

    def run(batches):
        now, held, size = None, [], 0
        for b in batches:
            for row in zip(*(b.column(k) for k in range(b.num_columns))):
                row = tuple(v.as_py() for v in row)
                if now is not None and (row[0] != now.first[0] or not row[6]):
                    held += now.rows()
                    now = None
                if row[6]:
                    now = now or Joined(row)
                    now.add(row)
                else:
                    held.append((*row[:6], row[10], row[11], 1, row[12]))
                size += 500 + len(held[-1][7] or b"" if held else b"")
                if size >= 4 << 20 and held:
                    yield batch_of(held, schema)
                    held, size = [], 0
        if now is not None:
            held += now.rows()
        if held:
            yield batch_of(held, schema)

    # a whole record carries no block, so this moves the segments and a few words for each other record
    return parts.repartition("id").sortWithinPartitions("id", "segment").mapInArrow(run, RECORDS)


def resolved(records: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Revisits take length and digest from their response, whose key is ``refers_to``."""
    revisits, others = records.filter("type = 'revisit'"), records.filter("type <> 'revisit'")
    wanted = revisits.select(F.col("refers_to").alias("id")).distinct()
    target = others.join(wanted, "id", "left_semi").groupBy("id").agg(F.min(F.struct("key", "bytes", "digest", "payload")).alias("t"))
    each = F.explode(F.sequence(F.lit(0), F.lit(s.salts - 1))).alias("_salt")
    salted = revisits.withColumn("_salt", F.pmod(F.xxhash64("id"), F.lit(s.salts)).cast("int"))
    met = salted.join(target.select(F.col("id").alias("refers_to"), "t", each), ["refers_to", "_salt"], "left")
    problem = F.coalesce("problem", F.when(F.col("t").isNull(), "the response is missing"))
    same = ["id", "type", F.col("key"), "url"]
    return others.select(*same, F.lit(None).cast("string").alias("refers_to"), "bytes", "digest", "payload", "segments", "problem").unionByName(
        met.select(*same, F.col("t.key").alias("refers_to"), F.col("t.bytes").alias("bytes"), F.col("t.digest").alias("digest"),
                   F.col("t.payload").alias("payload"), "segments", problem.alias("problem")))


def read(spark: SparkSession, path: str, s: Settings = Settings(), payload: bool = False) -> DataFrame:
    """(id, type, key, url, refers_to, bytes, digest, payload, segments, problem) of every record of a folder.

    Keys are texts as written; ``payload`` is null unless asked for.
    """
    return resolved(materialize(reassembled(pieces(spark, path, payload), payload)), s)


def round_trip(pages: DataFrame, s: Settings = Settings(), payload: bool = False, key: str = "page_id", url: str = "url", text: str = "html") -> DataFrame:
    """Write ``pages`` and read them back, with keys of their own type."""
    path, kind = new_dir(pages.sparkSession, "warc"), pages.schema[key].dataType
    write(pages, path, s, key, url, text)
    return read(pages.sparkSession, path, s, payload).withColumns({c: F.col(c).cast(kind) for c in ("key", "refers_to")})
