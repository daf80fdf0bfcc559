"""Substring de-duplication by grouping equal windows of words; no suffix trees are built.

A window is ``window`` consecutive words of one document; a word goes if a window that covers it
also starts in a document with a smaller key. The windows that matter are found and dealt out by hashes:

1. Of each window only the anchor is kept, its ``anchor``-word gram with the least hash;
   equal windows have equal anchors. Grams that occur once in the corpus are dropped. A task first
   joins its own repeats, so a gram that a third of all documents share is sent once a chunk.
2. The suffixes at the other anchors, with the words of their windows, are dealt out by the gram,
   and those of very frequent grams by the whole window, so that a group fits in memory. A chunk
   settles windows that it holds several times and sends on those of its smallest document.
3. Each group's windows are sorted by a hash of all their words and compared word by word with their
   neighbours. A run of equal windows is what a suffix tree's nodes of depth ``window`` or more would
   hold, the occurrences of a repeat; longer common prefixes are not counted.

Words are compared by 64-bit hashes. Defined results: a null text has no words; texts of fewer
words than a window keep all; a null key counts as larger than all others; repeated rows (same
key, same text) are removed alike and rows with one key do not remove each other's words; an empty
table gives no rows. Only key and text are read, so other columns' names do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimspark.session import materialize

from .common import PRIME, U64, mix, text_bytes, word_bounds, word_hashes


@dataclass(frozen=True)
class Settings:
    window: int = 13
    anchor: int = 7
    chunk: int = 400_000  # anchors a task holds before it passes them on
    suffixes: int = 100_000  # suffixes a task holds likewise
    bucket_grams: int = 500_000  # grams of the whole corpus in a bucket, about
    group_suffixes: int = 150_000  # anchors of the whole corpus in a group, about
    hot: int = 20_000  # a gram that occurs more often is dealt out by whole windows
    most_hot: int = 500_000  # the most frequent of these; the rest go by the gram
    offsets: int = 16  # over window - anchor; packs an anchor's range of windows


def powers(n: int) -> np.ndarray:
    return np.array([pow(PRIME, k + 1, 2**64) for k in range(n)], dtype=U64)


def rolling(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of every ``n`` consecutive words."""
    m = len(hashes) - n + 1
    out = np.zeros(m, dtype=U64)
    for k, p in enumerate(powers(n)):
        out += hashes[k : k + m] * p
    return mix(out)


def anchors(hashes: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Gram, place, first and last window start of each anchor."""
    none = np.zeros(0, np.int64)
    m = len(hashes) - s.window + 1
    if m < 1:
        return none.astype(U64), none, none, none
    gram = rolling(hashes, s.anchor)
    best, place = gram[:m].copy(), np.arange(m)
    for k in range(1, s.window - s.anchor + 1):
        other = gram[k : k + m]
        less = other < best
        best[less] = other[less]
        place[less] = np.flatnonzero(less) + k
    first = np.flatnonzero(np.diff(place, prepend=-1))
    last = np.append(first[1:], m) - 1
    return gram[place[first]], place[first], first, last


def _planes(x: np.ndarray) -> bytes:
    """Bytes of equal weight side by side, which the shuffle's compression shrinks."""
    return np.ascontiguousarray(x.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes()


def _unplanes(raw: bytes, n: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, n).T).view("<i8").ravel()


def _pack(*columns: np.ndarray) -> bytes:
    """int64 columns of one length; differences of sorted columns are small."""
    n = len(columns[0])
    return np.int64(n).tobytes() + b"".join(_planes(np.diff(c, prepend=0)) for c in columns)


def _unpack(raw: bytes, columns: int) -> list[np.ndarray]:
    n = int(np.frombuffer(raw[:8], np.int64)[0])
    return [np.cumsum(_unplanes(raw[8 + 8 * n * k : 8 + 8 * n * (k + 1)], n)) for k in range(columns)]


def _by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, dict[str, list]]]:
    """(part, columns as lists) from batches sorted by their first column."""
    part, held = None, None
    for b in batches:
        columns = [c.to_pylist() for c in b.columns]
        for row in zip(*columns):
            if row[0] != part:
                if part is not None:
                    yield part, held
                part, held = row[0], []
            held.append(row[1:])
    if part is not None:
        yield part, held


def _slices(keys: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(key, from, to) of the runs of a sorted array."""
    cuts = np.flatnonzero(np.diff(keys, prepend=keys[0] - 1 if len(keys) else 0))
    for lo, hi in zip(cuts, [*cuts[1:], len(keys)]):
        yield int(keys[lo]), int(lo), int(hi)


def repeated_anchors(source: DataFrame, buckets: int, s: Settings) -> DataFrame:
    """(key, at): packed anchors whose gram occurs again; rows with a null ``at`` name very frequent grams."""
    def gather(batches):
        grams, keys, ats, have = [], [], [], 0
        for b in batches:
            for key, text in zip(b.column(0).to_pylist(), b.column(1)):
                g, place, first, last = anchors(word_hashes(text.as_py()), s)
                if len(g):
                    grams.append(g)
                    keys.append(np.full(len(g), key))
                    ats.append((place * s.offsets + (place - first)) * s.offsets + (place - last))
                    have += len(g)
                if have >= s.chunk:
                    yield send(np.concatenate(grams), np.concatenate(keys), np.concatenate(ats))
                    grams, keys, ats, have = [], [], [], 0
        if have:
            yield send(np.concatenate(grams), np.concatenate(keys), np.concatenate(ats))

    def send(gram, key, at):
        order = np.argsort(gram, kind="stable")
        starts = np.flatnonzero(np.diff(gram[order], prepend=gram[order][0] + U64(1)))
        times = np.diff(np.append(starts, len(order)))
        lead = order[starts]  # one of each gram goes to its bucket, the others are known to repeat
        other = np.ones(len(gram), bool)
        other[lead] = False
        bucket = (gram[lead] % U64(buckets)).astype(np.int64)
        by = np.lexsort((key[lead], bucket))
        lead, times, bucket = lead[by], times[by], bucket[by]
        parts, blobs, kinds = [], [], []
        for k, lo, hi in _slices(bucket):
            some = lead[lo:hi]
            parts.append(k)
            kinds.append(0)
            blobs.append(gram[some].tobytes() + _pack(key[some], at[some], times[lo:hi]))
        if other.any():
            parts.append(int(gram[0] % U64(buckets)))
            kinds.append(1)
            blobs.append(_pack(key[other], at[other]))
        return pa.RecordBatch.from_arrays([pa.array(parts, pa.int64()), pa.array(kinds, pa.int32()), pa.array(blobs, pa.binary())], names=["part", "kind", "blob"])

    def join(batches):
        for _, rows in _by_part(batches):
            grams, keys, ats, times = [np.zeros(0, U64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for kind, blob in rows:
                if kind:
                    yield found(*_unpack(blob, 2))
                    continue
                # the grams take 8 of the 32 bytes of an entry, after them the packed length
                n = (len(blob) - 8) // 32
                grams.append(np.frombuffer(blob[: 8 * n], U64))
                for held, c in zip((keys, ats, times), _unpack(blob[8 * n :], 3)):
                    held.append(c)
            gram, key, at, n = (np.concatenate(x) for x in (grams, keys, ats, times))
            if not len(gram):
                continue
            order = np.argsort(gram, kind="stable")
            starts = np.flatnonzero(np.diff(gram[order], prepend=gram[order][0] + U64(1)))
            total = np.add.reduceat(n[order], starts)
            again = np.repeat(total > 1, np.diff(np.append(starts, len(order))))
            yield found(key[order][again], at[order][again])
            hot = starts[total > s.hot]
            if len(hot):
                yield pa.RecordBatch.from_arrays([pa.array(gram[order][hot].view(np.int64)), pa.nulls(len(hot), pa.int64()), pa.array(total[total > s.hot], pa.int64())], names=["key", "at", "n"])

    def found(key, at):
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(at), pa.nulls(len(key), pa.int64())], names=["key", "at", "n"])

    sent = source.select("key", "t").mapInArrow(gather, "part long, kind int, blob binary")
    return sent.repartition("part").sortWithinPartitions("part").mapInArrow(join, "key long, at long, n long")


def settle(hashes: np.ndarray, start: np.ndarray, key: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """For suffixes that begin at ``start`` of an array of words: whether a smaller key has the window, and the node of each.

    The windows are sorted by a hash of their words; runs whose neighbours share a window are a node.
    """
    value = np.zeros(len(start), dtype=U64)
    for k, p in enumerate(powers(s.window)):
        value += hashes[start + k] * p
    order = np.argsort(value, kind="stable")
    at = start[order]
    deep = np.zeros(len(at), bool)  # shares a window with the one before
    deep[1:] = value[order][1:] == value[order][:-1]
    run = np.flatnonzero(deep)
    for k in range(s.window):
        run = run[hashes[at[run] + k] == hashes[at[run - 1] + k]]
    deep[:] = False
    deep[run] = True
    nodes = np.flatnonzero(~deep)
    least = np.repeat(np.minimum.reduceat(key[order], nodes), np.diff(np.append(nodes, len(at)))) if len(at) else key
    smaller = np.zeros(len(at), bool)
    smaller[order] = least < key[order]
    return smaller, order


def _removed(key, version, start) -> pa.RecordBatch:
    """Rows (key, version, starts) from arrays in any order."""
    order = np.lexsort((start, version, key))
    key, version, start = key[order], version[order], start[order]
    cuts = np.flatnonzero((np.diff(key, prepend=key[0] - 1 if len(key) else 0) != 0) | (np.diff(version, prepend=version[0] if len(key) else 0) != 0)) if len(key) else np.zeros(0, int)
    lists = pa.ListArray.from_arrays(pa.array(np.append(cuts, len(key)).astype(np.int32)), pa.array(start, pa.int64()))
    return pa.RecordBatch.from_arrays([pa.array(key[cuts], pa.int64()), pa.array(version[cuts], pa.int64()), lists], names=["key", "version", "starts"])


def repeats(rows: DataFrame, hot: np.ndarray, groups: int, s: Settings) -> DataFrame:
    """(key, version, starts): windows that a smaller key has, from rows with their repeated anchors."""
    span = s.window

    def gather(batches):
        held: list[tuple] = []
        have = 0
        for b in batches:
            for key, version, text, ats in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3)):
                t = b" ".join(text.as_py().split())
                hashes = word_hashes(t)
                at = np.unique(np.asarray(ats.values))
                place, first, last = at // s.offsets**2, at // s.offsets % s.offsets, at % s.offsets
                first, last = place - first, place - last
                ok = (last + span <= len(hashes)) & (first >= 0)
                place, first, last = place[ok], first[ok], last[ok]
                if not len(place):
                    continue
                gram = rolling(hashes, s.anchor)[place]
                held.append((key, version, t, hashes, gram, first, last))
                have += len(place)
                if have >= s.suffixes:
                    yield send(held)
                    held, have = [], 0
        if held:
            yield send(held)

    def send(held):
        # all windows of the chunk, as places in one array of words
        size = np.cumsum([0, *[len(h[3]) for h in held]])
        words = np.concatenate([h[3] for h in held])
        count = [h[6] - h[5] + 1 for h in held]
        each = np.concatenate(count)  # windows of each anchor
        doc = np.repeat(np.arange(len(held)), [len(c) for c in count])
        first = np.concatenate([h[5] for h in held])
        gram = np.concatenate([h[4] for h in held])
        anchor = np.repeat(np.arange(len(each)), each)
        start = first[anchor] + np.arange(len(anchor)) - np.repeat(np.cumsum(each) - each, each)
        keys, versions = np.array([h[0] for h in held]), np.array([h[1] for h in held])
        owner = doc[anchor]
        smaller, _ = settle(words, size[owner] + start, keys[owner], s)
        parts, kinds, blobs = [], [], []
        if smaller.any():
            parts.append(int(gram[0] % U64(groups)))
            kinds.append(1)
            by = np.lexsort((start[smaller], owner[smaller]))
            blobs.append(_pack(keys[owner[smaller]][by], versions[owner[smaller]][by], start[smaller][by]))
        # what is open goes on: runs of windows of one anchor, or single windows of a frequent gram
        open_ = np.flatnonzero(~smaller)
        if len(open_):
            often = np.isin(gram[anchor[open_]], hot) if len(hot) else np.zeros(len(open_), bool)
            value = np.where(often, window_values(words, size[owner[open_]] + start[open_], s), gram[anchor[open_]])
            new = np.ones(len(open_), bool)
            new[1:] = often[1:] | (anchor[open_][1:] != anchor[open_][:-1]) | (np.diff(open_) != 1)
            lead = np.flatnonzero(new)
            length = np.diff(np.append(lead, len(open_)))
            group = (value[lead] % U64(groups)).astype(np.int64)
            by = np.argsort(group, kind="stable")
            bounds = {}
            for k, lo, hi in _slices(group[by]):
                some = lead[by[lo:hi]]
                w = open_[some]
                pieces = []
                for i, n in zip(w.tolist(), length[by[lo:hi]].tolist()):
                    d = int(owner[i])
                    if d not in bounds:
                        bounds[d] = word_bounds(np.frombuffer(held[d][2], np.uint8))
                    a, e = bounds[d]
                    pieces.append(held[d][2][a[start[i]] : e[start[i] + n - 1 + span - 1]])
                parts.append(k)
                kinds.append(0)
                meta = _pack(keys[owner[w]], versions[owner[w]], start[w], length[by[lo:hi]])
                blobs.append(np.int64(len(meta)).tobytes() + meta + b" ".join(pieces))
        return pa.RecordBatch.from_arrays([pa.array(parts, pa.int64()), pa.array(kinds, pa.int32()), pa.array(blobs, pa.binary())], names=["part", "kind", "blob"])

    def join(batches):
        for _, rows_of in _by_part(batches):
            keys, versions, starts, lengths, words = [], [], [], [], []
            for kind, blob in rows_of:
                if kind:
                    yield _removed(*_unpack(blob, 3))
                    continue
                n = int(np.frombuffer(blob[:8], np.int64)[0])
                for held, c in zip((keys, versions, starts, lengths), _unpack(blob[8 : 8 + n], 4)):
                    held.append(c)
                words.append(word_hashes(blob[8 + n :]))
            if not keys:
                continue
            key, version, start, length = (np.concatenate(x) for x in (keys, versions, starts, lengths))
            hashes = np.concatenate(words)
            begin = np.cumsum(length + span - 1) - (length + span - 1)  # of each run in the words
            run = np.repeat(np.arange(len(length)), length)
            step = np.arange(len(run)) - np.repeat(np.cumsum(length) - length, length)
            smaller, _ = settle(hashes, begin[run] + step, key[run], s)
            yield _removed(key[run[smaller]], version[run[smaller]], start[run[smaller]] + step[smaller])

    sent = rows.mapInArrow(gather, "part long, kind int, blob binary")
    return sent.repartition("part").sortWithinPartitions("part").mapInArrow(join, "key long, version long, starts array<long>")


def window_values(hashes: np.ndarray, start: np.ndarray, s: Settings) -> np.ndarray:
    out = np.zeros(len(start), dtype=U64)
    for k, p in enumerate(powers(s.window)):
        out += hashes[start + k] * p
    return mix(out)


def remove(docs: DataFrame, s: Settings = Settings(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words, n_removed, kept): every row's words that stay, joined by one space, as bytes."""
    last = F.lit(2**63 - 1)
    source = docs.select(F.col(key).alias("id"), F.coalesce(F.col(key).cast("long"), last).alias("key"), text_bytes(text).alias("t"))
    size = source.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    about = size / 24  # anchors: a word is about six bytes, an anchor about four words
    found = materialize(repeated_anchors(source, int(about / s.bucket_grams) + 1, s))
    frequent = found.filter(F.col("at").isNull()).orderBy(F.desc("n"), "key").limit(s.most_hot).select("key").toArrow()
    hot = np.sort(frequent.column(0).to_numpy().view(U64))
    # one exchange of the texts serves both joins
    texts = source.withColumn("version", F.crc32("t")).select("id", "key", "version", "t").repartition("key")
    places = found.filter(F.col("at").isNotNull()).groupBy(F.col("key").alias("k")).agg(F.collect_list("at").alias("ats"))
    rows = texts.join(places.hint("shuffle_hash"), F.col("key") == F.col("k"))
    gone = repeats(_ordered(rows), hot, int(about / s.group_suffixes) + 1, s)
    by_key = gone.groupBy(F.col("key").alias("k")).agg(F.collect_list(F.struct("version", "starts")).alias("gone"))
    both = texts.join(by_key.hint("shuffle_hash"), F.col("key") == F.col("k"), "left")

    def run(batches):
        for b in batches:
            n, out, kept = [], [], []
            for version, t, gone_of in zip(b.column(1).to_pylist(), b.column(2), b.column(3)):
                words = t.as_py().split()
                n.append(len(words))
                drop = np.zeros(len(words) + 1, np.int64)
                for g in gone_of.as_py() or ():
                    if g["version"] == version:
                        at = np.array(g["starts"], np.int64)
                        np.add.at(drop, at, 1)
                        np.add.at(drop, at + s.window, -1)
                covered = np.cumsum(drop)[:-1] > 0
                out.append(int(covered.sum()))
                kept.append(b" ".join([words[k] for k in np.flatnonzero(~covered).tolist()] if out[-1] else words))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(out, pa.int64()), pa.array(kept, pa.binary())],
                                             names=["id", "n_words", "n_removed", "kept"])

    kind = dict(docs.dtypes)[key]
    return both.select("id", "version", "t", "gone").mapInArrow(run, f"id {kind}, n_words long, n_removed long, kept binary").withColumnRenamed("id", key)


def _ordered(rows: DataFrame) -> DataFrame:
    """Columns as ``repeats`` reads them; all columns of the texts stay, so that both joins share one exchange."""
    return rows.select("key", "version", "t", "ats", "id")


def sha256(kept: bytes) -> str:
    return hashlib.sha256(kept).hexdigest()
