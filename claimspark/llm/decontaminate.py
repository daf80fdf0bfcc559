"""Benchmark decontamination: BM25 over an inverted index of test items, queried with every passage.

Each document is cut into overlapping passages, twice as long as the longest item, that begin
half a passage apart, so an item that a document holds lies whole in a passage. Scores are divided by the
item's score against itself, so one threshold fits all items. The search is a MaxScore split with
block maxima for batches of passages, without pivots or skipped blocks: lists of frequent terms, whose maxima together stay below a share of the
threshold, cannot retrieve an item alone and are not walked; sums over the other lists pick the
candidates; the frequent terms' maxima in the candidate's block of items then bound its score;
only what can still pass is scored in full. Every item at or above the threshold is retrieved.

A retrieved item is verified: five-word shingles of its question and of its answer must occur in
the passage, each to the stated share. An item's answer is its last sentence and its question what
stands before; an item of one sentence is both.

The index of one shard of items is a bounded broadcast; a benchmark with more items is searched
in several passes. Words are lower-cased (A-Z) and split at ASCII punctuation and white space.

Defined results: null texts are empty; items without words match nothing; equal items match each on
their own; repeated documents give repeated rows; empty tables give no rows. Only keys and texts are
read, so other columns' names do not matter; ``clean`` passes all columns of the documents through.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from claimspark.session import materialize

from .common import text_bytes


@dataclass(frozen=True)
class Settings:
    k1: float = 1.2
    b: float = 0.75
    threshold: float = 0.5  # of the item's score against itself
    walked_from: float = 0.5  # lists whose maxima sum up to this share of the threshold are not walked
    overlap: float = 0.8
    shingle: int = 5
    block: int = 64  # items
    shard: int = 20_000  # items in one broadcast index
    cells: int = 400_000  # scores a task holds at once


PLAIN = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256))


def words(text: bytes) -> list[bytes]:
    return text.lower().translate(PLAIN).split()


def parts_of(text: bytes) -> tuple[list[bytes], list[bytes]]:
    """Words of question and answer."""
    sentences = [w for w in map(words, re.split(rb"[.?!\n]+", text)) if w]
    if len(sentences) < 2:
        return words(text), words(text)
    return [w for s in sentences[:-1] for w in s], sentences[-1]


def shingles(w: list[bytes], n: int) -> set[bytes]:
    return {b" ".join(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()


def term_counts(items: DataFrame, text: str) -> DataFrame:
    """(term, df): the items that have each term."""
    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([t for x in b.column(0) for t in set(words(x.as_py()))], pa.binary())], names=["term"])

    return items.select(text_bytes(text).alias("t")).mapInArrow(run, "term binary").groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def lengths(items: DataFrame, text: str) -> tuple[int, float]:
    """Number of items and mean length in words."""
    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(words(x.as_py())) for x in b.column(0)], pa.int64())], names=["n"])

    n, mean = items.select(text_bytes(text).alias("t")).mapInArrow(run, "n long").agg(F.count(F.lit(1)), F.avg("n")).first()
    return n, mean or 0.0


def build(rows: list[tuple], df: dict[bytes, int], n: int, mean: float, s: Settings) -> dict:
    """The inverted index of a shard: plain arrays, by term in compressed rows."""
    tokens = [words(t) for _, t in rows]
    term: dict[bytes, int] = {}
    at, item, tf = [], [], []
    for k, w in enumerate(tokens):
        count: dict[int, int] = {}
        for x in w:
            i = term.setdefault(x, len(term))
            count[i] = count.get(i, 0) + 1
        at += count
        item += [k] * len(count)
        tf += count.values()
    at, item, tf = np.array(at, np.int64), np.array(item, np.int64), np.array(tf, float)
    size = np.array([len(w) for w in tokens], float)
    docs = np.array([df[t] for t in term], float)
    idf = np.log(1 + (n - docs + 0.5) / (docs + 0.5))
    impact = idf[at] * tf * (s.k1 + 1) / (tf + s.k1 * (1 - s.b + s.b * size[item] / max(mean, 1e-9))) if len(at) else np.zeros(0)
    own = np.bincount(item, weights=impact, minlength=len(rows)) if len(at) else np.zeros(len(rows))
    impact = impact / own[item] if len(at) else impact
    order = np.lexsort((item, at))
    at, item, impact = at[order], item[order], impact[order]
    begin = np.searchsorted(at, np.arange(len(term) + 1))
    most = np.maximum.reduceat(impact, begin[:-1]) if len(term) else np.zeros(0)
    # the most frequent terms, as long as their maxima stay below a share of the threshold
    frequent = np.argsort(-np.diff(begin), kind="stable")
    skipped = frequent[np.cumsum(most[frequent]) < s.walked_from * s.threshold]
    walked = np.ones(len(term), bool)
    walked[skipped] = False
    blocks = np.zeros((len(term), -(-max(len(rows), 1) // s.block)), np.float32)
    np.maximum.at(blocks, (at, item // s.block), impact.astype(np.float32))
    asked = [tuple(shingles(p, s.shingle) for p in parts_of(t)) for _, t in rows]
    return {"ids": [i for i, _ in rows], "term": term, "begin": begin, "item": item, "impact": impact, "walked": walked, "blocks": blocks[skipped],
            "skipped": {int(t): k for k, t in enumerate(skipped)}, "asked": asked, "stride": max(32, int(size.max(initial=0)))}


def matches(texts: list[bytes], ix: dict, s: Settings) -> list[tuple[int, int, float, float, float]]:
    """(text's place, item's place, score, question and answer overlap) of verified items, best passage each."""
    n_items, stride, terms = len(ix["ids"]), ix["stride"], ix["term"]
    if not terms:
        return []
    get, none = terms.get, len(terms)
    best: dict[tuple[int, int], tuple] = {}
    tokens, ids, passage, base, owner = [], [], [], 0, []
    for k, text in enumerate(texts):
        w = words(text)
        tokens.append(w)
        found = np.fromiter(map(get, w, [none] * len(w)), dtype=np.int64, count=len(w))
        ids.append(found)
        half = -(-len(w) // stride)
        passage.append(base + np.arange(len(w)) // stride)
        owner += [(k, h) for h in range(half)]
        base += half
    if not base:
        return []
    flat, half = np.concatenate(ids), np.concatenate(passage)
    walked = np.append(ix["walked"], False)[flat]
    flat, half = flat[walked], half[walked]
    # a passage is a half and the next one of the same text
    first = np.array([h == 0 for _, h in owner])
    again = ~first[half]
    key = np.unique(np.concatenate([half, half[again] - 1]) * none + np.concatenate([flat, flat[again]]))
    passages, term = key // none, key % none
    step = max(1, s.cells // n_items)
    bound = np.searchsorted(passages, np.arange(0, base + step, step))
    count = np.diff(ix["begin"])
    least = s.threshold * (1 - s.walked_from)
    for c, (lo, hi) in enumerate(zip(bound[:-1], bound[1:])):
        if lo == hi:
            continue
        p, t = passages[lo:hi] - c * step, term[lo:hi]
        n = count[t]
        post = np.repeat(ix["begin"][t] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        score = np.bincount(np.repeat(p, n) * n_items + ix["item"][post], weights=ix["impact"][post], minlength=0)
        for cell in np.flatnonzero(score >= least).tolist():
            place, item = divmod(cell, n_items)
            k, h = owner[place + c * step]
            span = slice(h * stride, (h + 2) * stride)
            rest = {ix["skipped"][x] for x in set(ids[k][span].tolist()) if x in ix["skipped"]}
            if score[cell] + ix["blocks"][list(rest), item // s.block].sum() < s.threshold - 1e-6:
                continue
            full = full_score(set(ids[k][span].tolist()), item, ix)
            if full < s.threshold - 1e-9:
                continue
            has = shingles(tokens[k][span], s.shingle)
            there = b" " + b" ".join(tokens[k][span]) + b" "
            over = [sum(g in has or b" " + g + b" " in there for g in part) / len(part) for part in ix["asked"][item]]
            if min(over) >= s.overlap:
                best[k, item] = max(best.get((k, item), (0.0, 0.0, 0.0)), (min(full, 1.0), *over))
    return [(k, item, *v) for (k, item), v in sorted(best.items())]


def full_score(terms: set[int], item: int, ix: dict) -> float:
    """The item's normalised score for a passage with these terms."""
    total = 0.0
    for t in terms:
        if t < len(ix["term"]):
            lo, hi = ix["begin"][t], ix["begin"][t + 1]
            at = lo + np.searchsorted(ix["item"][lo:hi], item)
            if at < hi and ix["item"][at] == item:
                total += float(ix["impact"][at])
    return total


def indexes(benchmark: DataFrame, s: Settings, key: str = "item_id", text: str = "text"):
    """The index of each shard, one after the other; the driver holds one shard at a time."""
    items = materialize(benchmark.select(F.col(key).alias("id"), text_bytes(text).alias("t")))
    n, mean = lengths(items, "t")
    df = materialize(term_counts(items, "t"))
    shards = -(-n // s.shard)
    for k in range(shards):
        part = items.filter(F.pmod(F.xxhash64("id", "t"), F.lit(shards)) == k)
        rows = sorted(((r.id, bytes(r.t)) for r in part.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        own = part.sparkSession.createDataFrame([(t,) for t in sorted({w for _, t in rows for w in words(t)})], "term binary")
        found = {bytes(r.term): r.df for r in df.join(own, "term", "left_semi").collect()}
        yield build(rows, found, n, mean, s)


def _batches(texts: list[bytes], most: int = 500_000):
    """(from, to) of runs of texts of about ``most`` bytes."""
    lo, size = 0, 0
    for k, t in enumerate(texts):
        size += len(t)
        if size >= most:
            yield lo, k + 1
            lo, size = k + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def leaks(docs: DataFrame, benchmark: DataFrame, s: Settings = Settings(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, item_id, score, question_overlap, answer_overlap): the verified test items of each document."""
    spark = docs.sparkSession
    kind, item_kind = dict(docs.dtypes)[key], dict(benchmark.dtypes)["item_id"]
    ids = to_arrow_type(benchmark.schema["item_id"].dataType)
    schema = f"key {kind}, item_id {item_kind}, score double, question_overlap double, answer_overlap double"
    source = docs.select(F.col(key).alias("key"), text_bytes(text).alias("t"))
    out = None
    for ix in indexes(benchmark, s):
        shared = spark.sparkContext.broadcast(ix)  # at most ``shard`` items

        def run(batches, shared=shared):
            ix = shared.value
            for b in batches:
                texts = [x.as_py() for x in b.column(1)]
                found = [(lo + m[0], *m[1:]) for lo, hi in _batches(texts) for m in matches(texts[lo:hi], ix, s)]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array([m[0] for m in found], pa.int64())), pa.array([ix["ids"][m[1]] for m in found], ids),
                     *[pa.array([m[k] for m in found], pa.float64()) for k in (2, 3, 4)]], names=["key", "item_id", "score", "question_overlap", "answer_overlap"])

        part = source.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return (out if out is not None else spark.createDataFrame([], schema)).withColumnRenamed("key", key)


def clean(docs: DataFrame, benchmark: DataFrame, s: Settings = Settings(), text: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no verified test item, with all their columns."""
    at, names, schema = docs.columns.index(text), docs.columns, docs.schema
    for ix in indexes(benchmark, s):
        shared = docs.sparkSession.sparkContext.broadcast(ix)

        def run(batches, shared=shared):
            for b in batches:
                texts = [(x.as_py() or "").encode() for x in b.column(at)]
                hit = {lo + m[0] for lo, hi in _batches(texts) for m in matches(texts[lo:hi], shared.value, s)}
                keep = pa.array([k not in hit for k in range(len(texts))], pa.bool_())
                yield pa.RecordBatch.from_arrays([c.filter(keep) for c in b.columns], names=names)

        docs = docs.mapInArrow(run, schema)
    return docs
