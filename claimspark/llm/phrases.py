"""Phrase collocations: best-first growth of frequent phrases under score bounds.

A phrase of two or more words with a occurrences, cut after its first words into parts with l and r
occurrences, scores floor(2000000 a / (l + r)) at its lowest cut. Whatever starts with a prefix p occurs
at most f(p) times, and its cut after the first word w has l = f(w) and r >= a, so no such phrase, nor p itself,
scores above floor(2000000 f(p) / (f(w) + f(p))). That is the bound of p.

Words and pairs are counted first. The pairs' scores give each language a level. Prefixes with a bound at or above the
level are grown by a word on either side, a pass over the texts for each length: to the right for longer
phrases, to the left to learn which phrases a longer one absorbs. Then every phrase that scores at least the level is known,
and so is whether it survives. A language with ``top`` survivors at its level is settled, ties included; for the others the
level falls, at last to zero, where all frequent phrases have been grown.

Tasks count phrases as numbers of words of their own and send partial counts. What may be counted comes to them
as a table of bits of fixed size: it passes some phrases too many, which are counted exactly as well,
and none too few. No other data is broadcast, and the driver sees bits, and whether a language is left.

Defined results: a null text is empty, a null language is ``und``; ties are ranked by occurrences,
then by the phrase's bytes; repeated rows count each; an empty table gives no rows; texts of any
length stream through in slices. Only language and text are read, so other columns' names do not matter.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimspark.session import materialize

from .common import PRIME, U64, mix, text_bytes

UNIT = 2_000_000


@dataclass(frozen=True)
class Settings:
    longest: int = 4
    least: int = 30
    absorb: int = 80  # per cent of a phrase's occurrences that lie in a longer one
    top: int = 2000
    spare: int = 2  # the first level lets through so many times ``top`` pairs
    bits: int = 25  # of a table of hashes: 2**bits bits
    tokens: int = 2 << 20  # held by a task at once
    slice_bytes: int = 1 << 20
    salts: int = 64


# ---- words of texts ---------------------------------------------------------------------------
BREAKS = b".,;:!?\n\x0b\x0c\r"
FLAT = bytes.maketrans(BREAKS, b"." * len(BREAKS))
EDGE = re.compile(rb"[ \t.]")


def slices(text: bytes, size: int):
    """Lists of lower-case words, with a point wherever a piece ends; no word is cut."""
    flat, at = text.lower().translate(FLAT), 0
    while at < len(flat):
        end = len(flat)
        if at + size < end and (edge := EDGE.search(flat, at + size)):
            end = edge.start()
        yield flat[at:end].replace(b".", b" . ").split()
        at = end


def by_language(batches, size: int):
    """(language, text) with the texts of a language, about ``size`` bytes of them, as one; pieces kept apart."""
    held: dict[str, list[bytes]] = {}
    total = 0
    for b in batches:
        for lang, text in zip(b.column(0), b.column(1)):
            text = text.as_py()
            held.setdefault(lang.as_py(), []).append(text)
            total += len(text) + 1
            if total >= size:
                for lang, texts in held.items():
                    yield lang, b".".join(texts)
                held, total = {}, 0
    for lang, texts in held.items():
        yield lang, b".".join(texts)


# ---- tables of bits -----------------------------------------------------------------------------
def word_hash(lang: str):
    seed = xxhash.xxh64_intdigest(lang.encode())
    return lambda word: xxhash.xxh64_intdigest(word, seed)


def joined(hashes: list[np.ndarray]) -> np.ndarray:
    """Hashes of phrases from those of their first, second, ... words."""
    return reduce(lambda c, h: mix(c * U64(PRIME) + h), hashes)


def bit_table(phrases: DataFrame, bits: int) -> np.ndarray:
    """The hashes of (lang, phrase) rows as a table of 2**bits bits."""
    block = 1 << 13

    def emit(found: dict[int, np.ndarray]):
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array([x.tobytes() for x in found.values()], pa.binary())], names=["block", "bits"])

    def mark(batches):
        table = np.zeros(1 << (bits - 3), np.uint8)
        for b in batches:
            rows: dict[int, list] = {}
            for lang, phrase in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                hashed, words = word_hash(lang), phrase.encode().split(b" ")
                rows.setdefault(len(words), []).append([hashed(w) for w in words])
            for some in rows.values():
                at = joined(list(np.array(some, U64).T)) >> U64(64 - bits)
                np.bitwise_or.at(table, at >> U64(3), (1 << (at & U64(7))).astype(np.uint8))
        parts = table.reshape(-1, min(block, len(table)))
        yield from emit({i: parts[i] for i in np.flatnonzero(parts.any(axis=1)).tolist()})

    def merge(batches):
        found: dict[int, np.ndarray] = {}
        for b in batches:
            for i, x in zip(b.column(0).to_pylist(), b.column(1)):
                x = np.frombuffer(x.as_py(), np.uint8)
                found[i] = found[i] | x if i in found else x
        yield from emit(found)

    kind = "block int, bits binary"
    table = np.zeros((max(1, (1 << (bits - 3)) // block), min(block, 1 << (bits - 3))), np.uint8)
    # a fixed number of blocks, whatever the number of phrases
    for r in phrases.select("lang", "phrase").mapInArrow(mark, kind).repartition("block").mapInArrow(merge, kind).collect():
        table[r.block] = np.frombuffer(r.bits, np.uint8)
    return table.reshape(-1)


def marked(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes >> U64(64 - int(np.log2(len(table) * 8)))
    return (table[at >> U64(3)] >> (at & U64(7)).astype(np.uint8) & 1).astype(bool)


# ---- counting ------------------------------------------------------------------------------------
COUNTS = "lang string, phrase string, f long"
SCHEMA = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("f", pa.int64())])


def texts_of(docs: DataFrame, lang: str, text: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), text_bytes(text).alias("text"))


def word_counts(texts: DataFrame, s: Settings) -> DataFrame:
    """Counts of words; the empty phrase has the number of all words of its language."""
    def run(batches):
        held: dict[str, Counter] = {}

        def out():
            for lang, words in held.items():
                words.pop(b".", None)
                if words:
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * (len(words) + 1)), pa.array([b"", *words], pa.binary()).cast(pa.string()),
                                                      pa.array([sum(words.values()), *words.values()], pa.int64())], schema=SCHEMA)
            held.clear()

        for lang, text in by_language(batches, 2 * s.slice_bytes):
            for words in slices(text, s.slice_bytes):
                held.setdefault(lang, Counter()).update(words)
                if sum(map(len, held.values())) > 300_000:
                    yield from out()
        yield from out()

    return summed(texts.mapInArrow(run, COUNTS))


def summed(parts: DataFrame) -> DataFrame:
    return parts.groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


class Ids:
    """A language's texts as numbers of its frequent words; 0 is any other word and the end of a piece."""

    def __init__(self, lang: str):
        self.hashed, self.number, self.words = word_hash(lang), {}, [b""]
        self.hashes, self.parts, self.n, self.context = [0], [], 0, 0

    def add(self, words: list[bytes], frequent: np.ndarray) -> None:
        new = list(set(words).difference(self.number, (b".",)))
        if new:
            hashes = np.fromiter(map(self.hashed, new), U64, len(new))
            for i in np.flatnonzero(marked(frequent, hashes)).tolist():
                self.number[new[i]] = len(self.words)
                self.words.append(new[i])
                self.hashes.append(int(hashes[i]))
        self.parts.append(np.fromiter(map(self.number.get, words, repeat(0)), np.int32, len(words)))
        self.n += len(words)

    def take(self, k: int) -> tuple[np.ndarray, int]:
        """All numbers held, and how many of them only lead up to the rest; those at the end lead up to the next ones."""
        ids, context = np.concatenate(self.parts), self.context
        self.parts, self.context = [ids[len(ids) - min(k - 1, len(ids)) :]], min(k - 1, len(ids))
        self.n = self.context
        return ids, context

    def ended(self) -> None:
        self.parts.append(np.zeros(1, np.int32))
        self.n += 1

    def forget(self) -> None:
        """Drop all words but those of the context, right after :meth:`take`."""
        ids, words, hashes = self.parts[0], self.words, self.hashes
        kept = [i for i in dict.fromkeys(ids.tolist()) if i]
        self.words, self.hashes = [b"", *(words[i] for i in kept)], [0, *(hashes[i] for i in kept)]
        self.number = {w: i for i, w in enumerate(self.words) if i}
        self.parts = [np.array([self.number.get(words[i], 0) for i in ids.tolist()], np.int32)]


@dataclass
class Wanted:
    """Which phrases of ``k`` words to count."""

    k: int
    words: np.ndarray
    pairs: np.ndarray | None = None  # all pairs in the phrase
    grown: np.ndarray | None = None  # the phrase without its last or its first word
    whole: np.ndarray | None = None

    def at(self, ids: np.ndarray, hashes: np.ndarray, context: int) -> np.ndarray:
        """Where in ``ids`` such phrases start that end after the context."""
        first = max(0, context - self.k + 1)
        n = len(ids) - self.k + 1
        if n <= first:
            return np.zeros(0, np.int64)
        ok = np.ones(n - first, bool)
        for j in range(self.k):
            ok &= ids[first + j : n + j] > 0
        at = np.flatnonzero(ok) + first
        h = lambda j, m, some: joined([hashes[ids[some + i]] for i in range(j, j + m)])
        if self.pairs is not None:
            for j in range(self.k - 1):
                at = at[marked(self.pairs, h(j, 2, at))]
        if self.grown is not None:
            at = at[marked(self.grown, h(0, self.k - 1, at)) | marked(self.grown, h(1, self.k - 1, at))]
        if self.whole is not None:
            at = at[marked(self.whole, h(0, self.k, at))]
        return at


def phrase_counts(texts: DataFrame, want: Wanted, s: Settings) -> DataFrame:
    def run(batches):
        held: dict[str, Ids] = {}

        def out():
            for lang, x in held.items():
                ids, context = x.take(want.k)
                at = want.at(ids, np.array(x.hashes, U64), context)
                if not len(at):
                    continue
                code, size = ids[at].astype(np.int64), len(x.words)
                for j in range(1, want.k):
                    # short codes, so that the next word still fits 64 bits
                    code = code if j == 1 else np.unique(code, return_inverse=True)[1]
                    code = code * size + ids[at + j]
                _, one, n = np.unique(code, return_index=True, return_counts=True)
                words = pa.array(x.words, pa.binary())
                phrase = pc.binary_join_element_wise(*[words.take(pa.array(ids[at[one] + j])) for j in range(want.k)], b" ")
                for lo in range(0, len(n), 100_000):
                    part = phrase.slice(lo, 100_000)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part)), part.cast(pa.string()), pa.array(n[lo : lo + 100_000], pa.int64())], schema=SCHEMA)

        for lang, text in by_language(batches, 2 * s.slice_bytes):
            x = held.setdefault(lang, Ids(lang))
            for words in slices(text, s.slice_bytes):
                x.add(words, want.words)
                if sum(y.n for y in held.values()) >= s.tokens:
                    yield from out()
                    for y in held.values():  # numbers of words are kept, unless they grow too many
                        if len(y.words) > 1 << 20:
                            y.forget()
            x.ended()
        yield from out()

    return summed(texts.mapInArrow(run, COUNTS))


# ---- scores and bounds ---------------------------------------------------------------------------
def ratio(a: Column, total: Column) -> Column:
    """floor(UNIT a / total); decimals, since the product may pass 64 bits."""
    return F.call_function("div", F.lit(UNIT).cast("decimal(17,0)") * a.cast("decimal(20,0)"), total.cast("decimal(20,0)"))


def scored(phrases: DataFrame, known: DataFrame) -> DataFrame:
    """(lang, phrase, a, score, l, r, lost, missing): the lowest of the cuts whose parts are in ``known``.

    ``lost`` says that a first part is not known, ``missing`` is a second part that is not."""
    words = F.split("phrase", " ")
    cut = lambda j: F.struct(j.alias("j"), F.array_join(F.slice("words", F.lit(1), j), " ").alias("first"),
                             F.array_join(F.slice("words", j + 1, F.size("words")), " ").alias("rest"))
    cuts = phrases.select("lang", "phrase", F.col("f").alias("a"), words.alias("words")).select(
        "lang", "phrase", "a", F.inline(F.transform(F.sequence(F.lit(1), F.size("words") - 1), cut)))
    part = lambda name, count: known.select("lang", F.col("phrase").alias(name), F.col("f").alias(count))
    met = cuts.join(part("first", "l"), ["lang", "first"], "left").join(part("rest", "r"), ["lang", "rest"], "left")
    each = F.struct(ratio(F.col("a"), F.col("l") + F.col("r")).alias("score"), "j", "l", "r")
    lowest = met.groupBy("lang", "phrase").agg(
        F.max("a").alias("a"), F.min(F.when(F.col("l").isNotNull() & F.col("r").isNotNull(), each)).alias("m"),
        F.max(F.col("l").isNull()).alias("lost"), F.max(F.when(F.col("r").isNull(), F.col("rest"))).alias("missing"))
    return lowest.select("lang", "phrase", "a", "m.score", "m.l", "m.r", "lost", "missing")


def bounded(phrases: DataFrame, words: DataFrame, levels: DataFrame) -> DataFrame:
    """The phrases whose bound reaches the level of their language."""
    first = words.select("lang", F.col("phrase").alias("first"), F.col("f").alias("w"))
    met = phrases.withColumn("first", F.substring_index("phrase", " ", 1)).join(first, ["lang", "first"]).join(levels, "lang")
    return met.filter(ratio(F.col("f"), F.col("w") + F.col("f")) >= F.col("level")).select("lang", "phrase", "f")


def levels_of(scores: DataFrame, want: int) -> DataFrame:
    """(lang, level): the highest thousand of scores with ``want`` phrases at or above it, else 0.

    The window holds at most a thousand counts a language."""
    bins = scores.groupBy("lang", F.expr("score div 1000").alias("bin")).count()
    above = bins.withColumn("n", F.sum("count").over(Window.partitionBy("lang").orderBy(F.desc("bin"))))
    return above.groupBy("lang").agg(F.coalesce(F.max(F.when(F.col("n") >= want, F.col("bin") * 1000)), F.lit(0)).cast("long").alias("level"))


def absorbed(phrases: DataFrame, longer: DataFrame, s: Settings) -> DataFrame:
    """The phrases that no longer one of a word more absorbs. Longer ones still occur no more often than these."""
    words = F.split("phrase", " ")
    inner = F.array(F.array_join(F.slice(words, F.lit(1), F.size(words) - 1), " "), F.array_join(F.slice(words, F.lit(2), F.size(words) - 1), " "))
    most = longer.select("lang", F.explode(inner).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("most"))
    wide = lambda c, by: F.lit(by).cast("decimal(5,0)") * F.col(c).cast("decimal(20,0)")
    return phrases.join(most, ["lang", "phrase"], "left").filter(F.col("most").isNull() | (wide("most", 100) < wide("a", s.absorb))).drop("most")


def collocations(docs: DataFrame, s: Settings = Settings(), lang: str = "lang", text: str = "text") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first ``top`` phrases of each language."""
    texts = texts_of(docs, lang, text)
    enough = F.col("f") >= s.least
    counted = materialize(word_counts(texts, s).filter(enough | (F.col("phrase") == "")))
    totals, words = counted.filter("phrase = ''").select("lang", F.col("f").alias("n")), counted.filter((F.col("phrase") != "") & enough)
    frequent = bit_table(words, s.bits)
    pairs = materialize(phrase_counts(texts, Wanted(2, frequent), s).filter(enough))
    pair_scores = materialize(scored(pairs, words))
    in_pairs = bit_table(pairs, s.bits)

    settled: list[DataFrame] = []
    spare, left, todo = s.spare, None, texts
    while True:
        open_scores = pair_scores if left is None else pair_scores.join(left, "lang", "left_semi")
        levels = levels_of(open_scores, s.top * spare)
        levels = materialize(levels.withColumn("level", F.lit(0).cast("long")) if spare > s.spare * 16 else levels)
        known, grown, longer = [words, pairs], pairs, []
        for k in range(3, s.longest + 1):
            near = bit_table(bounded(grown, words, levels), s.bits)
            grown = materialize(phrase_counts(todo, Wanted(k, frequent, in_pairs, grown=near), s).filter(enough))
            longer.append(grown)
            known.append(grown)
        every = lambda: reduce(DataFrame.unionByName, known)
        found = every().filter(F.instr("phrase", " ") > 0).join(levels.select("lang"), "lang", "left_semi")
        scores = materialize(scored(found, every()))
        # A phrase with an unknown first part came from the left; that part was not grown, so the phrase is below the level.
        running = lambda: scores.join(levels, "lang").filter(~F.col("lost") & (F.coalesce("score", "level") >= F.col("level")))
        for k in range(s.longest - 1, 2, -1):
            # second parts that were not grown themselves
            ends = running().filter(F.size(F.split("missing", " ")) == k).select("lang", F.col("missing").alias("phrase")).distinct()
            if not ends.isEmpty():
                known.append(materialize(phrase_counts(todo, Wanted(k, frequent, whole=bit_table(ends, s.bits)), s)
                                         .join(ends, ["lang", "phrase"], "left_semi")))
                scores = materialize(scored(found, every()))
        high = running().filter("missing is null").drop("missing", "lost")
        kept = materialize(reduce(lambda rows, more: absorbed(rows, more, s), longer, high))
        full = kept.groupBy("lang", "level").count().filter(F.col("count") >= s.top)
        done = levels.join(full.select("lang"), "lang", "left_semi").unionByName(levels.filter("level = 0")).select("lang").distinct()
        settled.append(kept.join(done, "lang", "left_semi"))
        left = materialize(levels.join(done, "lang", "left_anti").select("lang"))
        if left.isEmpty():
            break
        spare, todo = spare * 4, texts.join(left, "lang", "left_semi")

    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    rows = reduce(DataFrame.unionByName, settled).withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(s.salts)))
    few = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*best))).filter(F.col("rank") <= s.top)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best))).filter(F.col("rank") <= s.top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
