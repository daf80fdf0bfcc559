"""Quality classifier from weak labels.

Heuristic labellers look at the whole text; they vote bad or abstain, one votes good if no measure
is high. Spark counts the vote patterns of all documents; expectation-maximisation on these counts
(at most 2**labellers rows) estimates each labeller's accuracy from where votes overlap, and so a
posterior for each pattern. An abstention is no evidence and both classes are given the same
prior: kinds of junk that one labeller alone sees would else count as its mistakes. The posteriors
are the soft labels of a linear scorer on hashed features, fitted on a bounded sample and applied
to every document.

Defined results: a null text is an empty one; a text without words is rejected with score 0; an
empty table gives the prior model and no rows; repeated rows are judged alike. Only the key and
the text are read, so other columns' names do not matter; ``keep`` passes all columns through.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, mix, text_bytes, word_bounds, word_hashes

# The labellers with the measure each looks at, low up to the first limit, bad from the second.
LABELLERS = (
    ("symbols", 0.02, 0.04),  # share of characters that are neither letters, digits, spaces nor usual punctuation
    ("wordless", 0.05, 0.12),  # share of words without a letter or digit
    ("capitals", 0.15, 0.30),  # share of capitals among ASCII letters
    ("repeats", 0.40, 0.60),  # share of four-word sequences that occurred before in the text
    ("long_words", 0.08, 0.20),  # share of words of over 25 bytes
    ("odd_words", 0.08, 0.20),  # share of words with a symbol inside or at the end
    ("same_lines", 0.34, 0.60),  # share of lines that occurred before
)
LEAST_WORDS, LEAST_LINES = 20, 5  # below: no vote on repeats, on lines


@dataclass(frozen=True)
class Settings:
    buckets: int = 2048
    sample: int = 3000  # documents the scorer is fitted on, those with the smallest hashes
    rounds: int = 100
    epochs: int = 300
    rate: float = 2.0
    decay: float = 1e-4
    accept: float = 0.3  # the least score that stays; below one half, as doubtful texts are kept


_KIND = np.zeros(256, dtype=np.uint8)  # 1 letter, 2 digit, 3 usual punctuation, 4 space, 0 symbol
_KIND[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_KIND[48:58] = 2
_KIND[[ord(c) for c in ".,;:?'\"()-"]] = 3
_KIND[[9, 10, 11, 12, 13, 32]] = 4


def measures(text: bytes) -> np.ndarray | None:
    """The labellers' measures of a text; NaN where one does not apply, None without words."""
    data = np.frombuffer(text, dtype=np.uint8)
    start, end = word_bounds(data) if len(data) else (np.zeros(0, int), np.zeros(0, int))
    n = len(start)
    if not n:
        return None
    kind = _KIND[data]
    count = np.bincount(data, minlength=256)
    capitals, letters = count[65:91].sum(), count[65:91].sum() + count[97:123].sum()
    of = lambda mask: np.add.reduceat(mask.view(np.int8), start, dtype=np.int32)  # noqa: E731  spaces count for nothing here
    symbol, solid = of(kind == 0), of((kind == 1) | (kind == 2))
    hashes = word_hashes(text)
    repeats = np.nan
    if n >= LEAST_WORDS:
        four = hashes[:-3] * U64(3) + hashes[1:-2] * U64(5) + hashes[2:-1] * U64(7) + hashes[3:] * U64(11)
        repeats = 1 - len(np.unique(four)) / len(four)
    lines = [x for x in text.split(b"\n") if x.strip()]
    same = 1 - len(set(lines)) / len(lines) if len(lines) >= LEAST_LINES else np.nan
    return np.array([(kind == 0).mean(), (solid == 0).mean(), capitals / letters if letters else np.nan, repeats,
                     (end - start > 25).mean(), ((symbol > 0) & (solid > 0)).mean(), same])


_LOW, _HIGH = np.array([x[1] for x in LABELLERS]), np.array([x[2] for x in LABELLERS])
NAMES = (*[x[0] for x in LABELLERS], "plain")  # the last votes good if all measures are low


def votes(measured: np.ndarray | None) -> np.ndarray:
    """One vote (bad -1, abstain 0, good 1) of each labeller in ``NAMES``."""
    out = np.zeros(len(NAMES), dtype=np.int8)
    if measured is not None:
        with np.errstate(invalid="ignore"):
            out[:-1] -= measured >= _HIGH
            out[-1] = not (measured > _LOW).any()
    return out


def pattern(vote: np.ndarray) -> int:
    """Which labellers voted, as bits."""
    return int(((vote != 0) << np.arange(len(vote))).sum())


def vote_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(pattern, n): how many documents have each pattern of votes."""
    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([pattern(votes(measures(t.as_py()))) for t in b.column(0)], pa.int32())], names=["pattern"])

    return docs.select(text_bytes(text).alias("t")).mapInArrow(run, "pattern int").groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))


_SIDE = np.array([*[-1] * len(LABELLERS), 1])  # what each labeller votes, if it votes


@dataclass
class LabelModel:
    """accuracy: P(a labeller's vote is right), in the order of ``NAMES``."""

    accuracy: np.ndarray

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """Probability of good for each pattern of votes."""
        voted = patterns[:, None] >> np.arange(len(NAMES)) & 1
        odds = voted @ (_SIDE * np.log(self.accuracy / (1 - self.accuracy)))
        return 1 / (1 + np.exp(-np.clip(odds, -60, 60)))


def fit_labels(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100, start: float = 0.8, weight: float = 10.0) -> LabelModel:
    """Expectation-maximisation; labellers start better than chance, with so much weight in documents."""
    model = LabelModel(np.full(len(NAMES), start))
    voted = patterns[:, None] >> np.arange(len(NAMES)) & 1
    for _ in range(rounds):
        good = model.posterior(patterns)
        right = np.where(_SIDE > 0, good[:, None], 1 - good[:, None])
        share = ((counts[:, None] * voted * right).sum(axis=0) + weight * start) / ((counts[:, None] * voted).sum(axis=0) + weight)
        model = LabelModel(np.clip(share, 0.05, 0.999))
    return model


def features(text: bytes, measured: np.ndarray | None, buckets: int) -> np.ndarray:
    """Hashed byte trigrams (square roots of their shares) and hashed bins of the measures."""
    out = np.zeros(buckets, dtype=np.float32)
    data = np.frombuffer(text, dtype=np.uint8).astype(U64)
    if len(data) >= 3:
        gram = mix((data[:-2] << U64(16)) | (data[1:-1] << U64(8)) | data[2:]) % U64(buckets)
        out += np.sqrt(np.bincount(gram.astype(np.int64), minlength=buckets) / len(gram))
    if measured is not None:
        bins = np.where(np.isnan(measured), 31, np.minimum(np.nan_to_num(measured) * 20, 20).astype(int))
        named = mix(np.arange(len(bins), dtype=U64) * U64(64) + bins.astype(U64) + U64(1 << 40)) % U64(buckets)
        np.add.at(out, named.astype(np.int64), 1.0)
    return out


@dataclass
class Model:
    labels: LabelModel
    weights: np.ndarray  # by bucket, last the intercept
    settings: Settings

    def score(self, text: bytes, measured: np.ndarray | None) -> float:
        if measured is None:
            return 0.0
        x = features(text, measured, self.settings.buckets)
        return float(1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -60, 60))))


def fit_scorer(x: np.ndarray, y: np.ndarray, s: Settings) -> np.ndarray:
    """Logistic regression with soft labels; both classes weigh the same."""
    w = np.zeros(x.shape[1] + 1)
    if not len(x):
        return w
    weight = y / max(y.sum(), 1e-9) / 2 + (1 - y) / max((1 - y).sum(), 1e-9) / 2
    for _ in range(s.epochs):
        error = weight * (y - 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -60, 60))))
        w[:-1] += s.rate * (x.T @ error - s.decay * w[:-1])
        w[-1] += s.rate * error.sum()
    return w


def train(docs: DataFrame, s: Settings = Settings(), key: str = "doc_id", text: str = "text") -> Model:
    """The label model from all documents, the scorer from a bounded sample of them."""
    counted = vote_counts(docs, text).collect()  # at most 2 ** labellers rows
    labels = fit_labels(np.array([r.pattern for r in counted], dtype=np.int64), np.array([r.n for r in counted], dtype=float), s.rounds)
    hashed = docs.select(F.xxhash64(key, text).alias("h"), text_bytes(text).alias("t"))
    # the limit comes from hashes alone, so that only the sample's texts move
    last = hashed.select("h").orderBy("h").limit(s.sample).agg(F.max("h")).first()[0]
    if last is None:
        return Model(labels, np.zeros(s.buckets + 1), s)

    def run(batches):
        for b in batches:
            rows = [(t, measures(t)) for t in (x.as_py() for x in b.column(0))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([pattern(votes(m)) for _, m in rows], pa.int32()),
                 pa.array([features(t, m, s.buckets).tobytes() for t, m in rows], pa.binary())], names=["pattern", "x"])

    sample = hashed.filter(F.col("h") <= last).limit(s.sample).select("t").mapInArrow(run, "pattern int, x binary").collect()
    x = np.stack([np.frombuffer(r.x, dtype=np.float32) for r in sample])
    y = labels.posterior(np.array([r.pattern for r in sample], dtype=np.int64))
    return Model(labels, fit_scorer(x, y, s), s)


def judge(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, label, score, accepted): posterior of the votes, the scorer's probability of good, the decision."""
    kind = dict(docs.dtypes)[key]

    def run(batches):
        m = model  # a few kilobytes, whatever the input
        for b in batches:
            pats, scores = [], []
            for cell in b.column(1):
                t = cell.as_py()
                measured = measures(t)
                pats.append(pattern(votes(measured)))
                scores.append(m.score(t, measured))
            label = m.labels.posterior(np.array(pats, dtype=np.int64)) if pats else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(label, pa.float64()), pa.array(scores, pa.float64()), pa.array([x >= m.settings.accept for x in scores], pa.bool_())],
                names=["key", "label", "score", "accepted"])

    return docs.select(F.col(key).alias("key"), text_bytes(text).alias("t")).mapInArrow(
        run, f"key {kind}, label double, score double, accepted boolean").withColumnRenamed("key", key)


def keep(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are accepted, with all their columns."""
    at, names = docs.columns.index(text), docs.columns

    def run(batches):
        m = model  # a few kilobytes, whatever the input
        for b in batches:
            texts = [(x.as_py() or "").encode() for x in b.column(at)]
            good = pa.array([m.score(t, measures(t)) >= m.settings.accept for t in texts], pa.bool_())
            yield pa.RecordBatch.from_arrays([c.filter(good) for c in b.columns], names=names)

    return docs.mapInArrow(run, docs.schema)
