"""URL filters: host and path rules, and for the rest a logistic regression, all in DataFrame functions.

The regression sees hashed character n-grams of host and path. It is trained by full-batch
gradient descent on a small labelled table; training and scoring are built-in expressions, without
Python on the executors. The labelled table is bounded by ``sample`` rows a class, so its n-grams
and their inverted lists fit in one row; every URL is scored.

Defined results: a null URL or one without ``://`` has empty host and path and no rule; the empty
text has no n-grams and gets the intercept's verdict; without labelled rows all weights are zero
and the verdict is allow (block needs a positive score). Repeated rows are judged alike and count
once in training. Only the key and the URL are read, so other columns' names do not matter.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The rules, as verdict, host and path.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


@dataclass(frozen=True)
class Settings:
    buckets: int = 4096
    grams: tuple[int, ...] = (3, 4)
    sample: int = 1000  # labelled URLs of each class, those with the smallest hashes
    epochs: int = 60
    rate: float = 8.0
    decay: float = 1e-4


def host(url: str = "url") -> Column:
    return F.translate(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), PARTS, 1), UPPER, LOWER)


def path(url: str = "url") -> Column:
    return F.regexp_extract(F.coalesce(F.col(url), F.lit("")), PARTS, 2)


def matched(rules=RULES, host_col: str = "host", path_col: str = "path", field: int | None = None) -> Column:
    """The longest fitting rule (``host/path`` text), or with ``field`` 0 its verdict; null if none fits."""
    longest_first = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    out = None
    for r in longest_first:
        h = F.col(host_col)
        fits = ((h == r[1]) | h.endswith(f".{r[1]}")) & F.col(path_col).startswith(r[2])
        value = F.lit(r[1] + r[2] if field is None else r[field])
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out if out is not None else F.lit(None).cast("string")


def buckets(s: Settings, host_col: str = "host", path_col: str = "path") -> Column:
    """Distinct buckets of the n-grams of ``^host$`` and ``^path$``, told apart by a leading letter."""
    def of(mark: str, text: str, n: int) -> Column:
        chars = F.split(F.concat(F.lit("^"), F.col(text), F.lit("$")), "")
        starts = F.when(F.size(chars) >= n, F.sequence(F.lit(0), F.size(chars) - n)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.pmod(F.xxhash64(F.lit(mark), *[chars[i + k] for k in range(n)]), F.lit(s.buckets)).cast("int"))
    return F.array_distinct(F.concat(*[of(m, t, n) for m, t in (("h", host_col), ("p", path_col)) for n in s.grams]))


def labelled(urls: DataFrame, s: Settings) -> DataFrame:
    """(y, f): at most ``sample`` distinct labelled (host, path) of each class; y is 1 for block."""
    distinct = urls.filter(F.col("label").isNotNull()).dropDuplicates(["host", "path", "label"])
    order = [F.xxhash64("host", "path"), F.col("host"), F.col("path")]
    classes = [distinct.filter(F.col("label") == c).orderBy(*order).limit(s.sample) for c in ("allow", "block")]
    return classes[0].unionByName(classes[1]).select((F.col("label") == "block").cast("double").alias("y"), buckets(s).alias("f"))


def train(urls: DataFrame, s: Settings = Settings()) -> DataFrame:
    """One row (w): the weights by bucket and, last, the intercept, from (host, path, label).

    Each class weighs one half and each URL's features have length one.
    """
    rows = labelled(urls, s).agg(F.collect_list(F.struct("y", "f")).alias("r"))
    counted = rows.select(
        "r", F.size("r").alias("n"),
        F.aggregate("r", F.lit(0.0), lambda a, x: a + x["y"]).alias("pos"))
    ready = counted.select(
        "n",
        F.transform("r", lambda x: F.struct(
            x["y"].alias("y"), x["f"].alias("f"), F.lit(1.0).__truediv__(F.sqrt(F.greatest(F.size(x["f"]), F.lit(1)))).alias("v"),
            F.when(x["y"] > 0, 0.5 / F.col("pos")).otherwise(0.5 / (F.col("n") - F.col("pos"))).alias("c"))).alias("r"))
    # the inverted lists: for each bucket the labelled URLs that have it
    pairs = ready.select(F.posexplode("r").alias("i", "x")).select("i", F.explode("x.f").alias("b"))
    spark = urls.sparkSession
    lists = (spark.range(s.buckets).withColumnRenamed("id", "b").join(pairs, "b", "left").groupBy("b").agg(F.sort_array(F.collect_list("i")).alias("i"))
             .agg(F.transform(F.sort_array(F.collect_list(F.struct("b", "i"))), lambda x: x["i"]).alias("inv")))
    both = ready.select("*", lists.scalar().alias("inv"))

    def error(w: Column) -> Column:
        def one(x):
            z = F.aggregate(x["f"], w[s.buckets], lambda a, b: a + w[b] * x["v"])
            return x["c"] * (x["y"] - 1.0 / (1.0 + F.exp(-z)))
        return F.transform("r", one)

    def step(w: Column) -> Column:
        def moved(st):
            e = st["e"]
            total = F.transform("inv", lambda rows, b: st["w"][b] * (1 - s.rate * s.decay) + s.rate * F.aggregate(
                rows, F.lit(0.0), lambda a, i: a + e[i] * F.col("r")[i]["v"]))
            bias = st["w"][s.buckets] + s.rate * F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
            return F.concat(total, F.array(bias))
        # a one-element transform computes the errors once and names them
        return F.transform(F.array(F.struct(w.alias("w"), error(w).alias("e"))), moved)[0]

    zero = F.array_repeat(F.lit(0.0), s.buckets + 1)
    return both.select(F.aggregate(F.sequence(F.lit(1), F.lit(s.epochs)), zero, lambda w, _: step(w)).alias("w"))


def judge(pages: DataFrame, weights: DataFrame, rules=RULES, s: Settings = Settings(), key: str = "page_id", url: str = "url") -> DataFrame:
    """(key, host, path, rule, verdict, score) of every row; the score decides where no rule fits."""
    parts = pages.select(F.col(key), host(url).alias("host"), path(url).alias("path"))
    ruled = parts.select("*", matched(rules).alias("rule"), matched(rules, field=0).alias("by_rule"), buckets(s).alias("f"), weights.scalar().alias("w"))
    z = F.aggregate("f", F.col("w")[s.buckets], lambda a, b: a + F.col("w")[b] / F.sqrt(F.greatest(F.size("f"), F.lit(1))))
    scored = ruled.select(key, "host", "path", "rule", "by_rule", z.alias("score"))
    verdict = F.coalesce("by_rule", F.when(F.col("score") > 0, "block").otherwise("allow"))
    return scored.select(key, "host", "path", "rule", verdict.alias("verdict"), "score")


def labels_of_rules(pages: DataFrame, rules=RULES, url: str = "url") -> DataFrame:
    """(host, path, label): URLs that rules decide, as labelled examples."""
    return pages.select(host(url).alias("host"), path(url).alias("path")).withColumn("label", matched(rules, field=0))
