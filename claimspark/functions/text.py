"""Labels, identifiers, keyword lists and capture metadata inside text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import constants as K


def sanitize_claim_id(raw: Column, fallback: Column) -> Column:
    """Letters, digits, ``_`` and ``-`` only, at most 80 characters, else the fallback."""
    kept = F.substring(F.regexp_replace(F.coalesce(raw, F.lit("")), "[^A-Za-z0-9_-]", ""), 1, 80)
    return F.coalesce(F.nullif(kept, F.lit("")), fallback)


# Canonical damage label per keyword, first listed keyword wins.
LABEL_KEYWORDS = (
    ("scratch", "scratch"), ("dent", "dent"), ("paint", "paint trace"),
    ("head", "head light damage"), ("tail", "taillight damage"), ("mirror", "sidemirror damage"),
    ("sign", "signlight damage"), ("windshield", "windshield damage"), ("window", "window damage"),
)


def flat_label(label: Column) -> Column:
    """Lower case, separators as single blanks."""
    flat = F.translate(F.lower(F.coalesce(label, F.lit(""))), "_-", "  ")
    return F.trim(F.regexp_replace(flat, r"\s+", " "))


def canonical_label(flat: Column) -> Column:
    """Canonical label of a flattened one."""
    rules = [F.when(F.contains(flat, F.lit(word)), F.lit(name)) for word, name in LABEL_KEYWORDS]
    return F.coalesce(*rules, flat)


def normalize_damage_label(label: Column) -> Column:
    """Canonical label; the flattened text is bound once instead of once per keyword."""
    return F.get(F.transform(F.array(flat_label(label)), canonical_label), F.lit(0))


def with_label_norm(df: DataFrame) -> DataFrame:
    """Add ``label_norm``. The flattened label stays a column of its own, so generated code
    evaluates it once per row."""
    return (df.withColumn("_flat", flat_label(F.col("label")))
            .withColumn("label_norm", canonical_label(F.col("_flat"))).drop("_flat"))


def allowed_classes(reported: Column) -> Column:
    """Set of canonical labels a claimant reported; NULL means no restriction."""
    raw = F.trim(reported)
    parts = F.transform(F.split(raw, "[,;]"), flat_label)
    names = F.array_distinct(F.transform(F.filter(parts, lambda p: p != ""), canonical_label))
    open_ended = F.lower(raw).isin("", "unspecified", "all", "none")
    return F.when(raw.isNull() | open_ended, None).otherwise(F.when(F.size(names) > 0, names))


def normalize_severity(value: Column) -> Column:
    """Canonical severity, or NULL for a value outside the domain (never guessed)."""
    s = F.lower(F.trim(value))
    return F.when(s.isin(*K.SEVERITIES), s)


def normalize_bool(value: Column) -> Column:
    return F.coalesce(F.lower(F.trim(value)).isin(*K.TRUE_WORDS), F.lit(False))


def status_label(status: Column) -> Column:
    from .numbers import choose

    return choose(status, K.STATUS_LABELS, F.upper(F.replace(status, F.lit("_"), F.lit(" "))))


def first_keyword(haystack: Column, words) -> Column:
    """First entry of ``words`` (list order, not text order) contained in the text."""
    return F.coalesce(*[F.when(F.contains(haystack, F.lit(w)), F.lit(w)) for w in words])


def any_keyword(haystack: Column, words) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(haystack, F.lit(w)) for w in words])


def search_any(query: str, *fields: Column) -> Column:
    """Case-insensitive contains over several fields; a blank query matches everything."""
    q = query.strip().lower()
    if not q:
        return F.lit(True)
    hit = lambda c: F.contains(F.lower(F.coalesce(c.cast("string"), F.lit(""))), F.lit(q))
    return reduce(lambda a, b: a | b, [hit(c) for c in fields])


def nonempty(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def extract_capture_ts(body: Column) -> Column:
    """First ISO date-time in the text, else the first colon-separated one."""
    iso = F.regexp_extract(body, r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}", 0)
    colon = F.regexp_extract(body, r"\d{4}:\d{2}:\d{2} \d{2}:\d{2}:\d{2}", 0)
    return F.coalesce(nonempty(iso), nonempty(colon))


def parse_capture_ts(text: Column) -> Column:
    """Capture time from the first 19 characters in one of three layouts."""
    head = F.substring(text, 1, 19)
    layouts = ("yyyy-MM-dd'T'HH:mm:ss", "yyyy:MM:dd HH:mm:ss", "yyyy-MM-dd HH:mm:ss")
    return F.coalesce(*[F.try_to_timestamp(head, F.lit(f)) for f in layouts])


ISO6709 = r"([+-]\d{2,3}\.\d{3,})\s*([+-]\d{2,3}\.\d{3,})"


def extract_iso6709(body: Column) -> Column:
    """Struct (lat, lon) of the first ISO 6709 pair, NULL when absent or out of range."""
    coord = lambda g: F.regexp_extract(body, ISO6709, g).try_cast("double")
    lat, lon = coord(1), coord(2)
    usable = lat.between(-90, 90) & lon.between(-180, 180) & ~((lat == 0) & (lon == 0))
    return F.when(usable, F.struct(lat.alias("lat"), lon.alias("lon")))


def gps_dms_to_decimal(text: Column, ref: Column) -> Column:
    """Degrees, minutes and seconds (integers or fractions) to decimal degrees.

    Only digit runs and fractions are tokens, so ``29.45`` reads as the two tokens
    29 and 45; fewer than three tokens give NULL.
    """
    tokens = F.regexp_extract_all(text, F.lit(r"(\d+(?:/\d+)?)"), F.lit(1))

    def number(tok: Column) -> Column:
        num = F.split_part(tok, F.lit("/"), F.lit(1)).cast("double")
        den = F.nullif(F.split_part(tok, F.lit("/"), F.lit(2)), F.lit("")).cast("double")
        return num / F.when(den.isNull(), 1.0).otherwise(F.greatest(den, F.lit(1e-9)))

    terms = F.transform(tokens, lambda tok, i: F.when(i < 3, number(tok) / F.pow(F.lit(60.0), i)).otherwise(0.0))
    zero = F.struct(F.lit(0.0).alias("v"), F.lit(0).alias("n"))
    add = lambda acc, x: F.struct((acc["v"] + x).alias("v"), (acc["n"] + 1).alias("n"))
    value = F.aggregate(terms, zero, add, lambda acc: F.when(acc["n"] >= 3, acc["v"]))
    return F.when(ref.isin("S", "W"), F.lit(-1.0)).otherwise(F.lit(1.0)) * value
