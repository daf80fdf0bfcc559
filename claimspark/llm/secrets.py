"""Secret scans with an incremental ledger of content-addressed blobs.

Every historical version of a text is addressed by the SHA-256 of its content. The ledger holds
one row per blob and scan: the rule versions that were applied and the spans they found. A scan
looks only at pairs of blob and rule version that the ledger lacks, once per blob however many
paths hold it, and ``findings`` joins the spans back to all paths.

Spans are in code points, end exclusive, ordered by start, then by the rules' order. Defined
results: a null text is an empty one and has no spans; repeated rows are one blob; an empty table
gives an empty ledger; columns other than key and text are not read, so their names do not matter.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import unused_prefix


@dataclass(frozen=True)
class Rule:
    """A pattern; ``least`` characters of its group are needed, else the match is dropped."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0
    any_case: bool = False
    needs: tuple[str, ...] = ()  # a text without any of these (lower case) cannot match
    version: int = 1

    @property
    def id(self) -> str:
        return f"{self.kind}@{self.version}"


# The three base kinds in their order, then further well-known token formats.
BASE = ("assign", "access", "hex")
RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
         12, 2, True, ("passw", "secret", "token", "api")),
    Rule("access", r"AKIA[A-Z0-9]+", 18, needs=("akia",)),
    Rule("hex", r"[0-9a-f]{16,}", 16),  # runs shorter than the least length are dropped anyway
    Rule("pem", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----", needs=("private key",)),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{30,}", needs=("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    Rule("slack", r"xox[abeprs]-[A-Za-z0-9-]{10,}", needs=("xox",)),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", needs=("eyj",)),
)
SPANS = "array<struct<kind:string,start:int,end:int>>"


class Scanner:
    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = [(r, re.compile(r.pattern, re.ASCII | (re.IGNORECASE if r.any_case else 0)), [n.encode() for n in r.needs])
                      for r in rules]

    def spans(self, raw: bytes, wanted: set[str]) -> list[dict]:
        low = raw.lower()  # A-Z only
        text, found = None, []
        for order, (rule, pattern, needs) in enumerate(self.rules):
            if rule.id not in wanted or needs and not any(n in low for n in needs):
                continue
            text = raw.decode("utf-8", "replace") if text is None else text
            found += [(m.start(), order, rule.kind, m.end()) for m in pattern.finditer(text)
                      if m.end(rule.group) - m.start(rule.group) >= rule.least]
        return [{"kind": k, "start": s, "end": e} for s, _, k, e in sorted(found)]


def content(text: str) -> Column:
    return F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")


def versions(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(path, blob): the content address of each path's text."""
    return docs.select(F.col(key).alias("path"), F.unhex(F.sha2(content(text), 256)).alias("blob"))


def unseen(paths: DataFrame, ledger: DataFrame | None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, path, missing): blobs that lack rule versions, with one path that holds each."""
    ids = F.array(*[F.lit(r.id) for r in rules])
    blobs = paths.groupBy("blob").agg(F.min("path").alias("path"))
    if ledger is None:
        return blobs.withColumn("missing", ids)
    seen = ledger.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_set("rules"))).alias("seen"))
    missing = F.array_except(ids, F.coalesce("seen", F.array().cast("array<string>")))
    return blobs.join(seen, "blob", "left").select("blob", "path", missing.alias("missing")).filter(F.size("missing") > 0)


def scan(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES,
         key: str = "doc_id", text: str = "text") -> DataFrame:
    """New ledger rows (blob, rules, spans) for the pairs that ``ledger`` lacks."""
    stored = docs.select(F.col(key).alias("path"), content(text).alias("content")).withColumn("blob", F.unhex(F.sha2("content", 256)))
    # null paths meet each other too; the key beside the blob keeps a third of all rows with one text apart
    todo = unseen(stored.select("path", "blob"), ledger, rules).withColumnsRenamed({"path": "_path", "blob": "_blob"})
    once = stored.join(todo.hint("shuffle_hash"), (F.col("blob") == F.col("_blob")) & F.col("path").eqNullSafe(F.col("_path")))
    return apply_rules(once.select("blob", "missing", "content"), rules)


def apply_rules(blobs: DataFrame, rules: tuple[Rule, ...], blob: str = "blob", missing: str = "missing", text: str = "content") -> DataFrame:
    """Ledger rows of a table with a blob, the rule versions to apply and the text."""
    names = blobs.columns
    blob_at, missing_at, text_at = (names.index(blob), names.index(missing), names.index(text))

    def run(batches):
        scanner = Scanner(rules)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for b in batches:
            done: dict[bytes, list] = {}  # repeated rows of one path in a batch
            for blob, wanted, raw in zip(b.column(blob_at).to_pylist(), b.column(missing_at).to_pylist(), b.column(text_at)):
                if blob not in done:
                    raw = raw.as_py() or b""
                    done[blob] = [wanted, scanner.spans(raw.encode() if isinstance(raw, str) else raw, set(wanted))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(done), pa.binary()), pa.array([w for w, _ in done.values()], pa.list_(pa.string())),
                 pa.array([s for _, s in done.values()], kind)], names=["blob", "rules", "spans"])

    return blobs.mapInArrow(run, f"blob binary, rules array<string>, spans {SPANS}")


def current(ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, spans) of the blobs with findings, in order; scans of a blob by different rules are united.

    A rule's earlier versions have the same kind; only spans of scans that applied the current
    version of the kind count.
    """
    ids = F.create_map(*[x for r in rules for x in (F.lit(r.kind), F.lit(r.id))])
    order = F.create_map(*[x for k, r in enumerate(rules) for x in (F.lit(r.kind), F.lit(k))])
    valid = F.filter("spans", lambda s: F.array_contains("rules", F.element_at(ids, s["kind"])))
    one = ledger.filter(F.size("spans") > 0).select("blob", valid.alias("spans"))
    many = one.groupBy("blob").agg(F.flatten(F.collect_set("spans")).alias("spans"))
    keyed = F.transform(F.array_distinct("spans"), lambda s: F.struct(s["start"].alias("start"), F.element_at(order, s["kind"]).alias("o"), s["end"].alias("end"), s["kind"].alias("kind")))
    back = F.transform(F.array_sort(keyed), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return many.select("blob", back.alias("spans"))


def findings(paths: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(path, blob, spans) for every path; no findings give an empty array."""
    none = F.array().cast(SPANS)
    return paths.join(current(ledger, rules), "blob", "left").select("path", "blob", F.coalesce("spans", none).alias("spans"))


def span_text(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def redact(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES,
           key: str = "doc_id", text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every secret replaced by ``mark``; overlapping spans become one mark.

    All columns and rows stay. The texts are shuffled once, by content and path: the scan of
    unseen blobs and the replacement in all paths read the same exchange.
    """
    columns, at = docs.columns, docs.columns.index(text)
    mine = unused_prefix(docs)
    blob, path = f"{mine}blob", F.col(f"`{key}`")
    stored = docs.withColumn(blob, F.unhex(F.sha2(content(text), 256))).repartition(blob, key)
    todo = unseen(versions(docs, key, text), ledger, rules).select(F.col("path").alias(f"{mine}path"), F.col("blob").alias(f"{mine}todo"), F.col("missing").alias(f"{mine}missing"))
    once = stored.join(todo.hint("shuffle_hash"), (F.col(blob) == F.col(f"{mine}todo")) & path.eqNullSafe(F.col(f"{mine}path")))
    fresh = apply_rules(once, rules, blob, f"{mine}missing", text)
    known = fresh if ledger is None else fresh.unionByName(ledger)
    found = findings(versions(docs, key, text), known, rules).filter(F.size("spans") > 0).dropDuplicates(["blob", "path"])
    found = found.select(F.col("path").alias(f"{mine}path"), F.col("blob").alias(f"{mine}todo"), F.col("spans").alias(f"{mine}spans"))
    joined = stored.join(found.hint("shuffle_hash"), (F.col(blob) == F.col(f"{mine}todo")) & path.eqNullSafe(F.col(f"{mine}path")), "left")

    def run(batches):
        for b in batches:
            spans = b.column(len(columns))
            arrays = list(b.columns)[: len(columns)]
            if spans.null_count < len(spans):
                arrays[at] = pa.array([t.as_py() if s is None else replace(t.as_py(), s, mark) for t, s in zip(arrays[at], spans.to_pylist())], pa.string())
            yield pa.RecordBatch.from_arrays(arrays, names=columns)

    return joined.select(*[F.col(f"`{c}`") for c in columns], f"{mine}spans").mapInArrow(run, docs.schema)


def replace(text: str, spans: list[dict], mark: str) -> str:
    out, end = [], 0
    for s in spans:
        if s["start"] >= end:
            out += [text[end : s["start"]], mark]
        end = max(end, s["end"])
    return "".join(out) + text[end:]
