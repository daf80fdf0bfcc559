"""The corpus pipeline as a whole: every stage's output against its input, by plain Python, and defined results."""

import re

import pytest

import corpus_pipeline
from claimspark.llm import decontaminate, quality
from claimspark.session import materialize, new_dir
from tests.llm.test_near_copies import brute_force

SF = "/root/testdata/sf0.001"
# names that stages use inside
EXTRA = {"t": "x", "key": 1, "h": 2, "blob": "b", "ids": "i", "_text_bytes": "y", "__spans": "s", "decoded": "d", "label": 0.5, "row": 3}
ASSIGN = re.compile(r"""(?i:(?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def folder(spark, rows, bench):
    """A data folder with such documents, in several files, and test items."""
    at = new_dir(spark, "corpus")
    schema = "doc_id long, text string, lang string, source string, n_chars long, t string, key int, h int, blob string, ids string, _text_bytes string, `__spans` string, decoded string, label double, `row` int"
    full = [(d, t, None if d is None or d % 3 == 0 else "en", None, None if t is None else len(t), *EXTRA.values()) for d, t in rows]
    spark.createDataFrame(full, schema).repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


@pytest.fixture(scope="module")
def stages(spark):
    """Input and output of every stage."""
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    bench = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()] + [(None, None), (901, "")]
    long = [t for _, t in docs if len(t) > 1500][:8]
    rows = docs + [(10_000 + k, f"{t} One more closing remark.") for k, t in enumerate(long[:4])]
    rows += [(10_100 + k, f"{t}\n{i[1]}") for k, (t, i) in enumerate(zip(long[4:], bench))]
    rows += [(10_200, f"{long[0][:900]} the password = Abcdef123456789 and token: \"zzzz9999yyyy8888\" ends here. 😀 é")]
    rows += [(10_300, None), (10_301, ""), (None, long[1]), (None, None), (10_302, " \n\t"), (10_303, " ".join([long[2]] * 60))]
    rows += docs[:5]
    at = folder(spark, rows, bench)
    frames = [spark.read.parquet(f"{at}/documents.parquet")]
    for _, stage in corpus_pipeline.STAGES:
        frames.append(materialize(stage(spark, frames[-1], at)))
    return at, frames


def pairs(frame):
    return sorted(((r.doc_id, r.text) for r in frame.collect()), key=repr)


def test_stages_keep_the_columns_of_documents(stages):
    _, frames = stages
    assert all(f.dtypes == frames[0].dtypes for f in frames[1:-1])
    assert frames[1].count() > 100


def test_quality_stage_keeps_what_its_scorer_accepts(spark, stages):
    _, (docs, kept, *_) = stages
    model = quality.train(docs)
    want = [p for p in pairs(docs) if model.score((p[1] or "").encode(), quality.measures((p[1] or "").encode())) >= model.settings.accept]
    assert pairs(kept) == want


def test_near_duplicate_stage_keeps_one_of_each_group(stages):
    _, (_, docs, kept, *_) = stages
    keyed = sorted({p for p in pairs(docs) if p[0] is not None})
    want = set(brute_force([(d, t, "x") for d, t in keyed]).values())
    got = pairs(kept)
    assert sorted(d for d, _ in got if d is not None) == sorted(want) and len(want) < len(keyed)
    assert [p for p in got if p[0] is None] == [p for p in pairs(docs) if p[0] is None]


def test_leak_stage_drops_exactly_the_documents_with_an_item(spark, stages):
    at, (_, _, docs, kept, *_) = stages
    items = [[decontaminate.shingles(p, 5) for p in decontaminate.parts_of((r.text or "").encode())] for r in spark.read.parquet(f"{at}/benchmark.parquet").collect()]

    def leaks(text):
        has = b" " + b" ".join(decontaminate.words((text or "").encode())) + b" "
        return any(p[1] and min(sum(b" " + g + b" " in has for g in x) / len(x) for x in p) >= 0.8 for p in items)

    assert pairs(kept) == [p for p in pairs(docs) if not leaks(p[1])] and kept.count() < docs.count()


def test_secret_stage_changes_secrets_only(stages):
    _, (*_, docs, kept, _) = stages
    before, after = dict(pairs(docs)), dict(pairs(kept))
    assert before.keys() == after.keys() and docs.count() == kept.count()
    for d, text in after.items():
        left, found = before[d] or "", text or ""
        assert not [m for m in ASSIGN.finditer(found) if len(m[1]) >= 12]
        pattern = ".+?".join(re.escape(x) for x in found.split("[SECRET]"))
        assert re.fullmatch(pattern, left, re.S)
        if not [m for m in ASSIGN.finditer(left) if len(m[1]) >= 12] and not re.search("AKIA|[0-9a-f]{16}", left):
            assert "[SECRET]" not in found or "[SECRET]" in left or re.search("[A-Za-z0-9+/_=-]{16}", left)
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in kept.collect())


def test_tokens_decode_to_the_texts(stages):
    _, (*_, docs, coded) = stages
    assert pairs(coded) == sorted(((d, t or "") for d, t in pairs(docs)), key=repr)
    assert all(r.n_tokens == len(r.ids) for r in coded.collect())


def test_run_is_its_stages(spark, stages):
    at, frames = stages
    assert pairs(corpus_pipeline.run(spark, at)) == pairs(frames[-1])


def test_empty_tables(spark):
    assert corpus_pipeline.run(spark, folder(spark, [], [])).count() == 0
