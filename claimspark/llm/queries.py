"""The registered queries of the corpus operators and the SQL twins of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimspark.session import materialize

from . import ann, bpe, centroids, decontaminate, html_text, phrases, quality, rnn_lm, secrets, simhash, substrings, urls, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if oracle is not None:
            ORACLES[fn.__name__] = oracle
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query()
def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    back = bpe.decode(bpe.encode(docs).select("doc_id", "ids"))
    return back.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


@query()
def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = secrets.findings(secrets.versions(docs), materialize(secrets.scan(docs)))
    base = F.filter("spans", lambda s: s["kind"].isin(*secrets.BASE))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        F.col("path").alias("doc_id"), *[count(k).alias(f"n_{k}") for k in secrets.BASE],
        F.sha2(secrets.span_text(base).cast("binary"), 256).alias("base_sha256"), secrets.span_text(F.col("spans")).alias("spans"))


@query()
def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.judge(pages, materialize(urls.train(urls.labels_of_rules(pages))))


@query()
def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    found = materialize(html_text.subtrees(pages))
    known = materialize(html_text.templates(found))
    return html_text.main_text(pages, known, found=found).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


@query()
def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.judge(docs, quality.train(docs))


@query()
def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


@query()
def op9_rnn_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rnn_lm.fit_and_score(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("""with w as (select doc_id, unnest(ws) as word, generate_subscripts(ws, 1) as i from (select doc_id,
    list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as ws from documents)),
p as (select doc_id, i, word, string_agg(word, ' ') over v as win, count(*) over v as k from w
  window v as (partition by doc_id order by i rows between current row and 12 following)),
f as (select win, min(doc_id) as least_doc from p where k = 13 group by win),
s as (select p.doc_id, i, word, max(case when k = 13 and least_doc < p.doc_id then 1 else 0 end)
    over (partition by p.doc_id order by i rows between 12 preceding and current row) as gone
  from p left join f on p.win = f.win)
select d.doc_id, count(word) as n_words, cast(coalesce(sum(gone), 0) as bigint) as n_removed,
  sha256(coalesce(string_agg(word, ' ' order by i) filter (where gone = 0), '')) as kept_sha256
from documents d left join s on s.doc_id = d.doc_id group by d.doc_id""")
def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = substrings.remove(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query("""with v as (select vec_id, list_transform(embedding, lambda x: x::double) as e from embeddings
  where list_bool_and(list_transform(embedding, lambda x: x is not null and isfinite(x))) and list_bool_or(list_transform(embedding, lambda x: x <> 0))),
p as (select q.vec_id as query_id, c.vec_id, list_inner_product(q.e, c.e) as score
  from v q join v c on c.vec_id <> q.vec_id where q.vec_id % 20 = 0)
select * from (select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score from p)
where rank <= 20""")
def op2_rotated_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.search(vectors, vectors.filter(F.col("vec_id") % 20 == 0))


@query()
def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def clusters_sql(rounds: int = 3) -> str:
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""a{r} as materialized (select rid, vec_id, e, arg_min(c, (d, c)) as c, min(d) as d from (select v.rid, v.vec_id, v.e, c.c,
  cast(list_sum(list_transform(list_zip(v.e, c.e), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) as bigint) as d from v cross join c{r} c) group by all)""")
        if r < rounds:
            steps.append(f"""m{r} as (select c, list((s - ((s % n) + n) % n) // n order by i) as e from (select c, i, cast(sum(x) as bigint) as s, count(*) as n
  from (select c, unnest(e) as x, generate_subscripts(e, 1) as i from a{r}) group by c, i) group by c),
c{r + 1} as materialized (select c.c, coalesce(m.e, c.e) as e from c{r} c left join m{r} m on m.c = c.c)""")
    return f"""with v as materialized (select row_number() over () as rid, vec_id, list_transform(embedding, lambda x: cast(floor(64 * x::double) as bigint)) as e
  from embeddings where len(embedding) = 64 and list_bool_and(list_transform(embedding, lambda x: x is not null and isfinite(x)))),
c0 as materialized (select row_number() over (order by h nulls last, e) - 1 as c, e from (select sha256('1:' || vec_id) as h, e from v order by h nulls last, e limit 16)),
{", ".join(steps)}
select vec_id, cast(a.c as integer) as cluster, d as distance, cast(sum(d) over (partition by a.c) as bigint) as cluster_inertia,
  cast(sum(d) over () as bigint) as inertia, sha256(array_to_string(c.e, ',')) as centroid_sha256
from a{rounds} a join c{rounds} c on c.c = a.c"""


@query(clusters_sql())
def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


@query("""select page_id, octet_length(encode(h)) as payload_bytes, array_to_string(list_transform(range(8), lambda g: array_to_string(list_transform([15, 10, 5, 0],
    lambda b: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + ((('0x' || substr(sha1(h), 1 + 5 * g::int, 5))::int >> b::int) & 31)]), '')), '') as payload_digest,
  case when page_id is not distinct from m then 'response' else 'revisit' end as record_type, case when page_id is distinct from m then m end as refers_to
from (select page_id, h, max(page_id) over (partition by h) as m from (select page_id, coalesce(html, '') as h from pages))""")
def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = warc.round_trip(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return back.select(F.col("key").alias("page_id"), F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"),
                       F.col("type").alias("record_type"), "refers_to")


@query("""with t as (select coalesce(lang, 'und') as lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as x from documents),
p as (select lang, unnest(string_split_regex(x, '[.,;:!?\x0A-\x0D]')) as x from t),
w as (select lang, list_filter(string_split_regex(x, '[\x20\x09]+'), lambda y: y <> '') as ws from p),
g as (select lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) as phrase from w, range(1, 5) r(k)),
f as materialized (select lang, k, phrase, count(*) as f from g group by all),
n as (select lang, cast(sum(f) as bigint) as n from f where k = 1 group by lang),
c as materialized (select * from f where k > 1 and f >= 30),
h as materialized (select lang, k, phrase, f as a, j, array_to_string(string_split(phrase, ' ')[:j], ' ') as head, array_to_string(string_split(phrase, ' ')[j + 1:], ' ') as rest
  from c, range(1, 4) q(j) where j < k),
s as (select h.lang, h.phrase, h.k, a, x.f as l, y.f as r, j, cast((2000000::hugeint * a) // (x.f + y.f) as bigint) as score
  from h join f x on x.lang = h.lang and x.phrase = h.head join f y on y.lang = h.lang and y.phrase = h.rest),
m as (select lang, phrase, k, any_value(a) as a, unnest(arg_min({'l': l, 'r': r, 'score': score}, (score, j))) from s group by lang, phrase, k),
e as (select * from m where not exists (select 1 from c where c.lang = m.lang and c.k > m.k and 100 * c.f >= 80 * m.a
  and contains(' ' || c.phrase || ' ', ' ' || m.phrase || ' '))),
o as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from e)
select o.lang, rank, phrase, a, l, r, n, score from o join n on n.lang = o.lang where rank <= 2000""")
def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents").select("lang", "text"))
