"""The registered queries of this package: each operator over its whole table, as a digest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, clustering, divergence, language, media, mixing, near_dedup, packing, quality, secrets, suffix_dedup, token_counts, url_filter
from .tables import cut, table


def tokenizer_path(name: str) -> str:
    """Where the public tokenizers keep that file."""
    import public_tokenizers

    return public_tokenizers.path(name)


#: (verdict, host and path), as op10 fixes them.
RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
    rows = mixing.schedule(cut(docs), "doc_id", "source", "size")
    finish = F.get(F.col("__copies.finish"), F.lit(0))
    rows = rows.select(
        "doc_id", "size", F.col("__source_size").alias("source_size"), F.col("__target").alias("target"),
        F.aggregate("__copies", F.lit(0).cast("long"), lambda total, c: total + c["words"]).alias("taken"), finish.alias("first_finish"),
    )
    return rows.repartitionByRange(F.col("first_finish").asc_nulls_last(), F.col("doc_id")).sortWithinPartitions(F.col("first_finish").asc_nulls_last(), "doc_id")


OP1_SQL = r"""
with d as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
    md5('mix/' || coalesce(doc_id::varchar, '')) as h
  from documents
), s as (
  select source, sum(size)::bigint as source_size,
    [5, 2, 1][(row_number() over (order by source asc nulls last) - 1) % 3 + 1]::bigint as weight
  from d group by source
), c as (
  select *, source_size * 3 as cap,
    sum(source_size) over () - coalesce(sum(source_size * 3) over w, 0) as remaining,
    sum(weight) over () - coalesce(sum(weight) over w, 0) as others
  from s
  window w as (order by (source_size * 3)::double / weight, source asc nulls last rows between unbounded preceding and 1 preceding)
), t as (
  select *, least(max(remaining::double / others::double) over () * weight, cap::double) as target from c
), r as (
  select d.doc_id, d.size, t.source_size, t.target, t.weight,
    (sum(d.size) over (partition by d.source order by h, d.doc_id, d.size rows unbounded preceding) - d.size)::bigint as before
  from d join t on d.source is not distinct from t.source
)
select doc_id, size, source_size, target,
  (greatest(least(size, round(target)::bigint - before), 0) + greatest(least(size, round(target)::bigint - source_size - before), 0)
    + greatest(least(size, round(target)::bigint - 2 * source_size - before), 0))::bigint as taken,
  case when size > 0 and round(target)::bigint - before > 0 then (before + size)::double / weight end as first_finish
from r
"""


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    rows = url_filter.filter_urls(pages, RULES)
    return rows.select("page_id", F.col("__host").alias("host"), F.col("__path").alias("path"), F.col("__rule").alias("rule"), F.col("__verdict").alias("verdict"))


OP10_SQL = r"""
with u as (
  select page_id,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) as path
  from pages
), r as (
  select *, case
    when (host = 'example.net' or suffix(host, '.example.net')) and starts_with(path, '/en/') then 'example.net/en/'
    when (host = 'example.com' or suffix(host, '.example.com')) and starts_with(path, '/de/') then 'example.com/de/'
    when (host = 'org' or suffix(host, '.org')) and starts_with(path, '/fr/') then 'org/fr/'
    when (host = 'net' or suffix(host, '.net')) and starts_with(path, '/') then 'net/' end as rule
  from u
)
select page_id, host, path, rule, case when rule in ('net/', 'example.com/de/') then 'block' else 'allow' end as verdict from r
"""

def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.components(table(spark, sf_dir, "documents"), width=4)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeated(table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    rows = secrets.scan_secrets(docs)
    n = {f"n_{k}": F.col(f"__n_{k}") for k in ("assign", "access", "hex", "owned", "live", "copied")}
    return rows.select("doc_id", *[c.alias(k) for k, c in n.items()], F.sha2("__base", 256).alias("base_sha256"), F.col("__all").alias("spans"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of all sources; host: source, path: its part in one language. Kept: good and not toxic."""
    rows = quality.assess(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return rows.select("doc_id", "quality", "quality_host", "quality_path", "toxic", ((F.col("quality") >= 0.5) & (F.col("toxic") < 0.5)).alias("kept"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    rows = language.identify(docs, drop_text=True)
    return rows.select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), F.col("__lang").alias("lang_pred"), F.col("__score").alias("score"))


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.store(table(spark, sf_dir, "documents"))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op12_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.cluster(table(spark, sf_dir, "embeddings"))


_NEAREST_CENTROID = """a{0} as materialized (
  select id, c, d from (
    select *, row_number() over (partition by id order by d, c) as n
    from (select e.id, k{0}.c, sum((e.x - k{0}.x) * (e.x - k{0}.x))::bigint as d from e join k{0} on e.i = k{0}.i group by e.id, k{0}.c)
  ) where n = 1
)"""
_NEXT_CENTROIDS = """k{1} as materialized (
  select k.c, k.i, coalesce((s - ((s % n + n) % n)) // n, k.x)::bigint as x from k{0} k left join (
    select a{0}.c, e.i, sum(e.x)::hugeint as s, count(*)::hugeint as n from a{0} join e on a{0}.id = e.id group by a{0}.c, e.i
  ) m on k.c = m.c and k.i = m.i
)"""
OP12_SQL = (
    """
with kept as materialized (
  select row_number() over (order by vec_id) as id, vec_id, [floor(1024 * x::double)::bigint for x in embedding] as q
  from embeddings where len(embedding) = 64 and len([x for x in embedding if x is not null and isfinite(x)]) = 64
), e as materialized (select id, unnest(q) as x, unnest(range(1, 65)) as i from kept),
f as materialized (select id, row_number() over (order by sha256('3:' || vec_id), q) - 1 as c from kept where vec_id is not null),
k0 as materialized (select f.c, e.i, e.x from f join e on f.id = e.id where f.c < 8),
"""
    + ",\n".join(step for n in range(10) for step in (_NEAREST_CENTROID.format(n), _NEXT_CENTROIDS.format(n, n + 1)))
    + ",\n"
    + _NEAREST_CENTROID.format(10)
    + """,
h as (select c, sha256(string_agg(x::varchar, ',' order by i)) as centroid_sha256 from k10 group by c),
s as (select c, sum(d)::bigint as cluster_inertia from a10 group by c)
select kept.vec_id, a10.c::int as cluster, a10.d as distance, s.cluster_inertia, (select sum(d) from a10)::bigint as inertia, h.centroid_sha256
from kept join a10 on kept.id = a10.id join h on h.c = a10.c join s on s.c = a10.c
"""
)


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
with d as (
  select row_number() over () as id, coalesce(lang, '') as lang, coalesce(source, '') as source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as terms
  from documents
), w as materialized (select id, lang, source, unnest(terms) as term from d),
kept as materialized (select lang, term from w group by lang, term having count(distinct id) >= 30),
c as materialized (select w.lang, w.source, w.term, count(*)::hugeint as n from w join kept on w.lang = kept.lang and w.term = kept.term group by w.lang, w.source, w.term),
v as (select lang, count(*)::hugeint as v from kept group by lang),
g as materialized (
  select g.lang, g.source, coalesce(v.v, 0) as v, coalesce(t.n, 0) as total from (select distinct lang, source from d) g
  left join v on v.lang = g.lang left join (select lang, source, sum(n) as n from c group by lang, source) t on t.lang = g.lang and t.source = g.source
),
p as materialized (
  select g.lang, g.source, kept.term, coalesce(c.n, 0) as n, 1 + (1000000000 * (coalesce(c.n, 0) + 5)) // (g.total + 5 * g.v) as p
  from g join kept on kept.lang = g.lang left join c on c.lang = g.lang and c.source = g.source and c.term = kept.term
),
l as (
  select lang, term, 1 + (1000000000 * (n + 5)) // (total + 5 * v) as q from (
    select c.lang, c.term, sum(c.n) as n, any_value(v.v) as v, any_value(t.total) as total from c join v on v.lang = c.lang
    join (select lang, sum(n) as total from c group by lang) t on t.lang = c.lang group by c.lang, c.term
  )
),
pairs as (
  select a.lang, a.source, b.source as item, coalesce(f.value, 0)::bigint as value from g a join g b on a.lang = b.lang and a.source <> b.source
  left join (
    select x.lang, x.source, y.source as item, sum(abs(x.p - y.p)) as value from p x join p y on x.lang = y.lang and x.term = y.term and x.source <> y.source
    group by x.lang, x.source, y.source
  ) f on f.lang = a.lang and f.source = a.source and f.item = b.source
),
terms as (
  select p.lang, p.source, p.term as item, (p.p - l.q)::bigint as value from p join l on l.lang = p.lang and l.term = p.term where p.n > 0 and p.p > l.q
),
ranked as (
  select lang, source, 'pair' as part, item, value, row_number() over (partition by lang, source order by value desc, encode(item)) as rank from pairs
  union all
  select lang, source, 'term' as part, item, value, row_number() over (partition by lang, source order by value desc, encode(item)) as rank from terms
)
select lang, source, part, item, value, rank::int as rank from ranked where part = 'pair' or rank <= 50
"""


QUERIES = {"op1_mixing": op1_mixing, "op2_near_dedup": op2_near_dedup, "op3_suffix_dedup": op3_suffix_dedup, "op4_packing": op4_packing, "op5_secrets": op5_secrets, "op6_quality": op6_quality, "op7_language": op7_language, "op8_media": op8_media, "op9_neighbours": op9_neighbours, "op10_url_filter": op10_url_filter, "op11_token_counts": op11_token_counts, "op12_clustering": op12_clustering, "op13_divergence": op13_divergence}
ORACLES = {"op1_mixing": OP1_SQL, "op10_url_filter": OP10_SQL, "op12_clustering": OP12_SQL, "op13_divergence": OP13_SQL}
