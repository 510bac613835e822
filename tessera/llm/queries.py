"""The queries opN_<name> over whole tables, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .decontaminate import find_overlap
from .exact_dedup import exact_dedup
from .hard_negatives import mine_hard_negatives
from .language_id import identify
from .license_scan import scan_licenses
from .near_dedup import near_duplicates
from .ranked_search import ranked_search
from .sharding import shard_documents
from .stages import MODEL_PATH, encoder
from .substring_dedup import deduplicate_substrings
from .suffix_tree import score_documents
from .url_rules import ALLOW, BLOCK, filter_urls
from .warc import archive_round_trip


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_round_trip(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = deduplicate_substrings(_table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_removed", "kept_sha256")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_overlap(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text by digest, and whether decoding them gives the text back."""
    return encoder(spark, MODEL_PATH, digests=True)(_table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = identify(_table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return found.select("doc_id", "held_out", F.col("guess.lang").alias("lang_pred"), F.col("guess.score").alias("score"), F.col("guess.ambiguous").alias("ambiguous"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """class_id: the smallest doc_id among all that links of similarity 0.8 or more connect with the document."""
    found = near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.col("group_id").alias("class_id"), "kept", F.col("class_id").alias("same_shingles_id"), "n_links", "similarity")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


#: The listed rules (verdict, host, path) of op12.
URL_RULES = [(BLOCK, "net", "/"), (ALLOW, "example.net", "/en/"), (BLOCK, "example.com", "/de/"), (ALLOW, "org", "/fr/")]


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules are mined from the pages on which a listed rule decides."""
    return filter_urls(_table(spark, sf_dir, "pages"), URL_RULES).withColumnRenamed("id", "page_id")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings")
    moved = F.expr("case when vec_id % 7 = 0 then (label + 1) % 10 else label end")
    return mine_hard_negatives(rows.select("vec_id", "embedding", moved.alias("label")))


QUERIES = {f.__name__: f for f in (op1_warc, op2_lm_scoring, op3_license_scan, op4_substring_dedup, op5_sharding, op6_decontamination, op7_sentencepiece, op8_language_id, op9_exact_dedup, op10_near_dedup, op11_ranked_search, op12_url_filter, op13_hard_negatives)}

ORACLES = {
    "op1_warc": r"""
with p as (select page_id, coalesce(html, '') as payload from pages),
d as (select page_id, strlen(payload) as n, sha256(payload) as h from p),
f as (select h, min(page_id) as first_id from d where n >= 100 group by h)
select d.page_id, cast(d.n as bigint) as payload_bytes, d.h as payload_digest,
  case when d.n >= 100 and d.page_id <> f.first_id then 'revisit' else 'response' end as record_type,
  case when d.n >= 100 and d.page_id <> f.first_id then f.first_id end as refers_to
from d left join f on d.h = f.h""",
    "op4_substring_dedup": r"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
s as (select doc_id, ws, unnest(range(1, len(ws) - 48)) as i from w where len(ws) >= 50),
g as (select doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) as h from s),
o as (select h, min(doc_id) as first_doc from g group by h),
x as (select distinct g.doc_id, unnest(range(g.i, g.i + 50)) as p from g join o using (h) where o.first_doc < g.doc_id),
r as (select doc_id, list(distinct p) as gone from x group by doc_id)
select w.doc_id, cast(len(ws) as bigint) as n_words, cast(coalesce(len(gone), 0) as bigint) as n_removed,
  sha256(array_to_string(case when gone is null then ws else [ws[p] for p in range(1, len(ws) + 1) if not list_contains(gone, p)] end, ' ')) as kept_sha256
from w left join r on w.doc_id = r.doc_id""",
    "op6_decontamination": r"""
with folded as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from documents),
items as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from benchmark),
iw as (select distinct item_id, least(len(ws), 10) as k, array_to_string(ws[i:i + least(len(ws), 10) - 1], ' ') as g
  from (select item_id, ws, unnest(range(1, greatest(len(ws) - 8, 2))) as i from items where len(ws) > 0)),
ks as (select distinct k from iw),
dw as (select doc_id, k, i, array_to_string(ws[i:i + k - 1], ' ') as g
  from (select doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) as i from folded, ks where len(ws) >= k)),
hit as (select distinct doc_id, k, i, item_id from dw join iw using (k, g)),
pos as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + k)) as p from hit) group by doc_id),
its as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as listed from (select distinct doc_id, cast(item_id as varchar) as item from hit) group by doc_id)
select f.doc_id, cast(len(ws) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
  sha256(coalesce(listed, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from folded f left join pos on f.doc_id = pos.doc_id left join its on f.doc_id = its.doc_id""",
    "op9_exact_dedup": r"""
with t as (select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) as h from documents),
g as (select h, min(doc_id) as keep_id, count(*) as group_size from t group by h)
select t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id as kept, t.h as text_sha256 from t join g on t.h = g.h""",
    "op11_ranked_search": r"""
with d as (select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as ws from documents),
s as (select count(*) filter (len(ws) > 0) as docs, cast(sum(len(ws)) as bigint) as words from d),
p as (select r, w, count(*) as tf from (select r, unnest(ws) as w from d) group by r, w),
f as (select w, count(*) as df from p group by w),
q as (select i, item_id, unnest(list_distinct(ws)) as w from (select row_number() over () as i, item_id,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as ws from benchmark)),
qw as (select i, item_id, w, cast(floor(1000 * ln(cast(2 * docs + 2 as double) / cast(2 * df + 1 as double))) as bigint) as weight from q join f using (w), s),
dm as (select r, doc_id, 100 - 50 + (50 * len(ws) * docs) // words as m from d, s),
sc as (select i, item_id, doc_id, r, cast(sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * m))) as bigint) as score from qw join p using (w) join dm using (r) group by i, item_id, doc_id, r)
select item_id, cast(rank as int) as rank, doc_id, score from
  (select *, row_number() over (partition by i order by score desc, doc_id asc nulls last) as rank from sc where score > 0) where rank <= 50""",
    "op12_url_filter": r"""
with u as (select row_number() over () as r, page_id, regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)(?:\?([^#]*))?', ['host', 'path', 'query']) as x from pages),
v as (select r, page_id, translate(x.host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, x.path as path,
  translate(x.path, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as low_path, translate(x.query, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as low_query from u),
k as (select *, list_distinct(list_concat(
    list_transform(list_filter(string_split(host, '.'), lambda t: t <> ''), lambda t: 'h:' || t),
    list_transform(regexp_extract_all(low_path, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda t: 'p:' || t),
    list_transform(regexp_extract_all(low_query, '(?:^|&)([^&=]+)', 1), lambda t: 'q:' || t))) as tokens,
  case when (host = 'example.net' or ends_with(host, '.example.net')) and starts_with(path, '/en/') then 'example.net/en/'
    when (host = 'example.com' or ends_with(host, '.example.com')) and starts_with(path, '/de/') then 'example.com/de/'
    when (host = 'org' or ends_with(host, '.org')) and starts_with(path, '/fr/') then 'org/fr/'
    when (host = 'net' or ends_with(host, '.net')) and starts_with(path, '/') then 'net/' end as rule from v),
j as (select *, case when rule in ('net/', 'example.com/de/') then 'block' when rule is not null then 'allow' end as listed from k),
t as (select r, listed, unnest(tokens) as a from j where rule is not null),
least_n as (select ceil(0.01 * count(*)) as c from j where rule is not null),
often as (select a from t group by a having count(*) >= (select c from least_n)),
ft as (select t.* from t join often using (a)),
sets as (select r, listed, [a] as s from ft
  union all select x.r, x.listed, [x.a, y.a] from ft x join ft y on x.r = y.r and x.a < y.a
  union all select x.r, x.listed, [x.a, y.a, z.a] from ft x join ft y on x.r = y.r and x.a < y.a join ft z on x.r = z.r and y.a < z.a),
all_n as (select s, count(*) as n_all from sets group by s),
part_n as (select s, listed, count(*) as n from sets group by s, listed),
rules as (select s, listed, n, cast(n as double) / cast(n_all as double) as confidence from part_n join all_n using (s) where n >= (select c from least_n) and cast(n as double) / cast(n_all as double) >= 0.8),
kept as (select * from rules a where not exists (select 1 from rules b where b.listed = a.listed and len(b.s) < len(a.s) and len(list_intersect(b.s, a.s)) = len(b.s) and b.confidence >= a.confidence)),
mined as (select r, min(struct_pack(c := -confidence, m := -n, k := len(s), mined_rule := array_to_string(s, ' '), w := case kept.listed when 'block' then 0 else 1 end, verdict := kept.listed, confidence := confidence)) as b
  from j join kept on j.rule is null and len(list_intersect(kept.s, j.tokens)) = len(kept.s) group by r)
select page_id, host, path, rule, coalesce(listed, b.verdict, 'allow') as verdict, b.mined_rule as mined_rule, b.confidence as confidence from j left join mined using (r)""",
    "op13_hard_negatives": r"""
with v as (select row_number() over () as r, vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
  list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as x from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
a as (select * from v where vec_id % 100 = 0),
s as (select a.r as a, a.vec_id as anchor_id, v.r, v.vec_id, v.label = a.label as same, cast(list_sum(list_transform(list_zip(a.x, v.x), lambda z: z[1] * z[2])) as bigint) as score from a, v where len(a.x) = len(v.x)),
p as (select * from (select *, row_number() over (partition by a order by score desc, vec_id asc nulls last) as k from s where same and vec_id is distinct from anchor_id) where k <= 5),
n as (select p.anchor_id, p.vec_id as positive_id, s.vec_id as negative_id, p.score as positive_score, s.score as negative_score,
  row_number() over (partition by p.a, p.r order by s.score desc, s.vec_id asc nulls last) as rank
  from p join s on p.a = s.a and not s.same and 80 * p.score <= 100 * s.score and s.score <= p.score)
select anchor_id, positive_id, cast(rank as int) as rank, negative_id, positive_score, negative_score from n where rank <= 5""",
}
