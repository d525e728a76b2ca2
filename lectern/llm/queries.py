"""The operators applied to the given tables with production parameters, and their SQL checks."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bagminhash, bpe, chat_format, exact_dedup, fingerprints, hard_negatives, importance, metric_join, mixing, quality, token_files, toxicity, url_filter
from .common import table

#: Rules of the url filter: host, path, verdict.
URL_RULES = [
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"), ("net", "/fr/", "block"),
]


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken", "copies")


def op2_chat_quotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.link_quotations(table(spark, sf_dir, "conversations"))


def op3_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bagminhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "kept")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), rules)


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_documents(table(spark, sf_dir, "documents"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.checksums(token_files.encode_to_files(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=0))


#: Folds whose labels the classifiers never see.
TOXICITY_FOLD, QUALITY_FOLD = (4, 2), (3, 1)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels, ~toxicity.held_out(F.col("doc_id"), *TOXICITY_FOLD))
    return toxicity.score(docs, model).select(
        "doc_id", toxicity.held_out(F.col("doc_id"), *TOXICITY_FOLD).alias("held_out"), "score", "predicted")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats, labels = quality.measured(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels")
    model = quality.fit(stats, labels, ~toxicity.held_out(F.col("doc_id"), *QUALITY_FOLD))
    return quality.score(stats, model).select(
        "doc_id", toxicity.held_out(F.col("doc_id"), *QUALITY_FOLD).alias("held_out"), "score", "predicted")


def op10_metric_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric_join.near_vectors(table(spark, sf_dir, "embeddings"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    relabelled = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), anchor=F.col("vec_id") % 50 == 0, label=relabelled)


QUERIES = {f.__name__: f for f in (
    op1_mix_sources, op2_chat_quotations, op3_bagminhash, op4_url_filter, op5_fingerprints, op6_bpe, op7_token_files, op8_toxicity, op9_quality, op10_metric_join,
    op11_importance_resampling, op12_exact_dedup, op13_hard_negatives)}

_WORDS = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+')"

CHECKS: dict[str, str] = {
    "op2_chat_quotations": r"""
with recursive msg as (
  select conv_id, turn, role, coalesce(text, '') as text, md5(concat_ws('|', conv_id, turn, role, coalesce(text, ''))) as mid from conversations),
lines as (
  select distinct mid, conv_id, turn, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as pos from msg),
parsed as (
  select mid, conv_id, turn, pos, length(regexp_replace(regexp_extract(line, '^(?:[ \t]*>)+'), '[ \t]', '', 'g')) as level,
    trim(regexp_replace(lower(regexp_replace(line, '^(?:[ \t]*>)+', '')), '[^\p{L}\p{N}]+', ' ', 'g')) as body from lines),
marked as (
  select *, case when lag(level) over w is null or lag(level) over w <> level or lag(body) over w = '' then 1 else 0 end as starts
  from parsed window w as (partition by mid order by pos)),
numbered as (select *, sum(starts) over (partition by mid order by pos) as paragraph from marked),
units as (
  select mid, conv_id, turn, level, body from numbered where body <> ''
  union all
  select mid, conv_id, turn, level, string_agg(body, ' ' order by pos) from numbered where body <> ''
  group by mid, conv_id, turn, level, paragraph having count(*) > 1),
quoted as (
  select mid, conv_id, turn, md5(body) as digest, length(body) as size, min(level) as level from units where level > 0 group by mid, conv_id, turn, body),
written as (select distinct conv_id, md5(body) as digest, turn as by_turn from units where level = 0),
hits as (select q.*, by_turn from quoted q join written w using (conv_id, digest) where by_turn < q.turn),
target as (
  select mid, by_turn as linked from (
    select mid, by_turn, row_number() over (partition by mid order by level, sum(size) desc, by_turn desc) as r
    from hits group by mid, level, by_turn) where r = 1),
counts as (
  select q.mid, count(*) as n_quoted, any_value(t.linked) as linked, any_value(h.n) as n_linked
  from quoted q left join target t on t.mid = q.mid left join (select mid, count(distinct digest) as n from hits group by mid) h on h.mid = q.mid group by q.mid),
turns as (
  select m.conv_id, m.turn, max(c.linked) as linked from msg m left join counts c on c.mid = m.mid
  where m.conv_id is not null and m.turn is not null group by m.conv_id, m.turn),
before as (select *, lag(turn) over (partition by conv_id order by turn) as previous from turns),
headed as (
  select *, last_value(case when linked is not null and linked is distinct from previous then turn end ignore nulls)
    over (partition by conv_id order by turn) as head from before),
prefixes as (
  select h.conv_id, h.turn as head, lpad(cast(cast(h.linked as hugeint) + 9223372036854775808 as varchar), 20, '0') as prefix
  from headed h join headed p on p.conv_id = h.conv_id and p.turn = h.linked where h.head = h.turn and p.head is null
  union all
  select h.conv_id, h.turn, x.prefix || '.' || lpad(cast(cast(h.linked as hugeint) + 9223372036854775808 as varchar), 20, '0')
  from headed h join headed p on p.conv_id = h.conv_id and p.turn = h.linked join prefixes x on x.conv_id = h.conv_id and x.head = p.head
  where h.head = h.turn)
select m.conv_id, m.turn, m.role, coalesce(h.linked, h.previous) as reply_to, cast(coalesce(c.n_quoted, 0) as bigint) as n_quoted,
  cast(coalesce(c.n_linked, 0) as bigint) as n_linked,
  case when h.turn is null then null else concat_ws('.', x.prefix, lpad(cast(cast(h.turn as hugeint) + 9223372036854775808 as varchar), 20, '0')) end as reply_path,
  regexp_replace(array_to_string(list_filter(string_split(m.text, chr(10)), lambda l: not regexp_matches(l, '^(?:[ \t]*>)+')), chr(10)), '^\s+|\s+$', '', 'g') as body
from msg m left join counts c on c.mid = m.mid left join headed h on h.conv_id = m.conv_id and h.turn = m.turn
left join prefixes x on x.conv_id = h.conv_id and x.head = h.head
""",
    "op3_bagminhash": rf"""
with recursive words as (select doc_id, coalesce(text, '') as text, {_WORDS} as w from documents),
shingles as (
  select doc_id, case when len(w) = 0 then [text] else list_transform(range(greatest(len(w) - 4, 1)), lambda i: array_to_string(w[i + 1:i + 5], ' ')) end as s, len(w) as n from words),
bag as (select doc_id, shingle, count(*) as c from (select doc_id, case when n = 0 then '0|' else '1|' end || unnest(s) as shingle from shingles) group by all),
total as (select doc_id, sum(c) as w from bag group by doc_id),
pairs as (
  select a.doc_id as a, b.doc_id as b, sum(least(a.c, b.c)) as m from bag a join bag b on a.shingle = b.shingle and a.doc_id < b.doc_id group by all),
links as (
  select a, b from pairs p join total x on x.doc_id = p.a join total y on y.doc_id = p.b where m >= 0.8 * (x.w + y.w - m)),
sides as (select a, b from links union all select b, a from links),
reach as (select doc_id as id, doc_id as low from documents union select b, low from reach join sides on a = id)
select id as doc_id, min(low) as class_id, min(low) = id as kept from reach group by id
""",
    "op4_url_filter": """
with rules(h, p, verdict) as (values """ + ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES) + r"""),
cut as (select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
urls as (
  select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path, row_number() over () as n from cut),
fits as (
  select n, h || p as rule, r.verdict, row_number() over (partition by n order by length(h || p) desc, length(h) desc) as place
  from urls join rules r on (host = h or ends_with(host, '.' || h)) and starts_with(path, p))
select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from urls left join fits on fits.n = urls.n and place = 1
""",
    "op10_metric_join": """
with recursive v as (
  select vec_id, label, list_transform(embedding, lambda x: cast(x as double)) as e, row_number() over () as n from embeddings),
ok as (
  select *, sqrt(list_dot_product(e, e)) as size from v where label is not null and vec_id is not null and e is not null and len(e) > 0
  and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0 and list_dot_product(e, e) > 0),
links as (
  select a.n as a, b.n as b, a.vec_id as ida, b.vec_id as idb from ok a join ok b on a.label = b.label and a.n <> b.n and len(a.e) = len(b.e)
  and list_dot_product(a.e, b.e) / (a.size * b.size) >= 0.93),
reach as (select n, vec_id as low from v union select b, low from reach join links on a = reach.n)
select v.vec_id, (select count(*) from links where a = v.n) as n_links, min(low) as component_id, coalesce(v.vec_id = min(low), false) as kept
from v join reach using (n) group by v.n, v.vec_id
""",
    "op11_importance_resampling": r"""
with bits as (
  select list_transform(range(256), lambda i: list_reduce(range(8), lambda c, _: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, i)) as crc),
texts as (
  select 0 as side, row_number() over () as n, doc_id, coalesce(text, '') as text from documents
  union all select 1, row_number() over (), null, coalesce(text, '') from benchmark),
words as (
  select side, n, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from texts),
features as (
  select side, n, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) as f from words),
counted as (select side, n, f, count(*) as c from features group by all),
hashed as (
  select f, xor(list_reduce(list_transform(range(len(hex(f)) // 2), lambda i: ('0x' || substr(hex(f), 2 * i + 1, 2))::bigint),
    lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1]), 4294967295::bigint), 4294967295::bigint) % 10000 as bucket
  from (select distinct f from counted), bits),
placed as (select side, n, bucket, c from counted join hashed using (f)),
sums as (select bucket, coalesce(sum(c) filter (side = 0), 0) as s, coalesce(sum(c) filter (side = 1), 0) as t from placed group by bucket),
totals as (select sum(s) as s_all, sum(t) as t_all from sums),
gains as (
  select bucket, floor(1000 * ln(((t + 1)::double * (s_all + 10000)::double) / ((s + 1)::double * (t_all + 10000)::double)))::bigint as gain from sums, totals),
weights as (
  select n, sum(c) as n_features, floor(sum(c * gain)::double / sum(c)::double)::bigint as weight from placed join gains using (bucket) where side = 0 group by n),
scored as (
  select n, doc_id, len(w) as n_words, coalesce(n_features, 0)::bigint as n_features, coalesce(weight, 0) as weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || coalesce(doc_id::varchar, '')), 1, 8))::bigint + 0.5) / 4294967296.0)))::bigint as score
  from words left join weights using (n) where side = 0),
placed_rows as (
  select *, row_number() over (partition by n_words >= 20 order by score desc, doc_id, n_features) as place, count(*) filter (n_words >= 20) over () as able from scored)
select doc_id, n_features, weight, score, case when n_words >= 20 and place <= 25 * able // 100 then place end as rank from placed_rows
""",
    "op12_exact_dedup": r"""
with d as (select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) as text_sha256 from documents)
select doc_id, min(doc_id) over w as keep_id, count(*) over w as group_size, doc_id is not distinct from min(doc_id) over w as kept, text_sha256
from d window w as (partition by text_sha256)
""",
    "op13_hard_negatives": """
with v as (
  select row_number() over () as n, vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: floor(256 * cast(x as double))) as e
  from embeddings where vec_id is not null and label is not null and embedding is not null and len(embedding) > 0
  and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
pairs as (
  select a.n, a.vec_id as anchor_id, b.vec_id as other, a.label = b.label as same, cast(list_dot_product(a.e, b.e) as bigint) as score
  from v a join v b on a.n <> b.n and len(a.e) = len(b.e) where a.vec_id % 50 = 0),
positives as (
  select *, row_number() over (partition by n order by score desc, other) as place from pairs where same),
found as (
  select p.anchor_id, p.other as positive_id, p.score as positive_score, x.other as negative_id, x.score as negative_score,
    row_number() over (partition by p.n, p.place order by x.score desc, x.other) as rank
  from positives p join pairs x on x.n = p.n and not x.same
  where p.place <= 5 and 50 * p.score <= 100 * x.score and 100 * x.score <= 95 * p.score)
select anchor_id, positive_id, cast(rank as integer) as rank, negative_id, positive_score, negative_score from found where rank <= 3
""",
}
