"""Queries over vectors, retrieval and references."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Window, functions as F

from ..functions import intents, vectors
from ..functions.base import SPACES, WHITESPACE
from ..operators import references, retrieval
from .registry import query

DIM = 64


def hashed_vectors(texts: list[str], task: str) -> list[list[float]]:
    """Stand-in for a hosted model: word hashes counted into 64 buckets, reproducible anywhere."""
    out = []
    for text in texts:
        counts = [0.0] * DIM
        for word in text.lower().split():
            counts[int.from_bytes(hashlib.md5(word.encode()).digest()[:4], "big") % DIM] += 1.0
        out.append(counts)
    return out


def stored(t):
    """Vectors as a document table; ``label`` plays the source."""
    return t.given("embeddings").select(
        F.col("vec_id").alias("id"), "embedding", F.concat(F.lit("administrativo__plano_ensino_"), F.col("label").cast("string")).alias("source"))


def first_vector(t) -> list[float]:
    """One question's vector: the stored vector of the lowest id."""
    return t.given("embeddings").orderBy("vec_id").first()["embedding"]


COSINE = "round(list_cosine_similarity(d.embedding::double[], q.embedding::double[]), 12)"
FIRST = "(select embedding from embeddings order by vec_id limit 1)"


@query("f1_embed", "", "select doc_id, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) as words from documents")
def _(t):
    out = retrieval.embed(t.spread("documents").select("doc_id", "text"), hashed_vectors, DIM, text="text")
    return out.select("doc_id", F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x).cast("bigint").alias("words"))


@query("f2_check_vectors", "", """
select case when vec_id % 17 = 0 then 63 else 64 end as length, count(*) as rows, vec_id % 17 = 0 as bad from embeddings group by 1, 3""")
def _(t):
    short = F.when(F.col("vec_id") % 17 == 0, F.slice("embedding", 1, 63)).otherwise(F.col("embedding"))
    return retrieval.check_vectors(t.given("embeddings").withColumn("embedding", short), DIM)


@query("f3_cosine_similarity", "", f"""
select d.vec_id, round({COSINE}, 6) as similarity from embeddings d join embeddings q on q.vec_id = d.vec_id + 1""")
def _(t):
    d = t.given("embeddings")
    q = d.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    return d.join(q, "vec_id").select("vec_id", F.round(vectors.cosine_similarity("embedding", "next"), 6).alias("similarity"))


@query("f4_match_documents", "", f"""
select d.vec_id as id, round({COSINE}, 6) as similarity from embeddings d, (select {FIRST} as embedding) q
where {COSINE} >= 0.1 order by {COSINE} desc, d.vec_id limit 20""")
def _(t):
    return retrieval.match_documents(stored(t), first_vector(t), threshold=0.1, k=20).select(
        "id", F.round("similarity", 6).alias("similarity"))


@query("f5_match_documents_filtered", "", f"""
select d.vec_id as id, round({COSINE}, 6) as similarity, 'administrativo__plano_ensino_' || d.label as source
from embeddings d, (select {FIRST} as embedding) q where 'administrativo__plano_ensino_' || d.label ilike 'ADMINISTRATIVO__plano_ensino%3'
  and {COSINE} >= -1 order by {COSINE} desc, d.vec_id limit 5""")
def _(t):
    found = retrieval.match_documents(
        stored(t), first_vector(t), threshold=-1, k=5, source_pattern="ADMINISTRATIVO__plano_ensino%3")
    return found.select("id", F.round("similarity", 6).alias("similarity"), "source")


MATCHES = f"""select q.vec_id as query_id, d.vec_id as id, {COSINE} as similarity,
    row_number() over (partition by q.vec_id order by {COSINE} desc, d.vec_id) as rank
  from embeddings q, embeddings d where {COSINE} >= 0.25"""


def questions(t):
    return t.given("embeddings").select(F.col("vec_id").alias("query_id"), "embedding")


def matched(t, **options):
    return retrieval.match_batch(questions(t), stored(t), DIM, k=5, threshold=0.25, **options)


@query("f6_match_batch", "", f"select query_id, id, round(similarity, 6) as similarity, rank from ({MATCHES}) m where rank <= 5")
def _(t):
    return matched(t).select("query_id", "id", F.round("similarity", 6).alias("similarity"), F.col("rank").cast("bigint").alias("rank"))


@query("f6_match_batch_by_cells", "", f"select query_id, id, round(similarity, 6) as similarity, rank from ({MATCHES}) m where rank <= 5")
def _(t):
    found = matched(t, broadcast_values=DIM, cells=12, block_rows=5_000)
    return found.select("query_id", "id", F.round("similarity", 6).alias("similarity"), F.col("rank").cast("bigint").alias("rank"))


@query("f7_route_threshold", "dialog", f"""
select session_id, turn, case when h % 5 = 0 then -1.0 when regexp_matches(content, '(?i){intents.COURSE_WORDS}') then 0.25 else 0.35 end::double as threshold,
  case when h % 5 = 0 then '{intents.PLAN_PATTERN}' end as source_pattern from dialog""")
def _(t):
    mode = F.when(F.col("h") % 5 == 0, "info").otherwise("livre")
    return t.dialog.select("session_id", "turn", intents.route_threshold(mode, F.col("content")).alias("r")).select(
        "session_id", "turn", "r.threshold", "r.source_pattern")


@query("f8_search_text", "turns", "select id, coalesce(nullif(current_topic, ''), content) as search from turns")
def _(t):
    return t.turns.select("id", intents.search_text("current_topic", "content").alias("search"))


@query("f9_row_defaults", "chunks", """
select cast(case when doc_id % 4 = 0 then '' else id end as varchar) as id, md5(content) as content_md5, coalesce(nullif(source, ''), 'desconhecido') as source,
  case when doc_id % 3 = 0 then 0.0 else 0.5 end::double as similarity, case when doc_id % 5 = 0 then '{}' else lang end as metadata from chunks""")
def _(t):
    holes = t.chunks.select(
        F.when(F.col("doc_id") % 4 != 0, F.col("id")).alias("id"), "content", "source",
        F.when(F.col("doc_id") % 3 != 0, F.lit(0.5)).alias("similarity"), F.when(F.col("doc_id") % 5 != 0, F.col("lang")).alias("metadata"))
    return retrieval.row_defaults(holes).select("id", F.md5("content").alias("content_md5"), "source", "similarity", "metadata")


@query("f10_apply_grades", "chunks", """
select c.id from chunks c left join labels l on l.doc_id = c.doc_id
where l.doc_id is null or l.quality is null or case l.quality when 1 then 'relevant' else 'irrelevant' end = 'relevant'""")
def _(t):
    grades = t.given("labels").select("doc_id", F.when(F.col("quality") == 1, "relevant").otherwise("irrelevant").alias("grade"))
    return retrieval.apply_grades(t.chunks, grades, ["doc_id"]).select("id")


def ranked_hits(t):
    """Retrieved entries of the instrumented turns as match rows."""
    return t.telemetry().filter("metadata is not null").select(F.col("id").alias("query_id"), F.explode("metadata.retrieval").alias("e")).select(
        "query_id", F.col("e.document_id").alias("id"), "e.source", "e.rank", "e.similarity")


@query("f11_retrieval_array", "turns hits", """
select id as query_id, string_agg(rank || '=' || case when document_id = '' then 'source:' || doc_source || ':' || rank else document_id end || '@' || doc_source, ';' order by rank) as retrieval
from hits group by id""")
def _(t):
    arrays = retrieval.retrieval_array(ranked_hits(t))
    return arrays.select("query_id", F.array_join(F.transform("retrieval", lambda r: F.concat(
        r["rank"].cast("string"), F.lit("="), r["document_id"], F.lit("@"), r["source"])), ";").alias("retrieval"))


def shown_matches(t):
    """Ranked matches with the text of the chunk they point at."""
    chunks = t.chunks.select(F.col("id").alias("_id"), "content")
    return ranked_hits(t).join(chunks, F.col("id") == F.col("_id")).drop("_id")


@query("g1_format_context", "turns hits chunks", """
, shown as (select h.id as query_id, row_number() over (partition by h.id order by h.rank) as rank, h.similarity, c.content from hits h join chunks c on c.id = h.document_id)
, blocks as (select query_id, md5(string_agg('[' || rank || '] Trecho RAG ' || rank || ' (similaridade: ' || printf('%.2f', similarity) || ')' || chr(10) || content,
    chr(10) || chr(10) || '---' || chr(10) || chr(10) order by rank)) as context_md5 from shown group by query_id)
select t.id as query_id, coalesce(b.context_md5, md5('Nenhum material disponível.')) as context_md5 from turns t left join blocks b on b.query_id = t.id""")
def _(t):
    asked = t.turns.select(F.col("id").alias("query_id"))
    return references.format_context(asked, shown_matches(t)).select("query_id", F.md5("context").alias("context_md5"))


@query("g2_format_history", "messages", """
select session_id, md5(string_agg(case role when 'user' then 'Estudante: ' else 'Tutor: ' end || content, chr(10) order by created_at, id)) as history_md5
from (select *, row_number() over (partition by session_id order by created_at desc, id desc) as rn from messages) where rn <= 5 group by session_id""")
def _(t):
    return references.format_history(t.messages, 5).select("session_id", F.md5("history").alias("history_md5"))


CITED = """case doc_id % 3 when 0 then 'capa' || chr(10) || '  Silva de Souza (20' || lpad(cast(doc_id % 30 as string), 2, '0') || '). Estudo de ' || source || ' volume ' || cast(doc_id as string) || '. ' || chr(10)
  when 1 then 'Capítulo ' || case when doc_id % 2 = 0 then cast(doc_id as string) else '' end || ' - Cuidados de ' || source || ' edição. ' || chr(10) else '' end || text"""


def cited_files(t):
    """Documents with a citation line, a chapter heading or neither in front, cut into pages at blank-free lines."""
    return t.spread("documents").select("doc_id", "source", F.expr(CITED.replace("chr(10)", "'\\n'")).alias("text"))


# RE2 spellings of the two patterns.
RE2_CITATION = references.CITATION_LINE.replace("(?md)", "(?m)").replace("++", "+").replace("}+", "}").replace("'", "''")
RE2_CHAPTER = references.CHAPTER_LINE.replace("(?imud)", "(?im)")
REFERENCE_SQL = f"""
  case when c then trim(regexp_extract(text, '{RE2_CITATION}', 1)) end as author,
  case when c then regexp_extract(text, '{RE2_CITATION}', 2) end as year,
  case when c then rtrim(trim(regexp_extract(text, '{RE2_CITATION}', 3)), '. ') when k then rtrim(trim(regexp_extract(text, '{RE2_CHAPTER}', 2)), '. ') end as title,
  case when not c and k and regexp_extract(text, '{RE2_CHAPTER}', 1) <> '' then 'Cap. ' || regexp_extract(text, '{RE2_CHAPTER}', 1) end as section"""


@query("g3_extract_reference_metadata", "", f"""
with cited as (select doc_id, {CITED} as text from documents)
, seen as (select *, regexp_matches(text, '{RE2_CITATION}') as c, regexp_matches(text, '{RE2_CHAPTER}') as k from cited)
select doc_id, {REFERENCE_SQL} from seen""")
def _(t):
    files = cited_files(t).select("doc_id", F.array(F.struct(F.lit(1).alias("page_number"), F.col("text").alias("text"))).alias("pages"))
    return references.extract_reference_metadata(files).select(
        "doc_id", "reference.author", "reference.year", "reference.title", "reference.section")


@query("g4_backfill_references", "", f"""
with cited as (select doc_id, source, {CITED} as text, case when doc_id % 8 <> 7 then 'f' || cast(floor(doc_id / 5) as bigint) end as file from documents)
, keyed as (select *, coalesce('drive:' || file, 'source:' || source) as key from cited)
, heads as (select key, string_agg(text, chr(10) order by rn) as text from (
    select *, row_number() over (partition by key order by doc_id % 5, cast(doc_id as string)) as rn from keyed) where rn <= 20 group by key)
, seen as (select *, regexp_matches(text, '{RE2_CITATION}') as c, regexp_matches(text, '{RE2_CHAPTER}') as k from heads)
, found as (select key, {REFERENCE_SQL} from seen)
select cast(doc_id as string) as id, case when doc_id % 4 = 0 then 'kept' else f.title end as reference_title,
  case when doc_id % 4 = 0 then 'old' else coalesce(f.author, 'old') end as reference_author, case when doc_id % 4 <> 0 then f.year end as reference_year,
  case when doc_id % 4 <> 0 then f.section end as reference_section from keyed k left join found f on f.key = k.key""")
def _(t):
    chunks = cited_files(t).select(
        F.col("doc_id").cast("string").alias("id"), F.col("text").alias("content"), "source",
        F.expr("case when doc_id % 8 <> 7 then 'f' || cast(floor(doc_id / 5) as bigint) end").alias("drive_file_id"),
        (F.col("doc_id") % 5).alias("chunk_index"), F.lit("old").alias("reference_author"), F.lit(None).cast("string").alias("reference_year"),
        F.when(F.col("doc_id") % 4 == 0, F.lit("kept")).alias("reference_title"), F.lit(None).cast("string").alias("reference_section"))
    return references.backfill_references(chunks).select(
        "id", "reference_title", "reference_author", "reference_year", "reference_section")


# RE2 has no lookaround and no possessive quantifiers: what stands in front of a match is taken along, and the groups are moved by none.
_RE2 = lambda pattern: re.sub(r"\\u([0-9a-fA-F]{4})", r"\\x{\1}", pattern).replace("++", "+").replace("}+", "}").replace("(?iu)", "(?i)").replace("'", "''")
_START = "(?:^|[^A-Za-z0-9_])"
RE2_CITED = _START + _RE2(references._CITATION)
RE2_PAGE = "(?i)" + _START + _RE2(references.INLINE_PAGE.split(f"(?<!{references._W})")[1])
RE2_IN_CHAPTER = "(?i)" + _START + _RE2(references._CHAPTER)
RE2_AUTHORS = _RE2(references.AUTHOR_LINE)
TRIM = "'" + WHITESPACE + "'"
#: Every seventh document has stored fields, some of them empty.
STORED_FIELDS = {
    "title": "case when doc_id % 7 = 0 then 'Livro ' || cast(doc_id as string) end", "author": "case when doc_id % 14 = 0 then 'Souza' else '' end",
    "year": "case when doc_id % 21 = 0 then '2010' end", "section": "case when doc_id % 35 = 0 then 'Cap. 2' end"}
REFERENCE_LINES = f"""
cited as (select doc_id, coalesce({CITED}, '') as text, {', '.join(f'{x} as s_{n}' for n, x in STORED_FIELDS.items())} from documents)
, flat as (select *, trim(regexp_replace(text, '{_RE2(SPACES)}', ' ', 'g'), {TRIM}) as flat,
  list_filter(list_transform(string_split_regex(text, '\\r?\\n'), lambda x: trim(x, {TRIM})), lambda x: x <> '') as lines from cited)
, found as (select *, regexp_extract(flat, '{RE2_CITED}', 1) as author, regexp_extract(flat, '{RE2_CITED}', 2) as year, regexp_extract(flat, '{RE2_CITED}', 3) as title,
  regexp_extract(flat, '{RE2_PAGE}', 1) as page, regexp_extract(flat, '{RE2_IN_CHAPTER}', 1) as chapter, regexp_extract(flat, '{RE2_IN_CHAPTER}', 2) as heading,
  list_filter(range(1, len(lines)), lambda i: length(trim(regexp_replace(lines[i], '(?i)^\\[P[aá]g\\.\\s*[0-9]+\\]\\s*', ''), {TRIM})) between 12 and 180
    and regexp_matches(lines[i + 1], '{RE2_AUTHORS}'))[1] as above from flat)
, known as (select doc_id, coalesce(
  case when s_title is not null then concat_ws(' ', nullif(s_author, ''), '(' || s_year || ')', s_title || coalesce(' (' || s_section || ')', '') || '.') end,
  case when flat = '' then '{references.NO_REFERENCE}' end,
  case when title <> '' then regexp_replace(concat_ws(' ', nullif(trim(author, {TRIM}), ''), '(' || nullif(year, '') || ')', trim(regexp_replace(title, '(?i)^(?:cap[ií]tulo|t[ií]tulo)\\s*[:.-]?\\s*', ''), {TRIM}) || '.',
    'p. ' || nullif(page, '') || '.'), '\\s+\\.', '.', 'g') end,
  case when heading <> '' then regexp_replace(trim(heading, {TRIM}), '[.:;]+$', '') || case when chapter <> '' then ' (Cap. ' || chapter || ')' else '' end || '.' end,
  regexp_replace(trim(regexp_replace(lines[above], '(?i)^\\[P[aá]g\\.\\s*[0-9]+\\]\\s*', ''), {TRIM}), '[.:;]+$', '') || '.',
  '{references.NO_REFERENCE}') as reference from found)"""


def referenced_files(t):
    """Documents with citations and, some, with stored reference fields."""
    stored = F.struct(*[F.expr(x).alias(f"reference_{n}") for n, x in STORED_FIELDS.items()])
    return cited_files(t).withColumn("metadata", stored)


@query("g5_reference_line", "", f"with {REFERENCE_LINES.lstrip()} select doc_id, reference from known")
def _(t):
    return references.with_reference(referenced_files(t), "text").select("doc_id", "reference")


ANSWERED = "text || chr(10) || chr(10) || '**Referências:** inventada' || chr(10) || chr(10) || 'Deseja aprofundar este tema?'"
HEADING = references._REFERENCES_HEADING.replace("(?isu)", "(?is)")


@query("g6_strip_model_references", "", f"""
select conv_id, turn, md5(rtrim(regexp_extract({ANSWERED}, '{HEADING}', 1), ' ' || chr(9) || chr(10) || chr(13)) || chr(10) || chr(10) || 'Deseja aprofundar este tema?') as answer_md5
from conversations""")
def _(t):
    answer = F.concat("text", F.lit("\n\n**Referências:** inventada\n\nDeseja aprofundar este tema?"))
    return t.given("conversations").select("conv_id", "turn", F.md5(references.strip_model_references(answer)).alias("answer_md5"))


@query("g7_finalize_references", "turns hits", f"""
, {REFERENCE_LINES.lstrip()}
, lines as (select h.id as query_id, k.reference, min(h.rank) as place from hits h join known k on cast(k.doc_id as varchar) = h.document_id
  where k.reference <> '{references.NO_REFERENCE}' group by all)
, sections as (select query_id, '- ' || string_agg(reference, chr(10) || '- ' order by place) as shown
  from (select *, row_number() over (partition by query_id order by place) as n from lines) where n <= 5 group by query_id)
, answers as (select id as query_id, content, case when mode = 'quiz' then 'simulado_tema' else coalesce(mode, 'livre') end as generation_mode from turns)
select a.query_id, generation_mode, trim(trim(content, {TRIM}) || case when generation_mode in ({', '.join(f"'{m}'" for m in references.REFERENCED_MODES)})
  then chr(10) || chr(10) || '**Referências:**' || chr(10) || coalesce(shown, '- {references.NO_REFERENCE}') else '' end, {TRIM}) as answer
from answers a left join sections s on s.query_id = a.query_id""")
def _(t):
    mode = F.when(F.col("mode") == "quiz", "simulado_tema").otherwise(F.coalesce("mode", F.lit("livre")))
    answers = t.turns.select(F.col("id").alias("query_id"), F.col("content").alias("answer"), mode.alias("generation_mode"))
    # references are looked for in retrieved chunks only
    hits = ranked_hits(t)
    wanted = hits.select(F.col("id").alias("_id")).distinct()
    chunks = referenced_files(t).join(wanted, F.col("doc_id").cast("string") == F.col("_id"), "left_semi")
    known = references.with_reference(chunks, "text").select(F.col("doc_id").cast("string").alias("id"), "reference")
    matches = hits.join(known, "id")
    return references.finalize_references(answers, matches)
