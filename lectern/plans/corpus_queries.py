"""Queries over sources, text, chunks, identity and reconciliation."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import functions as F

from ..functions import identity, text as txt
from ..functions.base import WHITESPACE
from ..operators import audit, chunking, dedup, jobs, sync
from ..session import scratch_path
from ..sources import files, sinks, tables
from . import corpus
from .inputs import TABLES, for_duckdb
from .registry import at, query

WS = "'" + WHITESPACE + "'"


def uuid5_sql(namespace: uuid.UUID, name: str) -> str:
    d = f"sha1(unhex('{namespace.hex}') || encode({name}))"
    return (f"substr({d},1,8) || '-' || substr({d},9,4) || '-5' || substr({d},14,3) || '-' || "
            f"translate(substr({d},17,1),'0123456789abcdef','89ab89ab89ab89ab') || substr({d},18,3) || '-' || substr({d},21,12)")


def line_pages(t):
    """Documents as files whose pages are their lines."""
    return t.spread("documents").select(
        F.col("doc_id").alias("file_id"), "source",
        F.transform(F.split("text", "\n"), lambda x, i: F.struct((i + 1).alias("page_number"), x.alias("text"))).alias("pages"))


def text_files(t):
    """Documents as files of one page."""
    return t.spread("documents").select(
        F.col("doc_id").alias("file_id"), "source",
        F.array(F.struct(F.lit(1).alias("page_number"), F.col("text").alias("text"))).alias("pages"))


def paragraphs(content: bytes) -> list[str]:
    """Stand-in for a user's extractor: every paragraph of an HTML page is a page of text."""
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__()
            self.parts, self.open = [], False

        def handle_starttag(self, tag, attrs):
            if tag == "p":
                self.parts.append("")
                self.open = True

        def handle_endtag(self, tag):
            self.open = self.open and tag != "p"

        def handle_data(self, data):
            if self.open:
                self.parts[-1] += data

    reader = Reader()
    reader.feed(content.decode("utf-8"))
    return reader.parts


# ---- A: sources and sinks

@query("a1_scan_files")
def _(t):
    found = files.scan_files(t.spark, t.folder, [".PARQUET"])
    return found.select(F.substring_index("path", "/", -1).alias("name"), "length")


@query("a2_folder_paths", "nodes", f"""
, tree as (select 'root' as id, 'ROOT' as path union all
  select n.id, t.path || '/' || n.name from nodes n join tree t on n.parent = t.id
  where n.mime_type = '{files.FOLDER_TYPE}' and not n.trashed)
select n.id, n.name, n.mime_type, t.path || '/' || n.name as drive_path from nodes n join tree t on n.parent = t.id
where not n.trashed and n.mime_type in ({', '.join(f"'{m}'" for m in files.REMOTE_TYPES)})""")
def _(t):
    return files.folder_paths(t.nodes, "root").select("id", "name", "mime_type", "drive_path")


@query("a3_read_chat_messages", "messages", f"""
select id, session_id, role, content, {at('created_at')} as created_at from messages""")
def _(t):
    return tables.read_chat_messages(t.messages).select(
        "id", "session_id", "role", "content", "created_at")


@query("a4_read_manifest", "manifest", """
select drive_file_id, name, drive_path, mime_type, modified_time, md5_checksum, chunks_count, status from manifest""")
def _(t):
    return tables.read_manifest(t.manifest)


@query("a4_read_chunks_for_file", "chunks", "select id, source, page_number from chunks where drive_file_id = 'f3'")
def _(t):
    stored = t.chunks.withColumn("metadata", F.struct("drive_file_id", "page_number"))
    return tables.read_chunks_for_file(stored, "f3").select("id", "source", "metadata.page_number")


@query("a5_read_acceptance_cases", "", "select cast(item_id as varchar) as id, 1 as turns, 45000 as max_latency_ms from benchmark")
def _(t):
    cases = t.given("benchmark").select(
        F.col("item_id").cast("string").alias("id"), F.lit("").alias("description"), F.array("text").alias("messages"),
        F.struct(F.slice(F.split("text", " "), 1, 2).alias("includes"), F.array(F.lit("zzz")).alias("excludes"),
                 F.lit(1).alias("sourcesMin"), F.lit(45000).alias("maxLatencyMs")).alias("expect"))
    path = scratch_path(t.spark, "cases")
    cases.select(F.to_json(F.array(F.struct("*")))).write.text(path)
    read = files.read_acceptance_cases(t.spark, path, one_document=False)
    return read.select("id", F.size("messages").alias("turns"), F.col("expect.maxLatencyMs").alias("max_latency_ms"))


def newer_chunks(t):
    """Chunks that overlap the table: ids moved by 250, texts extended."""
    return t.chunks.select(
        (F.col("doc_id") + 250).cast("string").alias("id"), F.concat("content", F.lit("!")).alias("content"), "source", "drive_file_id")


NEWER = "select cast(doc_id + 250 as string) as id, content || '!' as content, source, drive_file_id from chunks"


@query("a6_write_chunks", "chunks", f"""
, newer as ({NEWER})
select id, md5(content) as content_md5, source from chunks where id not in (select id from newer)
union all select id, md5(content), source from newer""")
def _(t):
    path = scratch_path(t.spark, "chunks")
    # ids of this table do not tell the file, so it is dealt by id
    sinks.write_chunks(t.chunks.select("id", "content", "source", "drive_file_id"), path, key=("id",), parts=8)
    return sinks.write_chunks(newer_chunks(t), path, key=("id",), parts=8).select("id", F.md5("content").alias("content_md5"), "source")


@query("a7_export_audit_json", "messages", """
select 'session-' || substr(sha256(session_id), 1, 12) as case_candidate, count(*) as messages from messages group by session_id""")
def _(t):
    path = scratch_path(t.spark, "audit")
    sinks.export_audit_json(t.chat(), path, part_size=3)
    return t.spark.read.schema("case_candidate string, part bigint, messages array<struct<number:bigint>>").json(path).groupBy(
        "case_candidate").agg(F.sum(F.size("messages").cast("bigint")).alias("messages"))


@query("a9_append_health", "chunks jobs evaluations", """
select 'supabase' as component, 'healthy' as status, '{"indexed_documents":' || (select count(*) from chunks) || '}' as detail, 2 as times
union all select 'drive_sync', case when n > 0 then 'warning' else 'healthy' end, '{"failed_jobs":' || n || '}', 2 from (select count(*) as n from jobs where status = 'failed')
union all select 'quality_worker', case when n > 0 then 'warning' else 'healthy' end, '{"failed_evaluations":' || n || '}', 2 from (select count(*) as n from evaluations where status = 'failed')""")
def _(t):
    path = scratch_path(t.spark, "health")
    for minute in ("2024-02-01 00:00:00", "2024-02-01 00:10:00"):
        checks = jobs.health_check(t.chunks, t.jobs, t.evaluations, F.to_timestamp(F.lit(minute)), t.spark)
        sinks.append_health(checks, path)
    return t.spark.read.parquet(path).groupBy("component", "status", "detail").agg(F.count("*").cast("int").alias("times"))


# ---- B: extraction and cleaning

@query("b1_extract_pages", "", f"""
with bare as (select page_id, regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', '', 'g'), '(?s)<!--.*?-->', '', 'g') as html from pages)
, parts as (select page_id, unnest(string_split_regex(html, '(?i)<p(?:[ \\t\\n\\r\\f][^>]*)?>')[2:]) as part, unnest(range(len(string_split_regex(html, '(?i)<p(?:[ \\t\\n\\r\\f][^>]*)?>')) - 1)) + 1 as page_number from bare)
, texts as (select page_id, page_number, regexp_replace(regexp_extract(part, '(?is)^(.*?)(?:</p[ ]*>|$)', 1), '<[/!?a-zA-Z][^>]*>', '', 'g') as text from parts)
, plain as (select page_id, page_number, replace(replace(replace(replace(replace(replace(text, '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&') as text from texts)
select page_id as file_id, cast(page_number as integer) as page_number, trim(text, {WS}) as text from plain where trim(text, {WS}) <> ''""")
def _(t):
    html = t.spread("pages").select(F.col("page_id").alias("file_id"), "url", F.encode("html", "UTF-8").alias("content"))
    return files.explode_pages(files.extract_pages(html, paragraphs), ["file_id"])


ROUTE_NAME = "source || case doc_id % 4 when 0 then '.PDF' when 1 then '.docx' when 2 then '.pptx' else '.pdf' end"


@query("b2_route_extractor", "", f"""
select doc_id, case when lower({ROUTE_NAME}) like '%.docx' then 'docx' else 'pdf' end as route,
  case when lower({ROUTE_NAME}) like '%.pdf' then 'light' else 'structured' end as bulk_route from documents""")
def _(t):
    named = t.given("documents").select("doc_id", F.expr(ROUTE_NAME).alias("name"))
    return named.select("doc_id", files.route_extractor("name").alias("route"), files.route_extractor("name", True).alias("bulk_route"))


@query("b3_sanitize", "", "select doc_id, md5(text) as text_md5, source from documents")
def _(t):
    nul = F.char(F.lit(0))
    dirty = t.given("documents").withColumn("text", F.replace("text", F.lit("e"), F.concat(F.lit("e"), nul))).withColumn(
        "source", F.concat(nul, "source"))
    return dirty.select("doc_id", F.md5(txt.sanitize("text")).alias("text_md5"), txt.sanitize("source").alias("source"))


@query("b4_strip_blank_lines", "", f"""
select doc_id, md5(array_to_string(list_filter(list_transform(string_split(replace(text, '. ', chr(10) || ' ' || chr(10) || '  '), chr(10)), lambda x: trim(x, {WS})), lambda x: x <> ''), chr(10))) as text_md5
from documents""")
def _(t):
    broken = F.replace("text", F.lit(". "), F.lit("\n \n  "))
    return t.given("documents").select("doc_id", F.md5(txt.strip_blank_lines(broken)).alias("text_md5"))


@query("b5_unsupported_files", "", f"""
select doc_id, true as success, 'unsupported' as status, '{files.NO_TEXT}' as last_error
from documents where doc_id not in (select doc_id from labels)""")
def _(t):
    return files.unsupported_files(t.given("documents"), t.given("labels"), "doc_id")


# RE2 has no lookaround: long numbers are found among words, and what follows an option is written back
SPOKEN_RE2 = re.sub(r"\\u([0-9A-F]{4})", r"\\x{\1}", txt.SPOKEN_SYMBOLS)


@query("b6_plain_text", "", f"""
with marked as (select page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '{SPOKEN_RE2}', '', 'g'),
  '(?s)```.*?```', '', 'g'), '`[^`]*`', '', 'g'), '[*_~#>]', '', 'g'), '\\[([^\\]]*)\\]\\([^)]*\\)', '\\1', 'g') as text from pages)
, spelled as (select page_id, array_to_string(list_transform(regexp_extract_all(text, '[A-Za-z0-9_]+|[^A-Za-z0-9_]+'),
  lambda x: case when regexp_full_match(x, '[0-9]{{4,}}') then array_to_string(string_split(x, ''), ' ') else x end), '') as text from marked)
select page_id, trim(regexp_replace(text, '\\n{{2,}}', '. ', 'g'), {WS}) as spoken from spelled""")
def _(t):
    return t.given("pages").select("page_id", txt.plain_text("html").alias("spoken"))


@query("b7_normalize_answer_layout", "", """
with quiz as (select conv_id, turn, text || chr(10) || 'A) um B) dois **C)** tres D) quatro ' || chr(10) || 'Referências: • ' || text as text from conversations)
, options as (select conv_id, turn, regexp_replace(text, '(?m)(?:^|\\s)(?:\\*\\*)?([A-D])\\)(?:\\*\\*)?(\\s)', chr(10) || chr(10) || '**\\1)**\\2', 'g') as text from quiz)
select conv_id, turn, regexp_replace(regexp_replace(text, '(?is)^(.*?)(?:\\*\\*Refer[êe]ncias:?\\*\\*|Refer[êe]ncias:?)\\s*(?:•|-|\\*)?\\s*', '\\1**Referências:**' || chr(10) || chr(10) || '- '),
  '(?i)(\\n- [^\\n]+)\\s+(?:•|-|\\*)\\s*(Refer[êe]ncia:)', '\\1' || chr(10) || '- \\2', 'g') as answer from options""")
def _(t):
    quiz = F.concat("text", F.lit("\nA) um B) dois **C)** tres D) quatro \nReferências: • "), "text")
    return t.given("conversations").select("conv_id", "turn", txt.normalize_answer_layout(quiz).alias("answer"))


# ---- C: chunking

@query("c1_chunk_recursive")
def _(t):
    return chunking.chunk_recursive(text_files(t))


@query("c2_chunk_by_heading", "", f"""
with recursive marked as (select doc_id, source, regexp_replace(text, '\\n([A-M])', chr(10) || '# \\1', 'g') as text from documents)
, split as (select doc_id, source, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, {WS})), lambda x: x <> '') as l from marked)
, lines as (select doc_id, source, generate_subscripts(l, 1) as i, unnest(l) as line from split)
, placed as (select *, max(case when line like '#%' then i else 0 end) over (partition by doc_id order by i) as head from lines)
, body as (select *, row_number() over (partition by doc_id, head order by i) as j, length(line) as n from placed where line not like '#%')
, walk(doc_id, head, j, s, chars) as (
  select doc_id, head, j, j, n from body where j = 1
  union all
  select w.doc_id, w.head, b.j, case when w.chars + b.n > 1200 then b.j else w.s end, case when w.chars + b.n > 1200 then b.n else w.chars + b.n end
  from walk w join body b on b.doc_id = w.doc_id and b.head = w.head and b.j = w.j + 1)
, packed as (select b.doc_id, b.source, b.head, w.s, string_agg(b.line, chr(10) order by b.j) as text from walk w join body b using (doc_id, head, j) group by all)
, named as (select p.doc_id, p.source, p.head, p.s, case when h.line is null or trim(ltrim(h.line, '#'), {WS}) = '' then p.text else trim(ltrim(h.line, '#'), {WS}) || chr(10) || p.text end as content
  from packed p left join lines h on h.doc_id = p.doc_id and h.i = p.head where length(p.text) >= 80)
select doc_id as file_id, source, cast(row_number() over (partition by doc_id order by head, s) - 1 as int) as chunk_index, content, sha256(content) as content_hash from named""")
def _(t):
    marked = t.spread("documents").select(F.col("doc_id").alias("file_id"), "source", F.regexp_replace("text", "\n([A-M])", "\n# $1").alias("text"))
    return chunking.chunk_by_heading(marked)


@query("c2_heading_sections", "", f"""
, lines as (select doc_id, generate_subscripts(l, 1) - 1 as pos, unnest(l) as line from (
    select doc_id, list_filter(list_transform(string_split(replace(text, chr(10), chr(10) || '# '), chr(10)), lambda x: trim(x, {WS})), lambda x: x <> '') as l from documents))
select doc_id as file_id, pos, md5(line) as line_md5,
  count(*) filter (where line like '#%') over (partition by doc_id order by pos) as section from lines""".replace(", lines as", "with lines as", 1))
def _(t):
    marked = t.given("documents").select(F.col("doc_id").alias("file_id"), F.replace("text", F.lit("\n"), F.lit("\n# ")).alias("text"))
    return chunking.heading_sections(marked).select("file_id", F.col("pos").cast("bigint").alias("pos"), F.md5("line").alias("line_md5"), "section")


@query("c3_chunk_by_page_lines", "", f"""
with recursive split as (select doc_id, source, list_filter(string_split(text, chr(10)), lambda x: x <> '') as l from documents)
, lines as (select doc_id, source, generate_subscripts(l, 1) as i, trim(unnest(l), {WS}) as line from split)
, walk(doc_id, i, s, chars) as (
  select doc_id, i, i, length(line) from lines where i = 1
  union all
  select w.doc_id, b.i, case when w.chars + length(b.line) > 1200 then b.i else w.s end, case when w.chars + length(b.line) > 1200 then length(b.line) else w.chars + length(b.line) end
  from walk w join lines b on b.doc_id = w.doc_id and b.i = w.i + 1)
, packed as (select b.doc_id, b.source, w.s, max(b.i) as last, trim(string_agg(b.line, chr(10) order by b.i), {WS}) as text from walk w join lines b using (doc_id, i) group by all)
, paged as (select *, coalesce(lead(s) over (partition by doc_id order by s), last) as page from packed)
select doc_id as file_id, source, cast(page as int) as page_number, cast(row_number() over (partition by doc_id order by s) - 1 as int) as chunk_index,
  '[Pág. ' || page || '] ' || text as content, sha256(text) as content_hash from paged where length(text) >= 80""")
def _(t):
    return chunking.chunk_by_page_lines(line_pages(t))


# ---- D: identity and deduplication

@query("d1_content_hash", "", "select doc_id, sha256(text) as content_hash from documents")
def _(t):
    return t.given("documents").select("doc_id", identity.content_hash("text").alias("content_hash"))


@query("d2_backfill_content_hash", "chunks", "select id, coalesce(content_hash, sha256(content)) as content_hash from chunks")
def _(t):
    return dedup.backfill_content_hash(t.chunks).select("id", "content_hash")


RECORD_NAME = "coalesce(drive_file_id, 'none') || ':' || cast(page_number as string) || ':' || cast(chunk_index as string) || ':' || sha256(content)"


@query("d3_chunk_record_id", "chunks", f"select id, {uuid5_sql(uuid.NAMESPACE_URL, RECORD_NAME)} as record_id from chunks")
def _(t):
    hashed = t.chunks.withColumn("hash", identity.content_hash("content")).withColumn("file", F.coalesce("drive_file_id", F.lit("none")))
    return hashed.select("id", identity.chunk_record_id("file", "page_number", "chunk_index", "hash").alias("record_id"))


@query("d4_normalize_session_id", "messages", f"""
select distinct session_id, case when regexp_matches(session_id, '(?i)^[0-9a-f]{{8}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{12}}$')
  then session_id else {uuid5_sql(uuid.NAMESPACE_DNS, 'session_id')} end as normalized from messages""")
def _(t):
    return t.messages.select("session_id").distinct().select("session_id", identity.normalize_session_id("session_id").alias("normalized"))


@query("d5_anonymize_session", "messages", "select id, 'session-' || substr(sha256(session_id), 1, 12) as case_id from messages")
def _(t):
    return t.messages.select("id", identity.anonymize_session("session_id").alias("case_id"))


@query("d6_skip_existing_by_hash", "", """
select doc_id, sha256(text) as content_hash from documents
where sha256(text) not in (select sha256(d.text) from documents d join labels l on l.doc_id = d.doc_id)""")
def _(t):
    new = t.given("documents").select("doc_id", identity.content_hash("text").alias("content_hash"))
    existing = new.join(t.given("labels").select("doc_id"), "doc_id", "left_semi")
    return dedup.skip_existing_by_hash(new, existing).select("doc_id", "content_hash")


@query("d7_hash_duplicates", "", """
select sha256(text) as content_hash, count(*) as copies from documents group by 1 having count(*) > 1""")
def _(t):
    return dedup.hash_duplicates(t.given("documents").select(identity.content_hash("text").alias("content_hash")))


RETRIED = """select id, session_id, request_id, role, content, created_at from messages union all
  select id || '-retry', session_id, request_id, role, content || '!', created_at + interval '1' minute from messages"""


def retried(t):
    again = t.messages.select(
        F.concat("id", F.lit("-retry")).alias("id"), "session_id", "request_id", "role", F.concat("content", F.lit("!")).alias("content"),
        (F.col("created_at") + F.expr("interval '1' minute")).alias("created_at"))
    return t.messages.select("id", "session_id", "request_id", "role", "content", "created_at").unionByName(again)


@query("d8_dedup_turns", "messages", f"""
, doubled as ({RETRIED})
select id, md5(content) as content_md5 from (
  select *, row_number() over (partition by session_id, request_id, role order by created_at, id) as rn from doubled)
where rn = 1 or request_id is null""")
def _(t):
    return dedup.dedup_turns(retried(t)).select("id", F.md5("content").alias("content_md5"))


@query("d9_distinct_sources", "turns hits", """
select t.id, coalesce(s.sources, '') as sources from turns t left join (
  select id, string_agg(doc_source, '|' order by first) as sources from (
    select id, doc_source, min(rank) as first from hits group by id, doc_source) group by id) s on s.id = t.id
where t.has_meta""")
def _(t):
    found = dedup.distinct_sources(t.telemetry().filter(F.col("metadata").isNotNull()))
    return found.select("id", F.array_join("sources", "|").alias("sources"))


# ---- E: reconciliation

def listing(t):
    return t.listing.select(
        "id", "name", "drive_path", F.col("mime_type").alias("mimeType"), F.col("modified_time").alias("modifiedTime"),
        F.col("md5_checksum").alias("md5Checksum"))


def plan(t):
    return sync.plan_sync(listing(t), t.manifest)


SAME = """(l.name is not distinct from m.name
    and coalesce(nullif(l.drive_path, ''), l.name) is not distinct from coalesce(nullif(m.drive_path, ''), m.name)
    and case when l.md5_checksum <> '' and m.md5_checksum <> '' then l.md5_checksum = m.md5_checksum
      else replace(l.modified_time, 'Z', '+00:00') is not distinct from m.modified_time end)"""
PLAN = f"""
, plan as (
  select case when m.drive_file_id is null then 'new' when l.id is null then 'removed'
      when m.status = 'active' and {SAME} then 'unchanged' else 'changed' end as class,
    coalesce(l.id, m.drive_file_id) as file_id, case when l.id is null then m.name else l.name end as name,
    case when l.id is null then m.drive_path else l.drive_path end as drive_path,
    case when l.id is null then m.mime_type else l.mime_type end as mime_type, m.chunks_count as chunks_count
  from listing l full join manifest m on l.id = m.drive_file_id)
, sorted as (select *, coalesce(nullif(drive_path, ''), nullif(name, ''), '') as sort_path from plan)"""


@query("e1_plan_sync", "listing manifest", PLAN + "select class, file_id, name, sort_path from sorted")
def _(t):
    return plan(t).select("class", "file_id", "name", "sort_path")


FATES = """
, doc as (select 'f' || doc_id as id, doc_id, coalesce(text, '') as text, source, regexp_replace(coalesce(text, '') || case when doc_id % 2 = 0 then source else '' end, '\\s+', '', 'g') as packed
  from documents)
, outcome as (
  select s.file_id, d.*, class, case when class not in ('new', 'changed') then class when d.id is null or doc_id % 13 = 0 then 'lost'
    when doc_id % 11 = 0 then 'broken' when doc_id % 17 = 0 or packed = '' then 'blank' else 'good' end as fate from sorted s left join doc d on d.id = s.file_id)"""


def packed_files(chunks):
    """Per file the digest of its chunks one after the other, without white space."""
    packed = F.regexp_replace(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "content"))), lambda c: c["content"]), ""), r"\s+", "")
    return chunks.groupBy("drive_file_id").agg(F.md5(packed).alias("packed_md5"))


@query("e_reconcile", "listing manifest", PLAN + FATES + """
select file_id as drive_file_id, md5(packed) as packed_md5 from outcome where fate = 'good'
union all select drive_file_id, md5('old') from manifest m join outcome o on o.file_id = m.drive_file_id where fate in ('lost', 'broken', 'unchanged')""")
def _(t):
    """The chunk table after a run over all whole documents as files: broken ones and ones without bytes keep what they had."""
    return packed_files(reconciled(t).table)


STRIPPED = "'" + "".join(c for c in map(chr, range(0x3001)) if c.isspace()) + "'"


def chunk_counts_sql(pages: str) -> str:
    """CTEs up to ``counts`` (file_id, chunks) for DuckDB: how many chunks of up to 1,000 characters without overlap the recursive splitter cuts from
    the stripped ``pages`` (file_id, path, text), found by levels of separators: pieces that are too long go to the next one, runs of others are packed."""
    parts, nodes = [], f"(select file_id, path, text from {pages})"
    for level, separator in enumerate(chunking.SEPARATORS):
        mark = "'" + separator.replace("\n", "' || chr(10) || '") + "'"
        here = f"contains(text, {mark})" if separator else "true"
        pieces = f"list_filter(list_transform(string_split(text, {mark}), lambda x, i: case when i > 1 then {mark} || x else x end), lambda x: x <> '')"
        parts.append(f"""
, piece{level} as (select file_id, path, unnest(l) as text, generate_subscripts(l, 1) as i from (select file_id, path, {pieces} as l from {nodes} n where {here}) s)
, run{level} as (select *, length(text) as n, count(*) filter (where length(text) >= 1000) over (partition by file_id, path order by i) as run from piece{level})
, left{level} as (select file_id, path || '.' || i as path, text from run{level} where n >= 1000
  union all select file_id, path, text from {nodes} n where not {here})
, cut{level} as (select file_id, list_reduce(list({{'done': 0, 'chars': n, 'ink': case when trim(text, {STRIPPED}) = '' then 0 else 1 end}} order by i), lambda a, x:
    case when a.chars + x.chars > 1000 then {{'done': a.done + a.ink, 'chars': x.chars, 'ink': x.ink}}
      else {{'done': a.done, 'chars': a.chars + x.chars, 'ink': greatest(a.ink, x.ink)}} end) as r from run{level} where n < 1000 group by file_id, path, run)""")
        nodes = f"left{level}"
    every = " union all ".join(f"select file_id, r from cut{level}" for level in range(len(chunking.SEPARATORS)))
    return "".join(parts) + f"""
, counts as (select file_id, cast(sum(r.done + r.ink) as int) as chunks from ({every}) c group by file_id)"""


@query("e_reconcile_manifest", "listing manifest", PLAN + FATES + f"""
, split as (select file_id, string_split(text || case when doc_id % 2 = 0 then chr(12) || source else '' end, chr(12)) as l from outcome where fate = 'good')
, pages as (select file_id, cast(generate_subscripts(l, 1) as varchar) as path, trim(unnest(l), {STRIPPED}) as text from split)""" + chunk_counts_sql("pages") + """
select drive_file_id, m.status, cast(m.chunks_count as int) as chunks_count from manifest m join outcome o on o.file_id = m.drive_file_id where fate = 'unchanged'
union all select o.file_id, case when fate in ('good', 'blank') then 'active' else 'error' end, coalesce(c.chunks, 0)
from outcome o left join counts c on c.file_id = o.file_id where class in ('new', 'changed')""")
def _(t):
    """The manifest after that run, with the number of chunks that each whole text was cut into."""
    return reconciled(t).manifest.select("drive_file_id", "status", F.col("chunks_count").cast("int").alias("chunks_count"))


def two_pages(content: bytes) -> list[str]:
    if content == b"broken":
        raise ValueError("cannot be read")
    return content.decode().split("\f")


def flat(texts, task):
    """A stand-in for the user's embedding function."""
    return [[1.0] for _ in texts]


def reconciled(t):
    """A run whose files hold each document's text and, for even ones, its source on a second page; contents and chunks are tables
    dealt by file, of which only the parts that are needed are read."""
    i = F.col("doc_id")
    text = F.coalesce("text", F.lit(""))
    content = F.when(i % 11 == 0, F.lit("broken")).when(i % 17 == 0, F.lit(" \f ")).when(
        i % 2 == 0, F.concat(text, F.lit("\f"), "source")).otherwise(text)
    contents = t.spread("documents").filter(i % 13 != 0).select(
        F.concat(F.lit("f"), i.cast("string")).alias("id"), content.cast("binary").alias("content"))
    target = t.manifest.select(
        F.concat(F.lit("old-"), "drive_file_id").alias("id"), F.lit("old").alias("content"), F.lit("s").alias("source"), "drive_file_id")
    target = target.select("*", F.lit(None).cast("int").alias("chunk_index"))
    stored = sinks.DealtTable(t.spark, scratch_path(t.spark, "contents"), ("id",), parts=8)
    stored.replace(contents, list(range(8)))
    table = sinks.DealtTable(t.spark, scratch_path(t.spark, "chunks"), parts=8)
    table.replace(target, list(range(8)))
    return corpus.reconcile_into(table, listing(t), t.manifest, stored, two_pages, flat, 1, overlap=0, now=F.to_timestamp(F.lit("2024-04-01 00:00:00")))


@query("e2_same_version", "listing manifest", f"select l.id, {SAME} as same from listing l join manifest m on l.id = m.drive_file_id")
def _(t):
    joined = listing(t).alias("l").join(t.manifest.alias("m"), F.col("l.id") == F.col("m.drive_file_id"))
    return joined.select("l.id", sync.same_version().alias("same"))


@query("e3_upsert_chunks", "chunks", f"""
, newer as ({NEWER})
select id, md5(content) as content_md5 from chunks where id not in (select id from newer)
union all select id, md5(content) from newer""")
def _(t):
    target = t.chunks.select("id", "content", "source", "drive_file_id")
    return sync.upsert_chunks(target, newer_chunks(t)).select("id", F.md5("content").alias("content_md5"))


@query("e3_upsert_report", "chunks", f"""
, newer as ({NEWER})
select count(*) as written, count(*) filter (where id not in (select id from chunks)) as inserted,
  count(*) filter (where id in (select id from chunks)) as updated from newer""")
def _(t):
    return sync.upsert_report(t.chunks, newer_chunks(t))


@query("e4_remove_stale", "chunks", """
, current as (select cast(doc_id * 2 as string) as id, drive_file_id from chunks)
select id, drive_file_id from chunks
where not coalesce(drive_file_id in (select drive_file_id from current where drive_file_id is not null) and id not in (select id from current), false)""")
def _(t):
    current = t.chunks.select((F.col("doc_id") * 2).cast("string").alias("id"), "drive_file_id")
    return sync.remove_stale(t.chunks, current, current).select("id", "drive_file_id")


PROCESSED = "select distinct source as name, lang from chunks where source <> ''"


@query("e5_remove_legacy", "chunks", f"""
, listed as (select source || case when doc_id % 100 > 8 then '' else lang end as name from chunks)
, lone as (select name from listed group by name having count(*) = 1)
select id, source from chunks where not (drive_file_id is null and source in (select name from lone))""")
def _(t):
    listed = t.chunks.select(F.concat("source", F.when(F.col("doc_id") % 100 > 8, F.lit("")).otherwise(F.col("lang"))).alias("name"))
    processed = t.chunks.select(F.col("source").alias("name"))
    names = processed.unionByName(listed)
    return sync.remove_legacy(t.chunks, names, listed).select("id", "source")


@query("e6_remove_files", "listing manifest chunks", PLAN + """
select 'chunk' as kind, id as key from chunks where drive_file_id is null or drive_file_id not in (select file_id from plan where class = 'removed')
union all select 'manifest', drive_file_id from manifest where drive_file_id not in (select file_id from plan where class = 'removed')""")
def _(t):
    gone = plan(t).filter(F.col("class") == "removed").select(F.col("file_id").alias("drive_file_id"))
    kept, entries = sync.remove_files(t.chunks, t.manifest, gone)
    return kept.select(F.lit("chunk").alias("kind"), F.col("id").alias("key")).unionByName(
        entries.select(F.lit("manifest").alias("kind"), F.col("drive_file_id").alias("key")))


@query("e7_select_batch", "listing manifest", PLAN + """
select class, file_id, row_number() over (order by case class when 'changed' then 0 else 1 end, sort_path, file_id) <= 40 as selected
from sorted where class in ('changed', 'new')""")
def _(t):
    return sync.select_batch(plan(t), 40).select("class", "file_id", "selected")


@query("e8_jobs_from_plan", "listing manifest", PLAN + """
select case class when 'changed' then 0 when 'new' then 1 else 2 end as priority, class as action, file_id as drive_file_id, name,
  case when class = 'removed' then coalesce(drive_path, name) else drive_path end as drive_path,
  case when class = 'removed' then coalesce(mime_type, 'application/octet-stream') else mime_type end as mime_type,
  case when class <> 'removed' then name in (select name from listing group by name having count(*) = 1) end as cleanup_legacy_source
from plan where class <> 'unchanged'""")
def _(t):
    return sync.jobs_from_plan(plan(t), listing(t))


NOW = "timestamp '2024-03-01 00:00:00'"


def results(t):
    """Per-file results of a run over the listing."""
    n = F.expr("cast(substr(id, 2) as bigint)")
    return t.listing.select(
        "id", "name", "drive_path", "mime_type", F.when(n % 4 != 1, F.col("modified_time")).alias("modified_time"), "md5_checksum",
        F.when(n % 5 == 0, 0).otherwise(n % 40).cast("int").alias("total_chunks"), (n % 6 != 5).alias("success"),
        F.when(n % 5 == 0, "unsupported").otherwise("active").alias("status"),
        F.when((n % 6 == 5) | (n % 5 == 0), F.array(F.repeat(F.col("name"), 300), F.lit("second"))).otherwise(
            F.array().cast("array<string>")).alias("errors"),
        F.when(n % 3 == 0, "new").otherwise("changed").alias("action"), (n % 7).cast("int").alias("total_pages"),
        (n % 40).cast("int").alias("inserted"), F.lit(0).alias("skipped"), (n % 3).cast("int").alias("removed"))


RESULTS = """
, results as (select *, cast(substr(id, 2) as bigint) as n from listing)"""


@query("e9_manifest_rows", "listing", RESULTS + """
select id as drive_file_id, name, coalesce(drive_path, name) as drive_path, coalesce(mime_type, 'application/octet-stream') as mime_type,
  case when n % 4 <> 1 then replace(replace(modified_time, 'T', ' '), 'Z', '') else '2024-03-01 00:00:00' end as modified_time, md5_checksum,
  cast(case when n % 5 = 0 then 0 else n % 40 end as int) as chunks_count, case when n % 6 <> 5 then 'active' else 'error' end as status,
  case when n % 6 <> 5 then '2024-03-01 00:00:00' end as last_synced_at,
  case when n % 6 = 5 or n % 5 = 0 then substr(repeat(name, 300) || '; second', 1, 4000) end as last_error,
  '2024-03-01 00:00:00' as updated_at from results""")
def _(t):
    return sync.manifest_rows(results(t), F.expr(NOW))


@query("e10_sync_report", "listing manifest", PLAN + """
, done as (select case when n % 3 = 0 then 'new' else 'changed' end as action, n % 6 <> 5 as success, n % 40 as inserted, 0 as skipped, n % 3 as removed
  from (select cast(substr(id, 2) as bigint) as n from listing)
  union all select 'unchanged', true, 0, coalesce(chunks_count, 0), 0 from plan where class = 'unchanged')
select action, count(*) as files, count(*) filter (where success) as ok, count(*) filter (where not success) as failed,
  cast(sum(inserted) as bigint) as inserted, cast(sum(skipped) as bigint) as skipped, cast(sum(removed) as bigint) as removed from done group by action""")
def _(t):
    columns = ["action", "success", "inserted", "skipped", "removed"]
    return sync.sync_report(results(t).select(*columns).unionByName(sync.plan_results(plan(t)).select(*columns)))


@query("e10_report_lines", "listing", RESULTS + """
select id, '[' || case when n % 6 = 5 then 'FALHOU' when n % 5 = 0 then 'AVISO' else 'OK' end || '] | ' || name || ' | ' || (n % 7) || ' paginas | '
  || case when n % 5 = 0 then 0 else n % 40 end || ' chunks | ' || (n % 40) || ' gravados | ' || (n % 3) || ' removidos | acao='
  || case when n % 3 = 0 then 'new' else 'changed' end as summary from results""")
def _(t):
    return sync.report_lines(results(t))


@query("e11_rollback_partial", "chunks", f"""
, newer as ({NEWER}) select distinct id from newer where id not in (select id from chunks)""")
def _(t):
    return sync.rollback_partial(t.chunks, newer_chunks(t))
