"""Prompt context, history text and bibliographic references, assembled from retrieved chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.base import SPACES, col, join_sorted, present, rstrip, strip
from ..functions.text import sanitize
from .ordering import first_n_per_key

NO_MATERIAL = "Nenhum material disponível."
# Fixed value: line shown when no chunk gives a bibliographic hint.
NO_REFERENCE = "Informação não disponível no artigo, consultar o Plano de Ensino ou docentes."
REFERENCED_MODES = ["resumo", "resumo_aprofundar", "resumo_reformular", "info", "livre"]


def format_context(questions: DataFrame, matches: DataFrame, key: str = "query_id", legacy: bool = False) -> DataFrame:
    """Numbered context block per question; questions without matches get a fixed text. Matches are numbered from 1 in
    the order of their ranks, so that no number is missing after some were dropped."""
    matches = matches.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy("rank")))
    number = F.col("rank").cast("string")
    shown = F.format_string("%.2f", "similarity")
    if legacy:
        head = F.concat(F.lit("["), number, F.lit("] **Arquivo:** "), F.coalesce("source", F.lit("Fonte desconhecida")),
                        F.lit(" (similaridade: "), shown, F.lit(")\n"))
    else:
        head = F.concat(F.lit("["), number, F.lit("] Trecho RAG "), number, F.lit(" (similaridade: "), shown, F.lit(")\n"))
    entry = F.struct(F.col("rank").alias("pos"), F.concat(head, "content").alias("text"))
    blocks = matches.groupBy(key).agg(join_sorted(entry, "\n\n---\n\n").alias("context"))
    return questions.select(key).join(blocks, key, "left").withColumn(
        "context", F.coalesce("context", F.lit(NO_MATERIAL)))


def format_history(messages: DataFrame, n: int = 12, legacy: bool = False) -> DataFrame:
    """The newest n messages of each session as lines, oldest first."""
    newest = first_n_per_key(messages, ["session_id"], [F.desc("created_at"), F.desc("id")], n)
    who = F.when(F.col("role") == "user", F.lit("Estudante")).otherwise(F.lit("Tutor"))
    label = F.concat(F.lit("**"), who, F.lit(":** ")) if legacy else F.concat(who, F.lit(": "))
    entry = F.struct((-F.col("_rn")).alias("pos"), F.concat(label, F.coalesce("content", F.lit(""))).alias("text"))
    return newest.groupBy("session_id").agg(join_sorted(entry, "\n").alias("history"))


# Patterns of a citation line and of a chapter heading.
# (Possessive: what may follow a name cannot be part of one, so giving letters back never helps.)
_NAME = "[A-ZÀ-Ý][A-Za-zÀ-ÿ'’.-]++"
_PEOPLE = f"{_NAME}(?:\\s+(?:{_NAME}|de|da|do|dos|das)){{0,5}}+"
CITATION_LINE = f"(?md)^\\s*({_PEOPLE})\\s*\\(?((?:19|20)\\d{{2}})\\)?[.,]\\s*(.{{12,180}})$"
CHAPTER_LINE = "(?imud)^\\s*(?:cap[ií]tulo|cap\\.)\\s*(\\d+)?\\s*[-—–:.]\\s*(.{8,180})$"


def reference_fields(text: Column) -> Column:
    """struct<author, year, title, section> from a citation line, else from a chapter heading, else null."""
    text = sanitize(text)
    cited = F.rlike(text, F.lit(CITATION_LINE))
    headed = F.rlike(text, F.lit(CHAPTER_LINE))
    title = lambda pattern, group: F.rtrim(strip(F.regexp_extract(text, pattern, group)), F.lit(". "))
    number = F.regexp_extract(text, CHAPTER_LINE, 1)
    none = F.lit(None).cast("string")
    return F.when(cited, F.struct(
        strip(F.regexp_extract(text, CITATION_LINE, 1)).alias("author"),
        F.regexp_extract(text, CITATION_LINE, 2).alias("year"),
        title(CITATION_LINE, 3).alias("title"),
        none.alias("section"),
    )).when(headed, F.struct(
        none.alias("author"), none.alias("year"), title(CHAPTER_LINE, 2).alias("title"),
        F.when(number != "", F.concat(F.lit("Cap. "), number)).alias("section"),
    ))


def extract_reference_metadata(files: DataFrame, pages: int = 3) -> DataFrame:
    """Adds ``reference`` from the first pages of each file (pages array)."""
    head = F.array_join(F.transform(F.slice("pages", 1, pages), lambda p: F.coalesce(p["text"], F.lit(""))), "\n")
    return files.withColumn("reference", reference_fields(head))


def backfill_references(chunks: DataFrame, texts: int = 20) -> DataFrame:
    """Fill reference fields of chunks that lack a title from the first chunk texts of their file.

    Chunks are grouped by file id, else by source. chunks: id, content, source, drive_file_id, chunk_index,
    reference_author/year/title/section."""
    keyed = chunks.withColumn("_key", F.coalesce(
        F.concat(F.lit("drive:"), present("drive_file_id")),
        F.concat(F.lit("source:"), F.coalesce("source", F.lit("")))))
    first = first_n_per_key(
        keyed.select("_key", "content", "chunk_index", "id"), ["_key"], [F.asc_nulls_last("chunk_index"), F.asc("id")], texts)
    entry = F.struct(F.col("_rn").alias("pos"), F.col("content").alias("text"))
    found = first.groupBy("_key").agg(reference_fields(join_sorted(entry, "\n")).alias("_ref")).filter(
        F.col("_ref").isNotNull())
    lacking = F.col("reference_title").isNull() & F.col("_ref").isNotNull()
    # the extracted fields overlay the stored ones; a field that was not extracted stays
    fill = lambda name: F.when(lacking, F.coalesce(F.col(f"_ref.{name}"), F.col(f"reference_{name}"))).otherwise(
        F.col(f"reference_{name}")).alias(f"reference_{name}")
    filled = {f"reference_{n}": fill(n) for n in ("author", "year", "title", "section")}
    return keyed.join(found, "_key", "left").select(*[filled.get(c, F.col(c)) for c in chunks.columns])


# Patterns of citations, chapters, pages and author lines inside a passage.
# A word boundary that knows ASCII letters only, in front of a capital and of a plain letter.
_W = "[A-Za-z0-9_]"
_BEFORE_CAPITAL = f"(?:(?=[A-Z])(?<!{_W})|(?=[À-Ý])(?<={_W}))"
_CITATION = f"({_PEOPLE})\\s*\\(?((?:19|20)[0-9]{{2}})\\)?\\.\\s*([^.!?]{{12,160}})(?:\\.|$)"
_CHAPTER = "(?:cap[ií]tulo|cap\\.)\\s*([0-9]+)?\\s*[-—–:.]?\\s*([^.!?]{8,140})"
INLINE_PAGE = f"(?iu)(?<!{_W})(?:p\\.?|p[aá]gina(?:s)?)\\s*([0-9]+(?:\\s*(?:-|–|a)\\s*[0-9]+)?)"
AUTHOR_LINE = (
    f"^{_NAME}(?:\\s+[A-ZÀ-Ý]{{1,4}}[A-Za-zÀ-ÿ'’.-]*)*(?:\\s*,\\s*|\\s+e\\s+|\\s+{_NAME}){{1,}}"
)
_END_MARKS = "[.:;]+$"


def _stored_reference(metadata: Column) -> Column:
    author, year, title, section = (
        present(strip(metadata[f"reference_{f}"])) for f in ("author", "year", "title", "section"))
    full_title = F.concat(title, F.coalesce(F.concat(F.lit(" ("), section, F.lit(")")), F.lit("")), F.lit("."))
    return F.when(title.isNotNull(), F.concat_ws(" ", author, F.concat(F.lit("("), year, F.lit(")")), full_title))


def _citation_parts(cited: Column, page: Column) -> Column:
    """Author, year, title and page that the text shows; ``cited`` is the matched piece of text."""
    get = lambda group: present(strip(F.regexp_extract(cited, f"^{_CITATION}", group)))
    heading = "(?iu)^(?:cap[ií]tulo|t[ií]tulo)\\s*[:.-]?\\s*"
    title = F.regexp_extract(cited, f"^{_CITATION}", 3)
    return F.array_compact(F.array(
        get(1),
        F.concat(F.lit("("), get(2), F.lit(")")),
        F.when(title != "", F.concat(strip(F.regexp_replace(title, heading, "")), F.lit("."))),
        F.concat(F.lit("p. "), present(page), F.lit(".")),
    ))


def _chapter_reference(found: Column) -> Column:
    get = lambda group: F.regexp_extract(found, f"(?iu)^{_CHAPTER}", group)
    suffix = F.when(get(1) != "", F.concat(F.lit(" (Cap. "), get(1), F.lit(")"))).otherwise(F.lit(""))
    return F.when(get(2) != "", F.concat(F.regexp_replace(strip(get(2)), _END_MARKS, ""), suffix, F.lit(".")))


def _title_above_authors(content: Column) -> Column:
    """A line of 12 to 180 characters right above a line that looks like authors."""
    lines = F.filter(F.transform(F.split(content, "\\r?\\n"), strip), lambda x: x != "")
    above = F.transform(
        F.slice(lines, 1, F.greatest(F.size(lines) - 1, F.lit(0))),
        lambda line, i: F.struct(
            strip(F.regexp_replace(line, "(?iu)^\\[P[aá]g\\.\\s*[0-9]+\\]\\s*", "")).alias("title"),
            F.get(lines, i + 1).alias("authors")),
    )
    good = F.filter(above, lambda x: (F.length(x["title"]) >= 12) & (F.length(x["title"]) <= 180)
                    & F.rlike(x["authors"], F.lit(AUTHOR_LINE)))
    return F.concat(F.regexp_replace(F.get(good, F.lit(0))["title"], _END_MARKS, ""), F.lit("."))


def with_reference(chunks: DataFrame, content: str = "content", metadata: str = "metadata", out: str = "reference") -> DataFrame:
    """Adds the reference of each chunk: stored fields, inline citation, chapter, title above authors, or the fallback.

    The searches over the whole text are columns of their own, so each runs once per chunk."""
    stages = {
        "_text": F.coalesce(col(content), F.lit("")),
        "_flat": strip(F.regexp_replace("_text", SPACES, " ")),
        "_cited": F.regexp_substr("_flat", F.lit(_BEFORE_CAPITAL + _CITATION)),
        "_page": F.regexp_extract("_flat", INLINE_PAGE, 1),
        "_parts": _citation_parts(F.col("_cited"), F.col("_page")),
        "_chapter": F.when(F.size("_parts") < 2, F.regexp_substr("_flat", F.lit(f"(?iu)(?<!{_W}){_CHAPTER}"))),
    }
    staged = chunks
    for name, expression in stages.items():
        staged = staged.withColumn(name, expression)
    reference = F.coalesce(
        _stored_reference(col(metadata)),
        F.when(F.col("_flat") == "", F.lit(NO_REFERENCE)),
        F.when(F.size("_parts") >= 2, F.regexp_replace(F.array_join("_parts", " "), "\\s+\\.", ".")),
        _chapter_reference(F.col("_chapter")),
        _title_above_authors(F.col("_text")),
        F.lit(NO_REFERENCE),
    )
    return staged.withColumn(out, reference).drop(*stages)


# The heading of a references section and the closing question after it.
_REFERENCES_HEADING = "(?isu)^(.*?)(?:^|\\n)\\s*(?:\\*\\*)?refer[êe]ncias:?\\*{0,2}\\s*(.*)$"
_CONTINUATION = (
    "(?isu)^.*?(\\n\\s*\\n(?:\\*{0,2})?(?:deseja|gostaria de|por favor|qual tema|quest[aã]o).*)$"
)


def strip_model_references(text: Column | str) -> Column:
    """Cut the references a model wrote, up to the closing question if there is one."""
    text = col(text)
    before = rstrip(F.regexp_extract(text, _REFERENCES_HEADING, 1))
    after = F.regexp_extract(text, _REFERENCES_HEADING, 2)
    tail = strip(F.regexp_extract(after, _CONTINUATION, 1))
    joined = F.concat_ws("\n\n", present(before), present(tail))
    return F.when(F.rlike(text, F.lit(_REFERENCES_HEADING)), joined).otherwise(strip(text))


def reference_section(lines: Column) -> Column:
    """Section text from reference lines in rank order: distinct, up to five real ones, else the fallback."""
    distinct = F.array_distinct(F.coalesce(lines, F.array().cast("array<string>")))
    real = F.slice(F.filter(distinct, lambda x: x != NO_REFERENCE), 1, 5)
    shown = F.when(F.size(real) > 0, real).otherwise(F.array(F.lit(NO_REFERENCE)))
    return F.concat(F.lit("**Referências:**\n"), F.array_join(F.transform(shown, lambda x: F.concat(F.lit("- "), x)), "\n"))


def finalize_references(answers: DataFrame, matches: DataFrame, key: str = "query_id") -> DataFrame:
    """Answers (key, answer, generation_mode) with the application's own reference section.

    matches: key, rank, reference (see ``with_reference``, run once per chunk); at most k rows per answer."""
    lines = matches.select(key, F.struct(F.col("rank").alias("pos"), F.col("reference").alias("text")).alias("e"))
    per_answer = lines.groupBy(key).agg(F.transform(F.array_sort(F.collect_list("e")), lambda e: e["text"]).alias("_lines"))
    body = strip_model_references("answer")
    needed = F.coalesce(F.col("generation_mode").isin(REFERENCED_MODES), F.lit(False))
    return answers.join(per_answer, key, "left").withColumn(
        "answer",
        F.when(needed, strip(F.concat(body, F.lit("\n\n"), reference_section(F.col("_lines"))))).otherwise(body),
    ).drop("_lines")
