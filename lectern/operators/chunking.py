"""Cutting texts into chunks.

All three chunkers work on one row per file (``pages array<struct<page_number, text>>`` or a text column), the
unit in which extraction delivers text. A file is therefore never assembled by a shuffle, and the position of
a chunk in its file comes from the position in the returned array.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.base import strip
from ..functions.identity import content_hash
from ..functions.text import sanitize

# Separators of the recursive splitter, from paragraphs down to characters.
SEPARATORS = ("\n\n", "\n", ". ", " ", "")


def check_sizes(size: int, overlap: int) -> None:
    if not 200 <= size <= 4000:
        raise ValueError("size must be between 200 and 4000")
    if not 0 <= overlap <= 500 or overlap >= size:
        raise ValueError("overlap must be between 0 and 500 and below size")


def _pieces(text: str, separator: str) -> list[str]:
    """Split in front of every separator, keeping it at the start of the piece that follows."""
    if separator == "":
        return list(text)
    head, *tail = text.split(separator)
    return [p for p in [head, *[separator + t for t in tail]] if p]


def _windows(pieces: Iterable[str], size: int, overlap: int) -> Iterator[str]:
    """Pack pieces into windows of at most ``size``, each starting with up to ``overlap`` of the last one."""
    held: deque[str] = deque()
    length = 0
    for piece in pieces:
        if length + len(piece) > size and held:
            yield "".join(held)
            while held and (length > overlap or (length + len(piece) > size and length > 0)):
                length -= len(held.popleft())
        held.append(piece)
        length += len(piece)
    if held:
        yield "".join(held)


def split_text(text: str, size: int = 1000, overlap: int = 150, separators=SEPARATORS) -> list[str]:
    """Recursive character splitting: the coarsest separator present, finer ones for what is still too long."""
    level = next(i for i, s in enumerate(separators) if s == "" or s in text)
    finer = separators[level + 1:]
    out: list[str] = []
    short: list[str] = []

    def pack():
        out.extend(c for c in (w.strip() for w in _windows(short, size, overlap)) if c)
        short.clear()

    for piece in _pieces(text, separators[level]):
        if len(piece) < size:
            short.append(piece)
            continue
        pack()
        out.extend(split_text(piece, size, overlap, finer) if finer else [piece])
    pack()
    return out


def _spans(lengths: np.ndarray, borders: list[int], size: int) -> Iterator[tuple[int, int]]:
    """Runs [begin, end) of lines of at most ``size`` characters, or of one line that is longer, none across a border.

    Where a run ends is found in the running total of lengths, one search per run."""
    total = np.concatenate([[0], np.cumsum(lengths)])
    for begin, end in zip(borders, borders[1:]):
        while begin < end:
            fits = int(np.searchsorted(total, total[begin] + size, side="right")) - 1
            stop = min(end, max(begin + 1, fits))
            yield begin, stop
            begin = stop


def _lines(text: str) -> list[str]:
    return [x for x in (line.strip() for line in text.split("\n")) if x]


def heading_chunks(markdown: str, size: int, minimum: int) -> list[str]:
    """Lines grouped under the heading above them; short bodies dropped."""
    lines = _lines(markdown)
    marks = [i for i, line in enumerate(lines) if line[0] == "#"]
    # sections are runs of the lines that are no headings; the title of section i is the heading before it
    titles = ["", *(lines[i].lstrip("#").strip() for i in marks)]
    body = [line for line in lines if line[0] != "#"]
    borders = [0, *(i - n for n, i in enumerate(marks)), len(body)]
    section = np.searchsorted(borders[1:-1], np.arange(len(body)), side="right")
    found = ((titles[section[a]], "\n".join(body[a:b])) for a, b in _spans(np.array([len(x) for x in body], np.int64), borders, size))
    return [f"{title}\n{text}" if title else text for title, text in found if len(text) >= minimum]


def page_line_chunks(texts: Iterable[str], size: int, minimum: int) -> list[tuple[int, str]]:
    """(page, body) pairs: lines packed across pages; a chunk belongs to the page of the line that no longer fitted, the
    last one to the last page. Only pages with text are counted."""
    pages = [_lines(text) or [""] for text in texts if text]
    lines = [line for page in pages for line in page]
    number = np.repeat(np.arange(1, len(pages) + 1), [len(page) for page in pages]).tolist() + [len(pages)]
    spans = _spans(np.array([len(x) for x in lines], np.int64), [0, len(lines)], size)
    found = ((number[b], "\n".join(lines[a:b]).strip()) for a, b in spans)
    return [(page, text) for page, text in found if len(text) >= minimum]


def _page_udf(cutter):
    """Arrow UDF from a file's pages to its chunks, both in order.

    ``cutter`` takes the page numbers and texts of one file and yields (page number, chunk). Columns are read and
    built whole, so no Python object is made per struct."""

    @F.arrow_udf("array<struct<page_number:int,content:string>>")
    def cut(pages: pa.Array) -> pa.Array:
        numbers, texts = (c.to_pylist() for c in pages.flatten().flatten())
        ends, out_numbers, out_texts, at = [0], [], [], 0
        for length in pages.value_lengths().fill_null(0).to_pylist():
            for number, chunk in cutter(numbers[at:at + length], texts[at:at + length]):
                out_numbers.append(number)
                out_texts.append(chunk)
            at += length
            ends.append(len(out_texts))
        chunks = pa.StructArray.from_arrays(
            [pa.array(out_numbers, pa.int32()), pa.array(out_texts, pa.string())], names=["page_number", "content"])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), chunks)

    return cut


def _numbered_pages() -> Column:
    """Pages with the two fields the chunkers read, NUL characters removed."""
    return F.transform("pages", lambda p: F.struct(
        p["page_number"].cast("int").alias("page_number"), sanitize(p["text"]).alias("text")))


def _exploded(files: DataFrame, keep: list[str], chunks: Column) -> DataFrame:
    named = files.select(*keep, sanitize("source").alias("source"), chunks.alias("_chunks"))
    return named.select(*keep, "source", F.posexplode("_chunks").alias("chunk_index", "_c")).select(
        *keep, "source", F.col("_c.page_number").alias("page_number"), "chunk_index",
        F.col("_c.content").alias("content"),
    )


def chunk_recursive(
    files: DataFrame, size: int = 1000, overlap: int = 150, keep: Iterable[str] = ("file_id",)
) -> DataFrame:
    """Chunks of every non-blank page; ``chunk_index`` runs over the whole file.

    files: ``keep`` columns, source, pages. Out: keep, source, page_number, chunk_index, content,
    content_hash."""
    check_sizes(size, overlap)

    def cutter(numbers, texts):
        for number, text in zip(numbers, texts):
            if text and text.strip():
                yield from ((number, c) for c in split_text(text, size, overlap))

    return _exploded(files, list(keep), _page_udf(cutter)(_numbered_pages())).withColumn(
        "content_hash", content_hash("content"))


def chunk_by_page_lines(
    files: DataFrame, size: int = 1200, minimum: int = 80, keep: Iterable[str] = ("file_id",)
) -> DataFrame:
    """Lines packed across pages; content carries a page mark that the hash leaves out."""

    def cutter(numbers, texts):
        return page_line_chunks(texts, size, minimum)

    out = _exploded(files, list(keep), _page_udf(cutter)(_numbered_pages()))
    return out.withColumn("content_hash", content_hash("content")).withColumn(
        "content", F.concat(F.lit("[Pág. "), F.col("page_number").cast("string"), F.lit("] "), "content"))


def chunk_by_heading(
    files: DataFrame, text: str = "text", size: int = 1200, minimum: int = 80,
    keep: Iterable[str] = ("file_id",),
) -> DataFrame:
    """Markdown cut by heading; the heading line is part of content and hash."""

    @F.arrow_udf("array<string>")
    def cut(texts: pa.Array) -> pa.Array:
        return pa.array([heading_chunks(t or "", size, minimum) for t in texts.to_pylist()],
                        type=pa.list_(pa.string()))

    named = files.select(*keep, "source", cut(F.col(text)).alias("_chunks"))
    return named.select(*keep, "source", F.posexplode("_chunks").alias("chunk_index", "content")).withColumn(
        "content_hash", content_hash("content"))


def heading_sections(files: DataFrame, text: str = "text", keep: Iterable[str] = ("file_id",)) -> DataFrame:
    """Non-blank trimmed lines with the number of their section (headings met so far)."""
    lines = F.filter(F.transform(F.split(text, "\n"), strip), lambda x: x != "")
    rows = files.select(*keep, F.posexplode(lines).alias("pos", "line"))
    # cumulative heading count per file, accumulated over blocks of lines so that one long file is split up
    block = F.floor(F.col("pos") / 10_000)
    so_far = Window.partitionBy(*keep, "_block").orderBy("pos")
    blocks = (
        rows.groupBy(*keep, block.alias("_block"))
        .agg(F.count_if(F.col("line").startswith("#")).alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(
            Window.partitionBy(*keep).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .drop("_n")
    )
    return rows.withColumn("_block", block).join(blocks, [*keep, "_block"]).select(
        *keep, "pos", "line",
        (F.col("_before") + F.count_if(F.col("line").startswith("#")).over(so_far)).alias("section"),
    )
