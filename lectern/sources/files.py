"""File listings, folder trees and text extraction."""

from __future__ import annotations

import io
import xml.etree.ElementTree as ElementTree
import zipfile
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..schemas import ACCEPTANCE_CASES, PAGES
from ..session import written

# File types of the local loaders and of the remote folder.
LOCAL_TYPES = [".pdf"]
RICH_TYPES = [".pdf", ".docx", ".pptx", ".doc"]
FOLDER_TYPE = "application/vnd.google-apps.folder"
REMOTE_TYPES = [
    "application/pdf",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "application/vnd.google-apps.document",
]


def scan_files(spark: SparkSession, path: str, extensions: list[str] = LOCAL_TYPES, recursive: bool = True) -> DataFrame:
    """Files below a folder with one of the extensions (any case). The names are matched before anything is read, and
    ``content`` is read only if used; no order is given, since sorting would move the bytes."""
    def any_case(extension: str) -> str:
        return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in extension)

    glob = "{" + ",".join(f"*{any_case(e)}" for e in extensions) + "}"
    return spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option(
        "pathGlobFilter", glob).load(path)


def folder_paths(nodes: DataFrame, root: str) -> DataFrame:
    """Supported files below a root folder with their path ``ROOT/a/b``, at any depth.

    nodes: id, parent, name, mime_type, trashed. Only folders take part in the descent, one level at a time; a folder
    that was visited is not entered again, so folders that hold each other end it. The files, the bulk of
    the tree, are joined to the finished folder paths once. Of several paths to a folder the shortest counts, then the first by name."""
    live = nodes.filter(~F.coalesce("trashed", F.lit(False)))
    folders = written(live.filter(F.col("mime_type") == FOLDER_TYPE).select("id", "parent", "name"), "folders")
    level = nodes.sparkSession.createDataFrame([(root, "ROOT")], "id string, path string")
    visited = level
    while True:
        above = level.select(F.col("id").alias("_above"), "path")
        level = written(folders.join(above, F.col("parent") == F.col("_above")).groupBy("id").agg(
            F.min(F.concat("path", F.lit("/"), "name")).alias("path")).join(visited.select("id"), "id", "left_anti"), "level")
        if level.isEmpty():
            break
        visited = visited.unionByName(level)
    files = live.filter(F.col("mime_type").isin(REMOTE_TYPES))
    return files.alias("f").join(visited.alias("p"), F.col("f.parent") == F.col("p.id")).select(
        "f.*", F.concat("p.path", F.lit("/"), "f.name").alias("drive_path"))


def read_acceptance_cases(spark: SparkSession, path: str, one_document: bool = True) -> DataFrame:
    """Cases from a JSON array spread over lines, or from one array or object per line."""
    return spark.read.option("multiLine", one_document).schema(ACCEPTANCE_CASES).json(path)


def docx_pages(content: bytes) -> list[str]:
    """Text of a DOCX as one page; nothing when it cannot be parsed."""
    word = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            root = ElementTree.fromstring(archive.read("word/document.xml"))
    except Exception:
        return []
    paragraphs = ("".join(t.text or "" for t in p.iter(f"{word}t")).strip() for p in root.iter(f"{word}p"))
    return ["\n\n".join(p for p in paragraphs if p)]


def extract_pages(files: DataFrame, extractor: Callable[[bytes], list[str]], content: str = "content") -> DataFrame:
    """Replaces the bytes of each file by ``pages``: stripped text with page numbers from 1, blank pages left out.

    ``extractor`` turns one file's bytes into the texts of its pages. A failure yields no pages and the message
    in ``extract_error``."""
    return _extracted(files, {None: extractor}, F.lit(None).cast("string"), content)


def _extracted(files: DataFrame, extractors: dict[str | None, Callable], route: Column, content: str) -> DataFrame:
    kind = pa.struct([
        ("pages", pa.list_(pa.struct([("page_number", pa.int32()), ("text", pa.string())]))),
        ("error", pa.string()),
    ])

    def one(data: bytes | None, to: str | None) -> dict:
        try:
            if to not in extractors:
                raise LookupError(f"no extractor for route {to}")
            texts = extractors[to](data or b"")
        except Exception as error:  # a broken file must not stop the others
            return {"pages": [], "error": f"{type(error).__name__}: {error}"[:4000]}
        stripped = ((n, (t or "").strip()) for n, t in enumerate(texts, start=1))
        return {"pages": [{"page_number": n, "text": t} for n, t in stripped if t], "error": None}

    @F.arrow_udf(f"struct<pages:{PAGES.simpleString()},error:string>")
    def run(data: pa.Array, routes: pa.Array) -> pa.Array:
        return pa.array([one(v.as_py(), r.as_py()) for v, r in zip(data, routes)], type=kind)

    return files.withColumn("_x", run(F.col(content), route)).drop(content).select(
        "*", F.col("_x.pages").alias("pages"), F.col("_x.error").alias("extract_error")).drop("_x")


def explode_pages(files: DataFrame, keep: list[str]) -> DataFrame:
    """One row per page."""
    return files.select(*keep, F.explode("pages").alias("p")).select(*keep, "p.page_number", "p.text")


def route_extractor(name: Column | str, bulk: bool = False) -> Column:
    """Which parser a file name asks for: docx or pdf; in bulk loading light (PDF) or structured (the rest)."""
    lower = F.lower(name)
    if bulk:
        return F.when(lower.endswith(".pdf"), F.lit("light")).otherwise(F.lit("structured"))
    return F.when(lower.endswith(".docx"), F.lit("docx")).otherwise(F.lit("pdf"))


def extract_routed(files: DataFrame, name: str, extractors: dict[str, Callable], bulk: bool = False) -> DataFrame:
    """One pass over the files, each given to the extractor of its route.

    A failure is an error row, and so is a file whose route has no extractor. In bulk loading a PDF that fails just has no
    pages."""
    done = _extracted(files.withColumn("route", route_extractor(name, bulk)), extractors, F.col("route"), "content")
    if bulk:
        done = done.withColumn("extract_error", F.when(F.col("route") != "light", F.col("extract_error")))
    return done


# Fixed value: message recorded for files without extractable text.
NO_TEXT = "Nenhum texto extraível encontrado; envie uma versão com OCR para indexação."


def unsupported_files(files: DataFrame, pages: DataFrame, key: str = "file_id") -> DataFrame:
    """Files without any page of text: a success with status ``unsupported`` and the reason."""
    return files.join(pages.select(key), key, "left_anti").select(
        key, F.lit(True).alias("success"), F.lit("unsupported").alias("status"), F.lit(NO_TEXT).alias("last_error"))
