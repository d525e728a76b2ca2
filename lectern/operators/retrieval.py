"""Embedding in batches and exact thresholded cosine top-k."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions.base import present
from ..functions.vectors import as_matrix, similarity_to, unit_rows
from ..session import written
from .cells import CellTree
from .ordering import first_n_per_key

ATTEMPTS = 3
# Similarities are compared at this many digits, so that copies of a vector tie whatever block they fall in.
DIGITS = 12


def check_match(k: int, threshold: float) -> None:
    if not 1 <= k <= 20:
        raise ValueError("k must be between 1 and 20")
    if not -1 <= threshold <= 1:
        raise ValueError("threshold must be between -1 and 1")


def embed_batch(texts: list[str], fn: Callable, task: str, dim: int, sleep=time.sleep) -> list[list[float]]:
    """One call for the whole batch, tried three times; a short answer or wrong size fails the batch."""
    for attempt in range(1, ATTEMPTS + 1):
        try:
            vectors = fn(texts, task)
            if len(vectors) != len(texts):
                raise RuntimeError(f"EMBEDDING_COUNT_MISMATCH: expected={len(texts)} received={len(vectors)}")
            if any(len(v) != dim for v in vectors):
                raise RuntimeError(f"EMBEDDING_DIMENSION_MISMATCH: expected={dim}")
            return vectors
        except Exception:
            if attempt == ATTEMPTS:
                raise
            sleep(min(10, max(2, 2 ** (attempt - 1))))


def embed(
    df: DataFrame, fn: Callable[[list[str], str], list[list[float]]], dim: int, text: str = "content",
    batch: int = 20, task: str = "RETRIEVAL_DOCUMENT", out: str = "embedding", sleep=time.sleep,
) -> DataFrame:
    """Adds the vectors that the user's ``fn(texts, task)`` returns, ``batch`` texts per call, in order."""
    if not 1 <= batch <= 100:
        raise ValueError("batch must be between 1 and 100")
    position, names = df.columns.index(text), [*df.columns, out]
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.FloatType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for record in batches:
            texts = record.column(position).to_pylist()
            vectors = []
            for at in range(0, len(texts), batch):
                vectors += embed_batch(texts[at:at + batch], fn, task, dim, sleep)
            column = pa.array([np.asarray(v, dtype=np.float32) for v in vectors], type=pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([*record.columns, column], names=names)

    return df.mapInArrow(run, schema)


def check_vectors(df: DataFrame, dim: int, vector: str = "embedding") -> DataFrame:
    """Rows per vector length, with a flag for lengths other than ``dim``; a missing vector has length -1."""
    length = F.coalesce(F.size(vector), F.lit(-1)).alias("length")
    return df.groupBy(length).agg(F.count("*").alias("rows")).withColumn("bad", F.col("length") != dim)


def match_documents(
    docs: DataFrame, query: Sequence[float], threshold: float = 0.75, k: int = 5,
    source_pattern: str | None = None, vector: str = "embedding",
) -> DataFrame:
    """The k most similar documents at or above the threshold; equal similarities by id.

    A source pattern (SQL wildcards, any case) is applied before ranking and reaches the scan."""
    check_match(k, threshold)
    if source_pattern is not None:
        docs = docs.filter(F.col("source").ilike(source_pattern))
    scored = docs.withColumn("similarity", F.round(similarity_to(vector, query), DIGITS)).drop(vector)
    return scored.filter(F.col("similarity") >= threshold).orderBy(F.desc("similarity"), "id").limit(k)


class _TopK:
    """The best k documents per question, fed with blocks of documents.

    Similarities in single precision rule pairs out; the pairs that are left are scored in double precision."""

    # similarities held at once, and the documents among them
    CELLS, WIDTH = 250_000, 2_000

    def __init__(self, queries: np.ndarray, floors: np.ndarray, k: int):
        self.queries, self.k, self.coarse = queries, k, queries.astype(np.float32)
        # what a new document must reach: the threshold, later the k-th best so far
        self.floors = floors.copy()
        # several times the error of a product of unit vectors in single precision
        self.slack = (queries.shape[1] + 8) * 2.0 ** -22
        # (question, id, similarity), the k best of each question in order, and what came since
        self.held: tuple | None = None
        self.waiting: list[tuple] = []
        self.pairs = 0
        # ids of the k-th best, of questions that have as many
        self.last, self.full = None, np.zeros(len(queries), bool)

    def add(self, ids: np.ndarray, vectors: np.ndarray, asked: np.ndarray | None = None) -> None:
        """Documents for all questions or for those at the places ``asked``."""
        asked = np.arange(len(self.queries)) if asked is None else asked
        known = ~np.isnan(vectors).any(axis=1)
        ids, vectors = ids[known], vectors[known]
        for left in range(0, len(ids), self.WIDTH):
            some = slice(left, left + self.WIDTH)
            coarse, step = vectors[some].astype(np.float32), max(1, self.CELLS // len(ids[some]))
            for at in range(0, len(asked), step):
                self._score(asked[at:at + step], ids[some], vectors[some], coarse)

    def _score(self, asked: np.ndarray, ids: np.ndarray, vectors: np.ndarray, coarse: np.ndarray) -> None:
        sims = self.coarse[asked] @ coarse.T
        floors = (self.floors[asked] - self.slack).astype(np.float32)
        some = np.flatnonzero(sims.max(axis=1) >= floors)  # NaN compares false
        if not len(some):
            return
        asked, floors, sims = asked[some], floors[some], sims[some]
        hits = np.flatnonzero(sims >= floors[:, None])
        if len(hits) > sims.size // 128 and len(ids) > self.k:
            # nor can a document matter that is below the k-th best of these alone
            best = np.partition(sims, -self.k, axis=1)[:, -self.k] - np.float32(self.slack)
            hits = np.flatnonzero(sims >= np.maximum(floors, best)[:, None])
        row, d = np.divmod(hits, len(ids))
        q = asked[row]
        if len(hits) > sims.size // 32:
            exact = (self.queries[asked] @ vectors.T).ravel()[hits]
        else:
            exact = np.einsum("ij,ij->i", self.queries[q], vectors[d])
        exact, found = np.round(exact, DIGITS), ids[d]
        enters = exact >= self.floors[q]
        if self.last is not None:
            enters &= ~self.full[q] | (exact > self.floors[q]) | (found < self.last[q])
        if enters.any():
            self.waiting.append((q[enters], found[enters], exact[enters]))
            self.pairs += int(enters.sum())
            if self.pairs > self.k * len(self.queries):
                self._merge()

    def _merge(self) -> None:
        q, ids, sims = (np.concatenate(c) for c in zip(*([self.held] if self.held else []), *self.waiting))
        order = np.lexsort((ids, -sims, q))
        q, ids, sims, self.waiting = q[order], ids[order], sims[order], []
        self.pairs = 0
        starts = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]]))
        counts = np.diff(np.append(starts, len(q)))
        keep = np.arange(len(q)) - np.repeat(starts, counts) < self.k
        kth = starts[counts >= self.k] + self.k - 1
        if self.last is None or self.last.dtype != ids.dtype:
            self.last = np.zeros(len(self.queries), ids.dtype) if self.last is None else self.last.astype(ids.dtype)
        self.floors[q[kth]], self.last[q[kth]], self.full[q[kth]] = sims[kth], ids[kth], True
        self.held = (q[keep], ids[keep], sims[keep])

    def rows(self, query_ids: pa.Array, id_type: pa.DataType) -> pa.RecordBatch:
        """query_id, id and similarity of what was found."""
        if self.waiting:
            self._merge()
        q, ids, sims = self.held or ([], np.zeros(0, np.int64), [])
        return pa.RecordBatch.from_arrays(
            [query_ids.take(pa.array(q, pa.int64())), pa.array(ids.tolist(), type=id_type), pa.array(sims, pa.float64())],
            names=["query_id", "id", "similarity"])


def _arrow_type(df: DataFrame, name: str) -> pa.DataType:
    return pa.string() if isinstance(df.schema[name].dataType, T.StringType) else pa.int64()


def _id_array(column, kind: pa.DataType) -> np.ndarray:
    values = column.to_pylist()
    return np.array(values, dtype=str if kind == pa.string() else np.int64)


def match_batch(
    queries: DataFrame, docs: DataFrame, dim: int, k: int = 5, threshold: float = 0.75,
    broadcast_values: int = 4_000_000, cells: int | None = None, block_rows: int = 20_000,
) -> DataFrame:
    """Exact top-k for a table of questions: query_id, id, similarity, rank.

    queries: query_id, embedding [, threshold]; docs: id, embedding.
    A question set of at most ``broadcast_values`` numbers is sent to every task and the documents stay where
    they are. A larger one goes through a tree of cells (``match_by_cells``)."""
    check_match(k, threshold)
    if "threshold" not in queries.columns:
        queries = queries.withColumn("threshold", F.lit(float(threshold)))
    queries = queries.select("query_id", "embedding", F.col("threshold").cast("double").alias("threshold"))
    docs = docs.select("id", "embedding")
    most = max(1, broadcast_values // dim)
    if queries.limit(most + 1).count() <= most:
        found = _match_by_broadcast(queries, docs, dim, k)
    else:
        found, _ = match_by_cells(queries, docs, dim, k, cells, block_rows)
    return first_n_per_key(found, ["query_id"], [F.desc("similarity"), F.asc("id")], k, "rank")


def _schema(queries: DataFrame, docs: DataFrame) -> T.StructType:
    return T.StructType([
        T.StructField("query_id", queries.schema["query_id"].dataType),
        T.StructField("id", docs.schema["id"].dataType),
        T.StructField("similarity", T.DoubleType()),
    ])


def _match_by_broadcast(queries: DataFrame, docs: DataFrame, dim: int, k: int) -> DataFrame:
    """Every task scores its documents against the (size-checked) questions and emits its own top-k."""
    table = queries.toArrow()
    id_type, query_type = _arrow_type(docs, "id"), _arrow_type(queries, "query_id")
    query_ids = pa.array(table.column("query_id").to_pylist(), query_type)
    floors = np.array(table.column("threshold").to_pylist(), dtype=np.float64)
    shared = docs.sparkSession.sparkContext.broadcast(unit_rows(as_matrix(table.column("embedding"), dim)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _TopK(shared.value, floors, k)
        for record in batches:
            best.add(_id_array(record.column("id"), id_type), unit_rows(as_matrix(record.column("embedding"), dim)))
        yield best.rows(query_ids, id_type)

    return docs.mapInArrow(run, _schema(queries, docs))


#: Documents that a cell aims at, and the bounds of the cells and of the sample they are made from, in numbers on the driver.
CELL_ROWS, MOST_CELLS, SAMPLE_ROWS, SAMPLE_VALUES = 2_000, 4_096, 20_000, 4_000_000
#: Pairs of a question and a cell that a task looks at together: every cell may be near to every question of a batch.
PAIRS = 500_000
#: Numbers that a block of documents or of questions has at most, and the tasks a core gets. Blocks are copied once for each block they
#: meet, so that smaller ones move more.
BLOCK_VALUES, TASKS = 6_000_000, 4


def _block_counts(questions: int, docs: int, block_rows: int, most_rows: int, tasks: int) -> tuple[int, int]:
    """Blocks of questions and of documents: as few as fit into memory and keep all cores busy."""
    parts = lambda rows, size: max(1, -(-rows // size))
    most_rows = max(block_rows, most_rows)
    asked = max(parts(questions, most_rows), min(int(np.ceil(np.sqrt(tasks))), parts(questions, block_rows)))
    return asked, max(parts(docs, most_rows), min(parts(tasks, asked), parts(docs, block_rows)))


def _tree(docs: DataFrame, dim: int, cells: int | None) -> CellTree | None:
    """Centres from a sample of bounded size, chosen by hash; None without any vector."""
    if cells is None:
        cells = min(MOST_CELLS, max(1, docs.count() // CELL_ROWS))
    most = max(cells, min(SAMPLE_ROWS, SAMPLE_VALUES // dim))
    sample = docs.orderBy(F.xxhash64("id"), "id").limit(most).select("embedding").toArrow()
    units = unit_rows(as_matrix(sample.column("embedding"), dim))
    units = units[~np.isnan(units).any(axis=1)]
    return CellTree(units, cells) if len(units) else None


def match_by_cells(
    queries: DataFrame, docs: DataFrame, dim: int, k: int, cells: int | None = None, block_rows: int = 20_000
) -> tuple[DataFrame, DataFrame]:
    """Candidates (query_id, id, similarity) that hold the exact top-k of each question, and how the work was cut down: rows
    (query_id, cell, documents) for every cell that a question was scored against.

    Centres made from the data cut the documents into cells of a tree; each cell knows the largest angle of its documents to the centre. A question
    is first scored in the cell next to it; the k-th best found there, or its threshold, is the floor for all others: cells whose
    bound stays below are passed over, by whole nodes where the node's does. Neighbouring cells lie in one block of documents, which a
    question reaches once, however many of its cells it visits; large cells are cut. A task sees one block of documents and one of
    questions and returns at most k rows per question. Blocks have ``block_rows`` rows or, where that makes more than a few tasks for
    each core, up to BLOCK_VALUES numbers."""
    spark, id_type, query_type = docs.sparkSession, _arrow_type(docs, "id"), _arrow_type(queries, "query_id")
    schema = _schema(queries, docs)
    visit_schema = T.StructType([schema["query_id"], T.StructField("cell", T.IntegerType()), T.StructField("documents", T.LongType())])
    tree = _tree(docs, dim, cells)
    if tree is None:
        return spark.createDataFrame([], schema), spark.createDataFrame([], visit_schema)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units = unit_rows(as_matrix(batch.column(1), dim))
            ok = np.flatnonzero(~np.isnan(units).any(axis=1))
            cell, angle, high = tree.place(units[ok])
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(ok)), batch.column(1).take(pa.array(ok)), pa.array(cell.astype(np.int32)), pa.array(angle), pa.array(high)],
                names=["id", "embedding", "cell", "angle", "high"])

    vector = docs.schema["embedding"].dataType
    placed = written(docs.select("id", "embedding").mapInArrow(place, T.StructType([
        schema["id"], T.StructField("embedding", vector), T.StructField("cell", T.IntegerType()),
        T.StructField("angle", T.DoubleType()), T.StructField("high", T.DoubleType())])), "placed")
    # one row per cell
    for r in placed.groupBy("cell").agg(F.count("*").alias("rows"), F.max("angle").alias("angle"), F.max("high").alias("high")).collect():
        tree.cover(r["cell"], r["rows"], r["angle"], r["high"])
    if not tree.rows.any():
        return spark.createDataFrame([], schema), spark.createDataFrame([], visit_schema)

    asking = queries.count()
    question_blocks, doc_blocks = _block_counts(
        asking, int(tree.rows.sum()), block_rows, BLOCK_VALUES // dim, TASKS * spark.sparkContext.defaultParallelism)
    doc_rows, question_rows = -(-int(tree.rows.sum()) // doc_blocks), max(1, -(-asking // question_blocks))
    starts = tree.starts()
    # the blocks that a cell's documents are in
    low, high = starts // doc_rows, (starts + np.maximum(tree.rows, 1) - 1) // doc_rows
    asked_schema = T.StructType([schema["query_id"], T.StructField("embedding", queries.schema["embedding"].dataType),
                                 T.StructField("floor", T.DoubleType()), T.StructField("near", T.IntegerType())])

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, PAIRS // max(len(tree.centres), doc_blocks))
        return (whole.slice(at, step) for whole in batches for at in range(0, whole.num_rows, step))

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Questions with the cell next to them."""
        for batch in slices(batches):
            units = unit_rows(as_matrix(batch.column(1), dim))
            ok = np.flatnonzero(~np.isnan(units).any(axis=1))
            rows = batch.take(pa.array(ok))
            yield pa.RecordBatch.from_arrays(
                [*rows.columns, pa.array(tree.nearest_filled(units[ok]).astype(np.int32))], names=[*rows.schema.names, "near"])

    def pairs(units: np.ndarray, floors: np.ndarray, near: np.ndarray, first: bool, among: np.ndarray | None = None):
        """(question, cell) to be scored: the cell next to it, or all others that its floor leaves."""
        if first:
            return np.arange(len(near)), near
        q, c = tree.visits(units, floors, among)
        other = c != near[q]
        return q[other], c[other]

    def columns(questions: pa.RecordBatch | pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return (unit_rows(as_matrix(questions.column("embedding"), dim)), questions.column("floor").to_numpy(zero_copy_only=False),
                questions.column("near").to_numpy(zero_copy_only=False))

    def ask(first: bool):
        """Each question once for every block that holds a cell it is to be scored in."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                q, c = pairs(*columns(batch), first)
                reached = np.zeros((batch.num_rows, doc_blocks), bool)
                for further in range(int((high[c] - low[c]).max(initial=-1)) + 1):
                    inside = low[c] + further <= high[c]
                    reached[q[inside], low[c[inside]] + further] = True
                q, block = np.nonzero(reached)
                for at in range(0, len(q), 4096):
                    rows = batch.take(pa.array(q[at:at + 4096]))
                    yield pa.RecordBatch.from_arrays(
                        [*rows.columns, pa.array(block[at:at + 4096].astype(np.int32))], names=[*rows.schema.names, "db"])

        return run

    def score(first: bool):
        def run(ours: pa.Table, theirs: pa.Table) -> pa.Table:
            units, floors, near = columns(theirs)
            best = _TopK(units, floors, k)
            if len(units) and ours.num_rows:
                ids, docs_units = _id_array(ours.column("id"), id_type), unit_rows(as_matrix(ours.column("embedding"), dim))
                cell = ours.column("cell").to_numpy()
                order = np.argsort(cell, kind="stable")
                held, begin = np.unique(cell[order], return_index=True)
                among = np.zeros(len(tree.centres), bool)
                among[held] = True
                step = max(1, PAIRS // len(held))
                for at in range(0, len(units), step):
                    some = slice(at, at + step)
                    q, c = pairs(units[some], floors[some], near[some], first, among)
                    by_cell = np.argsort(c, kind="stable")
                    q, c = at + q[by_cell], c[by_cell]
                    for one, own in zip(held, np.split(order, begin[1:])):
                        asked = q[np.searchsorted(c, one):np.searchsorted(c, one, "right")]
                        if len(asked):
                            best.add(ids[own], docs_units[own], asked)
            return pa.Table.from_batches([best.rows(theirs.column("query_id").combine_chunks(), id_type)])

        return run

    number = lambda of: F.element_at(F.array(*[F.lit(int(n)) for n in of]), F.col("cell") + 1)
    pick = lambda of, n: F.pmod(F.xxhash64(of), n)
    dealt = placed.select("id", "embedding", "cell", F.floor((number(starts) + pick("id", number(tree.rows))) / F.lit(doc_rows)).cast("int").alias("db"))

    def meet(questions: DataFrame, first: bool) -> DataFrame:
        right, left = questions.mapInArrow(ask(first), T.StructType([*asked_schema.fields, T.StructField("db", T.IntegerType())])), dealt
        if question_blocks == 1:
            left, right = left.withColumn("qb", F.lit(0)), right.withColumn("qb", F.lit(0))
        else:
            # one row per block
            sizes = F.broadcast(right.groupBy("db").agg(F.ceil(F.count("*") / F.lit(question_rows)).cast("int").alias("_n")))
            left = left.join(sizes, "db").withColumn("qb", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).drop("_n")
            right = right.join(sizes, "db").withColumn("qb", pick("query_id", F.col("_n")).cast("int")).drop("_n")
        return left.groupBy("db", "qb").cogroup(right.groupBy("db", "qb")).applyInArrow(score(first), schema)

    # a block of questions is small enough to be placed again wherever it is read
    kept = written if question_blocks > 1 else lambda df, name: df
    start = kept(queries.select("query_id", "embedding", F.col("threshold").alias("floor")).mapInArrow(nearest, asked_schema), "asked")
    found = written(meet(start, True), "first")
    # a cell in blocks gives up to k rows from each
    kth = first_n_per_key(found, ["query_id"], [F.desc("similarity"), F.asc("id")], k).groupBy("query_id").agg(
        F.min("similarity").alias("_kth"), F.count("*").alias("_n")).filter(F.col("_n") == k).select("query_id", "_kth")
    floors = kept(start.join(kth, "query_id", "left").select(
        "query_id", "embedding", F.greatest("floor", "_kth").alias("floor"), "near"), "floors")

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for first in (True, False):
                q, c = pairs(*columns(batch), first)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("query_id").take(pa.array(q)), pa.array(c.astype(np.int32)), pa.array(tree.rows[c])], names=visit_schema.names)

    return found.unionByName(meet(floors, False)), floors.mapInArrow(visits, visit_schema)


def row_defaults(matches: DataFrame) -> DataFrame:
    """Missing id, source, similarity and metadata of a match get fixed defaults."""
    return matches.select(
        F.coalesce(F.col("id").cast("string"), F.lit("")).alias("id"),
        F.col("content"),
        F.coalesce(present("source"), F.lit("desconhecido")).alias("source"),
        F.coalesce(F.col("similarity"), F.lit(0.0)).alias("similarity"),
        F.coalesce(F.col("metadata"), F.lit("{}")).alias("metadata"),
    )


def apply_grades(matches: DataFrame, grades: DataFrame, keys: list[str]) -> DataFrame:
    """Drop matches graded irrelevant; a missing or failed grade keeps the match."""
    kept = F.coalesce(F.col("grade") == "relevant", F.lit(True))
    return matches.join(grades.select(*keys, "grade"), keys, "left").filter(kept).drop("grade")


def grade(matches: DataFrame, grader: Callable[[list, list], list], question: str = "question", content: str = "content",
          batch: int = 32) -> DataFrame:
    """Matches that a user's function does not grade ``irrelevant``. ``grader`` takes lists of questions and passages (their
    first 2,000 characters), ``batch`` at a time, and gives a grade for each; a batch that fails keeps its matches."""

    @F.arrow_udf("string")
    def run(questions: pa.Array, passages: pa.Array) -> pa.Array:
        asked, shown, grades = questions.to_pylist(), passages.to_pylist(), []
        for at in range(0, len(asked), batch):
            part = asked[at:at + batch]
            try:
                given = list(grader(part, shown[at:at + batch]))
            except Exception:  # a grader that is down must not lose matches
                given = []
            grades += given if len(given) == len(part) else [None] * len(part)
        return pa.array(grades, pa.string())

    graded = matches.withColumn("_grade", run(F.col(question), grade_input(content)))
    return graded.filter(F.coalesce(F.col("_grade") == "relevant", F.lit(True))).drop("_grade")


def grade_input(content: Column | str) -> Column:
    """The part of a chunk a grader sees."""
    return F.substring(content, 1, 2000)


def retrieval_array(matches: DataFrame, key: str = "query_id") -> DataFrame:
    """Per question the telemetry array of its (at most k) matches in rank order, numbered anew from 1.

    Fields are ordered rank first so that the array sorts by rank."""
    matches = matches.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy("rank")))
    doc = F.coalesce(present(F.col("id").cast("string")), F.concat(F.lit("source:"), "source", F.lit(":"), F.col("rank").cast("string")))
    entry = F.struct(F.col("rank").cast("int").alias("rank"), doc.alias("document_id"), "source", "similarity")
    return matches.groupBy(key).agg(F.array_sort(F.collect_list(entry)).alias("_r")).select(
        key,
        F.transform("_r", lambda r: F.struct(
            r["document_id"].alias("document_id"), r["source"].alias("source"), r["rank"].alias("rank"),
            r["similarity"].alias("similarity"))).alias("retrieval"),
    )

