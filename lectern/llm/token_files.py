"""Token ids in ORC: one row per document, ids as a list of integers under run-length encoding, in ascending document order.

Every file holds one range of document ids, sorted, so that ranges of ids can be read by stripe: the ORC row index holds
minima and maxima per stripe and per 10,000 rows, and a Bloom filter on the document id rules out stripes for a lookup by equality.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..session import prepare, scratch_path
from .common import Memory, Numbering, byte_slices, held, partitions

FILE_SCHEMA = "doc_id bigint, n_tokens bigint, start_in_file bigint, file_number int, ids array<int>"
#: A place in a text where the tokenizer always starts anew: a space before something that is not white space.
_PIECE = re.compile(r" (?=\S)")
#: A space before white space: only texts with one need the pattern, others are cut at every space.
_UNEVEN = [" " + chr(c) for c in range(0x3001) if chr(c).isspace()]


#: Words of Latin letters with a mark after them.
_MARKED = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+[.,;:!?]")


class PieceEncoder:
    """Token ids of whole texts with a byte-level BPE file of the tokenizers library, equal to its own
    ``encode(text, add_special_tokens=False)``.

    The pre-tokenizer takes a space along with the word after it, so a text may be cut before every such space and each
    distinct piece is encoded by the library once and remembered within ``limit`` bytes; texts with an added token's spelling are encoded whole.
    """

    def __init__(self, path: str, limit: int = 144 << 20):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.memory = Memory(limit)
        self.marks = {c: self.tokenizer.encode(c, add_special_tokens=False).ids[0] for c in ".,;:!?"}
        vocab = self.tokenizer.get_vocab()
        self.opens = np.zeros(max(vocab.values(), default=0) + 1, bool)
        for token, i in vocab.items():
            self.opens[i] = token.startswith("Ġ")  # how byte-level vocabularies write a space
        self.lengths, self.starts = np.zeros(1024, np.int32), np.zeros(1024, np.int64)
        self.ids, self.filled = np.zeros(1 << 16, np.int32), 0

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        heads, pieces, counts, whole = [], [], [], {}
        for i, text in enumerate(texts):
            if any(a in text for a in self.added):
                whole[i] = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.int32)
                text = ""
            first, *rest = _PIECE.split(text) if any(x in text for x in _UNEVEN) else text.split(" ")
            heads.append(first)
            pieces += rest
            counts.append(len(rest))
        numbers = self.memory.number(pieces)
        self._learn()
        lengths = self.lengths[numbers]
        ends = np.cumsum(lengths, dtype=np.int64)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.ids[np.arange(total) + np.repeat(self.starts[numbers] - (ends - lengths), lengths)]
        if self.memory.full:
            self._forget()
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])].tolist()
        first_ids = [e.ids for e in self.tokenizer.encode_batch_fast(heads, add_special_tokens=False)]
        return [whole[i] if i in whole else np.concatenate([np.array(x, np.int32), ids[a:b]])
                for i, (x, a, b) in enumerate(zip(first_ids, bounds, bounds[1:]))]

    def _forget(self) -> None:
        kept = self.memory.forget(_size)
        lengths, starts = self.lengths[kept], self.starts[kept]
        ends = np.cumsum(lengths, dtype=np.int64)
        total = int(ends[-1]) if len(ends) else 0
        self.ids = self.ids[np.arange(total) + np.repeat(starts - (ends - lengths), lengths)]
        self.lengths, self.starts, self.filled = lengths, ends - lengths, total

    def _learn(self) -> None:
        fresh, known = self.memory.fresh(), self.memory.known
        if not fresh:
            return
        # a word and the mark after it are apart for the tokenizer, so "word," needs what "word" gives
        wanted, numbers = Numbering(), self.memory.numbers
        held, asked, mark = (np.full(len(fresh), -1, np.int64) for _ in range(3))
        for place, piece in enumerate(fresh):
            if _MARKED.fullmatch(piece):
                mark[place] = self.marks[piece[-1]]
                piece = piece[:-1]
                number = numbers.get(piece, known)
                if number < known:
                    held[place] = number
                    continue
            asked[place] = wanted[piece]
        flat, ends = self._encode(list(wanted))
        lengths = np.where(held >= 0, self.lengths[held], np.diff(ends)[asked] if len(wanted) else 0).astype(np.int64)
        starts = np.where(held >= 0, self.starts[held], ends[asked] + self.filled)
        source = np.concatenate([self.ids[:self.filled], flat])
        whole = lengths + (mark >= 0)
        begins = self.filled + np.cumsum(whole) - whole
        total, count = self.filled + int(whole.sum()), known + len(fresh)
        if total > len(self.ids):
            self.ids = np.concatenate([self.ids[:self.filled], np.zeros(total, np.int32)])
        if count > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros(2 * count, np.int64)])
            self.lengths = np.concatenate([self.lengths, np.zeros(2 * count, np.int32)])
        within = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        self.ids[np.repeat(begins, lengths) + within] = source[np.repeat(starts, lengths) + within]
        marked = np.flatnonzero(mark >= 0)
        self.ids[begins[marked] + lengths[marked]] = mark[marked]
        self.starts[known:count], self.lengths[known:count], self.filled = begins, whole, total
        self.memory.learned(sum(map(_size, fresh)))

    def _encode(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces, each with a space in front, one after another, and where each begins and the last ends."""
        plain, other = [], []
        for place, piece in enumerate(pieces):
            (other if " " in piece or not piece or piece[0].isspace() else plain).append(place)
        lengths, found = np.zeros(len(pieces), np.int64), []
        # many pieces in one call, cut again where a token begins with the space that begins a piece
        for at in range(0, len(plain), 2000):
            part = plain[at:at + 2000]
            ids = np.array(self.tokenizer.encode_batch_fast(
                ["".join(" " + pieces[i] for i in part)], add_special_tokens=False)[0].ids, np.int32)
            begins = np.flatnonzero(self.opens[ids])
            if len(begins) != len(part) or begins[0] != 0:
                other.extend(part)
                continue
            lengths[part] = np.diff(np.append(begins, len(ids)))
            found.append((part, ids))
        if other:
            encoded = [e.ids for e in self.tokenizer.encode_batch_fast([" " + pieces[i] for i in other], add_special_tokens=False)]
            lengths[other] = [len(x) for x in encoded]
            found.append((other, np.array([i for x in encoded for i in x], np.int32)))
        ends = np.concatenate([[0], np.cumsum(lengths)])
        flat = np.zeros(int(ends[-1]), np.int32)
        for part, ids in found:
            n = lengths[part]
            flat[np.repeat(ends[part] - (np.cumsum(n) - n), n) + np.arange(len(ids))] = ids
        return flat, ends


def _size(piece: str) -> int:
    """About the bytes that a piece and its ids take."""
    return 190 + 3 * len(piece)


def encoder(path: str) -> PieceEncoder:
    """One per worker and vocabulary: pieces stay known from task to task."""
    return held(("pieces", path), lambda: PieceEncoder(path))


class _Write:
    """Encodes a sorted partition and counts ids within the file."""

    def __init__(self, path: str, end_id: int):
        self.path, self.end_id = path, end_id

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, start, encode = TaskContext.get().partitionId(), 0, encoder(self.path)
        for batch in byte_slices(batches, 1):
            ids = [np.append(x, np.int32(self.end_id)) for x in encode.encode_batch(batch.column(1).to_pylist())]
            lengths = np.fromiter(map(len, ids), np.int64, len(ids))
            ends = np.cumsum(lengths)
            offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(lengths), pa.array(start + ends - lengths),
                pa.array(np.full(len(ids), number, np.int32)), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(ids)))],
                names=["doc_id", "n_tokens", "start_in_file", "file_number", "ids"])
            start += int(ends[-1])


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text",
                 stripe_bytes: int = 64 << 20) -> None:
    """Encode every whole text, close it with ``end_id`` and write ORC files in ascending id order (null ids last, equal ids
    by the text's hash). A null text is empty: its list holds the end id alone. Repeated rows are written each; extra
    columns are not read; an empty table writes a folder without rows."""
    prepare(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("h"))
    order = [F.col("doc_id").asc_nulls_last(), F.col("h")]
    ranged = rows.repartitionByRange(partitions(docs), *order).sortWithinPartitions(*order)
    encoded = ranged.select("doc_id", "text").mapInArrow(_Write(tokenizer, end_id), FILE_SCHEMA)
    encoded.write.format("orc").option("compression", "none").option("orc.stripe.size", str(stripe_bytes)).option(
        "orc.create.index", "true").option("orc.row.index.stride", "10000").option(
        "orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01").save(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids) of written files. ``start`` counts the ids of all documents before: the place in
    the file plus the totals of the files before it (one row per file)."""
    files = spark.read.schema(FILE_SCHEMA).orc(path)
    totals = files.groupBy("file_number").agg(F.sum("n_tokens").alias("n"))
    before = totals.select("file_number", F.coalesce(F.sum("n").over(
        Window.orderBy("file_number").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return files.join(F.broadcast(before), "file_number").select(
        "doc_id", (F.col("before") + F.col("start_in_file")).alias("start"), "n_tokens", "ids")


def lookup_tokens(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """Rows of some documents; ids are pushed to the scan, which skips stripes by their minima, maxima and Bloom filters."""
    return read_tokens(spark, path).filter(F.col("doc_id").isin(doc_ids))


def _crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(3)
        values = np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False))
        offsets = lists.offsets.to_numpy()
        data = memoryview(values).cast("B")
        crc = [zlib.crc32(data[4 * a:4 * b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def checksums(tokens: DataFrame) -> DataFrame:
    """The CRC-32 of each document's ids as little-endian 32-bit integers, beside (doc_id, start, n_tokens)."""
    return tokens.select("doc_id", "start", "n_tokens", "ids").mapInArrow(
        _crc, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def encode_to_files(docs: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    """Write documents to token files in the shared folder and read them back: (doc_id, start, n_tokens, ids)."""
    path = scratch_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer, end_id)
    return read_tokens(docs.sparkSession, path)
