"""Document fingerprints by content-defined chunking.

A gear hash runs over the UTF-8 bytes of a text; where its high bits are zero, a chunk ends. The hash depends on the last
32 bytes only, so an insertion moves the boundaries near it and no others. Chunking is normalised: a strict mask
before the wanted size and a loose one after it keep sizes close to it. The fingerprint is the set of chunk digests with
their lengths; the containment of one text in another is the share of its chunk bytes that the other has too.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import mix, partitions

#: Chunk sizes in bytes: least, wanted, most.
LEAST, WANTED, MOST = 8, 24, 96
_BITS = 4  # the loose mask ends a chunk at every 8th byte, the strict one at every 32nd
_GEAR = (mix(np.arange(256, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """The gear hash after each byte: sum of gear[b] << age over the last 32 bytes, by doubling the window."""
    h = _GEAR[data]
    span = 1
    while span < 32:
        shifted = h[:-span] << np.uint32(span)
        h[span:] += shifted
        span *= 2
    return h


def cut_points(data: np.ndarray) -> list[int]:
    """Ends of chunks, the last one the end of the text."""
    n = len(data)
    if not n:
        return []
    high = gear_hashes(data)
    loose = np.flatnonzero(high < np.uint32(1 << (33 - _BITS))) + 1
    strict = loose[high[loose - 1] < np.uint32(1 << (31 - _BITS))]
    cuts, start = [], 0
    strict_list, loose_list = strict.tolist(), loose.tolist()
    s = t = 0
    n_strict, n_loose = len(strict_list), len(loose_list)
    while n - start > LEAST:
        low, mid, top = start + LEAST, start + WANTED, min(start + MOST, n)
        while s < n_strict and strict_list[s] < low:
            s += 1
        if s < n_strict and strict_list[s] <= mid and strict_list[s] <= top:
            end = strict_list[s]
        else:
            while t < n_loose and loose_list[t] <= mid:
                t += 1
            end = loose_list[t] if t < n_loose and loose_list[t] <= top else top
        cuts.append(end)
        start = end
    if start < n:
        cuts.append(n)
    return cuts


def fingerprint(data: bytes) -> dict[int, int]:
    """Digest to length for the distinct chunks of a text."""
    out, start = {}, 0
    for end in cut_points(np.frombuffer(data, np.uint8)):
        out[xxhash.xxh32_intdigest(data[start:end])] = end - start
        start = end
    return out


def spelled(chunks: dict[int, int]) -> str:
    """A fingerprint as text: digests in order, each with its length in bytes; equal texts spell alike."""
    return " ".join(f"{d:08x}{n:x}" for d, n in sorted(chunks.items()))


def containment(a: dict[int, int], b: dict[int, int]) -> float:
    """Share of the bytes of a's chunks that b has; two empty texts are alike, an empty one is in no other."""
    if not a:
        return 1.0 if not b else 0.0
    return sum(n for d, n in a.items() if b.get(d) == n) / sum(a.values())


RESULT = pa.schema([
    ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
    ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def _row(doc_id, text: str, chunks: dict[int, int], following: str, after: dict[int, int]) -> tuple:
    moved = len(text) // 4
    edited = (text[:len(text) - moved] + following[:moved]).encode()
    other = chunks if moved == 0 else fingerprint(edited)
    return (doc_id, len(text), hashlib.sha256(edited).hexdigest(), spelled(chunks), spelled(other),
            containment(chunks, other), containment(chunks, after))


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a partition in order of (bucket, key): each is finished when the next one of its bucket comes. A row
    marked ``ahead`` is the next bucket's first and only looked at."""
    held, rows = None, []
    for batch in batches:
        for bucket, ahead, doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
            if held and held[0] == bucket:
                chunks = fingerprint(text.encode())
                rows.append(_row(held[1], held[2], held[3], text, chunks))
                held = None if ahead else (bucket, doc_id, text, chunks)
            elif not ahead:
                held = (bucket, doc_id, text, fingerprint(text.encode()))
            if len(rows) >= 500:
                yield _batch(rows)
                rows = []
    if rows:
        yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), RESULT.types)], schema=RESULT)


class _Buckets:
    """The bucket of a row by binary search in the buckets' first keys, and once more the bucket before if the row is
    a first: its text is what the last row there looks ahead to."""

    def __init__(self, firsts: list[tuple]):
        self.firsts = firsts

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import bisect

        for batch in batches:
            keys = list(zip(*(c.to_pylist() for c in batch.columns[:3])))
            at = [bisect.bisect_right(self.firsts, k) - 1 for k in keys]
            again = [i for i, (a, k) in enumerate(zip(at, keys)) if self.firsts[a] == k]
            take = np.concatenate([np.arange(len(keys)), np.array(again, np.int64)])
            out = pa.RecordBatch.from_arrays([
                pa.array([*at, *((at[i] - 1) % len(self.firsts) for i in again)], pa.int32()),
                pa.array([False] * len(keys) + [True] * len(again)),
                *(c.take(pa.array(take)) for c in batch.columns)], names=["bucket", "ahead", "is_null", "key", "h", "text"])
            yield out


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of all texts and of their edited forms, and their likeness to the edited and the next document.

    The order is ascending id, null ids last, equal ids by the text's hash; after the last document comes the first. The
    edited text has its last quarter (rounded down, in code points) replaced by the first as many of the next document.
    A null text is empty and has an empty fingerprint. Repeated rows follow each other. Extra columns are not read.

    The text is shuffled once, by range: buckets of about a partition each, whose first keys are known from a pass
    over ids and hashes. The first row of a bucket goes to the bucket before it as well.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(F.col(id_col).isNull().cast("int").alias("is_null"), F.coalesce(F.col(id_col), F.lit(0)).cast("bigint").alias("key"),
                        F.xxhash64(text).alias("h"), text.alias("text"))
    width = partitions(docs)
    order = ["is_null", "key", "h"]
    # one first key per bucket comes to the driver: as many as there are partitions
    firsts = keyed.select(*order).repartitionByRange(width, *order).groupBy(F.spark_partition_id()).agg(
        F.min(F.struct(*order)).alias("first")).collect()
    firsts = sorted(tuple(r["first"]) for r in firsts)
    if not firsts:
        return docs.sparkSession.createDataFrame([], _ddl())
    dealt = keyed.mapInArrow(_Buckets(firsts), "bucket int, ahead boolean, is_null int, key bigint, h bigint, text string")
    placed = dealt.repartitionById(len(firsts), F.col("bucket")).sortWithinPartitions("bucket", "ahead", *order)
    return placed.select("bucket", "ahead", F.when(F.col("is_null") == 0, F.col("key")).alias("doc_id"), "text").mapInArrow(_sweep, _ddl())


def _ddl() -> str:
    return ("doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
            "near_edited double, near_next double")
