"""Importance resampling towards a target distribution by hashed features.

Words and pairs of words are hashed into buckets. How much more frequent a bucket is in the target than in the corpus is its gain; a
document's weight is the mean gain of its features, and a weighted sample without repeats are the documents with the largest
sums of weight and Gumbel noise. The cutoff is found without sorting the corpus: a quantile sketch gives a bracket of scores, exact counts
outside of it show whether the cutoff lies inside or widen it, and only the bracket is sorted.

Words are hashed once each per task; the CRC of a pair follows from those of its two words, since appending is linear
over bits, so that a text is scored by array lookups alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import prepare
from .common import Numbering, packed, restricted, stored

BUCKETS, SEED = 10_000, 7
#: Percent of the documents of at least so many words that is drawn.
PERCENT, LEAST_WORDS = 25, 20
#: Bytes of words that a task remembers, and bytes of text hashed at a time.
MEMORY, SLICE = 16 << 20, 4 << 20
#: Accuracy of the sketch: the bracket's ends are off by a share of 1 / ACCURACY of the rows each.
ACCURACY = 1000

#: What stands for each byte: letters lower-cased, digits and bytes of letters beyond ASCII kept, all else a space.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


class _Append:
    """The CRC-32 of a text with n bytes more, but for those bytes' own: a linear map, as four tables of 256 for each n."""

    LONGEST = 64

    def __init__(self):
        ends = np.array([zlib.crc32(b"\0" * n) for n in range(self.LONGEST + 1)], np.uint32)
        # crc32(zeros, start) ^ crc32(zeros) is linear in the start
        self.tables = np.zeros((self.LONGEST + 1, 4, 256), np.uint32)
        for n in range(self.LONGEST + 1):
            bits = np.array([zlib.crc32(b"\0" * n, 1 << b) for b in range(32)], np.uint32) ^ ends[n]
            for byte in range(4):
                for b in range(8):
                    self.tables[n, byte] ^= np.where(np.arange(256) >> b & 1, bits[8 * byte + b], np.uint32(0)).astype(np.uint32)

    def __call__(self, crc: np.ndarray, n: np.ndarray) -> np.ndarray:
        t = self.tables
        return t[n, 0, crc & 255] ^ t[n, 1, crc >> 8 & 255] ^ t[n, 2, crc >> 16 & 255] ^ t[n, 3, crc >> 24]


class FeatureHashes:
    """CRC-32 of all words of texts, and of all pairs of neighbours joined by a space."""

    def __init__(self, memory: int = MEMORY):
        self.memory, self.append = memory, _Append()
        self._empty()

    def _empty(self) -> None:
        self.numbers, self.words, self.bytes = Numbering(), 0, 0
        self.own, self.after, self.length = (np.zeros(1024, t) for t in (np.uint32, np.uint32, np.int64))

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of words, number of words of each text, hashes of pairs, number of pairs of each text."""
        found = [t.translate(_BYTES).split() for t in texts]
        counts = np.fromiter(map(len, found), np.int64, len(found))
        index = np.fromiter((self.numbers[w] for ws in found for w in ws), np.int64, int(counts.sum()))
        self._learn()
        words = self.own[index]
        ends = np.cumsum(counts)
        joined = np.ones(max(len(index) - 1, 0), bool)
        joined[ends[(ends > 0) & (ends < len(index))] - 1] = False
        left, right = index[:-1][joined], index[1:][joined]
        length = self.length[right] + 1
        short = length <= _Append.LONGEST
        pairs = np.zeros(len(left), np.uint32)
        pairs[short] = self.append(self.own[left[short]], length[short]) ^ self.after[right[short]]
        if not short.all():
            places = np.flatnonzero(joined)
            flat = [w for ws in found for w in ws]
            for i in np.flatnonzero(~short).tolist():
                pairs[i] = zlib.crc32(b" " + flat[places[i] + 1], int(words[places[i]]))
        if self.bytes > self.memory:
            self._empty()
        return words, counts, pairs, np.maximum(counts - 1, 0)

    def _learn(self) -> None:
        fresh = [w for w, _ in zip(reversed(self.numbers), range(len(self.numbers) - self.words))][::-1]
        if not fresh:
            return
        count = self.words + len(fresh)
        if count > len(self.own):
            self.own, self.after, self.length = (np.concatenate([x, np.zeros(2 * count, x.dtype)]) for x in (self.own, self.after, self.length))
        part = slice(self.words, count)
        self.own[part] = [zlib.crc32(w) for w in fresh]
        self.after[part] = [zlib.crc32(b" " + w) for w in fresh]
        self.length[part] = [len(w) for w in fresh]
        self.words, self.bytes = count, self.bytes + sum(map(len, fresh)) + 150 * len(fresh)


def _slices(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Rows with the bytes of their texts, about ``SLICE`` bytes at a time."""
    for batch in batches:
        sizes = np.cumsum(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False)) // SLICE
        starts = np.flatnonzero(np.r_[True, sizes[1:] != sizes[:-1]]).tolist() if len(sizes) else []
        for a, b in zip(starts, [*starts[1:], batch.num_rows]):
            part = batch.slice(a, b - a)
            yield part, part.column(column).to_pylist()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes, total = FeatureHashes(), np.zeros(BUCKETS, np.int64)
    for _, texts in _slices(batches, 0):
        words, _, pairs, _ = hashes(texts)
        total += np.bincount(words % BUCKETS, minlength=BUCKETS) + np.bincount(pairs % BUCKETS, minlength=BUCKETS)
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], names=["bucket", "n"])


def _bytes_of(text_col: str) -> Column:
    return F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text")


def bucket_counts(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """``bucket, n``: features of all texts by bucket; at most ``BUCKETS`` rows. A task gives one row per bucket."""
    return texts.select(_bytes_of(text_col)).mapInArrow(_count, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(docs: DataFrame, target: DataFrame, text_col: str = "text") -> np.ndarray:
    """For each bucket 1000 times the logarithm of how much more frequent it is in the target, smoothed by one, rounded down."""
    both = bucket_counts(docs, text_col).withColumnRenamed("n", "s").join(
        bucket_counts(target, text_col).withColumnRenamed("n", "t"), "bucket", "full").na.fill(0)
    s, t = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for r in both.collect():  # one row per bucket
        s[r["bucket"]], t[r["bucket"]] = r["s"], r["t"]
    ratio = ((t + 1.0) * float(s.sum() + BUCKETS)) / ((s + 1.0) * float(t.sum() + BUCKETS))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def _weigh(gains: np.ndarray):
    """(doc_id, text) to (doc_id, n_words, n_features, weight)."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = FeatureHashes()
        for batch, texts in _slices(batches, 1):
            words, counts, pairs, pair_counts = hashes(texts)
            total = _sums(gains[words % BUCKETS], counts) + _sums(gains[pairs % BUCKETS], pair_counts)
            features = counts + pair_counts
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts), pa.array(features), pa.array(total // np.maximum(features, 1))],
                names=["doc_id", "n_words", "n_features", "weight"])

    return weigh


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of whole numbers."""
    running = np.concatenate([[0], np.cumsum(values)])
    ends = np.cumsum(counts)
    return running[ends] - running[ends - counts]


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths from a hash of the seed and the id; a null id is an empty text."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("bigint")


def scored(docs: DataFrame, gains: np.ndarray, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_features, weight, score`` for every row."""
    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), _bytes_of(text_col))
    return rows.mapInArrow(_weigh(gains), "doc_id bigint, n_words bigint, n_features bigint, weight bigint").withColumn(
        "score", F.col("weight") + noise(F.col("doc_id"), seed))


def _order() -> list[Column]:
    """Best first; rows that tie in all that is returned are told apart by their number."""
    return [F.desc("score"), F.asc_nulls_last("doc_id"), F.col("n_features"), F.col("number")]


def bracket(rows: DataFrame, k: int, accuracy: int = ACCURACY) -> tuple[int, int, int]:
    """``low, high, above``: the k-th best score lies between low and high, and ``above`` rows score more than high.

    The ends come from a quantile sketch and are checked by exact counts; an end on the wrong side moves out, four times as far each time."""
    n, wide = rows.count(), 2.0 / accuracy
    share = 1 - k / n
    while True:
        low, high = rows.agg(F.percentile_approx("score", [max(0.0, share - wide), min(1.0, share + wide)], accuracy)).first()[0]
        above, within = rows.agg(
            F.count_if(F.col("score") > high), F.count_if(F.col("score").between(low, high))).first()
        if above < k <= above + within:
            return low, high, above
        wide *= 4


def ranked(rows: DataFrame, name: str = "rank") -> DataFrame:
    """Places 1, 2, 3... in the whole order: rows are dealt by range of it, numbered within, and take over the counts before."""
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = stored(rows.repartitionByRange(parts, *_order()).withColumn("_range", F.spark_partition_id()), "ranges")
    before = placed.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", F.coalesce(F.sum("_n").over(
        Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # one row per range
    return placed.join(F.broadcast(before), "_range").withColumn(
        name, F.col("_before") + F.row_number().over(Window.partitionBy("_range").orderBy(*_order()))).drop("_range", "_before")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED,
             id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` for every row; ``rank`` is null for documents that are not drawn.

    Of the N documents with at least ``least_words`` words, the floor(N * percent / 100) best scores are drawn, ties to the smaller id.
    Words are runs of ASCII letters, digits and all characters beyond ASCII, A-Z lower-cased; null texts have none, and a document
    without features weighs 0. Null ids come last in ties; repeated rows are documents of their own, each with a rank; rows that tie in
    id, score and features are interchangeable. Extra columns are not read; empty tables are allowed on either side.
    """
    if not 0 <= percent <= 100:
        raise ValueError("percent must be between 0 and 100")
    rows = stored(scored(docs, bucket_gains(docs, target, text_col), seed, id_col, text_col).withColumn(
        "number", F.monotonically_increasing_id()), "scored")
    columns = ["doc_id", "n_features", "weight", "score"]
    able = rows.filter(F.col("n_words") >= least_words)
    k = able.count() * percent // 100
    if not k:
        return rows.select(*columns, F.lit(None).cast("bigint").alias("rank"))
    low, high, above = bracket(able, k)
    inside = ranked(able.filter(F.col("score").between(low, high)))
    # the last row that is drawn, the only one of its place
    last = inside.filter(F.col("rank") == k - above).select("score", "doc_id", "n_features", "number").first()
    drawn = F.col("n_words") >= least_words
    drawn &= (F.col("score") > last["score"]) | ((F.col("score") == last["score"]) & _not_after(last))
    best = ranked(rows.filter(drawn))
    return best.select(*columns, "rank").unionByName(rows.filter(~drawn).select(*columns, F.lit(None).cast("bigint").alias("rank")))


def _not_after(last) -> Column:
    """Whether a row of the cutoff's score stands at or before the cutoff."""
    doc_id, features = F.col("doc_id"), F.col("n_features")
    rest = (features < last["n_features"]) | ((features == last["n_features"]) & (F.col("number") <= last["number"]))
    if last["doc_id"] is None:
        return doc_id.isNotNull() | rest
    return doc_id.isNotNull() & ((doc_id < last["doc_id"]) | ((doc_id == last["doc_id"]) & rest))


def take(docs: DataFrame, drawn: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The drawn documents with the columns of ``docs``; of documents that share an id all are taken if one is drawn."""
    ids = stored(drawn.filter("rank IS NOT NULL").select(
        F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("none")).distinct(), "drawn")
    own = F.col(f"row.{id_col}").cast("bigint")
    keyed = packed(docs).withColumns({"id": F.coalesce(own, F.lit(0)), "none": own.isNull()})
    return restricted(keyed, ids, "id", "none").select("row.*")
