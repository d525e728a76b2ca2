"""Helpers shared by the operators: stored tables, range-sorted sweeps, connected components, word hashes."""

from __future__ import annotations

import ctypes
import gc
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..session import prepare, scratch_path

#: A word of the contracts: a run of characters that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table once to the shared folder (``spark.checkpoint.dir``) and read it back. Cuts the lineage, makes
    partition ids and random order final, and survives lost executors."""
    spark = prepare(df.sparkSession)
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, with the package sent to the workers."""
    return prepare(spark).read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def partitions(df: DataFrame) -> int:
    """Partitions for a shuffle of about as many bytes as the scan has: its splits, or the session's setting."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.rdd.getNumPartitions())


def last_marker(df: DataFrame, order: list[Column], marker: Column, width: int | None = None) -> DataFrame:
    """For every row the last non-null ``marker`` at or before it in a total order, as column ``last_marker``.

    Rows are dealt out by range of the whole order, so a hot value of its first column is split; each range is swept by
    itself and takes over what the ranges before it ended with (one row per range). Native.
    """
    spark = df.sparkSession
    width = width or partitions(df)
    keys = [f"_k{i}" for i in range(len(order))]
    placed = df.withColumns(dict(zip(keys, order))).withColumn("_marker", marker)
    # the window repeats none of this work: ranges are stored, and their numbers with them
    placed = stored(placed.repartitionByRange(width, *keys).withColumn("_range", F.spark_partition_id()), "sweep")
    ends = placed.filter("_marker IS NOT NULL").groupBy("_range").agg(
        F.max_by("_marker", F.struct(*keys)).alias("_end"))
    ranges = placed.select("_range").distinct().join(ends, "_range", "left")
    # one row per range: bounded by the number of partitions
    carried = ranges.select("_range", F.last("_end", True).over(
        Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)).alias("_carried"))
    sweep = Window.partitionBy("_range").orderBy(*keys).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return placed.join(F.broadcast(carried), "_range").withColumn(
        "last_marker", F.coalesce(F.last("_marker", True).over(sweep), F.col("_carried"))
    ).drop("_range", "_carried", "_marker", *keys)


def packed(df: DataFrame) -> DataFrame:
    """All columns as one struct ``row``, so that no name of theirs meets a working column; ``select("row.*")`` undoes it."""
    return df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"))


#: A stored table of keys up to this many rows is sent to every task; a larger one is joined by shuffle.
BROADCAST_KEYS = 500_000


def restricted(docs: DataFrame, keys: DataFrame, *on: str) -> DataFrame:
    """Inner join of documents with a stored table of keys, which is counted first: few keys go to the documents, so that
    texts are not moved, many are joined by shuffle."""
    return docs.join(F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys, list(on))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b): rows (id, component) with the smallest reachable id, for every id in an edge.

    Alternating large-star and small-star steps until every id hangs on its root; every round is stored. Self-loops keep an
    id. Null ends are left out.
    """
    # stored first: edges may be costly to make, and are read more than once
    loops = stored(edges.filter("a IS NOT NULL AND b IS NOT NULL").select("a", "b"), "edges")
    ids = loops.select(F.col("a").alias("id")).union(loops.select("b")).distinct()
    state = stored(loops.filter("a <> b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while not _all_stars(state):
        both = state.union(state.select("v", "u"))
        low = both.groupBy(F.col("u").alias("n")).agg(F.min("v").alias("m")).withColumn("m", F.least("n", "m"))
        large = both.filter("v > u").join(low, F.col("u") == F.col("n")).select(
            F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy(F.col("u").alias("n")).agg(F.min("v").alias("m"))
        small = large.join(low, F.col("u") == F.col("n")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        state = stored(small.union(low.select("n", "m")).filter("u <> v").distinct(), "stars")
    return ids.join(state.withColumnRenamed("u", "id"), "id", "left").select(
        "id", F.coalesce("v", "id").alias("component"))


def _all_stars(edges: DataFrame) -> bool:
    """Whether every id has one edge downwards, to an id that has none."""
    rows, lower = edges.agg(F.count("*"), F.count_distinct("u")).first()
    if rows != lower:
        return False
    return edges.select("v").join(edges.select(F.col("u").alias("v")), "v", "left_semi").isEmpty()


class Numbering(dict):
    """Numbers for keys in order of first sight: ``numbering[key]`` gives a new key the next number."""

    def __missing__(self, key):
        self[key] = number = len(self)
        return number


class Memory:
    """Numbers for keys that a worker remembers, within ``limit`` bytes of what is learned about them.

    ``number`` looks keys up and numbers new ones; their owner learns the ``fresh`` ones and reports the bytes. Beyond the limit, ``forget``
    keeps the third that was used most and numbers it anew, so that frequent keys stay known however many rare ones pass."""

    def __init__(self, limit: int):
        self.limit, self.numbers, self.known, self.bytes, self.uses = limit, Numbering(), 0, 0, np.zeros(0, np.int64)

    def number(self, keys: list) -> np.ndarray:
        index = np.fromiter(map(self.numbers.__getitem__, keys), np.int64, len(keys))
        uses = np.bincount(index, minlength=len(self.numbers))
        uses[:len(self.uses)] += self.uses
        self.uses = uses
        return index

    def fresh(self) -> list:
        """The keys not learned yet, without walking over the others."""
        return [k for k, _ in zip(reversed(self.numbers), range(len(self.numbers) - self.known))][::-1]

    def learned(self, size: int) -> None:
        self.known, self.bytes = len(self.numbers), self.bytes + size

    @property
    def full(self) -> bool:
        return self.bytes > self.limit

    def forget(self, size: Callable[[object], int]) -> np.ndarray:
        """The old numbers of what is kept, in the order of the new ones; ``size`` gives the bytes of a key."""
        kept = np.argsort(-self.uses, kind="stable")
        keys = list(self.numbers)
        sizes = np.array([size(keys[i]) for i in kept.tolist()], np.int64)
        # a long key is used once and goes; were there only long ones, none would stay
        kept = kept[:min(len(keys) // 3, int(np.searchsorted(np.cumsum(sizes), self.limit // 2)))]
        self.numbers = Numbering((keys[i], n) for n, i in enumerate(kept.tolist()))
        self.known, self.bytes, self.uses = len(kept), int(sizes[:len(kept)].sum()), self.uses[kept] // 2
        return kept


_HELD: dict = {}


def held(key, make: Callable):
    """What a worker keeps from task to task: one thing at a time. Another operator's is given up, and its memory returned, before
    a new one is made, so that the stages of a pipeline do not add up in reused workers."""
    if key not in _HELD:
        release()
        _HELD[key] = make()
    return _HELD[key]


def release() -> None:
    """Give up what is held and return free memory to the system, as far as its allocators can."""
    _HELD.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


#: Bytes of text that are worked on at a time.
SLICE = 2 << 20


def byte_slices(batches: Iterator[pa.RecordBatch], column: int, size: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The rows of batches in slices of about ``size`` bytes of a text column; a longer text is a slice of its own. A batch without rows gives none."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        place = (np.cumsum(lengths, dtype=np.int64) - 1) // size
        starts = np.flatnonzero(np.r_[True, place[1:] != place[:-1]]).tolist() if len(place) else []
        for a, b in zip(starts, [*starts[1:], batch.num_rows]):
            yield batch.slice(a, b - a)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (the public splitmix64 constants)."""
    with np.errstate(over="ignore"):
        x = x + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def uniform(x: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) from 64-bit hashes."""
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0 ** -53


_TOKEN = re.compile(r"\w+")


class WordHashes:
    """64-bit hashes of the lower-cased words (runs of letters, digits and underscores) of texts. Words already seen
    are looked up, within ``limit`` bytes."""

    def __init__(self, limit: int = 24 << 20):
        self.memory, self.hashes = Memory(limit), np.zeros(1024, np.uint64)

    def __call__(self, texts: list[str | None]) -> list[np.ndarray]:
        found = [_TOKEN.findall(t.lower()) if t else [] for t in texts]
        memory = self.memory
        index = memory.number([w for words in found for w in words])
        fresh, known = memory.fresh(), memory.known
        if fresh:
            count = known + len(fresh)
            if count > len(self.hashes):
                self.hashes = np.concatenate([self.hashes, np.zeros(2 * count, np.uint64)])
            self.hashes[known:count] = [xxhash.xxh3_64_intdigest(w) for w in fresh]
            memory.learned(sum(map(_word_size, fresh)))
        hashes = np.split(self.hashes[index], np.cumsum([len(words) for words in found])[:-1]) if found else []
        if memory.full:
            self.hashes = self.hashes[memory.forget(_word_size)]
        return hashes


def _word_size(word: str) -> int:
    return 150 + len(word)


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words; a shorter text is one shingle of all its words."""
    if not len(words):
        return words
    size = min(size, len(words))
    n = len(words) - size + 1
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(size):
            out = mix(out ^ words[i:i + n])
    return out

