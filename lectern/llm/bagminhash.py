"""MinHash near-duplicates of multisets: BagMinHash signatures, bands, and the exact overlap of what they bring together.

A document is a multiset of word shingles. For every shingle a Poisson process runs over (time, weight): the weight axis is
cut into the levels [0, 1), [1, 2), [2, 4), [4, 8), ... with an independent process on each, so that a shingle seen often reads only as
many levels as its count reaches, and a level it reaches in part is thinned by position. Each point carries a register;
a register keeps the first time that any point brings it. Two documents agree in a register with the probability of their weighted
Jaccard similarity. Points are made in order of time and only up to a bound by which all registers are likely filled;
a document with an empty register doubles its bound.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import prepare
from .common import WordHashes, byte_slices, components, held, mix, packed, restricted, shingles, stored, uniform

SHINGLE, SIMILARITY = 5, 0.8
#: Bands of registers: a pair of similarity 0.8 shares none of 24 bands of 5 with probability 7e-5, one of 0.9 with 1e-9.
BANDS, ROWS = 24, 5
#: Members of a cluster that meet in one group.
BLOCK = 1024


def signatures(owners: np.ndarray, elements: np.ndarray, counts: np.ndarray, documents: int, registers: int) -> np.ndarray:
    """Register values (hashes of the winning points) of documents given as (owner, element, count) triples; 0 in
    documents without elements. A function of the multisets alone, whatever else stands in the block."""
    best = np.full(documents * registers, np.inf)
    winner = np.zeros(documents * registers, np.uint64)
    weight = np.bincount(owners, counts, documents)
    # a bound by which a process of this total rate has likely hit all registers
    bound = np.where(weight > 0, registers * (np.log(registers) + 4) / np.maximum(weight, 1), 0.0)
    todo = np.flatnonzero(weight > 0)
    chosen = np.arange(len(owners))
    while len(todo):
        for own, key, time, position in _points(owners[chosen], elements[chosen], counts[chosen], bound):
            register = (position % np.uint64(registers)).astype(np.int64)
            place = own * registers + register
            order = np.lexsort((time, place))
            place, time, key = place[order], time[order], key[order]
            first = np.concatenate([[True], place[1:] != place[:-1]])
            place, time, key = place[first], time[first], key[first]
            better = time < best[place]
            best[place[better]], winner[place[better]] = time[better], key[better]
        missing = ~np.isfinite(best.reshape(documents, registers)[todo]).all(axis=1)
        # a winner beyond the bound cannot exist, so filled registers are final
        todo = todo[missing]
        bound[todo] *= 2
        again = np.zeros(documents, bool)
        again[todo] = True
        chosen = np.flatnonzero(again[owners])
    return winner.reshape(documents, registers)


def _points(owners, elements, counts, bound):
    """Points of all processes up to their documents' bounds, in blocks: (owner, key, time, hash for the register)."""
    level = 0
    reach = np.arange(len(owners))
    while len(reach):
        low, width = (0, 1) if level == 0 else (1 << (level - 1), 1 << (level - 1))
        reach = reach[counts[reach] > low]
        if not len(reach):
            return
        rows, seed = reach, mix(elements[reach] ^ mix(np.array([level + 1], np.uint64)))
        time = np.zeros(len(rows))
        while len(rows):
            seed = mix(seed)
            time = time - np.log(uniform(seed)) / width
            kept = time <= bound[owners[rows]]
            rows, seed, time = rows[kept], seed[kept], time[kept]
            if not len(rows):
                break
            where = mix(seed ^ np.uint64(0xA5A5A5A5A5A5A5A5))
            inside = low + uniform(where) * width < counts[rows]
            if inside.any():
                yield owners[rows][inside], seed[inside], time[inside], mix(where ^ np.uint64(0x5A5A5A5A5A5A5A5A))[inside]
        level += 1


def multisets(texts: list[str | None], size: int = SHINGLE) -> list[tuple[np.ndarray, np.ndarray]]:
    """The distinct word shingles of texts, sorted, and how often each occurs."""
    return [np.unique(shingles(words, size), return_counts=True) for words in held("words", WordHashes)(texts)]


def occurrences(elements: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A multiset as a set: the n-th occurrence of an element is a member of its own. Overlaps of such sets are those of the multisets."""
    again = np.repeat(elements, counts)
    nth = np.arange(len(again)) - np.repeat(np.cumsum(counts) - counts, counts)
    return mix(again ^ mix(nth.astype(np.uint64)))


def _sign(size: int, bands: int, rows: int):
    """(doc_id, h, text) to (doc_id, h, bag, weight, bands): the multiset as one number, its total count, a hash for each band."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in byte_slices(batches, 2):
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                bags = multisets(batch.column(2).to_pylist(), size)
                sizes = np.fromiter((len(b[0]) for b in bags), np.int64, len(bags))
                owners = np.repeat(np.arange(len(bags)), sizes)
                elements, counts = np.concatenate([b[0] for b in bags]), np.concatenate([b[1] for b in bags])
                registers = signatures(owners, elements, counts, len(bags), bands * rows).reshape(len(bags), bands, rows)
                keys = np.tile(mix(np.arange(bands, dtype=np.uint64)), (len(bags), 1))
                for r in range(rows):
                    keys = mix(keys ^ registers[:, :, r])
                # a text without words is like its exact copies only
                bag = np.where(sizes > 0, np.uint64(0), batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64))
                np.add.at(bag, owners, mix(elements ^ mix(counts.astype(np.uint64))))
                weight = np.bincount(owners, counts, len(bags)).astype(np.int64)
                offsets = np.arange(0, keys.size + 1, bands, dtype=np.int32)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0), batch.column(1), pa.array(bag.view(np.int64)), pa.array(weight),
                    pa.ListArray.from_arrays(offsets, pa.array(keys.reshape(-1).view(np.int64)))],
                    names=["doc_id", "h", "bag", "weight", "bands"])

    return sign


def _expand(size: int):
    """(bag, text) to (bag, members): the multiset as a set of occurrences."""

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in byte_slices(batches, 1):
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                sets = [occurrences(*bag) for bag in multisets(batch.column(1).to_pylist(), size)]
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(sets).view(np.int64)))],
                    names=["bag", "members"])

    return expand


def near_duplicates(docs: DataFrame, size: int = SHINGLE, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The class of every document: ``doc_id, h, class_id, kept``, one row per input row. ``h`` is ``xxhash64(text)``.

    Documents are linked if their multisets of ``size``-word shingles have a weighted Jaccard similarity of at least
    ``similarity``, and a class is what links connect; ``class_id`` is its smallest id. Words are runs of letters and
    digits, lower-cased; a text shorter than ``size`` words is one shingle. Texts without words are in a class with their exact
    copies only; a null text is an empty one. ``kept`` marks the row of the smallest (id, h), null ids last; equal rows are
    all marked. Extra columns are not read.

    Equal multisets are one member. Members that share a band hang together in clusters, and all pairs of a cluster are compared
    exactly, in blocks of bounded size: a superset of the pairs that share a band, none of which is emitted as a row.
    """
    prepare(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    source = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text"))
    signed = stored(source.mapInArrow(
        _sign(size, bands, rows), "doc_id bigint, h bigint, bag bigint, weight bigint, bands array<bigint>"), "signed")
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")
    members = stored(signed.groupBy("bag").agg(
        F.min(first).alias("first"), F.min("h").alias("text_h"), F.first("weight").alias("weight"), F.first("bands").alias("bands")), "members")

    # members of one bucket, each tied to one of them: what hangs together that way is a cluster
    buckets = members.filter("weight > 0").select("bag", F.explode("bands").alias("key"))
    shared = buckets.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct(F.xxhash64("bag"), "bag"))["bag"].alias("leader")).filter("n > 1")
    ties = buckets.join(shared.select("key", "leader"), "key").filter("bag <> leader").select(
        F.col("bag").alias("a"), F.col("leader").alias("b")).distinct()
    clusters = stored(components(ties).select(F.col("id").alias("bag"), F.col("component").alias("cluster")), "clusters")
    links = _links(_sets(source, members, clusters, size), clusters, similarity)
    part = components(links).select(F.col("id").alias("bag"), "component")

    placed = members.join(part, "bag", "left").select(
        "bag", "first", F.coalesce("component", "bag").alias("class"))
    classes = placed.groupBy("class").agg(F.min("first").alias("lowest"))
    of_bag = placed.join(classes, "class").select("bag", "lowest")
    return signed.select("doc_id", "h", "bag").join(of_bag, "bag").select(
        "doc_id", "h", F.col("lowest.doc_id").alias("class_id"),
        (F.col("doc_id").eqNullSafe(F.col("lowest.doc_id")) & (F.col("h") == F.col("lowest.h"))).alias("kept"))


def _sets(source: DataFrame, members: DataFrame, clusters: DataFrame, size: int) -> DataFrame:
    """The occurrence sets of the members of clusters, from one text of each."""
    needed = stored(members.join(clusters, "bag").select("bag", F.col("text_h").alias("h")), "needed")
    texts = restricted(source.select("h", "text"), needed, "h").select("bag", "text")
    return texts.mapInArrow(_expand(size), "bag bigint, members array<bigint>").groupBy("bag").agg(F.first("members").alias("members"))


def _links(sets: DataFrame, clusters: DataFrame, similarity: float) -> DataFrame:
    """Edges (a, b) that connect whatever pairs of one cluster reach the similarity, by comparing all of them.

    A cluster of more than ``BLOCK`` members is cut into blocks by hash that meet in pairs, each pair in a group of its own; small
    clusters share a group of about half a block. A group gives a spanning forest of its links, never the pairs."""
    sizes = clusters.groupBy("cluster").agg(F.count("*").alias("n"))
    total = clusters.count()
    groups = max(1, total // (BLOCK // 2))
    sized = stored(clusters.join(sizes, "cluster").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")), "sized")
    block = F.pmod(F.xxhash64("bag"), F.col("blocks")).cast("int")
    small = F.col("blocks") == 1

    def meeting(x):
        return F.struct(F.least(F.col("block"), x).alias("i"), F.greatest(F.col("block"), x).alias("j"),
                        F.when(x == F.col("block"), 2).when(x > F.col("block"), 0).otherwise(1).alias("side"))

    met = sized.withColumn("block", block).withColumn(
        "m", F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), meeting))).select(
        "bag", "cluster", "m.*", F.when(small, F.pmod(F.xxhash64("cluster"), F.lit(groups))).otherwise(F.col("cluster")).alias("group"), small.alias("small"))
    return met.join(sets, "bag").groupBy("group", "small", "i", "j").applyInPandas(_meet(similarity), "a bigint, b bigint")


def _meet(similarity: float):
    """One group of clusters, or one pair of blocks, to edges (a, b)."""

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, own in pdf.groupby("cluster", sort=False):
            if len(own) > 1:
                out.append(_forest(own["bag"].to_numpy(), own["side"].to_numpy(), own["members"].to_numpy(), similarity))
        edges = np.concatenate(out) if out else np.zeros((0, 2), np.int64)
        return pd.DataFrame({"a": edges[:, 0], "b": edges[:, 1]})

    return meet


def _forest(ids: np.ndarray, side: np.ndarray, members: np.ndarray, similarity: float) -> np.ndarray:
    """Edges from each id to the smallest one that links reach within the group; side 0 meets side 1, side 2 itself."""
    left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
    if not len(left) or not len(right):
        return np.zeros((0, 2), np.int64)
    weight = np.array([len(m) for m in members], np.float64)
    row = np.repeat(np.arange(len(ids)), weight.astype(np.int64))
    _, column, often = np.unique(np.concatenate(members), return_inverse=True, return_counts=True)
    # members of one set only are in no overlap
    common = np.flatnonzero(often > 1)
    place = np.full(len(often), -1)
    place[common] = np.arange(len(common))
    column = place[column]
    row, column = row[column >= 0], column[column >= 0]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    shared = np.zeros((len(left), len(right)), np.float32)
    for at in range(0, len(common), 4096):
        low, high = np.searchsorted(column, [at, at + 4096])
        held = np.zeros((len(ids), min(4096, len(common) - at)), np.float32)
        held[row[low:high], column[low:high] - at] = 1
        shared += held[left] @ held[right].T
    linked = shared >= similarity * (weight[left][:, None] + weight[right][None, :] - shared)
    x, y = np.nonzero(linked & (ids[left][:, None] != ids[right][None, :]))
    label = np.arange(len(ids))
    a, b = left[x], right[y]
    while len(a):
        before = label.copy()
        np.minimum.at(label, a, label[b])
        np.minimum.at(label, b, label[a])
        label = label[label]
        if (label == before).all():
            break
    tied = np.flatnonzero(label != np.arange(len(ids)))
    return np.stack([ids[tied], ids[label[tied]]], axis=1)


def keep_first(docs: DataFrame, classes: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each class, with the columns of ``docs``."""
    kept = stored(classes.filter("kept").groupBy(
        F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("none"), "h").agg(F.count("*").alias("n")), "kept")
    own, text = F.col(f"row.{id_col}").cast("bigint"), F.col(f"row.{text_col}")
    keyed = packed(docs).withColumns({
        "id": F.coalesce(own, F.lit(0)), "none": own.isNull(), "h": F.xxhash64(F.coalesce(text, F.lit("")))})
    found = restricted(keyed, kept, "id", "none", "h")
    if kept.filter("n > 1").isEmpty():
        return found.select("row.*")
    # equal rows with equal ids: one of them
    return found.filter("n = 1").unionByName(found.filter("n > 1").dropDuplicates(["id", "none", "h"])).select("row.*")
