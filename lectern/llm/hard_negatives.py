"""Hard-negative mining with segment summaries.

Every vector is cut into segments; the mean and the deviation of each segment are stored beside the vector. Over a segment of
length L two vectors x, y have the product L * mean_x * mean_y + (x - mean_x)(y - mean_y), and the last term lies within plus or minus
deviation_x * deviation_y. Sums over few long segments bound a score coarsely, sums over more and shorter ones finely: pairs are
passed through the levels from coarse to fine, and only what no level rules out is scored exactly.

Rows stand in blocks along (length, label). A block is held by a task while its queries stream past it, so memory is bounded by a
block and a batch; blocks give the best rows of each query, which are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..session import prepare
from .common import stored

#: Segments of a vector at the finest level, and at each level that pairs pass, coarse to fine.
SEGMENTS, LEVELS = 16, (2, 4, 8, 16)
#: Components of all vectors of a block, queries that share a task with a block, and queries scored at a time.
BLOCK_VALUES, SLICE, BATCH = 1 << 22, 1 << 20, 256
SCALE = 256
POSITIVES, NEGATIVES = 5, 3
#: Percent of the positive's score between which a negative's must be.
LOWEST, HIGHEST = 50, 95

_ROW = "vec_id bigint, label bigint, dim int, v array<int>, means array<float>, devs array<float>"


def cuts(dim: int, parts: int = SEGMENTS) -> np.ndarray:
    """Borders of the segments of a vector: at most ``parts``, of nearly equal length."""
    parts = min(dim, parts)
    return np.arange(parts + 1) * dim // parts


def summaries(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Means and deviations (root of the sum of squared differences) of the segments of each row."""
    edges = cuts(x.shape[1])
    length = np.diff(edges)
    means = np.add.reduceat(x, edges[:-1], axis=1) / length
    devs = np.sqrt(np.add.reduceat((x - np.repeat(means, length, axis=1)) ** 2, edges[:-1], axis=1))
    return means, devs


def coarser(means: np.ndarray, devs: np.ndarray, length: np.ndarray, parts: int):
    """Summaries of ``parts`` longer segments, from those of the shorter ones they consist of."""
    edges = cuts(len(length), parts)
    total = np.add.reduceat(length, edges[:-1])
    mean = np.add.reduceat(means * length, edges[:-1], axis=1) / total
    rest = (means - np.repeat(mean, np.diff(edges), axis=1)) ** 2 * length
    return mean, np.sqrt(np.add.reduceat(devs ** 2 + rest, edges[:-1], axis=1)), total


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, label, embedding) to whole components and summaries; rows that take no part are left out."""
    for batch in batches:
        by_dim: dict[int, tuple[list, list]] = {}
        for i, v in enumerate(batch.column(2).to_pylist()):
            if v and None not in v:
                rows, vectors = by_dim.setdefault(len(v), ([], []))
                rows.append(i)
                vectors.append(v)
        for dim, (rows, vectors) in by_dim.items():
            x = np.floor(SCALE * np.array(vectors, np.float64))
            with np.errstate(over="ignore", invalid="ignore"):
                ok = (x * x).sum(axis=1) < 2.0 ** 62  # false for non-finite ones as well
            x, rows = x[ok], np.array(rows)[ok]
            if not len(x):
                continue
            means, devs = summaries(x)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(rows)), batch.column(1).take(pa.array(rows)), pa.array(np.full(len(x), dim, np.int32)),
                *(_lists(part, kind) for part, kind in ((x, np.int32), (means, np.float32), (devs, np.float32)))],
                names=["vec_id", "label", "dim", "v", "means", "devs"])


def _lists(x: np.ndarray, kind) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), pa.array(x.astype(kind).reshape(-1)))


def _matrix(lists, rows: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


class _Block:
    """The rows of one length in a block, in ascending order of id, with their summaries at all levels."""

    def __init__(self, batches: list[pa.RecordBatch]):
        self.ids, self.labels, self.rids = (np.concatenate([b.column(c).to_numpy() for b in batches]) for c in ("vec_id", "label", "rid"))
        self.v, means, devs = (np.concatenate([_matrix(b.column(c), b.num_rows) for b in batches]) for c in ("v", "means", "devs"))
        self.v = self.v.astype(np.float64)
        self.norms = np.sqrt((self.v ** 2).sum(axis=1))
        self.levels = list(_levels(means, devs, self.v.shape[1]))


def _levels(means, devs, dim: int):
    """(means * root of the length, deviations) from coarse to fine, so that a bound is one product of each kind."""
    length = np.diff(cuts(dim))
    for parts in sorted({min(p, len(length)) for p in LEVELS}):
        m, d, n = coarser(means.astype(np.float64), devs.astype(np.float64), length, parts)
        yield m * np.sqrt(n), d


class _Best:
    """The k best rows of each (query, window) so far: scores descending, ids ascending."""

    def __init__(self, queries: int, windows: int, k: int):
        self.windows, self.k = windows, k
        self.key, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))
        #: A row must score more than this to enter: rows come in ascending order of id, so that later ties do not count.
        self.floor = np.full((queries, windows), np.iinfo(np.int64).min)

    def add(self, query: np.ndarray, window: int, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(query):
            return
        key = np.concatenate([self.key, query * self.windows + window])
        score, ids = np.concatenate([self.score, score]), np.concatenate([self.id, ids])
        order = np.lexsort((ids, -score, key))
        key, score, ids = key[order], score[order], ids[order]
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        place = np.arange(len(key)) - np.repeat(starts, np.diff(np.r_[starts, len(key)]))
        last = key[place == self.k - 1]
        self.floor.reshape(-1)[last] = score[place == self.k - 1]
        kept = place < self.k
        self.key, self.score, self.id = key[kept], score[kept], ids[kept]


def search(block: _Block, rids, labels, v, means, devs, low, high, same: bool, k: int, seen: dict | None = None) -> _Best:
    """The ``k`` best rows of the block for each query and each of its windows ``low <= score <= high`` (matrices: query, window).

    ``same`` asks for rows of the query's label other than itself, else for rows of other labels. ``seen`` counts, by level,
    the pairs that pass it."""
    v = v.astype(np.float64)
    norms = np.sqrt((v ** 2).sum(axis=1))
    levels = list(_levels(means, devs, v.shape[1]))
    best = _Best(len(v), low.shape[1], k)
    start, width = 0, 128
    while start < len(block.ids):
        part = slice(start, start + width)
        alive = (labels[:, None] == block.labels[None, part]) == same
        if same:
            alive &= rids[:, None] != block.rids[None, part]
        # what any window still asks for
        least = np.maximum(low, best.floor).min(axis=1)[:, None]
        most = high.max(axis=1)[:, None]
        slack = 1e-5 * norms[:, None] * block.norms[None, part] + 1
        _count(seen, "label", alive)
        for number, ((m, d), (bm, bd)) in enumerate(zip(levels, block.levels)):
            # a level is worth its cost while it has rows and queries left
            rows, columns = np.flatnonzero(alive.any(axis=1)), np.flatnonzero(alive.any(axis=0))
            if not len(rows):
                break
            mid, gap = m[rows] @ bm[part][columns].T, d[rows] @ bd[part][columns].T + slack[np.ix_(rows, columns)]
            alive[np.ix_(rows, columns)] &= (mid + gap >= least[rows]) & (mid - gap <= most[rows])
            _count(seen, number, alive)
        rows, columns = np.flatnonzero(alive.any(axis=1)), np.flatnonzero(alive.any(axis=0))
        if len(rows):
            score = _scores(v[rows], norms[rows], block.v[part][columns], block.norms[part][columns])
            left = alive[np.ix_(rows, columns)]
            for w in range(low.shape[1]):
                fits = left & (score >= low[rows, w][:, None]) & (score <= high[rows, w][:, None]) & (score > best.floor[rows, w][:, None])
                q, c = np.nonzero(fits)
                best.add(rows[q], w, score[q, c], block.ids[part][columns[c]])
        start, width = start + width, min(2 * width, 4096)
    return best


def _count(seen: dict | None, level, alive: np.ndarray) -> None:
    if seen is not None:
        seen[level] = seen.get(level, 0) + int(alive.sum())


def _scores(a, a_norms, b, b_norms) -> np.ndarray:
    """Exact whole inner products: in floating point where no sum can leave its exact range, else in 64-bit numbers."""
    most = a_norms.max() * b_norms.max()
    if most < 2 ** 23:
        return (a.astype(np.float32) @ b.astype(np.float32).T).astype(np.int64)
    if most < 2 ** 52:
        return (a @ b.T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def _match(windows, same: bool, k: int):
    """Blocks, each followed by its queries, to (rid, window, id, score)."""

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[pa.RecordBatch]] = {}
        blocks: dict[int, _Block] = {}
        here, asking = None, False
        for batch in batches:
            place = np.stack([batch.column(c).to_numpy() for c in ("block", "slice", "query", "dim")])
            starts = np.flatnonzero(np.r_[True, (place[:, 1:] != place[:, :-1]).any(axis=0)]).tolist()
            for a, b in zip(starts, [*starts[1:], batch.num_rows]):
                block, slice_, query, dim = place[:, a].tolist()
                if here != (block, slice_) or query < asking:
                    here, held, blocks = (block, slice_), {}, {}
                asking = query
                if not query:
                    held.setdefault(dim, []).append(batch.slice(a, b - a))
                    continue
                if dim not in blocks:
                    if dim not in held:
                        continue  # no row of this length here
                    blocks[dim] = _Block(held.pop(dim))
                for at in range(a, b, BATCH):
                    yield _answer(blocks[dim], batch.slice(at, min(BATCH, b - at)), windows, same, k)

    return match


def _answer(block: _Block, queries: pa.RecordBatch, windows, same: bool, k: int) -> pa.RecordBatch:
    n = queries.num_rows
    rids, labels = (queries.column(c).to_numpy() for c in ("rid", "label"))
    low, high = windows(queries.column("scores"), n)
    best = search(block, rids, labels, *(_matrix(queries.column(c), n) for c in ("v", "means", "devs")), low, high, same, k)
    return pa.RecordBatch.from_arrays([
        pa.array(rids[best.key // best.windows]), pa.array((best.key % best.windows).astype(np.int32)), pa.array(best.id), pa.array(best.score)],
        names=["rid", "window", "id", "score"])


def _open(scores, n: int) -> tuple[np.ndarray, np.ndarray]:
    """One window for each query, which every score fits."""
    return np.full((n, 1), -2 ** 62), np.full((n, 1), 2 ** 62)


def _between(lowest: int, highest: int):
    """A window for each of the scores of a query: from ``lowest`` to ``highest`` percent of it, in whole numbers."""

    def windows(scores, n: int) -> tuple[np.ndarray, np.ndarray]:
        lengths = scores.value_lengths().to_numpy(zero_copy_only=False)
        of = np.zeros((n, max(1, lengths.max())), np.int64)
        used = np.arange(of.shape[1])[None, :] < lengths[:, None]
        of[used] = scores.flatten().to_numpy(zero_copy_only=False)
        # nothing fits where a query has fewer scores than others
        return (np.where(used, -_hundredths(-of, lowest), 2 ** 62), np.where(used, _hundredths(of, highest), -2 ** 62))

    return windows


def _hundredths(x: np.ndarray, percent: int) -> np.ndarray:
    """floor(x * percent / 100) without leaving 64 bits."""
    return x // 100 * percent + x % 100 * percent // 100


def _placed(rows: DataFrame) -> DataFrame:
    """The rows in blocks along (dim, label), with the block's number; a label of many rows fills several blocks."""
    n, values = rows.agg(F.count("*"), F.coalesce(F.sum("dim"), F.lit(0))).first()
    wanted = max(-(-values // BLOCK_VALUES), min(rows.sparkSession.sparkContext.defaultParallelism, -(-n // 2048)), 1)
    ranged = rows.repartitionByRange(wanted, "dim", "label", F.xxhash64("rid"))
    # a session may deal finer than asked for; neighbouring ranges then make up a block, since every block is asked by every anchor
    block = F.floor(F.spark_partition_id() * wanted / ranged.rdd.getNumPartitions()).cast("int")
    return stored(ranged.withColumn("block", block), "blocks")


def _meet(rows: DataFrame, queries: DataFrame, windows, same: bool, k: int, slices: int) -> DataFrame:
    """The ``k`` best of all blocks for each (rid, window) of queries that name the ``blocks`` they ask."""
    columns = ["rid", "vec_id", "label", "dim", "v", "means", "devs"]
    asked = queries.withColumn("block", F.explode("blocks")).select(
        "block", F.pmod(F.xxhash64("rid"), F.lit(slices)).cast("int").alias("slice"), F.lit(1).alias("query"), *columns, "scores")
    held = rows.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))).select(
        "block", "slice", F.lit(0).alias("query"), *columns,
        F.lit(None).cast("array<bigint>").alias("scores"))
    parts = max(1, rows.select("block").distinct().count() * slices)
    met = held.union(asked).repartition(parts, "block", "slice").sortWithinPartitions("block", "slice", "query", "dim", "vec_id")
    found = met.mapInArrow(_match(windows, same, k), "rid bigint, window int, id bigint, score bigint")
    best = Window.partitionBy("rid", "window").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def mine(vectors: DataFrame, anchor=None, label=None, positives: int = POSITIVES, negatives: int = NEGATIVES, lowest: int = LOWEST,
         highest: int = HIGHEST, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Hard negatives: ``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``anchor`` is the condition for anchors (a column over ``vec_id``, all rows if none), ``label`` replaces the label (a column over ``vec_id``
    and ``label``). Components x become floor(256 x) and scores are their exact inner products. An anchor's positives are its
    ``positives`` best other rows of its label; for each of them the ``negatives`` best rows of other labels are returned whose score is between
    ``lowest`` and ``highest`` percent of the positive's. Higher scores come first, ties by smaller id; rows of equal score and id
    are interchangeable. Repeated rows count each, as anchors too.

    Rows without label, id or vector, with an empty vector or one that holds null or non-finite components take no part, nor do
    vectors whose squared length reaches 2^62, whose scores would leave the 64-bit numbers; rows of different lengths have no score. Extra columns are not
    read; an empty table gives an empty result.
    """
    spark = prepare(vectors.sparkSession)
    source = vectors.select(
        F.col(id_col).cast("bigint").alias("vec_id"), F.col(label_col).cast("bigint").alias("label"),
        F.col(vector_col).cast("array<double>").alias("embedding")).filter("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL")
    if label is not None:
        source = source.select("vec_id", label.cast("bigint").alias("label"), "embedding").filter("label IS NOT NULL")
    read = stored(source.mapInArrow(_read, _ROW).withColumn("rid", F.monotonically_increasing_id()), "segments")
    rows = _placed(read)
    # labels that fill more than one block: at most one for each border between blocks
    wide = rows.groupBy("dim", "label").agg(F.min("block").alias("first"), F.max("block").alias("last")).filter("first < last")
    blocks = (rows.agg(F.max("block")).first()[0] or 0) + 1
    asking = (rows.filter(anchor) if anchor is not None else rows).join(F.broadcast(wide), ["dim", "label"], "left")
    asking = stored(asking, "anchors")
    slices = max(1, -(-asking.count() // SLICE))
    ends = (F.coalesce("first", "block"), F.coalesce("last", "block"))
    own = asking.withColumns({"blocks": F.sequence(*ends), "scores": F.lit(None).cast("array<bigint>")})
    chosen = _meet(rows, own, _open, True, positives, slices)
    chosen = stored(chosen.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "score"))).alias("positive")), "positives")

    windows = asking.join(chosen, "rid").withColumn("scores", F.col("positive.score"))
    # a block between the first and the last of a label holds no other label
    elsewhere = F.filter(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda b: ~F.coalesce((b > F.col("first")) & (b < F.col("last")), F.lit(False)))
    found = _meet(rows, windows.withColumn("blocks", elsewhere), _between(lowest, highest), False, negatives, slices)
    positive = chosen.join(asking.select("rid", "vec_id"), "rid").select(
        "rid", F.col("vec_id").alias("anchor_id"), F.posexplode("positive").alias("window", "p"))
    return positive.join(found, ["rid", "window"]).select(
        "anchor_id", F.col("p.id").alias("positive_id"), "rank", F.col("id").alias("negative_id"),
        F.col("p.score").alias("positive_score"), F.col("score").alias("negative_score"))

