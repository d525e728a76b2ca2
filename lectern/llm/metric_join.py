"""Embedding near-duplicates by an exact metric range join.

Vectors of one label are scaled to length 1; the metric is their angle. A label of few vectors is one cell. Pivots divide a larger one: each
vector is at home with the nearest pivot. A vector can be within the threshold angle of a member of another cell only if
its distance to that cell's pivot, less the threshold, is between the least and the greatest distance at which that cell has
members (triangle inequality); only then is it copied there as a guest. Cells join independently, in blocks of
bounded size, and give counts and a spanning forest of the links they found, never the pairs themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..session import prepare
from .common import components, stored

COSINE = 0.93
#: Vectors per cell that pivots aim at, and rows of a block of a cell.
CELL, BLOCK = 2048, 1024
#: Pivots of all labels together: the bound of what is sent to every task. Labels that are one cell need none, so labels may be many.
MOST_PIVOTS = 4096
_SLACK = 1e-9


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(embedding...) to the scaled vector, null where it is null, empty, zero or holds null or non-finite components."""
    for batch in batches:
        lists = batch.column(batch.num_columns - 1)
        units = []
        for v in lists.to_pylist():
            unit = None
            if v and None not in v:
                x = np.array(v, np.float64)
                top = np.abs(x).max()
                if np.isfinite(top) and top > 0:
                    x = x / top  # no overflow or underflow in the squares
                    unit = x / np.sqrt(x @ x)
            units.append(unit)
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(units, pa.list_(pa.float64()))],
                                         names=[*batch.schema.names[:-1], "unit"])


def _angles(cosines: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosines, -1.0, 1.0))


def _home(pivots: dict):
    """(rep, label, times, unit) to the same with the nearest pivot's number and the angle to it."""

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = list(zip(batch.column(1).to_pylist(), (len(u) for u in batch.column(3))))
            units = batch.column(3).to_pylist()
            cell, angle = np.zeros(len(keys), np.int32), np.zeros(len(keys))
            for key in set(keys):
                rows = [i for i, k in enumerate(keys) if k == key]
                numbers, centres = pivots[key]
                angles = _angles(np.array([units[i] for i in rows]) @ centres.T)
                nearest = angles.argmin(axis=1)
                cell[rows], angle[rows] = numbers[nearest], angles[np.arange(len(rows)), nearest]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(angle)],
                                             names=[*batch.schema.names, "cell", "angle"])

    return home


def _visits(pivots: dict, least: np.ndarray, most: np.ndarray, threshold: float):
    """Each vector to (cell, guest, rep, times, unit): at home, and as a guest in the later cells that may hold a partner.
    A pair of two cells meets in the later one only."""

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = list(zip(batch.column(1).to_pylist(), (len(u) for u in batch.column(3))))
            units = batch.column(3).to_pylist()
            own = batch.column(4).to_numpy()
            rows_out, cells_out = [np.arange(len(keys))], [own]
            for key in set(keys):
                rows = np.array([i for i, k in enumerate(keys) if k == key])
                numbers, centres = pivots[key]
                angles = _angles(np.array([units[i] for i in rows]) @ centres.T)
                may = ((angles - threshold - _SLACK <= most[numbers]) & (angles + threshold + _SLACK >= least[numbers])
                       & (numbers[None, :] > own[rows][:, None]))
                r, c = np.nonzero(may)
                rows_out.append(rows[r])
                cells_out.append(numbers[c])
            rows, cells = np.concatenate(rows_out), np.concatenate(cells_out)
            for at in range(0, len(rows), 4096):
                part, to = pa.array(rows[at:at + 4096]), cells[at:at + 4096].astype(np.int32)
                guest = pa.array(np.arange(at, at + len(to)) >= len(keys))
                yield pa.RecordBatch.from_arrays([
                    pa.array(to), guest, batch.column(0).take(part), batch.column(2).take(part), batch.column(3).take(part)],
                    names=["cell", "guest", "rep", "times", "unit"])

    return visit


def _join(cosine: float):
    """One pair of blocks to rows (rep, n, low): links found to each vector, and a vector that it is connected to."""

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        side = pdf["side"].to_numpy()
        a, b = pdf[side != 1], pdf[side != 0]  # 0: left block, 1: right block, 2: a block with itself
        x, y = (np.stack(p["unit"].to_numpy()) if len(p) else np.zeros((0, 1)) for p in (a, b))
        if not len(a) or not len(b):
            return pd.DataFrame({"rep": [], "n": [], "low": []}).astype("int64")
        linked = x @ y.T >= cosine
        itself = side[0] == 2
        if itself:
            np.fill_diagonal(linked, False)
        n_a = linked @ b["times"].to_numpy()
        ids_a, ids_b = a["rep"].to_numpy(), b["rep"].to_numpy()
        low_a, low_b = ids_a.copy(), ids_b.copy()
        rows, columns = np.nonzero(linked)
        # smallest id over the links of both sides, until nothing changes
        while len(rows):
            before = low_a.sum(), low_b.sum()
            np.minimum.at(low_a, rows, low_b[columns])
            np.minimum.at(low_b, columns, low_a[rows])
            if itself:
                low_a = low_b = np.minimum(low_a, low_b)
            if (low_a.sum(), low_b.sum()) == before:
                break
        out = [(ids_a, n_a, low_a)]
        if not itself:
            out.append((ids_b, a["times"].to_numpy() @ linked, low_b))
        ids, n, low = (np.concatenate(c).astype("int64") for c in zip(*out))
        some = n > 0
        return pd.DataFrame({"rep": ids[some], "n": n[some], "low": low[some]})

    return join


def near_vectors(vectors: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", vector_col: str = "embedding",
                 label_col: str = "label") -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row.

    Rows of equal non-null labels whose vectors have a cosine of at least ``cosine`` in double precision are linked. Vectors that
    are null, empty, zero, or hold null or non-finite components, and rows without label or id, link with nothing and are
    their own component; so do vectors of different lengths. ``n_links`` counts other rows, repeated ids each;
    ``component_id`` is the smallest id that links reach, ``kept`` whether the row has it. Equal vectors are joined once, with their
    number. Extra columns are not read.
    """
    prepare(vectors.sparkSession)
    threshold = float(np.arccos(cosine))
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("embedding"))
    rows = rows.mapInArrow(_units, f"vec_id bigint, label {dict(rows.dtypes)['label']}, unit array<double>")
    usable = F.col("unit").isNotNull() & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    # equal vectors are found by a 128-bit digest of label and scaled vector
    rows = stored(rows.withColumns({
        "k1": F.when(usable, F.xxhash64("label", "unit")), "k2": F.when(usable, F.xxhash64("unit", "label", F.lit(1)))}), "vectors")
    groups = rows.filter("k1 IS NOT NULL").groupBy("k1", "k2").agg(
        F.min("vec_id").alias("lowest"), F.count("*").alias("times"), F.first("label").alias("label"), F.first("unit").alias("unit"))
    # an id may come with several vectors: groups are numbered apart from ids
    groups = stored(groups.withColumn("rep", F.monotonically_increasing_id()), "groups")
    plain = groups.select("rep", "label", "times", "unit")

    sized = plain.withColumn("size", F.size("unit"))
    sizes = stored(sized.groupBy("label", "size").agg(F.count("*").alias("n"), F.min("rep").alias("first")), "sizes")
    width = _width(sizes)
    divided = sized.join(F.broadcast(sizes.filter(F.col("n") > width).select("label", "size", "n")), ["label", "size"])
    n, edges = _links(divided, _undivided(sized, sizes, width), _pivots(divided, width), cosine, threshold)
    part = components(edges)
    members = groups.select("rep", "k1", "k2", "lowest", "times").join(n, "rep", "left").join(
        part, F.col("rep") == F.col("id"), "left").withColumn("part", F.coalesce("component", "rep"))
    lowest = members.groupBy("part").agg(F.min("lowest").alias("component_id"))
    members = members.join(lowest, "part").select(
        "k1", "k2", (F.coalesce("n", F.lit(0)) + F.col("times") - 1).alias("n_links"), "component_id")
    found = rows.select("vec_id", "k1", "k2").join(members, ["k1", "k2"], "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return found.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _width(sizes: DataFrame) -> int:
    """Vectors per cell: ``CELL``, or more if the labels of more than that would need more than ``MOST_PIVOTS`` pivots together."""
    labels, total = sizes.filter(F.col("n") > CELL).agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    # of labels wider than a cell there are at most total / width, and each has less than one pivot beyond its share
    return max(CELL, -(-total // (MOST_PIVOTS - labels)) if labels <= MOST_PIVOTS // 2 else -(-2 * total // MOST_PIVOTS))


def _undivided(sized: DataFrame, sizes: DataFrame, width: int) -> DataFrame:
    """The vectors of labels of up to ``width``, each label and length a cell of its own with a number below 0, met in the shuffle
    only. A single vector has no partner."""
    few = sizes.filter((F.col("n") > 1) & (F.col("n") <= width))
    return sized.join(few, ["label", "size"]).select(
        (-F.col("first") - 1).alias("cell"), F.lit(False).alias("guest"), "rep", "times", "unit",
        F.ceil(F.col("n") / BLOCK).cast("int").alias("home_blocks"), F.lit(0).alias("guest_blocks"))


def _pivots(divided: DataFrame, width: int) -> dict:
    """Label and length to (cell numbers, pivots), for labels of more than ``width`` vectors: one pivot per so many, at random by
    hash. At most ``MOST_PIVOTS`` vectors come to the driver."""
    wanted = F.ceil(F.col("n") / width)
    rank = F.row_number().over(Window.partitionBy("label", "size").orderBy(F.xxhash64("unit", F.lit(1)), "rep"))
    most = divided.agg(F.coalesce(F.max(wanted), F.lit(0))).first()[0]
    first = divided.withColumn("rank", rank).filter(F.col("rank") <= most)
    chosen = first.filter(F.col("rank") <= wanted).select("label", "size", "unit").collect()
    pivots: dict = {}
    for number, row in enumerate(sorted(chosen, key=lambda r: (str(r["label"]), r["size"], r["unit"]))):
        pivots.setdefault((row["label"], row["size"]), []).append((number, row["unit"]))
    return {k: (np.array([n for n, _ in v], np.int32), np.array([u for _, u in v])) for k, v in pivots.items()}


def _links(divided: DataFrame, undivided: DataFrame, pivots: dict, cosine: float, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Number of links of each vector, and edges (a, b) that connect what links connect."""
    kind = dict(divided.dtypes)
    placed = stored(divided.select("rep", "label", "times", "unit").mapInArrow(
        _home(pivots), f"rep bigint, label {kind['label']}, times bigint, unit array<double>, cell int, angle double"), "cells")
    cells = sum(len(numbers) for numbers, _ in pivots.values())
    least, most, homes = np.full(cells, np.inf), np.full(cells, -np.inf), {}
    for r in placed.groupBy("cell").agg(F.min("angle").alias("low"), F.max("angle").alias("high"), F.count("*").alias("n")).collect():
        least[r["cell"]], most[r["cell"]], homes[r["cell"]] = r["low"], r["high"], r["n"]  # one row per pivot
    visits = stored(placed.mapInArrow(
        _visits(pivots, least, most, threshold), "cell int, guest boolean, rep bigint, times bigint, unit array<double>"), "visits")
    blocks = visits.groupBy("cell").agg(
        F.ceil(F.count_if(~F.col("guest")) / BLOCK).cast("int").alias("home_blocks"),
        F.ceil(F.count_if("guest") / BLOCK).cast("int").alias("guest_blocks"))
    # rows of a cell are dealt to blocks by hash; blocks meet in pairs, each pair in a group of its own
    homed = visits.join(F.broadcast(blocks), "cell").withColumn("cell", F.col("cell").cast("bigint"))
    dealt = homed.unionByName(undivided).withColumn(
        "block", F.pmod(F.xxhash64("rep"), F.when(F.col("guest"), F.col("guest_blocks")).otherwise(F.col("home_blocks"))).cast("int"))

    def numbers(count: str):
        return F.when(F.col(count) > 0, F.sequence(F.lit(0), F.col(count) - 1)).otherwise(F.array().cast("array<int>"))

    def meeting(i, j, guests: bool, side):
        return F.struct(F.lit(guests).alias("guests"), i.cast("int").alias("i"), j.cast("int").alias("j"), side.cast("int").alias("side"))

    block = F.col("block")
    among = F.transform(numbers("home_blocks"), lambda x: meeting(
        F.least(block, x), F.greatest(block, x), False, F.when(x == block, 2).when(x > block, 0).otherwise(1)))
    hosts = F.transform(numbers("guest_blocks"), lambda x: meeting(block, x, True, F.lit(0)))
    visiting = F.transform(numbers("home_blocks"), lambda x: meeting(x, block, True, F.lit(1)))
    met = dealt.withColumn("m", F.explode(F.when(F.col("guest"), visiting).otherwise(F.concat(among, hosts)))).select(
        "cell", "m.*", "rep", "times", "unit")
    found = stored(met.groupBy("cell", "guests", "i", "j").applyInPandas(_join(cosine), "rep bigint, n bigint, low bigint"), "found")
    n = found.groupBy("rep").agg(F.sum("n").alias("n"))
    return n, found.filter("rep <> low").select(F.col("rep").alias("a"), F.col("low").alias("b"))
