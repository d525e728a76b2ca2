"""Mixing sources to target weights by pivotal dependent rounding.

Each source gets a share of all words by its weight, at most ``most`` times what it has. A document of a source is wanted
``target / source size`` times: the whole part of that is certain, the rest is a probability. Two documents with
fractional probabilities meet, and words move from one to the other, at random but without drift, until one of them
is in or out; the other goes on. The largest documents are settled first, each against as many of the next smaller ones as
balance it, so that a small one stays open. What is left of one group of documents meets what is left of others one level
higher, up to one residual per source. The words taken from a source thus stay within one, mostly short, document of the target.
"""

from __future__ import annotations

import math
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from .common import WORD, mix, packed, restricted, stored, uniform

#: Documents that meet in one group, and residuals that meet on each higher level.
GROUP = 2048
#: A table of sources up to this many rows is sent to every task; a larger one is joined by shuffle.
BROADCAST_SOURCES = 100_000


def word_count(text: Column) -> Column:
    """Runs of characters that are not ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), most: float = 3.0) -> DataFrame:
    """Rows (source, source_size, target) for a table of (source, size).

    Sources by code point, null last, take the weights in turn and share the total of all sizes by them. A target above
    ``most`` times the source's size stops there and its excess is shared again among the others, until none is above.
    """
    sources = stored(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    # positions without a single sorted task: ranges are numbered within, and offset by what lies before
    ranged = stored(sources.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("_range", F.spark_partition_id()), "sources")
    counts = ranged.groupBy("_range").count().withColumn("_before", F.coalesce(F.sum("count").over(
        Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(F.col("source").asc_nulls_last())) - 1 + F.col("_before")
    weight = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int"))
    ranked = stored(ranged.join(F.broadcast(counts), "_range").select("source", "source_size", weight.alias("weight")), "weights")
    total = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    # a source stops when its share at this level of words per weight exceeds its most; the level only rises
    limit = most * F.col("source_size")
    level = 0.0
    while True:
        stopped = limit <= level * F.col("weight")
        held, open_weight = ranked.agg(
            F.coalesce(F.sum(F.when(stopped, limit)), F.lit(0.0)), F.coalesce(F.sum(F.when(~stopped, F.col("weight"))), F.lit(0.0))).first()
        if not open_weight:
            break
        higher = (total - held) / open_weight
        if higher <= level * (1 + 1e-12):
            break
        level = higher
    target = F.least(limit.cast("double"), F.lit(level) * F.col("weight"))
    return ranked.select("source", "source_size", target.alias("target"))


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), most: float = 3.0, seed: int = 0,
                id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """How often each document is taken: ``doc_id, size, source_size, target, copies, taken`` and ``digest``, one row
    per input row. Reruns agree: the random numbers are hashes of ids and texts, the order of meeting is by size, then hash.

    Sizes count words; null and empty texts have size 0 and are never taken. A null source is a source of its own, null
    ids are allowed, and repeated rows are separate documents (which of two equal rows is taken makes no difference).
    No document is taken more than ``ceil(most)`` times. Extra columns are not read.
    """
    digest = F.xxhash64(id_col, text_col, source_col)
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"),
                        digest.alias("digest"))
    # equal rows become one with a count: combined before the shuffle
    sized = stored(sized.groupBy("doc_id", "source", "size", "digest").agg(F.count("*").alias("rows")), "sized")
    targets = source_targets(sized.select("source", (F.col("size") * F.col("rows")).alias("size")), weights, most)
    counts = sized.groupBy(F.col("source").alias("_source")).agg(F.ceil(F.count("*") / GROUP).alias("groups"))
    targets = stored(targets.join(counts, F.col("source").eqNullSafe(F.col("_source"))).select(
        F.col("source").alias("_source"), "source_size", "target", "groups"), "targets")
    n_sources, width = targets.agg(F.count("*"), F.coalesce(F.max("groups"), F.lit(1))).first()
    side = F.broadcast(targets) if n_sources <= BROADCAST_SOURCES else targets
    wanted = sized.join(side, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    times = F.when(F.col("size") > 0, F.col("rows") * F.col("target") / F.col("source_size")).otherwise(0.0)
    wanted = wanted.withColumn("copies", F.floor(times)).withColumn("chance", times - F.floor(times))
    # the group of a document is its hash, so that any number of documents per source is cut into even groups
    wanted = wanted.withColumn("node", F.pmod(F.xxhash64("digest", F.lit(seed)), "groups"))
    columns = ["doc_id", "source", "size", "source_size", "target", "copies", "digest", "rows", "chance", "node"]
    level, done, open_rows = 0, None, wanted.select(*columns)
    schema = T.StructType([*open_rows.schema.fields, T.StructField("open", T.BooleanType())])
    while True:
        last = width == 1
        settled = stored(open_rows.groupBy("source", "node").applyInPandas(_meeting(seed + level, last), schema), f"level-{level}")
        closed = settled.filter("NOT open").drop("open")
        done = closed if done is None else done.unionByName(closed)
        if last:
            break
        width, level = math.ceil(width / GROUP), level + 1
        open_rows = settled.filter("open").drop("open").withColumn("node", F.floor(F.col("node") / GROUP))
    # equal rows share out their copies
    each = done.withColumn("row", F.explode(F.sequence(F.lit(0), F.col("rows").cast("int") - 1)))
    copies = F.floor(F.col("copies") / F.col("rows")) + (F.col("row") < F.col("copies") % F.col("rows")).cast("int")
    return each.withColumn("copies", copies.cast("int")).select(
        "doc_id", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"), "source", "digest")


def _meeting(seed: int, last: bool):
    """Settles one group of documents of one source; at most one stays open, and none in the last level."""

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "digest"], ascending=[False, True], kind="stable").reset_index(drop=True)
        chance, size = pdf["chance"].to_numpy().copy(), pdf["size"].to_numpy().astype(np.float64)
        random = uniform(mix(pdf["digest"].to_numpy().astype(np.int64).view(np.uint64) ^ mix(np.array([seed], np.uint64))))
        left, order = -1, np.flatnonzero((chance > 0) & (size > 0)).tolist()
        for place, i in enumerate(order):
            if not 0 < chance[i] < 1:
                continue
            if left < 0 and not _settle(chance, size, i, order, place + 1, random[i]):
                left = i  # what comes after is too little to balance it: pair by pair from here on
            elif left >= 0:
                left = _transfer(chance, size, left, i, random[i])
        if left >= 0 and last:
            chance[left] = float(random[left] < chance[left])
            left = -1
        opened = np.zeros(len(pdf), bool)
        if left >= 0:
            opened[left] = True
        pdf["copies"] = pdf["copies"] + ((chance >= 1) & ~opened)
        pdf["chance"], pdf["open"] = chance, opened
        return pdf

    return meet


def _settle(chance: np.ndarray, size: np.ndarray, i: int, order: list[int], begin: int, random: float) -> bool:
    """Decide document i against the next smaller ones together: if it comes in, they give up as many words as it gains, else
    they take over its words, in shares that keep the mean of each. False, and nothing done, if they cannot balance it."""
    p, words = chance[i], size[i]
    shares, total = [], 0.0
    for j in order[begin:]:
        if 0 < chance[j] < 1:
            share = min(chance[j] * size[j] / ((1 - p) * words), (1 - chance[j]) * size[j] / (p * words), 1 - total)
            shares.append((j, share))
            total += share
            if total >= 1 - 1e-12:
                break
    else:
        return False
    chance[i] = float(random < p)
    moved = -(1 - p) * words if chance[i] else p * words
    for j, share in shares:
        chance[j] = _snap(chance[j] + moved * share / size[j])
    return True


def _snap(p: float) -> float:
    return 0.0 if p < 1e-9 else 1.0 if p > 1 - 1e-9 else p


def _transfer(chance: np.ndarray, size: np.ndarray, i: int, j: int, random: float) -> int:
    """Move words between i and j, keeping ``size_i p_i + size_j p_j`` and the mean of both, until one is 0 or 1.
    Gives the one that is still open, or -1."""
    up = min((1 - chance[i]) * size[i], chance[j] * size[j])  # words that can go to i
    down = min(chance[i] * size[i], (1 - chance[j]) * size[j])  # words that can go to j
    moved = up if random * (up + down) < down else -down
    chance[i], chance[j] = _snap(chance[i] + moved / size[i]), _snap(chance[j] - moved / size[j])
    open_rows = [k for k in (i, j) if 0 < chance[k] < 1]
    return open_rows[0] if open_rows else -1


def take(docs: DataFrame, mixed: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself, with the columns of ``docs``: every document as often as it is taken, copies as repeated rows."""
    totals = stored(mixed.groupBy("digest").agg(F.sum("copies").alias("copies"), F.count("*").alias("rows")).filter(
        "copies > 0"), "taken")
    keyed = packed(docs).withColumn("digest", F.xxhash64(*(F.col(f"row.{c}") for c in (id_col, text_col, source_col))))

    def repeated(df: DataFrame, times: Column) -> DataFrame:
        return df.withColumn("times", times.cast("int")).filter("times > 0").withColumn(
            "copy", F.explode(F.sequence(F.lit(1), "times"))).select("row.*")

    whole = repeated(restricted(keyed, totals, "digest"), F.floor(F.col("copies") / F.col("rows")))
    # equal rows whose copies do not divide evenly: one of them stands for the rest
    uneven = totals.filter("copies % rows > 0")
    if uneven.isEmpty():
        return whole
    rest = restricted(keyed, uneven, "digest").dropDuplicates(["digest"])
    return whole.unionByName(repeated(rest, F.col("copies") % F.col("rows")))
