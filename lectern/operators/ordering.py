"""Order-dependent operators that do not put a large key into one task.

A plain ``row_number() over (partition by key order by ...)`` sorts a key's rows in a single task, which one hot
session would stall. It is used while no key has more than ``bucket_rows`` rows. Else the table is cut into ranges of the whole order
(key, then order), so that a large key spreads over as many ranges as it fills, whatever its times are: outliers,
bursts, one instant or none. Rows are sorted within their range only, and counts or last values of the ranges, one row per range and
key, are carried over. Both ways give the same result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import written

BUCKET_ROWS = 100_000


def _same(keys: list[str], prefix: str) -> Column:
    condition = F.lit(True)
    for i, k in enumerate(keys):
        condition = condition & F.col(k).eqNullSafe(F.col(f"{prefix}{i}"))
    return condition


def _renamed(keys: list[str], prefix: str) -> list[Column]:
    return [F.col(k).alias(f"{prefix}{i}") for i, k in enumerate(keys)]


def _has_large(df: DataFrame, keys: list[str], bucket_rows: int) -> bool:
    return not df.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > bucket_rows).isEmpty()


def in_ranges(df: DataFrame, order: list[Column], bucket_rows: int) -> DataFrame:
    """The table cut into ranges of about ``bucket_rows`` rows along an order, stored with their number ``_range``."""
    count = max(1, -(-df.count() // bucket_rows))
    return written(df.repartitionByRange(count, *order).withColumn("_range", F.spark_partition_id()), "ranges")


def ordered_position(
    df: DataFrame, keys: list[str], order: list[Column], name: str, bucket_rows: int = BUCKET_ROWS
) -> DataFrame:
    """Exact ``row_number`` per key."""
    if not _has_large(df, keys, bucket_rows):
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    placed = in_ranges(df, [*map(F.col, keys), *order], bucket_rows)
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy(*keys, "_range").agg(F.count("*").alias("_rows")).withColumn(
        "_before", F.coalesce(F.sum("_rows").over(earlier), F.lit(0))).select(
        *_renamed(keys, "_k"), F.col("_range").alias("_r"), "_before")
    within = Window.partitionBy("_range", *keys).orderBy(*order)
    return placed.join(starts, _same(keys, "_k") & (F.col("_range") == F.col("_r"))).withColumn(
        name, F.col("_before") + F.row_number().over(within)).select(*df.columns, name)


def global_position(df: DataFrame, order: list[Column], name: str, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Exact ``row_number`` over a whole table."""
    placed = in_ranges(df, order, bucket_rows)
    starts = placed.groupBy("_range").agg(F.count("*").alias("_rows")).withColumn("_before", F.coalesce(F.sum("_rows").over(
        Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select(F.col("_range").alias("_r"), "_before")
    within = Window.partitionBy("_range").orderBy(*order)
    return placed.join(starts, F.col("_range") == F.col("_r")).withColumn(
        name, F.col("_before") + F.row_number().over(within)).select(*df.columns, name)


def previous_value(
    df: DataFrame, keys: list[str], order: list[str], value: str, name: str, bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Exact ``lag(value)`` per key; the first row of a range takes the last value of the key's range before."""
    if not _has_large(df, keys, bucket_rows):
        return df.withColumn(name, F.lag(value).over(Window.partitionBy(*keys).orderBy(*order)))
    placed = in_ranges(df, [F.col(c) for c in (*keys, *order)], bucket_rows)
    tails = placed.groupBy(*keys, "_range").agg(F.max_by(F.struct(F.col(value).alias("v")), F.struct(*order)).alias("_tail"))
    carried = tails.select(
        *_renamed(keys, "_k"), F.col("_range").alias("_r"),
        F.lag("_tail").over(Window.partitionBy(*keys).orderBy("_range")).alias("_carried"))
    within = Window.partitionBy("_range", *keys).orderBy(*order)
    return placed.join(carried, _same(keys, "_k") & (F.col("_range") == F.col("_r"))).withColumn(
        name, F.when(F.row_number().over(within) == 1, F.col("_carried.v")).otherwise(F.lag(value).over(within))
    ).select(*df.columns, name)


def newest_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the largest by ``order``; partial aggregation shrinks copies before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return picked.select(*keys, "_row.*").select(*df.columns)


def oldest_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return picked.select(*keys, "_row.*").select(*df.columns)


def first_n_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int, name: str = "_rn") -> DataFrame:
    """``row_number <= n`` per key. Spark limits each map task to n rows per key before the shuffle."""
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col(name) <= n)


def nearest_rank(df: DataFrame, value: str, percents: dict[str, float], buckets: int = 200) -> DataFrame:
    """Exact nearest-rank percentiles of one column in a single row; 0 when there are no values.

    Values are counted (map-side) and the counts summed per bucket; buckets are cut at approximate quantiles of the distinct values (at
    most ``buckets`` numbers on the driver), so that they are about even whatever the values' scale, and only those that hold a wanted
    rank are looked into."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("v")).agg(F.count("*").alias("n"))
    shares = [i / buckets for i in range(1, buckets)]
    cuts = sorted(set(counts.agg(F.percentile_approx("v", shares, 10 * buckets)).first()[0] or []))
    bucket = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda x: x <= F.col("v"))) if cuts else F.lit(0)
    counts = counts.withColumn("b", bucket)
    running = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
    everything = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    asked = F.array(*[F.struct(F.lit(k).alias("name"), F.lit(float(p)).alias("p")) for k, p in percents.items()])
    # one row per bucket
    targets = (
        counts.groupBy("b").agg(F.sum("n").alias("bn"))
        .withColumn("upto", F.sum("bn").over(running))
        .withColumn("total", F.sum("bn").over(everything))
        .withColumn("w", F.explode(asked))
        .withColumn("rank", F.greatest(F.ceil(F.col("w.p") / 100 * F.col("total")), F.lit(1)))
        .filter((F.col("rank") <= F.col("upto")) & (F.col("rank") > F.col("upto") - F.col("bn")))
        .select(F.col("w.name").alias("name"), "rank", F.col("b").alias("tb"),
                (F.col("upto") - F.col("bn")).alias("before"))
    )
    inside = Window.partitionBy("name").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    found = (
        counts.join(targets, F.col("b") == F.col("tb"))
        .withColumn("reached", F.col("before") + F.sum("n").over(inside))
        .filter(F.col("reached") >= F.col("rank"))
        .groupBy("name").agg(F.min("v").alias("v"))
    )
    return found.agg(*[
        F.coalesce(F.max(F.when(F.col("name") == k, F.round("v"))), F.lit(0.0)).cast("bigint").alias(k)
        for k in percents
    ])
