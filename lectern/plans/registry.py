"""Registry of queries and their checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..session import exists, scratch_path
from .inputs import derived, given, nested, with_tables


class Tables:
    """Given and derived tables of one scale folder, as attributes."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def given(self, name: str) -> DataFrame:
        return given(self.spark, self.folder, name)

    def spread(self, name: str) -> DataFrame:
        """A given table for work that is heavy per row: a scan of too few splits is spread over all cores.
        Large tables have more splits than cores and are left as they are."""
        scan = self.given(name)
        cores = self.spark.sparkContext.defaultParallelism
        return scan.repartition(2 * cores) if scan.rdd.getNumPartitions() < 2 * cores else scan

    def __getattr__(self, name: str) -> DataFrame:
        return derived(self.spark, self.folder, name)

    def feedback(self) -> DataFrame:
        """Ratings as they arrive."""
        return self._stored("feedback_raw")

    def chat(self) -> DataFrame:
        """Messages from conversations, with nested telemetry."""
        return self._stored("messages")

    def telemetry(self) -> DataFrame:
        """Assistant turns from events, with nested telemetry."""
        return self._stored("turns")

    def _stored(self, name: str) -> DataFrame:
        """A derived table stored as an application would store it, telemetry as a real struct column from which
        a query reads only the fields it needs. Written once per session and scale."""
        key = (self.spark.sparkContext.applicationId, self.folder, name)
        path = _STORED.get(key)
        if path is None or not exists(self.spark, path):
            table = derived(self.spark, self.folder, name, self.spread)
            if "has_meta" in table.columns:
                table = nested(table)
            path = scratch_path(self.spark, name)
            table.write.parquet(path)
            _STORED[key] = path
        return self.spark.read.parquet(path)


_STORED: dict[tuple, str] = {}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def readable(df: DataFrame) -> DataFrame:
    """Timestamps as text to the second, so that both engines print them alike."""
    return df.select(*[
        F.date_format(f.name, "yyyy-MM-dd HH:mm:ss").alias(f.name) if isinstance(f.dataType, T.TimestampType) else F.col(f.name)
        for f in df.schema.fields
    ])


def query(key: str, tables: str = "", check: str | None = None):
    """Register a query over ``Tables`` under a key, with its SQL check if there is one."""

    def register(fn: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return readable(fn(Tables(spark, folder.rstrip("/"))))

        run.__name__ = key
        QUERIES[key] = run
        if check is not None:
            CHECKS[key] = with_tables(tables, check)
        return fn

    return register


def at(c: str) -> str:
    """DuckDB text of a timestamp, as ``readable`` prints it."""
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S')"
