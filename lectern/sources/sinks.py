"""Writers. A table that is changed in parts is a Parquet folder dealt by hash of a key: a change reads and writes only
the parts it touches, whose new folders are written beside the table and then take the place of the old ones, and leaves the files of all others as
they are.

One writer at a time. A change that stops half-way is repeated as it is, since ids are derived from content and position; who needs
versions or concurrent writers keeps the table in a format that has them."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.base import present
from ..operators.audit import audit_sessions
from ..operators.sync import each_once, without
from ..session import exists, file_system, written

PARTS = 64
#: What says which file a chunk belongs to; rows without it are dealt by their source.
FILE_KEY = ("drive_file_id", "source")


class DealtTable:
    """A table in ``parts`` folders by hash of the first non-empty column of ``key``. The name of the folders holds the number of parts, so a
    table is never read with another one."""

    def __init__(self, spark: SparkSession, path: str, key: tuple[str, ...] = FILE_KEY, parts: int = PARTS):
        self.spark, self.path, self.key, self.parts = spark, path.rstrip("/"), tuple(key), parts
        self.column = f"part_of_{parts}"

    def part(self, columns: list[str]) -> Column:
        key = F.coalesce(*(present(F.col(c).cast("string")) for c in self.key if c in columns), F.lit(""))
        return F.pmod(F.xxhash64(key), F.lit(self.parts)).cast("int")

    def exists(self) -> bool:
        return exists(self.spark, f"{self.path}/_columns/{self.column}")

    def read(self, touched: list[int] | None = None) -> DataFrame:
        """The rows, or those of some parts, whose folders alone are read."""
        if not self.exists():
            raise ValueError(f"{self.path} is no table of {self.parts} parts")
        columns = self.spark.read.parquet(f"{self.path}/_columns/{self.column}").schema
        table = self.spark.read.schema(columns).parquet(self.path)
        return (table if touched is None else table.filter(F.col(self.column).isin(touched))).drop(self.column)

    def touched(self, keys: DataFrame) -> list[int]:
        """Parts of rows that have (some of) the key's columns: at most ``parts`` numbers."""
        return sorted(r[0] for r in keys.select(self.part(keys.columns)).distinct().collect())

    def replace(self, rows: DataFrame, touched: list[int]) -> None:
        """Make ``rows`` the contents of the parts ``touched``, which all of them belong to."""
        placed = rows.withColumn(self.column, self.part(rows.columns))
        # written aside and once, as rows may be made from the parts they replace; large parts are split, small ones share a file
        aside = f"{self.path}/_aside-{uuid.uuid4().hex}"
        placed.hint("rebalance", self.column).write.partitionBy(self.column).parquet(aside)
        fs, Path = file_system(self.spark, self.path)
        folders = [f.getPath().getName() for f in fs.listStatus(Path(aside))]
        filled = {int(name.split("=")[1]) for name in folders if "=" in name}
        if not filled <= set(touched):
            fs.delete(Path(aside), True)
            raise ValueError("rows of parts that are not replaced")
        if not self.exists():
            self.spark.createDataFrame([], placed.schema).write.parquet(f"{self.path}/_columns/{self.column}")
        for part in touched:
            folder = f"{self.column}={part}"
            fs.delete(Path(f"{self.path}/{folder}"), True)
            # a part without rows is not written
            if part in filled and not fs.rename(Path(f"{aside}/{folder}"), Path(f"{self.path}/{folder}")):
                raise OSError(f"{aside}/{folder} cannot be moved")
        fs.delete(Path(aside), True)

    def upsert(self, new: DataFrame, order: list[Column] | None = None, files: DataFrame | None = None) -> DataFrame:
        """Rows of ``new`` replace those of the same id, which must have the same key; returns the table. With ``files`` (the first column of the
        key), rows of those files that are not in ``new`` go."""
        if not self.exists():
            self.replace(each_once(new, order), list(range(self.parts)))
            return self.read()
        touched = set(self.touched(new))
        if files is not None:
            touched |= set(self.touched(files.select(F.col(self.key[0]))))
        before = self.read(sorted(touched))
        unknown = set(new.columns) - set(before.columns)
        if unknown:
            raise ValueError(f"{self.path} has no columns {sorted(unknown)}")
        # ids alone tell which rows go
        going = before.select("id").join(new.select("id"), "id", "left_semi")
        if files is not None:
            going = going.union(before.join(files.select(F.col(self.key[0])).distinct(), self.key[0], "left_semi").select("id"))
        kept = without(before, written(going.distinct(), "going"), "id")
        self.replace(kept.unionByName(each_once(new, order), allowMissingColumns=True).select(*before.columns), sorted(touched))
        return self.read()


def write_chunks(new: DataFrame, path: str, order: list[Column] | None = None, touched: DataFrame | None = None,
                 key: tuple[str, ...] = FILE_KEY, parts: int = PARTS) -> DataFrame:
    """Keyed upsert of chunks into the table at ``path``; returns the table. With ``touched`` (the first column of ``key``), chunks of those files
    that are not in ``new`` go. ``key`` is what the id determines: the file, or ("id",) where ids do not tell."""
    return DealtTable(new.sparkSession, path, key, parts).upsert(new, order, touched)


def export_audit_json(messages: DataFrame, path: str, part_size: int = 1000) -> None:
    """Nested sessions as JSON lines, a long session in several parts."""
    audit_sessions(messages, part_size).write.json(path)


def export_panel_tables(indicators: DataFrame, sessions: DataFrame, path: str) -> None:
    """The two sheets of the panel export as CSV folders with a header."""
    indicators.write.option("header", True).csv(f"{path}/indicators")
    sessions.write.option("header", True).option("escape", '"').csv(f"{path}/sessions")


def append_health(checks: DataFrame, path: str) -> None:
    checks.select("component", "status", "detail", "checked_at").write.mode("append").parquet(path)
