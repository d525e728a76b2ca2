"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


#: A Python worker holds a batch several times over (bytes, strings, results), and a task may have several workers.
BATCH_BYTES = 4 * 1024 * 1024


def build_session(master: str | None = None, app: str = "lectern", **conf: str) -> SparkSession:
    """A session with the settings the operators rely on; cluster settings are left to the cluster."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        # documents can be long: bound Arrow batches by bytes as well as by rows
        "spark.sql.execution.arrow.maxBytesPerBatch": str(BATCH_BYTES),
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_SHIPPED: set[str] = set()
_LOCAL_FOLDERS: dict[str, str] = {}


def prepare(spark: SparkSession) -> SparkSession:
    """Pin the session to UTC, bound Arrow batches by bytes (documents can be long) and, once per application, send this
    package to the Python workers."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    application = spark.sparkContext.applicationId
    if application not in _SHIPPED:
        package = Path(__file__).resolve().parent
        archive = shutil.make_archive(
            f"{tempfile.mkdtemp(prefix='spark-lectern-')}/{package.name}", "zip", package.parent, package.name)
        spark.sparkContext.addPyFile(archive)
        _SHIPPED.add(application)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``; a temporary one only where unset."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    return _LOCAL_FOLDERS.setdefault(context.applicationId, tempfile.mkdtemp(prefix="spark-lectern-"))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, never used before."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def file_system(spark: SparkSession, path: str):
    """Hadoop file system of a path and the Path class."""
    jvm = spark.sparkContext._jvm
    Path = jvm.org.apache.hadoop.fs.Path
    return Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), Path


def exists(spark: SparkSession, path: str) -> bool:
    fs, HadoopPath = file_system(spark, path)
    return fs.exists(HadoopPath(f"{path}/_SUCCESS"))


def written(df: DataFrame, name: str) -> DataFrame:
    """Write once to the shared folder and read back: cuts lineage and survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
