"""Session defaults and the shared folder that cuts lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession

T = TypeVar("T")
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def get_spark(app: str = "siftline", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the defaults above; `conf` keys use `_` for `.` and win over them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in (DEFAULTS | {k.replace("_", "."): v for k, v in conf.items()}).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which every executor sees.

    A temporary folder is made only where the setting is unset and the master is a single local process.
    """
    sc = spark.sparkContext
    have = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if have is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        have = "file://" + tempfile.mkdtemp(prefix="spark-siftline-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(have)
    return have.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """`df` written to the shared folder, without its lineage; survives the loss of executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_PATHS: list[str] = []


def new_table_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder for a written table."""
    _PATHS.append(f"{shared_dir(spark)}/siftline-{name}-{uuid.uuid4().hex}")
    return _PATHS[-1]


def drop_tables(spark: SparkSession, of: DataFrame | None = None) -> None:
    """Deletes the tables that this process has written to the shared folder, or only the one that `of` reads; results that still read them are then void."""
    jvm = spark.sparkContext._jvm
    files = None if of is None else of.inputFiles()
    for p in list(_PATHS):
        if files is None or any(f"/{p.rsplit('/', 1)[1]}/" in f for f in files):
            path = jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
            _PATHS.remove(p)


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` written as Parquet in the shared folder and read back, so that it is computed once."""
    path = new_table_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def side_by_side(tasks: Sequence[Callable[[], T]]) -> list[T]:
    """The results of tasks that don't depend on each other: their plans are made, and their jobs run, at the same time."""
    with ThreadPoolExecutor(max(1, len(tasks))) as pool:
        return list(pool.map(lambda task: task(), tasks))
