"""Tables written to the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import threading
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the one the cluster names in spark.checkpoint.dir; only where that is unset and
    driver and executors are one machine (a local master) a temporary folder takes its place.
    """
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        place = "file://" + tempfile.mkdtemp(prefix="loomgraph-")
        spark.conf.set("spark.checkpoint.dir", place)
    return place.rstrip("/")


class _Scopes(threading.local):
    """Paths made within each scratch() that is open in a thread, the innermost last."""

    def __init__(self) -> None:
        self.open: list[list[str]] = []


_scopes = _Scopes()


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder, removed at the end of the scratch() around, and at
    the latest when the driver ends."""
    path = f"{shared_dir(spark)}/loomgraph-{name}-{uuid.uuid4().hex}"
    atexit.register(drop_path, spark, path)
    if _scopes.open:
        _scopes.open[-1].append(path)
    return path


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that this thread writes within are removed at its end: by then what reads them must be
    written to a path made outside."""
    _scopes.open.append([])
    try:
        yield
    finally:
        for path in _scopes.open.pop():
            drop_path(spark, path)


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Jobs within lose their shuffle files when they end, not when the driver collects its garbage:
    what they make is to be written or collected, and not run again."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def drop_path(spark: SparkSession, path: str) -> None:
    """Deletes a written table or archive; a session that has ended is left alone."""
    with contextlib.suppress(Exception):
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back.

    This cuts the lineage (a lost executor costs no recomputation of what came
    before) and gives the planner the table's true size.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, name: str) -> DataFrame:
    """Like written(), dealt to as many buckets by key as there are shuffle partitions, so that
    a join on the key needs no shuffle of this side."""
    spark = df.sparkSession
    path, table = fresh_path(spark, name), f"loomgraph_{name}_{uuid.uuid4().hex}"
    atexit.register(_drop_table, spark, table)
    df.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), key).option("path", path).saveAsTable(table, format="parquet")
    return spark.table(table)


def _drop_table(spark: SparkSession, table: str) -> None:
    with contextlib.suppress(Exception):
        spark.sql(f"DROP TABLE IF EXISTS {table}")
