"""Session helpers: local test sessions, the shared work folder, small-source spreading."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
# Of staged tables and collections: texts and their tokens take about half the room they take with snappy.
COMPRESSION = "zstd"
# Shuffle files of a query that ends in a table are not needed after it.
CLEANUP = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


def local_session(cores: int | str = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and the benchmark; a cluster brings its own."""
    # One numpy thread per Spark task, as a cluster manager sets it.
    os.environ.setdefault("OMP_NUM_THREADS", "1")
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("pagewell")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


_local_base: dict[str, str] = {}


def work_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder below the shared folder the cluster names.

    Only a local session, whose executors are this machine, may fall back to a
    temporary folder; on a cluster an unset folder is an error.
    """
    base = spark.conf.get(CHECKPOINT_CONF, None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_CONF} to a folder all executors can reach")
        base = _local_base.setdefault(
            spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="pagewell-")
        )
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex[:12]}"


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings for the block; those before are put back."""
    before = {key: spark.conf.get(key, None) for key in values}
    for key, value in values.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


_scratch: list[list[tuple[SparkSession, str]]] = []


@contextmanager
def scratch() -> Iterator[Callable[..., DataFrame]]:
    """Tables that `stored` makes inside are removed at the end; results must be written by then.

    Gives a `stored` for results, whose tables last until the end of the block around this one.
    """
    depth = len(_scratch)
    _scratch.append([])

    def lasting(df: DataFrame, label: str, spark: SparkSession | None = None) -> DataFrame:
        return stored(df, label, spark, depth)

    try:
        yield lasting
    finally:
        for spark, place in _scratch.pop():
            remove_folder(spark, place)


def remove_folder(spark: SparkSession, place: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def is_folder(spark: SparkSession, place: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(path) and fs.getFileStatus(path).isDirectory()


def stored(
    df: DataFrame, label: str, spark: SparkSession | None = None, depth: int | None = None, by: tuple[str, ...] = ()
) -> DataFrame:
    """A result that is used several times, written once to the shared folder, in folders by the values of ``by``.

    ``spark`` reads it back; a micro-batch has a session of its own, whose writes
    to a table another session would not notice.
    """
    spark = spark or df.sparkSession
    place = work_dir(spark, label)
    with settings(df.sparkSession, CLEANUP):
        df.write.option("compression", COMPRESSION).partitionBy(*by).parquet(place)
    if open_blocks := _scratch[:depth]:
        open_blocks[-1].append((spark, place))
    return spark.read.schema(df.schema).parquet(place)


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers, once per application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    target = tempfile.mkdtemp(prefix="pagewell-zip-")
    archive = shutil.make_archive(
        os.path.join(target, "pagewell"), "zip", os.path.dirname(package), os.path.basename(package)
    )
    spark.sparkContext.addPyFile(archive)
    _shipped.add(app)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Use all cores on a source that has fewer input splits than cores.

    A source with enough splits is returned as it is, so a large table is never
    shuffled here. Call it directly on a scan.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, *keys)
