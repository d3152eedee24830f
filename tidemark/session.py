"""Session helpers for tests and the benchmark; a cluster brings its own session."""

from __future__ import annotations

import tempfile
import uuid

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from tidemark.sources.sinks import delete_path

#: Whether shuffle files go when the statement that wrote them ends, and not when the driver happens to collect garbage.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cpus: int | str = 8, app: str = "tidemark", memory: str = "16g",
                  partitions: int = 8) -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cpus}]").appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        # Local tables are a few megabytes: keep all cores busy instead of merging them away.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "16k")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str | None:
    """The cluster's shared checkpoint folder; `fallback` only where none is named."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    target = named or fallback
    if target and not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(target)
    return target


def shared_folder(spark: SparkSession) -> str:
    """The folder that all machines see; in local mode a temporary one where none is named."""
    root = checkpoint_dir(spark) or spark.sparkContext.getCheckpointDir()
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors see")
        root = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def new_path(spark: SparkSession, name: str = "staged") -> str:
    """A path of its own in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame) -> DataFrame:
    """`df` written as a table to the shared folder and read back.

    For results that a plan reads several times: lineage ends there.
    """
    path = new_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Staged tables of one job, each dropped once nothing reads it any more."""

    def __init__(self, spark: SparkSession) -> None:
        self._spark, self._paths = spark, {}

    def stage(self, name: str, df: DataFrame) -> DataFrame:
        self._paths[name] = new_path(self._spark)
        df.write.parquet(self._paths[name])
        return self._spark.read.schema(df.schema).parquet(self._paths[name])

    def drop(self, *names: str) -> None:
        for name in names:
            delete_path(self._spark, self._paths.pop(name))

    def drop_all(self) -> None:
        self.drop(*list(self._paths))


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Scratch]:
    """A `Scratch` that is empty at the end; meanwhile no statement leaves its shuffle files behind."""
    before, tables = spark.conf.get(SHUFFLE_CLEANUP), Scratch(spark)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield tables
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
        tables.drop_all()
