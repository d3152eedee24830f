"""Shared helpers of the text operators: tables, folds, bounded samples, written intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_ROWS = 256
#: A sample is drawn by comparing a text's hash with a threshold out of this many.
_HASH_RANGE = 1 << 30


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that `spark.checkpoint.dir` names; in local mode a temporary one where it is unset (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors see")
        folder = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """`df` as a Parquet table in the shared folder: lineage ends there, and lost executors take nothing along."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tidemark-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bound_batches(df: DataFrame) -> DataFrame:
    """`df`; Python workers of its session get at most `BATCH_ROWS` texts at once from now on.

    Spark's default of ten thousand rows is meant for numbers; so many long texts fill a worker's memory.
    """
    key, conf = "spark.sql.execution.arrow.maxRecordsPerBatch", df.sparkSession.conf
    if not 0 < int(conf.get(key)) <= BATCH_ROWS:
        conf.set(key, str(BATCH_ROWS))
    return df


def held_out(doc_id: Column) -> Column:
    """True for the third of the documents that no model may learn from; null ids count as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(True))


def bounded_sample(df: DataFrame, rows: int, text: str = "text") -> DataFrame:
    """At most `rows` different texts of `df`, chosen by the hash of the text.

    The threshold follows the row count, so the sort sees about `rows` rows and not the table.
    """
    total = df.count()
    share = min(1.0, 1.2 * rows / max(total, 1))
    mark = F.xxhash64(text)
    kept = df.where(F.pmod(mark, F.lit(_HASH_RANGE)) < int(share * _HASH_RANGE)) if share < 1 else df
    others = [c for c in df.columns if c != text]
    if others:  # one row per text; the smallest of its other values, so that the choice is fixed
        kept = kept.groupBy(text).agg(F.min(F.struct(*others)).alias("_o")).select(text, "_o.*")
    else:
        kept = kept.distinct()
    return kept.orderBy(F.xxhash64(text), text).limit(rows)


class Memory:
    """A bounded dictionary of two generations: what is asked for again outlives the older one's end."""

    def __init__(self, size: int) -> None:
        self.size, self.new, self.old = size, {}, {}

    def recall(self, keys: set) -> list:
        """Makes known keys recent; returns the others."""
        if len(self.new) > self.size:
            self.new, self.old = {}, self.new
        new, old, unknown = self.new, self.old, []
        for key in keys.difference(new):
            found = old.get(key)
            if found is None:
                unknown.append(key)
            else:
                new[key] = found
        return unknown


def by_rows(frames: Iterable[pd.DataFrame], rows: int = 512) -> Iterator[pd.DataFrame]:
    """The same rows in smaller frames, so that results of long texts never pile up."""
    for frame in frames:
        for start in range(0, len(frame), rows):
            yield frame.iloc[start:start + rows]
