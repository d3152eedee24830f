"""The record of a run: running, then ok, partial, skipped or error, with counts observed on the run's own writes."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from tidemark.session import new_path
from tidemark.sources.sinks import read_table, upsert_by_key

RUNS = ("run_id int, started_at timestamp_ntz, finished_at timestamp_ntz, status string, tickers long, redone long, "
        "new_price_rows long, failures long, detail string")
#: Runs are few: their records share one bucket.
RUN_BUCKETS = 1


def _put(spark: SparkSession, root: str, run: tuple) -> None:
    upsert_by_key(spark.createDataFrame([run], RUNS), f"{root}/runs", new_path(spark, "run"), ["run_id"], key="run_id",
                  buckets=RUN_BUCKETS)


def record_run(root: str, run_id: int, changes: DataFrame, failures: DataFrame, stage: Callable[[DataFrame], None],
               clock: Callable[[], datetime]) -> str:
    """Run `stage` on the companies that changed and record it; the run's status.

    `changes` is what `change_detect` returns, `failures` (ticker, reason) one row per lost company. Both are written as
    rows of the run, and the counts are observed on these writes: no pass of their own, and no list in a cell. The
    record says running until the end, error if a step raises (the exception goes on), skipped if nothing changed,
    partial if companies were lost. Running the same number again replaces its record and rows.
    """
    spark, started = changes.sparkSession, clock()
    _put(spark, root, (run_id, started, None, "running", None, None, None, None, None))
    try:
        seen, lost = Observation(f"changes-{run_id}"), Observation(f"failures-{run_id}")
        changes.observe(seen, F.count(F.lit(1)).alias("tickers"), F.count_if("derive").alias("redone"),
                        F.sum("new_rows").alias("rows")).write.mode("overwrite").parquet(f"{root}/changes/run={run_id}")
        failures.select("ticker", "reason").observe(lost, F.count(F.lit(1)).alias("failures")).write.mode("overwrite").parquet(
            f"{root}/failures/run={run_id}")
        counts, failed = seen.get, lost.get["failures"]
        if counts["redone"]:
            stage(spark.read.schema(changes.schema).parquet(f"{root}/changes/run={run_id}").where("derive"))
    except Exception as error:
        _put(spark, root, (run_id, started, clock(), "error", None, None, None, None, f"{type(error).__name__}: {error}"[:500]))
        raise
    status = "partial" if failed else "ok" if counts["redone"] else "skipped"
    _put(spark, root, (run_id, started, clock(), status, counts["tickers"], counts["redone"], counts["rows"] or 0, failed, None))
    return status


def run_records(spark: SparkSession, root: str) -> DataFrame:
    return read_table(spark, f"{root}/runs").drop("bucket")


def run_failures(spark: SparkSession, root: str) -> DataFrame:
    """(run, ticker, reason) of all runs."""
    return spark.read.schema("ticker string, reason string, run int").parquet(f"{root}/failures")
