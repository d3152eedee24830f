"""Each metric against its own history and against its peers.

Ratio rows are unique per (ticker, date), so per-ticker windows and arrays are limited by the
calendar: ten years hold at most 3,653 sessions. Peer groups have no such limit and go through
`ranking.group_upper_median`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions.scalars import (
    GRID_MIN_ROWS, GRID_MIN_YEARS, WINDOW_YEARS, range_position, years_before)
from tidemark.operators.asof import latest_by
from tidemark.operators.ranking import group_upper_median
from tidemark.registry import METRICS


def to_long(rows: DataFrame, metrics: list[str] | None = None, keep: list[str] | None = None,
            nulls: bool = False) -> DataFrame:
    """(ticker, date, metric_key, value) per known value. Partitioning by ticker survives."""
    entries = [F.struct(F.lit(m).alias("metric_key"), F.col(m).alias("value"))
               for m in metrics or METRICS]
    long = rows.select(*(keep or ["ticker", "date"]), F.inline(F.array(*entries)))
    return long if nulls else long.where("value IS NOT NULL")


def metric_by_key(key: Column, metrics: list[str] | None = None) -> Column:
    """Value of the metric column named by `key`; null for an unknown name."""
    chain = F.when(F.lit(False), F.lit(None).cast("double"))
    for m in metrics or METRICS:
        chain = chain.when(key == m, F.col(m))
    return chain


def latest_value(rows: DataFrame, metrics: list[str] | None = None) -> DataFrame:
    """Newest known (date, value) per ticker and metric. Rows stay wide until they are one per ticker."""
    newest = {m: F.max(F.when(F.col(m).isNotNull(), F.struct("date", F.col(m).alias("value")))) for m in metrics or METRICS}
    found = rows.groupBy("ticker").agg(*[c.alias(m) for m, c in newest.items()])
    entries = [F.struct(F.lit(m).alias("metric_key"), F.col(m).alias("l")) for m in newest]
    return found.select("ticker", F.inline(F.array(*entries))).where("l IS NOT NULL").select(
        "ticker", "metric_key", "l.date", "l.value")


def history_aggregates(value: Column, latest: Column, date: Column) -> dict[str, Column]:
    """Aggregates of the trailing window ending at `latest` (struct of date and value)."""
    inside = value.isNotNull() & (date >= years_before(latest["date"], WINDOW_YEARS))
    kept = F.when(inside, value)
    return {
        "n": F.count(kept),
        "below": F.count_if(inside & (value <= latest["value"])),
        "low": F.min(kept),
        "high": F.max(kept),
        "first_date": F.min(F.when(inside, date)),
        "sorted_values": F.sort_array(F.collect_list(kept)),
    }


def history_stats() -> dict[str, Column]:
    """Percentile, upper median, span and sufficiency from `history_aggregates`."""
    years = F.datediff("date", "first_date") / F.lit(365.25)
    median = F.get("sorted_values", F.floor(F.col("n") / 2).cast("int"))
    low, high = F.col("low"), F.col("high")
    return {
        "percentile": F.when(F.col("n") > 0, F.col("below") / F.col("n") * 100),
        "median": median,
        "low": low,
        "high": high,
        "years": years,
        "sufficient": (years >= GRID_MIN_YEARS) & (F.col("n") > GRID_MIN_ROWS),
        "position": range_position(F.col("value"), low, high),
        "median_position": F.when(high - low > 0, (median - low) / (high - low) * 100),
    }


def _trailing_points(history: Column, metrics: list[str]) -> Column:
    """Array of (metric_key, latest, inside): each metric's newest known point, and its points of the ten years up to it."""
    def points(m: str) -> Column:
        return F.filter(F.transform(history, lambda x: F.struct(x["date"].alias("date"), x[m].alias("value"))),
                        lambda p: p["value"].isNotNull())

    known = F.array(*[F.struct(F.lit(m).alias("metric_key"), points(m).alias("points")) for m in metrics])
    dated = F.transform(known, lambda k: F.struct(
        k["metric_key"].alias("metric_key"), k["points"].alias("points"), F.array_max(k["points"]).alias("latest")))
    bounded = F.transform(F.filter(dated, lambda k: k["latest"].isNotNull()), lambda k: F.struct(
        k["metric_key"].alias("metric_key"), k["points"].alias("points"), k["latest"].alias("latest"),
        years_before(k["latest"]["date"], WINDOW_YEARS).alias("since")))
    return F.transform(bounded, lambda k: F.struct(
        k["metric_key"].alias("metric_key"), k["latest"].alias("latest"),
        F.filter(k["points"], lambda p: p["date"] >= k["since"]).alias("inside")))


def metric_stats(rows: DataFrame, metrics: list[str] | None = None) -> DataFrame:
    """One row per (ticker, metric): latest value placed in its trailing ten years.

    `is_current` tells whether the value is from the ticker's newest session. Rows stay wide until a ticker's
    sessions are one array, so no sort or shuffle sees a row per session and metric.
    """
    names = list(metrics or METRICS)
    histories = rows.groupBy("ticker").agg(
        F.collect_list(F.struct("date", *names)).alias("history"), F.max("date").alias("newest"))
    placed = histories.select("ticker", "newest", F.inline(_trailing_points(F.col("history"), names)))
    flat = placed.select(
        "ticker", "metric_key", "latest.date", "latest.value", F.size("inside").cast("long").alias("n"),
        F.size(F.filter("inside", lambda p: p["value"] <= F.col("latest.value"))).cast("long").alias("below"),
        F.array_min("inside.value").alias("low"), F.array_max("inside.value").alias("high"),
        F.array_min("inside.date").alias("first_date"), F.sort_array("inside.value").alias("sorted_values"),
        (F.col("latest.date") == F.col("newest")).alias("is_current"))
    return flat.select("ticker", "metric_key", "date", "value", "n", "is_current",
                       *[c.alias(k) for k, c in history_stats().items()])


def upper_median(rows: DataFrame, metrics: list[str] | None = None) -> DataFrame:
    """Upper median over the whole history, per ticker and metric; a ticker's sessions are limited by the calendar."""
    names = list(metrics or METRICS)
    found = rows.where("ticker IS NOT NULL").groupBy("ticker").agg(*[F.collect_list(m).alias(m) for m in names])
    entries = [F.struct(F.lit(m).alias("metric_key"), F.col(m).alias("known")) for m in names]
    return found.select("ticker", F.inline(F.array(*entries))).where("size(known) > 0").select(
        "ticker", "metric_key",
        F.get(F.sort_array("known"), F.floor(F.size("known") / 2).cast("int")).alias("median"))


def latest_snapshot(rows: DataFrame) -> DataFrame:
    """The newest row of each ticker."""
    return latest_by(rows, ["ticker"], ["date"])


def peer_median(current: DataFrame, groups: DataFrame) -> DataFrame:
    """Upper median over the members of a group; `current` holds each ticker's
    (ticker, metric_key, value) on its own newest session."""
    members = current.join(groups.select("ticker", "group_id"), "ticker")
    return group_upper_median(members, ["group_id", "metric_key"], "value", "group_median")
