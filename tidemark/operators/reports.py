"""Status and verification reports over the engine tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions.scalars import ANNUAL_DAYS
from tidemark.operators.distribution import to_long

STALE_HOURS = 72
RESTATED_BY = 0.05
COVERAGE_METRICS = [
    "pe_ttm", "ev_ebitda", "ev_sales", "fcf_yield", "gross_margin", "operating_margin", "roic",
    "net_debt_ebitda", "revenue_growth_yoy",
]


def run_freshness(runs: DataFrame, now: Column) -> DataFrame:
    """Newest run by id, hours since it ended (or started), and whether it is stale."""
    newest = runs.agg(F.max_by(F.struct("run_id", "started_at", "finished_at", "status"),
                               "run_id").alias("r")).select("r.*")
    micros = F.expr("timestampdiff(MICROSECOND, coalesce(finished_at, started_at), _now)")
    return (
        newest.withColumn("_now", now)
        .withColumn("hours_ago", micros / F.lit(3_600_000_000.0)).drop("_now")
        .withColumn("stale", (F.col("hours_ago") > STALE_HOURS)
                    | F.col("status").isin("error", "running")))


def metric_coverage(rows: DataFrame, metrics: list[str] | None = None) -> DataFrame:
    """Percent of a ticker's sessions with a value, per metric. Counts first, unpivots after."""
    names = metrics or COVERAGE_METRICS
    counted = rows.groupBy("ticker").agg(
        F.count(F.lit(1)).alias("_n"), *[F.count(m).alias(m) for m in names])
    return to_long(counted, names, ["ticker", "_n"], nulls=True).select(
        "ticker", "metric_key", (F.col("value") * 100 / F.col("_n")).alias("coverage_pct"))


def load_status(watchlist: DataFrame, facts: DataFrame, prices: DataFrame, rows: DataFrame) -> DataFrame:
    """Loaded row counts and the covered period per watched ticker."""
    f = facts.groupBy("ticker").agg(
        F.count(F.lit(1)).alias("facts"), F.min("period_end").alias("first_period"),
        F.max("period_end").alias("last_period"))
    p = prices.groupBy("ticker").agg(F.count(F.lit(1)).alias("prices"))
    r = rows.groupBy("ticker").agg(F.count(F.lit(1)).alias("ratios"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return (
        watchlist.select("ticker", "supported")
        .join(f, "ticker", "left").join(p, "ticker", "left").join(r, "ticker", "left")
        .select("ticker", "supported", zero("facts"), zero("prices"), zero("ratios"),
                "first_period", "last_period"))


def annual_series(facts: DataFrame, newest: int | None = None) -> DataFrame:
    """First-filed annual value of each period; the newest periods per concept, if a number is given."""
    first = (
        facts.where(F.col("duration_days").between(*ANNUAL_DAYS))
        .groupBy("ticker", "concept", "period_end")
        .agg(F.min_by(F.struct("value", "filed_at", "form"), F.struct("filed_at", "accession")).alias("f")))
    rank = F.row_number().over(Window.partitionBy("ticker", "concept").orderBy(F.desc("period_end")))
    kept = first if newest is None else first.withColumn("rn", rank).where(F.col("rn") <= newest)
    return kept.select(
        "ticker", "concept", "period_end", "f.value", F.col("f.filed_at").alias("first_filed"), "f.form")


def fact_versions(facts: DataFrame, days: tuple[int, int] = ANNUAL_DAYS) -> DataFrame:
    """Every filed version of each period, numbered by filing date."""
    order = Window.partitionBy("ticker", "concept", "period_end").orderBy("filed_at", "accession", "duration_days")
    return facts.where(F.col("duration_days").between(*days)).select(
        "ticker", "concept", "period_end", "duration_days", "value", "filed_at", "accession", "form",
        F.row_number().over(order).alias("version"))


def restatements(facts: DataFrame, days: tuple[int, int] = ANNUAL_DAYS) -> DataFrame:
    """First against last filed version of each period; flagged when they differ by over 5 %."""
    agg = facts.where(F.col("duration_days").between(*days)).groupBy(
        "ticker", "concept", "period_end").agg(
        F.count(F.lit(1)).alias("versions"),
        F.min_by("value", F.struct("filed_at", "accession")).alias("first_value"),
        F.max_by("value", F.struct("filed_at", "accession")).alias("last_value"))
    usable = (F.col("versions") > 1) & (F.col("first_value") != 0) & (F.col("last_value") != 0)
    ratio = F.when(usable, F.col("last_value") / F.col("first_value"))
    return agg.withColumn("ratio", ratio).withColumn(
        "restated", F.coalesce(F.abs(F.col("ratio") - 1) > RESTATED_BY, F.lit(False)))


def group_summary(groups: DataFrame, group_metrics: DataFrame, stock_groups: DataFrame) -> DataFrame:
    """Group with its metric and member counts, one row per member.

    Members stay rows: a text of all members would hold a whole group in one cell.
    """
    m = group_metrics.groupBy("group_id").agg(F.count(F.lit(1)).alias("n_metrics"))
    s = stock_groups.groupBy("group_id").agg(F.count(F.lit(1)).alias("n_members"))
    return (groups.join(m, "group_id", "left").join(s, "group_id", "left")
            .join(stock_groups.select("group_id", F.col("ticker").alias("member")), "group_id", "left")
            .select("group_id", "name", "primary_multiple",
                    F.coalesce("n_metrics", F.lit(0)).alias("n_metrics"),
                    F.coalesce("n_members", F.lit(0)).alias("n_members"), "member"))
