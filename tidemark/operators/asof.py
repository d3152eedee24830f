"""Generic point-in-time operators: keyed latest version, backward as-of attach, lookback."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def latest_by(df: DataFrame, keys: list[str], order: list, columns: list[str] | None = None) -> DataFrame:
    """One row per key, the greatest in `order`.

    An aggregate rather than a ranked window: copies of a key collapse map-side, so a key
    with a third of all rows costs one row per map task in the shuffle.
    """
    payload = columns or [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*payload), F.struct(*order))
    return df.groupBy(*keys).agg(best.alias("_row")).select(*keys, "_row.*")


def visible_asof(facts: DataFrame, grid: DataFrame) -> DataFrame:
    """Version of every fact period that was public at each grid date.

    `grid` is (ticker, as_of). Same-day versions are settled first (lowest accession), so
    no validity interval has zero length; the join then meets each as-of date with exactly
    one version per period.
    """
    keys = ["ticker", "concept", "period_start", "period_end", "duration_days"]
    versions = facts.groupBy(*keys, "filed_at").agg(
        F.min_by("value", "accession").alias("value"), F.min("accession").alias("accession"))
    span = Window.partitionBy(*keys).orderBy("filed_at")
    valid = versions.withColumn("valid_to", F.lead("filed_at").over(span)).alias("v")
    return (
        valid.join(grid.alias("g"), F.expr(
            "v.ticker = g.ticker AND v.filed_at <= g.as_of "
            "AND (v.valid_to IS NULL OR g.as_of < v.valid_to)"))
        .select("v.ticker", "g.as_of", "v.concept", "v.period_start", "v.period_end",
                "v.duration_days", "v.filed_at", "v.accession", "v.value")
    )


def asof_attach(days: DataFrame, states: DataFrame, key: str = "ticker",
                day_col: str = "date", state_time: str = "as_of") -> DataFrame:
    """Attach to each day the last state with `as_of` <= day; days before the first are dropped.

    Both sides are unique per (key, time), so a partition of the window holds at most two
    rows per calendar day whatever the size of the raw data. One shuffle by key, no join.
    """
    payload = [c for c in states.columns if c != key]
    day_payload = [c for c in days.columns if c not in (key, day_col)]
    left = days.select(
        key, F.unix_date(day_col).alias("_t"), F.lit(1).alias("_side"), F.col(day_col),
        *day_payload, F.lit(None).cast(states.select(F.struct(*payload)).schema[0].dataType)
        .alias("_state"))
    right = states.select(
        key, F.unix_date(state_time).alias("_t"), F.lit(0).alias("_side"),
        F.lit(None).cast("date").alias(day_col),
        *[F.lit(None).cast(days.schema[c].dataType).alias(c) for c in day_payload],
        F.struct(*payload).alias("_state"))
    w = (Window.partitionBy(key).orderBy("_t", "_side")
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (
        left.unionByName(right)
        .withColumn("_state", F.last("_state", ignorenulls=True).over(w))
        .where("_side = 1 AND _state IS NOT NULL")
        .select(key, day_col, "_t", *day_payload, "_state.*")
    )


def value_days_back(df: DataFrame, value: str, days: int, out: str, key: str = "ticker",
                    day_col: str = "_t") -> DataFrame:
    """`value` on the row at, or last before, `days` earlier; null if there is none."""
    w = (Window.partitionBy(key).orderBy(day_col)
         .rangeBetween(Window.unboundedPreceding, -days))
    return df.withColumn(out, F.last(value).over(w))
