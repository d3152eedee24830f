"""Watchlist grid, stock detail and the signals shown in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions.scalars import WINDOW_YEARS, range_position, years_before
from tidemark.operators.distribution import (
    history_aggregates, history_stats, metric_by_key, metric_stats, peer_median)
from tidemark.operators.ranking import global_rank, group_upper_median, rank_within
from tidemark.session import staged
from tidemark.registry import METRICS, PRIMARY, SECTIONS

FLAG_LOOKBACK_YEARS = 1
DEFAULT_PRIMARY = "pe_ttm"
# Thresholds of the attention flags.
MARGIN_DROP, DILUTION, INVENTORY_RISE, SLOW_GROWTH = 0.02, 1.02, 1.15, 0.1
HIGH_PERCENTILE, LOW_PERCENTILE = 95, 5
SAMPLE_EVERY = 5


def day_change(rows: DataFrame) -> DataFrame:
    """Newest close of each ticker against the session before."""
    prev = F.lag("close").over(Window.partitionBy("ticker").orderBy("date"))
    pair = rows.withColumn("prev_close", prev).groupBy("ticker").agg(
        F.max_by(F.struct("date", "close", "prev_close"), "date").alias("l"))
    return pair.select("ticker", "l.date", "l.close", _change("l").alias("change_pct"))


def _change(row: str) -> Column:
    close, prev = F.col(f"{row}.close"), F.col(f"{row}.prev_close")
    return F.when((close != 0) & (prev != 0), close / prev - 1)


def range_52w(prices: DataFrame, latest: DataFrame) -> DataFrame:
    """Low and high close of the year up to each ticker's newest row, and the place in it.

    `latest` is (ticker, date, close), one row per ticker.
    """
    own = latest.select("ticker", F.col("date").alias("latest_date"), F.col("close").alias("latest_close"))
    year = prices.join(own, "ticker").where(F.col("date") >= years_before(F.col("latest_date"), 1))
    agg = year.groupBy("ticker").agg(
        F.max("latest_date").alias("date"), F.max("latest_close").alias("close"),
        F.min("close").alias("low_52w"), F.max("close").alias("high_52w"))
    place = F.when(F.col("high_52w") > F.col("low_52w"),
                   range_position(F.col("close"), F.col("low_52w"), F.col("high_52w")))
    return agg.withColumn("position", place)


def active_group(watchlist: DataFrame, stock_groups: DataFrame, groups: DataFrame,
                 requested: DataFrame | None = None) -> DataFrame:
    """(ticker, group_id, group_name, primary_key): the requested group if a member, else the
    default if a member, else the lowest id; the leading multiple falls back to P/E."""
    member = stock_groups.join(groups, "group_id")
    wish = watchlist.select("ticker", "default_group_id")
    if requested is not None:
        wish = wish.join(requested.select("ticker", "requested_group_id"), "ticker", "left")
    else:
        wish = wish.withColumn("requested_group_id", F.lit(None).cast("int"))
    is_wish = lambda c: F.coalesce((F.col("group_id") == F.col(c)).cast("int"), F.lit(0))
    choice = F.struct(is_wish("requested_group_id").alias("r"), is_wish("default_group_id").alias("d"),
                      (-F.col("group_id")).alias("i"))
    best = wish.join(member, "ticker", "left").groupBy("ticker").agg(
        F.max_by(F.struct("group_id", "name", "primary_multiple"),
                 F.when(F.col("group_id").isNotNull(), choice)).alias("g"))
    return best.select(
        "ticker", "g.group_id", F.col("g.name").alias("group_name"),
        F.coalesce("g.primary_multiple", F.lit(DEFAULT_PRIMARY)).alias("primary_key"))


def _flag_columns() -> list[Column]:
    """The flags shown for a row; their names are fixed."""
    now, then = (lambda c: F.col(f"latest.{c}")), (lambda c: F.col(f"prior.{c}"))
    slow = F.coalesce(now("revenue_growth_yoy"), F.lit(1.0)) < SLOW_GROWTH
    return [
        F.when(now("operating_margin") < then("operating_margin") - MARGIN_DROP, "margin compressing"),
        F.when(now("shares_diluted") > then("shares_diluted") * DILUTION, "dilution"),
        F.when((now("inventory_days") > then("inventory_days") * INVENTORY_RISE) & slow,
               "inventory building"),
        F.when(F.col("sufficient") & (F.col("percentile") >= HIGH_PERCENTILE), "multiple at high"),
        F.when(F.col("sufficient") & (F.col("percentile") <= LOW_PERCENTILE), "multiple at low"),
    ]


def grid_rows(rows: DataFrame, active: DataFrame) -> DataFrame:
    """One row per ticker of `active`: newest session, day change, statistics of the leading
    multiple and flags. A single pass over the ratio rows, aggregated once by ticker."""
    joined = rows.join(active, "ticker").withColumn("pv", metric_by_key(F.col("primary_key")))
    w = Window.partitionBy("ticker")
    windowed = joined.withColumns({
        "prev_close": F.lag("close").over(w.orderBy("date")),
        "newest": F.max("date").over(w),
        "pl": F.max(F.when(F.col("pv").isNotNull(), F.struct("date", F.col("pv").alias("value")))).over(w),
    })
    cutoff = years_before(F.col("newest"), FLAG_LOOKBACK_YEARS)
    picked = ["date", "close", "prev_close", "market_cap", "enterprise_value", *METRICS]
    prior = F.struct("operating_margin", "shares_diluted", "inventory_days")
    agg = windowed.groupBy("ticker").agg(
        F.first("group_id").alias("group_id"), F.first("group_name").alias("group_name"),
        F.first("primary_key").alias("primary_key"),
        F.max_by(F.struct(*picked), "date").alias("latest"),
        F.max_by(prior, F.when(F.col("date") <= cutoff, F.col("date"))).alias("prior"),
        F.max("pl").alias("pl"),
        *[c.alias(k) for k, c in history_aggregates(F.col("pv"), F.col("pl"), F.col("date")).items()])
    stats = agg.withColumns({"date": F.col("pl.date"), "value": F.col("pl.value")})
    named = stats.select(
        "ticker", "group_id", "group_name", "primary_key", "latest", "prior",
        F.col("value").alias("multiple"), *[c.alias(k) for k, c in history_stats().items()])
    return named.select(
        "ticker", "group_id", "group_name", "primary_key", F.col("latest.date").alias("date"),
        F.col("latest.close").alias("close"), _change("latest").alias("change_pct"),
        F.col("latest.market_cap").alias("market_cap"),
        F.col("latest.revenue_growth_yoy").alias("revenue_growth_yoy"),
        "multiple", "percentile", "median", "low", "high", "years",
        F.coalesce("sufficient", F.lit(False)).alias("sufficient"),
        F.array_join(F.array_compact(F.array(*_flag_columns())), ", ").alias("flags"),
        F.size(F.array_compact(F.array(*_flag_columns()))).alias("n_flags"), "latest")


def watchlist_grid(rows: DataFrame, watchlist: DataFrame, stock_groups: DataFrame,
                   groups: DataFrame) -> DataFrame:
    """The grid of supported tickers, cheapest against own history first (`grid_rank`)."""
    active = active_group(watchlist, stock_groups, groups)
    # Members outside the supported list still count as peers, so every ticker is aggregated.
    base = staged(grid_rows(rows, active))
    peers = (
        stock_groups.join(groups, "group_id").join(base.select("ticker", "latest.*"), "ticker")
        .select("group_id", metric_by_key(F.col("primary_multiple")).alias("value")))
    medians = group_upper_median(peers, ["group_id"], "value", "group_median")
    # A ticker's groups are at most all configured groups.
    memberships = stock_groups.join(groups.select("group_id", F.col("name").alias("_name")), "group_id").groupBy("ticker").agg(
        F.array_join(F.sort_array(F.collect_set("_name")), ", ").alias("groups"))
    labels = F.create_map(*[x for k, v in METRICS.items() for x in (F.lit(k), F.lit(v[0]))])
    shown = (
        base.drop("latest")
        .join(watchlist.where("supported").select("ticker", "name"), "ticker")
        .join(medians, "group_id", "left").join(memberships, "ticker", "left")
        .withColumn("primary_label", F.coalesce(labels[F.col("primary_key")], F.col("primary_key"))))
    return global_rank(shown, [F.col("percentile").asc_nulls_last(), F.col("ticker")], "grid_rank")


GRID_SORTS = {
    "ticker": (lambda: F.col("ticker"), "asc"),
    "change_pct": (lambda: F.col("change_pct"), "desc"),
    "multiple": (lambda: F.col("multiple"), "asc"),
    "percentile": (lambda: F.when(F.col("sufficient"), F.col("percentile")), "asc"),
    "revenue_growth_yoy": (lambda: F.col("revenue_growth_yoy"), "desc"),
    "flags": (lambda: F.col("n_flags"), "desc"),
}


def grid_sorted(grid: DataFrame, column: str = "percentile", direction: str | None = None) -> DataFrame:
    """Grid in group sections ordered by a column; missing values last in both directions."""
    value, initial = GRID_SORTS[column]
    key = value().asc_nulls_last() if (direction or initial) == "asc" else value().desc_nulls_last()
    labelled = grid.withColumn("section", F.coalesce("group_name", F.lit("Ungrouped")))
    return rank_within(labelled, "section", [key, F.col("ticker")], "sort_rank")


def section_profile(rows: DataFrame, active: DataFrame, stock_groups: DataFrame,
                    group_metrics: DataFrame) -> DataFrame:
    """Metrics of a ticker's active group by section, with own-history and peer statistics."""
    stats = staged(metric_stats(rows))
    medians = peer_median(stats.where("is_current"), stock_groups)
    order = F.array_position(F.array(*[F.lit(s) for s in SECTIONS]), F.col("section")).cast("int")
    return (
        active.where("group_id IS NOT NULL").join(group_metrics, "group_id")
        .join(stats, ["ticker", "metric_key"], "left")
        .join(medians, ["group_id", "metric_key"], "left")
        .select("ticker", "group_id", "section", order.alias("section_order"), "sort_order",
                "metric_key", "value", "percentile", "median", "low", "high", "years",
                F.coalesce("sufficient", F.lit(False)).alias("sufficient"), "group_median"))


def sampled_series(rows: DataFrame, columns: list[str], every: int = SAMPLE_EVERY) -> DataFrame:
    """Every fifth session of the trailing ten years, counted from the first."""
    w = Window.partitionBy("ticker")
    recent = rows.withColumn("newest", F.max("date").over(w)).where(
        F.col("date") >= years_before(F.col("newest"), WINDOW_YEARS))
    numbered = recent.withColumn("rn", F.row_number().over(w.orderBy("date")))
    return numbered.where((F.col("rn") - 1) % every == 0).select("ticker", "date", *columns)


def added_price(watchlist: DataFrame, latest: DataFrame) -> DataFrame:
    """Fill a missing added price with the newest close; a set one is never overwritten."""
    newest = latest.select("ticker", F.col("close").alias("_close"))
    return (watchlist.join(newest, "ticker", "left")
            .withColumn("added_price", F.coalesce("added_price", "_close")).drop("_close"))


def resolved_primary(watchlist: DataFrame, groups: DataFrame) -> DataFrame:
    """(ticker, primary_key) by default group only, as rules resolve `__primary__`."""
    g = groups.select(F.col("group_id").alias("default_group_id"), F.col("primary_multiple").alias(PRIMARY))
    known = F.when(F.col(PRIMARY).isin(list(METRICS)), F.col(PRIMARY))
    return watchlist.join(g, "default_group_id", "left").select("ticker", known.alias("primary_key"))
