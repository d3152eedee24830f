"""Invariants of the ratio table, each returning the rows that break it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.operators.distribution import to_long
from tidemark.operators.shares import factor_after, splits_by_ticker

# Bounds of plausible margins and day-over-day moves.
GROSS_BOUNDS, OPERATING_BOUNDS, CLIFF = (-1.0, 1.0), (-5.0, 1.0), (0.5, 2.0)
MULTIPLES = ["pe_ttm", "ev_ebitda", "ev_sales", "ps_ttm", "ev_fcf"]


def _near(actual: Column, expected: Column, rel: float) -> Column:
    return F.abs(actual - expected) <= F.abs(expected) * rel


def check_lookahead(rows: DataFrame) -> DataFrame:
    """Rows fed by a filing newer than their session."""
    return rows.where("fundamentals_filed_at > date").select("ticker", "date", "fundamentals_filed_at")


def check_step(rows: DataFrame) -> DataFrame:
    """Sessions on which trailing revenue moved without a new filing."""
    w = Window.partitionBy("ticker").orderBy("date")
    known = rows.where("revenue_ttm IS NOT NULL").select(
        "ticker", "date", "revenue_ttm", "fundamentals_filed_at",
        F.lag("revenue_ttm").over(w).alias("was"), F.lag("fundamentals_filed_at").over(w).alias("filed_was"))
    return known.where("revenue_ttm <> was AND fundamentals_filed_at <=> filed_was").select(
        "ticker", "date", "was", "revenue_ttm")


def check_identities(rows: DataFrame) -> DataFrame:
    """Rows where P/E is not the reciprocal of the earnings yield, or EV not cap plus net debt."""
    reciprocal = F.when(F.col("earnings_yield") > 0, ~_near(
        F.col("pe_ttm"), 1 / F.col("earnings_yield"), 1e-6))
    ev = ~_near(F.col("enterprise_value"), F.col("market_cap") + F.col("net_debt"), 1e-9)
    broken = F.array_join(F.array_compact(F.array(
        F.when(reciprocal, "reciprocal"), F.when(ev, "enterprise value"))), ", ")
    return rows.select("ticker", "date", broken.alias("broken")).where("broken <> ''")


def check_negative(rows: DataFrame) -> DataFrame:
    """Negative multiples."""
    return to_long(rows, MULTIPLES).where("value < 0")


def check_bounds(rows: DataFrame) -> DataFrame:
    """Margins no company can have."""
    bad = ~F.col("gross_margin").between(*GROSS_BOUNDS) | ~F.col("operating_margin").between(*OPERATING_BOUNDS)
    return rows.where(bad).select("ticker", "date", "gross_margin", "operating_margin")


def check_cliffs(rows: DataFrame) -> DataFrame:
    """Sessions whose market cap is not within half to double of the last known one."""
    w = Window.partitionBy("ticker").orderBy("date")
    known = rows.where("market_cap IS NOT NULL").select(
        "ticker", "date", "market_cap", F.lag("market_cap").over(w).alias("was"))
    ratio = F.when(F.col("was") != 0, F.col("market_cap") / F.col("was"))
    return known.select("ticker", "date", ratio.alias("ratio")).where(
        (F.col("ratio") <= CLIFF[0]) | (F.col("ratio") >= CLIFF[1]))


def check_freshness(rows: DataFrame, bound: Column) -> DataFrame:
    """Tickers whose newest session is older than `bound`."""
    return rows.groupBy("ticker").agg(F.max("date").alias("last")).where(F.col("last") < bound)


def check_restated_shares(facts: DataFrame, splits: DataFrame, tolerance: float = 1e-4) -> DataFrame:
    """Share facts whose first version, carried through splits, disagrees with the last one."""
    versions = facts.groupBy("ticker", "concept", "period_end", "duration_days").agg(
        F.min_by(F.struct("filed_at", "value"), F.struct("filed_at", "accession")).alias("a"),
        F.max_by(F.struct("filed_at", "value"), F.struct("filed_at", "accession")).alias("b"))
    carried = versions.where("a.filed_at < b.filed_at").join(splits_by_ticker(splits), "ticker", "left")
    in_terms = lambda v: F.col(f"{v}.value") * factor_after(F.col("splits"), F.col(f"{v}.filed_at"))
    return carried.select("ticker", "concept", "period_end", in_terms("a").alias("original"),
                          in_terms("b").alias("restated")).where(
        ~_near(F.col("original"), F.col("restated"), tolerance))
