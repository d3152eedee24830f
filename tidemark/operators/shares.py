"""Share counts: carry as-filed counts through later splits, then reconcile the sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.registry import SHARES

# Plausible range and allowed change against the last accepted count.
MIN_SHARES, MAX_SHARES = 1e5, 1e12
DRIFT = 10
NO_ANCHOR_BAND = 100


def splits_by_ticker(splits: DataFrame) -> DataFrame:
    """(ticker, splits): date-ordered array; one entry per calendar day at most."""
    daily = splits.groupBy("ticker", "date").agg(F.max("ratio").alias("ratio"))
    return daily.groupBy("ticker").agg(
        F.sort_array(F.collect_list(F.struct("date", "ratio"))).alias("splits"))


def factor_after(splits: Column, filed_at: Column) -> Column:
    """Product, in date order, of the ratios of splits dated after `filed_at`."""
    return F.aggregate(
        F.coalesce(splits, F.array()), F.lit(1.0),
        lambda acc, s: F.when(s["date"] > filed_at, acc * s["ratio"]).otherwise(acc))


def split_factor(rows: DataFrame, splits: DataFrame, filed_at: str = "filed_at") -> DataFrame:
    """Add `factor`: cumulative split ratio applied after each row's filing date."""
    return (
        rows.join(splits_by_ticker(splits), "ticker", "left")
        .withColumn("factor", factor_after(F.col("splits"), F.col(filed_at)))
        .drop("splits")
    )


def _plausible(v: Column) -> Column:
    return F.when(v.between(MIN_SHARES, MAX_SHARES), v)


def pick_shares(candidates: list[Column], reference: Column) -> Column:
    """One step: the preferred trustworthy count given the last accepted one."""
    usable = [_plausible(c) for c in candidates]
    anchored = [F.when((v / reference).between(1 / DRIFT, DRIFT), v) for v in usable]
    # Three sources and no anchor: the middle one decides, within a hundredfold band.
    middle = F.element_at(F.sort_array(F.array(*usable)), 2)
    banded = [F.when(v.between(middle / NO_ANCHOR_BAND, middle * NO_ANCHOR_BAND), v)
              for v in usable]
    all_three = usable[0].isNotNull() & usable[1].isNotNull() & usable[2].isNotNull()
    return (
        F.when(reference.isNotNull(), F.coalesce(*anchored, reference))
        .when(all_three, F.coalesce(*banded))
        .otherwise(F.coalesce(*usable))
    )


def reconcile_shares(states: DataFrame, key: str = "ticker", order: str = "as_of",
                     out: str = "shares_final", seed: DataFrame | None = None) -> DataFrame:
    """Fold over the filing states of a key in date order, carrying the last accepted count.

    `seed` (key, seed) is the count accepted before a key's first state here.

    The array holds one element per filing date, so its size follows the calendar and not
    the number of facts.
    """
    payload = [c for c in states.columns if c not in (key, order)]
    history = states.groupBy(key).agg(
        F.sort_array(F.collect_list(F.struct(order, F.struct(*payload).alias("row")))).alias("h"))
    history = history.withColumn("seed", F.lit(None).cast("double")) if seed is None else history.join(seed, key, "left")
    start = F.struct(F.col("seed").alias("ref"),
                     F.array().cast("array<double>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        chosen = pick_shares([s["row"][c] for c in SHARES], acc["ref"])
        return F.struct(chosen.alias("ref"), F.array_append(acc["out"], chosen).alias("out"))

    folded = F.aggregate("h", start, step, lambda acc: acc["out"])
    return (
        history.select(key, F.inline(F.arrays_zip(F.col("h"), folded.alias("f"))))
        .select(key, f"h.{order}", "h.row.*", F.col("f").alias(out))
    )
