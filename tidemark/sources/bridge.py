"""Driver tables -> engine tables: suppliers act as companies, ship dates as sessions.

Each view scans the line items once and aggregates to its grain at once, with fixed-point
sums (cents and ten-thousandths), so results do not depend on the order of addition.
Every shuffle sees pre-aggregated rows: a supplier with a third of all line items is
reduced map-side to one row per session or per quarter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark import registry


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticker_of(key: str) -> Column:
    """Ten digits: wide enough for ten billion entities without truncation."""
    text = F.col(key).cast("string")
    return F.concat(F.lit("S"), F.when(F.length(text) > 10, text).otherwise(F.lpad(text, 10, "0")))


def fixed(c: Column, scale: int) -> Column:
    """Amount as a whole number of 1/scale, so that sums are exact in any order."""
    return F.floor(c * scale + 0.5)


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ticker, date, close, volume): one row per company and session."""
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_suppkey", F.to_date("l_shipdate").alias("date"))
        .agg(F.sum(fixed(F.col("l_extendedprice"), 100)).alias("cents"),
             F.sum(F.col("l_quantity").cast("long")).alias("volume"))
        .select(ticker_of("l_suppkey").alias("ticker"), "date",
                (F.col("cents") / F.lit(100.0) / F.col("volume")).alias("close"), "volume")
    )


def _versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sk, kind, ps, s0, sd, st, q): the sums behind every fact version, one row each."""
    base = (
        table(spark, sf_dir, "lineitem")
        .groupBy(
            F.col("l_suppkey").alias("sk"),
            F.trunc(F.to_date("l_shipdate"), "QUARTER").alias("q_start"),
            (F.col("l_linestatus") == "F").alias("final"))
        .agg(
            F.sum(fixed(F.col("l_extendedprice"), 100)).alias("c0"),
            F.sum(fixed(F.col("l_extendedprice") * F.col("l_discount"), 10000)).alias("cd"),
            F.sum(fixed(F.col("l_extendedprice") * F.col("l_tax"), 10000)).alias("ct"),
            F.sum(F.col("l_quantity").cast("long")).alias("q"))
    )
    level = lambda kind, ps: F.struct(F.lit(kind).alias("kind"), ps.alias("ps"))
    levels = F.array(
        level("Q-restated", F.col("q_start")),
        level("FY", F.trunc("q_start", "YEAR")),
        F.when(F.col("final"), level("Q-orig", F.col("q_start"))))
    return (
        base.withColumn("level", F.explode(levels)).where("level is not null")
        .groupBy("sk", "level.kind", "level.ps")
        .agg(F.sum("c0").alias("c0"), F.sum("cd").alias("cd"),
             F.sum("ct").alias("ct"), F.sum("q").alias("q"))
        .selectExpr("sk", "kind", "ps", "c0 / 100.0D AS s0", "cd / 10000.0D AS sd",
                    "ct / 10000.0D AS st", "cast(q AS double) AS q")
    )


# Duration concepts: (value, condition for a company to report it).
_FLOW_VALUES = {
    "revenue": ("s0 - sd", "true"),
    "cost_of_revenue": ("s0 * 0.6D", "true"),
    "gross_profit": ("s0 * 0.4D - sd", "sk % 4 = 0"),
    "operating_income": ("s0 * 0.25D - sd - st", "sk % 5 <> 1"),
    "net_income": ("CASE WHEN sk % 7 = 3 THEN s0 * 0.04D - sd ELSE s0 * 0.2D - sd - st END",
                   "true"),
    "pretax_income": ("s0 * 0.2D - sd", "sk % 11 <> 4"),
    "income_tax": ("st", "true"),
    "interest_expense": ("s0 * 0.01D", "sk % 2 = 0"),
    "operating_cash_flow": ("s0 * 0.22D - sd", "true"),
    "capex": ("s0 * 0.05D", "true"),
    "depreciation_amortization": (
        "s0 * 0.03D", "sk % 3 = 1 OR (sk % 3 = 0 AND ps < DATE'1999-01-01')"),
    "depreciation_expense": ("s0 * 0.02D", "sk % 3 <> 1"),
    "amortisation_expense": ("s0 * 0.015D", "sk % 3 = 0"),
    "stock_based_compensation": ("sd", "true"),
    "dividends_paid": ("s0 * 0.01D", "sk % 4 = 1"),
    "buybacks": ("s0 * 0.02D", "sk % 4 = 3"),
    "shares_diluted": (
        "1000000D + 100D * q / CASE WHEN kind = 'FY' THEN 4D ELSE 1D END", "sk % 4 <> 1"),
}
# Instant concepts, measured at quarter end. Every eleventh share count is off by a thousand.
_INSTANT_VALUES = {
    "shares_outstanding": (
        "(1000000D + 100D * q) * "
        "CASE WHEN (sk + year(ps) * 4 + quarter(ps)) % 11 = 0 THEN 1000D ELSE 1D END", "true"),
    "shares_outstanding_gaap": ("1000000D + 99D * q", "sk % 3 = 0"),
    "cash": ("s0 * 0.3D", "true"),
    "short_term_investments": ("s0 * 0.1D", "sk % 3 = 1"),
    "long_term_debt": ("s0 * 0.5D", "sk % 4 <> 2"),
    "short_term_debt": ("s0 * 0.1D", "sk % 6 = 0"),
    "inventory": ("s0 * 0.2D", "sk % 5 <> 4"),
    "total_assets": ("s0 * 2.0D", "true"),
    "total_equity": ("s0 * CASE WHEN sk % 13 = 7 THEN -0.1D ELSE 0.9D END", "true"),
    "current_assets": ("s0 * 0.8D", "true"),
    "current_liabilities": ("s0 * 0.4D", "true"),
}


def fundamentals(spark: SparkSession, sf_dir: str, concepts: list[str] | None = None) -> DataFrame:
    """As-filed facts with restatements: (ticker, concept, period_start, period_end,
    duration_days, filed_at, accession, form, unit, value).

    Quarters are filed a month after they end from settled lines only and restated three
    months later; years follow two months after they end.
    """
    keep = lambda d: {k: v for k, v in d.items() if concepts is None or k in concepts}
    flows, instants = keep(_FLOW_VALUES), keep(_INSTANT_VALUES)
    entry = lambda c, v, when, instant: (
        f"CASE WHEN {when} THEN named_struct('concept', '{c}', 'instant', {instant}, "
        f"'value', {v}) END")
    flow_rows = ", ".join(entry(c, v, w, "false") for c, (v, w) in flows.items())
    instant_rows = ", ".join(
        entry(c, v, f"kind = 'Q-restated' AND ({w})", "true") for c, (v, w) in instants.items())
    rows = ", ".join(r for r in (flow_rows, instant_rows) if r)
    return (
        _versions(spark, sf_dir)
        .selectExpr("*", f"explode(array({rows})) AS f").where("f is not null")
        .selectExpr(
            "sk", "f.concept", "f.value", "f.instant", "kind",
            "ps", "CASE WHEN kind = 'FY' THEN last_day(add_months(ps, 11)) "
                  "ELSE last_day(add_months(ps, 2)) END AS period_end")
        .select(
            ticker_of("sk").alias("ticker"), "concept",
            F.expr("CASE WHEN NOT instant THEN ps END").alias("period_start"), "period_end",
            F.expr("CASE WHEN instant THEN 0 ELSE datediff(period_end, ps) END")
            .alias("duration_days"),
            F.expr("CASE WHEN kind = 'FY' THEN add_months(ps, 14) "
                   "WHEN kind = 'Q-orig' OR instant THEN add_months(ps, 4) "
                   "ELSE add_months(ps, 7) END").alias("filed_at"),
            F.expr("CASE WHEN instant THEN 'Q-orig' ELSE kind END").alias("accession"),
            F.expr("CASE WHEN kind = 'FY' THEN '10-K' ELSE '10-Q' END").alias("form"),
            F.lit("USD").alias("unit"), "value")
    )


def splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ticker, date, ratio)."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey")
    event = F.array(
        F.when(F.expr("s_suppkey % 3 < 2"), F.struct(
            F.expr("add_months(DATE'1997-01-01', cast(s_suppkey * 13 % 48 AS int))").alias("date"),
            F.expr("CASE s_suppkey % 3 WHEN 0 THEN 2D ELSE 4D END").alias("ratio"))),
        F.when(F.expr("s_suppkey % 6 = 0"), F.struct(
            F.expr("DATE'2001-06-01'").alias("date"), F.lit(10.0).alias("ratio"))))
    return (s.select(ticker_of("s_suppkey").alias("ticker"), F.explode(event).alias("e"))
            .where("e is not null").select("ticker", "e.date", "e.ratio"))


def watchlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ticker, name, cik, default_group_id, supported, added_price)."""
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    return (
        table(spark, sf_dir, "supplier")
        .join(nation, F.expr("s_nationkey = n_nationkey"))
        .select(ticker_of("s_suppkey").alias("ticker"), F.col("s_name").alias("name"),
                F.col("s_suppkey").alias("cik"),
                F.expr("CASE WHEN s_suppkey % 9 <> 8 THEN n_regionkey + 1 END")
                .alias("default_group_id"),
                F.expr("s_suppkey % 17 <> 5").alias("supported"),
                F.expr("CASE WHEN s_suppkey % 2 = 1 THEN s_acctbal END").alias("added_price"))
    )


def stock_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ticker, group_id): region membership, and group 10 for every third company."""
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    groups = F.expr("CASE WHEN s_suppkey % 3 = 0 THEN array(n_regionkey + 1, 10) "
                    "ELSE array(n_regionkey + 1) END")
    return (
        table(spark, sf_dir, "supplier")
        .join(nation, F.expr("s_nationkey = n_nationkey"))
        .select(ticker_of("s_suppkey").alias("ticker"), F.explode(groups).alias("group_id"))
    )


def metric_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(group_id, name, profile, primary_multiple): regions dealt over the metric profiles."""
    order = list(registry.PROFILES)
    rows = [(i, p, registry.PROFILES[p][0]) for i, p in enumerate(order)]
    profiles = registry.literal_rows(spark, rows, "slot int, profile string, primary_multiple string")
    groups = table(spark, sf_dir, "region").selectExpr(
        "explode(CASE WHEN r_regionkey = 0 "
        "THEN array(named_struct('group_id', 1, 'name', r_name), "
        "named_struct('group_id', 10, 'name', 'CROSS SECTION')) "
        "ELSE array(named_struct('group_id', r_regionkey + 1, 'name', r_name)) END) AS g").select("g.*")
    return (groups.join(profiles, F.expr("(group_id - 1) % 4 = slot"))
            .select("group_id", "name", "profile", "primary_multiple"))


def group_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(group_id, metric_key, section, sort_order)."""
    return (metric_groups(spark, sf_dir)
            .join(registry.profile_metrics(spark), "profile")
            .select("group_id", "metric_key", "section", "sort_order"))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ticker, period_end, filed_at, label, parent, value, row_idx): product lines by part
    type with a GROUP_A total after its parts; every fifth company reports one line too high."""
    lines = (
        table(spark, sf_dir, "lineitem")
        .select("l_partkey", "l_suppkey", F.trunc(F.to_date("l_shipdate"), "YEAR").alias("y"),
                fixed(F.col("l_extendedprice") * (1 - F.col("l_discount")), 10000).alias("v"))
        .join(table(spark, sf_dir, "part").select("p_partkey", "p_type"),
              F.expr("l_partkey = p_partkey"))
        .groupBy("l_suppkey", "y", "p_type").agg(F.sum("v").alias("v"))
        .withColumn("v", F.expr("CASE WHEN l_suppkey % 5 = 0 AND p_type = 'PROMO' THEN v * 2 ELSE v END"))
    )
    labels = F.expr(
        "CASE WHEN p_type IN ('ECONOMY', 'LARGE', 'MEDIUM') "
        "THEN array(p_type, 'GROUP_A') ELSE array(p_type) END")
    return (
        lines.select("l_suppkey", "y", "v", F.explode(labels).alias("label"))
        .groupBy("l_suppkey", "y", "label").agg(F.sum("v").alias("v"))
        .select(
            ticker_of("l_suppkey").alias("ticker"),
            F.expr("last_day(add_months(y, 11))").alias("period_end"),
            F.expr("add_months(y, 14)").alias("filed_at"), "label",
            F.lit(None).cast("string").alias("parent"),
            F.expr("v / 10000.0D").alias("value"),
            F.expr("CASE label WHEN 'ECONOMY' THEN 1 WHEN 'LARGE' THEN 2 WHEN 'MEDIUM' THEN 3 "
                   "WHEN 'GROUP_A' THEN 4 WHEN 'PROMO' THEN 5 WHEN 'SMALL' THEN 6 ELSE 7 END")
            .alias("row_idx"))
    )
