"""Registered queries: each builds one plan over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.functions import scalars
from tidemark.operators import (
    asof, checks, distribution, grid, incremental, normalize, ratios, refresh, reports, rules, runs,
    segments, shares, state)
from tidemark import registry
from tidemark.registry import FLOWS, SHARES, STOCKS
from tidemark.session import new_path, staged
from tidemark.sources import bridge, facts, html_reports, sinks
from tidemark.streaming import rules_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _states(spark: SparkSession, d: str) -> DataFrame:
    return state.filing_state(bridge.fundamentals(spark, d), bridge.splits(spark, d))


def _ratios(spark: SparkSession, d: str) -> DataFrame:
    return ratios.ratios_daily(bridge.prices(spark, d), bridge.fundamentals(spark, d),
                               bridge.splits(spark, d))


# ---- point in time ---------------------------------------------------------------------
@query
def prices_daily(spark, d):
    return bridge.prices(spark, d)


@query
def fundamentals(spark, d):
    return bridge.fundamentals(spark, d)


@query
def filing_grid(spark, d):
    return state.filing_grid(bridge.fundamentals(spark, d))


@query
def visible_asof(spark, d):
    filed = bridge.fundamentals(spark, d)
    return asof.visible_asof(filed, state.filing_grid(filed))


@query
def ttm(spark, d):
    return state.concept_values(bridge.fundamentals(spark, d)).where(F.col("concept").isin(FLOWS))


@query
def latest_instant(spark, d):
    return state.concept_values(bridge.fundamentals(spark, d)).where(F.col("concept").isin(STOCKS))


@query
def split_factor(spark, d):
    filed = bridge.fundamentals(spark, d, SHARES)
    return shares.split_factor(filed, bridge.splits(spark, d)).select(
        "ticker", "concept", "period_end", "filed_at", "accession",
        (F.col("value") * F.col("factor")).alias("value"))


@query
def shares_normalised(spark, d):
    return _states(spark, d).select("ticker", "as_of", *SHARES)


@query
def filing_state(spark, d):
    return _states(spark, d)


@query
def derived_concepts(spark, d):
    return state.derived_concepts(_states(spark, d)).select(
        "ticker", "as_of", "gross_profit", "depreciation_amortization", "ebit", "ebitda", "fcf",
        "total_debt", "net_debt")


@query
def share_reconcile(spark, d):
    return shares.reconcile_shares(_states(spark, d).select("ticker", "as_of", *SHARES)).select(
        "ticker", "as_of", "shares_final")


@query
def asof_attach(spark, d):
    states = _states(spark, d).select("ticker", "as_of", "filed_at", "revenue")
    return asof.asof_attach(bridge.prices(spark, d).drop("volume"), states).drop("_t")


@query
def ratios_daily(spark, d):
    return _ratios(spark, d)


@query
def roic(spark, d):
    return _ratios(spark, d).select("ticker", "date", "roic")


@query
def yoy_growth(spark, d):
    return _ratios(spark, d).select("ticker", "date", "revenue_ttm", "revenue_growth_yoy")


# ---- distribution and grid -------------------------------------------------------------
def _groups(spark, d):
    return bridge.stock_groups(spark, d), bridge.metric_groups(spark, d)


def _active(spark, d, requested=None):
    return grid.active_group(bridge.watchlist(spark, d), *_groups(spark, d), requested)


@query
def latest_value(spark, d):
    return distribution.latest_value(_ratios(spark, d))


@query
def metric_stats(spark, d):
    return distribution.metric_stats(_ratios(spark, d))


@query
def upper_median(spark, d):
    return distribution.upper_median(_ratios(spark, d))


@query
def peer_median(spark, d):
    current = distribution.to_long(distribution.latest_snapshot(_ratios(spark, d)))
    return distribution.peer_median(current, bridge.stock_groups(spark, d))


@query
def day_change(spark, d):
    return grid.day_change(_ratios(spark, d))


@query
def range_52w(spark, d):
    latest = distribution.latest_snapshot(_ratios(spark, d).select("ticker", "date", "close"))
    return grid.range_52w(bridge.prices(spark, d), latest)


@query
def flags(spark, d):
    return grid.grid_rows(_ratios(spark, d), _active(spark, d)).select("ticker", "date", "flags")


@query
def active_group(spark, d):
    wish = bridge.watchlist(spark, d).selectExpr(
        "ticker", "CASE WHEN cik % 5 = 0 THEN 10 END AS requested_group_id")
    return _active(spark, d, wish)


@query
def section_profile(spark, d):
    return grid.section_profile(_ratios(spark, d), _active(spark, d),
                                bridge.stock_groups(spark, d), bridge.group_metrics(spark, d))


# Columns of the sampled series.
SERIES = ["close", "pe_ttm", "ev_ebitda", "ev_sales", "fcf_yield", "gross_margin", "operating_margin", "net_margin",
          "fcf_margin", "roic", "revenue_growth_yoy", "shares_diluted", "sbc_pct_revenue", "net_debt_ebitda",
          "inventory_days", "fcf_conversion"]


@query
def sampled_series(spark, d):
    return grid.sampled_series(_ratios(spark, d), SERIES)


@query
def percentile_band(spark, d):
    return distribution.metric_stats(_ratios(spark, d)).select(
        "ticker", "metric_key", "percentile",
        scalars.percentile_band(F.col("percentile")).alias("band"))


def _grid(spark, d):
    return grid.watchlist_grid(_ratios(spark, d), bridge.watchlist(spark, d), *_groups(spark, d))


@query
def watchlist_grid(spark, d):
    return _grid(spark, d)


@query
def grid_sorted(spark, d):
    rows = grid.grid_rows(_ratios(spark, d), _active(spark, d))
    return grid.grid_sorted(rows, "multiple", "desc").select(
        "section", "ticker", "multiple", "sort_rank")


@query
def added_price(spark, d):
    latest = distribution.latest_snapshot(_ratios(spark, d).select("ticker", "date", "close"))
    return grid.added_price(bridge.watchlist(spark, d), latest).select("ticker", "added_price")


# ---- reports ---------------------------------------------------------------------------
@query
def run_freshness(spark, d):
    runs = bridge.table(spark, d, "events").select(
        F.col("event_id").alias("run_id"), F.col("ts").alias("started_at"),
        F.expr("CASE WHEN event_type <> 'error' THEN ts + make_interval(0, 0, 0, 0, 0, 5) END")
        .alias("finished_at"),
        F.expr("CASE event_type WHEN 'error' THEN 'running' WHEN 'signup' THEN 'error' ELSE 'ok' END")
        .alias("status"))
    return reports.run_freshness(runs, F.expr("TIMESTAMP_NTZ'2024-02-02 00:00:00'"))


@query
def latest_snapshot(spark, d):
    return distribution.latest_snapshot(_ratios(spark, d))


@query
def metric_coverage(spark, d):
    return reports.metric_coverage(_ratios(spark, d))


@query
def load_status(spark, d):
    return reports.load_status(bridge.watchlist(spark, d), bridge.fundamentals(spark, d),
                               bridge.prices(spark, d), _ratios(spark, d))


@query
def annual_series(spark, d):
    return reports.annual_series(bridge.fundamentals(spark, d), newest=8)


@query
def restatements(spark, d):
    filed = bridge.fundamentals(spark, d)
    kind = lambda name, days: reports.restatements(filed, days).withColumn("kind", F.lit(name))
    return kind("annual", scalars.ANNUAL_DAYS).unionByName(kind("quarter", scalars.QUARTER_DAYS))


@query
def fact_versions(spark, d):
    filed = bridge.fundamentals(spark, d)
    kind = lambda name, days: reports.fact_versions(filed, days).withColumn("kind", F.lit(name))
    return kind("annual", scalars.ANNUAL_DAYS).unionByName(kind("quarter", scalars.QUARTER_DAYS))


@query
def group_summary(spark, d):
    groups = bridge.metric_groups(spark, d)
    return reports.group_summary(groups, bridge.group_metrics(spark, d), bridge.stock_groups(spark, d))


# ---- hierarchical revenue tables -------------------------------------------------------
def _report_lines(spark, d):
    """Segment lines as members of a report: child and parent in either order by company."""
    first = F.expr("cast(substr(ticker, 2) AS bigint) % 2 = 0")
    member = (
        F.when(F.col("label").isin("ECONOMY", "LARGE", "MEDIUM"),
               F.when(first, F.concat("label", F.lit(" | GROUP_A")))
               .otherwise(F.concat(F.lit("GROUP_A | "), "label")))
        .otherwise(F.col("label")))
    return bridge.segments(spark, d).select(
        "ticker", F.concat_ws("/", "ticker", "filed_at").alias("report_id"), "row_idx",
        "period_end", "value", member.alias("member"))


def _flat_lines(spark, d):
    """Segment lines without parents, so that totals must be found by value."""
    return bridge.segments(spark, d).withColumn("report_id", F.concat_ws("/", "ticker", "filed_at"))


def _stored(spark, d):
    return segments.mark_subtotals(_flat_lines(spark, d))


@query
def parse_number(spark, d):
    cell = F.expr("""CASE l_linenumber % 7
        WHEN 0 THEN concat('$ ', cast(l_extendedprice AS decimal(12,2)))
        WHEN 1 THEN concat('(', cast(l_extendedprice AS decimal(12,2)), ')')
        WHEN 2 THEN concat(cast(l_discount AS decimal(4,2)), '%')
        WHEN 3 THEN '—' WHEN 4 THEN concat('$ (', cast(l_quantity AS decimal(8,1)), ')')
        WHEN 5 THEN concat(' ', cast(l_quantity AS int), ',', '000 ')
        ELSE concat('-', cast(l_quantity AS int)) END""")
    return bridge.table(spark, d, "lineitem").select(cell.alias("cell")).groupBy("cell").agg(
        F.count(F.lit(1)).alias("n")).select("cell", "n", scalars.parse_number(F.col("cell")).alias("value"))


@query
def report_catalogue(spark, d):
    names = F.expr("""concat(CASE p_size % 5 WHEN 0 THEN 'Disaggregation of Revenue'
        WHEN 1 THEN 'Segment Information' WHEN 2 THEN 'Geographic Data - Segment Sales'
        WHEN 3 THEN 'Leases' ELSE 'Revenue - By Region' END, ' - ', p_name,
        CASE WHEN p_partkey % 4 = 0 THEN ' Narrative' ELSE '' END,
        CASE p_partkey % 3 WHEN 0 THEN ' (Details)' WHEN 1 THEN ' (Detail)' ELSE ' (Tables)' END)""")
    listing = bridge.table(spark, d, "part").select(
        F.expr("p_partkey div 20").alias("filing_id"), F.col("p_partkey").alias("position"),
        names.alias("short_name"))
    return segments.report_catalogue(listing)


@query
def member_islands(spark, d):
    return segments.member_islands(_report_rows(spark, d)).select(
        "report_id", "row_idx", "label", "island", "member", "is_header")


@query
def member_lines(spark, d):
    return segments.member_lines(_report_rows(spark, d), _report_periods(spark, d))


@query
def table_totals(spark, d):
    return segments.table_totals(_report_rows(spark, d), _report_periods(spark, d))


def _report_rows(spark, d):
    """Each line as a header row, an operating income row and a sales row; boilerplate and a
    total around them."""
    row = lambda at, label, value: F.struct(
        at.alias("row_idx"), label.alias("label"), F.array(value).alias("values"))
    none, v, i = F.lit(None).cast("double"), F.col("value"), F.col("row_idx") * 10
    first = F.col("row_idx") == F.lit(7)
    rows = F.array(
        row(i, F.col("label"), none),
        row(i + 1, F.lit("Operating income"), v * 0.25),
        row(i + 2, F.lit("Net sales"), v),
        F.when(first, row(F.lit(0), F.lit("Revenue [Line Items]"), none)),
        F.when(first, row(F.lit(1), F.lit("Total"), v * 3)),
        F.when(first, row(F.lit(90), F.lit("Segment Reporting Information"), none)),
        F.when(first, row(F.lit(91), F.lit("Revenues"), v * 4)))
    return (_flat_lines(spark, d).select("report_id", F.explode(rows).alias("r"))
            .where("r IS NOT NULL").select("report_id", "r.*"))


def _report_periods(spark, d):
    return _flat_lines(spark, d).groupBy("report_id").agg(
        F.lit(1000.0).alias("scale"), F.array(F.max("period_end")).alias("periods"))


@query
def pipe_orientation(spark, d):
    return segments.split_members(_report_lines(spark, d)).select(
        "report_id", "period_end", "row_idx", "label", "parent", "value")


@query
def segment_dedup(spark, d):
    # The part type without its level names several lines of a report alike.
    lines = _flat_lines(spark, d).withColumn("label", F.expr("CASE WHEN row_idx % 2 = 0 THEN 'EVEN' ELSE 'ODD' END"))
    return segments.segment_dedup(lines.select("report_id", "label", "period_end", "value", "row_idx"))


@query
def subtotal_parent(spark, d):
    lines = segments.split_members(_report_lines(spark, d))
    return segments.subtotal_parent(lines).select("report_id", "period_end", "label", "is_parent")


@query
def subtotal_run(spark, d):
    return segments.subtotal_run(_flat_lines(spark, d)).select(
        "ticker", "period_end", "label", "value", "is_subtotal")


@query
def range_match(spark, d):
    periods = bridge.segments(spark, d).select("ticker", F.date_sub("period_end", 3).alias("period_end")).distinct()
    return segments.range_match(periods, bridge.fundamentals(spark, d, ["revenue"]))


@query
def reconcile(spark, d):
    return segments.reconcile(_stored(spark, d), bridge.fundamentals(spark, d, ["revenue"]))


@query
def first_reconciling(spark, d):
    # Two candidates per filing: one with a line too high, then the table as it is.
    marked = _stored(spark, d)
    partial = marked.withColumn("report_id", F.concat("report_id", F.lit("/a"))).withColumn(
        "value", F.expr("CASE WHEN row_idx = 1 THEN value * 1.5D ELSE value END"))
    whole = marked.withColumn("report_id", F.concat("report_id", F.lit("/b")))
    both = partial.unionByName(whole)
    candidates = both.select(
        F.expr("substr(report_id, 1, length(report_id) - 2)").alias("filing_id"), "report_id",
        F.expr("CASE WHEN report_id LIKE '%/a' THEN 1 ELSE 2 END").alias("candidate_rank")).distinct()
    verdicts = segments.reconcile(both, bridge.fundamentals(spark, d, ["revenue"]))
    return segments.first_reconciling(verdicts, candidates)


@query
def segment_growth(spark, d):
    grown = segments.segment_growth(_stored(spark, d), F.expr("DATE'2003-01-01'"))
    return grown.withColumn("cagr", scalars.half_up(F.col("cagr"), 1e9))


@query
def segment_series(spark, d):
    return segments.segment_series(_stored(spark, d))


@query
def segment_coverage(spark, d):
    return segments.segment_coverage(_stored(spark, d), bridge.watchlist(spark, d),
                                     bridge.fundamentals(spark, d, ["revenue"]))


@query
def segment_violations(spark, d):
    return segments.segment_violations(_stored(spark, d))


# ---- sources and normalisation ---------------------------------------------------------
def tag_choice() -> list[tuple]:
    """(concept, foreign, copy, namespace, tag): two competing tags per concept where it has
    two, and one tag no concept knows."""
    rows = [("revenue", False, 2, "us-gaap", "CustomRevenueTag")]
    for c, (_kind, ns, tags, second) in registry.CONCEPTS.items():
        rows += [(c, False, i, ns, t) for i, t in enumerate(tags[:2])]
        rows += [(c, True, i, registry.SECOND_NAMESPACE, t) for i, t in enumerate(second[:2])]
    return rows


def _entries(spark, d, reported=None, keep=()):
    """Facts as raw reported entries, some of them unusable, under competing tags.

    `reported` are the facts with further columns `keep`; facts move once, by ticker, before they become texts.
    """
    if reported is None:
        found = bridge.fundamentals(spark, d)
        reported = found.repartition(state.shuffle_width(found), "ticker")
    choice = registry.literal_rows(
        spark, tag_choice(), "concept string, foreign boolean, copy int, namespace string, tag string")
    sk = "cast(substr(ticker, 2) AS bigint)"
    return (
        reported.withColumn("foreign", F.expr(f"{sk} % 10 = 7"))
        .join(choice, ["concept", "foreign"])
        .select(
            *keep, "ticker", "namespace", "tag",
            F.expr(f"CASE WHEN {sk} % 10 = 3 THEN 'EUR' ELSE unit END").alias("unit"),
            F.expr(f"""CASE WHEN concept = 'buybacks' AND {sk} % 8 = 3 THEN NULL
                   WHEN concept = 'dividends_paid' AND accession = 'Q-orig'
                   THEN cast(date_sub(period_start, 30) AS string)
                   ELSE cast(period_start AS string) END""").alias("start"),
            F.col("period_end").cast("string").alias("end"),
            (F.col("value") + F.col("copy")).alias("val"), F.col("accession").alias("accn"),
            F.year("period_end").alias("fy"),
            F.expr("CASE WHEN accession = 'FY' THEN 'FY' ELSE concat('Q', quarter(period_end)) END")
            .alias("fp"), "form",
            F.expr(f"CASE WHEN concept = 'capex' AND accession = 'FY' AND {sk} % 10 = 1 THEN NULL "
                   "ELSE cast(filed_at AS string) END").alias("filed"))
    )


def _tags(spark):
    return registry.concept_tags(spark)


def _normal(spark, d):
    return normalize.normalize(_entries(spark, d), _tags(spark))


@query
def facts_flatten(spark, d):
    # Nest each tag's entries into its payload text, then read that back as a source does.
    entry = F.struct("start", "end", "val", "accn", "fy", "fp", "form", "filed")
    tags = _entries(spark, d).groupBy("ticker", "namespace", "tag", "unit").agg(
        F.collect_list(entry).alias("entries"))
    units = F.struct(F.lit(None).cast("string").alias("label"),
                     F.create_map("unit", "entries").alias("units"))
    body = F.to_json(F.struct(F.create_map(
        "namespace", F.create_map("tag", units)).alias("facts")))
    flat = facts.flatten_facts(facts.parse_company_facts(tags.select("ticker", body.alias("body"))))
    return (flat.drop("source_pos").withColumnRenamed("start", "start_date")
            .withColumnRenamed("end", "end_date"))


@query
def facts_refresh(spark, d):
    # A fourth of the companies have a predecessor whose payload restates what was filed before 1998, a
    # thousand higher. Every entry is followed by a repeat with another value, which must lose.
    sk = F.expr("cast(substr(ticker, 2) AS bigint)")
    own = F.struct((sk + F.when(sk % 4 == 0, 1000000).otherwise(0)).alias("cik"), F.lit(0).alias("more"))
    old = F.when((sk % 4 == 0) & (F.col("filed_at") < F.expr("DATE'1998-01-01'")), F.struct(
        sk.alias("cik"), F.lit(1000).alias("more")))
    found = bridge.fundamentals(spark, d)
    # All groups below are within a key: facts move to it once, before they become texts.
    keyed = found.select("*", F.inline(F.array_compact(F.array(own, old)))).repartition(state.shuffle_width(found), "cik")
    both = _entries(spark, d, keyed, ["cik", "more"]).where("more = 0 OR filed IS NOT NULL").withColumn(
        "val", F.when(F.col("more") > 0, F.col("val") + F.col("more")).otherwise(F.col("val")))
    entry = lambda v: F.struct("start", "end", v.alias("val"), "accn", "fy", "fp", "form", "filed")
    lists = both.groupBy("cik", "namespace", "tag", "unit").agg(F.sort_array(F.collect_list(F.struct(
        F.struct("accn", "end", "start", "val").alias("at"), F.array(entry(F.col("val")), entry(F.col("val") + 7)).alias("e")))).alias("e"))
    units = lists.select("cik", "namespace", "tag", F.create_map("unit", F.flatten("e.e")).alias("units"))
    tags = units.groupBy("cik", "namespace").agg(F.map_from_entries(F.collect_list(F.struct("tag", F.struct(
        F.lit(None).cast("string").alias("label"), "units")))).alias("tags"))
    bodies = tags.groupBy("cik").agg(F.to_json(F.struct(F.map_from_entries(F.collect_list(F.struct(
        "namespace", "tags"))).alias("facts"))).alias("body"))
    doc = bridge.table(spark, d, "supplier").select(F.expr(
        "to_json(map(cast(s_suppkey AS string), named_struct('cik_str', s_suppkey, 'ticker', "
        "lower(concat('S', lpad(cast(s_suppkey AS string), 10, '0'))), 'title', s_name)))").alias("body"))
    moved = bridge.table(spark, d, "supplier").where("s_suppkey % 4 = 0").select(
        bridge.ticker_of("s_suppkey").alias("ticker"), F.expr("array(s_suppkey + 1000000, s_suppkey)").alias("ciks"))
    return refresh.facts_refresh(doc, moved, bodies, _tags(spark))


@query
def ticker_registry(spark, d):
    # One registry document per company: its ticker and its keys, some with a predecessor.
    doc = bridge.table(spark, d, "supplier").select(F.expr(
        "to_json(map(cast(s_suppkey AS string), named_struct('cik_str', s_suppkey, 'ticker', "
        "lower(s_name), 'title', s_name)))").alias("body"))
    moved = bridge.table(spark, d, "supplier").where("s_suppkey % 4 = 0").select(
        F.upper("s_name").alias("ticker"), F.expr("array(s_suppkey + 1000000, s_suppkey)").alias("ciks"))
    return facts.resolve_ciks(facts.parse_registry(doc), moved)


@query
def price_history(spark, d):
    nan = F.lit(float("nan"))
    history = bridge.prices(spark, d).select(
        "ticker", "date", "volume",
        F.when(F.col("volume") % 10 == 0, nan).otherwise(F.col("close")).alias("close"),
        F.when(F.col("volume") % 7 == 0, 2.0).when(F.col("volume") % 7 == 1, nan).otherwise(0.0).alias("split"),
        F.when(F.col("volume") % 5 == 0, 0.25).otherwise(0.0).alias("dividend"))
    p, s, v = facts.price_tables(history)
    kind = lambda df, k, c: df.select(F.lit(k).alias("kind"), "ticker", "date", F.col(c).alias("value"))
    return kind(p, "price", "close").unionByName(kind(s, "split", "ratio")).unionByName(
        kind(v, "dividend", "amount"))


@query
def filings_topn(spark, d):
    filed = bridge.fundamentals(spark, d, ["revenue"]).select(
        "ticker", "form", "accession", "filed_at", "period_end").distinct()
    index = filed.groupBy("ticker").agg(F.collect_list(F.struct(
        "form", F.concat_ws("-", "accession", "period_end").alias("a"), "filed_at", "period_end")).alias("f")).select(
        "ticker", F.lit(1).alias("cik"), F.col("f.form").alias("form"), F.col("f.a").alias("accessionNumber"),
        F.col("f.filed_at").alias("filingDate"), F.col("f.period_end").alias("reportDate"))
    return facts.annual_filings(index, F.expr("DATE'2003-06-30'"), years=10, newest=10)


@query
def report_scan(spark, d):
    # Reports rendered as HTML by Spark, one document per filing, then scanned back.
    # Some rows hold a footnote, a table within the cell, or a span that is no number.
    note = F.when(F.col("row_idx") % 3 == 1, "</td><td>(1)").when(
        F.col("row_idx") % 3 == 2, "<table><tr><td>7</td></tr></table>").otherwise("")
    cell = F.concat(F.lit("<tr><td>"), "label", F.lit("</td><td colspan=\"1%\">$ "),
                    F.format_number(F.col("value"), 4), note, F.lit("</td></tr>"))
    docs = _flat_lines(spark, d).groupBy("report_id", "period_end").agg(F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("row_idx", cell.alias("c")))), lambda x: x["c"]), "").alias("body"))
    html = F.concat(F.lit("<table><tr><th rowspan='1'>Revenue - USD ($) $ in Thousands</th><th>"),
                    F.date_format("period_end", "MMM dd, yyyy"), F.lit("</th></tr>"), "body", F.lit("</table>"))
    broken = docs.select(F.concat("report_id", F.lit("/none")).alias("report_id"), F.lit("<p>no table").alias("html"))
    rows = html_reports.report_rows(docs.select("report_id", html.alias("html")).unionByName(broken))
    return rows.select("reason", "report_id", "row_idx", "label",
                       scalars.parse_number(F.col("cells")[0]).alias("value"),
                       F.col("periods")[0].alias("period_end"))


@query
def segment_refresh(spark, d):
    # Each filing lists a first choice with one line too high, the right table, and one that is no choice.
    lines = staged(_flat_lines(spark, d).withColumn("filing_id", F.translate("report_id", "/-", "")))
    # Staged: a filter on what the index texts say would otherwise reach, and write and read a text for, every line item.
    filed = staged(lines.select("ticker", "filing_id", "filed_at", "period_end").distinct())
    array = lambda c: F.transform(F.array(c), lambda x: x.cast("string"))
    index = facts.read_filing_index(filed.select("ticker", F.lit(1).alias("cik"), F.to_json(F.struct(
        F.array(F.lit("10-K")).alias("form"), F.array("filing_id").alias("accessionNumber"),
        array(F.col("filed_at")).alias("filingDate"), array(F.col("period_end")).alias("reportDate"))).alias("body")))
    names = F.expr("""array(named_struct('position', 2, 'short_name', 'Disaggregation of Revenue (Details)', 'file', 'R2.htm'),
        named_struct('position', 3, 'short_name', 'Segment Information - Segment Sales (Details)', 'file', 'R3.htm'),
        named_struct('position', 4, 'short_name', 'Leases (Details)', 'file', 'R4.htm'))""")
    listing = filed.select("filing_id", F.inline(names))
    shown = F.format_number(F.when((F.col("file") == "R2.htm") & (F.col("row_idx") == 1), F.col("value") * 1.5).otherwise(
        F.col("value")) / 1000, 7)
    cell = F.concat(F.lit("<tr><td>"), "label", F.lit("</td><td> </td></tr><tr><td>Net sales</td><td>$ "), shown,
                    F.lit("</td><td>(1)</td></tr>"))
    bodies = lines.withColumn("file", F.explode(F.array(*map(F.lit, ("R2.htm", "R3.htm", "R4.htm"))))).groupBy(
        "filing_id", "file", "period_end").agg(F.array_join(F.transform(F.sort_array(F.collect_list(
            F.struct("row_idx", cell.alias("c")))), lambda x: x["c"]), "").alias("body"))
    html = F.concat(F.lit("<table><tr><th>Revenue - USD ($) $ in Thousands</th><th>"), F.date_format("period_end", "MMM dd, yyyy"),
                    F.lit("</th></tr>"), "body", F.lit("<tr><td>Segment Reporting Information</td><td></td></tr>"
                                                       "<tr><td>Net sales</td><td>9</td></tr></table>"))
    stored = refresh.segment_refresh(index, listing, bodies.select("filing_id", "file", html.alias("html")),
                                     bridge.fundamentals(spark, d, ["revenue"]), F.expr("DATE'2003-06-30'"), 10, 10)
    # Whole amounts; the offset keeps four-decimal values away from the edge.
    return stored.withColumn("value", F.floor(F.col("value") + 0.12345).cast("double"))


@query
def concept_map(spark, d):
    return normalize.concept_map(_entries(spark, d), _tags(spark)).select(
        "ticker", "namespace", "tag", "concept", "kind", "priority", "accn",
        F.col("end").alias("end_date"), "val")


@query
def fact_rows(spark, d):
    return normalize.fact_rows(normalize.concept_map(_entries(spark, d), _tags(spark)))


@query
def duration_bucket(spark, d):
    days = F.expr("cast((l_orderkey * 7 + l_partkey) % 400 AS int)")
    return (bridge.table(spark, d, "lineitem").groupBy(days.alias("days"))
            .agg(F.count(F.lit(1)).alias("n"))
            .withColumn("bucket", scalars.duration_bucket(F.col("days"))))


@query
def fact_dedup(spark, d):
    return _normal(spark, d)


@query
def taxonomy(spark, d):
    return normalize.taxonomy(_entries(spark, d))


@query
def unit_mode(spark, d):
    return normalize.unit_mode(_normal(spark, d))


@query
def concept_coverage(spark, d):
    return normalize.concept_coverage(_normal(spark, d))


@query
def concept_missing(spark, d):
    return normalize.concept_missing(_normal(spark, d))


@query
def support_gate(spark, d):
    return normalize.support_gate(_normal(spark, d), normalize.taxonomy(_entries(spark, d)))


@query
def quarantine(spark, d):
    # Some filing dates are no dates, and some companies' payloads end early.
    wrong = F.expr("fp = 'Q2' AND cast(substr(ticker, 2) AS bigint) % 3 = 1 AND filed IS NOT NULL")
    entries = _entries(spark, d).withColumn("filed", F.when(wrong, "2024-02-31").otherwise(F.col("filed")))
    bad = normalize.quarantine(entries, _tags(spark)).select("ticker", "tag", "reason")
    body = F.expr("""CASE WHEN s_suppkey % 4 = 0 THEN '{"cik": 1, "facts": {"us-gaap": {"Assets": {"la'
                          ELSE '{"cik": 1, "entityName": "x", "facts": {}}' END""")
    texts = bridge.table(spark, d, "supplier").select(bridge.ticker_of("s_suppkey").alias("ticker"), body.alias("body"))
    payloads = normalize.quarantine_payloads(facts.parse_company_facts(texts)).withColumn("tag", F.lit(None).cast("string"))
    return bad.unionByName(payloads).groupBy("ticker", "tag", "reason").agg(F.count(F.lit(1)).alias("n"))


# ---- sinks and incremental control -----------------------------------------------------
def _price_update(spark, d):
    """Restated closes of a third of the companies, and sessions not stored before."""
    p = bridge.prices(spark, d)
    return p.where(F.expr("cast(substr(ticker, 2) AS bigint) % 3 = 0")).select(
        "ticker", F.when(F.dayofmonth("date") > 25, F.add_months("date", 120)).otherwise(F.col("date")).alias("date"),
        (F.col("close") * 2).alias("close"), "volume").groupBy("ticker", "date").agg(
        F.max("close").alias("close"), F.max("volume").alias("volume"))


@query
def upsert_latest(spark, d):
    return sinks.upsert(bridge.prices(spark, d), _price_update(spark, d), ["ticker", "date"])


@query
def insert_if_absent(spark, d):
    return sinks.insert_if_absent(bridge.prices(spark, d), _price_update(spark, d), ["ticker", "date"])


@query
def remove_keys(spark, d):
    gone = bridge.watchlist(spark, d).where("NOT supported")
    return sinks.remove_keys(bridge.prices(spark, d), gone, ["ticker"])


def _store(spark, tables, key="ticker"):
    """The tables written by bucket under a folder of their own; the folder."""
    root = new_path(spark, "store")
    for name, df in tables.items():
        sinks.replace_by_key(df, f"{root}/{name}", new_path(spark, "merge"), key=key, buckets=8)
    return root


def _counted(spark, root, names, key="ticker"):
    counted = [sinks.read_table(spark, f"{root}/{n}").groupBy(key).agg(F.count(F.lit(1)).alias("n")).select(
        F.lit(n).alias("table_name"), key, "n") for n in names]
    return reduce(DataFrame.unionByName, counted)


@query
def replace_keys(spark, d):
    # Of the replaced companies every other one has no new rows and loses its old ones.
    root = _store(spark, {"prices": bridge.prices(spark, d)})
    sk = "cast(substr(ticker, 2) AS bigint)"
    update = _price_update(spark, d)
    sinks.replace_by_key(update.where(f"{sk} % 2 = 1"), f"{root}/prices", new_path(spark, "merge"),
                         keys=update.select("ticker").distinct())
    return sinks.read_table(spark, f"{root}/prices").drop("bucket")


@query
def purge_tickers(spark, d):
    watch = bridge.watchlist(spark, d)
    tables = {"watchlist": watch, "stock_groups": bridge.stock_groups(spark, d), "prices": bridge.prices(spark, d),
              "share_splits": bridge.splits(spark, d), "fundamentals": bridge.fundamentals(spark, d)}
    root = _store(spark, tables)
    sinks.remove_stored_tickers(spark, root, watch.where("NOT supported"), new_path(spark, "purge"), purge=True)
    return _counted(spark, root, tables)


@query
def cascade_rules(spark, d):
    tables = {"alert_rules": _rules(spark), "alert_events": _fired(spark, d)}
    root = _store(spark, tables, "rule_id")
    gone = bridge.table(spark, d, "nation").select(F.expr("cast(n_nationkey % 4 + 2 AS int)").alias("rule_id"))
    sinks.delete_stored_rules(spark, root, gone, new_path(spark, "cascade"))
    return _counted(spark, root, tables, "rule_id")


@query
def run_records(spark, d):
    """Five runs: one loses companies, one is well, one finds nothing changed, one fails and one fails, then is run again."""
    root = new_path(spark, "runs")
    before, after = _marks(spark, d)
    changes = staged(incremental.change_detect(before, after))
    lost = bridge.watchlist(spark, d).where("NOT supported").select("ticker", F.lit("bad payload").alias("reason"))
    steps = iter(range(100))
    clock = lambda: datetime(2003, 1, 1, next(steps))

    def failing(rows: DataFrame) -> None:
        raise ValueError(f"stage failed on {rows.count()} companies")

    write = lambda rows: rows.write.format("noop").mode("overwrite").save()
    still = incremental.change_detect(after, after)
    for run_id, found, failures, stage in ((1, changes, lost, write), (2, changes, lost.limit(0), write),
                                           (3, still, lost.limit(0), write), (4, changes, lost, failing),
                                           (5, changes, lost, failing), (5, changes, lost, write)):
        try:
            runs.record_run(root, run_id, found, failures, stage, clock)
        except ValueError:
            pass  # its record says so
    return runs.run_records(spark, root)


def _marks(spark, d):
    p, f = bridge.prices(spark, d), bridge.fundamentals(spark, d)
    sk = "cast(substr(ticker, 2) AS bigint)"
    before = incremental.high_water_marks(
        p.where(f"{sk} % 2 = 0 OR date < DATE'2001-06-01'"),
        f.where(f"({sk} % 3 = 0 OR filed_at < DATE'2002-01-01') AND {sk} % 5 <> 4"))
    return before, incremental.high_water_marks(p, f)


@query
def change_detect(spark, d):
    return incremental.change_detect(*_marks(spark, d))


@query
def incremental_ratios(spark, d):
    # A first run on what was there before, then one on everything: companies of some keys change in neither.
    p, f, s = bridge.prices(spark, d), bridge.fundamentals(spark, d), bridge.splits(spark, d)
    sk = "cast(substr(ticker, 2) AS bigint)"
    root = new_path(spark, "store")
    old = (p.where(f"{sk} % 2 = 0 OR date < DATE'2001-06-01'").withColumn("close", F.expr(
               f"CASE WHEN {sk} % 7 = 6 AND date = DATE'1999-05-03' THEN close * 1.1D ELSE close END")),
           f.where(f"({sk} % 3 = 0 OR filed_at < DATE'2002-01-01') AND {sk} % 5 <> 4"), s.where("ratio < 10 OR ticker LIKE '%2'"))
    incremental.refresh_ratios(root, *old, buckets=8)
    incremental.refresh_ratios(root, p, f, s)
    return sinks.read_table(spark, f"{root}/ratios").select(*ratios.RATIO_COLUMNS)


@query
def run_audit(spark, d):
    failures = bridge.watchlist(spark, d).where("NOT supported")
    return incremental.run_audit(incremental.change_detect(*_marks(spark, d)), failures,
                                 F.expr("TIMESTAMP_NTZ'2003-01-01 00:00:00'"))


@query
def assign_groups(spark, d):
    requests = bridge.table(spark, d, "supplier").where("s_suppkey % 2 = 0").select(
        bridge.ticker_of("s_suppkey").alias("ticker"),
        F.posexplode(F.expr("array(cast(s_suppkey % 5 + 1 AS int), 10)")).alias("position", "group_id"))
    members, listed = incremental.assign_groups(
        bridge.stock_groups(spark, d), requests, bridge.watchlist(spark, d))
    return members.join(listed.select("ticker", "default_group_id"), "ticker")


# ---- rules -----------------------------------------------------------------------------
RULES = [
    (i, name, scope, "3" if ref else None, metric, cond, threshold, True)
    for i, (name, scope, ref, metric, cond, threshold) in enumerate(registry.DEFAULT_RULES, 1)
] + [
    (7, "One company", "ticker", "s0000000003", "ev_sales", "value_below", 400.0, True),
    (8, "Unknown metric", "all", None, "no_such_metric", "value_below", 1.0, True),
    (9, "Return on equity", "all", None, "roe", "value_above", 0.1, True),
    (10, "Low price to book", "all", None, "pb", "percentile_below", 30.0, True),
    (11, "Paused", "all", None, "fcf_conversion", "value_above", 0.1, False),
]
RULE_DDL = ("rule_id int, name string, scope string, scope_ref string, metric_key string, "
            "condition string, threshold double, enabled boolean")


def _rules(spark):
    return registry.literal_rows(spark, RULES, RULE_DDL)


def _pairs(spark, d):
    return rules.rule_pairs(_rules(spark), bridge.watchlist(spark, d), *_groups(spark, d))


def _sessions(spark, d):
    """Ranked and other metrics are two branches over the ratio rows; staged, the rows are derived once."""
    rows, pairs = _ratios(spark, d), _pairs(spark, d)
    # At most the known metrics.
    asked = [r.metric_key for r in pairs.select("metric_key").distinct().collect() if r.metric_key in rows.columns]
    return rules.rule_sessions(staged(rows.select("ticker", "date", "fundamentals_filed_at", *sorted(asked))), pairs)


def _fired(spark, d):
    """Recorded events of the stream table: a rule, a company, a day, what was seen, read or not."""
    return bridge.table(spark, d, "events").select(
        F.col("event_id"), F.expr("cast(ts AS timestamp_ntz)").alias("created_at"),
        F.expr("cast(event_id % 11 + 1 AS int)").alias("rule_id"),
        bridge.ticker_of("user_id").alias("ticker"), F.to_date("ts").alias("trigger_date"),
        F.expr("CASE WHEN event_id % 3 > 0 THEN 'pe_ttm' END").alias("metric_key"), "value",
        F.expr("CASE WHEN event_id % 4 = 0 THEN value / 2 END").alias("percentile"),
        F.concat_ws(" ", "event_type", "props").alias("detail"),
        F.expr("event_type IN ('view', 'click')").alias("acknowledged"))


@query
def rule_pairs(spark, d):
    return _pairs(spark, d)


@query
def rule_holds(spark, d):
    return rules.rule_holds(_ratios(spark, d), _pairs(spark, d))


@query
def trailing_percentile(spark, d):
    metrics = list(registry.METRICS)
    ranked = rules.trailing_percentile(_ratios(spark, d).select("ticker", "date", *metrics), metrics=metrics)
    return ranked.select("ticker", "date", "metric_key", "value", F.col("pct").alias("percentile"),
                         (F.col("n") >= scalars.RULE_MIN_ROWS).alias("sufficient"))


@query
def edge_trigger(spark, d):
    return rules.edge_trigger(_sessions(spark, d))


# Sessions reach the feed in three parts; the stream stops and starts again between them.
FEED_CUTS = ["1998-01-01", "2000-06-01"]


def _fed(spark, d, run):
    """Runs `run(stream, root)` after each part of the sessions has reached the feed folder; its last result and the root."""
    root = new_path(spark, "stream")
    part = F.lit(0)
    for day in FEED_CUTS:
        part = part + (F.col("session") >= F.lit(day).cast("date")).cast("int")
    sessions = _sessions(spark, d)
    # Written once, a folder per part; a part without a session reaches the feed as an empty table.
    sessions.withColumn("part", F.coalesce(part, F.lit(-1))).write.partitionBy("part").parquet(f"{root}/landed")
    result = None
    for i in range(len(FEED_CUTS) + 1):
        if not sinks.move_path(spark, f"{root}/landed/part={i}", f"{root}/feed/part-{i}"):
            sessions.limit(0).write.parquet(f"{root}/feed/part-{i}")
        feed = spark.readStream.schema(sessions.schema).option("recursiveFileLookup", "true").parquet(f"{root}/feed")
        result = run(feed, root)
    return result, root


@query
def stream_events(spark, d):
    _, root = _fed(spark, d, lambda feed, root: rules_stream.run_events(feed, f"{root}/events", f"{root}/checkpoint"))
    return spark.read.schema(rules_stream.EVENTS).parquet(f"{root}/events")


@query
def stream_state(spark, d):
    _, root = _fed(spark, d, lambda feed, root: rules_stream.run_events(feed, f"{root}/events", f"{root}/checkpoint"))
    return rules_stream.stream_state(spark, f"{root}/checkpoint")


@query
def rule_state(spark, d):
    last, root = _fed(spark, d, lambda feed, root: rules_stream.run_evaluations(feed, root, f"{root}/checkpoint"))
    return rules_stream.read_state(spark, root, last)


@query
def recorded_events(spark, d):
    _, root = _fed(spark, d, lambda feed, root: rules_stream.run_evaluations(feed, root, f"{root}/checkpoint"))
    return rules_stream.read_events(spark, root)


@query
def new_filing(spark, d):
    return rules.new_filing(_ratios(spark, d).select(
        "ticker", F.col("date").alias("session"), F.col("fundamentals_filed_at").alias("marker")))


@query
def event_text(spark, d):
    return rules.event_text(rules.edge_trigger(_sessions(spark, d)), registry.metrics(spark))


@query
def rule_validation(spark, d):
    rows = bridge.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("rule_id"),
        F.expr("CASE WHEN o_orderkey % 50 = 0 THEN ' ' ELSE concat('rule ', o_custkey, ' ', o_orderkey % 5) END").alias("name"),
        F.expr("CASE o_orderkey % 4 WHEN 0 THEN 'all' WHEN 1 THEN 'group' WHEN 2 THEN 'ticker' ELSE 'some' END").alias("scope"),
        F.expr("CASE WHEN o_orderkey % 3 = 0 THEN '5' END").alias("scope_ref"),
        F.expr("CASE WHEN o_orderkey % 6 = 5 THEN 'close' WHEN o_orderkey % 6 = 4 THEN '__primary__' ELSE 'pe_ttm' END").alias("metric_key"),
        F.expr("CASE o_orderkey % 7 WHEN 0 THEN 'new_filing' WHEN 1 THEN 'percentile_below' WHEN 2 THEN 'percentile_above' "
               "WHEN 3 THEN 'value_below' WHEN 4 THEN 'value_above' WHEN 5 THEN 'value_equal' ELSE 'percentile_below' END").alias("condition"),
        F.expr("CASE o_orderkey % 8 WHEN 0 THEN '' WHEN 1 THEN 'abc' WHEN 2 THEN '15d' ELSE cast(cast(o_orderkey % 130 AS int) AS string) END").alias("threshold"))
    return rules.rule_validation(rows, _rules(spark))


@query
def open_events(spark, d):
    return rules.open_events(_fired(spark, d), _rules(spark), limit=50)


@query
def rule_listing(spark, d):
    return rules.rule_listing(_rules(spark), _fired(spark, d), bridge.metric_groups(spark, d))


# ---- checks ----------------------------------------------------------------------------
@query
def check_lookahead(spark, d):
    # Some sessions show a filing of the day after.
    shown = F.expr("CASE WHEN dayofmonth(date) = 15 THEN date_add(date, 1) ELSE fundamentals_filed_at END")
    return checks.check_lookahead(_ratios(spark, d).withColumn("fundamentals_filed_at", shown))


@query
def check_step(spark, d):
    # Revenue moves without a filing on some sessions.
    moved = F.expr("CASE WHEN dayofmonth(date) = 10 THEN revenue_ttm * 1.25D ELSE revenue_ttm END")
    return checks.check_step(_ratios(spark, d).withColumn("revenue_ttm", moved))


@query
def check_identities(spark, d):
    # Enterprise values and earnings multiples are off on some sessions.
    return checks.check_identities(_ratios(spark, d).withColumns({
        "enterprise_value": F.expr("CASE WHEN dayofmonth(date) = 7 THEN enterprise_value * 1.5D ELSE enterprise_value END"),
        "pe_ttm": F.expr("CASE WHEN dayofmonth(date) = 9 THEN pe_ttm * 1.5D ELSE pe_ttm END")}))


@query
def check_negative(spark, d):
    # Multiples have the wrong sign on some sessions.
    turned = lambda c: F.expr(f"CASE WHEN dayofmonth(date) = 3 THEN -{c} ELSE {c} END")
    return checks.check_negative(_ratios(spark, d).withColumns({c: turned(c) for c in ("pe_ttm", "ev_sales", "ev_ebitda")}))


@query
def check_bounds(spark, d):
    # Margins scaled to just around one, so that some rows break the bound.
    rows = _ratios(spark, d).withColumn("gross_margin", F.col("gross_margin") * 2.72)
    return checks.check_bounds(rows)


@query
def check_cliffs(spark, d):
    return checks.check_cliffs(_ratios(spark, d))


@query
def check_freshness(spark, d):
    return checks.check_freshness(_ratios(spark, d), F.expr("DATE'2001-11-01'"))


@query
def check_restated_shares(spark, d):
    filed = bridge.fundamentals(spark, d, SHARES)
    return checks.check_restated_shares(filed, bridge.splits(spark, d))
