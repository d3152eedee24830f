"""Hierarchical revenue tables: rendered rows to labelled lines, subtotals, reconciliation.

A report is one document, so windows over a report's rows are limited by a page's length.
Anything that spans reports or filings is an aggregate or an equi-join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions.scalars import (
    ANNUAL_DAYS, RECONCILE_TOLERANCE, SUBTOTAL_TOLERANCE, close_to)
from tidemark.operators.asof import latest_by

# Patterns and limits of the data source's report layout.
TIERS = [
    "(?i)disaggregat|by type|by market|by product|significant product",
    "(?i)reportable segment|by segment|segment information|operations by segment|"
    "financial information by segment|segment sales|segment revenue",
    "(?i)geograph|by region|by countr",
]
EXCLUDED = (
    "(?i)narrative|parenthetical|\\(tables\\)|long-lived|property and equipment|"
    "performance obligation|unearned|corporate unallocated|by customer|major customer|"
    "segment assets|reconciling item")
DETAIL = "(?i)\\(detail(s)?\\)"
SKIPPED_LABEL = "(?i)\\[line items\\]|\\[abstract\\]|\\[member\\]|\\[domain\\]"
JUNK_START = (
    "segment reporting information|reportable segment|operating segments?|intersegment|"
    "consolidation|elimination")
JUNK = f"(?i)^({JUNK_START})|concentration risk"
JUNK_HEADER = f"(?i)^(?:({JUNK_START})|concentration risk)"
TOTAL_LABEL = "(?i)^\\s*(total|net sales|revenues?)\\s*$"
REVENUE_ROW = "(?i)revenue|net sales|^sales"
MAX_RUN, MIN_LINES, DATE_SLACK_DAYS, CAGR_PERIODS, STALE_DAYS = 8, 2, 5, 3, 395


def report_catalogue(reports: DataFrame) -> DataFrame:
    """Revenue reports of a filing with their preference tier and order.

    `reports` is (filing_id, position, short_name, file). The subject after the last " - "
    decides exclusion, the whole name decides the tier.
    """
    subject = F.element_at(F.split("short_name", " - "), -1)
    tier = (F.when(F.col("short_name").rlike(TIERS[0]), 0)
            .when(F.col("short_name").rlike(TIERS[1]), 1)
            .when(F.col("short_name").rlike(TIERS[2]), 2))
    kept = (reports.where(F.col("short_name").rlike(DETAIL) & ~subject.rlike(EXCLUDED))
            .withColumn("tier", tier).where("tier IS NOT NULL"))
    order = Window.partitionBy("filing_id").orderBy("tier", "position")
    return kept.withColumn("candidate_rank", F.row_number().over(order))


def member_islands(rows: DataFrame) -> DataFrame:
    """Rows of a table with the member they belong to.

    `rows` is (report_id, row_idx, label, values array<double>). A row without values opens a
    member (or none, for boilerplate); value rows belong to the last such row.
    Adds `island`, `member` and `is_header`.
    """
    kept = rows.withColumn("label", F.trim("label")).where(
        (F.col("label") != "") & (F.col("label") != "nan") & ~F.col("label").rlike(SKIPPED_LABEL))
    w = Window.partitionBy("report_id").orderBy("row_idx").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    header = ~F.exists("values", lambda v: v.isNotNull())
    opened = F.when(F.col("is_header"), F.struct(
        F.when(~F.col("label").rlike(JUNK_HEADER), F.col("label")).alias("member")))
    return (
        kept.withColumn("is_header", header)
        .withColumns({"island": F.count_if("is_header").over(w),
                      "member": F.last(opened, ignorenulls=True).over(w)["member"]})
    )


def member_lines(rows: DataFrame, periods: DataFrame) -> DataFrame:
    """(report_id, row_idx, member, period_end, value): the revenue row of each member.

    `periods` is (report_id, scale, periods array<date>). The first row named like revenue
    wins, else the member's first row.
    """
    islands = member_islands(rows).where("NOT is_header AND member IS NOT NULL")
    order = F.struct((~F.col("label").rlike(REVENUE_ROW)).alias("other"), F.col("row_idx").alias("at"))
    chosen = islands.groupBy("report_id", "island").agg(
        F.min_by(F.struct("row_idx", "member", "values"), order).alias("r"))
    return _by_period(chosen.select("report_id", "r.*"), periods, ["row_idx", "member"])


def table_totals(rows: DataFrame, periods: DataFrame) -> DataFrame:
    """(report_id, period_end, total): the last undimensioned total row of each period."""
    totals = member_islands(rows).where("NOT is_header AND member IS NULL").where(
        F.col("label").rlike(TOTAL_LABEL))
    lines = _by_period(totals.select("report_id", "row_idx", "values"), periods, ["row_idx"])
    return lines.groupBy("report_id", "period_end").agg(F.max_by("value", "row_idx").alias("total"))


def _by_period(rows: DataFrame, periods: DataFrame, keep: list[str]) -> DataFrame:
    return (
        rows.join(periods, "report_id")
        .select("report_id", *keep, "scale",
                F.inline(F.arrays_zip(F.col("periods").alias("period_end"), F.col("values").alias("v"))))
        .where("period_end IS NOT NULL AND v IS NOT NULL")
        .select("report_id", *keep, "period_end", (F.col("v") * F.col("scale")).alias("value"))
    )


def split_members(lines: DataFrame) -> DataFrame:
    """Resolve "A | B" members into label and parent per report.

    The side with fewer distinct values is the parent, on the right when both have as many.
    Boilerplate on either side is dropped after the split.
    """
    parts = F.split("member", "\\|", 2)
    piped = F.size(parts) == 2
    sided = lines.withColumns({
        "_left": F.when(piped, F.trim(parts[0])), "_right": F.when(piped, F.trim(parts[1]))})
    sides = sided.where("_left IS NOT NULL").groupBy("report_id").agg(
        F.count_distinct("_left").alias("_nl"), F.count_distinct("_right").alias("_nr"))
    parent_left = F.coalesce(F.col("_nl") < F.col("_nr"), F.lit(False))
    named = sided.join(sides, "report_id", "left").withColumns({
        "label": F.when(F.col("_left").isNull(), F.trim("member"))
        .when(parent_left, F.col("_right")).otherwise(F.col("_left")),
        "parent": F.when(parent_left, F.col("_left")).otherwise(F.col("_right")),
    }).withColumn("parent", F.nullif("parent", F.lit("")))
    return named.where(~F.col("label").rlike(JUNK)
                       & ~F.coalesce(F.col("parent").rlike(JUNK), F.lit(False))).drop(
        "member", "_left", "_right", "_nl", "_nr")


def segment_dedup(lines: DataFrame) -> DataFrame:
    """One line per (report, label, period): the largest amount, the first on ties."""
    order = [F.abs("value").alias("size"), (-F.col("row_idx")).alias("at")]
    return latest_by(lines, ["report_id", "label", "period_end"], order)


def subtotal_parent(lines: DataFrame) -> DataFrame:
    """Flag lines that another line of the report and period names as its parent."""
    keys = ["report_id", "period_end"]
    parents = (lines.where("parent IS NOT NULL")
               .select(*keys, F.col("parent").alias("label"), F.lit(True).alias("_p")).distinct())
    return (lines.join(parents, [*keys, "label"], "left")
            .withColumn("is_parent", F.coalesce("_p", F.lit(False))).drop("_p"))


def subtotal_run(lines: DataFrame) -> DataFrame:
    """Flag lines equal to the sum of the next or previous k siblings, k from 2 to 8.

    Siblings share a parent and are no explicit parents themselves; that list is fixed before
    any run is tested, so each run is one framed sum. Adds `is_subtotal`.
    """
    flagged = lines if "is_parent" in lines.columns else subtotal_parent(lines)
    w = Window.partitionBy("report_id", "period_end", "parent", "is_parent").orderBy("row_idx")
    tests = F.lit(False)
    for k in range(2, MAX_RUN + 1):
        for frame in (w.rowsBetween(1, k), w.rowsBetween(-k, -1)):
            full = F.count("value").over(frame) == k
            tests = tests | (full & close_to(F.sum("value").over(frame), F.col("value"),
                                             SUBTOTAL_TOLERANCE))
    run = (F.col("value") > 0) & ~F.col("is_parent") & tests
    return flagged.withColumn("is_subtotal", F.col("is_parent") | F.coalesce(run, F.lit(False)))


def mark_subtotals(lines: DataFrame) -> DataFrame:
    return subtotal_run(subtotal_parent(lines)).drop("is_parent")


def annual_revenue(facts: DataFrame) -> DataFrame:
    """The facts that give a year's revenue."""
    return facts.where((F.col("concept") == "revenue") & F.col("duration_days").between(*ANNUAL_DAYS))


def range_match(periods: DataFrame, facts: DataFrame) -> DataFrame:
    """Annual revenue whose period ends within five days of each (ticker, period_end), latest
    filed (lowest accession on ties). Eleven-fold day expansion keeps it an equi-join."""
    revenue = annual_revenue(facts).groupBy("ticker", "period_end", "filed_at").agg(
        F.min_by("value", "accession").alias("value"), F.min("accession").alias("accession"))
    near = revenue.select(
        "ticker", F.explode(F.sequence(F.date_sub("period_end", DATE_SLACK_DAYS),
                                       F.date_add("period_end", DATE_SLACK_DAYS))).alias("period_end"),
        "filed_at", "accession", "value")
    # Newest filing first; on one day the lowest accession.
    newest = near.groupBy("ticker", "period_end", "filed_at").agg(
        F.min_by("value", "accession").alias("value")).groupBy("ticker", "period_end").agg(
        F.max_by("value", "filed_at").alias("reported"))
    return periods.join(newest, ["ticker", "period_end"], "left")


def reconcile(lines: DataFrame, facts: DataFrame, totals: DataFrame | None = None) -> DataFrame:
    """Per report and period: do at least two leaves add up to the reported total within 1 %?

    `lines` carries ticker, report_id, period_end, value, is_subtotal. Reported revenue
    outranks the table's own total.
    """
    leaf = F.when(~F.col("is_subtotal"), F.col("value").cast("decimal(28,4)"))
    sums = lines.groupBy("ticker", "report_id", "period_end").agg(
        F.count(leaf).alias("n_leaves"), F.sum(leaf).cast("double").alias("leaf_sum"))
    matched = range_match(sums, facts)
    if totals is not None:
        matched = matched.join(totals, ["report_id", "period_end"], "left")
    else:
        matched = matched.withColumn("total", F.lit(None).cast("double"))
    target = F.coalesce(F.nullif("reported", F.lit(0.0)), F.nullif("total", F.lit(0.0)))
    good = (F.col("n_leaves") >= MIN_LINES) & close_to(
        F.col("leaf_sum"), F.col("target"), RECONCILE_TOLERANCE)
    return matched.withColumn("target", target).select(
        "ticker", "report_id", "period_end", "n_leaves", "leaf_sum", "target",
        F.coalesce(good, F.lit(False)).alias("reconciles"))


def first_reconciling(verdicts: DataFrame, candidates: DataFrame) -> DataFrame:
    """Per filing, the first candidate report with any good period, and its good periods.

    `candidates` is (filing_id, report_id, candidate_rank).
    """
    good = verdicts.where("reconciles").join(candidates, "report_id")
    best = good.groupBy("filing_id").agg(F.min("candidate_rank").alias("candidate_rank"))
    return good.join(best, ["filing_id", "candidate_rank"]).select(
        "filing_id", "report_id", "candidate_rank", "ticker", "period_end")


def latest_filing(segments: DataFrame) -> DataFrame:
    """Lines of the newest filing that covers each (ticker, period)."""
    newest = segments.groupBy("ticker", "period_end").agg(F.max("filed_at").alias("filed_at"))
    return segments.join(newest, ["ticker", "period_end", "filed_at"])


def segment_growth(segments: DataFrame, today: Column) -> DataFrame:
    """Share, yearly growth and three-period CAGR of the lines in each ticker's newest period,
    matched on the label; growth rank, decliner count and staleness."""
    lines = latest_filing(segments.where("NOT is_subtotal"))
    periods = lines.groupBy("ticker", "period_end").agg(
        F.sum(F.col("value").cast("decimal(28,4)")).cast("double").alias("total"),
        F.max("filed_at").alias("filed_at"))
    # One row per fiscal period of a ticker.
    p = Window.partitionBy("ticker").orderBy(F.desc("period_end"))
    ranked = periods.withColumn("k", F.row_number().over(p)).where(F.col("k") <= CAGR_PERIODS + 1)
    at = lambda k: F.max(F.when(F.col("k") == k, F.col("value")))
    newest = lambda c: F.max(F.when(F.col("k") == 1, F.col(c)))
    by_label = (
        lines.select("ticker", "label", "period_end", "value")
        .join(ranked, ["ticker", "period_end"])
        .groupBy("ticker", "label")
        .agg(at(1).alias("latest"), at(2).alias("prior"), at(CAGR_PERIODS + 1).alias("base"),
             newest("total").alias("total"), newest("period_end").alias("latest_period"),
             newest("filed_at").alias("filed_at"))
        .where("latest IS NOT NULL"))
    grown = by_label.select(
        "ticker", "label", "latest_period", "filed_at", "latest",
        F.when(F.col("total") != 0, F.col("latest") / F.col("total")).alias("share"),
        F.when(F.col("prior") != 0, F.col("latest") / F.col("prior") - 1).alias("yoy"),
        F.when(F.col("base") > 0, F.pow(F.col("latest") / F.col("base"), F.lit(1.0) / CAGR_PERIODS) - 1)
        .alias("cagr"),
        (F.datediff(today, "filed_at") > STALE_DAYS).alias("stale"))
    w = Window.partitionBy("ticker")
    order = w.orderBy(F.desc_nulls_last("yoy"), F.desc("latest"), "label")
    return grown.withColumns({"growth_rank": F.row_number().over(order),
                              "declining": F.count_if(F.col("yoy") < 0).over(w)})


def segment_series(segments: DataFrame) -> DataFrame:
    """(ticker, label, period_end, value): every label of a ticker's newest period at all of its periods,
    null where a period has no such line."""
    lines = latest_filing(segments.where("NOT is_subtotal")).groupBy("ticker", "label", "period_end").agg(
        F.max("value").alias("value"))
    newest = lines.groupBy("ticker").agg(F.max("period_end").alias("period_end"))
    current = lines.join(newest, ["ticker", "period_end"], "left_semi").select("ticker", "label")
    grid = current.join(lines.select("ticker", "period_end").distinct(), "ticker")  # labels x years of one ticker
    return grid.join(lines, ["ticker", "label", "period_end"], "left")


def segment_coverage(segments: DataFrame, watchlist: DataFrame, facts: DataFrame) -> DataFrame:
    """Per supported ticker: periods, lines, first and last period, and periods whose leaves
    are over one percent off reported revenue, and the newest period's labels. Zero periods where nothing
    was published."""
    newest = segments.groupBy("ticker").agg(F.max("period_end").alias("period_end"))
    labels = segments.where("NOT is_subtotal").join(newest, ["ticker", "period_end"], "left_semi").groupBy("ticker").agg(
        F.array_join(F.sort_array(F.collect_set("label")), ", ").alias("newest_labels"))
    lines = segments.groupBy("ticker").agg(
        F.count_distinct("period_end").alias("periods"), F.count(F.lit(1)).alias("lines"),
        F.min("period_end").alias("first_period"), F.max("period_end").alias("last_period"))
    leaves = latest_filing(segments.where("NOT is_subtotal")).groupBy("ticker", "period_end").agg(
        F.sum(F.col("value").cast("decimal(28,4)")).cast("double").alias("parsed"))
    drift = F.abs(F.col("parsed") - F.col("reported")) / F.col("reported") * 100
    bad = range_match(leaves, facts).where("reported <> 0").groupBy("ticker").agg(
        F.count_if(drift > 1.0).alias("mismatched"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return (watchlist.where("supported").select("ticker").join(lines, "ticker", "left")
            .join(bad, "ticker", "left").join(labels, "ticker", "left")
            .select("ticker", zero("periods"), zero("lines"), "first_period", "last_period",
                    zero("mismatched"), "newest_labels"))


def segment_violations(segments: DataFrame) -> DataFrame:
    """Leaf lines that are totals, boilerplate, or off the plausible revenue scale."""
    size = F.abs("value")
    reasons = F.array_compact(F.array(
        F.when(~F.col("is_subtotal") & F.col("label").startswith("Total"), "total as leaf"),
        F.when(F.col("label").rlike("(?i)^(segment reporting information|reportable segment,)|"
                                    "concentration risk"), "boilerplate"),
        F.when((size > 0) & ~size.between(1e6, 1e12), "scale")))
    return segments.select("ticker", "label", "period_end", "value",
                           F.array_join(reasons, ", ").alias("reason")).where("reason <> ''")
