"""Filing states: what was known about a company on each of its filing dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions.scalars import ANNUAL_DAYS, LOOSE_YEAR_DAYS, QUARTER_DAYS, zero_if_null
from tidemark.operators.shares import factor_after, reconcile_shares, splits_by_ticker
from tidemark.registry import FLOWS, SHARES, STOCKS

DURATIONS = FLOWS + ["shares_diluted"]
MARKER = "_other"
INSTANTS = STOCKS + ["shares_outstanding", "shares_outstanding_gaap"]


def filing_grid(facts: DataFrame) -> DataFrame:
    """(ticker, as_of): the only dates on which a company's picture changes."""
    return facts.select("ticker", F.col("filed_at").alias("as_of")).distinct()


def shuffle_width(df: DataFrame) -> int:
    """The session's shuffle width. Derivation is heavy per byte, so its one shuffle by ticker
    keeps this width instead of being coalesced by data size."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _kind(days: str = "duration_days") -> Column:
    d = F.col(days)
    return (F.when(d == 0, "I").when(d.between(*QUARTER_DAYS), "Q")
            .when(d.between(*ANNUAL_DAYS), "A"))


def _histories(facts: DataFrame) -> DataFrame:
    """(ticker, concept, versions, dates): a concept's versions by filing date, and all filing dates of its ticker.

    One shuffle by ticker serves every later step. An array holds one company's facts of one concept.
    Facts no state uses still put their filing date on the grid: they travel as a marker.
    """
    kind = _kind()
    used = ((F.col("concept").isin(DURATIONS) & kind.isin("Q", "A"))
            | (F.col("concept").isin(INSTANTS) & (kind == "I")))
    named = F.col("accession").isNotNull()
    version = F.struct(
        "filed_at", "period_end", "period_start", "duration_days", (~named).alias("unnamed"), "accession",
        F.when(named, F.col("value")).alias("value"), (used & (kind == "A")).alias("annual"))
    # Facts move as they are: what is derived of them would be computed over and over below the shuffle.
    moved = facts.select("ticker", "concept", "period_start", "period_end", "duration_days", "filed_at", "accession",
                         "value").where("filed_at IS NOT NULL").repartition(shuffle_width(facts), "ticker")
    marked = moved.select(
        "ticker", F.when(used, F.col("concept")).otherwise(MARKER).alias("concept"), version.alias("v"))
    # Hashes lead the sort keys: names share long prefixes, hashes differ in the first byte.
    grouped = (
        marked.groupBy(F.xxhash64("ticker", "concept").alias("_g"), "ticker", "concept")
        .agg(F.sort_array(F.collect_list("v")).alias("versions")))
    company = Window.partitionBy(F.xxhash64("ticker"), "ticker")
    days = F.flatten(F.collect_list(F.array_distinct("versions.filed_at")).over(company))
    return grouped.select("ticker", "concept", "versions", F.sort_array(F.array_distinct(days)).alias("dates"))


_ROW = "struct<period_end:date,filed_at:date,duration_days:int,value:double,period_start:date>"


def _snapshots(versions: Column) -> Column:
    """Array of (day, top, year, until): what of a concept is public from a filing date to its next one.

    `top` holds the newest version of each of the four last quarters or balances, newest first, `year` that of the
    last year. A version enters on its filing date and replaces the one of its period; what leaves the first four
    cannot return, as periods before it only grow newer. Of same-day versions the lowest accession counts.
    """
    def same(x: Column, y: Column) -> Column:
        return (x["period_end"].eqNullSafe(y["period_end"]) & x["period_start"].eqNullSafe(y["period_start"])
                & x["duration_days"].eqNullSafe(y["duration_days"]))

    def snapshot(acc: Column, until: Column) -> Column:
        return F.array_append(acc["out"], F.struct(
            acc["at"]["filed_at"].alias("day"), acc["top"].alias("top"), acc["year"].alias("year"), until.alias("until")))

    def step(acc: Column, v: Column) -> Column:
        row = F.struct(*[v[f].alias(f) for f in ("period_end", "filed_at", "duration_days", "value", "period_start")])
        later = acc["at"]["filed_at"] < v["filed_at"]
        again = acc["at"]["filed_at"].eqNullSafe(v["filed_at"]) & same(acc["at"], v)
        others = F.filter(acc["top"], lambda x: ~same(x, v))
        newest = v["period_end"] > F.get(acc["top"], F.lit(0))["period_end"]
        top = F.when(again | v["annual"], acc["top"]).when(newest, F.slice(F.concat(F.array(row), acc["top"]), 1, 4)).otherwise(
            F.slice(F.sort_array(F.array_append(others, row), asc=False), 1, 4))
        year = F.when(v["annual"] & ~again, F.greatest(acc["year"], row)).otherwise(acc["year"])
        return F.struct(row.alias("at"), top.alias("top"), year.alias("year"),
                        F.when(later, snapshot(acc, v["filed_at"])).otherwise(acc["out"]).alias("out"))

    none = F.lit(None)
    start = F.struct(
        none.cast(_ROW).alias("at"), F.array().cast(f"array<{_ROW}>").alias("top"), none.cast(_ROW).alias("year"),
        F.array().cast(f"array<struct<day:date,top:array<{_ROW}>,year:{_ROW},until:date>>").alias("out"))
    return F.aggregate(versions, start, step, lambda acc: snapshot(acc, none.cast("date")))


def concept_values(facts: DataFrame, since: DataFrame | None = None) -> DataFrame:
    """(ticker, as_of, concept, value, filed_at): trailing twelve months for flows, latest
    balance for instants, latest quarter (else year) for diluted shares.

    Rows grow with a concept's filing dates, not with facts x dates. `since` (ticker, since_filed) leaves out
    earlier dates.
    """
    c = F.col
    public = _histories(facts).select("ticker", "concept", "dates", F.inline(_snapshots(c("versions"))))
    q = [F.get("top", F.lit(i)) for i in range(4)]
    # Oldest to newest, so the floating-point sum has one defined order.
    q_sum = q[3]["value"] + q[2]["value"] + q[1]["value"] + q[0]["value"]
    q_filed = F.greatest(*[x["filed_at"] for x in q])
    span = F.datediff(q[0]["period_end"], q[3]["period_start"])
    exact, loose = span.between(*ANNUAL_DAYS), span.between(*LOOSE_YEAR_DAYS)
    head = F.coalesce(q[0], "year")

    def choose(field: str, quarters: Column) -> Column:
        return (F.when(~c("concept").isin(FLOWS), head[field]).when(exact, quarters)
                .when(c("year").isNotNull(), c(f"year.{field}")).when(loose, quarters))

    # Both ends are filing dates of the ticker, so they are places in its list of dates.
    end = F.coalesce(F.array_position("dates", c("until")), F.size("dates") + 1)
    placed = public.select(
        "ticker", "concept", "dates", choose("value", q_sum).alias("value"), choose("filed_at", q_filed).alias("filed_at"),
        F.array_position("dates", c("day")).cast("int").alias("start_at"), end.cast("int").alias("end_at"))
    if since is not None:
        earlier = F.size(F.filter("dates", lambda day: day < c("since_filed")))
        placed = placed.join(since, "ticker").withColumn("start_at", F.greatest("start_at", earlier + 1)).where(
            "start_at < end_at")
    return placed.select(
        "ticker", F.explode(F.slice("dates", c("start_at"), c("end_at") - c("start_at"))).alias("as_of"),
        "concept", "value", "filed_at")


def filing_state(facts: DataFrame, splits: DataFrame, since: DataFrame | None = None) -> DataFrame:
    """Wide row per (ticker, as_of): flows, balances, split-normalised share counts,
    `filed_at` of the newest input, and `filed_<concept>` where a later choice needs it."""
    at = lambda c, field: F.max(F.when(F.col("concept") == c, F.col(field)))
    dated = ["depreciation_amortization", "depreciation_expense", "amortisation_expense"]
    wide = concept_values(facts, since).groupBy("ticker", "as_of").agg(
        F.max(F.when(F.col("concept") != MARKER, F.col("filed_at"))).alias("filed_at"),
        *[at(c, "value").alias(c) for c in FLOWS + STOCKS + SHARES],
        *[at(c, "filed_at").alias(f"filed_{c}") for c in dated],
        *[at(c, "filed_at").alias(f"_from_{c}") for c in SHARES])
    # Splits meet one row per filing date.
    return wide.join(splits_by_ticker(splits), "ticker", "left").withColumns({
        c: F.col(c) * factor_after(F.col("splits"), F.col(f"_from_{c}")) for c in SHARES
    }).drop("splits", *[f"_from_{c}" for c in SHARES])


def derived_concepts(states: DataFrame) -> DataFrame:
    """Concepts with no direct tag: gross profit, D&A choice, EBIT, EBITDA, FCF, debt."""
    c = F.col
    parts = F.when(
        c("depreciation_expense").isNotNull() | c("amortisation_expense").isNotNull(),
        zero_if_null(c("depreciation_expense")) + zero_if_null(c("amortisation_expense")))
    never = F.lit("0001-01-01").cast("date")
    parts_filed = F.greatest(F.coalesce(c("filed_depreciation_expense"), never),
                             F.coalesce(c("filed_amortisation_expense"), never))
    newer = parts_filed > F.coalesce(c("filed_depreciation_amortization"), never)
    combined = c("depreciation_amortization")
    da = F.when(combined.isNull() | (parts.isNotNull() & newer), parts).otherwise(combined)
    no_debt_line = c("long_term_debt").isNull() & c("short_term_debt").isNull()
    balance_sheet = c("total_assets").isNotNull() | c("cash").isNotNull()
    debt = (F.when(no_debt_line, F.when(balance_sheet, F.lit(0.0)))
            .otherwise(zero_if_null(c("long_term_debt")) + zero_if_null(c("short_term_debt"))))
    return states.withColumns({
        "gross_profit": F.coalesce(c("gross_profit"), c("revenue") - c("cost_of_revenue")),
        "depreciation_amortization": da,
        "ebit": F.coalesce(c("operating_income"), c("pretax_income") + c("interest_expense"),
                           c("pretax_income")),
        "fcf": c("operating_cash_flow") - c("capex"),
        "total_debt": debt,
    }).withColumns({
        "ebitda": c("ebit") + c("depreciation_amortization"),
        "net_debt": c("total_debt") - (zero_if_null(c("cash"))
                                       + zero_if_null(c("short_term_investments"))),
    })


def company_states(facts: DataFrame, splits: DataFrame, since: DataFrame | None = None,
                   seed: DataFrame | None = None) -> DataFrame:
    """Filing states with derived concepts and the reconciled share count `shares_final`.

    With `since` (ticker, since_filed) only the states from there on; `seed` (ticker, seed) are the counts before.
    """
    return reconcile_shares(derived_concepts(filing_state(facts, splits, since)), seed=seed)
