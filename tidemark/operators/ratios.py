"""The daily ratio table: filing states attached to prices, then one row of ratios per day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.scalars import safe_div, safe_div_pos, zero_if_null
from tidemark.operators.asof import asof_attach, value_days_back
from tidemark.operators.state import company_states

# Columns of a ratio row.
RATIO_COLUMNS = [
    "ticker", "date", "close", "market_cap", "enterprise_value", "shares_diluted", "pe_ttm",
    "ps_ttm", "pb", "ev_ebitda", "ev_sales", "ev_fcf", "fcf_yield", "earnings_yield",
    "gross_margin", "operating_margin", "net_margin", "fcf_margin", "fcf_conversion", "roic",
    "roe", "net_debt", "net_debt_ebitda", "interest_coverage", "revenue_ttm",
    "revenue_growth_yoy", "inventory_days", "sbc_pct_revenue", "capex_pct_revenue",
    "fundamentals_filed_at",
]
# Tax rate where it cannot be measured, and its ceiling.
DEFAULT_TAX, MAX_TAX = 0.21, 0.5
GROWTH_LOOKBACK_DAYS = 365

_STATE_INPUTS = [
    "filed_at", "revenue", "net_income", "fcf", "ebit", "ebitda", "gross_profit", "pretax_income",
    "income_tax", "total_equity", "total_debt", "cash", "net_debt", "interest_expense",
    "inventory", "cost_of_revenue", "stock_based_compensation", "capex", "shares_final",
]


def roic() -> Column:
    """After-tax EBIT over invested capital."""
    c = F.col
    measured = F.least(F.greatest(c("income_tax") / c("pretax_income"), F.lit(0.0)), F.lit(MAX_TAX))
    tax = F.when((c("pretax_income") > 0) & c("income_tax").isNotNull(), measured).otherwise(DEFAULT_TAX)
    invested = c("total_equity") + c("total_debt") - zero_if_null(c("cash"))
    return safe_div_pos(c("ebit") * (1 - tax), invested)


def ratio_columns() -> dict[str, Column]:
    """Column expressions of a ratio row, given a state and `close`, `market_cap`, `ev`."""
    c = F.col
    cap, ev, positive_ev = c("market_cap"), c("ev"), F.when(c("ev") > 0, c("ev"))
    return {
        "enterprise_value": ev,
        "shares_diluted": c("shares_final"),
        "pe_ttm": safe_div_pos(cap, c("net_income")),
        "ps_ttm": safe_div_pos(cap, c("revenue")),
        "pb": safe_div_pos(cap, c("total_equity")),
        "ev_ebitda": safe_div_pos(positive_ev, c("ebitda")),
        "ev_sales": safe_div_pos(positive_ev, c("revenue")),
        "ev_fcf": safe_div_pos(positive_ev, c("fcf")),
        "fcf_yield": safe_div(c("fcf"), cap),
        "earnings_yield": safe_div(c("net_income"), cap),
        "gross_margin": safe_div(c("gross_profit"), c("revenue")),
        "operating_margin": safe_div(c("ebit"), c("revenue")),
        "net_margin": safe_div(c("net_income"), c("revenue")),
        "fcf_margin": safe_div(c("fcf"), c("revenue")),
        "fcf_conversion": safe_div_pos(c("fcf"), c("net_income")),
        "roic": roic(),
        "roe": safe_div_pos(c("net_income"), c("total_equity")),
        "net_debt_ebitda": safe_div_pos(c("net_debt"), c("ebitda")),
        "interest_coverage": safe_div_pos(c("ebit"), c("interest_expense")),
        "revenue_ttm": c("revenue"),
        "inventory_days": safe_div(c("inventory"), c("cost_of_revenue") / F.lit(365.0)),
        "sbc_pct_revenue": safe_div_pos(c("stock_based_compensation"), c("revenue")),
        "capex_pct_revenue": safe_div_pos(c("capex"), c("revenue")),
        "fundamentals_filed_at": c("filed_at"),
    }


def yoy_growth(rows: DataFrame) -> DataFrame:
    """Revenue growth against the session 365 days earlier, or the last before it."""
    prior, now = F.col("_prior"), F.col("revenue_ttm")
    return (
        value_days_back(rows, "revenue_ttm", GROWTH_LOOKBACK_DAYS, "_prior")
        .withColumn("revenue_growth_yoy", F.when((prior > 0) & (now != 0), now / prior - 1))
        .drop("_prior")
    )


def ratio_values(prices: DataFrame, states: DataFrame) -> DataFrame:
    """Ratios without growth for every session on or after a company's first filing; `_t` is the day's number."""
    c = F.col
    days = asof_attach(prices.select("ticker", "date", "close"),
                       states.select("ticker", "as_of", *_STATE_INPUTS))
    valued = days.withColumn(
        "market_cap", F.when(c("shares_final") != 0, c("shares_final") * c("close"))
    ).withColumn("ev", c("market_cap") + c("net_debt"))
    return valued.select("ticker", "date", "_t", "close", "market_cap", "net_debt",
                         *[v.alias(k) for k, v in ratio_columns().items()])


def ratio_rows(prices: DataFrame, states: DataFrame) -> DataFrame:
    """Ratios for every session on or after a company's first filing."""
    return yoy_growth(ratio_values(prices, states)).select(*RATIO_COLUMNS)


def ratios_daily(prices: DataFrame, facts: DataFrame, splits: DataFrame) -> DataFrame:
    """All companies in one plan; companies without prices or facts yield no rows."""
    return ratio_rows(prices, company_states(facts, splits))
