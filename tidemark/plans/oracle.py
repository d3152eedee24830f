"""Independent ANSI SQL for every query, composed from named common table expressions.

Where an operator uses windows, arrays or aggregates, the SQL takes another route: a range
join against the grid, a correlated match, a recursive walk.
"""

from __future__ import annotations

import re

from tidemark import registry
from tidemark.sources import bridge

CTES: dict[str, str] = {}


def _sql_literal(expr: str) -> str:
    return re.sub(r"(\d(?:\.\d+)?)D\b", r"\1::DOUBLE", expr)


def _values(rows: list[tuple]) -> str:
    def one(v):
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return "true" if v else "false"
        if isinstance(v, str):
            return "'" + v.replace("'", "''") + "'"
        return f"{v!r}::DOUBLE" if isinstance(v, float) else str(v)
    return ", ".join("(" + ", ".join(one(v) for v in r) + ")" for r in rows)


def compose(final: str) -> str:
    """Prefix `final` with the expressions it names, directly or through others."""
    order: list[str] = []

    def need(text: str) -> None:
        for name in CTES:
            if name not in order and re.search(rf"\b{name}\b", text):
                body = CTES[name].replace(name, "", 1) if name == "x_shares" else CTES[name]
                need_inner(name, body)

    def need_inner(name: str, body: str) -> None:
        for other in CTES:
            if other != name and other not in order and re.search(rf"\b{other}\b", body):
                need_inner(other, CTES[other])
        if name not in order:
            order.append(name)

    need(final)
    if not order:
        return final
    parts = ",\n".join(f"{n} AS {'' if n in RECURSIVE else 'MATERIALIZED '}({CTES[n]})"
                       for n in order)
    return f"WITH RECURSIVE {parts}\n{final}"


RECURSIVE = {"x_walk"}

TICKER = "'S' || lpad(CAST({0} AS VARCHAR), CAST(greatest(10, length(CAST({0} AS VARCHAR))) AS INTEGER), '0')"
BETWEEN_Q = "BETWEEN 80 AND 100"
BETWEEN_A = "BETWEEN 340 AND 380"

CTES["b_prices"] = f"""
SELECT {TICKER.format('l_suppkey')} AS ticker, CAST(l_shipdate AS DATE) AS date,
       CAST(sum(CAST(l_extendedprice AS DECIMAL(18,4))) AS DOUBLE) / sum(l_quantity) AS close,
       CAST(sum(l_quantity) AS BIGINT) AS volume
FROM lineitem GROUP BY 1, 2"""

CTES["b_lines"] = """
SELECT l_suppkey AS sk, CAST(date_trunc('quarter', l_shipdate) AS DATE) AS q_start,
       CAST(date_trunc('year', l_shipdate) AS DATE) AS y_start, l_linestatus AS status,
       CAST(l_extendedprice AS DECIMAL(18,4)) AS ep,
       CAST(l_extendedprice * l_discount AS DECIMAL(18,4)) AS ed,
       CAST(l_extendedprice * l_tax AS DECIMAL(18,4)) AS et, l_quantity AS q
FROM lineitem"""

_sums = ("CAST(sum(ep) AS DOUBLE) AS s0, CAST(sum(ed) AS DOUBLE) AS sd, "
         "CAST(sum(et) AS DOUBLE) AS st, sum(q) AS q")
CTES["b_sums"] = f"""
SELECT sk, 'Q-orig' AS kind, q_start AS ps, {_sums} FROM b_lines WHERE status = 'F' GROUP BY 1, 3
UNION ALL SELECT sk, 'Q-restated', q_start, {_sums} FROM b_lines GROUP BY 1, 3
UNION ALL SELECT sk, 'FY', y_start, {_sums} FROM b_lines GROUP BY 1, 3"""

_flow = [
    f"SELECT sk, '{c}' AS concept, false AS instant, kind, ps, {_sql_literal(v)} AS value "
    f"FROM b_sums WHERE {_sql_literal(w)}" for c, (v, w) in bridge._FLOW_VALUES.items()]
_instant = [
    f"SELECT sk, '{c}', true, kind, ps, {_sql_literal(v)} FROM b_sums "
    f"WHERE kind = 'Q-restated' AND ({_sql_literal(w)})"
    for c, (v, w) in bridge._INSTANT_VALUES.items()]
CTES["b_values"] = "\nUNION ALL ".join(_flow + _instant).replace("DATE'", "DATE '")

CTES["b_facts"] = f"""
SELECT {TICKER.format('sk')} AS ticker, concept,
       CASE WHEN instant THEN NULL ELSE ps END AS period_start, period_end,
       CASE WHEN instant THEN 0 ELSE CAST(datediff('day', ps, period_end) AS INTEGER) END
           AS duration_days,
       CAST(CASE WHEN kind = 'FY' THEN ps + INTERVAL 14 MONTH
                 WHEN kind = 'Q-orig' OR instant THEN ps + INTERVAL 4 MONTH
                 ELSE ps + INTERVAL 7 MONTH END AS DATE) AS filed_at,
       CASE WHEN instant THEN 'Q-orig' ELSE kind END AS accession,
       CASE WHEN kind = 'FY' THEN '10-K' ELSE '10-Q' END AS form, 'USD' AS unit, value
FROM (SELECT *, CAST(ps + CASE WHEN kind = 'FY' THEN INTERVAL 12 MONTH ELSE INTERVAL 3 MONTH END
                     - INTERVAL 1 DAY AS DATE) AS period_end FROM b_values)"""

CTES["b_splits"] = f"""
SELECT {TICKER.format('s_suppkey')} AS ticker,
       CAST(DATE '1997-01-01' + INTERVAL 1 MONTH * CAST(s_suppkey * 13 % 48 AS INT) AS DATE) AS date,
       CASE s_suppkey % 3 WHEN 0 THEN 2::DOUBLE ELSE 4::DOUBLE END AS ratio
FROM supplier WHERE s_suppkey % 3 < 2
UNION ALL SELECT {TICKER.format('s_suppkey')}, DATE '2001-06-01', 10::DOUBLE
FROM supplier WHERE s_suppkey % 6 = 0"""

CTES["b_watchlist"] = f"""
SELECT {TICKER.format('s_suppkey')} AS ticker, s_name AS name, s_suppkey AS cik,
       CASE WHEN s_suppkey % 9 <> 8 THEN n_regionkey + 1 END AS default_group_id,
       s_suppkey % 17 <> 5 AS supported,
       CASE WHEN s_suppkey % 2 = 1 THEN s_acctbal END AS added_price
FROM supplier JOIN nation ON s_nationkey = n_nationkey"""

CTES["b_stock_groups"] = f"""
SELECT {TICKER.format('s_suppkey')} AS ticker, n_regionkey + 1 AS group_id
FROM supplier JOIN nation ON s_nationkey = n_nationkey
UNION ALL SELECT {TICKER.format('s_suppkey')}, 10 FROM supplier
JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 3 = 0"""

_profiles = [(i, p, registry.PROFILES[p][0]) for i, p in enumerate(registry.PROFILES)]
CTES["b_metric_groups"] = f"""
SELECT group_id, name, profile, primary_multiple
FROM (SELECT r_regionkey + 1 AS group_id, r_name AS name FROM region
      UNION ALL SELECT 10, 'CROSS SECTION') g
JOIN (VALUES {_values(_profiles)}) p(slot, profile, primary_multiple)
  ON (group_id - 1) % 4 = slot"""

_pm = []
for _p, (_m, _s) in registry.PROFILES.items():
    for _i, (_sec, _k) in enumerate([(s, k) for s, ks in _s.items() for k in ks]):
        _pm.append((_p, _k, _sec, _i))
CTES["b_group_metrics"] = f"""
SELECT group_id, metric_key, section, sort_order FROM b_metric_groups
JOIN (VALUES {_values(_pm)}) m(profile, metric_key, section, sort_order) USING (profile)"""

CTES["m_metrics"] = (
    "SELECT * FROM (VALUES " + _values([(k, *v) for k, v in registry.METRICS.items()])
    + ") t(metric_key, label, fmt, section, peer_comparable)")

CTES["b_leaf"] = f"""
SELECT {TICKER.format('l_suppkey')} AS ticker,
       CAST(date_trunc('year', l_shipdate) + INTERVAL 12 MONTH - INTERVAL 1 DAY AS DATE) AS period_end,
       CAST(date_trunc('year', l_shipdate) + INTERVAL 14 MONTH AS DATE) AS filed_at,
       p_type AS label, sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4)))
         * CASE WHEN l_suppkey % 5 = 0 AND p_type = 'PROMO' THEN 2 ELSE 1 END AS v
FROM lineitem JOIN part ON l_partkey = p_partkey
GROUP BY 1, 2, 3, 4, l_suppkey"""
CTES["b_segments"] = """
SELECT ticker, period_end, filed_at, label, CAST(NULL AS VARCHAR) AS parent,
       CAST(v AS DOUBLE) AS value,
       CASE label WHEN 'ECONOMY' THEN 1 WHEN 'LARGE' THEN 2 WHEN 'MEDIUM' THEN 3
                  WHEN 'PROMO' THEN 5 WHEN 'SMALL' THEN 6 ELSE 7 END AS row_idx FROM b_leaf
UNION ALL SELECT ticker, period_end, filed_at, 'GROUP_A', NULL, CAST(sum(v) AS DOUBLE), 4
FROM b_leaf WHERE label IN ('ECONOMY', 'LARGE', 'MEDIUM') GROUP BY 1, 2, 3"""

# ---- point in time ---------------------------------------------------------------------
CTES["x_grid"] = "SELECT DISTINCT ticker, filed_at AS as_of FROM b_facts"
CTES["x_versions"] = """
SELECT ticker, concept, period_start, period_end, duration_days, filed_at,
       arg_min(value, accession) AS value, min(accession) AS accession
FROM b_facts GROUP BY ALL"""
CTES["x_visible"] = """
SELECT g.ticker, g.as_of, v.concept, v.period_start, v.period_end, v.duration_days, v.filed_at,
       v.accession, v.value
FROM x_grid g JOIN x_versions v ON v.ticker = g.ticker AND v.filed_at <= g.as_of
QUALIFY row_number() OVER (
    PARTITION BY g.ticker, g.as_of, v.concept, v.period_start, v.period_end, v.duration_days
    ORDER BY v.filed_at DESC) = 1"""
CTES["x_quarters"] = f"""
SELECT *, row_number() OVER (PARTITION BY ticker, as_of, concept
           ORDER BY period_end DESC, filed_at DESC, duration_days DESC) AS rn
FROM x_visible WHERE duration_days {BETWEEN_Q}"""
CTES["x_four"] = """
SELECT ticker, as_of, concept, count(*) = 4 AS four,
       max(CASE WHEN rn = 1 THEN value END) AS newest,
       max(CASE WHEN rn = 1 THEN filed_at END) AS newest_filed,
       datediff('day', max(CASE WHEN rn = 4 THEN period_start END),
                max(CASE WHEN rn = 1 THEN period_end END)) AS span,
       max(CASE WHEN rn = 4 THEN value END) + max(CASE WHEN rn = 3 THEN value END)
       + max(CASE WHEN rn = 2 THEN value END) + max(CASE WHEN rn = 1 THEN value END) AS total,
       max(filed_at) AS filed_at
FROM x_quarters WHERE rn <= 4 GROUP BY 1, 2, 3"""
CTES["x_annual"] = f"""
SELECT ticker, as_of, concept, value, filed_at FROM x_visible
WHERE duration_days {BETWEEN_A}
QUALIFY row_number() OVER (PARTITION BY ticker, as_of, concept
    ORDER BY period_end DESC, filed_at DESC, duration_days DESC) = 1"""
CTES["x_instant"] = """
SELECT ticker, as_of, concept, value, filed_at FROM x_visible WHERE duration_days = 0
QUALIFY row_number() OVER (PARTITION BY ticker, as_of, concept
    ORDER BY period_end DESC, filed_at DESC) = 1"""
CTES["x_ttm"] = """
SELECT ticker, as_of, concept,
       CASE WHEN four AND span BETWEEN 340 AND 380 THEN total
            WHEN a.value IS NOT NULL THEN a.value
            WHEN four AND span BETWEEN 300 AND 420 THEN total END AS value,
       CASE WHEN four AND span BETWEEN 340 AND 380 THEN q.filed_at
            WHEN a.value IS NOT NULL THEN a.filed_at
            WHEN four AND span BETWEEN 300 AND 420 THEN q.filed_at END AS filed_at
FROM x_four q FULL JOIN x_annual a USING (ticker, as_of, concept)"""
CTES["x_factor"] = """
SELECT f.ticker, f.filed_at, coalesce(product(s.ratio), 1) AS factor
FROM (SELECT DISTINCT ticker, filed_at FROM b_facts) f
LEFT JOIN b_splits s ON s.ticker = f.ticker AND s.date > f.filed_at GROUP BY 1, 2"""
CTES["x_share_source"] = """
SELECT ticker, as_of, concept, coalesce(q.newest, a.value) AS value,
       coalesce(q.newest_filed, a.filed_at) AS filed_at
FROM (SELECT * FROM x_four WHERE concept = 'shares_diluted') q
FULL JOIN (SELECT * FROM x_annual WHERE concept = 'shares_diluted') a USING (ticker, as_of, concept)
UNION ALL SELECT ticker, as_of, concept, value, filed_at FROM x_instant
WHERE concept IN ('shares_outstanding', 'shares_outstanding_gaap')"""
_in = lambda cs: ", ".join(f"'{c}'" for c in cs)
CTES["x_inputs"] = f"""
SELECT ticker, as_of, concept, value, filed_at FROM x_ttm WHERE concept IN ({_in(registry.FLOWS)})
UNION ALL SELECT * FROM x_instant WHERE concept IN ({_in(registry.STOCKS)})
UNION ALL SELECT s.ticker, s.as_of, s.concept, s.value * f.factor, s.filed_at
FROM x_share_source s JOIN x_factor f USING (ticker, filed_at)"""
_wide = ", ".join(
    f"max(CASE WHEN concept = '{c}' THEN value END) AS {c}"
    for c in registry.FLOWS + registry.STOCKS + registry.SHARES)
_dated = ["depreciation_amortization", "depreciation_expense", "amortisation_expense"]
_filed = ", ".join(f"max(CASE WHEN concept = '{c}' THEN i.filed_at END) AS filed_{c}" for c in _dated)
CTES["x_state"] = f"""
SELECT g.ticker, g.as_of, max(i.filed_at) AS filed_at, {_wide}, {_filed}
FROM x_grid g LEFT JOIN x_inputs i USING (ticker, as_of) GROUP BY 1, 2"""
CTES["x_derived"] = """
SELECT *, ebit + da AS ebitda, total_debt - liquid AS net_debt FROM (
  SELECT *,
    coalesce(gross_profit, revenue - cost_of_revenue) AS gp,
    CASE WHEN depreciation_amortization IS NULL THEN parts
         WHEN parts IS NOT NULL AND parts_filed >
              coalesce(filed_depreciation_amortization, DATE '0001-01-01') THEN parts
         ELSE depreciation_amortization END AS da,
    CASE WHEN operating_income IS NOT NULL THEN operating_income
         WHEN pretax_income IS NOT NULL AND interest_expense IS NOT NULL
           THEN pretax_income + interest_expense ELSE pretax_income END AS ebit,
    operating_cash_flow - capex AS fcf,
    CASE WHEN long_term_debt IS NULL AND short_term_debt IS NULL
         THEN CASE WHEN total_assets IS NOT NULL OR cash IS NOT NULL THEN 0::DOUBLE END
         ELSE coalesce(long_term_debt, 0) + coalesce(short_term_debt, 0) END AS total_debt,
    coalesce(cash, 0) + coalesce(short_term_investments, 0) AS liquid
  FROM (SELECT *,
          CASE WHEN depreciation_expense IS NOT NULL OR amortisation_expense IS NOT NULL
               THEN coalesce(depreciation_expense, 0) + coalesce(amortisation_expense, 0) END AS parts,
          greatest(coalesce(filed_depreciation_expense, DATE '0001-01-01'),
                   coalesce(filed_amortisation_expense, DATE '0001-01-01')) AS parts_filed
        FROM x_state))"""
_ok = lambda v: f"CASE WHEN {v} >= 1e5 AND {v} <= 1e12 THEN {v} END"
CTES["x_candidates"] = f"""
SELECT ticker, as_of, {_ok('shares_diluted')} AS d, {_ok('shares_outstanding')} AS o,
       {_ok('shares_outstanding_gaap')} AS g,
       row_number() OVER (PARTITION BY ticker ORDER BY as_of) AS n
FROM x_state"""
_near = lambda v: f"CASE WHEN {v} / w.ref >= 0.1 AND {v} / w.ref <= 10 THEN {v} END"
_mid = "list_sort([d, o, g])[2]"
_band = lambda v: f"CASE WHEN {v} >= {_mid} / 100 AND {v} <= {_mid} * 100 THEN {v} END"
CTES["x_walk"] = f"""
SELECT DISTINCT ticker, CAST(NULL AS DATE) AS as_of, CAST(0 AS BIGINT) AS n,
       CAST(NULL AS DOUBLE) AS ref FROM x_candidates
UNION ALL
SELECT c.ticker, c.as_of, c.n,
       CASE WHEN w.ref IS NOT NULL
            THEN coalesce({_near('d')}, {_near('o')}, {_near('g')}, w.ref)
            WHEN d IS NOT NULL AND o IS NOT NULL AND g IS NOT NULL
            THEN coalesce({_band('d')}, {_band('o')}, {_band('g')})
            ELSE coalesce(d, o, g) END
FROM x_walk w JOIN x_candidates c ON c.ticker = w.ticker AND c.n = w.n + 1"""
CTES["x_shares"] = "SELECT ticker, as_of, ref AS shares_final FROM x_walk WHERE n > 0"
_div = lambda a, b: f"CASE WHEN {b} <> 0 THEN {a} / {b} END"
_pos = lambda a, b: f"CASE WHEN {b} > 0 THEN {a} / {b} END"
_ev = "CASE WHEN ev > 0 THEN ev END"
_tax = ("CASE WHEN pretax_income > 0 AND income_tax IS NOT NULL "
        "THEN least(greatest(income_tax / pretax_income, 0.0::DOUBLE), 0.5::DOUBLE) "
        "ELSE 0.21::DOUBLE END")
_roic = (f"CASE WHEN total_equity + total_debt - coalesce(cash, 0) > 0 THEN "
         f"(ebit * (1 - ({_tax}))) / (total_equity + total_debt - coalesce(cash, 0)) END")
CTES["x_days"] = """
SELECT p.ticker, p.date, p.close, s.* EXCLUDE (ticker),
       CASE WHEN h.shares_final <> 0 THEN h.shares_final * p.close END AS market_cap,
       h.shares_final
FROM b_prices p ASOF JOIN x_derived s ON p.ticker = s.ticker AND p.date >= s.as_of
JOIN x_shares h ON h.ticker = s.ticker AND h.as_of = s.as_of"""
CTES["x_rows"] = f"""
SELECT ticker, date, close, market_cap, ev AS enterprise_value, shares_final AS shares_diluted,
  {_pos('market_cap', 'net_income')} AS pe_ttm, {_pos('market_cap', 'revenue')} AS ps_ttm,
  {_pos('market_cap', 'total_equity')} AS pb, {_pos(f'({_ev})', 'ebitda')} AS ev_ebitda,
  {_pos(f'({_ev})', 'revenue')} AS ev_sales, {_pos(f'({_ev})', 'fcf')} AS ev_fcf,
  {_div('fcf', 'market_cap')} AS fcf_yield, {_div('net_income', 'market_cap')} AS earnings_yield,
  {_div('gp', 'revenue')} AS gross_margin, {_div('ebit', 'revenue')} AS operating_margin,
  {_div('net_income', 'revenue')} AS net_margin, {_div('fcf', 'revenue')} AS fcf_margin,
  {_pos('fcf', 'net_income')} AS fcf_conversion, {_roic} AS roic,
  {_pos('net_income', 'total_equity')} AS roe, net_debt,
  {_pos('net_debt', 'ebitda')} AS net_debt_ebitda,
  {_pos('ebit', 'interest_expense')} AS interest_coverage, revenue AS revenue_ttm,
  {_div('inventory', '(cost_of_revenue / 365)')} AS inventory_days,
  {_pos('stock_based_compensation', 'revenue')} AS sbc_pct_revenue,
  {_pos('capex', 'revenue')} AS capex_pct_revenue, filed_at AS fundamentals_filed_at
FROM (SELECT *, market_cap + net_debt AS ev FROM x_days)"""
CTES["x_ratios"] = """
SELECT r.*, CASE WHEN p.revenue_ttm > 0 AND r.revenue_ttm <> 0
                 THEN r.revenue_ttm / p.revenue_ttm - 1 END AS revenue_growth_yoy
FROM x_rows r ASOF LEFT JOIN x_rows p
  ON p.ticker = r.ticker AND r.date - 365 >= p.date"""

RATIO_SELECT = """SELECT ticker, date, close, market_cap, enterprise_value, shares_diluted, pe_ttm,
ps_ttm, pb, ev_ebitda, ev_sales, ev_fcf, fcf_yield, earnings_yield, gross_margin,
operating_margin, net_margin, fcf_margin, fcf_conversion, roic, roe, net_debt, net_debt_ebitda,
interest_coverage, revenue_ttm, revenue_growth_yoy, inventory_days, sbc_pct_revenue,
capex_pct_revenue, fundamentals_filed_at FROM x_ratios"""

SQL: dict[str, str] = {}
SQL["prices_daily"] = "SELECT ticker, date, close, volume FROM b_prices"
SQL["fundamentals"] = ("SELECT ticker, concept, period_start, period_end, duration_days, filed_at, "
                    "accession, form, unit, value FROM b_facts")
SQL["filing_grid"] = "SELECT ticker, as_of FROM x_grid"
SQL["visible_asof"] = "SELECT * FROM x_visible"
SQL["ttm"] = (f"SELECT ticker, as_of, concept, value, filed_at FROM x_ttm "
              f"WHERE concept IN ({_in(registry.FLOWS)})")
SQL["latest_instant"] = (f"SELECT ticker, as_of, concept, value, filed_at FROM x_instant "
                         f"WHERE concept IN ({_in(registry.STOCKS)})")
SQL["split_factor"] = """
SELECT f.ticker, f.concept, f.period_end, f.filed_at, f.accession, f.value * x.factor AS value
FROM b_facts f JOIN x_factor x USING (ticker, filed_at)
WHERE f.concept IN ('shares_diluted', 'shares_outstanding', 'shares_outstanding_gaap')"""
SQL["shares_normalised"] = """
SELECT ticker, as_of, shares_diluted, shares_outstanding, shares_outstanding_gaap FROM x_state"""
SQL["filing_state"] = "SELECT * FROM x_state"
SQL["derived_concepts"] = """
SELECT ticker, as_of, gp AS gross_profit, da AS depreciation_amortization, ebit, ebitda, fcf,
       total_debt, net_debt FROM x_derived"""
SQL["share_reconcile"] = "SELECT ticker, as_of, shares_final FROM x_shares"
SQL["asof_attach"] = """
SELECT p.ticker, p.date, p.close, s.as_of, s.filed_at, s.revenue
FROM b_prices p ASOF JOIN x_state s ON p.ticker = s.ticker AND p.date >= s.as_of"""
SQL["ratios_daily"] = SQL["incremental_ratios"] = RATIO_SELECT
SQL["roic"] = "SELECT ticker, date, roic FROM x_ratios"
SQL["yoy_growth"] = "SELECT ticker, date, revenue_ttm, revenue_growth_yoy FROM x_ratios"

# ---- distribution and grid -------------------------------------------------------------
_long = "\nUNION ALL ".join(
    f"SELECT ticker, date, '{m}' AS metric_key, {m} AS value FROM x_ratios WHERE {m} IS NOT NULL"
    for m in registry.METRICS)
CTES["x_long"] = _long
CTES["x_newest"] = "SELECT ticker, max(date) AS newest FROM x_ratios GROUP BY 1"


def _years_before(d: str, n: int) -> str:
    shifted = f"CAST({d} - INTERVAL {n} YEAR AS DATE)"
    return (f"CASE WHEN month({d}) = 2 AND day({d}) = 29 AND day({shifted}) = 28 "
            f"THEN {shifted} + 1 ELSE {shifted} END")


CTES["x_latest"] = """
SELECT ticker, metric_key, date, value FROM x_long
QUALIFY row_number() OVER (PARTITION BY ticker, metric_key ORDER BY date DESC) = 1"""


def _stats(long: str, latest: str) -> str:
    return f"""
SELECT l.ticker, l.metric_key, any_value(l.date) AS date, any_value(l.value) AS value,
       count(*) AS n, CAST(sum(CASE WHEN h.value <= l.value THEN 1 ELSE 0 END) AS DOUBLE) AS below,
       min(h.value) AS low, max(h.value) AS high, min(h.date) AS first_date
FROM {latest} l JOIN {long} h ON h.ticker = l.ticker AND h.metric_key = l.metric_key
 AND h.date >= {_years_before('l.date', 10)} GROUP BY 1, 2"""


def _medians(long: str, latest: str) -> str:
    return f"""
SELECT ticker, metric_key, value AS median FROM (
  SELECT h.ticker, h.metric_key, h.value,
         row_number() OVER (PARTITION BY h.ticker, h.metric_key ORDER BY h.value) AS rn,
         count(*) OVER (PARTITION BY h.ticker, h.metric_key) AS n
  FROM {latest} l JOIN {long} h ON h.ticker = l.ticker AND h.metric_key = l.metric_key
   AND h.date >= {_years_before('l.date', 10)})
WHERE rn = n // 2 + 1"""


CTES["x_hist"] = _stats("x_long", "x_latest")
CTES["x_hist_median"] = _medians("x_long", "x_latest")
_final_stats = """
  below / n * 100 AS percentile, median, low, high,
  datediff('day', first_date, date) / 365.25::DOUBLE AS years,
  datediff('day', first_date, date) / 365.25::DOUBLE >= 3 AND n > 100 AS sufficient"""
CTES["x_stats"] = f"""
SELECT ticker, metric_key, date, value, n, date = newest AS is_current, {_final_stats},
  CASE WHEN high - low > 0 THEN (value - low) / (high - low) * 100 ELSE 50 END AS position,
  CASE WHEN high - low > 0 THEN (median - low) / (high - low) * 100 END AS median_position
FROM x_hist JOIN x_hist_median USING (ticker, metric_key) JOIN x_newest USING (ticker)"""
CTES["x_peers"] = """
SELECT group_id, metric_key, value AS group_median FROM (
  SELECT group_id, l.metric_key, l.value,
         row_number() OVER (PARTITION BY group_id, l.metric_key ORDER BY l.value) AS rn,
         count(*) OVER (PARTITION BY group_id, l.metric_key) AS n
  FROM b_stock_groups g JOIN x_newest m USING (ticker)
  JOIN x_long l ON l.ticker = g.ticker AND l.date = m.newest)
WHERE rn = n // 2 + 1"""


def _active(requested: str) -> str:
    return f"""
SELECT w.ticker, g.group_id, g.name AS group_name, coalesce(g.primary_multiple, 'pe_ttm') AS primary_key
FROM (SELECT *, {requested} AS requested FROM b_watchlist) w
LEFT JOIN (b_stock_groups sg JOIN b_metric_groups USING (group_id)) g ON g.ticker = w.ticker
QUALIFY row_number() OVER (PARTITION BY w.ticker ORDER BY
    CASE WHEN g.group_id = w.requested THEN 0 WHEN g.group_id = w.default_group_id THEN 1 ELSE 2 END,
    g.group_id) = 1"""


CTES["x_active"] = _active("CAST(NULL AS INTEGER)")
_last = lambda cond: f"""
SELECT r.* FROM x_ratios r JOIN x_newest m USING (ticker) WHERE {cond}
QUALIFY row_number() OVER (PARTITION BY r.ticker ORDER BY r.date DESC) = 1"""  # noqa: E731
CTES["x_now"] = _last("r.date = m.newest")
CTES["x_then"] = _last(f"r.date <= {_years_before('m.newest', 1)}")
CTES["x_change"] = """
SELECT ticker, date, close, CASE WHEN close <> 0 AND prev <> 0 THEN close / prev - 1 END AS change_pct
FROM (SELECT ticker, date, close, lag(close) OVER (PARTITION BY ticker ORDER BY date) AS prev
      FROM x_ratios) JOIN x_newest USING (ticker) WHERE date = newest"""
CTES["x_grid_rows"] = """
SELECT a.ticker, a.group_id, a.group_name, a.primary_key, c.date, c.close, c.change_pct,
  n.market_cap, n.revenue_growth_yoy, s.value AS multiple, s.percentile, s.median, s.low, s.high,
  s.years, coalesce(s.sufficient, false) AS sufficient,
  concat_ws(', ',
    CASE WHEN n.operating_margin < t.operating_margin - 0.02::DOUBLE THEN 'margin compressing' END,
    CASE WHEN n.shares_diluted > t.shares_diluted * 1.02::DOUBLE THEN 'dilution' END,
    CASE WHEN n.inventory_days > t.inventory_days * 1.15::DOUBLE
          AND coalesce(n.revenue_growth_yoy, 1) < 0.1::DOUBLE THEN 'inventory building' END,
    CASE WHEN s.sufficient AND s.percentile >= 95 THEN 'multiple at high' END,
    CASE WHEN s.sufficient AND s.percentile <= 5 THEN 'multiple at low' END) AS flags
FROM x_active a JOIN x_change c USING (ticker) JOIN x_now n USING (ticker)
LEFT JOIN x_then t USING (ticker)
LEFT JOIN x_stats s ON s.ticker = a.ticker AND s.metric_key = a.primary_key"""
SQL["latest_value"] = "SELECT ticker, metric_key, date, value FROM x_latest"
SQL["metric_stats"] = "SELECT * FROM x_stats"
SQL["upper_median"] = """
SELECT ticker, metric_key, value AS median FROM (
  SELECT ticker, metric_key, value, row_number() OVER (PARTITION BY ticker, metric_key ORDER BY value) AS rn,
         count(*) OVER (PARTITION BY ticker, metric_key) AS n FROM x_long) WHERE rn = n // 2 + 1"""
SQL["peer_median"] = "SELECT group_id, metric_key, group_median FROM x_peers"
SQL["day_change"] = "SELECT ticker, date, close, change_pct FROM x_change"
SQL["range_52w"] = f"""
SELECT ticker, date, close, low_52w, high_52w,
  CASE WHEN high_52w > low_52w THEN (close - low_52w) / (high_52w - low_52w) * 100 END AS position
FROM (SELECT n.ticker, n.date, n.close, min(p.close) AS low_52w, max(p.close) AS high_52w
      FROM x_now n JOIN b_prices p ON p.ticker = n.ticker AND p.date >= {_years_before('n.date', 1)}
      GROUP BY 1, 2, 3)"""
SQL["flags"] = "SELECT ticker, date, flags FROM x_grid_rows"
SQL["active_group"] = _active("CASE WHEN cik % 5 = 0 THEN 10 END")
SQL["section_profile"] = """
SELECT a.ticker, a.group_id, m.section,
  CASE m.section WHEN 'paying' THEN 1 WHEN 'getting' THEN 2 WHEN 'integrity' THEN 3 ELSE 4 END
    AS section_order, m.sort_order, m.metric_key, s.value, s.percentile, s.median, s.low, s.high,
  s.years, coalesce(s.sufficient, false) AS sufficient, p.group_median
FROM x_active a JOIN b_group_metrics m USING (group_id)
LEFT JOIN x_stats s ON s.ticker = a.ticker AND s.metric_key = m.metric_key
LEFT JOIN x_peers p ON p.group_id = a.group_id AND p.metric_key = m.metric_key"""
SQL["sampled_series"] = f"""
SELECT ticker, date, close, pe_ttm, ev_ebitda, ev_sales, fcf_yield, gross_margin, operating_margin, net_margin,
  fcf_margin, roic, revenue_growth_yoy, shares_diluted, sbc_pct_revenue, net_debt_ebitda, inventory_days, fcf_conversion FROM (
  SELECT r.*, row_number() OVER (PARTITION BY r.ticker ORDER BY r.date) AS rn
  FROM x_ratios r JOIN x_newest m USING (ticker) WHERE r.date >= {_years_before('m.newest', 10)})
WHERE (rn - 1) % 5 = 0"""
SQL["percentile_band"] = """
SELECT ticker, metric_key, percentile,
  CASE WHEN percentile <= 20 THEN 1 WHEN percentile <= 40 THEN 2 WHEN percentile <= 60 THEN 3
       WHEN percentile <= 80 THEN 4 WHEN percentile IS NOT NULL THEN 5 END AS band
FROM x_stats"""
SQL["watchlist_grid"] = """
SELECT g.*, coalesce(mm.label, g.primary_key) AS primary_label,
       (SELECT string_agg(DISTINCT x.name, ', ' ORDER BY x.name) FROM b_stock_groups sg
        JOIN b_metric_groups x ON x.group_id = sg.group_id WHERE sg.ticker = g.ticker) AS groups, CAST(length(flags) - length(replace(flags, ',', ''))
                 + CASE WHEN flags = '' THEN 0 ELSE 1 END AS INTEGER) AS n_flags, w.name, p.group_median,
       row_number() OVER (ORDER BY percentile NULLS LAST, g.ticker) AS grid_rank
FROM x_grid_rows g JOIN b_watchlist w ON w.ticker = g.ticker AND w.supported
LEFT JOIN m_metrics mm ON mm.metric_key = g.primary_key
LEFT JOIN x_peers p ON p.group_id = g.group_id AND p.metric_key = g.primary_key"""
SQL["grid_sorted"] = """
SELECT coalesce(group_name, 'Ungrouped') AS section, ticker, multiple,
  row_number() OVER (PARTITION BY coalesce(group_name, 'Ungrouped')
                     ORDER BY multiple DESC NULLS LAST, ticker) AS sort_rank FROM x_grid_rows"""
SQL["added_price"] = """
SELECT w.ticker, coalesce(w.added_price, n.close) AS added_price
FROM b_watchlist w LEFT JOIN x_now n USING (ticker)"""

# ---- reports ---------------------------------------------------------------------------
SQL["run_freshness"] = """
SELECT *, hours_ago > 72 OR status IN ('error', 'running') AS stale FROM (
  SELECT event_id AS run_id, ts AS started_at,
         CASE WHEN event_type <> 'error' THEN ts + INTERVAL 5 MINUTE END AS finished_at,
         CASE event_type WHEN 'error' THEN 'running' WHEN 'signup' THEN 'error' ELSE 'ok' END AS status,
         datediff('microsecond', CASE WHEN event_type <> 'error' THEN ts + INTERVAL 5 MINUTE ELSE ts END,
                  TIMESTAMP '2024-02-02') / 3600000000::DOUBLE AS hours_ago
  FROM events ORDER BY event_id DESC LIMIT 1)"""
SQL["latest_snapshot"] = RATIO_SELECT.replace("x_ratios", "x_now")
from tidemark.operators.reports import COVERAGE_METRICS  # noqa: E402
SQL["metric_coverage"] = "\nUNION ALL ".join(
    f"SELECT ticker, '{m}' AS metric_key, count({m}) * 100 / count(*) AS coverage_pct "
    f"FROM x_ratios GROUP BY 1" for m in COVERAGE_METRICS)
SQL["load_status"] = """
SELECT ticker, supported,
  (SELECT count(*) FROM b_facts f WHERE f.ticker = w.ticker) AS facts,
  (SELECT count(*) FROM b_prices p WHERE p.ticker = w.ticker) AS prices,
  (SELECT count(*) FROM x_ratios r WHERE r.ticker = w.ticker) AS ratios,
  (SELECT min(period_end) FROM b_facts f WHERE f.ticker = w.ticker) AS first_period,
  (SELECT max(period_end) FROM b_facts f WHERE f.ticker = w.ticker) AS last_period
FROM b_watchlist w"""
SQL["annual_series"] = """
SELECT ticker, concept, period_end, value, filed_at AS first_filed, form FROM (
  SELECT *, row_number() OVER (PARTITION BY ticker, concept ORDER BY period_end DESC) AS newest
  FROM (SELECT * FROM b_facts WHERE duration_days BETWEEN 340 AND 380
        QUALIFY row_number() OVER (PARTITION BY ticker, concept, period_end
                                   ORDER BY filed_at, accession) = 1))
WHERE newest <= 8"""
SQL["fact_versions"] = """
SELECT ticker, concept, period_end, duration_days, value, filed_at, accession, form,
  CAST(row_number() OVER (PARTITION BY ticker, concept, period_end, kind ORDER BY filed_at, accession, duration_days) AS INTEGER) AS version, kind
FROM (SELECT *, CASE WHEN duration_days BETWEEN 340 AND 380 THEN 'annual' WHEN duration_days BETWEEN 80 AND 100 THEN 'quarter' END AS kind
      FROM b_facts) WHERE kind IS NOT NULL"""
SQL["restatements"] = """
SELECT *, coalesce(abs(ratio - 1) > 0.05::DOUBLE, false) AS restated FROM (
  SELECT *, CASE WHEN versions > 1 AND first_value <> 0 AND last_value <> 0
                 THEN last_value / first_value END AS ratio FROM (
    SELECT ticker, concept, period_end, kind, count(*) AS versions,
           first(value ORDER BY filed_at, accession) AS first_value,
           last(value ORDER BY filed_at, accession) AS last_value
    FROM (SELECT *, CASE WHEN duration_days BETWEEN 340 AND 380 THEN 'annual'
          WHEN duration_days BETWEEN 80 AND 100 THEN 'quarter' END AS kind FROM b_facts) WHERE kind IS NOT NULL GROUP BY 1, 2, 3, 4))"""
SQL["group_summary"] = """
SELECT g.group_id, g.name, g.primary_multiple,
  (SELECT count(*) FROM b_group_metrics m WHERE m.group_id = g.group_id) AS n_metrics,
  (SELECT count(*) FROM b_stock_groups s WHERE s.group_id = g.group_id) AS n_members,
  s.ticker AS member
FROM b_metric_groups g LEFT JOIN b_stock_groups s USING (group_id)"""

# ---- hierarchical revenue tables -------------------------------------------------------
CTES["e_lines"] = "SELECT *, ticker || '/' || CAST(filed_at AS VARCHAR) AS report_id FROM b_segments"
CTES["e_close"] = """
SELECT s.ticker, s.period_end, s.label, s.value, s.row_idx, s.report_id, s.filed_at, s.value > 0
  AND EXISTS (SELECT 1 FROM (SELECT ticker, period_end, row_idx, n, k FROM e_runs) r
    WHERE r.ticker = s.ticker AND r.period_end = s.period_end AND r.row_idx = s.row_idx) AS is_subtotal
FROM e_lines s"""
CTES["e_pos"] = """
SELECT *, row_number() OVER (PARTITION BY report_id, period_end ORDER BY row_idx) AS pos FROM e_lines"""
CTES["e_runs"] = """
SELECT s.ticker, s.period_end, s.row_idx, k, side, count(*) AS n
FROM e_pos s, range(2, 9) ks(k), (VALUES (1), (-1)) d(side)
JOIN e_pos o ON o.report_id = s.report_id AND o.period_end = s.period_end
 AND (o.pos - s.pos) * side BETWEEN 1 AND k
GROUP BY s.ticker, s.period_end, s.row_idx, s.value, k, side
HAVING count(*) = k AND abs(sum(o.value) - s.value) / abs(s.value) <= 0.001::DOUBLE"""
CTES["e_reported"] = """
SELECT s.report_id, s.period_end, f.value AS reported
FROM (SELECT DISTINCT report_id, ticker, period_end FROM e_lines) s
JOIN b_facts f ON f.ticker = s.ticker AND f.concept = 'revenue'
 AND f.duration_days BETWEEN 340 AND 380 AND abs(datediff('day', f.period_end, s.period_end)) <= 5
QUALIFY row_number() OVER (PARTITION BY s.report_id, s.period_end
                           ORDER BY f.filed_at DESC, f.accession) = 1"""


def _verdict(lines: str) -> str:
    return f"""
SELECT l.ticker, l.report_id, l.period_end, l.n_leaves, l.leaf_sum, nullif(r.reported, 0) AS target,
  coalesce(l.n_leaves >= 2 AND abs(l.leaf_sum - r.reported) / abs(r.reported) <= 0.01::DOUBLE, false)
    AS reconciles
FROM (SELECT ticker, report_id, base, period_end,
        count(CASE WHEN NOT is_subtotal THEN 1 END) AS n_leaves,
        CAST(sum(CASE WHEN NOT is_subtotal THEN CAST(value AS DECIMAL(28,4)) END) AS DOUBLE) AS leaf_sum
      FROM {lines} GROUP BY 1, 2, 3, 4) l
LEFT JOIN e_reported r ON r.report_id = l.base AND r.period_end = l.period_end"""


CTES["e_based"] = "SELECT *, report_id AS base FROM e_close"
CTES["e_verdict"] = _verdict("e_based")
CTES["e_two"] = """
SELECT * REPLACE (report_id || '/a' AS report_id, CASE WHEN row_idx = 1 THEN value * 1.5::DOUBLE ELSE value END AS value),
  report_id AS base FROM e_close
UNION ALL SELECT * REPLACE (report_id || '/b' AS report_id), report_id AS base FROM e_close"""
CTES["e_two_verdict"] = _verdict("e_two")
CTES["e_members"] = """
SELECT *, CASE WHEN label NOT IN ('ECONOMY', 'LARGE', 'MEDIUM') THEN label
               WHEN CAST(substr(ticker, 2) AS BIGINT) % 2 = 0 THEN label || ' | GROUP_A'
               ELSE 'GROUP_A | ' || label END AS member FROM e_lines"""
CTES["e_sides"] = """
SELECT *, CASE WHEN contains(member, '|') THEN trim(split_part(member, '|', 1)) END AS lhs,
          CASE WHEN contains(member, '|') THEN trim(split_part(member, '|', 2)) END AS rhs
FROM e_members"""
CTES["e_named"] = """
SELECT s.* EXCLUDE (label, parent),
  CASE WHEN lhs IS NULL THEN member WHEN nl < nr THEN rhs ELSE lhs END AS label,
  CASE WHEN nl < nr THEN lhs ELSE rhs END AS parent
FROM e_sides s LEFT JOIN (SELECT report_id, count(DISTINCT lhs) AS nl, count(DISTINCT rhs) AS nr
  FROM e_sides WHERE lhs IS NOT NULL GROUP BY 1) USING (report_id)"""
CTES["e_rows"] = """
SELECT report_id, row_idx * 10 AS row_idx, label, CAST(NULL AS DOUBLE) AS v FROM e_lines
UNION ALL SELECT report_id, row_idx * 10 + 1, 'Operating income', value * 0.25::DOUBLE FROM e_lines
UNION ALL SELECT report_id, row_idx * 10 + 2, 'Net sales', value FROM e_lines
UNION ALL SELECT report_id, 1, 'Total', value * 3 FROM e_lines WHERE row_idx = 7
UNION ALL SELECT report_id, 90, 'Segment Reporting Information', NULL FROM e_lines WHERE row_idx = 7
UNION ALL SELECT report_id, 91, 'Revenues', value * 4 FROM e_lines WHERE row_idx = 7"""
CTES["e_islands"] = """
SELECT r.report_id, r.row_idx, r.label, r.v, r.v IS NULL AS is_header,
  (SELECT count(*) FROM e_rows h WHERE h.report_id = r.report_id AND h.v IS NULL
    AND h.row_idx <= r.row_idx) AS island,
  (SELECT CASE WHEN max_by(h.label, h.row_idx) <> 'Segment Reporting Information'
               THEN max_by(h.label, h.row_idx) END FROM e_rows h
   WHERE h.report_id = r.report_id AND h.v IS NULL AND h.row_idx <= r.row_idx) AS member
FROM e_rows r"""
CTES["e_growth_lines"] = "SELECT * FROM e_close WHERE NOT is_subtotal"
CTES["e_periods"] = """
SELECT ticker, period_end, CAST(sum(CAST(value AS DECIMAL(28,4))) AS DOUBLE) AS total,
       max(filed_at) AS filed_at, row_number() OVER (PARTITION BY ticker ORDER BY period_end DESC) AS k
FROM e_growth_lines GROUP BY 1, 2"""

_cell = """CASE l_linenumber % 7
  WHEN 0 THEN '$ ' || CAST(CAST(l_extendedprice AS DECIMAL(12,2)) AS VARCHAR)
  WHEN 1 THEN '(' || CAST(CAST(l_extendedprice AS DECIMAL(12,2)) AS VARCHAR) || ')'
  WHEN 2 THEN CAST(CAST(l_discount AS DECIMAL(4,2)) AS VARCHAR) || '%'
  WHEN 3 THEN '—' WHEN 4 THEN '$ (' || CAST(CAST(l_quantity AS DECIMAL(8,1)) AS VARCHAR) || ')'
  WHEN 5 THEN ' ' || CAST(CAST(l_quantity AS INT) AS VARCHAR) || ',000 '
  ELSE '-' || CAST(CAST(l_quantity AS INT) AS VARCHAR) END"""
SQL["parse_number"] = f"""
SELECT cell, n, CASE kind WHEN 0 THEN amount WHEN 1 THEN -amount WHEN 4 THEN -quantity
  WHEN 5 THEN quantity * 1000 WHEN 6 THEN quantity END AS value
FROM (SELECT {_cell} AS cell, any_value(l_linenumber % 7) AS kind, count(*) AS n,
        any_value(l_extendedprice) AS amount, any_value(l_quantity) AS quantity
      FROM lineitem GROUP BY 1)"""
SQL["report_catalogue"] = """
SELECT filing_id, position, short_name, tier,
  CAST(row_number() OVER (PARTITION BY filing_id ORDER BY tier, position) AS INTEGER) AS candidate_rank
FROM (SELECT p_partkey // 20 AS filing_id, p_partkey AS position,
    CASE p_size % 5 WHEN 0 THEN 'Disaggregation of Revenue' WHEN 1 THEN 'Segment Information'
      WHEN 2 THEN 'Geographic Data - Segment Sales' WHEN 3 THEN 'Leases'
      ELSE 'Revenue - By Region' END || ' - ' || p_name
    || CASE WHEN p_partkey % 4 = 0 THEN ' Narrative' ELSE '' END
    || CASE p_partkey % 3 WHEN 0 THEN ' (Details)' WHEN 1 THEN ' (Detail)' ELSE ' (Tables)' END
      AS short_name,
    CASE p_size % 5 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 1 WHEN 3 THEN NULL ELSE 2 END AS tier
  FROM part WHERE p_partkey % 4 <> 0 AND p_partkey % 3 <> 2)
WHERE tier IS NOT NULL"""
SQL["member_islands"] = "SELECT report_id, row_idx, label, island, member, is_header FROM e_islands"
SQL["member_lines"] = """
SELECT i.report_id, i.row_idx, i.member, l.period_end, i.v * 1000 AS value
FROM e_islands i JOIN (SELECT DISTINCT report_id, period_end FROM e_lines) l USING (report_id)
WHERE i.label = 'Net sales' AND i.member IS NOT NULL"""
SQL["table_totals"] = """
SELECT i.report_id, l.period_end, i.v * 1000 AS total
FROM e_islands i JOIN (SELECT DISTINCT report_id, period_end FROM e_lines) l USING (report_id)
WHERE NOT is_header AND member IS NULL AND label IN ('Total', 'Revenues')
QUALIFY row_number() OVER (PARTITION BY i.report_id ORDER BY i.row_idx DESC) = 1"""
SQL["pipe_orientation"] = "SELECT report_id, period_end, row_idx, label, parent, value FROM e_named"
SQL["segment_dedup"] = """
SELECT report_id, CASE WHEN row_idx % 2 = 0 THEN 'EVEN' ELSE 'ODD' END AS label, period_end, value, row_idx
FROM e_lines QUALIFY row_number() OVER (PARTITION BY report_id, row_idx % 2, period_end
                                        ORDER BY abs(value) DESC, row_idx) = 1"""
SQL["subtotal_parent"] = """
SELECT report_id, period_end, label, EXISTS (SELECT 1 FROM e_named p
  WHERE p.report_id = n.report_id AND p.period_end = n.period_end AND p.parent = n.label) AS is_parent
FROM e_named n"""
SQL["subtotal_run"] = "SELECT ticker, period_end, label, value, is_subtotal FROM e_close"
SQL["range_match"] = """
SELECT s.ticker, s.period_end, (SELECT f.value FROM b_facts f WHERE f.ticker = s.ticker
    AND f.concept = 'revenue' AND f.duration_days BETWEEN 340 AND 380
    AND abs(datediff('day', f.period_end, s.period_end)) <= 5
    ORDER BY f.filed_at DESC, f.accession LIMIT 1) AS reported
FROM (SELECT DISTINCT ticker, period_end - 3 AS period_end FROM b_segments) s"""
SQL["reconcile"] = "SELECT * FROM e_verdict"
SQL["first_reconciling"] = """
SELECT regexp_replace(report_id, '/[ab]$', '') AS filing_id, report_id,
  CAST(CASE WHEN report_id LIKE '%/a' THEN 1 ELSE 2 END AS INTEGER) AS candidate_rank, ticker, period_end
FROM e_two_verdict WHERE reconciles
QUALIFY rank() OVER (PARTITION BY regexp_replace(report_id, '/[ab]$', '')
                     ORDER BY CASE WHEN report_id LIKE '%/a' THEN 1 ELSE 2 END) = 1"""
SQL["segment_refresh"] = """
SELECT t.ticker, 'product' AS axis, t.label, CAST(NULL AS VARCHAR) AS parent, t.period_end,
  CAST(year(t.period_end) AS INTEGER) AS fiscal_year, t.filed_at,
  replace(replace(t.base, '/', ''), '-', '') AS accession, floor(t.value + 0.12345::DOUBLE) AS value, t.is_subtotal
FROM e_two t JOIN e_two_verdict v ON v.report_id = t.report_id AND v.period_end = t.period_end AND v.reconciles
JOIN (SELECT DISTINCT ticker, filed_at FROM e_lines WHERE year(filed_at) >= 1993
      QUALIFY dense_rank() OVER (PARTITION BY ticker ORDER BY filed_at DESC) <= 10) n
  ON n.ticker = t.ticker AND n.filed_at = t.filed_at
QUALIFY rank() OVER (PARTITION BY t.base ORDER BY right(t.report_id, 1)) = 1"""
SQL["segment_growth"] = """
SELECT *, CAST(row_number() OVER (PARTITION BY ticker ORDER BY yoy DESC NULLS LAST, latest DESC, label)
            AS INTEGER) AS growth_rank,
       count(CASE WHEN yoy < 0 THEN 1 END) OVER (PARTITION BY ticker) AS declining
FROM (SELECT l.ticker, l.label, p.period_end AS latest_period, p.filed_at, l.value AS latest,
    CASE WHEN p.total <> 0 THEN l.value / p.total END AS share,
    CASE WHEN l2.value <> 0 THEN l.value / l2.value - 1 END AS yoy,
    CASE WHEN l4.value > 0 THEN
      floor((pow(l.value / l4.value, 1::DOUBLE / 3) - 1) * 1e9 + 0.5) / 1e9 END AS cagr,
    datediff('day', p.filed_at, DATE '2003-01-01') > 395 AS stale
  FROM e_periods p JOIN e_growth_lines l ON l.ticker = p.ticker AND l.period_end = p.period_end
  LEFT JOIN e_periods p2 ON p2.ticker = p.ticker AND p2.k = 2
  LEFT JOIN e_growth_lines l2 ON l2.ticker = p.ticker AND l2.period_end = p2.period_end AND l2.label = l.label
  LEFT JOIN e_periods p4 ON p4.ticker = p.ticker AND p4.k = 4
  LEFT JOIN e_growth_lines l4 ON l4.ticker = p.ticker AND l4.period_end = p4.period_end AND l4.label = l.label
  WHERE p.k = 1)"""
SQL["segment_series"] = """
SELECT c.ticker, c.label, p.period_end, l.value
FROM e_growth_lines c JOIN e_periods n ON n.ticker = c.ticker AND n.period_end = c.period_end AND n.k = 1
JOIN e_periods p ON p.ticker = c.ticker
LEFT JOIN e_growth_lines l ON l.ticker = c.ticker AND l.label = c.label AND l.period_end = p.period_end"""
SQL["segment_coverage"] = """
SELECT w.ticker, count(DISTINCT c.period_end) AS periods, count(c.label) AS lines,
  min(c.period_end) AS first_period, max(c.period_end) AS last_period,
  coalesce(any_value(v.bad), 0) AS mismatched,
  (SELECT string_agg(DISTINCT e.label, ', ' ORDER BY e.label) FROM e_close e WHERE e.ticker = w.ticker AND NOT e.is_subtotal
   AND e.period_end = (SELECT max(period_end) FROM e_close x WHERE x.ticker = w.ticker)) AS newest_labels
FROM b_watchlist w LEFT JOIN e_close c USING (ticker)
LEFT JOIN (SELECT ticker, count(CASE WHEN abs(leaf_sum - target) / target * 100 > 1 THEN 1 END) AS bad
           FROM e_verdict WHERE target IS NOT NULL GROUP BY 1) v ON v.ticker = w.ticker
WHERE w.supported GROUP BY 1"""
SQL["segment_violations"] = """
SELECT ticker, label, period_end, value, 'scale' AS reason FROM e_close
WHERE abs(value) > 0 AND (abs(value) < 1e6 OR abs(value) > 1e12)"""

# ---- sources and normalisation ---------------------------------------------------------
def _tag_rows() -> list[tuple]:
    from tidemark.plans.queries import tag_choice
    return tag_choice()


_sk = "CAST(substr(ticker, 2) AS BIGINT)"
CTES["n_choice"] = ("SELECT * FROM (VALUES " + _values(_tag_rows())
                    + ") t(concept, is_foreign, copy, namespace, tag)")
CTES["n_entries"] = f"""
SELECT ticker, namespace, tag, CASE WHEN {_sk} % 10 = 3 THEN 'EUR' ELSE unit END AS unit,
  CASE WHEN f.concept = 'buybacks' AND {_sk} % 8 = 3 THEN NULL
       WHEN f.concept = 'dividends_paid' AND accession = 'Q-orig'
       THEN CAST(period_start - 30 AS VARCHAR) ELSE CAST(period_start AS VARCHAR) END AS start_date,
  CAST(period_end AS VARCHAR) AS end_date, value + copy AS val, accession AS accn,
  CAST(year(period_end) AS INTEGER) AS fy,
  CASE WHEN accession = 'FY' THEN 'FY' ELSE 'Q' || quarter(period_end) END AS fp, form,
  CASE WHEN f.concept = 'capex' AND accession = 'FY' AND {_sk} % 10 = 1 THEN NULL
       ELSE CAST(filed_at AS VARCHAR) END AS filed
FROM b_facts f JOIN n_choice c ON c.concept = f.concept AND c.is_foreign = ({_sk} % 10 = 7)"""
_all_tags = []
for _c, (_k, _ns, _t, _t2) in registry.CONCEPTS.items():
    for _p, (_n, _tag) in enumerate([(_ns, t) for t in _t] + [("ifrs-full", t) for t in _t2], 1):
        _all_tags.append((_n, _tag, _c, _k, _p))
CTES["n_tags"] = ("SELECT * FROM (VALUES " + _values(_all_tags)
                  + ") t(namespace, tag, concept, kind, priority)")
CTES["n_mapped"] = """
SELECT e.*, t.concept, t.kind, t.priority,
  CAST(datediff('day', CAST(start_date AS DATE), CAST(end_date AS DATE)) AS INTEGER) AS days
FROM n_entries e JOIN n_tags t USING (namespace, tag)"""
CTES["n_rows"] = """
SELECT ticker, concept, CASE WHEN kind = 'duration' THEN CAST(start_date AS DATE) END AS period_start,
  CAST(end_date AS DATE) AS period_end, CASE WHEN kind = 'duration' THEN days ELSE 0 END AS duration_days,
  fy AS fiscal_year, fp AS fiscal_period, form, CAST(filed AS DATE) AS filed_at, accn AS accession,
  unit, val AS value, priority
FROM n_mapped WHERE filed IS NOT NULL AND (kind = 'instant' OR (start_date IS NOT NULL AND
  (days BETWEEN 80 AND 100 OR days BETWEEN 170 AND 190 OR days BETWEEN 260 AND 285
   OR days BETWEEN 340 AND 380)))"""
CTES["n_facts"] = """
SELECT * EXCLUDE (priority) FROM n_rows QUALIFY row_number() OVER (
  PARTITION BY ticker, concept, period_end, accession, duration_days ORDER BY priority) = 1"""
CTES["n_currency"] = f"""
SELECT ticker, unit AS currency FROM (SELECT ticker, unit, count(*) AS n FROM n_facts
  WHERE concept IN ({_in(registry.MONETARY)}) GROUP BY 1, 2)
QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY n DESC, unit) = 1"""
CTES["n_registry"] = ("SELECT * FROM (VALUES " + _values(
    [(c, c in registry.OPTIONAL) for c in registry.CONCEPTS]) + ") t(concept, optional)")
CTES["n_parts"] = ("SELECT * FROM (VALUES " + _values(
    [(c, p) for c, ps in registry.DERIVABLE.items() for p in ps]) + ") t(concept, part)")
CTES["n_coverage"] = """
SELECT t.ticker, c.concept, count(f.value) AS n
FROM (SELECT DISTINCT ticker FROM n_facts) t, n_registry c
LEFT JOIN n_facts f ON f.ticker = t.ticker AND f.concept = c.concept GROUP BY 1, 2"""
CTES["n_missing"] = """
SELECT v.ticker, v.concept FROM n_coverage v JOIN n_registry r ON r.concept = v.concept
WHERE n = 0 AND NOT optional AND NOT EXISTS (
  SELECT 1 FROM n_parts p JOIN n_coverage o ON o.concept = p.part
  WHERE p.concept = v.concept AND o.ticker = v.ticker AND o.n > 0)"""
CTES["n_taxonomy"] = """
SELECT ticker, taxonomy, taxonomy = 'ifrs-full' AS annual_only FROM (
  SELECT ticker, CASE WHEN count(CASE WHEN namespace = 'us-gaap' THEN 1 END) > 0 THEN 'us-gaap'
    WHEN count(CASE WHEN namespace = 'ifrs-full' THEN 1 END) > 0 THEN 'ifrs-full'
    ELSE 'unknown' END AS taxonomy FROM n_entries GROUP BY 1)"""
SQL["facts_flatten"] = "SELECT * FROM n_entries"
SQL["facts_refresh"] = f"""
SELECT * REPLACE (value + CASE WHEN {_sk} % 4 = 0 AND filed_at < DATE '1998-01-01' THEN 1000 ELSE 0 END AS value) FROM n_facts"""
SQL["ticker_registry"] = """
SELECT upper(s_name) AS ticker, s_name AS name, CAST(o AS INTEGER) AS cik_order,
  CASE WHEN s_suppkey % 4 = 0 AND o = 0 THEN s_suppkey + 1000000 ELSE s_suppkey END AS cik
FROM supplier, range(2) r(o) WHERE o = 0 OR s_suppkey % 4 = 0"""
SQL["price_history"] = """
SELECT 'price' AS kind, ticker, date, close AS value FROM b_prices WHERE volume % 10 <> 0
UNION ALL SELECT 'split', ticker, date, 2::DOUBLE FROM b_prices WHERE volume % 7 = 0
UNION ALL SELECT 'dividend', ticker, date, 0.25::DOUBLE FROM b_prices WHERE volume % 5 = 0"""
SQL["filings_topn"] = """
SELECT ticker, 1 AS cik, 'FY' || strftime(period_end, '%Y%m%d') AS accession, filed_at AS filed,
  period_end AS period FROM (SELECT DISTINCT ticker, filed_at, period_end FROM b_facts
  WHERE concept = 'revenue' AND form = '10-K' AND year(filed_at) >= 1993)
QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY filed_at DESC) <= 10"""
SQL["report_scan"] = """
SELECT report_id, CAST(row_number() OVER (PARTITION BY report_id ORDER BY row_idx) - 1 AS INTEGER) AS row_idx,
  label, value, period_end, NULL AS reason
FROM e_lines
UNION ALL SELECT DISTINCT report_id || '/none', NULL, NULL, NULL, NULL, 'no table' FROM e_lines"""
SQL["concept_map"] = """
SELECT ticker, namespace, tag, concept, kind, priority, accn, end_date, val FROM n_mapped"""
SQL["fact_rows"] = "SELECT * FROM n_rows"
SQL["duration_bucket"] = """
SELECT days, count(*) AS n, CASE WHEN days >= 80 AND days <= 100 THEN 'Q'
  WHEN days >= 170 AND days <= 190 THEN 'H' WHEN days >= 260 AND days <= 285 THEN '9M'
  WHEN days >= 340 AND days <= 380 THEN 'FY' END AS bucket
FROM (SELECT CAST((l_orderkey * 7 + l_partkey) % 400 AS INTEGER) AS days FROM lineitem) GROUP BY 1"""
SQL["fact_dedup"] = "SELECT * FROM n_facts"
SQL["taxonomy"] = "SELECT * FROM n_taxonomy"
SQL["unit_mode"] = "SELECT * FROM n_currency"
SQL["concept_coverage"] = "SELECT * FROM n_coverage"
SQL["concept_missing"] = "SELECT * FROM n_missing"
SQL["support_gate"] = """
SELECT ticker, currency, years, foreign_note IS NULL AS supported, foreign_note AS unsupported_reason,
  concat_ws('; ', foreign_note, CASE WHEN annual_only THEN 'annual-only filer' END,
    CASE WHEN years < 5 THEN 'short history' END, 'missing required concepts: ' || missing) AS warnings
FROM (SELECT s.ticker, c.currency, s.years, t.annual_only, m.missing,
    CASE WHEN c.currency <> 'USD' THEN 'reports in ' || c.currency || ', priced in USD; needs FX conversion'
      || CASE WHEN t.annual_only THEN ' and an ADR ratio' ELSE '' END END AS foreign_note
  FROM (SELECT ticker, datediff('day', min(period_end), max(period_end)) / 365.25::DOUBLE AS years
        FROM n_facts GROUP BY 1) s
  LEFT JOIN n_currency c USING (ticker) LEFT JOIN n_taxonomy t USING (ticker)
  LEFT JOIN (SELECT ticker, string_agg(concept, ', ' ORDER BY concept) AS missing FROM n_missing GROUP BY 1) m
    USING (ticker))"""
SQL["quarantine"] = f"""
SELECT ticker, tag, reason, count(*) AS n FROM (
  SELECT e.ticker, e.tag, CASE WHEN t.kind IS NULL THEN 'unknown tag' WHEN filed IS NULL THEN 'missing filed'
    WHEN fp = 'Q2' AND CAST(substr(e.ticker, 2) AS BIGINT) % 3 = 1 THEN 'bad filed date'
    WHEN t.kind = 'duration' AND start_date IS NULL THEN 'missing start'
    WHEN t.kind = 'duration' AND NOT EXISTS (SELECT 1 FROM (VALUES (80, 100), (170, 190), (260, 285), (340, 380))
      b(lo, hi) WHERE datediff('day', CAST(start_date AS DATE), CAST(end_date AS DATE)) BETWEEN lo AND hi)
    THEN 'odd duration' END AS reason
  FROM n_entries e LEFT JOIN n_tags t USING (namespace, tag)
  UNION ALL SELECT {TICKER.format('s_suppkey')}, NULL, 'bad payload' FROM supplier WHERE s_suppkey % 4 = 0)
WHERE reason IS NOT NULL GROUP BY 1, 2, 3"""

# ---- sinks and incremental control -----------------------------------------------------
CTES["k_update"] = """
SELECT ticker, date, max(close) AS close, max(volume) AS volume FROM (
  SELECT ticker, CASE WHEN day(date) > 25 THEN CAST(date + INTERVAL 120 MONTH AS DATE) ELSE date END AS date,
         close * 2 AS close, volume
  FROM b_prices WHERE CAST(substr(ticker, 2) AS BIGINT) % 3 = 0) GROUP BY 1, 2"""
SQL["upsert_latest"] = """
SELECT coalesce(u.ticker, p.ticker) AS ticker, coalesce(u.date, p.date) AS date,
  CASE WHEN u.ticker IS NULL THEN p.close ELSE u.close END AS close,
  CASE WHEN u.ticker IS NULL THEN p.volume ELSE u.volume END AS volume
FROM b_prices p FULL JOIN k_update u ON u.ticker = p.ticker AND u.date = p.date"""
SQL["insert_if_absent"] = """
SELECT ticker, date, close, volume FROM b_prices
UNION ALL SELECT u.* FROM k_update u WHERE NOT EXISTS (
  SELECT 1 FROM b_prices p WHERE p.ticker = u.ticker AND p.date = u.date)"""
SQL["remove_keys"] = """
SELECT * FROM b_prices WHERE ticker NOT IN (SELECT ticker FROM b_watchlist WHERE NOT supported)"""


SQL["replace_keys"] = """
SELECT * FROM b_prices WHERE CAST(substr(ticker, 2) AS BIGINT) % 3 <> 0
UNION ALL SELECT * FROM k_update WHERE CAST(substr(ticker, 2) AS BIGINT) % 2 = 1"""
SQL["purge_tickers"] = "\nUNION ALL ".join(
    f"SELECT '{name}' AS table_name, t.ticker, count(*) AS n FROM {source} t WHERE t.ticker NOT IN "
    "(SELECT ticker FROM b_watchlist WHERE NOT supported) GROUP BY 2"
    for name, source in (("watchlist", "b_watchlist"), ("stock_groups", "b_stock_groups"), ("prices", "b_prices"),
                         ("share_splits", "b_splits"), ("fundamentals", "b_facts")))
SQL["cascade_rules"] = """
SELECT table_name, rule_id, count(*) AS n FROM (
  SELECT 'alert_rules' AS table_name, CAST(rule_id AS INTEGER) AS rule_id FROM r_rules
  UNION ALL SELECT 'alert_events', CAST(event_id % 11 + 1 AS INTEGER) FROM events)
WHERE rule_id NOT IN (SELECT n_nationkey % 4 + 2 FROM nation) GROUP BY 1, 2"""
SQL["run_records"] = """
SELECT run_id, TIMESTAMP '2003-01-01' + to_hours(a) AS started_at, TIMESTAMP '2003-01-01' + to_hours(b) AS finished_at, status,
  CASE WHEN status <> 'error' THEN tickers END AS tickers,
  CASE status WHEN 'skipped' THEN 0 WHEN 'error' THEN NULL ELSE redone END AS redone,
  CASE status WHEN 'skipped' THEN 0 WHEN 'error' THEN NULL ELSE new_price_rows END AS new_price_rows,
  CASE status WHEN 'partial' THEN lost WHEN 'error' THEN NULL ELSE 0 END AS failures,
  CASE WHEN status = 'error' THEN 'ValueError: stage failed on ' || redone || ' companies' END AS detail
FROM (VALUES (1, 0, 1, 'partial'), (2, 2, 3, 'ok'), (3, 4, 5, 'skipped'), (4, 6, 7, 'error'),
    (5, 10, 11, 'partial')) t(run_id, a, b, status),
  (SELECT count(*) AS tickers, count(CASE WHEN derive THEN 1 END) AS redone,
    CAST(sum(new_rows) AS BIGINT) AS new_price_rows FROM k_changes),
  (SELECT count(*) AS lost FROM b_watchlist WHERE NOT supported)"""


def _mark(pw: str, fw: str) -> str:
    return f"""
SELECT ticker, max(date) AS session, count(date) AS n_prices, max(filed_at) AS filed_at FROM (
  SELECT ticker, date, NULL AS filed_at FROM b_prices WHERE {pw}
  UNION ALL SELECT ticker, NULL, filed_at FROM b_facts WHERE {fw}) GROUP BY 1"""


CTES["k_before"] = _mark(f"{_sk} % 2 = 0 OR date < DATE '2001-06-01'",
                         f"({_sk} % 3 = 0 OR filed_at < DATE '2002-01-01') AND {_sk} % 5 <> 4")
CTES["k_after"] = _mark("true", "true")
CTES["k_changes"] = """
SELECT *, new_rows <> 0 OR new_session OR new_filing AS derive, new_filing AS segments FROM (
  SELECT a.ticker, a.session, a.n_prices - coalesce(b.n_prices, 0) AS new_rows,
    a.session IS DISTINCT FROM b.session AS new_session,
    a.filed_at IS DISTINCT FROM b.filed_at AS new_filing
  FROM k_after a LEFT JOIN k_before b USING (ticker))"""
SQL["change_detect"] = "SELECT * FROM k_changes"
SQL["run_audit"] = """
SELECT TIMESTAMP '2003-01-01' AS finished_at, CASE WHEN failures > 0 THEN 'partial'
    WHEN redo > 0 THEN 'ok' ELSE 'skipped' END AS status, tickers, new_price_rows, latest_session, failures,
  concat_ws('; ', CASE WHEN redo > 0 THEN new_price_rows || ' new price rows'
    ELSE 'no new session (still ' || CAST(latest_session AS VARCHAR) || ')' END,
    (SELECT string_agg(ticker || ' failed', '; ' ORDER BY ticker) FROM b_watchlist WHERE NOT supported)) AS detail
FROM (SELECT max(session) AS latest_session, count(*) AS tickers, CAST(sum(new_rows) AS BIGINT) AS new_price_rows,
        count(CASE WHEN derive THEN 1 END) AS redo,
        (SELECT count(*) FROM b_watchlist WHERE NOT supported) AS failures FROM k_changes)"""
SQL["assign_groups"] = f"""
SELECT m.ticker, m.group_id, CAST(CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey % 5 + 1
    ELSE w.default_group_id END AS INTEGER) AS default_group_id
FROM (SELECT ticker, CAST(group_id AS INTEGER) AS group_id FROM b_stock_groups
      UNION SELECT {TICKER.format('s_suppkey')}, CAST(s_suppkey % 5 + 1 AS INTEGER) FROM supplier WHERE s_suppkey % 2 = 0
      UNION SELECT {TICKER.format('s_suppkey')}, 10 FROM supplier WHERE s_suppkey % 2 = 0) m
JOIN b_watchlist w USING (ticker) JOIN supplier ON s_suppkey = w.cik"""

# ---- rules -----------------------------------------------------------------------------
def _rule_rows() -> list[tuple]:
    from tidemark.plans.queries import RULES
    return RULES


CTES["r_rules"] = ("SELECT rule_id, name, scope, scope_ref, metric_key, condition, "
                   "CAST(threshold AS DOUBLE) AS threshold, enabled FROM (VALUES " + _values(_rule_rows())
                   + ") t(rule_id, name, scope, scope_ref, metric_key, condition, threshold, enabled)")
CTES["r_scoped"] = """
SELECT r.*, w.ticker FROM r_rules r JOIN b_watchlist w ON r.scope = 'all' AND w.supported WHERE r.enabled
UNION ALL SELECT r.*, g.ticker FROM r_rules r
  JOIN b_stock_groups g ON r.scope = 'group' AND CAST(g.group_id AS VARCHAR) = r.scope_ref
  JOIN b_watchlist w ON w.ticker = g.ticker AND w.supported WHERE r.enabled
UNION ALL SELECT r.*, upper(scope_ref) FROM r_rules r WHERE enabled AND scope = 'ticker' AND scope_ref IS NOT NULL"""
CTES["r_pairs"] = """
SELECT s.rule_id, s.ticker, s.condition, s.threshold,
  CASE WHEN s.metric_key = '__primary__' THEN g.primary_multiple ELSE m.metric_key END AS metric_key
FROM r_scoped s LEFT JOIN b_watchlist w USING (ticker)
LEFT JOIN b_metric_groups g ON g.group_id = w.default_group_id
LEFT JOIN m_metrics m ON m.metric_key = s.metric_key"""
CTES["r_all"] = """
SELECT p.*, r.date AS session, r.fundamentals_filed_at AS marker, l.value AS v
FROM r_pairs p JOIN x_ratios r ON r.ticker = p.ticker
LEFT JOIN x_long l ON l.ticker = p.ticker AND l.date = r.date AND l.metric_key = p.metric_key"""
CTES["r_wanted"] = """
SELECT DISTINCT ticker, metric_key FROM r_pairs WHERE condition LIKE 'percentile%'"""
CTES["r_pct"] = """
SELECT a.ticker, a.metric_key, a.date, count(*) AS n,
  count(CASE WHEN h.value <= a.value THEN 1 END) / count(*) * 100 AS pct
FROM r_wanted w JOIN x_long a ON a.ticker = w.ticker AND a.metric_key = w.metric_key
JOIN x_long h ON h.ticker = a.ticker AND h.metric_key = a.metric_key
 AND h.date BETWEEN a.date - 3652 AND a.date
GROUP BY 1, 2, 3"""
CTES["r_sessions"] = """
SELECT a.rule_id, a.ticker, a.session, a.condition, a.threshold, a.metric_key, a.v AS value,
  CASE WHEN condition LIKE 'percentile%' THEN p.pct END AS percentile, a.marker,
  coalesce(CASE condition WHEN 'value_below' THEN v < threshold WHEN 'value_above' THEN v > threshold
    WHEN 'percentile_below' THEN p.n >= 100 AND p.pct < threshold
    WHEN 'percentile_above' THEN p.n >= 100 AND p.pct > threshold END, false) AS holds
FROM r_all a LEFT JOIN r_pct p
  ON p.ticker = a.ticker AND p.metric_key = a.metric_key AND p.date = a.session"""
CTES["r_numbered"] = """
SELECT *, row_number() OVER (PARTITION BY rule_id, ticker ORDER BY session) AS k FROM r_sessions"""
CTES["r_judged"] = """
SELECT s.* EXCLUDE (holds), CASE WHEN s.condition = 'new_filing'
    THEN b.k IS NOT NULL AND s.marker IS NOT NULL AND s.marker IS DISTINCT FROM b.marker
    ELSE s.holds END AS holds
FROM r_numbered s LEFT JOIN r_numbered b ON b.rule_id = s.rule_id AND b.ticker = s.ticker AND b.k = s.k - 1"""
CTES["r_events"] = """
SELECT s.rule_id, s.ticker, s.session AS trigger_date, s.condition, s.threshold, s.metric_key,
  CASE WHEN s.condition <> 'new_filing' THEN s.value END AS value, s.percentile
FROM r_judged s LEFT JOIN r_judged b ON b.rule_id = s.rule_id AND b.ticker = s.ticker AND b.k = s.k - 1
WHERE s.holds AND NOT coalesce(b.holds, false)"""


def _fmt(v: str) -> str:
    one = lambda x: f"printf('%.1f', floor({x} * 10 + 0.5) / 10)"
    big = (f"CASE WHEN abs({v}) >= 1e12 THEN {one(f'({v} / 1e12)')} || 'T' "
           f"WHEN abs({v}) >= 1e9 THEN {one(f'({v} / 1e9)')} || 'B' "
           f"WHEN abs({v}) >= 1e6 THEN {one(f'({v} / 1e6)')} || 'M' "
           f"ELSE format('{{:,}}', CAST(floor({v} + 0.5) AS BIGINT)) END")
    return (f"CASE WHEN {v} IS NULL THEN '—' WHEN fmt = 'percent' THEN {one(f'({v} * 100)')} || '%' "
            f"WHEN fmt = 'multiple' THEN {one(v)} || 'x' "
            f"WHEN fmt = 'days' THEN CAST(CAST(floor({v} + 0.5) AS BIGINT) AS VARCHAR) || 'd' "
            f"WHEN fmt IN ('currency', 'number') THEN {big} "
            f"ELSE printf('%.2f', floor({v} * 100 + 0.5) / 100) END")


SQL["rule_pairs"] = "SELECT * FROM r_pairs"
SQL["rule_holds"] = """
SELECT s.rule_id, s.ticker, s.session, s.condition, s.threshold, s.metric_key,
  CASE WHEN s.condition <> 'new_filing' THEN s.value END AS value, s.percentile, s.marker, s.holds
FROM r_sessions s JOIN x_newest m ON m.ticker = s.ticker AND m.newest = s.session"""
SQL["trailing_percentile"] = """
SELECT a.ticker, a.date, a.metric_key, a.value, count(CASE WHEN h.value <= a.value THEN 1 END) / count(*) * 100 AS percentile,
  count(*) >= 100 AS sufficient
FROM x_long a JOIN x_long h ON h.ticker = a.ticker AND h.metric_key = a.metric_key AND h.date BETWEEN a.date - 3652 AND a.date
GROUP BY 1, 2, 3, 4"""
SQL["edge_trigger"] = "SELECT * FROM r_events"
SQL["stream_events"] = SQL["recorded_events"] = SQL["edge_trigger"]
SQL["rule_state"] = """
SELECT j.rule_id, j.ticker, j.session AS last_session, j.holds AS last_held,
  CASE WHEN j.condition = 'new_filing' THEN j.marker END AS last_marker
FROM r_judged j WHERE NOT EXISTS (
  SELECT 1 FROM r_judged n WHERE n.rule_id = j.rule_id AND n.ticker = j.ticker AND n.k = j.k + 1)"""
SQL["stream_state"] = SQL["rule_state"].replace("CASE WHEN j.condition = 'new_filing' THEN j.marker END", "j.marker")
SQL["new_filing"] = """
SELECT ticker, session, marker FROM (
  SELECT ticker, date AS session, fundamentals_filed_at AS marker,
         lag(fundamentals_filed_at) OVER (PARTITION BY ticker ORDER BY date) AS was,
         row_number() OVER (PARTITION BY ticker ORDER BY date) AS k FROM x_ratios)
WHERE k > 1 AND marker IS NOT NULL AND marker IS DISTINCT FROM was"""
SQL["event_text"] = f"""
SELECT rule_id, ticker, trigger_date, metric_key, value, percentile,
  CASE WHEN condition = 'new_filing' THEN ticker || ' filed new financials'
    WHEN condition LIKE 'percentile%' THEN ticker || ' ' || label || ' ' || {_fmt('value')} || ' — '
      || printf('%.1f', floor(percentile * 10 + 0.5) / 10) || ' percentile of its own history (rule: '
      || CASE WHEN condition LIKE '%below' THEN 'below ' ELSE 'above ' END
      || CAST(CAST(floor(threshold + 0.5) AS BIGINT) AS VARCHAR) || ')'
    ELSE ticker || ' ' || label || ' ' || {_fmt('value')} || ' (rule: '
      || CASE WHEN condition LIKE '%below' THEN 'below ' ELSE 'above ' END || {_fmt('threshold')} || ')' END AS detail
FROM r_events LEFT JOIN m_metrics USING (metric_key)"""
SQL["rule_validation"] = """
WITH c AS (SELECT o_orderkey AS rule_id,
    CASE WHEN o_orderkey % 50 = 0 THEN '' ELSE 'rule ' || o_custkey || ' ' || (o_orderkey % 5) END AS name,
    CASE o_orderkey % 4 WHEN 0 THEN 'all' WHEN 1 THEN 'group' WHEN 2 THEN 'ticker' ELSE 'some' END AS scope,
    o_orderkey % 3 = 0 AS has_ref, o_orderkey % 6 = 5 AS bad_metric,
    CASE o_orderkey % 7 WHEN 0 THEN 'new_filing' WHEN 1 THEN 'percentile_below' WHEN 2 THEN 'percentile_above'
      WHEN 3 THEN 'value_below' WHEN 4 THEN 'value_above' WHEN 5 THEN 'value_equal' ELSE 'percentile_below' END AS condition,
    CASE WHEN o_orderkey % 8 > 2 THEN o_orderkey % 130 END AS threshold FROM orders)
SELECT rule_id, name, scope, condition, concat_ws('; ',
  CASE WHEN name = '' THEN 'no name' END, CASE WHEN scope = 'some' THEN 'invalid scope' END,
  CASE WHEN scope <> 'all' AND NOT has_ref THEN 'no scope reference' END,
  CASE WHEN condition = 'value_equal' THEN 'invalid condition' END,
  CASE WHEN bad_metric THEN 'unknown metric' END,
  CASE WHEN condition <> 'new_filing' AND threshold IS NULL THEN 'threshold is not a number' END,
  CASE WHEN condition LIKE 'percentile%' AND threshold > 100 THEN 'percentile out of range' END,
  CASE WHEN name <> '' AND EXISTS (SELECT 1 FROM c o WHERE o.name = c.name AND o.rule_id < c.rule_id)
       THEN 'name already exists' END) AS errors
FROM c"""
_events = f"""
SELECT event_id, CAST(ts AS TIMESTAMP) AS created_at, CAST(event_id % 11 + 1 AS INTEGER) AS rule_id,
  {TICKER.format('user_id')} AS ticker, CAST(ts AS DATE) AS trigger_date,
  CASE WHEN event_id % 3 > 0 THEN 'pe_ttm' END AS metric_key, value,
  CASE WHEN event_id % 4 = 0 THEN value / 2 END AS percentile, concat_ws(' ', event_type, props) AS detail FROM events WHERE event_type NOT IN ('view', 'click')"""
SQL["open_events"] = f"""
SELECT event_id, created_at, e.rule_id, r.name AS rule_name, ticker, trigger_date, e.metric_key, value, percentile, detail
FROM ({_events}) e JOIN r_rules r USING (rule_id)
ORDER BY trigger_date DESC, event_id DESC LIMIT 50"""
SQL["rule_listing"] = f"""
SELECT r.rule_id, r.name, r.scope, CASE r.scope WHEN 'all' THEN 'All stocks'
    WHEN 'group' THEN coalesce((SELECT g.name FROM b_metric_groups g WHERE CAST(g.group_id AS VARCHAR) = r.scope_ref),
                               'Group ' || r.scope_ref) ELSE r.scope_ref END AS scope_label,
  r.metric_key, r.condition, r.threshold, r.enabled,
  (SELECT count(*) FROM ({_events}) e WHERE e.rule_id = r.rule_id) AS open_count
FROM r_rules r"""

# ---- checks ----------------------------------------------------------------------------
SQL["check_lookahead"] = """
SELECT * FROM (SELECT ticker, date, CASE WHEN day(date) = 15 THEN date + 1 ELSE fundamentals_filed_at END
  AS fundamentals_filed_at FROM x_ratios) WHERE fundamentals_filed_at > date"""
SQL["check_step"] = """
SELECT ticker, date, was, revenue_ttm FROM (
  SELECT ticker, date, revenue_ttm, fundamentals_filed_at AS f, lag(revenue_ttm) OVER w AS was,
         lag(fundamentals_filed_at) OVER w AS fw
  FROM (SELECT * REPLACE (CASE WHEN day(date) = 10 THEN revenue_ttm * 1.25::DOUBLE ELSE revenue_ttm END AS revenue_ttm) FROM x_ratios)
  WHERE revenue_ttm IS NOT NULL WINDOW w AS (PARTITION BY ticker ORDER BY date))
WHERE revenue_ttm <> was AND f IS NOT DISTINCT FROM fw"""
SQL["check_identities"] = """
SELECT * FROM (SELECT ticker, date, concat_ws(', ',
  CASE WHEN earnings_yield > 0 AND abs(pe_ttm - 1 / earnings_yield) > abs(1 / earnings_yield) * 1e-6 THEN 'reciprocal' END,
  CASE WHEN abs(enterprise_value - (market_cap + net_debt)) > abs(market_cap + net_debt) * 1e-9 THEN 'enterprise value' END)
  AS broken FROM (SELECT * REPLACE (
    CASE WHEN day(date) = 7 THEN enterprise_value * 1.5::DOUBLE ELSE enterprise_value END AS enterprise_value,
    CASE WHEN day(date) = 9 THEN pe_ttm * 1.5::DOUBLE ELSE pe_ttm END AS pe_ttm) FROM x_ratios)) WHERE broken <> ''"""
SQL["check_negative"] = """
SELECT ticker, date, metric_key, value FROM (SELECT * REPLACE (CASE WHEN day(date) = 3
  AND metric_key IN ('pe_ttm', 'ev_sales', 'ev_ebitda') THEN -value ELSE value END AS value) FROM x_long)
WHERE value < 0 AND metric_key IN ('pe_ttm', 'ev_ebitda', 'ev_sales', 'ps_ttm', 'ev_fcf')"""
SQL["check_bounds"] = """
SELECT * FROM (SELECT ticker, date, gross_margin * 2.72::DOUBLE AS gross_margin, operating_margin FROM x_ratios)
WHERE gross_margin > 1 OR gross_margin < -1 OR operating_margin > 1 OR operating_margin < -5"""
SQL["check_cliffs"] = """
SELECT * FROM (SELECT ticker, date, market_cap / lag(market_cap) OVER (PARTITION BY ticker ORDER BY date) AS ratio
  FROM x_ratios WHERE market_cap IS NOT NULL) WHERE ratio <= 0.5 OR ratio >= 2"""
SQL["check_freshness"] = """
SELECT ticker, newest AS last FROM x_newest WHERE newest < DATE '2001-11-01'"""
SQL["check_restated_shares"] = """
SELECT ticker, concept, period_end, original, restated FROM (
  SELECT v.ticker, v.concept, v.period_end, v.first_value * fa.factor AS original, v.last_value * fb.factor AS restated
  FROM (SELECT ticker, concept, period_end, duration_days, first(value ORDER BY filed_at, accession) AS first_value,
          last(value ORDER BY filed_at, accession) AS last_value, min(filed_at) AS lo, max(filed_at) AS hi
        FROM b_facts WHERE concept IN ('shares_diluted', 'shares_outstanding', 'shares_outstanding_gaap') GROUP BY 1, 2, 3, 4) v
  JOIN x_factor fa ON fa.ticker = v.ticker AND fa.filed_at = v.lo
  JOIN x_factor fb ON fb.ticker = v.ticker AND fb.filed_at = v.hi WHERE v.lo < v.hi)
WHERE abs(original - restated) > abs(restated) * 1e-4"""


def oracle_sql() -> dict[str, str]:
    return {k: compose(v) for k, v in SQL.items()}
