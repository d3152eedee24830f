"""Concept, metric, group and rule registries: fixed values that must match the data source.

They are configuration, a few dozen rows in code, and reach plans as literal rows.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, types as T
from pyspark.sql.pandas.types import to_arrow_schema

# Concept -> (kind, namespace, tags by priority, tags of the second namespace).
CONCEPTS = {
    "revenue": ("duration", "us-gaap", [
        "RevenueFromContractWithCustomerExcludingAssessedTax",
        "RevenueFromContractWithCustomerIncludingAssessedTax",
        "Revenues", "SalesRevenueNet", "SalesRevenueGoodsNet",
    ], ["Revenue", "RevenueFromContractsWithCustomers"]),
    "cost_of_revenue": ("duration", "us-gaap", [
        "CostOfRevenue", "CostOfGoodsAndServicesSold", "CostOfGoodsSold", "CostOfServices",
    ], ["CostOfSales"]),
    "gross_profit": ("duration", "us-gaap", ["GrossProfit"], ["GrossProfit"]),
    "operating_income": ("duration", "us-gaap", ["OperatingIncomeLoss"],
                         ["ProfitLossFromOperatingActivities"]),
    "net_income": ("duration", "us-gaap", [
        "NetIncomeLoss", "ProfitLoss", "NetIncomeLossAvailableToCommonStockholdersBasic",
    ], ["ProfitLossAttributableToOwnersOfParent", "ProfitLoss"]),
    "pretax_income": ("duration", "us-gaap", [
        "IncomeLossFromContinuingOperationsBeforeIncomeTaxesExtraordinaryItemsNoncontrollingInterest",
        "IncomeLossFromContinuingOperationsBeforeIncomeTaxesMinorityInterestAndIncomeLossFromEquityMethodInvestments",
    ], ["ProfitLossBeforeTax"]),
    "income_tax": ("duration", "us-gaap", ["IncomeTaxExpenseBenefit"],
                   ["IncomeTaxExpenseContinuingOperations"]),
    "interest_expense": ("duration", "us-gaap", [
        "InterestExpense", "InterestExpenseDebt", "InterestExpenseNonoperating",
    ], ["FinanceCosts"]),
    "eps_diluted": ("duration", "us-gaap", ["EarningsPerShareDiluted"],
                    ["DilutedEarningsLossPerShare"]),
    "shares_diluted": ("duration", "us-gaap", [
        "WeightedAverageNumberOfDilutedSharesOutstanding",
        "WeightedAverageNumberOfShareOutstandingBasicAndDiluted",
    ], ["AdjustedWeightedAverageNumberOfOrdinarySharesOutstanding",
        "WeightedAverageNumberOfOrdinarySharesOutstandingDiluted"]),
    "operating_cash_flow": ("duration", "us-gaap", [
        "NetCashProvidedByUsedInOperatingActivities",
        "NetCashProvidedByUsedInOperatingActivitiesContinuingOperations",
    ], ["CashFlowsFromUsedInOperatingActivities"]),
    "capex": ("duration", "us-gaap", [
        "PaymentsToAcquirePropertyPlantAndEquipment", "PaymentsToAcquireProductiveAssets",
        "PaymentsForCapitalImprovements",
    ], ["PurchaseOfPropertyPlantAndEquipmentClassifiedAsInvestingActivities"]),
    "depreciation_amortization": ("duration", "us-gaap", [
        "DepreciationDepletionAndAmortization", "DepreciationAmortizationAndAccretionNet",
        "DepreciationAndAmortization",
    ], ["DepreciationAndAmortisationExpense"]),
    "depreciation_expense": ("duration", "us-gaap", ["Depreciation"], ["DepreciationExpense"]),
    "amortisation_expense": ("duration", "us-gaap", ["AmortizationOfIntangibleAssets"],
                             ["AmortisationExpense"]),
    "stock_based_compensation": ("duration", "us-gaap", [
        "ShareBasedCompensation", "AllocatedShareBasedCompensationExpense",
    ], []),
    "dividends_paid": ("duration", "us-gaap", [
        "PaymentsOfDividendsCommonStock", "PaymentsOfDividends",
    ], ["DividendsPaidClassifiedAsFinancingActivities", "DividendsPaid"]),
    "buybacks": ("duration", "us-gaap", ["PaymentsForRepurchaseOfCommonStock"], []),
    "cash": ("instant", "us-gaap", [
        "CashAndCashEquivalentsAtCarryingValue",
        "CashCashEquivalentsRestrictedCashAndRestrictedCashEquivalents",
    ], ["CashAndCashEquivalents"]),
    "short_term_investments": ("instant", "us-gaap", [
        "ShortTermInvestments", "MarketableSecuritiesCurrent",
        "AvailableForSaleSecuritiesDebtSecuritiesCurrent",
    ], []),
    "long_term_debt": ("instant", "us-gaap", ["LongTermDebtNoncurrent", "LongTermDebt"],
                       ["LongtermBorrowings", "BorrowingsNoncurrent"]),
    "short_term_debt": ("instant", "us-gaap", [
        "LongTermDebtCurrent", "DebtCurrent", "ShortTermBorrowings",
    ], ["ShorttermBorrowings"]),
    "inventory": ("instant", "us-gaap", ["InventoryNet"], ["Inventories"]),
    "total_assets": ("instant", "us-gaap", ["Assets"], ["Assets"]),
    "total_equity": ("instant", "us-gaap", [
        "StockholdersEquity",
        "StockholdersEquityIncludingPortionAttributableToNoncontrollingInterest",
    ], ["EquityAttributableToOwnersOfParent", "Equity"]),
    "current_assets": ("instant", "us-gaap", ["AssetsCurrent"], ["CurrentAssets"]),
    "current_liabilities": ("instant", "us-gaap", ["LiabilitiesCurrent"], ["CurrentLiabilities"]),
    "shares_outstanding": ("instant", "dei", ["EntityCommonStockSharesOutstanding"], []),
    "shares_outstanding_gaap": ("instant", "us-gaap", ["CommonStockSharesOutstanding"], []),
}
SECOND_NAMESPACE = "ifrs-full"

# Concepts whose absence is not a problem, and those built from others.
OPTIONAL = [
    "inventory", "dividends_paid", "buybacks", "short_term_debt", "short_term_investments",
    "stock_based_compensation", "gross_profit", "shares_outstanding", "shares_outstanding_gaap",
    "depreciation_expense", "amortisation_expense", "interest_expense", "current_assets",
    "current_liabilities", "long_term_debt",
]
DERIVABLE = {
    "depreciation_amortization": ["depreciation_expense", "amortisation_expense"],
    "gross_profit": ["revenue", "cost_of_revenue"],
    "operating_income": ["pretax_income"],
}
# Concepts that tell the reporting currency; flows, balances and share counts of a state.
MONETARY = ["revenue", "net_income", "total_assets", "cash", "total_equity"]

FLOWS = [
    "revenue", "cost_of_revenue", "gross_profit", "operating_income", "net_income",
    "pretax_income", "income_tax", "interest_expense", "operating_cash_flow", "capex",
    "depreciation_amortization", "depreciation_expense", "amortisation_expense",
    "stock_based_compensation", "dividends_paid", "buybacks",
]
STOCKS = [
    "cash", "short_term_investments", "long_term_debt", "short_term_debt", "inventory",
    "total_assets", "total_equity", "current_assets", "current_liabilities",
]
SHARES = ["shares_diluted", "shares_outstanding", "shares_outstanding_gaap"]

# Metric key -> (label, format, section, comparable between peers).
METRICS = {
    "pe_ttm": ("P/E (TTM)", "multiple", "paying", True),
    "ev_ebitda": ("EV/EBITDA", "multiple", "paying", True),
    "ev_sales": ("EV/Sales", "multiple", "paying", True),
    "ev_fcf": ("EV/FCF", "multiple", "paying", True),
    "fcf_yield": ("FCF Yield", "percent", "paying", True),
    "ps_ttm": ("P/S", "multiple", "paying", True),
    "pb": ("P/B", "multiple", "paying", True),
    "revenue_growth_yoy": ("Revenue Growth YoY", "percent", "getting", True),
    "gross_margin": ("Gross Margin", "percent", "getting", True),
    "operating_margin": ("Operating Margin", "percent", "getting", True),
    "net_margin": ("Net Margin", "percent", "getting", True),
    "fcf_margin": ("FCF Margin", "percent", "getting", True),
    "roic": ("ROIC", "percent", "getting", True),
    "roe": ("ROE", "percent", "getting", True),
    "fcf_conversion": ("FCF Conversion", "ratio", "getting", True),
    "inventory_days": ("Inventory Days", "days", "getting", True),
    "shares_diluted": ("Diluted Shares", "number", "integrity", False),
    "sbc_pct_revenue": ("SBC % of Revenue", "percent", "integrity", True),
    "net_debt_ebitda": ("Net Debt/EBITDA", "multiple", "leverage", True),
    "interest_coverage": ("Interest Coverage", "multiple", "leverage", True),
    "capex_pct_revenue": ("Capex % of Revenue", "percent", "leverage", True),
    "net_debt": ("Net Debt", "currency", "leverage", False),
}
# Sections in display order.
SECTIONS = ["paying", "getting", "integrity", "leverage"]

# Metric profile -> (leading multiple, metrics per section in order).
PROFILES = {
    "Big Tech": ("pe_ttm", {
        "paying": ["pe_ttm", "ev_ebitda", "ev_fcf", "fcf_yield"],
        "getting": ["revenue_growth_yoy", "gross_margin", "operating_margin", "fcf_margin",
                    "roic", "fcf_conversion"],
        "integrity": ["shares_diluted", "sbc_pct_revenue"],
    }),
    "AI / High Growth": ("ev_sales", {
        "paying": ["ev_sales", "ps_ttm", "fcf_yield"],
        "getting": ["revenue_growth_yoy", "gross_margin", "operating_margin", "fcf_margin"],
        "integrity": ["shares_diluted", "sbc_pct_revenue"],
    }),
    "Semiconductors": ("ev_ebitda", {
        "paying": ["ev_ebitda", "pe_ttm", "ev_sales", "fcf_yield"],
        "getting": ["revenue_growth_yoy", "gross_margin", "operating_margin", "roic",
                    "inventory_days"],
        "integrity": ["shares_diluted", "sbc_pct_revenue"],
        "leverage": ["net_debt_ebitda", "capex_pct_revenue", "interest_coverage"],
    }),
    "Energy": ("ev_ebitda", {
        "paying": ["ev_ebitda", "ev_fcf", "fcf_yield", "pe_ttm"],
        "getting": ["operating_margin", "roic", "revenue_growth_yoy"],
        "integrity": ["shares_diluted"],
        "leverage": ["net_debt_ebitda", "capex_pct_revenue", "interest_coverage"],
    }),
}

PRIMARY = "__primary__"
# Conditions of rules.
CONDITIONS = ["percentile_below", "percentile_above", "value_below", "value_above", "new_filing"]

# Starting rules (name, scope, group name, metric, condition, threshold).
DEFAULT_RULES = [
    ("Cheap vs its own history", "all", None, PRIMARY, "percentile_below", 15.0),
    ("Expensive vs its own history", "all", None, PRIMARY, "percentile_above", 90.0),
    ("Profit not converting to cash", "all", None, "fcf_conversion", "value_below", 0.8),
    ("Leverage above 3x EBITDA", "all", None, "net_debt_ebitda", "value_above", 3.0),
    ("New financials filed", "all", None, PRIMARY, "new_filing", None),
    ("Inventory piling up (semis)", "group", "Semiconductors", "inventory_days",
     "percentile_above", 85.0),
]


def literal_rows(spark: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
    """Configuration rows as a local relation, so Spark knows how small they are."""
    schema = T.StructType.fromDDL(ddl)
    columns = list(zip(*rows)) or [[] for _ in schema]
    arrow = to_arrow_schema(schema)
    return spark.createDataFrame(pa.table(
        [pa.array(list(c), f.type) for c, f in zip(columns, arrow)], schema=arrow))


def concept_tags(spark: SparkSession) -> DataFrame:
    """(namespace, tag, concept, kind, priority, concept_order); priority runs over both
    namespaces of a concept, first the primary one."""
    rows = []
    for order, (concept, (kind, namespace, tags, second)) in enumerate(CONCEPTS.items()):
        sources = [(namespace, t) for t in tags] + [(SECOND_NAMESPACE, t) for t in second]
        rows += [(ns, tag, concept, kind, p, order)
                 for p, (ns, tag) in enumerate(sources, start=1)]
    return literal_rows(
        spark, rows, "namespace string, tag string, concept string, kind string, priority int, "
              "concept_order int")


def concepts(spark: SparkSession) -> DataFrame:
    """(concept, kind, optional, components)."""
    rows = [(c, v[0], c in OPTIONAL, DERIVABLE.get(c, [])) for c, v in CONCEPTS.items()]
    return literal_rows(
        spark, rows, "concept string, kind string, optional boolean, components array<string>")


def metrics(spark: SparkSession) -> DataFrame:
    rows = [(k, *v, i) for i, (k, v) in enumerate(METRICS.items())]
    return literal_rows(
        spark, rows, "metric_key string, label string, fmt string, section string, "
              "peer_comparable boolean, metric_order int")


def profile_metrics(spark: SparkSession) -> DataFrame:
    """(profile, metric_key, section, sort_order); sort_order runs over the whole profile."""
    rows = []
    for profile, (_primary, sections) in PROFILES.items():
        flat = [(s, k) for s, keys in sections.items() for k in keys]
        rows += [(profile, k, s, i) for i, (s, k) in enumerate(flat)]
    return literal_rows(
        spark, rows, "profile string, metric_key string, section string, sort_order int")
