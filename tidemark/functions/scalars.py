"""Column functions shared by the operators. All stay inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Tolerances and day ranges that decide results.
QUARTER_DAYS = (80, 100)
HALF_DAYS = (170, 190)
NINE_MONTH_DAYS = (260, 285)
ANNUAL_DAYS = (340, 380)
LOOSE_YEAR_DAYS = (300, 420)
SUBTOTAL_TOLERANCE = 0.001
RECONCILE_TOLERANCE = 0.01
WINDOW_YEARS = 10
RULE_WINDOW_DAYS = 3652
RULE_MIN_ROWS = 100
GRID_MIN_YEARS = 3
GRID_MIN_ROWS = 100


def safe_div(num: Column, den: Column) -> Column:
    """num / den, null where the denominator is unknown or zero."""
    return F.when(den != 0, num / den)


def safe_div_pos(num: Column, den: Column) -> Column:
    """num / den, null unless the denominator is strictly positive."""
    return F.when(den > 0, num / den)


def zero_if_null(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def close_to(a: Column, b: Column, tolerance: float) -> Column:
    """Relative equality against `b`; an absolute slack of one when `b` is zero."""
    return F.when(b == 0, F.abs(a) < 1).otherwise(F.abs(a - b) / F.abs(b) <= tolerance)


def years_before(d: Column, years: int) -> Column:
    """The same calendar day `years` earlier; 29 February rolls to 1 March."""
    shifted = F.add_months(d, -12 * years)
    rolls = (F.month(d) == 2) & (F.dayofmonth(d) == 29) & (F.dayofmonth(shifted) == 28)
    return F.when(rolls, F.date_add(shifted, 1)).otherwise(shifted)


def duration_bucket(days: Column) -> Column:
    """Q / H / 9M / FY by inclusive day range, else null."""
    return (
        F.when(days.between(*QUARTER_DAYS), "Q")
        .when(days.between(*HALF_DAYS), "H")
        .when(days.between(*NINE_MONTH_DAYS), "9M")
        .when(days.between(*ANNUAL_DAYS), "FY")
    )


def parse_number(cell: Column) -> Column:
    """Rendered table cell to number: parentheses negate, percentages are not amounts.

    A leading minus sign is dropped, as the data source never uses one for amounts.
    """
    text = F.trim(cell)
    digits = F.regexp_replace(text, "[^0-9.]", "")
    value = digits.try_cast("double")
    negative = text.startswith("(") | text.startswith("$ (")
    usable = ~text.isin("", "nan", "—", "–", "-") & ~text.contains("%")
    return F.when(usable, F.when(negative, -value).otherwise(value))


def detect_scale(html: Column) -> Column:
    """Multiplier named in a table header, 1 when none is named."""
    word = F.lower(F.regexp_extract(html, r"(?i)\$\s*in\s*(thousands|millions|billions)", 1))
    return (
        F.when(word == "thousands", 1e3).when(word == "millions", 1e6)
        .when(word == "billions", 1e9).otherwise(1.0)
    )


def percentile_band(pct: Column) -> Column:
    """Band 1 (lowest fifth) to 5; null percentile has no band."""
    return F.when(pct.isNotNull(),
                  F.when(pct <= 20, 1).when(pct <= 40, 2).when(pct <= 60, 3)
                  .when(pct <= 80, 4).otherwise(5))


def range_position(value: Column, low: Column, high: Column) -> Column:
    """Place of `value` between low and high in percent; 50 when there is no span."""
    return F.when(high - low > 0, (value - low) / (high - low) * 100).when(
        value.isNotNull(), F.lit(50.0))


def half_up(value: Column, scale: float) -> Column:
    """Round half up at 1/scale using plain IEEE steps, so engines agree bit for bit."""
    return F.floor(value * scale + 0.5) / F.lit(scale)


def format_amount(value: Column, fmt: Column) -> Column:
    """Text of a metric value in the registry's format."""
    one = lambda v: F.format_string("%.1f", half_up(v, 10.0))
    size = F.abs(value)
    big = (
        F.when(size >= 1e12, F.concat(one(value / 1e12), F.lit("T")))
        .when(size >= 1e9, F.concat(one(value / 1e9), F.lit("B")))
        .when(size >= 1e6, F.concat(one(value / 1e6), F.lit("M")))
        .otherwise(F.format_number(F.floor(value + 0.5).cast("double"), 0))
    )
    return (
        F.when(value.isNull(), "—")
        .when(fmt == "percent", F.concat(one(value * 100), F.lit("%")))
        .when(fmt == "multiple", F.concat(one(value), F.lit("x")))
        .when(fmt == "days", F.concat(F.floor(value + 0.5).cast("string"), F.lit("d")))
        .when(fmt.isin("currency", "number"), big)
        .otherwise(F.format_string("%.2f", half_up(value, 100.0)))
    )
