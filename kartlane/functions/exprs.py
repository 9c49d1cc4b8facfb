"""Column expressions: safe arithmetic, calendar helpers, labels.

All built-in ``pyspark.sql.functions`` — they stay inside whole-stage codegen.
ANSI mode stays on, so every division goes through ``safe_divide``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# -- arithmetic ---------------------------------------------------------------
def safe_divide(num, den) -> Column:
    """num / den, NULL when den is 0 or NULL (never raises under ANSI)."""
    return col(num) / F.nullif(col(den), F.lit(0))


def fdiv(num, den) -> Column:
    """Double division with NULL on zero denominators."""
    return col(num).cast("double") / F.nullif(col(den).cast("double"), F.lit(0.0))


def r4(c, digits: int = 4) -> Column:
    """Round half-up at ``digits`` decimals, robust to summation-order noise.

    Two stages: snap to 9 decimals through DECIMAL(38,9) (absorbs the last-bit
    noise that differs with partitioning), then round that exact decimal.
    The oracle SQL applies the same two stages.
    """
    return F.round(col(c).cast("decimal(38,9)"), digits).cast("double")


def clip(c, lo=None, hi=None) -> Column:
    out = col(c)
    if lo is not None:
        out = F.greatest(out, F.lit(lo))
    if hi is not None:
        out = F.least(out, F.lit(hi))
    return out


def combine_first(a, b) -> Column:
    return F.coalesce(col(a), col(b))


def fill_label(c, default: str = "Missing") -> Column:
    """NULL or blank string -> default label (strip first)."""
    return F.coalesce(F.nullif(F.trim(col(c)), F.lit("")), F.lit(default))


def margin_ratio(price, cost) -> Column:
    return safe_divide(col(price) - col(cost), col(price))


# -- item values (expr_item_values) -----------------------------------------
def item_value_columns(items: DataFrame) -> DataFrame:
    """gross = qty*price; net = gross - coalesce(discount, 0); cogs = qty*unit cogs."""
    gross = F.col("quantity") * F.col("unit_price")
    return items.withColumns({
        "gross_item_value": gross,
        "net_item_value": gross - F.coalesce(F.col("discount_amount"), F.lit(0.0)),
        "item_cogs": F.col("quantity") * F.col("cogs"),
    })


def discount_formula(promo_type, discount_value, quantity, unit_price) -> Column:
    """percentage: qty*price*value/100; fixed: qty*value."""
    return (F.when(col(promo_type) == "percentage",
                   col(quantity) * col(unit_price) * col(discount_value) / F.lit(100.0))
            .when(col(promo_type) == "fixed", col(quantity) * col(discount_value)))


# -- calendar -----------------------------------------------------------------
def month_trunc(d) -> Column:
    return F.trunc(col(d), "month")


def month_diff(later, earlier) -> Column:
    """(y2-y1)*12 + (m2-m1): calendar months, not months_between."""
    return ((F.year(col(later)) - F.year(col(earlier))) * 12
            + (F.month(col(later)) - F.month(col(earlier))))


def day_diff(later, earlier) -> Column:
    return F.datediff(col(later), col(earlier))


def month_name(d) -> Column:
    return F.date_format(col(d), "MMM")


def days_in_month(d) -> Column:
    return F.dayofmonth(F.last_day(col(d)))


def is_month_end(d) -> Column:
    return col(d) == F.last_day(col(d))


def weekday_mon0(d) -> Column:
    """Monday=0 .. Sunday=6 (pandas dayofweek)."""
    return F.weekday(col(d))


def last_friday_of_november(year_col) -> Column:
    nov30 = F.make_date(col(year_col), F.lit(11), F.lit(30))
    return F.next_day(F.date_sub(nov30, 7), "FRI")


def iso_date(d) -> Column:
    return F.date_format(col(d), "yyyy-MM-dd")


# -- labels -------------------------------------------------------------------
def period_label(year_c, cut: int = 2018) -> Column:
    return F.when(col(year_c) >= cut, F.lit("Recent")).otherwise(F.lit("Past"))


def era_label(year_c, bounds=(2014, 2019, 2020)) -> Column:
    """Four eras by year: < b0, [b0, b1), [b1, b2), >= b2."""
    b0, b1, b2 = bounds
    y = col(year_c)
    return (F.when(y < b0, F.lit("early")).when(y < b1, F.lit("growth"))
            .when(y < b2, F.lit("transition")).otherwise(F.lit("recent")))


def bucket_cap(c, cap: int = 24) -> Column:
    return F.when(col(c) < cap, col(c).cast("string")).otherwise(F.lit(f"{cap}+"))


def label_concat(*cols, sep: str = " / ") -> Column:
    return F.concat_ws(sep, *[col(c) for c in cols])


def any_negative(*cols) -> Column:
    out = None
    for c in cols:
        p = col(c) < 0
        out = p if out is None else (out | p)
    return out


def promo_used(a, b) -> Column:
    """A + B - A and B == A or B present."""
    return F.coalesce(col(a), col(b)).isNotNull()
