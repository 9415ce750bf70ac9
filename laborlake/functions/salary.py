"""Salary column functions (native expressions, no UDFs)."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values (must equal the reference for identical results) -------------------
# FX rates to USD by feed source; unknown sources are taken as USD.
FX_TO_USD = {"adzuna_in": 1 / 95.0, "adzuna_gb": 1.27, "adzuna_us": 1.0, "remotive": 1.0}
NATIVE_CURRENCY = {"adzuna_in": "INR", "adzuna_gb": "GBP", "adzuna_us": "USD", "remotive": "USD"}
MIN_CREDIBLE_ANNUAL_USD = 5000
PAY_BAND_MARGIN = 10000
PAY_BANDS = ("above_market", "at_market", "below_market")
# ---------------------------------------------------------------------------------------


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def clean_salary(col="salary") -> Column:
    """Mixed int / float / "$123,456/yr" / NULL → whole dollars as bigint.

    Text form, keep only digits and dots, take the digits before the first dot.
    ``try_cast`` keeps an over-long digit run (ANSI overflow) as NULL instead of failing.
    """
    numeric = F.regexp_replace(_c(col).cast("string"), r"[^0-9.]", "")
    whole = F.regexp_extract(numeric, r"^(\d+)", 1)
    return F.when(whole == "", F.lit(None).cast("bigint")).otherwise(whole.try_cast("bigint"))


def fx_rate(source) -> Column:
    m = F.create_map(*[x for k, v in FX_TO_USD.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(m[_c(source)], F.lit(1.0))


def native_currency(source) -> Column:
    m = F.create_map(*[x for k, v in NATIVE_CURRENCY.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(m[_c(source)], F.lit("USD"))


def to_usd(salary, source) -> Column:
    """Native-currency salary → USD rounded to cents; non-numeric or < 5,000 → NULL."""
    value = F.round(_c(salary).cast("string").try_cast("double") * fx_rate(source), 2)
    return F.when(value >= MIN_CREDIBLE_ANNUAL_USD, value)


def implausible_salary(salary, source) -> Column:
    """True where a numeric salary was dropped by the credibility floor (for counting)."""
    value = F.round(_c(salary).cast("string").try_cast("double") * fx_rate(source), 2)
    return value.isNotNull() & (value < MIN_CREDIBLE_ANNUAL_USD)


def pay_band(salary_vs_market) -> Column:
    vs = _c(salary_vs_market)
    return (F.when(vs > PAY_BAND_MARGIN, "above_market")
             .when(vs < -PAY_BAND_MARGIN, "below_market")
             .otherwise("at_market"))
