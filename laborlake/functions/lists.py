"""Small list / key / flag column functions used by the whole-table jobs."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values (must equal the reference for identical results) -------------------
TRUE_TEXT = ("true", "t", "1")
# Country code → region name used to rank postings for a profile; "Remote" always added.
COUNTRY_TO_REGION = {"in": "India", "us": "North America", "ca": "North America",
                     "gb": "Europe", "de": "Europe", "au": "Asia Pacific", "sg": "Asia Pacific"}
REMOTE_REGION = "Remote"
# Feed country code → region name at ingest ("in" and "us" are named, others upper-cased).
FEED_COUNTRY_REGION = {"in": "India", "us": "North America"}
# Profile fields counted by the completeness meter.
FILLABLE_FIELDS = ("full_name", "headline", "skills", "target_roles", "seniority",
                   "preferred_locations", "countries")
# ---------------------------------------------------------------------------------------


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _map(d: dict) -> Column:
    return F.create_map(*[x for k, v in d.items() for x in (F.lit(k), F.lit(v))])


def surrogate_key(col) -> Column:
    """``md5`` hex of the natural key (NULL stays NULL)."""
    return F.md5(_c(col))


def skill_count(col) -> Column:
    return F.size(F.coalesce(_c(col), F.array().cast("array<string>")))


def bool_text(col) -> Column:
    """'true'/'t'/'1' (any case) → true; anything else or NULL → false."""
    return F.coalesce(F.lower(_c(col).cast("string")).isin(*TRUE_TEXT), F.lit(False))


def provenance_label(is_real) -> Column:
    return F.when(_c(is_real), "real").otherwise("synthetic")


def csv_list(col, lower: bool = True) -> Column:
    """Comma text → array of trimmed (lower-cased) non-blank items; NULL → []."""
    parts = F.split(F.coalesce(_c(col), F.lit("")), ",")
    items = F.transform(parts, lambda s: F.lower(F.trim(s)) if lower else F.trim(s))
    return F.filter(items, lambda s: s != "")


def list_to_csv(col, sep: str = ", ") -> Column:
    """array → sep-joined trimmed non-blank items, blank result → NULL."""
    items = F.filter(F.transform(_c(col), lambda s: F.trim(s)), lambda s: s != "")
    joined = F.array_join(items, sep)
    return F.when(joined != "", joined)


def country_regions(countries) -> Column:
    """Profile country codes → distinct region names (in first-seen order) plus Remote."""
    mapped = F.transform(csv_list(countries), lambda c: _map(COUNTRY_TO_REGION)[c])
    return F.array_distinct(F.concat(F.filter(mapped, lambda r: r.isNotNull()),
                                     F.array(F.lit(REMOTE_REGION))))


def feed_country_region(code) -> Column:
    c = F.lower(_c(code))
    return F.coalesce(_map(FEED_COUNTRY_REGION)[c], F.upper(c))


def profile_completeness(*cols) -> Column:
    cols = cols or FILLABLE_FIELDS
    return sum((F.when(F.trim(F.coalesce(_c(c).cast("string"), F.lit(""))) != "", 1)
                 .otherwise(0) for c in cols), F.lit(0))
