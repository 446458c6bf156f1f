"""Scalar expressions: Column in, Column out, all inside code generation."""
from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from ..rules import SEARCH_SEPARATORS, VISIT_LABELS, STREET_WORDS, THEME_PATTERNS


def r6(c: Column, places: int = 6) -> Column:
    """Rounded for output; adding zero turns -0.0 into 0.0."""
    return F.round(c, places) + F.lit(0.0)


def norm_key(c: Column) -> Column:
    """Lower case, every run of other characters one blank, no blanks at the ends."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", " "))


def safe_int(c: Column) -> Column:
    """Whole part of a number written as text; null when it is not one."""
    return c.try_cast("double").try_cast("int")


def zip5(c: Column) -> Column:
    found = F.regexp_extract(c, r"(\d{5})", 1)
    return F.when(found != "", found)


def zip3(c: Column) -> Column:
    return F.substring(c, 1, 3)


def month_start(c: Column) -> Column:
    return F.trunc(c, "month")


def quarter_label(c: Column) -> Column:
    return F.concat(F.year(c).cast("string"), F.lit("Q"), F.quarter(c).cast("string"))


def month_label(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM")


def daynum(c: Column) -> Column:
    """Days since 1970-01-01, the integer that range frames need."""
    return F.unix_date(c)


def age_years(day: Column, opened: Column) -> Column:
    return F.datediff(day, opened) / F.lit(365.25)


def possible_age(day: Column, opened: Column) -> Column:
    age = age_years(day, opened)
    return F.when(age >= 0, age)


def months_between_30_44(earlier: Column, later: Column) -> Column:
    return F.datediff(later, earlier) / F.lit(30.44)


def within_months(day: Column, end: Column, months: float) -> Column:
    return F.coalesce(months_between_30_44(day, end).between(0, months), F.lit(False))


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Both ends of the score interval for k of n; null without rows."""
    k, n = k.cast("double"), F.when(n > 0, n.cast("double"))
    p = k / n
    d = 1 + F.lit(z * z) / n
    mid = (p + F.lit(z * z) / (2 * n)) / d
    half = F.lit(z) * F.sqrt(p * (1 - p) / n + F.lit(z * z) / (4 * n * n)) / d
    return r6(mid - half, 4), r6(mid + half, 4)


def log_odds(p: Column, eps: float = 1e-6) -> Column:
    q = F.greatest(F.lit(eps), F.least(F.lit(1 - eps), p))
    return F.log(q / (1 - q))


def half_up(c: Column) -> Column:
    """Nearest whole number, halves upward, as a person rounds by hand."""
    return F.floor(c + F.lit(0.5))


def metres(lon_a: Column, lat_a: Column, lon_b: Column, lat_b: Column) -> Column:
    """Planar distance; good within a city."""
    dx = (lon_b - lon_a) * F.lit(111320.0) * F.cos(lat_a * F.lit(math.pi) / F.lit(180.0))
    dy = (lat_b - lat_a) * F.lit(110540.0)
    return F.sqrt(dx * dx + dy * dy)


def search_tokens(query: Column) -> Column:
    """Words of a query: separators and joining words dropped, street words written out."""
    cut = F.split(F.lower(query), SEARCH_SEPARATORS)
    bare = F.transform(cut, lambda t: F.regexp_replace(F.trim(t), r"\.$", ""))
    words = F.create_map(*[F.lit(x) for kv in STREET_WORDS.items() for x in kv])
    return F.transform(F.filter(bare, lambda t: t != ""), lambda t: F.coalesce(words[t], t))


def expand_streets(text: Column) -> Column:
    out = F.lower(F.coalesce(text, F.lit("")))
    for short, whole in STREET_WORDS.items():
        out = F.regexp_replace(out, rf"\b{short}\b\.?", whole)
    return out


def visit_phrase(visit_type: Column, source_type: Column) -> Column:
    """A visit in words; a type that is this library's reading says so and names the source's type."""
    label = visit_type
    for kind, words in VISIT_LABELS.items():
        label = F.when(visit_type == kind, words).otherwise(label)
    said = F.trim(F.coalesce(source_type, F.lit("")))
    note = F.when(said == "", " [type read]").otherwise(F.concat(F.lit(" [type read from: "), said, F.lit("]")))
    return F.concat(label, F.when(visit_type.isin("followup", "complaint"), note).otherwise(""))


def plain_number(c: Column, places: int = 1) -> Column:
    """Blank for null, no trailing zeros, no trailing point."""
    if places == 0:
        return F.coalesce(F.bround(c).cast("long").cast("string"), F.lit(""))
    text = F.format_string(f"%.{places}f", F.bround(c.cast("double"), places))
    return F.when(c.isNull(), "").otherwise(F.regexp_replace(text, r"\.?0+$", ""))


def name_group(name: Column, groups: dict[str, list[str]]) -> Column:
    """First group that shares a whole word with the name, else ``unclassified``."""
    words = F.split(F.lower(F.coalesce(name, F.lit(""))), "[^a-z]+")
    out = F.lit("unclassified")
    for label, keys in reversed(list(groups.items())):
        out = F.when(F.arrays_overlap(words, F.array(*[F.lit(k) for k in keys])), label).otherwise(out)
    return out


def theme_of(text: Column) -> Column:
    """First theme whose pattern is in the item text, else ``other``."""
    bare = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"^\s*\d+[a-z]?\.\s*", ""))
    out = F.lit("other")
    for theme, pattern in reversed(THEME_PATTERNS):
        out = F.when(bare.rlike(pattern), theme).otherwise(out)
    return out


def formula_safe(c: Column) -> Column:
    """Text a spreadsheet would run as a formula gets a leading apostrophe; numbers stay."""
    risky = c.rlike(r"^[=+\-@\t\r]") & c.try_cast("double").isNull()
    return F.when(risky, F.concat(F.lit("'"), c)).otherwise(c)


def formula_text(c: Column) -> Column:
    """The inverse of :func:`formula_safe`."""
    return F.when(c.rlike(r"^'[=+\-@\t\r]"), F.substring(c, 2, 1 << 30)).otherwise(c)


def points_formula(major: Column, minor: Column, grp: Column, weights=(4, 2, 1)) -> Column:
    a, b, c = weights
    return F.greatest(F.lit(0), 100 - a * major - b * minor - c * grp)
