"""Column functions for cleaning keys, dates and numbers."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

EV_TYPES = ("BEV", "PHEV")


def normalize_zip(zip_: Column) -> Column:
    """Trimmed; one to five digits are padded with zeros to five, anything else stays."""
    z = F.trim(zip_)
    return F.when(z.rlike("^[0-9]{1,5}$"), F.lpad(z, 5, "0")).otherwise(z)


def clean_text(text: Column, default: str | None = None, upper: bool = False) -> Column:
    """Trimmed (and upper-cased) text; blank and null give ``default``."""
    t = F.nullif(F.trim(text), F.lit(""))
    t = F.upper(t) if upper else t
    return t if default is None else F.coalesce(t, F.lit(default))


def is_ev(drivetrain: Column, types: Iterable[str] = EV_TYPES) -> Column:
    """Whether the drivetrain is one of ``types``; false for null."""
    return F.coalesce(drivetrain.isin(*types), F.lit(False))


def snapshot_key(text: Column) -> Column:
    """Snapshot id as an int; null where the text is none."""
    return F.trim(text).try_cast("int")


def month_key(text: Column) -> Column:
    """Month text as given; null where blank."""
    return F.nullif(F.trim(text), F.lit(""))


def lenient_date(text: Column) -> Column:
    return F.try_to_date(text, "yyyy-MM-dd")


def strict_date(text: Column) -> Column:
    return F.to_date(text, "yyyy-MM-dd")


def lenient_double(text: Column) -> Column:
    return F.trim(text).try_cast("double")


def round_half_even(x: Column) -> Column:
    return F.bround(x).cast("long")


def fixed4(x: Column) -> Column:
    return F.format_string("%.4f", x)


def cents_to_units(cents: Column) -> Column:
    return cents.cast("double") / F.lit(100.0)


def month_start(date: Column) -> Column:
    return F.trunc(date, "MM")


def add_months_clamped(date: Column, months: Column | int) -> Column:
    return F.add_months(date, months)


def clamp01(x: Column) -> Column:
    return F.greatest(F.least(x, F.lit(1.0)), F.lit(0.0))


def finite(x: Column) -> Column:
    """True for numbers other than null, NaN and the infinities."""
    return F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False))


def array_dot(xs: Column, betas: Column) -> Column:
    return F.aggregate(F.zip_with(xs, betas, lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v)


def standardize(x: Column, mean: Column, std: Column) -> Column:
    return (x - mean) / std


def split_rows(text: Column, sep: str = ",") -> Column:
    """The trimmed, non-empty parts of a delimited text, to be exploded."""
    return F.filter(F.transform(F.split(text, sep), lambda p: F.trim(p)), lambda p: p != "")


def bracket_bounds(label: Column) -> Column:
    """(lo, hi) of an income label: "Under $a", "$a under $b", "$a or more" (hi null). Both null where the label is none."""
    t = F.regexp_replace(F.trim(label), ",", "")
    number = lambda pattern, i=1: F.nullif(F.regexp_extract(t, pattern, i), F.lit("")).try_cast("double")
    under, both, more = r"(?i)^under \$([0-9.]+)$", r"(?i)^\$([0-9.]+) under \$([0-9.]+)$", r"(?i)^\$([0-9.]+) or more$"
    lo = F.when(t.rlike(under), F.lit(0.0)).when(t.rlike(both), number(both)).when(t.rlike(more), number(more))
    hi = F.when(t.rlike(under), number(under)).when(t.rlike(both), number(both, 2))
    return F.struct(lo.alias("lo"), hi.alias("hi"))


def is_county_header(label: Column, total: Column) -> Column:
    """A label ending with "County" on a row without a total opens a county's block."""
    return F.coalesce(F.trim(label).endswith("County"), F.lit(False)) & total.isNull()
