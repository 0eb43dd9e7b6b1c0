"""Format checks of extracted fields: the value in its canonical form, or an empty string. Never null, never an error."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from .columns import bind
from .text import strip

# Accepted date patterns, in order.
DATE_PATTERNS = ("d/M/yyyy", "d/M/yy", "d-MMM-yyyy", "d-MMM-yy", "d-M-yyyy", "MMMM d, yyyy", "MMM d, yyyy")
# The shapes of those patterns; parsing follows only where the shape fits.
DATE_SHAPES = (
    r"^\d{1,2}/\d{1,2}/\d{4}$", r"^\d{1,2}/\d{1,2}/\d{2}$", r"^\d{1,2}-[A-Za-z]{3}-\d{4}$", r"^\d{1,2}-[A-Za-z]{3}-\d{2}$",
    r"^\d{1,2}-\d{1,2}-\d{4}$", r"^[A-Za-z]+\s+\d{1,2},\s+\d{4}$", r"^[A-Za-z]{3}\s+\d{1,2},\s+\d{4}$",
)


def check_date(value: Column) -> Column:
    bare = F.regexp_replace(strip(value), r"(?i)([0-9]+)(st|nd|rd|th)", "$1")
    bare = strip(F.regexp_replace(bare, r"\s+\d{1,2}:\d{2}.*$", ""))
    return bind(F.regexp_replace(bare, r"\s+", " "), _date)


def _date(bare: Column) -> Column:
    """The date by the first pattern that fits; each is tried where its shape fits only."""
    tries = []
    for pattern, shape in zip(DATE_PATTERNS, DATE_SHAPES):
        day = F.try_to_date(F.when(bare.rlike(shape), F.initcap(F.lower(bare)) if "MMM" in pattern else bare), pattern)
        if pattern.endswith("yy") and not pattern.endswith("yyyy"):  # two digits from 69 on are of the last century
            day = bind(day, lambda d: F.when(F.year(d) >= 2069, F.add_months(d, -1200)).otherwise(d))
        tries.append(day)
    return F.coalesce(F.date_format(F.coalesce(*tries), "dd/MM/yyyy"), F.lit(""))


def check_phone(value: Column) -> Column:
    digits = F.regexp_replace(value, r"(?U)\D", "")
    return F.when(F.length(digits).between(9, 11), digits).otherwise("")


def check_email(value: Column) -> Column:
    return F.when(F.contains(value, F.lit(".")) & value.rlike(r"[\p{L}\p{N}]"), value).otherwise("")


def check_currency(value: Column) -> Column:
    return F.when(value.rlike(r"(?U)\d"), value).otherwise("")


def check_percent(value: Column) -> Column:
    number = strip(F.regexp_replace(strip(value), r"%+\z", ""))
    number = F.regexp_replace(number, r"(?<=\d)_(?=\d)", "")
    plain = number.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\z") | F.lower(number).rlike(r"^[+-]?(inf|infinity|nan)\z")
    return F.when(plain, value).otherwise("")


def check_integer(value: Column) -> Column:
    return F.when(strip(value).rlike(r"(?U)^-?\d+\z"), value).otherwise("")


#: Registry; ``free_text`` and unknown formats are not checked. Add an entry to add a format.
CHECKS: dict[str, Callable[[Column], Column]] = {
    "date": check_date, "phone": check_phone, "email": check_email, "currency": check_currency, "percent": check_percent,
    "integer": check_integer,
}


def checked(value: Column, kind: str) -> Column:
    check = CHECKS.get(kind)
    return F.when(value == "", "").otherwise(check(value)) if check else value
