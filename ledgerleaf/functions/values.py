"""Typed readings of raw strings: amounts, dates, identifiers."""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerleaf.functions.text import WHITESPACE, blank_to_null

# Every decimal digit outside ASCII with its value, by rule.
_DIGITS = {
    chr(c): str(unicodedata.decimal(chr(c)))
    for c in range(128, sys.maxunicode + 1)
    if unicodedata.category(chr(c)) == "Nd"
}
_FOREIGN_DIGIT = r"[\p{Nd}&&[^0-9]]"
_CURRENCY_MARK = r"(?iu)^\s*(?:Rs\.?|INR|₹)\s*"

# --- Fixed values: identifier formats ----------------------------------------------
GSTIN_FORMAT = r"(?iu)^[0-9]{2}[A-Z]{5}[0-9]{4}[A-Z][1-9A-Z]Z[0-9A-Z]$"
PAN_FORMAT = r"(?iu)^[A-Z]{5}[0-9]{4}[A-Z]$"
IFSC_FORMAT = r"(?iu)^[A-Z]{4}0[A-Z0-9]{6}$"

# --- Fixed values: date formats, in the order they are tried -------------------------
DATE_FORMATS = (
    (r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yyyy"),
    (r"^\d{1,2}-\d{1,2}-\d{4}$", "d-M-yyyy"),
    (r"^\d{1,2} [A-Za-z]{3} \d{4}$", "d MMM yyyy"),
    (r"^\d{1,2} [A-Za-z]{3,9} \d{4}$", "d MMMM yyyy"),
    (r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d"),
    (r"^\d{1,2}\.\d{1,2}\.\d{4}$", "d.M.yyyy"),
)


def ascii_digits(c: Column) -> Column:
    """Write decimal digits of any script in ASCII; plain text passes untouched."""
    mapped = F.translate(c, "".join(_DIGITS), "".join(_DIGITS.values()))
    return F.when(c.rlike(_FOREIGN_DIGIT), mapped).otherwise(c)


def amount(c: Column, mode: str = "plain") -> Column:
    """Number in a money string, or null.

    ``plain`` keeps digits, dots and minus signs as they stand, so the dot of
    ``Rs.`` stays too. ``strict_currency`` drops a leading currency mark first.
    """
    if mode not in ("plain", "strict_currency"):
        raise ValueError(f"unknown amount mode {mode!r}")
    if mode == "strict_currency":
        c = F.regexp_replace(c, _CURRENCY_MARK, "")
    return F.regexp_replace(ascii_digits(c), r"[^0-9.\-]", "").try_cast("double")


def tax_part(c: Column) -> Column:
    """Unsigned number in a tax string; unreadable text counts as zero."""
    number = F.regexp_replace(ascii_digits(c), r"[^0-9.]", "").try_cast("double")
    return F.coalesce(number, F.lit(0.0))


def date(c: Column) -> Column:
    """Date written in one of the supported formats, or null.

    The shape test keeps the (slow) failing parse off almost every row.
    """
    text = F.regexp_replace(blank_to_null(c), "[" + WHITESPACE + "]+", " ")
    return F.coalesce(
        *(F.when(text.rlike(shape), F.try_to_timestamp(text, F.lit(fmt))) for shape, fmt in DATE_FORMATS)
    ).cast("date")


def has_format(c: Column, pattern: str) -> Column:
    return F.coalesce(blank_to_null(c).rlike(pattern), F.lit(False))


def two_decimals(c: Column) -> Column:
    return F.format_string("%.2f", c)
