"""Column helpers for text: trimming, lines, keyword values, entity mentions.

Everything is a built-in expression; no row leaves the JVM.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# All characters that count as white space, by rule rather than by list.
WHITESPACE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())

# Line ends other than "\n"; each ends a line of text.
_OTHER_LINE_ENDS = "[\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
_ANY_LINE_END = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"

_W = r"[\p{L}\p{N}_]"
_EDGE = rf"(?:(?<={_W})(?!{_W})|(?<!{_W})(?={_W}))"
# Letters matched case-insensitively, with the four extra code points that fold to ASCII.
_AZ = "[A-Za-zİıſK]"
_SPACE = "[" + re.escape(WHITESPACE) + "]"
_MONTHS = "(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)"

# --- Fixed values: shapes of the entities ---------------------------------------
GSTIN = rf"(?<!{_W})[0-9]{{2}}{_AZ}{{5}}[0-9]{{4}}{_AZ}[1-9A-Za-zİıſK][Zz][0-9A-Za-zİıſK](?!{_W})"
PAN = rf"(?<!{_W}){_AZ}{{5}}[0-9]{{4}}{_AZ}(?!{_W})"
DATE = (
    rf"(?<!{_W})(?:\p{{Nd}}{{1,2}}[/-]\p{{Nd}}{{1,2}}[/-]\p{{Nd}}{{2,4}}"
    rf"|\p{{Nd}}{{4}}[/-]\p{{Nd}}{{1,2}}[/-]\p{{Nd}}{{1,2}}"
    rf"|\p{{Nd}}{{1,2}}{_SPACE}+(?iu:{_MONTHS}[a-z]*){_SPACE}+\p{{Nd}}{{2,4}})(?!{_W})"
)
MONEY = r"(?iu:Rs\.?|INR|₹)?" + _SPACE + r"*([0-9]{1,3}(?:,[0-9]{2,3})*(?:\.[0-9]{2})?)"
EMAIL = rf"{_EDGE}[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{{2,}}{_EDGE}"
PHONE = (
    rf"{_EDGE}(?:\+?\p{{Nd}}{{1,3}}(?:[-.]|{_SPACE})?)?\(?\p{{Nd}}{{3}}\)?(?:[-.]|{_SPACE})?"
    rf"\p{{Nd}}{{3}}(?:[-.]|{_SPACE})?\p{{Nd}}{{4}}(?!{_W})"
)


def strip(c: Column) -> Column:
    """Trim every kind of white space from both ends."""
    return F.trim(c, F.lit(WHITESPACE))


def blank_to_null(c: Column) -> Column:
    return F.nullif(strip(c), F.lit(""))


def is_blank(c: Column) -> Column:
    """True for null, empty and white-space-only strings."""
    return F.coalesce(strip(c) == "", F.lit(True))


def has_text(c: Column) -> Column:
    """True for a non-empty string; blanks count as text."""
    return F.coalesce(c != "", F.lit(False))


def lines(text: Column) -> Column:
    """Stripped, non-empty lines of a text."""
    raw = F.split(F.regexp_replace(text, _OTHER_LINE_ENDS, "\n"), "\n")
    return F.filter(F.transform(raw, strip), lambda x: x != "")


def line_count(text: Column) -> Column:
    """Number of lines; a final line end opens no further line."""
    ends = F.regexp_count(text, F.lit(_ANY_LINE_END))
    tail = F.when(text == "", 0).when(F.right(text, F.lit(1)).rlike(f"(?s)^(?:{_ANY_LINE_END})$"), 0)
    return (ends + tail.otherwise(1)).cast("int")


def candidates(line_array: Column) -> Column:
    """Lines that carry a value after their first ``:``, ``-`` or ``=``.

    Each becomes ``(upper-case line, value)``, so that all keyword look-ups of a
    document share one pass over its text.
    """
    pairs = F.transform(
        F.filter(line_array, lambda x: x.rlike(r"[:\-=]")),
        lambda x: F.struct(
            F.upper(x).alias("line"),
            strip(F.regexp_extract(x, r"(?s)^[^:\-=]*[:\-=](.*)$", 1)).alias("value"),
        ),
    )
    return F.filter(pairs, lambda p: p["value"] != "")


def _alternatives(keywords: Sequence[str]) -> str:
    return "|".join(re.escape(k) for k in keywords)


def keyword_value(cands: Column, keywords: Sequence[str], whole_words: bool) -> Column:
    """Value of the first candidate line that names one of the keywords."""
    pattern = f"(?:{_alternatives(keywords)})"
    if whole_words:
        pattern = rf"(?<![A-Z0-9]){pattern}(?![A-Z0-9])"
    return F.get(F.filter(cands, lambda p: p["line"].rlike(pattern)), F.lit(0))["value"]


def mentions(text: Column, pattern: str, group: int = 0) -> Column:
    """All matches of an entity pattern, in text order."""
    return F.regexp_extract_all(text, F.lit(pattern), group)


def nth(array: Column, n: int) -> Column:
    return F.get(array, F.lit(n))


def corpus(pages: Column) -> Column:
    """Page texts joined by line ends, in page order."""
    return F.array_join(F.transform(pages, lambda p: p["text"]), "\n")
