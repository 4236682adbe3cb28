"""Tolerant reading of text values. Nothing here raises under ANSI mode: bad input becomes null."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Spellings a CSV reader takes as "no value", in any column.
CSV_NA_TOKENS = (
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
)

# Tried in this order, so that an ambiguous day/month pair is read month first and only a pair that
# has no such month is read day first. A time of day after the date is left out before.
DATE_FORMATS = (
    "yyyy-M-d",
    "M/d/yyyy",
    "yyyy/M/d",
    "yyyyMMdd",
    "d-MMM-yyyy",
    "d-MMM-yy",
    "M/d/yy",
    "d MMM yyyy",
    "MMM d, yyyy",
    "MMM d yyyy",
    "d MMMM yyyy",
    "MMMM d, yyyy",
    "MMMM d yyyy",
    "M-d-yyyy",
    "yyyy.M.d",
    "d/M/yyyy",
    "d-M-yyyy",
    "d.M.yyyy",
    "yyyy-M",
)
# Hours and minutes, with optional seconds, fraction, half of the day and zone. The day is the one
# written: an offset does not move it.
_TIME = (
    r"(?:[Tt]| +)(?:[01]?[0-9]|2[0-3]):[0-5]?[0-9](?::[0-5]?[0-9](?:\.[0-9]+)?)?"
    r"(?: ?[AaPp][Mm])?(?: ?(?:[Zz]|UTC|[+-][0-9]{2}:?[0-9]{2}))?$"
)
# Two-digit years from here on belong to the century before.
_PIVOT = 2069

# Every character a Python string counts as white space.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

_INFINITY = "[iI][nN][fF](?:[iI][nN][iI][tT][yY])?"
_DIGITS = r"(?:[0-9]++(?:\.[0-9]*+)?|\.[0-9]++)(?:[eE][+-]?[0-9]++)?"
_PLAIN = r"^[+-]?[0-9]{1,300}+(?:\.[0-9]{0,300}+)?$"
_NUMBER = rf"^[+-]?(?:{_DIGITS}|{_INFINITY})$"


def strip_ws(c: Column) -> Column:
    """Trim every kind of Unicode white space; plain ``trim`` removes spaces only."""
    return F.btrim(c, F.lit(WHITE_SPACE))


def has_text(c: Column) -> Column:
    """True when the value holds anything but white space; null stays null."""
    return c.rlike(f"[^{''.join(f'\\u{ord(w):04x}' for w in WHITE_SPACE)}]")


def clean_header(c: Column) -> Column:
    """Header spelling: line breaks removed, trimmed, lower case."""
    return F.lower(strip_ws(F.regexp_replace(c, r"[\r\n]", "")))


def null_if_na(c: Column, tokens: Sequence[str] = CSV_NA_TOKENS) -> Column:
    return F.when(c.isin(list(tokens)), None).otherwise(c)


def to_amount(c: Column, kind: T.DataType, into: T.DataType | None = None) -> Column:
    """Amount column of type ``kind`` as a number; text that is not a plain number becomes null.

    The pattern runs before the cast because Spark would also take spellings such as ``1d``.
    """
    into = into or T.DoubleType()
    if not isinstance(kind, T.StringType):
        return c if kind == into else c.try_cast(into)
    text = strip_ws(c)
    value = text.try_cast(into)
    if isinstance(into, T.DecimalType):
        return F.when(text.rlike(_NUMBER), value)
    # Apart from plain decimals, a number may be too large for a double; it is then no number,
    # unless it says infinity.
    fits = (F.abs(value) < F.lit(float("inf"))) | text.rlike(_INFINITY)
    return F.when(text.rlike(_PLAIN), value).when(text.rlike(_NUMBER) & fits, value)


def _shape(date_format: str) -> str:
    """Pattern of the texts a date format can match. Checking it first spares the parser, whose
    refusal of a text is a costly exception.
    """
    shapes = {
        "yyyy": "[0-9]{4}", "yy": "[0-9]{2}", "MMMM": r"\p{L}+", "MMM": r"\p{L}{3}", "MM": "[0-9]{2}",
        "dd": "[0-9]{2}",
    }
    tokens = re.finditer(r"'([^']*)'|([A-Za-z])\2*|.", date_format)
    out = []
    for token in tokens:
        text = token.group(0)
        if token.group(2):
            out.append(shapes.get(text, "[0-9]{1,2}" if len(text) == 1 else ".+"))
        else:
            out.append(re.escape(token.group(1) if text.startswith("'") else text))
    return f"^{''.join(out)}$"


#: Two small numbers and a year, which may be read month first or day first.
_PAIR = r"^\s*([0-9]{1,2})([/-])([0-9]{1,2})\2((?:[0-9]{4}|[0-9]{2})(?![0-9]).*)$"


def day_first_vote(c: Column) -> Column:
    """1 for a date text that can only be read day first, -1 for one that can only be read month first, 0
    for one that can be read both ways, null for all others."""
    first, second = (F.regexp_extract(c, _PAIR, k).try_cast("int") for k in (1, 3))
    day, month = F.lit(1), F.lit(12)
    readable = first.between(day, F.lit(31)) & second.between(day, F.lit(31)) & (F.least(first, second) <= month)
    return F.when(readable, (first > month).cast("int") - (second > month).cast("int"))


def month_first(c: Column) -> Column:
    """A day-first date text that could be read both ways, with its first two numbers exchanged."""
    return F.when(day_first_vote(c) == 0, F.regexp_replace(c, _PAIR, "$3$2$1$2$4")).otherwise(c)


def to_day(c: Column, kind: T.DataType, formats: Sequence[str] = DATE_FORMATS) -> Column:
    """Date of a DATE, timestamp or text column; text is tried against each format in turn."""
    if isinstance(kind, T.DateType):
        return c
    if not isinstance(kind, T.StringType):
        return c.cast("date")
    whole = strip_ws(c)
    dated = F.when(F.contains(whole, F.lit(":")), F.regexp_replace(whole, _TIME, "")).otherwise(whole)
    day = F.lit(None)
    for date_format in reversed(formats):
        text = whole if "H" in date_format or "h" in date_format else dated
        # The cast reads texts of this shape as the format does, at a fraction of its cost.
        read = text.try_cast("date") if date_format == "yyyy-M-d" else F.try_to_timestamp(text, F.lit(date_format)).cast("date")
        if re.search(r"(?<!y)yy(?!y)", date_format):
            read = F.when(F.year(read) < _PIVOT, read).otherwise(F.add_months(read, -1200))
        day = F.coalesce(F.when(text.rlike(_shape(date_format)), read), day)
    return day.cast("date")
