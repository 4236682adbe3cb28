"""Column functions: text, numbers, dates and labels."""

from tillbook.functions.labels import format_currency, one_decimal, progress_text, trend, trend_label
from tillbook.functions.parse import (
    CSV_NA_TOKENS,
    DATE_FORMATS,
    clean_header,
    day_first_vote,
    has_text,
    month_first,
    null_if_na,
    strip_ws,
    to_amount,
    to_day,
)

__all__ = [
    "CSV_NA_TOKENS",
    "DATE_FORMATS",
    "clean_header",
    "day_first_vote",
    "format_currency",
    "has_text",
    "month_first",
    "null_if_na",
    "one_decimal",
    "progress_text",
    "strip_ws",
    "to_amount",
    "to_day",
    "trend",
    "trend_label",
]
