"""Display texts and the trend rule."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts and symbols shown to the user.
CURRENCY = "₵"
NO_PRIOR = "— No prior period"
NO_CHANGE = "→ No change vs prev period"
UP, DOWN, SUFFIX = "▲ ", "▼ ", "% vs prev period"
GOAL_HINT = {
    "target": "Set a target above to track your progress",
    "budget": "Set a budget above to track your spending",
}


def format_currency(c: Column) -> Column:
    """Currency text without decimals, half to even; the sign follows the symbol."""
    return F.concat(F.lit(CURRENCY), F.format_number(c.cast("double"), 0))


def one_decimal(c: Column) -> Column:
    """One decimal, no thousands separators."""
    return F.call_function("format_number", c.cast("double"), F.lit("0.0"))


def progress_text(actual: Column, goal: Column, pct: Column, kind: str) -> Column:
    text = F.concat(
        format_currency(actual), F.lit(" of "), format_currency(goal),
        F.lit(" ("), one_decimal(pct), F.lit("%)"),
    )
    return F.when(goal > 0, text).otherwise(F.lit(GOAL_HINT[kind]))


def trend(current: Column, previous: Column) -> Column:
    """Percent change; null when there is no prior value or it is zero."""
    now, before = current.cast("double"), previous.cast("double")
    return F.try_divide(now - before, before) * 100


def trend_direction(pct: Column) -> Column:
    return (
        F.when(pct.isNull(), "none").when(pct > 0, "up").when(pct < 0, "down").otherwise("flat")
    )


def trend_label(pct: Column) -> Column:
    size = F.concat(one_decimal(F.abs(pct)), F.lit(SUFFIX))
    return (
        F.when(pct.isNull(), NO_PRIOR)
        .when(pct > 0, F.concat(F.lit(UP), size))
        .when(pct < 0, F.concat(F.lit(DOWN), size))
        .otherwise(NO_CHANGE)
    )
