"""Comparison with the preceding period, month over month, and progress against goals."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillbook.functions.labels import progress_text, trend, trend_direction, trend_label
from tillbook.operators.filters import Day, as_day, selection
from tillbook.operators.metrics import mean, record_count
from tillbook.operators.ranking import join_by_key, rank_slice
from tillbook.spec import BY, LedgerSpec


def _window(first: Column, last: Column) -> dict[str, Column]:
    """Current span in days (at least one) and the inclusive window of that length before it."""
    span = F.greatest(F.datediff(last, first), F.lit(1))
    return {
        "span_days": span,
        "prior_start": F.date_sub(first, span + 1),
        "prior_end": F.date_sub(first, 1),
    }


def period_bounds(ledger: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """First and last day of the (filtered) ledger and its prior window; undated keys give none."""
    days = (
        ledger.groupBy(*by)
        .agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"))
        .filter(F.col("first_date").isNotNull())
    )
    return days.withColumns(_window(F.col("first_date"), F.col("last_date")))


def _rollup(ledger: DataFrame, spec: LedgerSpec, keys: Sequence[str]) -> DataFrame:
    """Sums per key, combined map-side, so that per-tenant joins see days and parties, not rows."""
    return ledger.groupBy(*keys).agg(
        F.sum(spec.amount).alias("_amount"), record_count(ledger).alias("_records")
    )


def prior_kpis(
    ledger: DataFrame,
    bounds: DataFrame,
    spec: LedgerSpec,
    by: Sequence[str] = BY,
    start: Day = None,
    end: Day = None,
) -> DataFrame:
    """KPIs of each key's prior window; keys without prior rows give none.

    ``start`` and ``end`` of the selection that the bounds come from limit the scan to the days that
    its prior windows can reach.
    """
    dated = ledger.filter(reach(start, end))
    rollup = _rollup(dated, spec, [*by, "date", spec.party])
    window = bounds.select(*by, "prior_start", "prior_end")
    inside = join_by_key(rollup, window, by, ["date", spec.party]).filter(
        F.col("date").between(F.col("prior_start"), F.col("prior_end"))
    )
    sums = (
        inside.groupBy(*by)
        .agg(
            F.sum("_amount").alias("total"),
            F.count_distinct(F.col(spec.party)).alias("parties"),
            F.sum("_records").alias("records"),
        )
        .filter(F.col("records") > 0)
    )
    average = mean(F.col("total"), F.col("records"))
    return sums.select(*by, "total", average.alias("average"), "parties", "records")


def reach(start: Day, end: Day) -> Column:
    """Days that can matter for a date selection: its own and any prior window cut from it. Without
    ``end``, all days.

    A window ends before ``end``; it starts no earlier than the whole selected span and one day
    before ``start`` (two days before, for a one-day span).
    """
    first, last = as_day(start), as_day(end)
    if not last:
        return F.col("date").isNotNull()
    days = F.col("date") <= F.lit(last)
    if first:
        span = max((last - first).days, 1)
        days = days & (F.col("date") >= F.lit(first - dt.timedelta(days=span + 1)))
    return days


def kpis_with_trend(
    ledger: DataFrame,
    spec: LedgerSpec,
    start: Day = None,
    end: Day = None,
    parties: Iterable[str] | None = None,
    categories: Iterable[str] | None = None,
    by: Sequence[str] = BY,
    prior_scope: str = "all",
) -> DataFrame:
    """The four KPIs of the selection, each with its prior value, change and label (long form).

    The prior window is cut from the whole ledger, or from the party and category selection when
    ``prior_scope="filtered"``. Keys without selected rows give none.

    One scan: the ledger is rolled up to day and party with a flag for selected lines, and both the
    current figures and the prior window come from that one shuffle.
    """
    chosen = selection(spec, start, end, parties, categories)
    rows = ledger.filter(reach(start, end)) if end else ledger
    if prior_scope == "filtered":
        rows = rows.filter(selection(spec, None, None, parties, categories))
    flagged = rows.withColumn("_chosen", F.coalesce(chosen, F.lit(False)))
    rollup = _rollup(flagged, spec, [*by, "date", spec.party, "_chosen"])

    # Conditional sums, not filters: a filter would be pushed below and split the shared shuffle.
    picked = lambda name: F.when(F.col("_chosen"), F.col(name))
    current = (
        rollup.groupBy(*by)
        .agg(
            F.sum(picked("_amount")).alias("total"),
            F.sum(picked("_records")).alias("records"),
            F.count_distinct(picked(spec.party)).alias("parties"),
            F.min(picked("date")).alias("_first"),
            F.max(picked("date")).alias("_last"),
        )
        .filter(F.col("records") > 0)
        .withColumns(_window(F.col("_first"), F.col("_last")))
        .select(*by, "total", "records", "parties", "prior_start", "prior_end")
    )
    before = F.coalesce(F.col("date").between(F.col("prior_start"), F.col("prior_end")), F.lit(False))
    earlier = lambda name: F.when(before, F.col(name))
    both = (
        join_by_key(
            rollup.select(*by, "date", spec.party, "_amount", "_records"),
            current, by, ["date", spec.party],
        )
        .groupBy(*by, "total", "records", "parties")
        .agg(
            F.sum(earlier("_amount")).alias("_total"),
            F.sum(earlier("_records")).alias("_records"),
            F.count_distinct(earlier(spec.party)).alias("_parties"),
        )
    )
    any_prior = F.col("_records") > 0
    now_mean = mean(F.col("total"), F.col("records"))
    old_mean = mean(F.col("_total"), F.col("_records"))
    metrics = {
        "total": (F.col("total"), F.col("_total")),
        "average": (now_mean, old_mean),
        "parties": (F.col("parties"), F.col("_parties")),
        "records": (F.col("records"), F.col("_records")),
    }
    lines = F.array(
        *[
            F.struct(
                F.lit(name).alias("metric"),
                now.cast("double").alias("value"),
                F.when(any_prior, old.cast("double")).alias("previous"),
            )
            for name, (now, old) in metrics.items()
        ]
    )
    change = trend(F.col("value"), F.col("previous"))
    return (
        both.select(*by, F.inline(lines))
        .withColumn("pct", change)
        .withColumns({"direction": trend_direction(F.col("pct")), "label": trend_label(F.col("pct"))})
    )


def month_over_month(
    ledger: DataFrame, spec: LedgerSpec, by: Sequence[str] = BY, n: int = 8
) -> DataFrame:
    """Each party's total in the key's latest month and the calendar month before it; the ``n``
    largest by both together, ordered by the latest month.
    """
    month = F.trunc("date", "MM").alias("month")
    months = (
        ledger.filter(F.col("date").isNotNull() & F.col(spec.party).isNotNull())
        .groupBy(*by, spec.party, month)
        .agg(F.sum(spec.amount).alias("total"))
    )
    # Counting totals as well keeps both uses on one shuffle of the ledger.
    latest = (
        months.groupBy(*by)
        .agg(F.max("month").alias("this"), F.count("total").alias("_n"))
        .filter(F.col("_n") > 0)
        .select(*by, "this", F.add_months("this", -1).alias("last"))
    )
    in_month = lambda name: F.coalesce(
        F.sum(F.when(F.col("month") == F.col(name), F.col("total"))), F.lit(0)
    )
    pairs = (
        join_by_key(months, latest, by, [spec.party, "month"])
        .filter(F.col("month").isin(F.col("this"), F.col("last")))
        .groupBy(*by, spec.party)
        .agg(in_month("this").alias("this_month"), in_month("last").alias("last_month"))
        .withColumn("combined", F.col("this_month") + F.col("last_month"))
    )
    kept = rank_slice(pairs, by, [F.col("combined").desc(), F.col(spec.party).asc()], n)
    return kept.select(*by, "rank", spec.party, "this_month", "last_month", "combined").orderBy(
        *by, F.col("this_month").desc(), F.col(spec.party).asc()
    )


# Status of a goal from its percentage, first matching floor wins.
GOAL_STATUS = {
    "target": {"floors": ((100, "success"), (60, "warning")), "below": "danger", "unset": "primary"},
    "budget": {"floors": ((90, "danger"), (60, "warning")), "below": "success", "unset": "danger"},
}


def goal_progress(
    ledger: DataFrame,
    spec: LedgerSpec,
    goals: DataFrame,
    kind: str | None = None,
    by: Sequence[str] = BY,
) -> DataFrame:
    """Total against each key's goal: percent capped at 100, status and text.

    ``goals`` has one row per key with ``goal``; null, zero and negative mean not set. A key found
    only in ``goals`` counts as a total of zero. ``by=[]`` compares all rows with the sum of all goals.
    """
    kind = kind or spec.goal_kind
    rule = GOAL_STATUS[kind]
    totals = ledger.groupBy(*by).agg(F.sum(spec.amount).cast("double").alias("actual"))
    pct = F.when(
        F.col("goal") > 0, F.least(F.col("actual") / F.nullif("goal", F.lit(0.0)) * 100, F.lit(100.0))
    ).otherwise(F.lit(0.0))
    status = F.when(F.col("goal") <= 0, rule["unset"])
    for floor, name in rule["floors"]:
        status = status.when(F.col("pct") >= floor, name)
    none = F.lit(None).cast("double")
    wanted = goals.select(*by, none.alias("actual"), F.col("goal").cast("double"))
    return (
        totals.withColumn("goal", none)
        .unionByName(wanted)
        .groupBy(*by)
        .agg(
            F.coalesce(F.sum("actual"), F.lit(0.0)).alias("actual"),
            F.coalesce(F.sum("goal"), F.lit(0.0)).alias("goal"),
        )
        .withColumn("pct", pct)
        .withColumns(
            {
                "status": status.otherwise(rule["below"]),
                "text": progress_text(F.col("actual"), F.col("goal"), F.col("pct"), kind),
            }
        )
    )
