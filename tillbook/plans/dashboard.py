"""Every chart-ready table of a dashboard, derived from one cube."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillbook.operators import metrics, periods
from tillbook.plans.cube import CATEGORY, DAY, PARTY, cube_grain
from tillbook.spec import BY, LedgerSpec


def dashboard(cube: DataFrame, spec: LedgerSpec, by: Sequence[str] = BY) -> dict[str, DataFrame]:
    """Tables by name. ``cube`` is the cube of the filtered ledger, best read from a written table.

    Trends and goals are not here: they look at the unfiltered ledger and at a goals table.
    """
    days, parties, categories = (cube_grain(cube, g) for g in (DAY, PARTY, CATEGORY))
    return {
        "kpis": metrics.kpis(parties, spec, by),
        "daily_totals": metrics.daily_totals(days, spec, by),
        "top_parties": metrics.top_parties(parties, spec, by),
        "party_share": metrics.party_share(parties, spec, by),
        "month_over_month": periods.month_over_month(parties, spec, by),
        "weekday_heatmap": metrics.weekday_heatmap(days, spec, by),
        "monthly_totals": metrics.monthly_totals(days, spec, by),
        "category_totals": metrics.category_totals(categories, spec, by),
        "ledger_totals": metrics.ledger_totals(days, spec, by),
        "period_bounds": periods.period_bounds(days, by),
        "parties": parties.select(*by, spec.party).distinct(),
        "categories": categories.filter(F.col("category") != "").select(*by, "category"),
    }
