"""Ledger operators: DataFrame in, DataFrame out, no actions inside."""

from tillbook.operators.changes import (
    append_rows,
    apply_changes,
    apply_deletes,
    apply_updates,
    clear_tenant,
)
from tillbook.operators.clean import clean_ledger, conform, ledger_listing, normalize_columns
from tillbook.operators.filters import filter_ledger, list_page, prior_rows
from tillbook.operators.ingest import (
    flag_upload,
    ingest_upload,
    parse_csv_lines,
    validate_edits,
    validate_entries,
)
from tillbook.operators.metrics import (
    category_totals,
    daily_totals,
    filter_options,
    kpis,
    ledger_totals,
    monthly_totals,
    party_share,
    party_totals,
    profit,
    top_parties,
    weekday_heatmap,
)
from tillbook.operators.periods import (
    goal_progress,
    kpis_with_trend,
    month_over_month,
    period_bounds,
    prior_kpis,
)
from tillbook.operators.ranking import join_by_key, keep_by_key, rank_slice

__all__ = [
    "append_rows",
    "apply_changes",
    "apply_deletes",
    "apply_updates",
    "category_totals",
    "clean_ledger",
    "clear_tenant",
    "conform",
    "daily_totals",
    "filter_ledger",
    "filter_options",
    "flag_upload",
    "goal_progress",
    "ingest_upload",
    "join_by_key",
    "keep_by_key",
    "kpis",
    "kpis_with_trend",
    "ledger_listing",
    "ledger_totals",
    "list_page",
    "month_over_month",
    "monthly_totals",
    "normalize_columns",
    "parse_csv_lines",
    "party_share",
    "party_totals",
    "period_bounds",
    "prior_kpis",
    "prior_rows",
    "profit",
    "rank_slice",
    "top_parties",
    "validate_edits",
    "validate_entries",
    "weekday_heatmap",
]
