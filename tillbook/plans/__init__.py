"""Jobs made of several operators: the cube, the dashboard, the summary and the insight texts."""

from tillbook.plans.cube import cube_grain, ledger_cube, refresh_cube
from tillbook.plans.dashboard import dashboard
from tillbook.plans.insights import insight_prompts, parse_replies
from tillbook.plans.summary import business_summary, flatten_summary, summary_json
from tillbook.plans.windows import kpis_from_bitmaps, kpis_windows, party_bitmaps, party_numbers, running_totals

__all__ = [
    "business_summary",
    "cube_grain",
    "dashboard",
    "flatten_summary",
    "insight_prompts",
    "kpis_from_bitmaps",
    "kpis_windows",
    "ledger_cube",
    "parse_replies",
    "party_bitmaps",
    "party_numbers",
    "refresh_cube",
    "running_totals",
    "summary_json",
]
