"""Metrics, periods, goals, the cube, the summary and replies on small ledgers."""

from __future__ import annotations

import json

import pytest
from helpers import EXPENSES, SALES, day, ledger, rows
from pyspark.sql import functions as F

from tillbook import operators as ops
from tillbook import plans

BOOK = [
    ("t", "2024-01-30", "A", 10, "x"), ("t", "2024-02-01", "B", 20, ""), ("t", "2024-02-01", "A", 5, "y"),
    ("t", None, "C", 7.5, "x"), ("u", "2024-02-03", "A", 1, ""),
]


def test_kpis(spark):
    out = ops.kpis(ledger(spark, BOOK), SALES).orderBy("user_id")
    assert rows(out) == [("t", 42.5, 10.625, 3, 4), ("u", 1.0, 1.0, 1, 1)]
    assert rows(ops.kpis(ledger(spark, BOOK), SALES, by=[])) == [(43.5, 8.7, 3, 5)]


def test_empty_ledger_gives_no_rows(spark):
    none = ledger(spark, BOOK).filter("user_id = 'nobody'")
    for by in (["user_id"], []):
        for operator in (
            ops.kpis, ops.daily_totals, ops.top_parties, ops.party_share, ops.month_over_month,
            ops.weekday_heatmap, ops.monthly_totals, ops.category_totals, ops.ledger_totals,
            ops.kpis_with_trend, ops.filter_options,
        ):
            assert operator(none, SALES, by=by).count() == 0, (operator.__name__, by)
        assert ops.period_bounds(none, by).count() == 0
        assert ops.profit(none, none, SALES, SALES, by).count() == 0


def test_filter_options(spark):
    out = rows(ops.filter_options(ledger(spark, BOOK), SALES), "user_id", "option", "value")
    assert out == [
        ("t", "category", "x"), ("t", "category", "y"), ("t", "end_date", "2024-02-01"),
        ("t", "party", "A"), ("t", "party", "B"), ("t", "party", "C"), ("t", "start_date", "2024-01-30"),
        ("u", "end_date", "2024-02-03"), ("u", "party", "A"), ("u", "start_date", "2024-02-03"),
    ]


def test_top_parties_break_ties_by_name(spark):
    book = ledger(spark, [("t", None, p, 5) for p in "CBA"])
    assert rows(ops.top_parties(book, SALES, n=2), "rank", "product") == [(1, "A"), (2, "B")]


def test_share_base(spark):
    book = ledger(spark, [("t", None, f"P{i:02d}", i) for i in range(1, 13)])
    top = rows(ops.party_share(book, SALES), "product", "base_total", "percent")
    assert [r[0] for r in top] == [f"P{i:02d}" for i in range(12, 2, -1)]
    assert {r[1] for r in top} == {75.0}
    assert sum(r[2] for r in top) == pytest.approx(100)
    assert {r[0] for r in rows(ops.party_share(book, SALES, base="all"), "base_total")} == {78.0}


def test_month_over_month(spark):
    book = ledger(
        spark,
        [
            ("t", "2024-01-31", "old", 9), ("t", "2024-02-01", "feb", 3), ("t", "2024-02-29", "both", 4),
            ("t", "2024-03-15", "both", 1), ("t", "2024-03-01", "mar", 2), ("u", "2024-01-05", "A", 1),
            ("u", "2023-12-31", "A", 2), ("t", None, "mar", 50),
        ],
    )
    out = rows(ops.month_over_month(book, SALES), "user_id", "product", "this_month", "last_month")
    assert out == [
        ("t", "mar", 2.0, 0.0), ("t", "both", 1.0, 4.0), ("t", "feb", 0.0, 3.0), ("u", "A", 1.0, 2.0),
    ]


def test_heatmap(spark):
    book = ledger(spark, [("t", "2021-01-03", "A", 1), ("t", "2020-12-28", "A", 2), ("t", "2023-01-02", "A", 3), ("t", "2024-01-01", "A", 4)])
    out = rows(ops.weekday_heatmap(book, SALES), "week", "dow", "total")
    assert len(out) == 14
    assert {r[:2]: r[2] for r in out if r[2]} == {(53, 6): 1.0, (53, 0): 2.0, (1, 0): 7.0}
    years = rows(ops.weekday_heatmap(book, SALES, by_iso_year=True), "iso_year", "week", "dow", "total")
    assert [r for r in years if r[3]] == [(2020, 53, 0, 2.0), (2020, 53, 6, 1.0), (2023, 1, 0, 3.0), (2024, 1, 0, 4.0)]
    wide = ops.weekday_heatmap(book, SALES, wide=True)
    assert wide.columns == ["user_id", "week", *[f"d{i}" for i in range(7)]]


def test_months_keep_six_and_count_undated_as_one(spark):
    book = ledger(spark, [("t", f"2024-{m:02d}-05", "A", m) for m in range(1, 9)] + [("t", None, "A", 99)])
    assert [m for (m,) in rows(ops.monthly_totals(book, SALES), "month")] == [*[f"2024-{m:02d}" for m in range(4, 9)], "NaT"]
    dated = ops.monthly_totals(book, SALES, drop_null_month=True)
    assert [m for (m,) in rows(dated, "month")] == [f"2024-{m:02d}" for m in range(3, 9)]


def test_categories(spark):
    out = rows(ops.category_totals(ledger(spark, BOOK), SALES))
    assert out == [("t", "", 20.0), ("t", "x", 17.5), ("t", "y", 5.0)]


def test_ledger_totals(spark):
    out = ops.ledger_totals(ledger(spark, BOOK), SALES).filter("user_id = 't'")
    assert rows(out) == [("t", 42.5, 10.625, 4, day("2024-01-30"), day("2024-02-01"), "2024-01-30 to 2024-02-01")]


def test_period_bounds(spark):
    book = ledger(
        spark,
        [("one", "2024-02-10", "A", 1), ("ten", "2024-02-01", "A", 1), ("ten", "2024-02-10", "A", 1), ("none", None, "A", 1)],
    )
    out = ops.period_bounds(book).orderBy("user_id")
    assert rows(out, "user_id", "span_days", "prior_start", "prior_end") == [
        ("one", 1, day("2024-02-08"), day("2024-02-09")), ("ten", 9, day("2024-01-22"), day("2024-01-31")),
    ]


TRENDED = [
    ("t", "2024-02-10", "A", 30, "x"), ("t", "2024-02-09", "A", 5), ("t", "2024-02-08", "B", 7),
    ("t", "2024-02-07", "C", 100), ("t", None, "A", 1000), ("u", "2024-02-10", "A", 1),
]


def test_trend_of_a_party_looks_at_all_parties_before(spark):
    pick = dict(start="2024-02-10", end="2024-02-10", parties=["A"])
    columns = ("user_id", "metric", "value", "previous", "pct", "direction")
    out = ops.kpis_with_trend(ledger(spark, TRENDED), SALES, **pick).orderBy("user_id", "metric")
    assert rows(out, *columns) == [
        ("t", "average", 30.0, 6.0, 400.0, "up"), ("t", "parties", 1.0, 2.0, -50.0, "down"),
        ("t", "records", 1.0, 2.0, -50.0, "down"), ("t", "total", 30.0, 12.0, 150.0, "up"),
        ("u", "average", 1.0, None, None, "none"), ("u", "parties", 1.0, None, None, "none"),
        ("u", "records", 1.0, None, None, "none"), ("u", "total", 1.0, None, None, "none"),
    ]
    same = ops.kpis_with_trend(ledger(spark, TRENDED), SALES, **pick, prior_scope="filtered")
    assert rows(same.filter("user_id = 't' and metric = 'total'"), *columns) == [("t", "total", 30.0, 5.0, 500.0, "up")]


@pytest.mark.parametrize(
    "pick", [{}, {"start": "2024-02-08"}, {"end": "2024-02-09"}, {"start": "2024-02-08", "end": "2024-02-10"}, {"categories": ["x"]}]
)
def test_trend_equals_its_parts(spark, pick):
    book = ledger(spark, TRENDED)
    chosen = ops.filter_ledger(book, SALES, **pick)
    before = ops.prior_kpis(book, ops.period_bounds(chosen), SALES)
    raw = ops.kpis(ops.prior_rows(book, ops.period_bounds(chosen), SALES), SALES)
    assert sorted(rows(before)) == sorted(rows(raw))
    now = {(u, m): v for u, *vs in rows(ops.kpis(chosen, SALES)) for m, v in zip(("total", "average", "parties", "records"), vs)}
    old = {(u, m): v for u, *vs in rows(before) for m, v in zip(("total", "average", "parties", "records"), vs)}
    out = rows(ops.kpis_with_trend(book, SALES, **pick), "user_id", "metric", "value", "previous")
    assert {(u, m): v for u, m, v, _ in out} == now
    assert {(u, m): p for u, m, _, p in out if p is not None} == old


def goal_case(spark, totals, kind):
    spec = SALES if kind == "target" else EXPENSES
    book = ledger(spark, [(str(i), None, "A", v) for i, v in enumerate(totals) if v is not None], spec)
    goals = spark.createDataFrame([(str(i), 0.0 if i == 0 else 100.0) for i in range(len(totals))], "user_id string, goal double")
    return rows(ops.goal_progress(book, spec, goals).orderBy("user_id"), "pct", "status", "text")


def test_targets(spark):
    out = goal_case(spark, [5, 59.9, 60, 100, 140, None], "target")
    assert [r[:2] for r in out] == [
        (0.0, "primary"), (59.9, "danger"), (60.0, "warning"), (100.0, "success"), (100.0, "success"), (0.0, "danger"),
    ]
    assert out[0][2] == "Set a target above to track your progress"
    assert out[1][2] == "₵60 of ₵100 (59.9%)"


def test_budgets(spark):
    out = goal_case(spark, [5, 59.9, 60, 90], "budget")
    assert [r[:2] for r in out] == [(0.0, "danger"), (59.9, "success"), (60.0, "warning"), (90.0, "danger")]


def test_profit_rounds_first_and_needs_both(spark):
    sales = ledger(spark, [("t", None, "A", 100.0), ("zero", None, "A", 0), ("only", None, "A", 1)])
    sales = sales.withColumn("sales", F.when(F.col("user_id") == "t", 100.005).otherwise(F.col("sales").cast("double")))
    costs = ledger(spark, [("t", None, "V", 0), ("zero", None, "V", 5)], EXPENSES)
    costs = costs.withColumn("amount", F.when(F.col("user_id") == "t", 50.004).otherwise(F.col("amount").cast("double")))
    out = ops.profit(sales, costs, SALES, EXPENSES).orderBy("user_id")
    assert rows(out, "user_id", "gross_profit", "profit_margin") == [("t", 50.0, 50.0), ("zero", -5.0, 0.0)]


def test_cube_serves_every_table(spark):
    book = ledger(spark, BOOK)
    tables = plans.dashboard(plans.ledger_cube(book, SALES), SALES)
    for name in (
        "kpis", "daily_totals", "top_parties", "party_share", "month_over_month", "weekday_heatmap",
        "monthly_totals", "category_totals", "ledger_totals",
    ):
        assert sorted(rows(tables[name])) == sorted(rows(getattr(ops, name)(book, SALES))), name
    assert rows(tables["period_bounds"]) == rows(ops.period_bounds(book))


def summary(spark, sales, expenses):
    return plans.business_summary(
        plans.ledger_cube(ledger(spark, sales), SALES),
        plans.ledger_cube(ledger(spark, expenses, EXPENSES), EXPENSES), SALES, EXPENSES,
    )


def test_summary_document(spark):
    made = summary(spark, BOOK, [("t", "2024-02-02", "V", 12.5), ("w", None, "V", 3)])
    texts = dict(rows(plans.summary_json(made)))
    assert set(texts) == {"t", "u", "w"}
    assert json.loads(texts["t"]) == {
        "sales": {
            "total": 42.5, "average": 10.62, "records": 4, "date_range": "2024-01-30 to 2024-02-01",
            "monthly": {"2024-01": 10.0, "2024-02": 25.0, "NaT": 7.5},
            "top_products": {"B": 20.0, "A": 15.0, "C": 7.5}, "by_category": {"": 20.0, "x": 17.5, "y": 5.0},
        },
        "expenses": {
            "total": 12.5, "average": 12.5, "records": 1, "date_range": "2024-02-02 to 2024-02-02",
            "monthly": {"2024-02": 12.5}, "top_vendors": {"V": 12.5}, "by_category": {},
        },
        "profit": {"gross_profit": 30.0, "profit_margin": 70.6},
    }
    assert list(json.loads(texts["t"])["sales"]["top_products"]) == ["B", "A", "C"]
    assert set(json.loads(texts["u"])) == {"sales"}
    assert set(json.loads(texts["w"])) == {"expenses"}
    prompt = dict(rows(plans.insight_prompts(made)))["t"]
    assert texts["t"] in prompt and prompt.startswith("You are a business analyst.")


REPLY = '{"summary":"s","strengths":"a","risks":"b","recommendations":"c","forecast":"d"}'
REPLIES = {
    REPLY: ("ok", "s", "d"),
    f"  ```json\n{REPLY}\n``` ": ("ok", "s", "d"),
    f"```{REPLY}```": ("ok", "s", "d"),
    f"```json\n{REPLY}": ("ok", "s", "d"),
    '{"summary":"s"}': ("ok", "s", ""),
    '{"summary":["x","y"],"forecast":1}': ("ok", '["x","y"]', "1"),
    "{}": ("ok", "", ""),
    '{"summary":"s"': ("bad_json", None, None),
    REPLY + " done": ("bad_json", None, None),
    REPLY + REPLY: ("bad_json", None, None),
    "{'summary':'s'}": ("bad_json", None, None),
    "Sorry": ("bad_json", None, None),
    "": ("bad_json", None, None),
    "[1]": ("error", None, None),
    "12": ("error", None, None),
}


def test_replies(spark):
    bodies = [json.dumps({"choices": [{"message": {"content": c}}]}) for c in REPLIES] + ['{"error":"x"}', "oops"]
    df = spark.createDataFrame([(f"{i:02d}", b) for i, b in enumerate(bodies)], "user_id string, body string")
    out = rows(plans.parse_replies(df).orderBy("user_id"), "status", "summary", "forecast")
    assert out == [*REPLIES.values(), ("error", None, None), ("error", None, None)]
