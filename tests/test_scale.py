"""Plans that hold at scale, skewed inputs, and properties that tie the operators together."""

from __future__ import annotations

import random
import re

import pytest
from helpers import EXPENSES, SALES, ledger, rows
from pyspark.sql import functions as F

from checks import queries as checks
from tillbook import operators as ops
from tillbook import plans
from tillbook import sources as src
from tillbook.sources import warehouse as wh


@pytest.fixture(scope="module")
def stored(spark, data, tmp_path_factory):
    """The sales ledger of the test tables as a stored table; lookups never fit a broadcast."""
    path = str(tmp_path_factory.mktemp("stored") / "ledger")
    src.write_ledger(wh.sales_ledger(spark, data), path)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    yield ops.clean_ledger(src.scan_ledger(spark, path, SALES), SALES)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def final_plan(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


ONE_SCAN = {
    "kpis": lambda l: ops.kpis(l, SALES),
    "filter_options": lambda l: ops.filter_options(l, SALES),
    "party_share": lambda l: ops.party_share(l, SALES),
    "party_share_all": lambda l: ops.party_share(l, SALES, base="all"),
    "month_over_month": lambda l: ops.month_over_month(l, SALES),
    "category_totals": lambda l: ops.category_totals(l, SALES),
    "kpis_with_trend": lambda l: ops.kpis_with_trend(l, SALES, "1997-01-01", "1998-12-31"),
    "ledger_cube": lambda l: plans.ledger_cube(l, SALES),
    "weekday_heatmap": lambda l: ops.weekday_heatmap(l, SALES),
}


@pytest.mark.parametrize("name", ONE_SCAN)
def test_one_scan_of_the_ledger(stored, name):
    plan = final_plan(ONE_SCAN[name](stored))
    assert len(re.findall(r"FileScan parquet", plan)) == 1
    assert "Cartesian" not in plan and "BroadcastNestedLoop" not in plan and "Python" not in plan


@pytest.mark.parametrize("name", ["top_parties", "month_over_month", "list_page", "monthly_totals"])
def test_rankings_are_cut_before_the_shuffle(stored, name):
    plan = final_plan(getattr(ops, name)(stored, SALES))
    assert re.search(r"WindowGroupLimit .*Partial", plan)


def test_filters_and_columns_reach_the_scan(stored):
    plan = final_plan(ops.top_parties(ops.filter_ledger(stored, SALES, "1997-01-01", parties=["red ring"]), SALES))
    assert "ReadSchema: struct<user_id:string,date:date,product:string,sales:decimal(18,2)>" in plan
    assert "GreaterThanOrEqual(date,1997-01-01)" in plan.split("PushedFilters: [")[1]


def test_deep_pages_equal_shallow_ones(spark, stored):
    want = rows(ops.list_page(stored, SALES, page=4, size=25).orderBy("user_id", "position"))
    before = spark.conf.get("spark.sql.optimizer.windowGroupLimitThreshold")
    spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", 10)
    try:
        deep = ops.list_page(stored, SALES, page=4, size=25).orderBy("user_id", "position")
        assert rows(deep) == want and len(want) == 625
    finally:
        spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", before)


def test_null_tenants_and_ties_on_every_page(spark):
    book = ledger(spark, [(None if i % 3 == 0 else "t", "2024-01-05", "A", 1) for i in range(60)])
    pages = lambda: rows(ops.list_page(book, SALES, page=2, size=7).orderBy("user_id", "position"), "user_id", "position", "id")
    want = pages()
    before = spark.conf.get("spark.sql.optimizer.windowGroupLimitThreshold")
    spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", 5)
    try:
        assert pages() == want and len(want) == 14
    finally:
        spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", before)


def test_the_summary_sorts_nothing_as_a_whole(spark, data):
    cubes = [
        src.write_and_read(plans.ledger_cube(ops.clean_ledger(read(spark, data), s), s), ["grain"])
        for s, read in ((SALES, wh.sales_ledger), (EXPENSES, wh.expense_ledger))
    ]
    assert "rangepartitioning" not in final_plan(plans.business_summary(*cubes, SALES, EXPENSES))


@pytest.fixture(scope="module")
def skewed(spark):
    """One tenant and one party hold most rows."""
    pick = random.Random(7)
    made = [
        (
            "hot" if pick.random() < 0.7 else f"t{pick.randrange(5)}",
            None if pick.random() < 0.05 else f"2024-{pick.randrange(1, 8):02d}-{pick.randrange(1, 29):02d}",
            "hot" if pick.random() < 0.5 else f"P{pick.randrange(40)}",
            pick.randrange(-50, 500),
            pick.choice(["", "x", "y"]),
        )
        for _ in range(3000)
    ]
    return ledger(spark, made)


def test_all_tenants_at_once_equal_each_alone(skewed):
    tenants = sorted(u for (u,) in rows(skewed.select("user_id").distinct()))
    for operator in (ops.kpis, ops.top_parties, ops.month_over_month, ops.kpis_with_trend, ops.category_totals):
        together = sorted(rows(operator(skewed, SALES)), key=str)
        alone = [r for t in tenants for r in rows(operator(skewed.filter(F.col("user_id") == t), SALES))]
        assert together == sorted(alone, key=str), operator.__name__


def test_totals_agree(skewed):
    dated = skewed.filter("date is not null")
    total = {u: t for u, t in rows(ops.kpis(dated, SALES), "user_id", "total")}
    for operator in (ops.daily_totals, ops.weekday_heatmap, ops.party_totals):
        sums = operator(dated, SALES).groupBy("user_id").agg(F.sum("total").alias("s"))
        assert dict(rows(sums)) == total, operator.__name__


def test_against_pandas(skewed):
    """The reference figures, computed afresh with pandas for the hot tenant."""
    frame = skewed.withColumn("sales", F.col("sales").cast("double")).toPandas()
    hot = frame[frame.user_id == "hot"]
    best = hot.groupby("product").sales.sum().reset_index().sort_values(["sales", "product"], ascending=[False, True])
    out = rows(ops.top_parties(skewed, SALES).filter("user_id = 'hot'"), "product", "total")
    assert out == list(best.head(10).itertuples(index=False, name=None))
    import pandas as pd

    months = pd.to_datetime(hot.date).dt.to_period("M").astype(str)
    tail = hot.sales.groupby(months).sum().tail(6)
    assert rows(ops.monthly_totals(skewed, SALES).filter("user_id = 'hot'"), "month", "total") == list(tail.items())


def test_ingest_loses_nothing(spark, data):
    raw = wh.raw_sales(spark, data)
    accepted, quarantine = ops.ingest_upload(raw, SALES)
    assert accepted.count() + quarantine.count() == raw.count()


def test_grains_of_a_written_cube_are_pruned(stored):
    cube = src.write_and_read(plans.ledger_cube(stored, SALES), ["grain"])
    plan = final_plan(ops.daily_totals(plans.cube_grain(cube, "day"), SALES))
    assert "grain" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_change_set_is_built_in_one_pass(spark, data):
    """The lines are joined once for all kinds of changes."""
    plan = checks._partial_changes(spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 3


def test_store_computes_a_change_set_once(spark, tmp_path):
    """Every step of the change works on the written change set."""
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = ledger(spark, [("a", "2024-01-01", "x", 1), ("a", "2024-02-01", "y", 2)])
    src.write_ledger(rows, str(tmp_path / "ledger"))
    changes = rows.withColumns({"op": F.lit("update"), "seq": F.lit(1).cast("bigint")})
    src.store_changes(spark, str(tmp_path / "ledger"), changes.mapInArrow(counted, changes.schema), SALES)
    assert seen.value == 2
