"""Running totals, bitmaps of parties, refreshed cubes and date orders of files against plain versions."""

from __future__ import annotations

import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tillbook import EXPENSES, SALES, ledger_schema, operators as ops, plans, sources as src
from tillbook.operators import ingest

DAY = dt.date(2023, 11, 1)


def random_ledger(spark, n=600, spec=SALES, seed=1):
    pick = random.Random(seed)
    rows = []
    for i in range(n):
        tenant = "hot" if pick.random() < 0.5 else f"t{pick.randrange(4)}"
        gap = pick.choice([0, 0, 0, 400])
        day = None if pick.random() < 0.1 else DAY + dt.timedelta(days=pick.randrange(90) + gap)
        rows.append((tenant, f"{i:04d}", day, pick.choice([*"abcdefgh", None]), Decimal(pick.randrange(-50, 900)), pick.choice(["", "x"])))
    return rows, spark.createDataFrame(rows, ledger_schema(spec))


@pytest.mark.parametrize("spec", [SALES, EXPENSES])
def test_any_window_of_days(spark, spec):
    rows, ledger = random_ledger(spark, spec=spec)
    pick = random.Random(2)
    asked = []
    for k in range(1000):
        start = DAY + dt.timedelta(days=pick.randrange(-60, 600))
        end = start + dt.timedelta(days=pick.choice([-1, 0, 1, 27, 31, 200, 500]))
        asked.append((k, pick.choice(["hot", "t1", "t2", "nobody"]), pick.choice([start, start, None]), pick.choice([end, end, None])))
    windows = spark.createDataFrame(asked, "window int, user_id string, start date, end date")
    running = src.write_and_read(plans.running_totals(ledger, spec))
    out = {r["window"]: r for r in plans.kpis_windows(running, windows).collect()}
    assert len(out) == 1000
    for k, tenant, start, end in asked:
        inside = [r[4] for r in rows if r[0] == tenant and r[2] and (not start or r[2] >= start) and (not end or r[2] <= end)]
        assert (out[k]["total"], out[k]["records"]) == (sum(inside), len(inside)), asked[k]
        assert out[k]["average"] == (pytest.approx(float(sum(inside)) / len(inside)) if inside else None)
    assert plans.kpis_windows(running, windows.limit(0)).count() == 0
    nothing = plans.running_totals(ledger.limit(0), spec)
    assert {r["records"] for r in plans.kpis_windows(nothing, windows).collect()} == {0}


def test_windows_do_not_read_the_ledger(spark):
    _, ledger = random_ledger(spark)
    running = src.write_and_read(plans.running_totals(ledger, SALES))
    windows = spark.createDataFrame([("hot", DAY, None)], "user_id string, start date, end date")
    text = plans.kpis_windows(running, windows)._jdf.queryExecution().optimizedPlan().toString()
    assert "product" not in text and "CartesianProduct" not in text and "BroadcastNestedLoop" not in text


def test_distinct_parties_of_spans(spark, monkeypatch):
    pick = random.Random(3)
    rows, ledger = random_ledger(spark)
    many = [("big", f"m{i}", DAY + dt.timedelta(days=pick.randrange(90)), f"p{pick.randrange(60_000):05d}", Decimal(1), "") for i in range(60_000)]
    ledger = ledger.unionByName(spark.createDataFrame(many, ledger_schema(SALES)))
    rows = rows + many
    numbers = plans.party_numbers(ledger, SALES)
    assert numbers.agg(F.min("number"), F.max("number"), F.count_distinct("number")).first()[:] == (1, numbers.count(), numbers.count())
    bitmaps = src.write_and_read(plans.party_bitmaps(ledger, numbers, SALES))
    spans = [("hot", 0, 2), ("t1", 1, 1), ("big", 0, 0), ("big", 0, 5), ("hot", 0, 30), ("none", 0, 3), ("t2", 40, 41), ("hot", 0, 2)]
    day = lambda months: dt.date(2023 + (10 + months) // 12, (10 + months) % 12 + 1, 17)
    asked = spark.createDataFrame([(k, t, day(a), day(b)) for k, (t, a, b) in enumerate(spans)], "k int, user_id string, first date, last date")
    out = {r["k"]: r for r in plans.kpis_from_bitmaps(bitmaps, asked).collect()}
    for k, (tenant, a, b) in enumerate(spans):
        months = {(day(m).year, day(m).month) for m in range(a, b + 1)}
        inside = [r for r in rows if r[0] == tenant and r[2] and (r[2].year, r[2].month) in months]
        assert (k in out) == bool(inside)
        if inside:
            want = (sum(r[4] for r in inside), len({r[3] for r in inside} - {None}), len(inside))
            assert (out[k]["total"], out[k]["parties"], out[k]["records"]) == want
    assert out[3]["parties"] > 32768  # more than one bucket


def cube_rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_cube_after_changes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(src.snapshots, "FILE_ROWS", 40)
    rows, ledger = random_ledger(spark)
    store = src.Store(str(tmp_path / "s"), SALES)
    src.append_batch(spark, store, ledger, "a")
    cube = src.write_and_read(plans.ledger_cube(src.read_store(spark, store), SALES))
    made = lambda found: spark.createDataFrame(
        found, "user_id string, id string, op string, seq bigint, date date, product string, sales decimal(18,2), category string"
    )
    ids = [r[1] for r in rows if r[0] == "t3"]
    steps = [
        made([("t3", i, "delete", 1, None, None, None, None) for i in ids]),
        made([("t1", "n1", "insert", 1, DAY, "new", Decimal(4), "c"), ("t1", "n2", "insert", 1, None, None, Decimal(-4), None)]),
        made([(r[0], r[1], "update", 1, DAY, "moved", None, None) for r in rows if r[0] == "t2"][:9]),
    ]
    for step in steps:
        old = src.versions(spark, store)[-1]
        new = src.change_store(spark, store, step).number
        removed, added = src.version_changes(spark, store, old, new)
        every = src.read_store(spark, store)
        assert len(removed.inputFiles()) < len(every.inputFiles()) - 2
        cube = src.write_and_read(plans.refresh_cube(cube, removed, added, SALES))
        fresh = plans.ledger_cube(every, SALES)
        assert cube.dtypes == fresh.dtypes and cube_rows(cube) == cube_rows(fresh)


def test_date_order_is_decided_once_per_file(spark):
    files = {
        ("t", "day.csv"): ["03/04/2024", "13/04/2024", "4/3/24", "5-6-2024", "2024-07-08", "1.2.2024", "31/12/2023 10:00", "nonsense", None],
        ("t", "month.csv"): ["03/04/2024", "04/13/2024", "7/8/24"],
        ("t", "open.csv"): ["03/04/2024", "05/06/2024"],
        ("t", "tie.csv"): ["13/04/2024", "04/13/2024", "03/04/2024"],
        ("t", "most.csv"): ["13/04/2024", "14/04/2024", "04/13/2024", "03/04/2024", "99/99/2024", "12/34/567"],
        (None, "day.csv"): ["03/04/2024", "04/13/2024"],
        ("u", None): ["03/04/2024", "13/04/2024"],
    }
    day_first = {("t", "day.csv"), ("t", "most.csv"), ("u", None)}
    rows = [(t, f, d, "x", "1", "") for (t, f), dates in files.items() for d in dates]
    table = spark.createDataFrame(rows, "user_id string, file string, date string, product string, sales string, category string")
    orders = {(r[0], r[1]): r[2] for r in ingest.date_orders(table, ["user_id", "file"]).collect()}
    assert {k for k, v in orders.items() if v} == day_first
    out = ops.flag_upload(table.withColumn("day_first", F.lit("clash")), SALES, files=["user_id", "file"])
    assert out.count() == len(rows)
    read = {(r["user_id"], r["file"], r["date"]): r["_date"] for r in out.collect()}
    date = dt.date
    assert read["t", "day.csv", "03/04/2024"] == date(2024, 4, 3) and read["t", "day.csv", "4/3/24"] == date(2024, 3, 4)
    assert read["t", "day.csv", "5-6-2024"] == date(2024, 6, 5) and read["t", "day.csv", "2024-07-08"] == date(2024, 7, 8)
    assert read["t", "day.csv", "1.2.2024"] == date(2024, 2, 1) and read["t", "day.csv", "31/12/2023 10:00"] == date(2023, 12, 31)
    assert read["t", "day.csv", "nonsense"] is None and read["t", "day.csv", None] is None
    assert read["t", "month.csv", "03/04/2024"] == read["t", "open.csv", "03/04/2024"] == read["t", "tie.csv", "03/04/2024"] == date(2024, 3, 4)
    assert read["t", "most.csv", "03/04/2024"] == date(2024, 4, 3) and read["t", "most.csv", "04/13/2024"] == date(2024, 4, 13)
    assert read["u", None, "03/04/2024"] == date(2024, 4, 3) and read[None, "day.csv", "03/04/2024"] == date(2024, 3, 4)
    plain = ops.flag_upload(table, SALES)
    assert {r["_date"] for r in plain.collect() if r["date"] == "03/04/2024"} == {date(2024, 3, 4)}
