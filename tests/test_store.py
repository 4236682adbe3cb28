"""Stores of versions: stops between steps, writers at a time, repeated appends, files that are read, pages."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from checks.queries import _records_and_ids
from tillbook import SALES, operators as ops, sources as src
from tillbook.sources import pages, snapshots
from tillbook.spec import ledger_schema

DAY = dt.date(2024, 1, 1)


def rows_of(n, tenants=5, seed=3, days=40):
    pick = random.Random(seed)
    out = []
    for i in range(n):
        day = None if pick.random() < 0.1 else DAY + dt.timedelta(days=pick.randrange(days))
        tenant = "hot" if pick.random() < 0.4 else f"t{pick.randrange(tenants)}"
        out.append((tenant, f"{i:05d}", day, pick.choice("abc"), pick.randrange(1, 900), pick.choice(["", "x"])))
    return out


def ledger(spark, rows):
    plain = spark.createDataFrame(rows, "user_id string, id string, date date, product string, sales int, category string")
    return plain.withColumn("sales", F.col("sales").cast("decimal(18,2)")).to(ledger_schema(SALES))


def changes(spark, rows):
    """Updates, deletes and inserts ``(tenant, id, op, seq, product)``."""
    made = spark.createDataFrame(rows, "user_id string, id string, op string, seq bigint, product string")
    return made.selectExpr(
        "*", "cast(null as date) as date", "cast(if(op = 'insert', 5, null) as decimal(18,2)) as sales", "cast(null as string) as category"
    )


@pytest.fixture
def store(spark, tmp_path):
    return src.Store(str(tmp_path / "store"), SALES)


def content(df):
    return sorted(map(tuple, df.collect()), key=str)


CHANGES = [("hot", "00001", "update", 1, "new"), ("t1", "00007", "delete", 1, None), ("t9", "n1", "insert", 1, "first"), ("t1", "no", "update", 1, "x")]


class Stop(Exception):
    pass


def test_stops_between_any_two_steps(spark, store, monkeypatch):
    """A change that stops anywhere leaves the old ledger; run again it gives the new one."""
    base = ledger(spark, rows_of(300))
    src.append_batch(spark, store, base, "one")
    old = content(base)
    step = changes(spark, CHANGES)
    new = content(ops.apply_changes(base, step, SALES))

    def stops(name, after):
        real = getattr(snapshots, name)

        def broken(*args, **options):
            if after:
                real(*args, **options)
            raise Stop

        return broken

    for name, after in (("_touched", True), ("_write_files", False), ("_write_files", True), ("publish", False), ("rename_new", False)):
        with monkeypatch.context() as patch:
            patch.setattr(snapshots, name, stops(name, after))
            with pytest.raises(Stop):
                src.change_store(spark, store, step)
        assert content(src.read_store(spark, store)) == old and src.versions(spark, store) == [1]
    with monkeypatch.context() as patch:  # stopped after the rename: the change is done
        patch.setattr(snapshots, "rename_new", stops("rename_new", True))
        with pytest.raises(Stop):
            src.change_store(spark, store, step)
    assert content(src.read_store(spark, store)) == new
    src.change_store(spark, store, changes(spark, CHANGES[:2]))
    assert content(src.read_store(spark, store)) == new
    assert content(src.read_store(spark, store, version=1)) == old


def test_writers_at_a_time(spark, store, monkeypatch):
    """Who is second builds on what the first one committed; nothing is lost or added twice."""
    rows = rows_of(90)
    src.append_batch(spark, store, ledger(spark, rows[:30]), "a")
    real, seen = snapshots.publish, []

    def late(spark_, store_, version):
        if not seen:  # others commit just before this one does
            seen.append(version.number)
            src.append_batch(spark, store, ledger(spark, rows[30:60]), "b")
            src.change_store(spark, store, changes(spark, [("t9", "n2", "insert", 1, "theirs")]))
        real(spark_, store_, version)

    monkeypatch.setattr(snapshots, "publish", late)
    src.append_batch(spark, store, ledger(spark, rows[60:]), "c")
    assert src.versions(spark, store) == [1, 2, 3, 4] and seen == [2]
    found = content(src.read_store(spark, store).filter("id <> 'n2'"))
    assert found == content(ledger(spark, rows)) and src.read_store(spark, store).count() == 91
    seen.clear()
    src.append_batch(spark, store, ledger(spark, rows[30:60]), "b")  # committed before: nothing happens
    assert src.versions(spark, store) == [1, 2, 3, 4]

    def same(spark_, store_, version):
        if not seen:
            seen.append(version.number)
            src.append_batch(spark, store, ledger(spark, rows_of(5, seed=9)), "d")
        real(spark_, store_, version)

    monkeypatch.setattr(snapshots, "publish", same)
    src.append_batch(spark, store, ledger(spark, rows_of(5, seed=9)), "d")
    assert src.read_store(spark, store).count() == 96
    with pytest.raises(snapshots.Conflict):
        real(spark, store, snapshots.Version(1, "", "", ""))


def test_derived_ids(spark):
    lines = ledger(spark, rows_of(200)).drop("id").unionByName(ledger(spark, rows_of(1)).drop("id"), True)
    lines = lines.unionByName(lines.limit(20)).withColumn("product", F.lit("same"))
    ids = content(snapshots.derived_ids(lines, "b"))
    assert ids == content(snapshots.derived_ids(lines.repartition(7), "b"))
    named = [r["id"] for r in snapshots.derived_ids(lines, "b").collect()]
    assert len(set(named)) == len(named) == lines.count()
    assert not set(named) & {r["id"] for r in snapshots.derived_ids(lines, "c").collect()}


def test_rows_with_derived_ids_are_moved_once_per_content(spark, store, monkeypatch):
    """What is dealt to files are counted rows; files hold every copy in the order of tenant, date and id, also
    where one content has more copies than are moved as one; no ranges of files are made by a sort of rows."""
    monkeypatch.setattr(snapshots, "COPIES", 3)
    lines = ledger(spark, rows_of(60)).drop("id", "category").withColumn("date", F.col("date").cast("string"))
    many = lines.unionByName(lines.limit(1).withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(50)))).drop("n"))
    dealt, plans, real_copies, real_write = [], [], snapshots._copies, snapshots.write_and_read
    monkeypatch.setattr(snapshots, "_copies", lambda df: dealt.append(df.count()) or real_copies(df))
    monkeypatch.setattr(
        snapshots, "write_and_read", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or real_write(df)
    )
    src.append_batch(spark, store, many.drop("user_id"), "one", tenant="t")
    src.append_batch(spark, store, many, "two")
    src.append_batch(spark, store, many, "two")
    assert all(n < 110 for n in dealt) and len(dealt) == 2
    assert plans and not any("SortAggregate" in plan for plan in plans)
    stored = src.read_store(spark, store)
    assert stored.count() == stored.select("id").distinct().count() == 220
    names = ["product", "sales", "date"]
    texts = lambda df: sorted(tuple(map(str, r)) for r in df.collect())
    assert texts(stored.select(*names, "category")) == texts(many.unionAll(many).select(*names, F.lit("")))
    assert stored.filter("user_id = 't'").count() >= 110
    keys = lambda r: (r["user_id"], r["date"] is not None, r["date"] or DAY, r["id"])
    for name in stored.inputFiles():
        rows = spark.read.schema(store.schema).parquet(name).coalesce(1).collect()
        assert [keys(r) for r in rows] == sorted(keys(r) for r in rows)
    files = snapshots.files_of(spark, store, snapshots.version_of(spark, store)).collect()
    assert sum(f["rows"] for f in files) == 220 and {f["file"].rsplit("/", 1)[-1] for f in files} == opened(stored)
    assert min(f["min_id"] for f in files) == stored.agg(F.min("id")).first()[0]
    assert sum(f["undated"] for f in files) == stored.filter("date is null").count()


def test_records_and_ids(spark):
    """Ids that occur again in one content, in several, or not at all."""
    rows = [("a", 1, "x"), ("a", 1, "x"), ("a", 1, "y"), ("b", 1, "x"), (None, 2, "z"), (None, 2, "z"), (None, 2, None), (None, 2, None), ("c", 3, "w")]
    df = spark.createDataFrame(rows, "name string, n int, id string")
    by = ["name", "n"]
    want = df.groupBy(*by).agg(F.count("*").alias("records"), F.count_distinct("id").alias("ids"))
    assert content(_records_and_ids(df, by)) == content(want)


def opened(df):
    """Files that a plan reads."""
    return {f.rsplit("/", 1)[-1] for f in df.inputFiles()}


def test_files_that_are_not_needed_are_not_read(spark, store, monkeypatch):
    monkeypatch.setattr(snapshots, "FILE_ROWS", 20)
    rows = rows_of(400)
    src.append_batch(spark, store, ledger(spark, rows), "a")
    every = opened(src.read_store(spark, store))
    some = src.read_store(spark, store, ["t2"], "2024-01-05", "2024-01-09")
    want = [r for r in rows if r[0] == "t2" and r[2] and dt.date(2024, 1, 5) <= r[2] <= dt.date(2024, 1, 9)]
    assert content(some) == content(ledger(spark, want)) and len(opened(some)) <= 3 < len(every)
    table = spark.createDataFrame([("t2",), ("t4",), ("none",)], "user_id string")
    assert content(src.read_store(spark, store, table)) == content(ledger(spark, [r for r in rows if r[0] in ("t2", "t4")]))
    files = lambda: {r["file"] for r in snapshots.files_of(spark, store, snapshots.version_of(spark, store)).collect()}
    before = files()
    src.change_store(spark, store, changes(spark, [("t3", next(r[1] for r in rows if r[0] == "t3"), "update", 1, "z")]))
    assert len(before - files()) == 1  # one file is rewritten
    before = files()
    src.clear_store(spark, store, ["hot"])
    assert len(before - files()) >= 5
    assert src.read_store(spark, store).count() == sum(r[0] != "hot" for r in rows)
    assert src.clear_store(spark, store, ["hot"]).number == src.versions(spark, store)[-1] == 3
    with pytest.raises(ValueError):
        src.read_store(spark, store, version=9)


def test_many_small_appends_are_merged(spark, store):
    rows = rows_of(240)
    for k in range(12):
        src.append_batch(spark, store, ledger(spark, rows[k::12]), str(k))
    assert len(opened(src.read_store(spark, store, ["t1"]))) >= 12
    src.compact_store(spark, store, rows=60)
    assert content(src.read_store(spark, store)) == content(ledger(spark, rows))
    assert len(opened(src.read_store(spark, store, ["t1"]))) <= 2
    number = src.versions(spark, store)[-1]
    src.compact_store(spark, store, rows=60)
    assert src.versions(spark, store)[-1] == number
    src.append_batch(spark, store, ledger(spark, rows[:20]), "5")  # batches are still known
    assert src.versions(spark, store)[-1] == number


def test_empty_stores(spark, store):
    assert src.read_store(spark, store).count() == 0 and src.versions(spark, store) == []
    assert src.list_page_indexed(spark, store).count() == 0
    assert src.compact_store(spark, store) is None and src.clear_store(spark, store, ["a"]) is None
    src.append_batch(spark, store, ledger(spark, []), "nothing")
    assert src.read_store(spark, store).count() == 0 and src.versions(spark, store) == [1]
    src.change_store(spark, store, changes(spark, CHANGES))
    assert [r["id"] for r in src.read_store(spark, store).collect()] == ["n1"]


def scanned(df):
    """Rows that the scans of a run plan gave."""
    df.collect()
    found, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if node.nodeName().startswith("AdaptiveSparkPlan"):
            todo.append(node.executedPlan())
        elif "QueryStage" in node.nodeName():
            todo.append(node.plan())
        else:
            if node.nodeName().startswith("Scan"):
                found += node.metrics().apply("numOutputRows").value()
            todo += [node.children().apply(i) for i in range(node.children().size())]
    return found


def test_pages_by_index(spark, store, monkeypatch):
    monkeypatch.setattr(snapshots, "FILE_ROWS", 25)
    rows = rows_of(900, days=6)  # busy days are longer than a bucket
    base = ledger(spark, rows)
    src.append_batch(spark, store, base, "a")
    for page in (1, 2, 7, 30, 200):
        want = content(ops.list_page(base, SALES, page=page))
        assert content(src.list_page_indexed(spark, store, page, bucket_rows=25)) == want
        listed = content(src.list_page_indexed(spark, store, page, tenants=["hot", "t3"], bucket_rows=25))
        assert listed == [r for r in want if r[0] in ("hot", "t3")]
    index = src.page_index(spark, store)
    assert index.agg(F.max("n"), F.sum("n")).first()[:] == (25, 900)

    step = changes(spark, CHANGES + [("t2", r[1], "delete", 1, None) for r in rows if r[0] == "t2"][:30])
    src.change_store(spark, store, step)
    seen = []
    real = pages._buckets
    monkeypatch.setattr(pages, "_buckets", lambda rows, size: seen.append(rows.count()) or real(rows, size))
    changed = ops.apply_changes(base, step, SALES)
    assert content(src.list_page_indexed(spark, store, 3, bucket_rows=25)) == content(ops.list_page(changed, SALES, page=3))
    assert content(src.list_page_indexed(spark, store, 3, number=1)) == content(ops.list_page(base, SALES, page=3))
    assert len(seen) == 1


def test_a_deep_page_reads_two_buckets(spark, store, monkeypatch):
    monkeypatch.setattr(snapshots, "FILE_ROWS", 100)
    days = 4000
    rows = [("one", f"{i:06d}", DAY - dt.timedelta(days=i % days), "a", 1, "") for i in range(20_000)]
    src.append_batch(spark, store, ledger(spark, rows + [("two", "x", DAY, "a", 1, "")]), "a")
    page = src.list_page_indexed(spark, store, page=1500, tenants=["one"], bucket_rows=200)
    order = sorted(rows, key=lambda r: (-r[2].toordinal(), r[1]))
    assert [r["id"] for r in page.collect()] == [r[1] for r in order[14_990:15_000]]
    index = src.page_index(spark, store).count()
    assert scanned(page) - index <= 2 * 200 + 2 * 100  # two buckets, and the rest of the files at both ends
