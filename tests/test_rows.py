"""Cleaning, filters, uploads, entries and changes on small inputs."""

from __future__ import annotations

import base64

import pytest
from helpers import EXPENSES, SALES, day, ledger, rows
from pyspark.sql import functions as F

from tillbook import operators as ops
from tillbook import sources as src


def test_headers(spark):
    df = spark.createDataFrame([("a", "b", "c", "d")], ["date ", "Product", "SA\r\nLES", "CATEGORY"])
    assert ops.normalize_columns(df).columns == ["date", "product", "sales", "category"]
    with pytest.raises(ValueError, match="date"):
        ops.normalize_columns(spark.createDataFrame([("a", "b")], ["Date", "date "]))


def test_clean_ledger(spark):
    schema = "user_id string, id string, date string, product string, sales string, category string"
    df = spark.createDataFrame(
        [
            ("t", "1", "2024-01-05", "A", "10", None),
            ("t", "2", "bad", "B", "-2.5", "x"),
            ("t", "3", "2024-01-05", "C", "n/a", "x"),
            ("t", "4", "2024-01-05", "  ", "1", "x"),
            ("t", "5", "2024-01-05", "\t", "1", "x"),
            ("t", "6", "2024-01-05", " ", "1", "x"),
            ("t", "7", "2024-01-05", None, "1", "x"),
        ],
        schema,
    )
    clean = ops.clean_ledger(df, SALES)
    assert rows(clean.orderBy("id")) == [
        ("t", "1", day("2024-01-05"), "A", 10.0, ""),
        ("t", "2", None, "B", -2.5, "x"),
    ]
    assert rows(ops.clean_ledger(clean, SALES).orderBy("id")) == rows(clean.orderBy("id"))
    missing = ops.clean_ledger(df.drop("date", "category"), SALES)
    assert rows(missing.filter("id = 1")) == [("t", "1", None, "A", 10.0, "")]


FOUR = [
    ("t", "2024-02-01", "A", 1, "x"), ("t", "2024-02-02", "B", 2, ""),
    ("t", "2024-02-03", "A", 3, "y"), ("t", None, "A", 4, "x"),
]


@pytest.mark.parametrize(
    "filters, amounts",
    [
        ({}, [1, 2, 3, 4]),
        ({"parties": [], "categories": []}, [1, 2, 3, 4]),
        ({"start": "2024-02-01", "end": "2024-02-03"}, [1, 2, 3]),
        ({"end": "2024-02-02"}, [1, 2]),
        ({"parties": ["A"]}, [1, 3, 4]),
        ({"start": "2024-02-02", "parties": ["A"], "categories": ["y", "x"]}, [3]),
    ],
)
def test_filters(spark, filters, amounts):
    out = ops.filter_ledger(ledger(spark, FOUR), SALES, **filters)
    assert sorted(a for (a,) in rows(out, "sales")) == amounts


def test_filter_by_table(spark):
    chosen = spark.createDataFrame([("A",)], "name string")
    out = ops.filter_ledger(ledger(spark, FOUR), SALES, parties=chosen, start="2024-02-01")
    assert sorted(a for (a,) in rows(out, "sales")) == [1, 3]


def test_listing_and_pages(spark):
    book = ledger(spark, [("t", f"2024-01-{d:02d}", "A", d) for d in range(1, 26)] + [("t", None, "A", 99)])
    listing = ops.ledger_listing(book, SALES)
    amounts = [a for (a,) in rows(listing, "sales")]
    assert amounts == [*range(25, 0, -1), 99]
    pages = [rows(ops.list_page(book, SALES, page=p), "sales") for p in (1, 2, 3, 4)]
    assert [a for p in pages for (a,) in p] == amounts
    assert [len(p) for p in pages] == [10, 10, 6, 0]
    some = ops.list_page(book, SALES, where=F.col("sales") > 20, order=[F.col("sales").asc()], size=2)
    assert rows(some, "position", "sales") == [(1, 21.0), (2, 22.0)]
    named = ops.ledger_listing(book, SALES, headings=True)
    assert named.columns == ["user_id", "id", "Date", "Product", "Sales (₵)", "Category"]


def upload(spark, values):
    return spark.createDataFrame(
        values, "user_id string, date string, product string, sales string, category string"
    )


def test_ingest_reasons(spark):
    df = upload(
        spark,
        [
            ("t", "2024-01-05", " A ", " 5 ", None), ("t", "bad", "B", "1", "x"),
            ("t", "", "", "", ""), ("t", "2024-01-05", "C", "", "x"),
            ("t", "2024-01-05", "D", "1,234", "x"), ("t", "2024-01-05", "NA", "3", "x"),
            ("t", "2024-01-05", "  ", "3", "x"),
        ],
    )
    accepted, quarantine = ops.ingest_upload(df, SALES)
    assert sorted(rows(accepted, "product", "date", "sales", "category")) == [
        (" A ", day("2024-01-05"), 5.0, ""), ("B", None, 1.0, "x"),
    ]
    assert sorted(r for (r,) in rows(quarantine, "reject_reason")) == [
        "bad_amount", "empty_row", "missing_amount", "missing_party", "missing_party",
    ]


def test_ingest_without_amount_column(spark):
    accepted, quarantine = ops.ingest_upload(upload(spark, [("t", "2024-01-05", "A", "1", "")]).drop("sales"), SALES)
    assert accepted.count() == 0
    assert rows(quarantine, "reject_reason") == [("missing_amount",)]


def test_entries(spark):
    df = spark.createDataFrame(
        [
            ("t", "2024-01-05", " A ", 5.0, " x "), ("t", None, "A", 5.0, None),
            ("t", "2024-01-05", " ", 5.0, None), ("t", "2024-01-05", "A", None, None),
            ("t", "2024-01-05", "A", -1.0, None), ("t", "soon", "A", 0.0, None),
        ],
        "user_id string, date string, vendor string, amount double, category string",
    )
    out = rows(ops.validate_entries(df, EXPENSES), "vendor", "category", "reject_reason")
    assert out[0] == ("A", "x", None)
    assert [r[2] for r in out[1:]] == [*["missing_field"] * 3, "negative_amount", "bad_date"]


def test_edits(spark):
    df = spark.createDataFrame(
        [
            ("t", "1", "2024-01-05", "A", 5.0), ("t", None, "2024-01-05", "A", 5.0),
            ("t", "3", "2024-01-05", "A", None), ("t", "4", "soon", "A", 5.0),
            ("t", "5", "2024-01-05", "A", -1.0),
        ],
        "user_id string, id string, date string, product string, sales double",
    ).withColumn("category", F.lit(None).cast("string"))
    out = [r for (r,) in rows(ops.validate_edits(df, SALES), "reject_reason")]
    assert out == [None, "no_record", "missing_field", "bad_date", None]


CHANGE = (
    "user_id string, id string, op string, seq bigint, date date, product string, sales double, "
    "category string"
)


def change(user, rec, op, seq, amount=0.0):
    return (user, rec, op, seq, day("2024-05-05"), f"new{seq}", amount, "c")


def test_changes(spark):
    book = ledger(spark, [("t", "2024-01-01", f"P{i}", i) for i in range(6)])
    changes = spark.createDataFrame(
        [
            change("t", "r0", "update", 1, 10.0), change("t", "r0", "delete", 2),
            change("other", "r1", "delete", 1), change("t", "r2", "update", 1, 20.0),
            change("t", "r2", "update", 2, 21.0), change("t", "r3", "delete", 1),
            change("t", "r3", "insert", 2, 30.0), change("t", "r3", "update", 3, 31.0),
            change("t", "r4", "delete", 1), change("t", "r4", "update", 2, 40.0),
            change("t", "new", "insert", 1, 50.0), change("t", "none", "update", 1, 60.0),
        ],
        CHANGE,
    )
    out = rows(ops.apply_changes(book, changes, SALES).orderBy("id"), "id", "product", "sales")
    assert out == [
        ("new", "new1", 50.0), ("r1", "P1", 1.0), ("r2", "new2", 21.0), ("r3", "new3", 31.0),
        ("r5", "P5", 5.0),
    ]


def test_insert_then_delete_is_identity(spark):
    book = ledger(spark, FOUR)
    new = spark.createDataFrame([change("t", "n1", "insert", 1, 5.0)], CHANGE)
    grown = ops.append_rows(book, new.drop("op", "seq"))
    assert grown.count() == 5
    assert sorted(rows(ops.apply_deletes(grown, new), "id")) == sorted(rows(book, "id"))


def test_append_for_a_tenant(spark):
    new = spark.createDataFrame([("2024-01-01", "A", 1.0)], "date string, product string, sales double")
    out = ops.append_rows(ledger(spark, FOUR), new, tenant="u").filter("user_id = 'u'")
    ((user, rec, date, party, amount, category),) = rows(out)
    assert (user, date, party, amount, category) == ("u", day("2024-01-01"), "A", 1.0, "")
    assert rec


def test_updates_keep_what_is_not_given(spark):
    updates = spark.createDataFrame(
        [("t", "r0", None, "Z"), ("u", "r1", 9.0, "Z")],
        "user_id string, id string, sales double, product string",
    )
    out = rows(ops.apply_updates(ledger(spark, FOUR), updates, SALES).orderBy("id"), "product", "sales")
    assert out == [("Z", 1.0), ("B", 2.0), ("A", 3.0), ("A", 4.0)]


def test_clear_tenant(spark):
    book = ledger(spark, [("t", None, "A", 1), ("u", None, "A", 2)])
    assert rows(ops.clear_tenant(book, ["t"]), "user_id") == [("u",)]
    assert rows(ops.clear_tenant(book, spark.createDataFrame([("u",)], "user_id string")), "user_id") == [("t",)]


def envelope(name, payload, user="t"):
    if isinstance(payload, str):
        payload = payload.encode()
    return (user, name, "data:text/csv;base64," + base64.b64encode(payload).decode())


ENVELOPES = [
    envelope("a.csv", b"\xef\xbb\xbfdate,product,sales,category\n2024-01-05,Caf\xc3\xa9\xff,5,x\n\n  \n2024-01-06,B,6,\n"),
    envelope("B.CSV", 'Sales,"pro\nduct",Extra,DATE \r\n7,"a, ""b""",z,2024-01-07\r\n'.replace("\n", "", 1)),
    envelope("c.txt", "date,product,sales\n2024-01-05,A,1\n"),
    envelope("d.xlsx", b"PK"),
    ("t", "e.csv", "data:text/csv;base64,%%%"),
    envelope("f.csv", "date,product,sales\n"),
    envelope("g.csv", "Date,date ,product,sales\n2024-01-05,x,A,1\n"),
    envelope("h.csv", "date,date,product,sales\n2024-01-05,x,A,1\n2024-01-05,x,A,1,2\n"),
    ("t", None, None),
]


def test_envelopes(spark):
    df = spark.createDataFrame(ENVELOPES, "user_id string, filename string, contents string")
    out = ops.flag_upload(src.decode_uploads(df, SALES), SALES)
    seen = {}
    for f, d, p, s, r in rows(out, "file", "_date", "product", "_amount", "reject_reason"):
        seen.setdefault(f, []).append((str(d) if d else None, p, s, r))
    assert sorted(seen["a.csv"]) == [("2024-01-05", "Café", 5.0, None), ("2024-01-06", "B", 6.0, None)]
    assert seen["B.CSV"] == [("2024-01-07", 'a, "b"', 7.0, None)]
    reasons = {f: [v[3] for v in vs] for f, vs in seen.items() if f not in ("a.csv", "B.CSV", "h.csv")}
    assert reasons == {
        "c.txt": ["unsupported_file"], "d.xlsx": ["unsupported_file"], "e.csv": ["bad_encoding"],
        "f.csv": ["no_rows"], "g.csv": ["duplicate_header"], None: ["no_file"],
    }
    assert sorted(v[3] or "" for v in seen["h.csv"]) == ["", "too_many_fields"]


def test_line_breaks_in_quotes(spark):
    df = spark.createDataFrame(
        [envelope("a.csv", 'date,product,sales\n2024-01-05,"two\r\nlines ""q""",5\n2024-01-06,B,6\n')],
        "user_id string, filename string, contents string",
    )
    out = src.decode_uploads(df, SALES, multiline=True)
    assert sorted(rows(out, "product", "sales")) == [("B", "6"), ('two\r\nlines "q"', "5")]


def test_csv_files_of_different_layout(spark, tmp_path):
    (tmp_path / "user_id=t%201").mkdir()
    (tmp_path / "user_id=007").mkdir()
    (tmp_path / "user_id=t%201" / "a.csv").write_text("\n date,Product,sales\n2024-01-05,A,1\n\n2024-01-06,B,2\n")
    (tmp_path / "user_id=007" / "b.CSV").write_bytes(b'SALES,category,product,date\n3,"x, y",C\xfe,2024-01-07\n')
    (tmp_path / "user_id=007" / "c.txt").write_text("date,product,sales\n2024-01-05,A,1\n")
    out = src.read_csv_uploads(spark, str(tmp_path), SALES)
    columns = ("user_id", "date", "product", "sales", "category", "reject_reason")
    assert sorted(rows(out, *columns), key=str) == [
        ("007", "2024-01-07", "C", "3", "x, y", None),
        ("007", None, None, None, None, "unsupported_file"),
        ("t 1", "2024-01-05", "A", "1", None, None),
        ("t 1", "2024-01-06", "B", "2", None, None),
    ]
    one = src.read_csv_uploads(spark, str(tmp_path / "user_id=007"), SALES, tenant="z")
    assert rows(one.filter("reject_reason is null"), "user_id", "sales") == [("z", "3")]
    plain = src.read_csv_ledger(spark, str(tmp_path / "user_id=007"))
    assert rows(ops.conform(ops.normalize_columns(plain), SALES.upload_columns), "sales") == [("3",)]


def test_every_line_of_a_folder_has_a_place(spark, tmp_path):
    head = "date,product,sales,category\n"
    for tenant, name, text in (
        ("a", "x.csv", head + '2024-01-05,"Big\nbox",1,c\n' + head + "2024-01-06,B,2,c,9,9\n2024-01-07,C,3\n"),
        ("a", "y.csv", head), ("a", "z.csv", " \n"), ("b", "n.XLS", "x"),
    ):
        (tmp_path / f"user_id={tenant}").mkdir(exist_ok=True)
        (tmp_path / f"user_id={tenant}" / name).write_text(text)
    (tmp_path / "stray.csv").write_text(head + "2024-01-05,A,1,c\n")

    def reasons(**options):
        out = ops.flag_upload(src.read_csv_uploads(spark, str(tmp_path), SALES, **options), SALES)
        return sorted(rows(out, "user_id", "product", "reject_reason"), key=str)

    files = [("a", None, "no_rows"), ("a", None, "no_rows"), ("b", None, "unsupported_file"), (None, "A", "missing_tenant")]
    lines = [("a", "product", "repeated_header"), ("a", "B", "too_many_fields"), ("a", "C", None)]
    cut = [r for r in reasons() if r[2] == "unclosed_quote"]
    assert len(cut) == 2 and sorted([r for r in reasons() if r not in cut], key=str) == sorted(files + lines, key=str)
    whole = [r for r in reasons(multiline=True) if r not in files]
    assert sorted(whole, key=str) == sorted([*lines, ("a", "Big\nbox", None)], key=str)


def test_partial_updates_keep_what_they_do_not_give(spark):
    book = ledger(spark, [("t", "2024-01-05", "A", 1, "x"), ("t", "2024-01-06", "B", 2, "y")])
    schema = "user_id string, id string, op string, seq int, date date, product string, sales double, category string"
    steps = [
        ("t", "r0", "update", 1, None, "A2", None, None), ("t", "r0", "update", 2, None, None, 9.0, None),
        ("t", "r1", "update", 1, None, None, 5.0, None), ("t", "r1", "delete", 2, None, None, None, None),
        ("t", "new", "insert", 1, None, "N", 3.0, None), ("t", "new", "update", 2, None, None, 4.0, None),
    ]
    out = ops.apply_changes(book, spark.createDataFrame(steps, schema), SALES)
    want = [("new", None, "N", 4.0, ""), ("r0", day("2024-01-05"), "A2", 9.0, "x")]
    assert sorted(rows(out, "id", "date", "product", "sales", "category")) == want
    updates = spark.createDataFrame([s for s in steps if s[2] == "update"], schema)
    out = ops.apply_updates(book, updates, SALES)
    assert sorted(rows(out, "id", "product", "sales")) == [("r0", "A2", 9.0), ("r1", "B", 5.0)]


def test_one_goal_for_all(spark):
    goals = spark.createDataFrame([("t", 4.0), ("u", 16.0)], "user_id string, goal double")
    out = ops.goal_progress(ledger(spark, [("t", None, "A", 1), ("v", None, "B", 4)]), SALES, goals, by=[])
    assert rows(out, "actual", "goal", "pct") == [(5.0, 20.0, 25.0)]


def test_a_tenant_reads_few_row_groups(spark, tmp_path):
    import pyarrow.parquet as pq

    book = ledger(spark, [(f"t{i % 40:02d}", "2024-01-05", f"party {i}", i) for i in range(4000)])
    path = tmp_path / "ledger"
    src.write_ledger(book, str(path), **{"parquet.block.size": 4096, "parquet.page.size.row.check.min": 10,
                                         "parquet.block.size.row.check.min": 10})
    groups = []
    for file in path.rglob("*.parquet"):
        meta = pq.ParquetFile(file).metadata
        for i in range(meta.num_row_groups):
            stats = [meta.row_group(i).column(c).statistics for c in range(meta.num_columns)
                     if meta.row_group(i).column(c).path_in_schema == "user_id"][0]
            groups.append((stats.min, stats.max))
    assert len(groups) > 3 and sum(a <= "t07" <= b for a, b in groups) <= 1 + len(groups) // 3
    assert src.scan_ledger(spark, str(path), SALES, ["t07"]).count() == 100


def test_stored_ledger(spark, tmp_path):
    path = str(tmp_path / "ledger")
    book = ledger(spark, [*FOUR, ("u", "2024-03-01", "A", 5)])
    src.write_ledger(book, path)
    assert sorted(rows(src.scan_ledger(spark, path, SALES), "sales")) == [(1.0,), (2.0,), (3.0,), (4.0,), (5.0,)]
    assert rows(src.scan_ledger(spark, path, SALES, ["u"]), "sales") == [(5.0,)]
    march = src.scan_ledger(spark, path, SALES, start="2024-02-03", end="2024-03-31")
    assert sorted(rows(march, "sales")) == [(3.0,), (5.0,)]
    plan = march._jdf.queryExecution().executedPlan().toString()
    assert "month" in plan.split("PartitionFilters: [")[1].split("]")[0]
    flat = str(tmp_path / "flat")
    book.write.parquet(flat)
    assert rows(src.scan_ledger(spark, flat, SALES, start="2024-02-03", end="2024-02-28"), "sales") == [(3.0,)]
    src.write_json(book.select("id", "category"), str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 5


@pytest.mark.parametrize("date", [None, "2024-01-05"])
def test_a_hot_day_and_undated_rows_are_divided(spark, tmp_path, date):
    book, path = ledger(spark, [("t", date, "A", i) for i in range(2000)]), tmp_path / "ledger"
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(coalesce, "false")
    try:
        src.write_ledger(book, str(path))
    finally:
        spark.conf.unset(coalesce)
    sizes = [spark.read.parquet(str(f)).count() for f in path.rglob("*.parquet")]
    assert len(sizes) > 1 and max(sizes) < 1500 and sum(sizes) == 2000
