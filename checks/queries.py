"""The registered queries: each takes ``(spark, folder)`` and reads the tables in that folder."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillbook import EXPENSES, SALES, LedgerSpec
from tillbook import operators as ops
from tillbook import plans
from tillbook import sources as src
from tillbook.functions import format_currency
from tillbook.sources import warehouse as wh

Query = Callable[[SparkSession, str], DataFrame]

# Selections used by the filtered queries: a two-year span and, in one case, a category.
START, END = "1997-01-01", "1998-12-31"
CATEGORIES = ["", "PROMO", "ECONOMY", "F"]

LEDGERS = {"sales": (SALES, wh.sales_ledger), "expenses": (EXPENSES, wh.expense_ledger)}


def _plain(df: DataFrame) -> DataFrame:
    """Decimals as doubles, so that results compare across engines."""
    money = [f.name for f in df.schema.fields if f.dataType.typeName() == "decimal"]
    return df.withColumns({c: F.col(c).cast("double") for c in money}) if money else df


def _rounded(df: DataFrame, **places: int) -> DataFrame:
    return df.withColumns({c: F.bround(c, p) for c, p in places.items()})


def _clean(read: Callable, spec: LedgerSpec, spark: SparkSession, folder: str) -> DataFrame:
    return ops.clean_ledger(read(spark, folder), spec)


def ledger_queries(spec: LedgerSpec, read: Callable[[SparkSession, str], DataFrame]) -> dict[str, Query]:
    """Queries that exist once per ledger."""

    def on_ledger(operator: Callable[[DataFrame], DataFrame]) -> Query:
        return lambda spark, folder: _plain(operator(_clean(read, spec, spark, folder)))

    def cube(spark: SparkSession, folder: str) -> DataFrame:
        return plans.ledger_cube(_clean(read, spec, spark, folder), spec)

    def goal(spark: SparkSession, folder: str) -> DataFrame:
        goals = wh.goals(spark, folder, spec.goal_kind)
        return _plain(ops.goal_progress(_clean(read, spec, spark, folder), spec, goals))

    def prior(spark: SparkSession, folder: str) -> DataFrame:
        ledger = _clean(read, spec, spark, folder)
        bounds = ops.period_bounds(ops.filter_ledger(ledger, spec, START, END))
        return _plain(_rounded(ops.prior_kpis(ledger, bounds, spec, start=START, end=END), average=6))

    def prior_lines(spark: SparkSession, folder: str) -> DataFrame:
        ledger = _clean(read, spec, spark, folder)
        bounds = ops.period_bounds(ops.filter_ledger(ledger, spec, START, END))
        return _plain(ops.prior_rows(ledger, bounds, spec))

    def trend(**options) -> Query:
        return on_ledger(
            lambda l: _rounded(ops.kpis_with_trend(l, spec, START, END, **options), value=6, previous=6, pct=6)
        )

    def named(ledger: DataFrame) -> DataFrame:
        """Parties with an e in their name."""
        return ledger.select(spec.party).filter(F.contains(spec.party, F.lit("e"))).distinct()

    def filtered(spark: SparkSession, folder: str) -> DataFrame:
        """All four selections: dates, a list of categories, a table of parties."""
        ledger = _clean(read, spec, spark, folder)
        return _plain(ops.filter_ledger(ledger, spec, START, END, named(ledger), CATEGORIES))

    def filtered_by_tables(spark: SparkSession, folder: str) -> DataFrame:
        ledger = _clean(read, spec, spark, folder)
        categories = spark.createDataFrame([(c,) for c in CATEGORIES], "category string")
        return _plain(ops.filter_ledger(ledger, spec, START, None, named(ledger), categories))

    def scan_some(spark: SparkSession, folder: str) -> DataFrame:
        """The stored ledger of two tenants and two years, both pushed to the files."""
        path = src.shared_folder(spark)
        ledger = read(spark, folder)
        src.write_ledger(ledger, path)
        kind = ledger.schema[spec.amount].dataType
        return _plain(src.scan_ledger(spark, path, spec, ["t1", "t7"], START, END, amount=kind))

    def global_goal(spark: SparkSession, folder: str) -> DataFrame:
        goals = wh.goals(spark, folder, spec.goal_kind)
        return _plain(ops.goal_progress(_clean(read, spec, spark, folder), spec, goals, by=[]))

    return {
        "clean_ledger": on_ledger(lambda l: l),
        "filter_ledger": on_ledger(lambda l: ops.filter_ledger(l, spec, START, END)),
        "kpis": on_ledger(lambda l: _rounded(ops.kpis(l, spec), average=6)),
        "filter_options": on_ledger(lambda l: ops.filter_options(l, spec)),
        "daily_totals": on_ledger(lambda l: ops.daily_totals(l, spec)),
        "top_parties_10": on_ledger(lambda l: ops.top_parties(l, spec)),
        "top_parties_5": on_ledger(lambda l: ops.top_parties(l, spec, n=5)),
        "party_share": on_ledger(lambda l: _rounded(ops.party_share(l, spec), percent=6)),
        "party_share_all": on_ledger(
            lambda l: _rounded(ops.party_share(l, spec, base="all"), percent=6)
        ),
        "month_over_month": on_ledger(lambda l: ops.month_over_month(l, spec)),
        "weekday_heatmap": on_ledger(lambda l: ops.weekday_heatmap(l, spec)),
        "weekday_heatmap_iso_year": on_ledger(
            lambda l: ops.weekday_heatmap(l, spec, by_iso_year=True)
        ),
        "monthly_totals_6": on_ledger(lambda l: ops.monthly_totals(l, spec)),
        "category_totals": on_ledger(lambda l: ops.category_totals(l, spec)),
        "ledger_totals": on_ledger(lambda l: _rounded(ops.ledger_totals(l, spec), average=6)),
        "period_bounds": on_ledger(
            lambda l: ops.period_bounds(ops.filter_ledger(l, spec, START, END))
        ),
        "prior_rows": prior_lines,
        "prior_kpis": prior,
        "kpis_with_trend": trend(),
        "kpis_with_trend_chosen": trend(categories=CATEGORIES),
        "kpis_with_trend_filtered": trend(categories=CATEGORIES, prior_scope="filtered"),
        "filter_ledger_all": filtered,
        "filter_ledger_tables": filtered_by_tables,
        "scan_ledger_tenants": scan_some,
        f"global_{spec.goal_kind}": global_goal,
        f"{spec.goal_kind}_progress": goal,
        "ledger_listing": on_ledger(lambda l: ops.ledger_listing(l, spec)),
        "list_page": on_ledger(lambda l: ops.list_page(l, spec, page=2)),
        "list_page_deep": on_ledger(lambda l: ops.list_page(l, spec, page=101)),
        "list_page_global": on_ledger(lambda l: ops.list_page(l, spec, page=201, by=[])),
        "list_page_by_amount": on_ledger(
            lambda l: ops.list_page(
                l, spec, page=3, where=F.col("category") != "", order=[F.col(spec.amount).desc()]
            )
        ),
        "ledger_cube": lambda spark, folder: _plain(cube(spark, folder)),
    }


def _cubes(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Cubes of both ledgers as written tables, read by grain."""
    return tuple(
        src.write_and_read(plans.ledger_cube(_clean(read, spec, spark, folder), spec), ["grain"])
        for spec, read in LEDGERS.values()
    )


def _summary(spark: SparkSession, folder: str) -> DataFrame:
    return plans.business_summary(*_cubes(spark, folder), SALES, EXPENSES)


def profit(spark: SparkSession, folder: str) -> DataFrame:
    sales, expenses = (_clean(read, spec, spark, folder) for spec, read in LEDGERS.values())
    return _plain(ops.profit(sales, expenses, SALES, EXPENSES))


def global_kpis(spark: SparkSession, folder: str) -> DataFrame:
    """All tenants taken as one, with both display texts."""
    ledger = _clean(wh.sales_ledger, SALES, spark, folder)
    out = ops.kpis(ledger, SALES, by=[])
    texts = {f"{c}_text": format_currency(F.col(c)) for c in ("total", "average")}
    return _plain(_rounded(out.withColumns(texts), average=6))


def ledger_listing_headings(spark: SparkSession, folder: str) -> DataFrame:
    ledger = _clean(wh.sales_ledger, SALES, spark, folder)
    return _plain(ops.ledger_listing(ledger, SALES, headings=True))


def scan_ledger(spark: SparkSession, folder: str, spec: LedgerSpec, read: Callable) -> DataFrame:
    """The ledger stored by month, then scanned for the tenants of a table (here: all of them)."""
    path = src.shared_folder(spark)
    ledger = read(spark, folder)
    src.write_ledger(ledger, path)
    tenants = wh.goals(spark, folder, "target")
    kind = ledger.schema[spec.amount].dataType
    return _plain(src.scan_ledger(spark, path, spec, tenants, amount=kind))


# Written CSV keeps the outer white space of its values.
CSV = {
    "header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False,
}


def csv_ingest(spark: SparkSession, folder: str) -> DataFrame:
    """Raw sales as CSV files with untidy headers and a column too many, read with one header for
    all, cleaned and split; the accepted rows.
    """
    path = src.shared_folder(spark)
    raw = wh.raw_sales(spark, folder).toDF(" USER_ID", "Note", "Date ", "PRODUCT", " Sales ", "Category")
    raw.write.csv(path, **CSV)
    return ops.ingest_upload(src.read_csv_ledger(spark, path), SALES)[0]


def _csv_lines(raw: DataFrame, columns: list[str]) -> DataFrame:
    """Rows as CSV lines, every value in quotes."""
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.coalesce(c, F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))
    return raw.select("user_id", F.concat_ws(",", *[quoted(c) for c in columns]).alias("line"))


def _csv_folder(spark: SparkSession, folder: str) -> str:
    """Raw sales as CSV files in two layouts, with lines and files that must be refused."""
    path = src.shared_folder(spark)
    raw = wh.raw_sales(spark, folder)
    odd = F.split_part("id", F.lit("-"), F.lit(1)).cast("bigint") % 2 == 1
    tenants = src.write_and_read(raw.select("user_id").distinct())

    plain = {**CSV, "header": False, "sep": "\u0001", "quote": "", "escapeQuotes": False}

    def write(lines: DataFrame, name: str, *first: str) -> None:
        """One file per tenant: the first lines, then the rows."""
        top = F.posexplode(F.array(*[F.lit(x) for x in first])).alias("k", "line")
        whole = tenants.select("user_id", top).unionByName(lines.withColumn("k", F.lit(len(first))))
        whole = whole.repartition("user_id").sortWithinPartitions("user_id", "k").drop("k")
        whole.write.partitionBy("user_id").csv(f"{path}/{name}", **plain)

    a, b = "date,product,sales,category", ' SALES ,Note,"Category",Product,DATE'
    wide, broken = '"2024-01-01","x","1","y","z"', '"2024-01-01","cut'
    write(_csv_lines(raw.filter(odd), a.split(",")), "a.csv", a, a, wide, broken)
    second = raw.filter(~odd).withColumn("note", F.lit("n"))
    write(_csv_lines(second, ["sales", "note", "category", "product", "date"]), "b.csv", b)
    nothing = tenants.withColumn("line", F.lit(a)).limit(0)
    write(nothing, "c.csv", a)
    tenants.withColumn("line", F.lit(a)).repartition("user_id").write.partitionBy("user_id").text(f"{path}/d.xls")
    stray = spark.createDataFrame([(a,), ("2024-01-01,x,1,",)], "line string")
    stray.coalesce(1).write.csv(f"{path}/e.csv", **plain)
    return path


def _csv_folder_rows(spark: SparkSession, folder: str) -> DataFrame:
    return src.read_csv_uploads(spark, _csv_folder(spark, folder), SALES)


def csv_mixed_layouts(spark: SparkSession, folder: str) -> DataFrame:
    """Accepted rows of files in two layouts, with the file they come from."""
    flagged = ops.flag_upload(_csv_folder_rows(spark, folder), SALES).filter(F.col("reject_reason").isNull())
    return flagged.select(
        F.regexp_extract("file", r"/(\w\.\w+)/user_id", 1).alias("file"), "user_id", F.col("_date").alias("date"),
        "product", F.col("_amount").alias("sales"), F.coalesce("category", F.lit("")).alias("category"),
    )


def csv_quarantine(spark: SparkSession, folder: str) -> DataFrame:
    """Rows set aside of the same files, counted by tenant and reason."""
    _, quarantine = ops.ingest_upload(_csv_folder_rows(spark, folder), SALES)
    return quarantine.groupBy("user_id", "reject_reason").agg(F.count("*").alias("n"))


def csv_multiline_split(spark: SparkSession, folder: str) -> DataFrame:
    """Accepted rows of CSV files, one per tenant, in which many products hold line breaks and quotes."""
    path = src.shared_folder(spark)
    raw = wh.raw_sales(spark, folder)
    quantity = F.split_part("id", F.lit("-"), F.lit(5)).cast("int")
    long = F.concat(F.col("product"), F.lit('\n"b", c\r\n\n'), F.col("product"))
    raw = raw.withColumn("product", F.when(quantity.between(10, 40), long).otherwise(F.col("product")))
    raw.drop("id").repartition("user_id").write.partitionBy("user_id").csv(path, **CSV)
    return ops.ingest_upload(src.read_csv_uploads(spark, path, SALES, multiline=True), SALES)[0]


def csv_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Raw sales written as CSV files, one folder per tenant, and read back as uploads."""
    path = src.shared_folder(spark)
    raw = wh.raw_sales(spark, folder).drop("id")
    raw.write.partitionBy("user_id").csv(path, **CSV)
    return src.read_csv_uploads(spark, path, SALES).drop("file", "reject_reason")


def _flagged(read: Callable, spec: LedgerSpec, accepted: bool) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        parts = ops.ingest_upload(read(spark, folder).drop("id"), spec)
        return _plain(parts[0] if accepted else parts[1])

    return query


def decode_uploads(spark: SparkSession, folder: str) -> DataFrame:
    """Base64 uploads decoded, parsed and split into good rows and stated reasons."""
    rows = src.decode_uploads(wh.uploads(spark, folder), SALES)
    flagged = ops.flag_upload(rows, SALES)
    return flagged.select(
        "user_id", "file", F.col("_date").alias("date"), "product",
        F.col("_amount").alias("sales"), "category", "reject_reason",
    )


def decode_large_uploads(spark: SparkSession, folder: str) -> DataFrame:
    """Envelopes with a tenant's raw sales of a thousand order numbers each, decoded in chunks; the good rows."""
    columns = ["date", "product", "sales", "category"]
    raw = wh.raw_sales(spark, folder)
    thousand = F.floor(F.split_part("id", F.lit("-"), F.lit(1)).cast("bigint") / 1000).alias("thousand")
    lines = _csv_lines(raw.withColumn("user_id", F.struct("user_id", thousand)), columns)
    whole = lines.groupBy("user_id").agg(F.array_join(F.collect_list("line"), "\n").alias("body"))
    payload = F.base64(F.encode(F.concat(F.lit(",".join(columns) + "\n"), F.col("body")), "UTF-8"))
    packed = whole.select(
        "user_id.user_id", F.concat("user_id.thousand", F.lit(".csv")).alias("filename"),
        F.concat(F.lit("data:text/csv;base64,"), payload).alias("contents"),
    )
    return ops.ingest_upload(src.decode_large_uploads(packed, SALES, chunk=1 << 10), SALES)[0]


def validate_entries(spark: SparkSession, folder: str) -> DataFrame:
    return ops.validate_entries(wh.entries(spark, folder), SALES)


def validate_edits(spark: SparkSession, folder: str) -> DataFrame:
    edits = wh.entries(spark, folder).withColumn(
        "id", F.when(F.col("category").isNotNull(), F.col("id"))
    )
    return ops.validate_edits(edits, SALES)


def append_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The ledger plus the inserts of the change set."""
    new = wh.changes(spark, folder).filter(F.col("op") == "insert").drop("op", "seq")
    return _plain(ops.append_rows(wh.sales_ledger(spark, folder), new))


def clear_tenant(spark: SparkSession, folder: str) -> DataFrame:
    """The ledger without the tenants that have no target."""
    unset = wh.goals(spark, folder, "target").filter(F.col("goal") == 0)
    return _plain(ops.clear_tenant(wh.sales_ledger(spark, folder), unset))


def _changes(spark: SparkSession, folder: str, op: str) -> DataFrame:
    return wh.changes(spark, folder).filter(F.col("op") == op)


def apply_updates(spark: SparkSession, folder: str) -> DataFrame:
    updates = _changes(spark, folder, "update")
    return _plain(ops.apply_updates(wh.sales_ledger(spark, folder), updates, SALES))


def apply_deletes(spark: SparkSession, folder: str) -> DataFrame:
    return _plain(
        ops.apply_deletes(wh.sales_ledger(spark, folder), _changes(spark, folder, "delete"))
    )


def apply_changes(spark: SparkSession, folder: str) -> DataFrame:
    ledger, changes = wh.sales_ledger(spark, folder), wh.changes(spark, folder)
    return _plain(ops.apply_changes(ledger, changes, SALES))


def _partial_changes(spark: SparkSession, folder: str) -> DataFrame:
    """Updates that give one field each, several for some records, and two kinds of other changes."""
    line = wh.sales_ledger(spark, folder).withColumn("q", F.split_part("id", F.lit("-"), F.lit(5)).cast("int"))
    none = F.lit(None)

    def change(where: str, op: str, seq: int, date=none, product=none, sales=none, category=none, suffix=""):
        fields = F.struct(
            F.concat("id", F.lit(suffix)).alias("id"), F.lit(op).alias("op"),
            F.lit(seq).cast("bigint").alias("seq"), date.cast("date").alias("date"),
            product.cast("string").alias("product"), sales.cast("decimal(18,2)").alias("sales"),
            category.cast("string").alias("category"),
        )
        return F.when(F.expr(where), fields)

    name, late = F.col("product"), F.lit("1999-09-09")
    steps = F.array(
        change("q <= 4", "update", 1, sales=F.col("sales") + 1),
        change("q in (1, 2, 6)", "update", 2, product=F.concat(name, F.lit(" a"))),
        change("q in (1, 2)", "update", 3, product=F.concat(name, F.lit(" b"))),
        change("q in (3, 5)", "update", 4, date=late),
        change("q = 3", "update", 5, category=F.lit("again")),
        change("q = 7", "insert", 1, product=name, sales=F.col("sales"), suffix="-new"),
        change("q = 8", "delete", 1),
    )
    return line.filter("q <= 8").select("user_id", F.inline(F.array_compact(steps)))


def apply_changes_partial(spark: SparkSession, folder: str) -> DataFrame:
    return _plain(ops.apply_changes(wh.sales_ledger(spark, folder), _partial_changes(spark, folder), SALES))


def store_changes(spark: SparkSession, folder: str) -> DataFrame:
    """The same changes applied to a stored ledger, twice, which must not matter; then scanned."""
    path = src.shared_folder(spark)
    ledger = wh.sales_ledger(spark, folder)
    src.write_ledger(ledger, path)
    kind = ledger.schema["sales"].dataType
    for _ in range(2):
        src.store_changes(spark, path, _partial_changes(spark, folder), SALES, kind)
    return _plain(src.scan_ledger(spark, path, SALES, amount=kind))


def _stored(spark: SparkSession, folder: str, batches: int = 1) -> src.Store:
    """The sales ledger as a store of versions, appended in some batches."""
    ledger = wh.sales_ledger(spark, folder)
    store = src.Store(src.shared_folder(spark), SALES, ledger.schema["sales"].dataType)
    for k in range(batches):
        src.append_batch(spark, store, ledger.filter(F.pmod(F.hash("id"), F.lit(batches)) == k), f"part {k}")
    return store


def store_snapshots(spark: SparkSession, folder: str) -> DataFrame:
    """A ledger before and after a change set, both read after the change."""
    store = _stored(spark, folder)
    src.change_store(spark, store, _partial_changes(spark, folder))
    read = [src.read_store(spark, store, version=v).withColumn("version", F.lit(v)) for v in src.versions(spark, store)]
    return _plain(read[0].unionByName(read[1]))


def _records_and_ids(rows: DataFrame, content: list[str]) -> DataFrame:
    """Records and distinct ids per content, exactly.

    Equal ids have equal hashes, so only records whose id's hash occurs again are compared by their values;
    all others are counted once each.
    """
    hashed = rows.select(*content, "id", F.xxhash64("id").alias("_hash"))
    again = src.write_and_read(hashed.groupBy("_hash").agg(F.count("*").alias("_n")).filter("_n > 1").select("_hash"))
    same = hashed.join(again, "_hash", "left_semi").groupBy(*content, "id").agg(F.count("id").alias("_n")).filter("_n > 1")
    one = F.lit(1).cast("bigint")
    known = F.col("id").isNotNull().cast("bigint")
    counts = rows.select(*content, one.alias("records"), known.alias("ids")).unionAll(
        same.select(*content, (one - 1).alias("records"), (one - F.col("_n")).alias("ids"))
    )
    return counts.groupBy(*content).agg(F.sum("records").alias("records"), F.sum("ids").alias("ids"))


def append_twice(spark: SparkSession, folder: str) -> DataFrame:
    """Lines without ids in two batches, each appended twice: how many records of each content there are."""
    ledger = wh.sales_ledger(spark, folder)
    store = src.Store(src.shared_folder(spark), SALES, ledger.schema["sales"].dataType)
    lines = src.write_and_read(ledger.select("user_id", "date", F.lit("any").alias("product"), "sales", "category"))
    for batch in ("first", "second", "first", "second"):
        src.append_batch(spark, store, lines, batch)
    content = ["user_id", "date", "product", "sales", "category"]
    return _plain(_records_and_ids(src.read_store(spark, store), content))


def store_compacted(spark: SparkSession, folder: str) -> DataFrame:
    """A ledger appended in batches, whose files were merged."""
    store = _stored(spark, folder, 3)
    src.compact_store(spark, store)
    return _plain(src.read_store(spark, store))


def list_page_indexed(spark: SparkSession, folder: str) -> DataFrame:
    """Page 101 of every tenant's listing, by the index of a stored ledger."""
    return _plain(src.list_page_indexed(spark, _stored(spark, folder), page=101, bucket_rows=500))


def cube_refreshed(spark: SparkSession, folder: str) -> DataFrame:
    """A stored ledger's cube, brought up to date after each of three changes from the changed files alone."""
    store = _stored(spark, folder)
    cube = src.write_and_read(plans.ledger_cube(src.read_store(spark, store), SALES))
    again = wh.sales_ledger(spark, folder).filter("user_id = 't7' and split_part(id, '-', 5) = '1'")
    for change in (
        lambda: src.change_store(spark, store, _partial_changes(spark, folder)),
        lambda: src.clear_store(spark, store, ["t7"]),
        lambda: src.append_batch(spark, store, again, "again"),
    ):
        old = src.versions(spark, store)[-1]
        removed, added = src.version_changes(spark, store, old, change().number)
        cube = src.write_and_read(plans.refresh_cube(cube, removed, added, SALES))
    return _plain(cube)


def _spans(spark: SparkSession, folder: str) -> DataFrame:
    """Windows of days and months for every tenant: open at either end for some."""
    nation = spark.read.parquet(f"{folder}/nation.parquet")
    tenant = F.concat(F.lit("t"), F.col("n_nationkey").cast("string")).alias("user_id")
    spans = nation.select(tenant, F.explode(F.sequence(F.lit(0), F.lit(24))).alias("k"))
    begin = F.date_add(F.lit("1991-11-20").cast("date"), F.col("k") * 97)
    return spans.select(
        "user_id", F.col("k").cast("bigint").alias("window"), F.when(F.col("k") % 5 != 0, begin).alias("start"),
        F.when(F.col("k") % 7 != 0, F.date_add(begin, F.col("k") * F.col("k") * 3)).alias("end"),
    )


def kpis_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Totals and records of 25 windows for each tenant, from running totals."""
    running = src.write_and_read(plans.running_totals(_clean(wh.sales_ledger, SALES, spark, folder), SALES))
    return _plain(_rounded(plans.kpis_windows(running, _spans(spark, folder)), average=6))


def kpis_from_bitmaps(spark: SparkSession, folder: str) -> DataFrame:
    """Figures of 25 spans of months for each tenant, distinct products among them, from bitmaps."""
    ledger = _clean(wh.sales_ledger, SALES, spark, folder)
    numbers = plans.party_numbers(ledger, SALES)
    bitmaps = src.write_and_read(plans.party_bitmaps(ledger, numbers, SALES))
    spans = _spans(spark, folder).filter("start is not null and end is not null")
    out = plans.kpis_from_bitmaps(bitmaps, spans.withColumnsRenamed({"start": "first", "end": "last"}))
    return _plain(_rounded(out, average=6))


def ingest_file_dates(spark: SparkSession, folder: str) -> DataFrame:
    """One file per tenant, written day first, month first, or day first with days that leave it open."""
    kind = F.substring("user_id", 2, 9).cast("int") % 3
    lines = wh.sales_ledger(spark, folder).filter((kind < 2) | (F.dayofmonth("date") <= 12) | F.col("date").isNull())
    text = F.when(kind == 1, F.date_format("date", "M/d/yyyy")).otherwise(F.date_format("date", "d/M/yyyy"))
    lines = lines.withColumns({"date": text, "sales": F.col("sales").cast("string"), "file": F.concat("user_id", F.lit(".csv"))})
    return ops.ingest_upload(lines.drop("id"), SALES, files=["user_id", "file"])[0]


def business_summary(spark: SparkSession, folder: str) -> DataFrame:
    return plans.flatten_summary(_summary(spark, folder), SALES, EXPENSES)


def summary_json(spark: SparkSession, folder: str) -> DataFrame:
    return plans.summary_json(_summary(spark, folder))


def insight_prompts(spark: SparkSession, folder: str) -> DataFrame:
    return plans.insight_prompts(_summary(spark, folder))


def _reply(text: Column) -> Column:
    message = F.struct(F.struct(text.alias("content")).alias("message"))
    return F.to_json(F.struct(F.array(message).alias("choices")))


def parse_replies(spark: SparkSession, folder: str) -> DataFrame:
    """Replies made from each tenant's daily sales: bare, fenced, incomplete, broken and others."""
    ledger = _clean(wh.sales_ledger, SALES, spark, folder)
    days = ops.daily_totals(ledger, SALES)
    kind = F.pmod(F.datediff("date", F.lit("1990-01-01").cast("date")), F.lit(7))
    day, total = F.date_format("date", "yyyy-MM-dd"), F.col("total").cast("string")
    q = lambda name, value: F.concat(F.lit(f'"{name}":"'), value, F.lit('"'))
    short = F.concat(F.lit("{"), q("summary", total), F.lit(","), q("risks", day), F.lit("}"))
    full = F.concat(
        F.lit("{"), q("summary", total), F.lit(',"strengths":["a","b"],'), q("risks", day),
        F.lit(","), q("recommendations", F.lit("1. keep")), F.lit(","), q("forecast", F.lit("up")),
        F.lit("}"),
    )
    text = (
        F.when(kind == 0, full)
        .when(kind == 1, F.concat(F.lit("\n```json\n"), full, F.lit("\n```\nthanks")))
        .when(kind == 2, F.concat(F.lit("```"), short, F.lit("```")))
        .when(kind == 3, short)
        .when(kind == 4, F.concat(F.lit("Sure: "), short))
        .when(kind == 5, F.concat(F.lit("["), short, F.lit("]")))
    )
    body = F.when(kind == 6, F.lit('{"error":"busy"}')).otherwise(_reply(text))
    replies = days.select("user_id", body.alias("body"))
    return plans.parse_replies(replies)


def all_queries() -> dict[str, Query]:
    out: dict[str, Query] = dict(ledger_queries(SALES, wh.sales_ledger))
    out |= {
        f"expense_{n}" if n not in ("budget_progress", "global_budget") else n: q
        for n, q in ledger_queries(EXPENSES, wh.expense_ledger).items()
    }
    out |= {
        "scan_ledger": partial(scan_ledger, spec=SALES, read=wh.sales_ledger),
        "expense_scan_ledger": partial(scan_ledger, spec=EXPENSES, read=wh.expense_ledger),
        "ingest_upload": _flagged(wh.raw_sales, SALES, True),
        "ingest_quarantine": _flagged(wh.raw_sales, SALES, False),
        "clean_ledger_raw": lambda spark, folder: ops.clean_ledger(wh.raw_sales(spark, folder), SALES),
        "expense_clean_ledger_raw": lambda spark, folder: ops.clean_ledger(wh.raw_expenses(spark, folder), EXPENSES),
        "expense_ingest_upload": _flagged(wh.raw_expenses, EXPENSES, True),
        "expense_ingest_quarantine": _flagged(wh.raw_expenses, EXPENSES, False),
    }
    for query in (
        profit, global_kpis, ledger_listing_headings, csv_ingest, csv_scan, decode_uploads, validate_entries,
        validate_edits, append_rows, clear_tenant, apply_updates, apply_deletes, apply_changes,
        apply_changes_partial, store_changes, store_snapshots, append_twice, store_compacted, list_page_indexed, cube_refreshed, kpis_windows,
        kpis_from_bitmaps, ingest_file_dates, decode_large_uploads, csv_multiline_split, csv_mixed_layouts, csv_quarantine,
        business_summary, summary_json, insight_prompts, parse_replies,
    ):
        out[query.__name__] = query
    return out
