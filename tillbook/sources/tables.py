"""Stored ledgers and the JSON sink."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillbook.operators.changes import apply_changes
from tillbook.operators.filters import Day, as_day
from tillbook.operators.ranking import keep_by_key
from tillbook.shared import write_and_read
from tillbook.spec import BY, KEY, TENANT, LedgerSpec, ledger_schema

MONTH = "month"


def scan_ledger(
    spark: SparkSession,
    path: str,
    spec: LedgerSpec,
    tenants: Iterable[str] | DataFrame | None = None,
    start: Day = None,
    end: Day = None,
    amount: T.DataType | None = None,
) -> DataFrame:
    """Stored ledger, of some tenants or all. A list of tenants is pushed down to the files; a long
    list may come as a DataFrame with the tenant key. ``start`` and ``end`` select dates, and skip
    whole months of a ledger stored by :func:`write_ledger`.
    """
    schema = ledger_schema(spec, amount)
    ledger = spark.read.schema(schema.add(MONTH, T.StringType())).parquet(path)
    for day, keep in ((as_day(start), "__ge__"), (as_day(end), "__le__")):
        if day:
            # A ledger not stored by month has no month text: only its dates decide.
            months = F.col(MONTH).isNull() | getattr(F.col(MONTH), keep)(f"{day:%Y-%m}")
            ledger = ledger.filter(months & getattr(F.col("date"), keep)(F.lit(day)))
    ledger = ledger.drop(MONTH)
    if tenants is None:
        return ledger
    if isinstance(tenants, DataFrame):
        return keep_by_key(ledger, tenants, BY)
    return ledger.filter(F.col(TENANT).isin(list(tenants)))


def _month(day: str = "date") -> Column:
    return F.coalesce(F.date_format(day, "yyyy-MM"), F.lit("none"))


def write_ledger(ledger: DataFrame, path: str, mode: str = "append", **options) -> None:
    """Store rows as Parquet partitioned by calendar month and ordered by tenant and date within.

    The rows are range-partitioned by (month, tenant, date, id): a tenant's rows of a month lie together,
    so that file and row-group statistics let a tenant's scan skip the rest, and a hot tenant is
    divided by date, its undated rows and those of one busy day by id. ``options`` go to the Parquet writer.
    """
    keys = [MONTH, TENANT, "date"]
    (
        ledger.withColumn(MONTH, _month())
        .repartitionByRange(*keys, "id")
        .sortWithinPartitions(*keys)
        .write.mode(mode)
        .options(**options)
        .partitionBy(MONTH)
        .parquet(path)
    )


def store_changes(
    spark: SparkSession, path: str, changes: DataFrame, spec: LedgerSpec, amount: T.DataType | None = None
) -> None:
    """Apply a change set (see :func:`apply_changes`) to a ledger stored by :func:`write_ledger`.

    Only months that hold a changed record before or after are read and rewritten; their list, one
    entry per calendar month, is all that comes to the driver. The new rows are written to the shared
    folder first and then replace those months, one after another: this is not one step. A job that stops
    before the replacement may be run again; one that stops within it can leave a month incomplete, and
    readers may see some months changed and others not. Where that matters, keep the ledger in a store of
    versions and use :func:`change_store`.
    """
    schema = ledger_schema(spec, amount).add(MONTH, T.StringType())
    stored = spark.read.schema(schema).parquet(path)
    changes = write_and_read(changes)
    keys = write_and_read(changes.select(*KEY).distinct())
    before = stored.select(*KEY, MONTH).join(keys, list(KEY), "left_semi").select(MONTH)
    after = changes.filter("op <> 'delete'").select(_month().alias(MONTH))
    months = sorted(r[0] for r in before.union(after).distinct().collect())
    part = stored.filter(F.col(MONTH).isin(months)).drop(MONTH)
    # The part moves once: the steps below all go by record key. Of a changed record one row is left.
    marked = part.join(keys.withColumn("_hit", F.lit(True)), list(KEY), "left")
    copy = F.row_number().over(Window.partitionBy(*KEY).orderBy(*KEY))
    single = marked.withColumn("_copy", copy).filter("_hit is null or _copy = 1").select(*part.columns)
    result = write_and_read(apply_changes(single, changes, spec))
    write_ledger(result, path, "overwrite", partitionOverwriteMode="dynamic")
    left = {r[0] for r in result.select(_month()).distinct().collect()}
    for month in set(months) - left:  # a month without rows is in no output and would stay as it was
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{MONTH}={month}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    spark.catalog.refreshByPath(path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Store rows as JSON lines; null fields are left out."""
    df.write.mode(mode).json(path)
