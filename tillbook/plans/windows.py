"""Figures of any window of days from stored running totals, and distinct parties from bitmaps.

Running totals hold, per tenant and calendar month, what was sold before the month and after each of its
days. A window is the difference of two of them, each found by an equality join on the month, so that
any number of windows is answered without the ledger.

Distinct parties do not add up over months. Parties are therefore numbered, those of a tenant next to
each other, and each month of a tenant has bitmaps of the numbers that occur; a span of months is their
union.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillbook.operators.metrics import record_count
from tillbook.operators.ranking import number_rows
from tillbook.spec import TENANT, LedgerSpec


def running_totals(ledger: DataFrame, spec: LedgerSpec) -> DataFrame:
    """``user_id``, ``month`` (every one from the tenant's first to its last), ``total`` and ``records`` before
    the month, and ``days``: day, total and records from the first day of all to the end of that day.

    Undated rows are in no window. Rows are summed to days before anything is ordered, so that a tenant
    is as many rows as it has days.
    """
    dated = ledger.filter(F.col("date").isNotNull())
    days = dated.groupBy(TENANT, "date").agg(F.sum(spec.amount).alias("total"), record_count(ledger).alias("records"))
    first = F.trunc("date", "MM")
    so_far = Window.partitionBy(TENANT).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    days = days.select(
        TENANT, first.alias("month"), "date", F.sum("total").over(so_far).alias("total"), F.sum("records").over(so_far).alias("records")
    )
    months = days.groupBy(TENANT, "month").agg(F.sort_array(F.collect_list(F.struct("date", "total", "records"))).alias("days"))
    every = Window.partitionBy(TENANT).orderBy("month")
    after = F.coalesce(F.lead("month").over(every), F.add_months("month", 1))
    last = F.element_at("days", -1)
    # A month of sales also stands for the months without any up to the next one.
    spread = months.withColumns({"_next": after, "_last": last, "_before": F.lag(last).over(every)})
    spread = spread.withColumn("_at", F.explode(F.sequence("month", F.add_months("_next", -1), F.expr("interval 1 month"))))
    own = F.col("_at") == F.col("month")
    carried = F.when(own, F.col("_before")).otherwise(F.col("_last"))
    kind = dict(days.dtypes)["total"]
    return spread.select(
        TENANT, F.col("_at").cast("date").alias("month"),
        F.coalesce(carried["total"], F.lit(0)).cast(kind).alias("total"),
        F.coalesce(carried["records"], F.lit(0)).cast("bigint").alias("records"),
        F.when(own, F.col("days")).otherwise(F.slice("days", 1, 0)).alias("days"),
    )


def _up_to(name: str, day: Column) -> Column:
    """Total and records of a month's row at the end of a day."""
    passed = F.filter(F.col(f"{name}.days"), lambda d: d["date"] <= day)
    last = F.try_element_at(passed, F.lit(-1))
    before = F.struct(F.col(f"{name}.total"), F.col(f"{name}.records"))
    return F.when(last.isNotNull(), F.struct(last["total"].alias("total"), last["records"].alias("records"))).otherwise(before)


def kpis_windows(running: DataFrame, windows: DataFrame) -> DataFrame:
    """``windows`` (``user_id``, ``start`` and ``end``, both inclusive, null for open, and any other columns) with
    ``total``, ``records`` and ``average`` of the dated rows in them, from :func:`running_totals`.

    A tenant without rows has totals of zero and a null average, as has an empty window.
    """
    bounds = running.groupBy(F.col(TENANT).alias("_tenant")).agg(
        F.min("month").alias("_first"), F.max("month").alias("_final"), F.max_by(F.struct("total", "records", "days"), "month").alias("_end")
    )
    asked = windows.join(bounds, F.col(TENANT) == F.col("_tenant"), "left")
    # The day up to which is summed, and the one up to which is taken off.
    last = F.coalesce(F.least("end", F.last_day("_final")), F.last_day("_final"))
    before = F.coalesce(F.date_sub("start", 1), F.date_sub("_first", 1))
    before = F.least(before, F.last_day("_final"))
    asked = asked.withColumns({"_to": last, "_from": before})
    lookup = running.select(F.struct(TENANT, "month", "total", "records", "days").alias("row"))
    for name in ("_to", "_from"):
        side = lookup.select(F.col("row").alias(f"{name}_row"))
        same = (F.col(TENANT) == F.col(f"{name}_row.{TENANT}")) & (F.trunc(name, "MM") == F.col(f"{name}_row.month"))
        asked = asked.join(side, same, "left")
    to, off = _up_to("_to_row", F.col("_to")), _up_to("_from_row", F.col("_from"))
    empty = F.coalesce(F.col("start") > F.col("end"), F.lit(False))
    value = lambda field: F.when(empty, 0).otherwise(F.coalesce(to[field], F.lit(0)) - F.coalesce(off[field], F.lit(0)))
    kind = dict(running.dtypes)["total"]
    out = asked.select(*windows.columns, value("total").cast(kind).alias("total"), value("records").cast("bigint").alias("records"))
    average = F.col("total").cast("double") / F.nullif(F.col("records"), F.lit(0))
    return out.withColumn("average", average)


def party_numbers(ledger: DataFrame, spec: LedgerSpec) -> DataFrame:
    """``user_id``, party and ``number`` of every pair that occurs, from 1 in their order, so that the numbers of
    a tenant lie together. Numbered by range partitions, none of which holds all."""
    pairs = ledger.filter(F.col(spec.party).isNotNull()).select(TENANT, spec.party).distinct()
    return number_rows(pairs, [F.col(TENANT), F.col(spec.party)], "number")


def party_bitmaps(ledger: DataFrame, numbers: DataFrame, spec: LedgerSpec) -> DataFrame:
    """``user_id``, ``month``, ``total``, ``records``, ``bucket`` and ``parties``, a bitmap of the numbers in the bucket
    that occur in the month. Total and records are those of the bucket's rows; rows without a party are in
    bucket 0 and no bitmap. Undated rows have a null month."""
    rows = ledger.groupBy(TENANT, F.trunc("date", "MM").alias("month"), spec.party).agg(
        F.sum(spec.amount).alias("total"), record_count(ledger).alias("records")
    )
    numbered = rows.join(numbers, [TENANT, spec.party], "left")
    return numbered.groupBy(TENANT, "month", F.coalesce(F.bitmap_bucket_number("number"), F.lit(0)).alias("bucket")).agg(
        F.sum("total").alias("total"), F.sum("records").alias("records"),
        F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("parties"),
    )


def kpis_from_bitmaps(bitmaps: DataFrame, spans: DataFrame) -> DataFrame:
    """``spans`` (``user_id``, ``first`` and ``last`` month, given by any day of it, and any other columns) with
    ``total``, ``average``, ``parties`` (distinct) and ``records``, from :func:`party_bitmaps`; spans without rows are
    left out."""
    named = spans.withColumn("_span", F.struct(*spans.columns))
    months = named.select(
        F.col(TENANT), "_span",
        F.explode(F.sequence(F.trunc("first", "MM"), F.trunc("last", "MM"), F.expr("interval 1 month"))).alias("month"),
    )
    found = months.join(bitmaps, [TENANT, "month"])
    united = found.groupBy("_span", "bucket").agg(
        F.bitmap_count(F.bitmap_or_agg("parties")).alias("parties"), F.sum("total").alias("total"), F.sum("records").alias("records")
    )
    out = united.groupBy("_span").agg(*[F.sum(c).alias(c) for c in ("total", "parties", "records")])
    average = F.col("total").cast("double") / F.col("records")
    return out.select("_span.*", "total", average.alias("average"), "parties", "records")
