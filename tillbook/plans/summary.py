"""The nested business summary of every tenant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillbook.operators import metrics
from tillbook.plans.cube import CATEGORY, DAY, PARTY, cube_grain
from tillbook.spec import BY, TENANT, LedgerSpec

_MONEY = "decimal(38,2)"


def _money(c: Column) -> Column:
    return F.bround(c, 2).try_cast(_MONEY)


def _as_map(df: DataFrame, key: str, order: Column, name: str) -> DataFrame:
    """One ordered map per tenant. Months and top parties are few by construction; the category map
    is as long as the tenant's list of categories, because the document shows them all.
    """
    entries = F.array_sort(F.collect_list(F.struct(order.alias("o"), F.col(key), F.col("total"))))
    pairs = F.transform(entries, lambda e: F.struct(e[key], _money(e["total"])))
    return df.groupBy(*BY).agg(F.map_from_entries(pairs).alias(name))


def ledger_section(cube: DataFrame, spec: LedgerSpec) -> DataFrame:
    """``(user_id, section)``: totals, last months, top parties and categories of one ledger."""
    days, parties, categories = (cube_grain(cube, g) for g in (DAY, PARTY, CATEGORY))
    monthly = _as_map(metrics.monthly_totals(days, spec, ordered=False), "month", F.col("month"), "monthly")
    top = _as_map(metrics.top_parties(parties, spec, n=5, ordered=False), spec.party, F.col("rank"), spec.top_key)
    by_category = _as_map(
        metrics.category_totals(categories, spec, ordered=False), "category", -F.col("total"), "by_category"
    )
    empty = F.create_map().cast(f"map<string,{_MONEY}>")
    joined = metrics.ledger_totals(days, spec)
    for part in (monthly, top, by_category):
        joined = joined.join(part, TENANT, "left")
    return joined.select(
        TENANT,
        F.struct(
            _money(F.col("total")).alias("total"),
            _money(F.col("average")).alias("average"),
            "records",
            "date_range",
            *[
                F.coalesce(F.col(m), empty).alias(m)
                for m in ("monthly", spec.top_key, "by_category")
            ],
        ).alias("section"),
    )


def business_summary(
    sales_cube: DataFrame, expense_cube: DataFrame, sales: LedgerSpec, expenses: LedgerSpec
) -> DataFrame:
    """``(user_id, sales, expenses, profit)`` from the cubes of both ledgers.

    A section is null for a tenant without such rows; profit needs both.
    """
    both = (
        ledger_section(sales_cube, sales)
        .withColumnRenamed("section", "sales")
        .join(
            ledger_section(expense_cube, expenses).withColumnRenamed("section", "expenses"),
            TENANT, "full_outer",
        )
    )
    result = metrics.profit_columns(F.col("sales.total"), F.col("expenses.total"))
    profit = F.struct(
        _money(result["gross_profit"]).alias("gross_profit"),
        result["profit_margin"].try_cast("decimal(38,1)").alias("profit_margin"),
    )
    has_both = F.col("sales").isNotNull() & F.col("expenses").isNotNull()
    return both.withColumn("profit", F.when(has_both, profit))


def summary_json(summary: DataFrame) -> DataFrame:
    """``(user_id, summary)`` with the document as indented JSON; absent sections are left out."""
    document = F.struct("sales", "expenses", "profit")
    return summary.select(TENANT, F.to_json(document, {"pretty": "true"}).alias("summary"))


def flatten_summary(summary: DataFrame, sales: LedgerSpec, expenses: LedgerSpec) -> DataFrame:
    """The summary as rows ``(user_id, section, item, position, key, value)`` in document order."""
    scalar = lambda section, item, value: F.array(
        F.struct(
            F.lit(section).alias("section"), F.lit(item).alias("item"), F.lit(1).alias("position"),
            F.lit("").alias("key"), value.cast("string").alias("value"),
        )
    )

    def entries(section: str, item: str) -> Column:
        pairs = F.map_entries(F.col(f"{section}.{item}"))
        return F.transform(
            pairs,
            lambda e, i: F.struct(
                F.lit(section).alias("section"), F.lit(item).alias("item"),
                (i + 1).alias("position"), e["key"].alias("key"),
                e["value"].cast("string").alias("value"),
            ),
        )

    parts = []
    for spec in (sales, expenses):
        section = spec.name
        parts += [
            scalar(section, i, F.col(f"{section}.{i}"))
            for i in ("total", "average", "records", "date_range")
        ]
        parts += [entries(section, i) for i in ("monthly", spec.top_key, "by_category")]
    parts += [scalar("profit", i, F.col(f"profit.{i}")) for i in ("gross_profit", "profit_margin")]
    present = [F.coalesce(p, F.array().cast(_LINES)) for p in parts]
    return summary.select(TENANT, F.inline(F.concat(*present))).filter(F.col("value").isNotNull())


_LINES = "array<struct<section:string,item:string,position:int,key:string,value:string>>"
