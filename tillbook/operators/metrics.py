"""Totals, rankings, shares and roll-ups of a ledger.

Every operator also takes a pre-aggregated ledger: when a ``records`` column is present it counts
the rows behind each line (see ``tillbook.plans.cube``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillbook.operators.ranking import join_by_key, rank_slice
from tillbook.spec import BY, LedgerSpec

NO_MONTH = "NaT"  # Fixed value: month text of rows without a date.


def record_count(df: DataFrame) -> Column:
    return F.sum("records") if "records" in df.columns else F.count(F.lit(1))


def mean(total: Column, records: Column) -> Column:
    return total.cast("double") / records


def _grouped(df: DataFrame, by: Sequence[str], **aggregates: Column) -> DataFrame:
    """``groupBy`` whose global form gives no row, instead of one of nulls, on empty input."""
    out = df.groupBy(*by).agg(
        *[c.alias(n) for n, c in aggregates.items()], record_count(df).alias("records")
    )
    return out if by else out.filter(F.col("records") > 0)


def kpis(ledger: DataFrame, spec: LedgerSpec, by: Sequence[str] = BY) -> DataFrame:
    """Total, average, distinct parties and records per key."""
    sums = _grouped(
        ledger, by, total=F.sum(spec.amount), parties=F.count_distinct(F.col(spec.party))
    )
    average = mean(F.col("total"), F.col("records"))
    return sums.select(*by, "total", average.alias("average"), "parties", "records")


def filter_options(ledger: DataFrame, spec: LedgerSpec, by: Sequence[str] = BY) -> DataFrame:
    """Choices of the filter bar as rows ``(option, value)``: parties, non-blank categories, and the
    first and last day. One scan feeds all of them; a key with many parties gives many rows rather
    than one large array.
    """
    grain = F.grouping_id()
    keys = [*by, spec.party, "category"]
    sets = ledger.groupingSets([[*by, spec.party], [*by, "category"], [*by]], *keys).agg(
        grain.alias("_grain"), F.min("date").alias("_first"), F.max("date").alias("_last")
    )
    # grouping_id counts the left-out columns in binary: category only, party only, both.
    pair = lambda option, value: F.struct(F.lit(option).alias("option"), value.alias("value"))
    options = (
        F.when(F.col("_grain") == 1, F.array(pair("party", F.col(spec.party))))
        .when(F.col("_grain") == 2, F.array(pair("category", F.col("category"))))
        .otherwise(
            F.array(
                pair("start_date", F.date_format("_first", "yyyy-MM-dd")),
                pair("end_date", F.date_format("_last", "yyyy-MM-dd")),
            )
        )
    )
    return (
        sets.select(*by, F.inline(options))
        .filter(F.col("value").isNotNull() & (F.col("value") != ""))
        .orderBy(*by, "option", "value")
    )


def daily_totals(ledger: DataFrame, spec: LedgerSpec, by: Sequence[str] = BY) -> DataFrame:
    dated = ledger.filter(F.col("date").isNotNull())
    return dated.groupBy(*by, "date").agg(F.sum(spec.amount).alias("total")).orderBy(*by, "date")


def party_totals(ledger: DataFrame, spec: LedgerSpec, by: Sequence[str] = BY) -> DataFrame:
    named = ledger.filter(F.col(spec.party).isNotNull())
    return named.groupBy(*by, spec.party).agg(F.sum(spec.amount).alias("total"))


def _top(totals: DataFrame, spec: LedgerSpec, by: Sequence[str], n: int) -> DataFrame:
    order = [F.col("total").desc(), F.col(spec.party).asc()]
    return rank_slice(totals, by, order, n).select(*by, "rank", spec.party, "total")


def top_parties(
    ledger: DataFrame, spec: LedgerSpec, by: Sequence[str] = BY, n: int = 10, ordered: bool = True
) -> DataFrame:
    """Largest ``n`` parties per key by total; equal totals rank by name. Plans that go on with the
    rows take them not ``ordered``, here and below, and save a sort of the whole result.
    """
    top = _top(party_totals(ledger, spec, by), spec, by, n)
    return top.orderBy(*by, "rank") if ordered else top


def party_share(
    ledger: DataFrame, spec: LedgerSpec, by: Sequence[str] = BY, n: int = 10, base: str = "top"
) -> DataFrame:
    """Top parties with their percentage of ``base_total``: the kept rows (``base="top"``) or the
    whole ledger (``base="all"``).
    """
    totals = party_totals(ledger, spec, by)
    top = _top(totals, spec, by, n)
    # At most n rows per key are left, so summing them again is free of skew.
    whole = (top if base == "top" else totals).groupBy(*by).agg(F.sum("total").alias("base_total"))
    percent = F.try_divide(F.col("total").cast("double"), F.col("base_total").cast("double")) * 100
    return (
        join_by_key(top, whole, by, ["rank"], salts=1)
        .select(*by, "rank", spec.party, "total", "base_total", percent.alias("percent"))
        .orderBy(*by, "rank")
    )


def weekday_heatmap(
    ledger: DataFrame,
    spec: LedgerSpec,
    by: Sequence[str] = BY,
    by_iso_year: bool = False,
    wide: bool = False,
) -> DataFrame:
    """Totals per ISO week and weekday (0 = Monday), dense over the weeks that occur.

    The seven weekday sums are columns of one aggregate, so missing cells need no grid join.
    Weeks of different years add up unless ``by_iso_year``.
    """
    day = F.col("date")
    week = {"week": F.weekofyear(day)}
    if by_iso_year:
        week = {"iso_year": F.extract(F.lit("YEAROFWEEK"), day), **week}
    keys = [*by, *week]
    sums = (
        ledger.filter(day.isNotNull() & F.col(spec.amount).isNotNull())
        .select(*by, *[c.alias(n) for n, c in week.items()], F.weekday(day).alias("_dow"), spec.amount)
        .groupBy(*keys)
        .agg(
            *[
                F.coalesce(F.sum(F.when(F.col("_dow") == d, F.col(spec.amount))), F.lit(0)).alias(
                    f"d{d}"
                )
                for d in range(7)
            ]
        )
    )
    if wide:
        return sums.orderBy(*keys)
    cells = F.array(
        *[F.struct(F.lit(d).alias("dow"), F.col(f"d{d}").alias("total")) for d in range(7)]
    )
    return sums.select(*keys, F.inline(cells)).orderBy(*keys, "dow")


def monthly_totals(
    ledger: DataFrame,
    spec: LedgerSpec,
    by: Sequence[str] = BY,
    last: int = 6,
    drop_null_month: bool = False,
    ordered: bool = True,
) -> DataFrame:
    """Totals of the last ``last`` months that occur. Undated rows form month ``NaT``, which sorts
    last and takes a slot, unless ``drop_null_month``.
    """
    rows = ledger.filter(F.col("date").isNotNull()) if drop_null_month else ledger
    month = F.coalesce(F.date_format("date", "yyyy-MM"), F.lit(NO_MONTH))
    totals = rows.groupBy(*by, month.alias("month")).agg(F.sum(spec.amount).alias("total"))
    kept = rank_slice(totals, by, [F.col("month").desc()], last)
    kept = kept.select(*by, "month", "total")
    return kept.orderBy(*by, "month") if ordered else kept


def category_totals(
    ledger: DataFrame, spec: LedgerSpec, by: Sequence[str] = BY, ordered: bool = True
) -> DataFrame:
    """Totals per category, largest first; keys whose categories are all blank give no rows."""
    totals = ledger.groupBy(*by, "category").agg(F.sum(spec.amount).alias("total"))
    # Counting totals as well keeps both uses on one shuffle of the ledger.
    named = (
        totals.groupBy(*by)
        .agg(F.max(F.col("category") != "").alias("_named"), F.count("total").alias("_n"))
        .filter(F.col("_named") & (F.col("_n") > 0))
        .select(*by)
    )
    kept = join_by_key(totals.filter(F.col("category").isNotNull()), named, by, ["category"])
    kept = kept.select(*by, "category", "total")
    return kept.orderBy(*by, F.col("total").desc(), F.col("category").asc()) if ordered else kept


def ledger_totals(ledger: DataFrame, spec: LedgerSpec, by: Sequence[str] = BY) -> DataFrame:
    """Total, average, records, first and last day, and the two days as text."""
    sums = _grouped(
        ledger, by,
        total=F.sum(spec.amount), first_date=F.min("date"), last_date=F.max("date"),
    )
    span = F.concat(
        F.date_format("first_date", "yyyy-MM-dd"), F.lit(" to "),
        F.date_format("last_date", "yyyy-MM-dd"),
    )
    return sums.select(
        *by, "total", mean(F.col("total"), F.col("records")).alias("average"), "records",
        "first_date", "last_date", span.alias("date_range"),
    )


def profit_columns(sales_total: Column, expense_total: Column) -> dict[str, Column]:
    """Profit and margin from totals already rounded to two places."""
    income, cost = sales_total.cast("double"), expense_total.cast("double")
    margin = F.bround((income - cost) / F.nullif(income, F.lit(0.0)) * 100, 1)
    return {
        "gross_profit": F.bround(income - cost, 2),
        "profit_margin": F.when(income == 0, F.lit(0.0)).otherwise(margin),
    }


def profit(
    sales: DataFrame,
    expenses: DataFrame,
    sales_spec: LedgerSpec,
    expense_spec: LedgerSpec,
    by: Sequence[str] = BY,
) -> DataFrame:
    """Gross profit and margin of the keys present in both ledgers."""
    def total(df: DataFrame, spec: LedgerSpec, name: str) -> DataFrame:
        sums = _grouped(df, by, total=F.sum(spec.amount))
        return sums.select(*by, F.bround("total", 2).alias(name))

    left = total(sales, sales_spec, "sales_total")
    right = total(expenses, expense_spec, "expense_total")
    # One row per key on both sides; without keys each side is a single row.
    both = join_by_key(left, right, by, ["sales_total"], salts=1)
    columns = profit_columns(F.col("sales_total"), F.col("expense_total"))
    return both.select(
        *by, "sales_total", "expense_total", *[c.alias(n) for n, c in columns.items()]
    )
