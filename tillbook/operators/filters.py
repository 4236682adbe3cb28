"""Row selection: the four dashboard filters, the prior window and listing pages."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillbook.operators.clean import listing_columns
from tillbook.operators.ranking import join_by_key, keep_by_key, rank_slice
from tillbook.spec import BY, LedgerSpec

Day = dt.date | str | None
Choice = Iterable[str] | DataFrame | None


def as_day(value: Day) -> dt.date | None:
    """A date from a date or ISO text; empty means not set."""
    if not value:
        return None
    return dt.date.fromisoformat(value) if isinstance(value, str) else value


def selection(
    spec: LedgerSpec,
    start: Day = None,
    end: Day = None,
    parties: Iterable[str] | None = None,
    categories: Iterable[str] | None = None,
) -> Column:
    """Predicate of the given filters; an empty list means no filter. Both days are inclusive."""
    terms = [F.lit(True)]
    if as_day(start):
        terms.append(F.col("date") >= F.lit(as_day(start)))
    if as_day(end):
        terms.append(F.col("date") <= F.lit(as_day(end)))
    for column, values in ((spec.party, list(parties or [])), ("category", list(categories or []))):
        if values:
            terms.append(F.col(column).isin(values))
    predicate = terms[0] if len(terms) == 1 else terms[1]
    for term in terms[2:]:
        predicate = predicate & term
    return predicate


def filter_ledger(
    ledger: DataFrame,
    spec: LedgerSpec,
    start: Day = None,
    end: Day = None,
    parties: Choice = None,
    categories: Choice = None,
) -> DataFrame:
    """Rows passing every given filter. Long selections may come as one-column DataFrames."""
    tables = {}
    if isinstance(parties, DataFrame):
        tables[spec.party], parties = parties, None
    if isinstance(categories, DataFrame):
        tables["category"], categories = categories, None
    rows = ledger.filter(selection(spec, start, end, parties, categories))
    for column, table in tables.items():
        rows = keep_by_key(rows, table.toDF(column), [column])
    return rows


def prior_rows(
    ledger: DataFrame,
    bounds: DataFrame,
    spec: LedgerSpec,
    by: Sequence[str] = BY,
    first: Day = None,
    last: Day = None,
) -> DataFrame:
    """Ledger rows inside each key's prior window (``prior_start``..``prior_end``). Days outside
    ``first``..``last``, where given, are known to lie in no window and are not read.
    """
    window = bounds.select(*by, "prior_start", "prior_end")
    dated = ledger.filter(F.col("date").isNotNull())
    for day, keep in ((as_day(first), "__ge__"), (as_day(last), "__le__")):
        if day:
            dated = dated.filter(getattr(F.col("date"), keep)(F.lit(day)))
    return (
        join_by_key(dated, window, by, [c for c in ("id", "date") if c in ledger.columns])
        .filter(F.col("date").between(F.col("prior_start"), F.col("prior_end")))
        .select(*ledger.columns)
    )


def list_page(
    ledger: DataFrame,
    spec: LedgerSpec,
    page: int = 1,
    size: int = 10,
    where: Column | None = None,
    order: Sequence[Column] | None = None,
    by: Sequence[str] = BY,
) -> DataFrame:
    """Page ``page`` (from 1) of each key's listing, after a column filter and a column sort.

    The default order is newest first; ``id`` closes any order, so pages never overlap.
    """
    rows = ledger if where is None else ledger.filter(where)
    order = [*(order or [F.col("date").desc_nulls_last()]), F.col("id").asc()]
    sliced = rank_slice(rows, by, order, page * size, (page - 1) * size + 1, "position")
    return sliced.select(
        *by, "position", *[c.alias(n) for n, c in listing_columns(spec).items()]
    ).orderBy(*by, "position")
