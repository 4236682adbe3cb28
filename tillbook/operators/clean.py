"""Header cleaning, conforming to the ledger schema, load-time cleaning and the listing."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillbook.functions import DATE_FORMATS, has_text, to_amount, to_day
from tillbook.functions.labels import CURRENCY
from tillbook.spec import TENANT, LedgerSpec


def normalize_columns(df: DataFrame) -> DataFrame:
    """Column names without line breaks and outer white space, in lower case.

    Raises ``ValueError`` when two names fall together.
    """
    names = [re.sub(r"[\r\n]", "", c).strip().lower() for c in df.columns]
    doubled = sorted(n for n, count in Counter(names).items() if count > 1)
    if doubled:
        raise ValueError(f"duplicate columns after normalising: {', '.join(doubled)}")
    return df.toDF(*names)


def conform(df: DataFrame, columns: Sequence[str], fill: str | None = None) -> DataFrame:
    """Select ``columns`` in order (after the tenant key, if present), adding missing ones."""
    keys = [TENANT] if TENANT in df.columns and TENANT not in columns else []
    filler = F.lit(fill).cast("string")
    return df.select(
        *keys, *[F.col(c) if c in df.columns else filler.alias(c) for c in columns]
    )


def clean_ledger(
    df: DataFrame,
    spec: LedgerSpec,
    amount: T.DataType | None = None,
    date_formats: Sequence[str] = DATE_FORMATS,
) -> DataFrame:
    """Load-time cleaning: typed amount and date, blank category for null, unusable rows dropped
    (no amount, blank party, no tenant).

    A numeric amount column keeps its type unless ``amount`` names one; text becomes DOUBLE.
    """
    table = conform(normalize_columns(df), spec.columns)
    kinds = {f.name: f.dataType for f in table.schema.fields}
    numeric = isinstance(kinds[spec.amount], T.NumericType)
    into = amount or (kinds[spec.amount] if numeric else T.DoubleType())
    usable = F.col(spec.amount).isNotNull() & has_text(F.col(spec.party))
    if TENANT in table.columns:
        usable = usable & F.col(TENANT).isNotNull()
    return table.withColumns(
        {
            "date": to_day(F.col("date"), kinds["date"], date_formats),
            spec.amount: to_amount(F.col(spec.amount), kinds[spec.amount], into),
            "category": F.coalesce(F.col("category").cast("string"), F.lit("")),
        }
    ).filter(usable)


def ledger_listing(
    ledger: DataFrame, spec: LedgerSpec, by: Sequence[str] = (TENANT,), headings: bool = False
) -> DataFrame:
    """Newest first, undated last: date as text, amount rounded to two places.

    ``headings`` gives the display names; the record id stays for later edits.
    """
    ordered = ledger.orderBy(*by, F.col("date").desc_nulls_last(), F.col("id").asc())
    rows = ordered.select(*by, *[c.alias(n) for n, c in listing_columns(spec).items()])
    return rows.withColumnsRenamed(listing_headings(spec)) if headings else rows


def listing_columns(spec: LedgerSpec) -> dict[str, Column]:
    return {
        "id": F.col("id"),
        "date": F.date_format("date", "yyyy-MM-dd"),
        spec.party: F.col(spec.party),
        spec.amount: F.bround(spec.amount, 2),
        "category": F.col("category"),
    }


def listing_headings(spec: LedgerSpec) -> dict[str, str]:
    return {
        "date": "Date",
        spec.party: spec.party.title(),
        spec.amount: f"{spec.amount.title()} ({CURRENCY})",
        "category": "Category",
    }
