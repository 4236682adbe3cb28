"""Small ledgers written in line."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from tillbook import EXPENSES, SALES, ledger_schema


def day(text: str | None) -> dt.date | None:
    return dt.date.fromisoformat(text) if text else None


def ledger(spark, rows, spec=SALES):
    """Rows of ``(tenant, date, party, amount[, category])`` as a stored ledger with made-up ids."""
    full = [
        (r[0], f"r{i}", day(r[1]), r[2], Decimal(str(r[3])), r[4] if len(r) > 4 else "")
        for i, r in enumerate(rows)
    ]
    return spark.createDataFrame(full, ledger_schema(spec))


def rows(df, *columns):
    """Collected rows as tuples of the named columns (default: all), decimals as floats."""
    names = columns or df.columns
    plain = lambda v: float(v) if isinstance(v, Decimal) else v
    return [tuple(plain(r[c]) for c in names) for r in df.collect()]


__all__ = ["EXPENSES", "SALES", "day", "ledger", "rows"]
