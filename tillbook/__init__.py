"""Multi-tenant sales and expense ledger analytics, written as Spark DataFrame expressions."""

from tillbook.spec import BY, EXPENSES, SALES, LedgerSpec, ledger_schema

__all__ = ["BY", "EXPENSES", "SALES", "LedgerSpec", "ledger_schema"]
