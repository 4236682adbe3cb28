"""What a ledger looks like. Sales and expenses differ in two column names and a few labels."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

TENANT = "user_id"
BY = (TENANT,)
KEY = (TENANT, "id")


@dataclass(frozen=True)
class LedgerSpec:
    """Names that turn the shared operators into sales or expense operators."""

    name: str
    party: str
    amount: str
    top_key: str
    goal_kind: str

    @property
    def columns(self) -> tuple[str, ...]:
        """Stored ledger columns after the tenant key, in order."""
        return ("id", "date", self.party, self.amount, "category")

    @property
    def upload_columns(self) -> tuple[str, ...]:
        """Columns looked for in an uploaded file."""
        return ("date", self.party, self.amount, "category")


SALES = LedgerSpec("sales", "product", "sales", "top_products", "target")
EXPENSES = LedgerSpec("expenses", "vendor", "amount", "top_vendors", "budget")


def ledger_schema(spec: LedgerSpec, amount: T.DataType | None = None) -> T.StructType:
    """Schema of a stored ledger; ``amount`` may be DOUBLE or a DECIMAL (default DECIMAL(18,2))."""
    return T.StructType(
        [
            T.StructField(TENANT, T.StringType()),
            T.StructField("id", T.StringType()),
            T.StructField("date", T.DateType()),
            T.StructField(spec.party, T.StringType()),
            T.StructField(spec.amount, amount or T.DecimalType(18, 2)),
            T.StructField("category", T.StringType()),
        ]
    )
