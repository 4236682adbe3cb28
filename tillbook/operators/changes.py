"""Record-level changes as set operations: the ledger is scanned once and never moved as a whole
unless the change set is too large to broadcast, in which case both sides meet by record key.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillbook.operators.ranking import keep_by_key
from tillbook.spec import BY, KEY, TENANT, LedgerSpec


def _ledger_types(df: DataFrame, ledger: DataFrame) -> DataFrame:
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in ledger.schema.fields])


def append_rows(ledger: DataFrame, new: DataFrame, tenant: str | None = None) -> DataFrame:
    """Ledger plus new rows, for one tenant or for the tenants named in ``new``.

    Rows without an ``id`` column get a random one; a missing category becomes blank.
    """
    if tenant is not None:
        new = new.withColumn(TENANT, F.lit(tenant))
    if "id" not in new.columns:
        new = new.withColumn("id", F.uuid())
    category = F.col("category") if "category" in new.columns else F.lit(None).cast("string")
    new = new.withColumn("category", F.coalesce(category, F.lit("")))
    return ledger.unionByName(_ledger_types(new, ledger))


def clear_tenant(ledger: DataFrame, tenants: Iterable[str] | DataFrame) -> DataFrame:
    """Ledger without the given tenants."""
    if isinstance(tenants, DataFrame):
        return keep_by_key(ledger, tenants, BY, matching=False)
    return ledger.filter(~F.col(TENANT).isin(list(tenants)))


def apply_deletes(ledger: DataFrame, keys: DataFrame) -> DataFrame:
    """Ledger without the records named by ``(user_id, id)``."""
    return ledger.join(keys.select(*KEY), list(KEY), "left_anti")


def _last_given(fields: Iterable[str], seq: Column | None) -> list[Column]:
    """Per field, the value of the last change that gives one (null: none does)."""
    if seq is None:
        return [F.any_value(c, F.lit(True)).alias(c) for c in fields]
    return [F.max_by(c, F.when(F.col(c).isNotNull(), seq)).alias(c) for c in fields]


def _overlaid(ledger: DataFrame, fields: Iterable[str]) -> list[Column]:
    """The ledger's columns with the fields of ``_new`` laid over them."""
    types = {f.name: f.dataType for f in ledger.schema.fields}
    laid = {c: F.coalesce(F.col(f"_new.{c}").cast(types[c]), F.col(c)).alias(c) for c in fields}
    return [laid.get(c, F.col(c)) for c in ledger.columns]


def apply_updates(ledger: DataFrame, updates: DataFrame, spec: LedgerSpec) -> DataFrame:
    """Ledger with records replaced field by field; a null field keeps its old value.

    Several updates of one record need a ``seq`` column: per field, the last one that gives it wins.
    Unknown records are ignored.
    """
    fields = [c for c in spec.columns if c != "id" and c in updates.columns]
    seq = F.col("seq") if "seq" in updates.columns else None
    latest = updates.groupBy(*KEY).agg(*_last_given(fields, seq)).select(*KEY, F.struct(*fields).alias("_new"))
    return ledger.join(latest, list(KEY), "left").select(*_overlaid(ledger, fields))


def apply_changes(ledger: DataFrame, changes: DataFrame, spec: LedgerSpec) -> DataFrame:
    """Ledger after an ordered change set with ``op`` (insert, update, delete) and ``seq``.

    Per record the last insert or delete decides whether it exists. Its fields come from that insert
    or from the ledger, and each later update lays the fields it gives over them; a null field keeps
    the old value. Updates of a record that does not exist do nothing, an inserted null category
    becomes blank, and records of other tenants are never touched. ``seq`` is unique per record.
    """
    fields = [c for c in spec.columns if c != "id"]
    op, seq = F.col("op"), F.col("seq")
    resets = op.isin("insert", "delete")
    last = F.max(F.when(resets, seq)).over(Window.partitionBy(*KEY))
    valid = changes.withColumn("_reset", last).filter(F.col("_reset").isNull() | (seq >= F.col("_reset")))
    final = valid.groupBy(*KEY).agg(
        F.max("_reset").isNotNull().alias("_touched"),
        F.bool_or(op == "insert").alias("_born"),
        *_last_given(fields, seq),
    )
    final = final.select(*KEY, "_touched", "_born", F.struct(*fields).alias("_new"))
    kept = ledger.join(final, list(KEY), "left").filter(~F.coalesce("_touched", F.lit(False)))
    inserted = final.filter("_born").select(*KEY, "_new.*")
    inserted = inserted.withColumn("category", F.coalesce("category", F.lit("")))
    return kept.select(*_overlaid(ledger, fields)).unionByName(_ledger_types(inserted, ledger))
