"""One pass over a ledger that serves every roll-up.

A dashboard or summary needs totals by day, party, month and category. Computed apart, each would
scan the ledger and repeat whatever joins produce it. The cube computes three grains in one scan
and one shuffle of pre-aggregated lines; everything else derives from its far smaller result. Write
it once (:func:`tillbook.sources.write_and_read`, partitioned by ``grain``), then read a grain.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillbook.operators.metrics import record_count
from tillbook.spec import BY, LedgerSpec

DAY, PARTY, CATEGORY = "day", "party", "category"


def ledger_cube(ledger: DataFrame, spec: LedgerSpec, by: Sequence[str] = BY) -> DataFrame:
    """Sums and record counts by ``day``, by ``party`` and month, and by ``category``.

    Columns outside a grain are null; the party grain's ``date`` is the first of its month.
    """
    month = F.trunc("date", "MM")
    rows = ledger.withColumn("_month", month)
    grains = [[*by, "date"], [*by, spec.party, "_month"], [*by, "category"]]
    keys = [*by, "date", spec.party, "_month", "category"]
    sums = rows.groupingSets(grains, *keys).agg(
        F.grouping("date").alias("_no_day"),
        F.grouping("category").alias("_no_category"),
        F.sum(spec.amount).alias("_sum"),
        record_count(ledger).alias("records"),
    )
    grain = (
        F.when(F.col("_no_day") == 0, DAY).when(F.col("_no_category") == 0, CATEGORY).otherwise(PARTY)
    )
    return sums.select(
        *by,
        grain.alias("grain"),
        F.coalesce("date", "_month").alias("date"),
        spec.party,
        "category",
        F.col("_sum").alias(spec.amount),
        "records",
    )


def refresh_cube(
    cube: DataFrame, removed: DataFrame, added: DataFrame, spec: LedgerSpec, by: Sequence[str] = BY
) -> DataFrame:
    """The cube of a changed ledger from the cube before and the rows that were removed and added (see
    :func:`tillbook.sources.version_changes`); the other rows are not read.

    Sums and counts take signed additions, so that rows in both sets cancel out; a group without records
    left is dropped. Groups that no changed row belongs to pass by unchanged.
    """
    minus = removed.withColumns({spec.amount: -F.col(spec.amount), "records": F.lit(-1).cast("bigint")})
    plus = added.withColumn("records", F.lit(1).cast("bigint"))
    delta = ledger_cube(minus.unionByName(plus), spec, by)
    keys = [*by, "grain", "date", spec.party, "category"]
    kinds = {f.name: f.dataType for f in cube.schema.fields}
    merged = cube.unionByName(delta.select(*cube.columns)).groupBy(*keys).agg(
        F.sum(spec.amount).cast(kinds[spec.amount]).alias(spec.amount), F.sum("records").cast("bigint").alias("records")
    )
    return merged.filter("records > 0").select(*cube.columns)


def cube_grain(cube: DataFrame, grain: str) -> DataFrame:
    """One grain of the cube as a pre-aggregated ledger."""
    return cube.filter(F.col("grain") == grain).drop("grain")
