"""Two building blocks that keep a hot key off a single task: ranking and per-key lookup."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillbook.shared import write_and_read

SALTS = 1


def join_by_key(
    rows: DataFrame,
    per_key: DataFrame,
    by: Sequence[str],
    spread: Sequence[str],
    how: str = "inner",
    salts: int = SALTS,
) -> DataFrame:
    """Attach ``per_key`` (one row per ``by``, never null) to ``rows``.

    The join key carries a salt, so that a later grouping by tenant does not inherit the join's layout
    and AQE may split a hot tenant. More ``salts`` (a power of two) spread one tenant's rows by a hash
    of the ``spread`` columns, at the price of as many copies of ``per_key``. Nothing is hinted: AQE
    turns the join into a broadcast when the measured size allows. ``by=[]`` joins on the salt alone.
    """
    # A masked hash is never null. A nullable salt would draw a null filter through the aggregate
    # below ``rows`` and so keep it from sharing a shuffle with the one below ``per_key``.
    salted = rows.withColumn("_salt", F.xxhash64(*spread).bitwiseAND(salts - 1))
    copies = per_key.withColumn(
        "_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint")))
    )
    return salted.join(copies, [*by, "_salt"], how).drop("_salt")


def keep_by_key(
    rows: DataFrame, keys: DataFrame, by: Sequence[str], matching: bool = True
) -> DataFrame:
    """``rows`` whose ``by`` value is (or is not) among ``keys``; a hot value is spread as above."""
    how = "left_semi" if matching else "left_anti"
    return join_by_key(rows, keys.select(*by), by, list(by), how).select(*rows.columns)


def number_rows(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """``df`` with the BIGINT position 1, 2, ... of each row in ``order``, without one task sorting all.

    Rows are range-partitioned and written once with their bucket (a recomputed range partitioning
    might cut elsewhere); counts per bucket, one row each, give the offsets.
    """
    buckets = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(buckets, *order).withColumn("_bucket", F.spark_partition_id())
    dealt = write_and_read(dealt)
    counts = dealt.groupBy("_bucket").agg(F.count("*").alias("_n"))
    running = F.sum("_n").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("_bucket", F.coalesce(running, F.lit(0)).alias("_start"))
    within = F.row_number().over(Window.partitionBy("_bucket").orderBy(*order))
    numbered = dealt.join(F.broadcast(starts), "_bucket")  # one row per bucket
    return numbered.withColumn(name, F.col("_start") + within).select(*df.columns, name)


def rank_slice(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[Column],
    last: int,
    first: int = 1,
    rank: str = "rank",
) -> DataFrame:
    """Rows ranked ``first``..``last`` within each ``by`` group (a null key is a group too);
    ``order`` must be a total order.

    Below the group-limit threshold of the session Spark drops rows ranked past ``last`` in every
    task before the shuffle. Deeper slices take positions from one distributed sort instead of
    gathering a group in one task. Both give the same rows.
    """
    threshold = int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold"))
    if last >= threshold:
        return _deep_slice(df, by, order, last, first, rank)
    if not by:
        df = df.orderBy(*order).limit(last)
    position = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    ranked = df.withColumn(rank, position).filter(F.col(rank) <= last)
    return ranked.filter(F.col(rank) >= first) if first > 1 else ranked


def _deep_slice(
    df: DataFrame, by: Sequence[str], order: Sequence[Column], last: int, first: int, rank: str
) -> DataFrame:
    """The rows are written once, range-partitioned by key and order. Counts per key and bucket tell
    which buckets the slice lies in; only those are ranked.
    """
    buckets = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(buckets, *map(F.col, by), *order)
    dealt = write_and_read(dealt.withColumn("_bucket", F.spark_partition_id()))
    counts = dealt.groupBy(*by, "_bucket").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    before = before.filter((F.col("_before") < last) & (F.col("_before") + F.col("_n") >= first))
    before = before.select(*[F.col(c).alias(f"_{i}") for i, c in enumerate(by)], F.col("_bucket").alias("_b"), "_before")
    same = F.col("_bucket") == F.col("_b")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_{i}"))
    within = F.row_number().over(Window.partitionBy(*by, "_bucket").orderBy(*order))
    position = F.col("_before") + within
    kept = dealt.join(before, same).withColumn("_at", position).filter(F.col("_at").between(first, last))
    return kept.withColumn(rank, F.col("_at").cast("int")).select(*df.columns, rank)
