"""Pages of a stored ledger's listing by an index of counts, without sorting the ledger.

Per version of a store and tenant, the listing order (newest first, undated last, then by id) is cut
into buckets of bounded rows. A bucket knows how many rows come before it and its first and last place
in the order. A page lies in the buckets whose counts reach it, two at most if it is no longer than a
bucket, and only these are read and ranked.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillbook.operators.clean import listing_columns
from tillbook.shared import write_and_read
from tillbook.sources.snapshots import Store, names_in, read_store, rename_new, version_changes, version_of
from tillbook.spec import BY, TENANT

#: Rows of a bucket.
BUCKET_ROWS = 50_000

_PLACE = "struct<undated:int,day:int,id:string>"
INDEX = f"{TENANT} string, before bigint, n bigint, low {_PLACE}, high {_PLACE}"


def place() -> Column:
    """A row's place in the listing order, as a value that sorts so: newest first, undated last, by id."""
    undated = F.col("date").isNull().cast("int").alias("undated")
    day = F.coalesce(-F.unix_date("date"), F.lit(0)).alias("day")
    return F.struct(undated, day, F.col("id").alias("id"))


def _buckets(rows: DataFrame, size: int) -> DataFrame:
    """The index of some tenants' rows. Only keys are sorted, in range partitions; counts per partition
    give the places at which each of them begins, so no tenant is counted in one task."""
    keys = rows.select(TENANT, place().alias("place"))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = keys.repartitionByRange(parts, TENANT, "place").withColumn("part", F.spark_partition_id())
    dealt = write_and_read(dealt)
    counts = dealt.groupBy(TENANT, "part").agg(F.count("*").alias("many"))
    earlier = Window.partitionBy(TENANT).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    begins = counts.select(TENANT, "part", F.coalesce(F.sum("many").over(earlier), F.lit(0)).alias("begins"))
    within = F.row_number().over(Window.partitionBy(TENANT, "part").orderBy("place"))
    cut = dealt.withColumn("piece", F.floor((within - 1) / size))
    pieces = cut.groupBy(TENANT, "part", "piece").agg(
        F.count("*").alias("n"), F.min("place").alias("low"), F.max("place").alias("high")
    )
    before = F.col("begins") + F.col("piece") * size
    return pieces.join(begins, [TENANT, "part"]).select(TENANT, before.alias("before"), "n", "low", "high")


def _index_path(store: Store, number: int) -> str:
    return f"{store.path}/pages/{number:020d}"


def page_index(spark: SparkSession, store: Store, number: int | None = None, size: int = BUCKET_ROWS) -> DataFrame:
    """The index of a version, stored beside it when it is first asked for.

    Where an earlier version has one, only tenants with changed files are sorted again. The index becomes
    visible by one rename; of two jobs that make it at a time, one does.
    """
    version = version_of(spark, store, number)
    if version is None:
        return spark.createDataFrame([], INDEX)
    path = _index_path(store, version.number)
    indexed = [int(name) for name in names_in(spark, f"{store.path}/pages")]
    if version.number not in indexed:
        earlier = max((n for n in indexed if n < version.number), default=None)
        if earlier is None:
            index = _buckets(read_store(spark, store, version=version.number), size)
        else:
            # Tenants without rows in files that only one of the versions has did not change.
            removed, added = version_changes(spark, store, earlier, version.number)
            changed = write_and_read(removed.select(TENANT).union(added.select(TENANT)).distinct())
            kept = spark.read.schema(INDEX).parquet(_index_path(store, earlier)).join(changed, TENANT, "left_anti")
            rows = read_store(spark, store, changed, version=version.number)
            index = kept.unionByName(_buckets(rows, size))
        staged = f"{store.path}/staged/{uuid.uuid4().hex}"
        index.repartitionByRange(TENANT, "before").sortWithinPartitions(TENANT, "before").write.parquet(staged)
        rename_new(spark, *map(spark._jvm.org.apache.hadoop.fs.Path, (staged, path)))
    return spark.read.schema(INDEX).parquet(path)


def _day(place_day: int) -> dt.date:
    return dt.date(1970, 1, 1) - dt.timedelta(days=place_day)


def list_page_indexed(
    spark: SparkSession,
    store: Store,
    page: int = 1,
    size: int = 10,
    tenants: Iterable[str] | None = None,
    number: int | None = None,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Page ``page`` (from 1) of each tenant's listing, newest first, as :func:`list_page` gives it, from the
    buckets that hold the page. With a list of tenants their buckets' days are pushed down, so that other
    files and row groups are not read; without, all tenants' buckets are looked up by a join.
    """
    first, last = (page - 1) * size + 1, page * size
    index = page_index(spark, store, number, bucket_rows)
    wanted = index.filter((F.col("before") < last) & (F.col("before") + F.col("n") >= first))
    version = version_of(spark, store, number)
    number = version.number if version else None
    if tenants is None or version is None:
        rows = read_store(spark, store, version=number)
    else:
        listed = list(tenants)
        wanted = wanted.filter(F.col(TENANT).isin(listed))
        places = wanted.select("low", "high").collect()  # two buckets of each listed tenant
        rows = _near_rows(spark, store, listed, places, number)
    named = wanted.select(F.col(TENANT).alias("_tenant"), "before", "low", "high")
    inside = (F.col(TENANT) == F.col("_tenant")) & place().between(F.col("low"), F.col("high"))
    found = rows.join(named, inside)
    within = F.row_number().over(Window.partitionBy(TENANT, "before").orderBy(F.col("date").desc_nulls_last(), "id"))
    ranked = found.withColumn("position", (F.col("before") + within).cast("int"))
    columns = [c.alias(n) for n, c in listing_columns(store.spec).items()]
    return ranked.filter(F.col("position").between(first, last)).select(*BY, "position", *columns).orderBy(*BY, "position")


def _near_rows(spark: SparkSession, store: Store, tenants: list[str], places: list, number: int) -> DataFrame:
    """Rows of some tenants on the days that their buckets span."""
    dated = [p for p in places if not p["low"]["undated"]]
    empty = read_store(spark, store, tenants, version=number).filter(F.col("date").isNull())
    undated = any(p["high"]["undated"] for p in places)
    if not dated:
        return empty
    latest = _day(min(p["low"]["day"] for p in dated))
    # A bucket that ends among undated rows begins on some day and holds all earlier ones.
    earliest = None if undated else _day(max(p["high"]["day"] for p in dated))
    rows = read_store(spark, store, tenants, earliest, latest, version=number)
    return rows.unionByName(empty) if undated else rows
