"""Sharding by sampled splitters: size-weighted samples, quantile boundaries, range partitions."""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillbook.llm.common import utf8_bytes
from tillbook.sources import write_and_read

ADDED = ("shard", "slot")


def copy_key(text: Column, doc_id: Column) -> Column:
    """A long that puts equal texts next to each other and spreads them by id within: the upper 40
    bits come from the text, the lower 24 from the id."""
    low = (1 << 24) - 1
    return F.xxhash64(text).bitwiseAND(~low).bitwiseOR(F.xxhash64(doc_id).bitwiseAND(low))


def shard_rows(
    df: DataFrame,
    key: Column,
    size: Column,
    shards: int = 40,
    ranges_per_shard: int = 16,
    range_bytes: int = 256 << 20,
    max_ranges: int = 50_000,
    samples: int = 20,
    seed: int = 7,
) -> DataFrame:
    """``df`` with ``shard`` (0 to ``shards`` - 1, bytes near equal) and ``slot`` (0, 1, ... within it).

    Rows are ordered by ``key`` (a long) and, among equal keys, by the place they are first written to.
    Splitters are quantiles of a sample in which a row's chance grows with its size; the sample has
    about ``samples`` rows per range and is the only thing besides one figure per range that comes to
    the driver, both bounded by ``max_ranges``. Ranges that come out overfull are sampled again and
    subdivided; as no two rows share key and place, one hot key divides too. Exact running sums inside
    the ranges then cut the order into shards: a row goes where its middle byte falls, so that a shard
    differs from the mean by at most the two rows at its ends.

    Sizes below 1 count as 1, a null size too. Columns of ``df`` named ``shard`` or ``slot`` are
    replaced. Shards stay empty if there are fewer rows than shards; an empty table stays empty.
    """
    spark = df.sparkSession
    kept = [c for c in df.columns if c.lower() not in ADDED]
    weight = F.greatest(F.coalesce(size, F.lit(1)), F.lit(1)).cast("bigint")
    rows = write_and_read(
        df.select(
            F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"),
            key.cast("bigint").alias("key"),
            weight.alias("size"),
            F.monotonically_increasing_id().alias("place"),
        ).withColumn("key", F.coalesce("key", F.lit(0)))
    )
    total = rows.agg(F.sum("size")).first()[0] or 0
    count = min(max_ranges, max(shards * ranges_per_shard, total // range_bytes))
    mean = max(total / count, 1.0)

    def sample(some: DataFrame) -> pd.DataFrame:
        chance = F.least(F.lit(1.0), F.col("size") * samples / F.lit(mean))
        lot = F.pmod(F.xxhash64(F.lit(seed), "key", "place"), F.lit(1 << 40)) / F.lit(float(1 << 40))
        drawn = some.filter(lot < chance).select("key", "place", "size").toPandas()
        return drawn.sort_values(["key", "place"], ignore_index=True)

    def quantiles(drawn: pd.DataFrame) -> list[tuple[int, int]]:
        """Splitters about a mean range apart; a sampled row stands for the bytes it was drawn by."""
        reach = np.maximum(drawn["size"].to_numpy(float), mean / samples).cumsum()
        ends = np.flatnonzero(np.diff(np.floor(reach / mean)) > 0)
        return list(zip(drawn["key"].iloc[ends].tolist(), drawn["place"].iloc[ends].tolist()))

    cuts, seen = sorted(set(quantiles(sample(rows)))), -1
    while True:
        ranged = rows.withColumn("range", _range_of(cuts)("key", "place"))
        stats = ranged.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
        stats = stats.toPandas().sort_values("range", ignore_index=True)
        over = stats.loc[(stats["bytes"] > 4 * mean) & (stats["n"] > 1), "range"].tolist()
        if not over or len(cuts) in (seen, max_ranges):
            break
        seen = len(cuts)
        cuts = sorted({*cuts, *quantiles(sample(ranged.filter(F.col("range").isin(over))))})[:max_ranges]

    stats["bytes_before"] = stats["bytes"].cumsum() - stats["bytes"]
    stats["rows_before"] = stats["n"].cumsum() - stats["n"]
    starts = spark.createDataFrame(
        stats[["range", "bytes_before", "rows_before"]].astype("int64"),
        "range bigint, bytes_before bigint, rows_before bigint",
    )
    order = Window.partitionBy("range").orderBy("key", "place")
    before = F.col("bytes_before") + F.sum("size").over(order) - F.col("size")

    def placed(some: DataFrame) -> DataFrame:
        joined = some.join(F.broadcast(starts), "range")  # one row per range, at most max_ranges
        at = F.col("rows_before") + F.row_number().over(order) - 1
        return joined.withColumn("at", at).withColumn("before", before).withColumn(
            "shard", F.floor((F.col("before") * 2 + F.col("size")) * F.lit(shards) / F.lit(2 * max(total, 1))).cast("int")
        )

    # Where shards begin: at a range, or inside one of the few ranges that reach over a boundary.
    first = {}
    spots = np.floor(stats["bytes_before"].to_numpy(float) * shards / max(total, 1))
    last = np.floor((stats["bytes_before"] + stats["bytes"]).to_numpy(float) * shards / max(total, 1))
    for shard, at in zip(spots[spots == last].astype(int), stats["rows_before"][spots == last]):
        first[shard] = min(first.get(shard, at), at)
    cut = stats.loc[spots != last, "range"].tolist()
    if cut:
        inside = placed(ranged.filter(F.col("range").isin(cut)).drop("row"))
        for shard, at in inside.groupBy("shard").agg(F.min("at")).collect():  # at most one row per shard
            first[shard] = min(first.get(shard, at), at)
    begin = spark.createDataFrame([(int(s), int(a)) for s, a in first.items()], "shard int, begin bigint")
    done = placed(ranged).join(F.broadcast(begin), "shard")  # one row per shard
    return done.select("row.*", "shard", (F.col("at") - F.col("begin")).alias("slot"))


def _range_of(cuts: list[tuple[int, int]]):
    """Column function (key, place) -> number of splitters before it; splitters end their range."""
    keys = np.array([k for k, _ in cuts], dtype=np.int64)

    @F.pandas_udf("bigint")
    def find(key: pd.Series, place: pd.Series) -> pd.Series:
        k = key.to_numpy(np.int64)
        low, high = np.searchsorted(keys, k, "left"), np.searchsorted(keys, k, "right")
        for i in np.flatnonzero(low != high):
            low[i] = bisect_right(cuts, (int(k[i]), int(place.iat[i]) - 1))
        return pd.Series(low)

    return find


def shard_documents(docs: DataFrame, shards: int = 40, **options) -> DataFrame:
    """``docs`` in shards of near equal bytes (UTF-8 text plus 16 a row), equal texts side by side."""
    key = copy_key(F.col("text"), F.col("doc_id"))
    return shard_rows(docs, key, utf8_bytes(F.col("text")) + 16, shards, **options)
