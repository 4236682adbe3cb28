"""Mixing sources to target weights: repetition rates per source, then whole copies per document."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillbook.llm.common import word_count
from tillbook.operators.ranking import number_rows
from tillbook.sources import write_and_read


def source_targets(
    sizes: DataFrame,
    weights: Sequence[int] = (3, 1, 2),
    share: Fraction = Fraction(3, 2),
    most: int = 2,
) -> DataFrame:
    """Target of each source, from ``sizes(source, size)`` with any number of rows per source.

    Sources in code point order, null last, take ``weights`` in turn and share ``share`` times all
    sizes. No target exceeds ``most`` times its source's size; what that cuts off is shared again by
    weight among the rest, until none is above. All decisions compare whole numbers. Only sums come to
    the driver; a round costs one aggregation over the sources, each round stops at least one source.
    Returns ``(source, source_size, target)``. A source without any words has the target 0.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    placed = number_rows(totals, [F.col("source").asc_nulls_last()], "_at")
    turn = F.element_at(F.array(*[F.lit(w) for w in weights]), F.pmod(F.col("_at") - 1, len(weights)).cast("int") + 1)
    placed = write_and_read(placed.select("source", "source_size", turn.cast("bigint").alias("weight")))
    everything = placed.agg(F.sum("source_size")).first()[0] or 0

    full, stopped = F.lit(False), -1
    while True:
        row = placed.agg(
            F.count_if(full).alias("n"),
            F.sum(F.when(full, F.col("source_size"))).alias("size"),
            F.sum(F.when(~full, F.col("weight"))).alias("weight"),
        ).first()
        open_weight = (row["weight"] or 0) * share.denominator
        left = share.numerator * everything - most * (row["size"] or 0) * share.denominator
        if row["n"] == stopped or not open_weight:
            break
        stopped = row["n"]
        full = F.col("source_size").cast("decimal(38,0)") * F.lit(Decimal(most * open_weight)) <= F.col(
            "weight"
        ).cast("decimal(38,0)") * F.lit(Decimal(left))
    part = F.col("weight") * F.lit(float(left)) / F.lit(float(max(open_weight, 1)))
    target = F.when(full, (F.col("source_size") * most).cast("double")).otherwise(part)
    return placed.select("source", "source_size", target.alias("target"))


def draw(doc_id: Column, text: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on seed, id and text alone."""
    key = F.concat_ws(":", F.lit(str(seed)), doc_id.cast("string"), F.md5(F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))


def mix_plan(docs: DataFrame, seed: int = 7, **shares) -> DataFrame:
    """For each row of ``docs``: its columns as the struct ``doc``, ``size``, ``source_size``,
    ``target`` and ``copies``, which is floor(rate) plus one Bernoulli copy with the fraction as its
    probability, where rate = target / source size.

    Two scans: one sums words per source (with map-side combining), one decides. The table of sources
    is joined, not collected; a hot source is split by the skew join or the join is a broadcast,
    whichever the measured size allows. Null sources form a source, a null text has size 0, rows that
    agree in id and text are taken alike, an empty table gives an empty plan.
    """
    rows = docs.select(
        F.struct("*").alias("doc"),
        F.col("source").alias("_source"),
        word_count(F.col("text")).alias("size"),
        draw(F.col("doc_id"), F.col("text"), seed).alias("_draw"),
    )
    targets = source_targets(docs.select("source", word_count(F.col("text")).alias("size")), **shares)
    joined = rows.join(targets, rows["_source"].eqNullSafe(targets["source"]))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(rate)
    copies = whole + (F.col("_draw") < rate - whole).cast("bigint")
    return joined.select("doc", "size", "source_size", "target", copies.alias("copies"))


def mix_sources(docs: DataFrame, seed: int = 7, **shares) -> DataFrame:
    """``docs`` with every row as often as its plan says; same columns."""
    plan = mix_plan(docs, seed, **shares).filter("copies > 0")
    repeated = plan.select("doc", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))))
    return repeated.select("doc.*")
