"""What several operators share: words, stable draws, joins of checked size, connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillbook.sources import write_and_read

#: A word is a run of anything but ASCII white space (Java's and DuckDB's regular expressions agree).
WORD = r"[^\x20\x09-\x0D]+"

#: Bytes up to which a table is broadcast; a larger one is joined by a shuffle. A row counts for its values
#: and for what the hash table of a join keeps besides.
BROADCAST_BYTES, ROW_BYTES = 32 << 20, 24


def word_count(text: Column) -> Column:
    """Number of words; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def utf8_bytes(text: Column) -> Column:
    """Bytes of the text in UTF-8; a null text has none."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint")


def _bytes_of(column: T.StructField) -> Column:
    """Bytes of a value, near enough: eight of a number, all of a text, the JSON text of anything else."""
    value = F.col(f"`{column.name}`")
    if isinstance(column.dataType, (T.StringType, T.BinaryType)):
        size = F.octet_length(value)
    elif isinstance(column.dataType, (T.ArrayType, T.MapType, T.StructType)):
        size = F.octet_length(F.to_json(F.struct(value)))
    else:
        size = F.lit(8)
    return F.coalesce(size, F.lit(0)).cast("bigint")


def small(df: DataFrame) -> DataFrame:
    """``df``, a written table, hinted for broadcast only if its counted bytes are few."""
    size = F.lit(ROW_BYTES).cast("bigint")
    for column in df.schema.fields:
        size = size + _bytes_of(column)
    total = df.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    return F.broadcast(df) if total <= BROADCAST_BYTES else df


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected ``edges(x, y)`` of integers, as ``(node, root)``.

    The root is the smallest node reachable. Alternates large-star and small-star steps: every step
    takes minima per node with map-side combining and joins them back, so a hub is split by the skew
    join and no component meets in one task. Each step is written to the shared folder; only a
    fingerprint of the edge set comes to the driver. Nodes without an edge do not appear.
    """
    edges = edges.select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y"))
    edges = write_and_read(edges.filter("x <> y").distinct())
    seen = None
    while True:
        both = edges.union(edges.select(F.col("y").alias("x"), F.col("x").alias("y")))
        edges = write_and_read(_star(both, both.filter("y > x")))
        edges = write_and_read(_star(edges, edges, own=True))
        state = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("x", "y"))).first()
        if state == seen:
            break
        seen = state
    roots = edges.select(F.col("x").alias("node"), F.col("y").alias("root"))
    return roots.union(edges.select(F.col("y"), F.col("y")).distinct())


def _star(every: DataFrame, moved: DataFrame, own: bool = False) -> DataFrame:
    """Point the neighbours in ``moved`` (and with ``own`` the node itself) to the least of a node's
    neighbourhood in ``every``."""
    least = every.groupBy("x").agg(F.min("y").alias("_m")).withColumn("_m", F.least("x", "_m"))
    out = moved.join(least, "x").select(F.col("y").alias("x"), F.col("_m").alias("y"))
    if own:
        out = out.union(least.select("x", F.col("_m").alias("y")))
    return out.filter("x > y").distinct()


#: Blocks of a grade are numbered from the grade times this on.
GRADE = 1 << 32


def deal_blocks(
    members: DataFrame, group: str, number: str, most: int, kernel, schema: str, grade: Column | None = None
) -> DataFrame:
    """Run ``kernel`` over all pairs of members of each group, in blocks of bounded size.

    ``members`` is a written table with a group, a number and a payload per row. A group of at most
    ``most`` rows is one block; a larger one is divided by a hash of the number, and each pair of its
    blocks (and each block with itself) is dealt out by itself, so that no task holds a group. Pairs of
    blocks are range-partitioned, which packs small groups together. ``kernel`` gets the rows of one
    pair of blocks as two frames (the same one twice for a block with itself) and returns a frame.

    With ``grade``, a whole number from 0 on, groups of more than ``most`` rows are divided by grade first,
    and pairs of blocks whose grades differ by more than one are skipped.
    """
    sizes = write_and_read(members.groupBy(group).agg(F.count("*").alias("_m")).filter("_m > 1"))
    sized = members.join(small(sizes), group)
    place = lambda parts: F.pmod(F.xxhash64(number), parts)
    if grade is None:
        parts = F.ceil(F.col("_m") / most)
        blocked = sized.withColumn("_block", place(parts))
        others = F.sequence(F.lit(0).cast("bigint"), parts - 1)
    else:
        graded = sized.withColumn("_grade", F.when(F.col("_m") > most, grade).otherwise(0).cast("bigint"))
        near = small(_near_grades(graded, group, most))
        own = F.filter("_near", lambda g: g["grade"] == F.col("_grade"))[0]["parts"]
        blocked = graded.join(near, [group, "_grade"]).withColumn("_block", F.col("_grade") * GRADE + place(own))
        numbers = lambda g: F.sequence(g["grade"] * GRADE, g["grade"] * GRADE + g["parts"] - 1)
        others = F.flatten(F.transform("_near", numbers))
    dealt = blocked.withColumn("_other", F.explode(others))
    dealt = dealt.withColumns({"_low": F.least("_block", "_other"), "_high": F.greatest("_block", "_other")})
    keys = [group, "_low", "_high"]
    dealt = dealt.select(*members.columns, "_block", "_low", "_high")
    dealt = dealt.repartitionByRange(*keys).sortWithinPartitions(*keys)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in runs(parts, keys):
            low, high = rows["_low"].iat[0], rows["_high"].iat[0]
            left, right = rows[rows["_block"] == low], rows[rows["_block"] == high]
            if len(left) and len(right):
                out = kernel(left, right, low == high)
                if len(out):
                    yield out

    return dealt.mapInPandas(run, schema)


def _near_grades(graded: DataFrame, group: str, most: int) -> DataFrame:
    """By group and grade, the numbers of blocks of this grade and of the two beside it, a written table."""
    parts = F.ceil(F.count("*") / most).alias("parts")
    parts = graded.groupBy(group, F.col("_grade").alias("grade")).agg(parts)
    around = F.explode(F.array(*[F.col("grade") + d for d in (-1, 0, 1)])).alias("_grade")
    beside = parts.select(group, around, F.struct("grade", "parts").alias("_part"))
    # At most three entries; a grade that only its neighbours name has no rows to join.
    return write_and_read(beside.groupBy(group, "_grade").agg(F.collect_list("_part").alias("_near")))


def runs(parts: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """The rows of each key, from batches sorted by the keys."""
    held = None
    for part in parts:
        if len(part):
            part = part if held is None else pd.concat([held, part], ignore_index=True)
            new = (part[keys] != part[keys].shift()).any(axis=1).to_numpy()
            starts = [*np.flatnonzero(new), len(part)]
            for a, b in zip(starts[:-2], starts[1:-1]):
                yield part.iloc[a:b]
            held = part.iloc[starts[-2] :]
    if held is not None:
        yield held


def least_linked(linked: np.ndarray, left: np.ndarray, right: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Smallest number that each row and column reaches over the links of a boolean matrix."""
    a, b, top = left.copy(), right.copy(), np.iinfo(np.int64).max
    while True:
        a2 = np.minimum(a, np.where(linked, b[None, :], top).min(1, initial=top))
        b2 = np.minimum(b, np.where(linked, a2[:, None], top).min(0, initial=top))
        if same:
            a2 = b2 = np.minimum(a2, b2)
        if (a2 == a).all() and (b2 == b).all():
            return a, b
        a, b = a2, b2
