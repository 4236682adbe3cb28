"""Embedding near-duplicates by lattice hashing: E8 cells of random projections, in several tables.

A projection of a unit vector to blocks of eight numbers is decoded, block by block, to the nearest
point of the lattice E8; the points name the vector's cell. Close vectors share cells or lie in
neighbouring ones, which are probed too. Vectors in one cell are compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillbook.llm.common import components, deal_blocks, least_linked
from tillbook.llm.shingles import mixed
from tillbook.sources import write_and_read

#: Vectors are compared in blocks of about so many, and cells of at most so many are packed together.
BLOCK, PACKED = 128, 32


def nearest_e8(y: np.ndarray) -> np.ndarray:
    """Twice the nearest E8 point of each row (so that all coordinates are integers).

    E8 is D8 together with D8 shifted by one half, where D8 holds the integer points of even sum. The
    nearest D8 point rounds every coordinate, and if the sum is odd, the worst one the other way.
    """

    def d8(z: np.ndarray) -> np.ndarray:
        near = np.rint(z)
        rest = z - near
        worst = np.abs(rest).argmax(1)
        odd = np.flatnonzero(near.sum(1) % 2)
        near[odd, worst[odd]] += np.where(rest[odd, worst[odd]] >= 0, 1.0, -1.0)
        return near

    whole, half = d8(y), d8(y - 0.5) + 0.5
    closer = ((y - half) ** 2).sum(1) < ((y - whole) ** 2).sum(1)
    return np.rint(2 * np.where(closer[:, None], half, whole)).astype(np.int64)


def _shortest_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8, which lead to the neighbouring cells."""
    pairs = []
    for i in range(8):
        for j in range(i):
            for a in (1.0, -1.0):
                for b in (1.0, -1.0):
                    v = np.zeros(8)
                    v[i], v[j] = a, b
                    pairs.append(v)
    signs = np.array(np.meshgrid(*[[0.5, -0.5]] * 8)).reshape(8, -1).T
    return np.vstack([pairs, signs[(signs < 0).sum(1) % 2 == 0]])


NEIGHBOURS = _shortest_vectors()


class LatticeHash:
    """``tables`` cells per vector, of ``blocks`` lattice points each; ``width`` scales the projections
    (larger: smaller cells) and ``probes`` neighbouring cells per block are looked up besides."""

    def __init__(self, tables: int = 8, blocks: int = 2, width: float = 0.6, probes: int = 1, seed: int = 7):
        self.tables, self.blocks, self.width, self.probes, self.seed = tables, blocks, width, probes, seed

    def cells(self, unit: np.ndarray, salt: np.ndarray) -> np.ndarray:
        """Numbers of the home cell and the probed cells of every row in every table."""
        random = np.random.default_rng([self.seed, unit.shape[1]])
        out = []
        for table in range(self.tables):
            names, others = [], []
            for _ in range(self.blocks):
                y = unit @ random.normal(0, self.width, (unit.shape[1], 8)) + random.uniform(0, 1, 8)
                point = nearest_e8(y)
                gain = (y - point / 2) @ NEIGHBOURS.T
                near = np.argsort(-gain, 1, kind="stable")[:, : self.probes]
                names.append(self._name(point))
                others.append([self._name(point + np.rint(2 * NEIGHBOURS[near[:, k]]).astype(np.int64)) for k in range(self.probes)])
            keys = [names] + [[*names[:b], o, *names[b + 1 :]] for b in range(self.blocks) for o in others[b]]
            for key in keys:
                cell = salt + np.uint64(table + 1)
                for part in key:
                    cell = mixed(cell * np.uint64(0x9E3779B97F4A7C15) + part)
                out.append(cell.view(np.int64))
        return np.stack(out, 1)

    @staticmethod
    def _name(point: np.ndarray) -> np.ndarray:
        name = np.zeros(len(point), np.uint64)
        for k in range(8):
            name = mixed(name * np.uint64(31) + point[:, k].view(np.uint64))
        return name


def unit_vector(values, label) -> np.ndarray | None:
    """The vector in double precision over its length; None for what is linked with nothing."""
    if values is None or label is None or label != label or not len(values) or any(v is None for v in values):
        return None
    vector = np.asarray(values, dtype=np.float64)
    if not np.isfinite(vector).all():
        return None
    top = np.abs(vector).max()
    if not top:
        return None
    vector = vector / top  # no overflow in the length
    return vector / np.sqrt(vector @ vector)


def _hashed(rows: DataFrame, hashing: LatticeHash) -> DataFrame:
    """``(number, f, cells)`` of every vector that can be linked; ``f`` is equal for equal vectors of
    one label. ``rows`` gives a hash of the label in its place."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            units = [unit_vector(v, x) for v, x in zip(part["embedding"], part["label"])]
            size = np.array([0 if u is None else len(u) for u in units], dtype=int)
            for d in np.unique(size[size > 0]):
                at = np.flatnonzero(size == d)
                unit = np.stack([units[i] for i in at])
                label = part["label"].to_numpy(np.int64)[at].view(np.uint64)
                salt = mixed(label * np.uint64(0x9E3779B97F4A7C15) + np.uint64(d))
                f = salt.copy()
                for k in range(d):
                    f = mixed(f * np.uint64(31) + (unit[:, k] + 0.0).view(np.uint64))
                cells = hashing.cells(unit, salt)
                yield pd.DataFrame({"number": part["number"].to_numpy()[at], "f": f.view(np.int64), "cells": list(cells)})

    return rows.mapInPandas(run, "number bigint, f bigint, cells array<bigint>")


def first_shared(left: np.ndarray, right: np.ndarray, at: np.ndarray, most: int = 1 << 22) -> np.ndarray:
    """Which pairs of rows of sorted cells (padded with the largest number) share no cell before ``at``."""
    out = np.ones(len(at), bool)
    step = max(1, most // (left.shape[1] * right.shape[1] or 1))
    for k in range(0, len(at), step):
        a, b, c = left[k : k + step], right[k : k + step], at[k : k + step]
        shared = (a[:, :, None] == b[:, None, :]) & (a < c[:, None])[:, :, None]
        out[k : k + step] = ~shared.any((1, 2))
    return out


def _padded(cells: pd.Series) -> np.ndarray:
    """Sorted lists of cells as rows of one matrix."""
    out = np.full((len(cells), max(map(len, cells))), np.iinfo(np.int64).max)
    for i, row in enumerate(cells):
        out[i, : len(row)] = row
    return out


def _units(vectors: pd.Series, width: int) -> np.ndarray:
    """Unit vectors as rows; shorter ones, which are in other cells than longer ones, end in zeros."""
    out = np.zeros((len(vectors), width))
    for i, values in enumerate(vectors):
        out[i, : len(values)] = unit_vector(values, 0)
    return out


def _compare(least: float):
    def kernel(left: pd.DataFrame, right: pd.DataFrame, same: bool) -> pd.DataFrame:
        a, b = left["number"].to_numpy(), right["number"].to_numpy()
        cell, other = left["cell"].to_numpy(), right["cell"].to_numpy()
        together = (cell[:, None] == other[None, :]) & (a[:, None] != b[None, :])
        if not together.any():
            return pd.DataFrame({"x": [], "y": [], "links": []})
        width = max(map(len, pd.concat([left["embedding"], right["embedding"]])))
        u, v = _units(left["embedding"], width), _units(right["embedding"], width)
        linked = together & (u @ v.T >= least)
        i, j = np.nonzero(linked)
        mine = first_shared(_padded(left["cells"])[i], _padded(right["cells"])[j], cell[i])
        linked[i[~mine], j[~mine]] = False
        x, y = least_linked(linked, a, b, same)
        counts = linked @ right["rows"].to_numpy()
        if not same:
            a, x = np.concatenate([a, b]), np.concatenate([x, y])
            counts = np.concatenate([counts, left["rows"].to_numpy() @ linked])
        some = counts > 0
        return pd.DataFrame({"x": a[some], "y": x[some], "links": counts[some]})

    return kernel


def _members(hashed: DataFrame, classes: DataFrame, rows: DataFrame) -> DataFrame:
    """``(pack, cell, number, rows, cells, embedding)``: every class of equal vectors in each of its cells that
    other classes are in as well. Small cells are packed together, as many of them are one comparison's worth."""
    cells = hashed.select("f", F.explode("cells").alias("cell")).distinct()
    cells = write_and_read(cells)
    shared = cells.groupBy("cell").agg(F.count("*").alias("many")).filter("many > 1")
    entries = write_and_read(cells.join(shared, "cell"))
    total = entries.filter(F.col("many") <= PACKED).count()
    pack = F.xxhash64(F.pmod(F.xxhash64("cell"), F.lit(max(1, total // BLOCK))))
    pack = F.when(F.col("many") <= PACKED, pack).otherwise(F.xxhash64(F.lit("cell"), "cell"))
    lists = entries.groupBy("f").agg(F.array_sort(F.collect_list("cell")).alias("cells"))
    full = lists.join(classes, "f").join(rows.select("number", "embedding"), "number")
    placed = entries.select("f", "cell", pack.alias("pack")).join(full, "f")
    return write_and_read(placed.select("pack", "cell", "number", "rows", "cells", "embedding"))


def link_vectors(vectors: DataFrame, least: float = 0.98, hashing: LatticeHash | None = None) -> DataFrame:
    """``vectors(vec_id, embedding, label)`` as ``vec_id``, ``n_links``, ``component_id`` and ``kept``.

    Vectors of one label and one length are linked when their cosine in double precision is at least
    ``least`` and the index brings them together; every pair that it does is compared, so no reported
    link is below. Equal vectors are compared once and counted as often as they occur. Null, zero and
    non-finite vectors, and those without a label, are linked with nothing and are their own component.
    Labels of any type compare as in Spark.
    Rows with equal ids are separate vectors; ``kept`` marks those that carry their component's id.

    Every row is indexed, and vectors are compared if they share a cell, not if others connect them. A pair
    counts in the first cell it shares. Large cells are compared in pairs of blocks, so that one huge
    group is spread over many tasks.
    """
    hashing = hashing or LatticeHash()
    rows = vectors.select("vec_id", "embedding", "label", F.monotonically_increasing_id().alias("number"))
    rows = write_and_read(rows)
    # Vectors without a label drop out here, so that no null turns the hashes into floating numbers.
    labelled = rows.filter("label is not null").select("number", "embedding", F.xxhash64("label").alias("label"))
    hashed = write_and_read(_hashed(labelled, hashing))
    classes = write_and_read(hashed.groupBy("f").agg(F.min("number").alias("number"), F.count("*").alias("rows")))
    members = _members(hashed, classes, rows)
    compared = deal_blocks(members, "pack", "number", BLOCK, _compare(least), "x bigint, y bigint, links bigint")
    compared = write_and_read(compared)
    found = write_and_read(components(compared.filter("x <> y").select("x", "y")))
    others = compared.groupBy("x").agg(F.sum("links").alias("links"))

    rooted = classes.join(found, F.col("number") == F.col("node"), "left").join(
        others, F.col("number") == F.col("x"), "left"
    )
    links = F.col("rows") - 1 + F.coalesce("links", F.lit(0))
    rooted = write_and_read(rooted.select("f", F.coalesce("root", "number").alias("root"), links.alias("n_links")))
    placed = rows.select("number", "vec_id").join(hashed.select("number", "f"), "number", "left")
    placed = write_and_read(placed.join(rooted, "f", "left"))
    least_id = write_and_read(placed.groupBy("root").agg(F.min("vec_id").alias("component_id")).filter("root is not null"))
    out = placed.join(least_id, "root", "left")
    component = F.when(F.col("root").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )
