"""N-gram Jaccard join by set relations: index lists are skipped by size and position, and a set's
overlaps are derived from those of a similar set.

1. Equal sets become one class. A class whose shingles are mostly found nowhere else cannot reach the
   threshold and is set aside; this is decided on a fixed part of the hash range.
2. The rest is indexed by its rarest shingles. Shingles are ordered by frequency; a set enters the lists
   of its first few only (prefix), lists are cut into blocks by set size, and a set enters its own size
   block and, as far as its place in the list leaves enough shingles for sets of that size, the next.
   Sets that no list brings together cannot be linked.
3. Sets that lists connect are compared exactly, in blocks, and blocks whose sizes are too far apart are
   skipped. Within a block the overlaps of a set with
   all others come from those of the set before it: only the lists of the shingles that one of the two
   lacks are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillbook.llm.arrow_text import parts_of_batch
from tillbook.llm.common import components, deal_blocks, least_linked, small
from tillbook.llm.shingles import fingerprint, text_sets
from tillbook.sources import write_and_read

#: Sets are compared in blocks of about so many.
BLOCK = 512
#: The part of the hash range on which step 1 decides, and the size below which it uses all of it.
BAND, ALL_BELOW = 0.25, 64


def sets_of(docs: DataFrame, width: int, percent: int, whole: bool = False) -> DataFrame:
    """``(doc_id, at, f, n, hashes)``: a number of the row, fingerprint and size of its set, and its
    hashes, all of them or those that step 1 needs. The numbers hold once the result is written. Rows are
    worked on in parts of bounded bytes of text, so that memory does not grow with the rows of a batch."""
    # A set of fewer than ALL_BELOW can be linked to sets up to this size, so they show all as well.
    shown = ALL_BELOW * 100 // percent + 1
    limit = np.uint64(int(BAND * 2**64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in parts_of_batch(batch, "text")):
            f, n, kept = [], [], []
            for found in text_sets(part.column("text"), width):
                f.append(fingerprint(found) if len(found) else None)
                n.append(len(found))
                some = found if whole or len(found) <= shown else found[: np.searchsorted(found, limit)].copy()
                kept.append(some.view(np.int64))
            ends = np.cumsum([0, *map(len, kept)]).astype(np.int32)
            values = np.concatenate(kept) if kept else np.empty(0, np.int64)
            hashes = pa.ListArray.from_arrays(pa.array(ends), pa.array(values))
            columns = [part.column("doc_id"), part.column("at"), pa.array(f, pa.int64()), pa.array(n, pa.int64())]
            yield pa.RecordBatch.from_arrays([*columns, hashes], ["doc_id", "at", "f", "n", "hashes"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, at bigint, f bigint, n bigint, hashes array<bigint>"
    return docs.select("doc_id", "text", F.monotonically_increasing_id().alias("at")).mapInArrow(run, schema)


def _spare(n: Column, percent: int) -> Column:
    """How many shingles of a set of ``n`` may be missing in a linked set."""
    return n - F.floor((n * percent + 99) / 100)


def _grade(n: Column, percent: int) -> Column:
    """Grade of a size; the sizes of linked sets are of one grade or of two that follow each other."""
    return F.floor(F.log(n.cast("double")) / (math.log(100 / percent) * (1 + 1e-9)))


def _undecided(sets: DataFrame, percent: int) -> DataFrame:
    """``(k, f, doc_id, n)`` of classes with too few shingles of their own to be set aside, numbered by
    ``k``. Rows count for themselves here, as their small numbers shuffle in fewer bytes than
    fingerprints; a class of several rows has no shingle of its own and is never set aside."""
    seen = sets.select("at", F.explode("hashes").alias("s"))
    single = seen.groupBy("s").agg(F.min("at").alias("at"), F.max("at").alias("top")).filter("at = top")
    # Hashes are signed here; the part of the range starts at 0 and ends below 2 ** 62.
    inside = (F.col("s") >= 0) & (F.col("s") < int(BAND * 2**64))
    own = single.groupBy("at").agg(F.count("*").alias("every"), F.count_if(inside).alias("part"))
    rows = sets.filter("n > 0").select("at", "f", "doc_id", "n").join(own, "at", "left")
    counted = F.coalesce(F.when(F.col("n") < ALL_BELOW, F.col("every")).otherwise(F.col("part")), F.lit(0))
    left = rows.filter(counted <= _spare(F.col("n"), percent))
    left = left.groupBy("f").agg(F.min("doc_id").alias("doc_id"), F.max("n").alias("n"))
    return left.withColumn("k", F.monotonically_increasing_id())


def _ranked(docs: DataFrame, left: DataFrame, width: int, percent: int) -> DataFrame:
    """``(f, n, shared)`` of undecided classes: their shingles that occur in another one, rarest first."""
    ids = small(left.select(F.col("doc_id").alias("_id")).distinct())
    picked = docs.select("doc_id", "text").join(ids, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    again = write_and_read(sets_of(picked, width, percent, whole=True))
    seen = again.join(small(left.select("f", "k")), "f").select("k", F.explode("hashes").alias("s"))
    counts = seen.groupBy("s").agg(F.count("*").cast("int").alias("c"), F.min("k").alias("a"), F.max("k").alias("b"))
    shared = seen.join(counts.filter("a < b").select("s", "c"), "s")
    ranked = shared.groupBy("k").agg(F.array_sort(F.collect_set(F.struct("c", "s"))).alias("shared"))
    return ranked.join(left, "k").select("f", "n", "shared")


def _candidates(ranked: DataFrame, percent: int) -> DataFrame:
    """Edges ``(x, y)`` that connect all sets that share a block of an index list; blocks are skipped by place."""
    # In rarity order the first n - size(shared) shingles of a set occur in no other set.
    entries = _spare(F.col("n"), percent) + 1 - (F.col("n") - F.size("shared"))
    prefix = F.expr("slice(shared, 1, cast(entries as int))")
    listed = ranked.withColumn("entries", entries).filter("entries > 0")
    listed = listed.select("f", "n", (F.col("n") - F.size("shared")).alias("own"), F.posexplode(prefix).alias("k", "e"))
    # If s is the first shingle that two linked sets share, both lack in common what comes before it. What is
    # left of this set from its place on bounds the size of the other set, and so the blocks it may be in.
    left = F.col("n") - F.col("own") - F.col("k")
    most = F.floor(left * (100 + percent) / percent) - F.col("n")
    own = _grade(F.col("n"), percent)
    blocks = F.when(_grade(most, percent) > own, F.array(own, own + 1)).otherwise(F.array(own))
    lists = listed.select("f", F.col("e.s").alias("s"), F.explode(blocks).alias("grade"))
    lists = write_and_read(lists)
    firsts = lists.groupBy("s", "grade").agg(F.min("f").alias("y"), F.max("f").alias("_top")).filter("y < _top")
    return lists.join(firsts, ["s", "grade"]).filter("f <> y").select(F.col("f").alias("x"), "y").distinct()


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every left with every right set of sorted hashes.

    The right sets form an index. The lists that differ between a left set and the one before it are
    added to and taken off that one's answers, unless there are more of them than the set has itself.
    """
    out = np.zeros((len(left), len(right)), np.int64)
    if not left or not right or not sum(map(len, right)):
        return out
    owner = np.repeat(np.arange(len(right)), [len(r) for r in right])
    values = np.concatenate(right)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]

    def read(hashes: np.ndarray) -> np.ndarray:
        a, b = np.searchsorted(values, hashes, "left"), np.searchsorted(values, hashes, "right")
        sizes = b - a
        total = int(sizes.sum())
        places = np.repeat(a - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(total)
        return np.bincount(owner[places], minlength=len(right))

    before, answers = np.empty(0, np.int64), np.zeros(len(right), np.int64)
    for i, hashes in enumerate(left):
        gained = np.setdiff1d(hashes, before, assume_unique=True)
        lost = np.setdiff1d(before, hashes, assume_unique=True)
        if len(gained) + len(lost) < len(hashes):
            answers = answers + read(gained) - read(lost)
        else:
            answers = read(hashes)
        out[i], before = answers, hashes
    return out


def _compare(percent: int):
    def kernel(left: pd.DataFrame, right: pd.DataFrame, same: bool) -> pd.DataFrame:
        left, right = left.sort_values(["n", "f"]), right.sort_values(["n", "f"])
        n, m = left["n"].to_numpy(), right["n"].to_numpy()
        if not same:  # sets that are too large or too small for the other block are skipped
            fits = (n * 100 >= m.min() * percent) & (n * percent <= m.max() * 100)
            left, n = left[fits], n[fits]
        f, g = left["f"].to_numpy(), right["f"].to_numpy()
        if not len(f):
            return pd.DataFrame({"x": [], "y": []})
        common = overlaps(list(left["hashes"]), list(right["hashes"]))
        linked = common * 100 >= (n[:, None] + m[None, :] - common) * percent
        a, b = least_linked(linked, f, g, same)
        x, y = (f, a) if same else (np.concatenate([f, g]), np.concatenate([a, b]))
        return pd.DataFrame({"x": x[x != y], "y": y[x != y]})

    return kernel


def linked_documents(docs: DataFrame, width: int = 4, percent: int = 85) -> DataFrame:
    """Classes of linked documents: ``doc_id``, ``f`` (fingerprint of the set, null if empty),
    ``n_shingles``, ``root`` (a number of the component, null if empty) and ``component_id``, the smallest
    doc_id reachable over links.

    Words are runs of anything but ASCII white space with A-Z in lower case, a set holds the distinct
    runs of ``width`` words (of a shorter text, the whole sequence), and two sets are linked when
    100 * intersection >= ``percent`` * union. Texts without words, and null texts, are linked with
    nothing and their component is their own id. Rows with equal ids are separate documents; a
    component of null ids only has the id null.

    Nothing is capped: lists and components of any length are divided into blocks, large components by size
    first.
    """
    sets = write_and_read(sets_of(docs, width, percent))
    classes = write_and_read(sets.filter("n > 0").groupBy("f").agg(F.min("doc_id").alias("doc_id"), F.max("n").alias("n")))
    left = write_and_read(_undecided(sets, percent))
    ranked = write_and_read(_ranked(docs, left, width, percent))
    rough = write_and_read(components(_candidates(ranked, percent)))
    hashes = F.array_sort(F.transform("shared", lambda e: e["s"])).alias("hashes")
    members = ranked.join(small(rough), F.col("f") == F.col("node")).select("root", "f", "n", hashes)
    links = deal_blocks(
        write_and_read(members), "root", "f", BLOCK, _compare(percent), "x bigint, y bigint",
        grade=_grade(F.col("n"), percent),
    )
    found = write_and_read(components(write_and_read(links)))

    rooted = classes.join(found, F.col("f") == F.col("node"), "left")
    rooted = write_and_read(rooted.select("f", "doc_id", F.coalesce("root", "f").alias("root")))
    least = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = write_and_read(rooted.join(least, "root").select("f", "root", "component_id"))
    out = sets.select("doc_id", "f", F.col("n").alias("n_shingles")).join(named, "f", "left")
    own = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "f", "n_shingles", "root", own.alias("component_id"))


def keep_first(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One document of each component, the one with the smallest id; same columns.

    Of rows that share id and component (repeats) the one with the smallest text stays. Documents
    without words all stay.
    """
    linked = write_and_read(linked_documents(docs, width, percent))
    # An id stays if it names a component; if it is the id of several rows, these are told apart below.
    names = F.max(F.col("component_id").eqNullSafe(F.col("doc_id")))
    ids = linked.groupBy(F.col("doc_id").alias("_id")).agg(names.alias("_names"), F.count("*").alias("_rows"))
    ids = write_and_read(ids.filter("_names").drop("_names"))
    rows = docs.select(F.struct("*").alias("row"))
    kept = rows.join(small(ids), F.col("row.doc_id").eqNullSafe(F.col("_id")))
    single = kept.filter("_rows = 1").select("row.*")
    if ids.filter("_rows > 1").isEmpty():
        return single
    repeated = kept.filter("_rows > 1").select("row.*")
    return single.unionByName(_first_of_repeats(repeated, linked, width, percent))


def _first_of_repeats(rows: DataFrame, linked: DataFrame, width: int, percent: int) -> DataFrame:
    """Of rows whose ids are not unique, one for each component that such an id names; their sets are
    computed again, as an id does not tell which set it stands for."""
    columns = rows.columns
    rows = write_and_read(rows.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("at")))
    sets = sets_of(rows.select(F.col("at").alias("doc_id"), "row.text"), width, percent)
    rows = rows.join(sets.select(F.col("doc_id").alias("at"), "f"), "at")
    named = linked.filter(F.col("root").isNotNull() & F.col("component_id").eqNullSafe(F.col("doc_id")))
    named = named.select(F.col("f").alias("g"), F.col("doc_id").alias("id"), "root").distinct()
    first = rows.join(named, (F.col("f") == F.col("g")) & F.col("row.doc_id").eqNullSafe(F.col("id")))
    first = first.groupBy("root").agg(F.min(F.struct("row.text", "at")).alias("least")).select("least.at")
    stay = first.union(rows.filter("f is null").select("at"))
    return rows.join(stay, "at", "left_semi").select("row.*").select(*columns)
