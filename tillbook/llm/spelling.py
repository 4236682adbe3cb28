"""Spelling variants by dense prefix-suffix tiling: blocks of words are code-point matrices, and two
words differ by a single edit if their common prefix and suffix together reach the longer length
minus one.

Words are cut into thirds. An edit leaves two thirds as they are, so that two words of which the shorter
has b code points share the first two thirds of b, or the first and the last, or the last two. Words
with equal such parts are put into one tile, small parts packed together and large ones divided into
pairs of blocks. Within a tile all words of two blocks are compared at once. A pair is counted where its
common prefix says that it belongs, so once only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillbook.llm.common import small
from tillbook.sources import write_and_read

#: Words of a packed tile on average, most words of a block, most code points of a block's matrix.
PACKED, BLOCK, BLOCK_CELLS = 192, 512, 1 << 20
#: Fixed by the task: letters of a run, and the share of runs that lose a code point.
LETTERS = "A-Za-zÀ-ÿ"
ONE_IN = 31


def words_of(docs: DataFrame, least: int = 7, occurs: int = 2) -> DataFrame:
    """``(word, n)`` of all words with at least ``least`` code points that occur ``occurs`` times or more.

    Words are maximal runs of letters with A-Z in lower case. With h the CRC-32 of ``<doc_id>:<run>``, a
    run loses its code point at h modulo its length if 31 divides h. Null texts have no words, a null
    id is an empty one. Partial counts are taken in every task before the shuffle.
    """
    runs = F.regexp_extract_all("text", F.lit(f"([{LETTERS}]{{{least},}})"), F.lit(1))
    upper, lower = ("".join(map(chr, range(a, a + 26))) for a in (65, 97))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    rows = rows.withColumn("run", F.translate("run", upper, lower))
    rows = rows.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
    at = F.pmod("h", F.length("run")).cast("int")
    shorter = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
    word = F.when(F.col("h") % ONE_IN == 0, shorter).otherwise(F.col("run"))
    counts = rows.select(word.alias("word")).filter(F.length("word") >= least).groupBy("word").agg(F.count("*").alias("n"))
    return counts.filter(F.col("n") >= occurs)


def _keys(base: Column) -> dict[int, Column]:
    """The two thirds of a word that stay if the edit is in the last (0), middle (1) or first (2) one."""
    first, second = F.floor(base / 3).cast("int"), (base - F.floor(base / 3)).cast("int")
    return {
        0: F.left("word", second),
        1: F.concat(F.left("word", first), F.right("word", base - second)),
        2: F.right("word", base - first),
    }


def tiles(words: DataFrame, least: int) -> DataFrame:
    """``(kind, base, bucket, low, high, block, word, n)``: the words of every tile, a tile being two
    blocks (or one) of the words that share a bucket of keys."""
    rows = words.withColumn("size", F.length("word"))
    bases = F.filter(F.array("size", F.col("size") - 1), lambda b: b >= least)
    rows = rows.withColumn("base", F.explode(bases))
    keyed = F.array(*[F.struct(F.lit(k).alias("kind"), key.alias("key")) for k, key in _keys(F.col("base")).items()])
    rows = rows.select("word", "n", "base", F.explode(keyed).alias("_k")).select("word", "n", "base", "_k.*")
    lengths = words.groupBy(F.length("word").alias("base")).agg(F.count("*").alias("many"))
    # A base holds the words of its own length and of the next.
    per_base = lengths.unionAll(lengths.select(F.col("base") - 1, "many")).groupBy("base").agg(F.sum("many").alias("many"))
    rows = rows.join(small(write_and_read(per_base)), "base")
    bucket = F.pmod(F.xxhash64("key"), F.ceil(F.col("many") / PACKED)).alias("bucket")
    rows = write_and_read(rows.select("kind", "base", bucket, "word", "n"))

    most = F.greatest(F.lit(1), F.least(F.lit(BLOCK), F.floor(F.lit(BLOCK_CELLS) / F.col("base"))))
    group = ["kind", "base", "bucket"]
    sizes = rows.groupBy(*group).agg(F.count("*").alias("m")).filter("m > 1")
    sizes = write_and_read(sizes.select(*group, F.ceil(F.col("m") / most).cast("int").alias("parts")))
    dealt = rows.join(small(sizes), group).withColumn("block", F.pmod(F.xxhash64("word"), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return dealt.select(
        *group, F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "word", "n"
    )


def matrix(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, width: int, pad: int, right: bool) -> np.ndarray:
    """Code points of words, one word a row, padded on the right or on the left."""
    at = np.arange(width)[None, :] - (width - sizes[:, None] if right else 0)
    inside = (at >= 0) & (at < sizes[:, None])
    return np.where(inside, data[np.where(inside, starts[:, None] + at, 0)], pad).astype(np.uint8)


def common(a: np.ndarray, b: np.ndarray, back: bool) -> np.ndarray:
    """Length of the common prefix (or, of matrices padded on the left, suffix) of every pair of rows."""
    total = np.zeros((len(a), len(b)), np.int32)
    alive = np.ones((len(a), len(b)), bool)
    for j in reversed(range(a.shape[1])) if back else range(a.shape[1]):
        alive &= a[:, j][:, None] == b[:, j][None, :]
        if not alive.any():
            break
        total += alive
    return total


def near(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, a: np.ndarray, b: np.ndarray, kind: int, base: int) -> np.ndarray:
    """Which words of rows ``a`` are one edit away from which of rows ``b``, of the pairs that belong to
    this kind and base."""
    views = [(data, starts[r], sizes[r], base + 1) for r in (a, b)]
    # Different padding never agrees. The code points of these words are below 256 and above 1.
    prefix = common(*(matrix(*v, pad, False) for pad, v in enumerate(views)), False)
    suffix = common(*(matrix(*v, pad, True) for pad, v in enumerate(views)), True)
    la, lb = sizes[a][:, None], sizes[b][None, :]
    first, second = base // 3, base - base // 3
    ranges = ((second, base + 2), (first, second), (0, first))
    low, high = ranges[kind]
    single = (prefix + suffix >= np.maximum(la, lb) - 1) & (np.minimum(la, lb) == base)
    return single & (prefix >= low) & (prefix < high) & ~((la == lb) & (prefix == la))


def compare_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per word and tile: how many near words, and the one that comes first. Rows come sorted by tile,
    and within by falling count and word."""
    names = ["kind", "base", "bucket", "low", "high"]
    for table in whole_tiles(batches, names):
        words = table.column("word").cast(pa.large_binary())
        offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
        data = np.frombuffer(words.buffers()[2], np.uint8)
        starts, sizes = offsets[:-1], np.diff(offsets)
        keys = [table.column(c).to_numpy() for c in names]
        block = table.column("block").to_numpy()
        cuts = [0, *(np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in keys])) + 1), len(table)]
        rows, counts, firsts = [], [], []
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            kind, base, _, low, high = (int(k[lo]) for k in keys)
            a = lo + np.flatnonzero(block[lo:hi] == low)
            b = a if low == high else lo + np.flatnonzero(block[lo:hi] == high)
            if not len(a) or not len(b):
                continue
            found = near(data, starts, sizes, a, b, kind, base)
            for left, right, linked in ((a, b, found), (b, a, found.T))[: 1 if low == high else 2]:
                count = linked.sum(1)
                some = np.flatnonzero(count)
                rows.append(left[some])
                counts.append(count[some])
                firsts.append(right[linked[some].argmax(1)])  # the largest n, then the smallest word
        if rows and sum(map(len, rows)):
            own, first = pa.array(np.concatenate(rows)), pa.array(np.concatenate(firsts))
            yield pa.RecordBatch.from_arrays(
                [
                    table.column("word").take(own), pa.array(np.concatenate(counts).astype(np.int64)),
                    table.column("n").take(first), table.column("word").take(first),
                ],
                ["word", "n_near", "form_n", "form"],
            )


def whole_tiles(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    """The rows of sorted batches, regrouped so that no tile lies in two of them."""
    held = None
    for batch in batches:
        if held is not None:
            batch = pa.concat_batches([held, batch])
        last = np.ones(len(batch), bool)
        for name in names:
            values = batch.column(name).to_numpy()
            last &= values == values[-1]
        end = len(batch) - int(last.sum())
        if end:
            yield batch.slice(0, end)
        held = batch.slice(end)
    if held is not None and len(held):
        yield held


def near_words(words: DataFrame, least: int = 7) -> DataFrame:
    """``word``, ``n_near`` (words one edit away), ``form_n`` and ``form`` (of those, the largest ``n`` and, of
    equal ones, the smallest word) of every word that has a near one."""
    keys = ["kind", "base", "bucket", "low", "high"]
    latin = tiles(words, least).withColumn("word", F.encode("word", "ISO-8859-1"))
    dealt = latin.repartition(*keys).sortWithinPartitions(*keys, F.desc("n"), "word")
    found = dealt.mapInArrow(compare_tiles, "word binary, n_near bigint, form_n bigint, form binary")
    text = {c: F.decode(c, "ISO-8859-1").alias(c) for c in ("word", "form")}
    found = found.select(text["word"], "n_near", F.struct((-F.col("form_n")).alias("less"), text["form"]).alias("best"))
    found = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))
    return found.select("word", "n_near", (-F.col("best.less")).alias("form_n"), F.col("best.form").alias("form"))


def spelling_variants(docs: DataFrame, least: int = 7, occurs: int = 2, times: int = 10) -> DataFrame:
    """``word``, ``n``, ``form``, ``form_n``, ``n_near`` and ``root`` of every word of :func:`words_of`.

    ``n_near`` counts the words that differ by one inserted, deleted or replaced code point (0: none). The
    form is the near word that occurs most often, of equal ones the first in code-point order, if it
    occurs at least ``times`` as often as the word, else null with a null ``form_n``. The root is where
    following forms ends, the word itself if it has none. As counts grow by the factor ``times`` along a
    path (``times`` is above 1), few doublings reach every end.

    Null and empty texts and empty tables give no words; repeated rows count again; other columns are
    not looked at. Words may be of any length: long ones make smaller blocks.
    """
    words = write_and_read(words_of(docs, least, occurs))
    found = words.join(near_words(words, least), "word", "left")
    enough = F.col("form_n") >= F.col("n") * times
    judged = write_and_read(
        found.select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
            F.when(enough, F.col("form")).alias("form"), F.when(enough, F.col("form_n")).alias("form_n"),
        )
    )
    largest = judged.agg(F.max("n")).first()[0] or 1
    steps = math.floor(math.log(largest, times))
    paths = judged.filter("form is not null").select("word", F.col("form").alias("root"))
    for _ in range(max(0, math.ceil(math.log2(max(1, steps))))):
        ahead = paths.select(F.col("word").alias("root"), F.col("root").alias("next"))
        paths = write_and_read(paths.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root")))
    rooted = judged.join(paths, "word", "left")
    return rooted.select("word", "n", "form", "form_n", "n_near", F.coalesce("root", "word").alias("root"))
