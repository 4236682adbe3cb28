"""URL filters: rule lookup by Bloom filter cascades that are exact over the corpus's keys.

Column expressions only: no join decides a url, and nothing leaves the JVM.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillbook.sources import write_and_read

#: Hash functions and bits per encoded key of every level.
HASHES = 5
BITS_PER_KEY = 8
#: A level's filter is a literal in the plan, so its size has a bound (8 MB).
MAX_BITS = 1 << 26


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_keys(host: Column, path: Column, lengths: Sequence[int]) -> Column:
    """Keys under which a rule could be listed, longest first, equal lengths in code point order:
    the host and every domain above it, each with the path's prefixes of the given lengths."""
    labels = F.split(host, r"\.")
    domains = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    )
    prefixes = F.array_compact(
        F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths])
    )
    keys = F.flatten(F.transform(domains, lambda d: F.transform(prefixes, lambda p: F.concat(d, p))))
    ranked = F.array_sort(F.transform(F.array_distinct(keys), lambda k: F.struct((-F.length(k)).alias("short"), k.alias("key"))))
    return F.transform(ranked, lambda s: s["key"])


def _spots(key: Column, bits: int, level: int) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(level), F.lit(i), key), F.lit(bits)) for i in range(HASHES)]


def filter_bits(inside: int, outside: int) -> int:
    """Bits of a filter of ``inside`` keys that wrongly accepts no more than as many of ``outside`` keys,
    which are those of the next level: a test of HASHES spots fails with (HASHES * inside / bits) ** HASHES."""
    enough = HASHES * inside * (max(outside, 1) / max(inside, 1)) ** (1 / HASHES)
    bits = 64
    while bits < max(BITS_PER_KEY * inside, enough):
        bits *= 2
    return bits


def _bloom(keys: DataFrame, others: DataFrame, level: int) -> Callable[[Column], Column]:
    """A Bloom filter of ``keys(key)`` as a column test, of a size that suits the number of ``others``.
    The words of the filter, not keys, come to the driver; their number is bounded by ``MAX_BITS``."""
    bits = filter_bits(keys.count(), others.count())
    if bits > MAX_BITS:
        raise ValueError(f"a filter of {bits} bits exceeds {MAX_BITS}; list fewer keys per cascade")
    spot = keys.select(F.explode(F.array(*_spots(F.col("key"), bits, level))).alias("spot"))
    mask = F.lit(1).cast("bigint")
    words = spot.groupBy(F.expr("spot div 32").alias("word")).agg(
        F.bit_or(F.call_function("shiftleft", mask, F.expr("cast(spot % 32 as int)"))).alias("bits")
    )
    table = np.zeros(bits // 32, dtype=np.int64)
    for word, value in words.collect():
        table[word] = value
    literal = F.lit(table)

    def holds(key: Column) -> Column:
        test = F.lit(True)
        for spot in _spots(key, bits, level):
            word = F.get(literal, F.floor(spot / 32).cast("int"))
            bit = F.call_function("shiftright", word, (spot % 32).cast("int")).bitwiseAND(F.lit(1).cast("bigint"))
            test = test & (bit == 1)
        return test

    return holds


def cascade(listed: DataFrame, universe: DataFrame) -> Callable[[Column], Column]:
    """Exact membership in ``listed(key)`` for every key of ``universe(key)``, as a column test.

    Level 1 encodes the listed keys, level 2 those other keys of the universe that level 1 wrongly
    accepts, level 3 the listed keys that level 2 wrongly accepts, and so on until no error is left. Levels
    are as large as it takes to leave the next one no more keys, about, than they have.
    Keys outside ``universe`` may be judged wrongly, so it must hold every key that will be asked.
    Null keys and repeats are ignored; an empty list gives a test that is always false.
    """
    listed = write_and_read(listed.select("key").filter("key is not null").distinct())
    if listed.isEmpty():
        return lambda key: F.lit(False)
    others = universe.select("key").filter("key is not null").join(listed, "key", "left_anti")
    inside, outside = listed, write_and_read(others.distinct())
    levels = []
    while True:
        holds = _bloom(inside, outside, len(levels))
        levels.append(holds)
        wrong = write_and_read(outside.filter(holds(F.col("key"))))
        if wrong.isEmpty():
            break
        inside, outside = wrong, inside

    def member(key: Column) -> Column:
        answer = F.lit(len(levels) % 2 == 1)
        for depth in reversed(range(len(levels))):
            answer = F.when(~levels[depth](key), F.lit(depth % 2 == 1)).otherwise(answer)
        return F.coalesce(answer, F.lit(False))

    return member


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str]], url: str = "url") -> DataFrame:
    """Rows of ``pages`` as the struct ``page`` with ``host``, ``path``, ``rule`` and ``verdict``.

    ``rules`` are pairs of ``allow`` or ``block`` and a host with a path prefix. A rule fits its host
    and all subdomains where the path starts with its own; the longest fitting rule decides. The
    cascades' universe is every key of every url in ``pages``, so each lookup is exact. A url without a
    fitting rule is not listed and therefore allowed; null and malformed urls have empty host and path.
    """
    spark = pages.sparkSession
    table = spark.createDataFrame([(a, r) for a, r in rules], "action string, key string")
    lengths = sorted({len(r) - len(r.split("/", 1)[0]) for _, r in rules}, reverse=True)
    parts = pages.select(
        F.struct("*").alias("page"), url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path")
    )
    keys = rule_keys(F.col("host"), F.col("path"), lengths)
    universe = write_and_read(parts.select("host", "path").distinct().select(F.explode(keys).alias("key")).distinct())
    blocked = cascade(table.filter("action = 'block'"), universe)
    allowed = cascade(table.filter("action = 'allow'"), universe)
    rule = F.get(F.filter(keys, lambda k: blocked(k) | allowed(k)), 0)
    found = parts.withColumn("rule", rule)
    verdict = F.when(blocked(F.col("rule")), "block").otherwise("allow")
    return found.withColumn("verdict", F.when(F.col("rule").isNull(), "allow").otherwise(verdict))
