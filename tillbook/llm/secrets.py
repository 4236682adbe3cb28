"""Secret scans: known formats, and candidate strings whose sliding-window entropy is high.

Column expressions only. Positions count code points, ends are exclusive.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds in the order that breaks ties, their patterns, the group that carries the
#: length, and its least length.
BASE = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
)
#: The hex pattern with its least length inside: the same matches, as a run is always taken whole.
HEX_RUN = r"[0-9a-f]{24,}"

ENTROPY = "entropy"


@dataclass(frozen=True)
class CharClass:
    """Candidate strings of one alphabet, and the entropy in bits from which a window counts."""

    alphabet: str
    pattern: str
    bits: float


#: Hex digits alone, also as a part of a path or an assignment; digits and capitals or small letters mixed,
#: as in keys and tokens; both are tried.
CLASSES = (
    CharClass("0123456789abcdefABCDEF", r"(?<![0-9A-Za-z])[0-9a-fA-F]{20,}(?![0-9A-Za-z])", 3.0),
    CharClass(
        "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-",
        r"[A-Za-z0-9+/_=-]{20,}",
        3.7,
    ),
)
#: Candidates that look random but are none: words (small, capital or capitalised) and numbers alone, UUIDs,
#: counting sequences, samples.
ALLOW = (
    r"^(?:[A-Z]?[a-z]{2,}+|[A-Z]{2,}+(?![a-z])|[_=/+-]++)++$",
    r"^[a-z_=/+-]+$",
    r"^[A-Z_=/+-]+$",
    r"^[0-9_=/+-]+$",
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"(?i:0123456789|abcdefghij|example|sample|placeholder|xxxx)",
)
#: What of a suppressed candidate is looked at by itself: the values of a path or an assignment.
PART = r"[A-Za-z0-9+_-]{20,}"
#: Matches whose places are added up at a time.
RUN = 128


def located(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches as an array of ``(start, end, value)``.

    Places are lengths added up, first within runs of matches and then over the runs, so that a text of
    very many matches does not copy all of them for each.
    """
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")

    def add(state: Column, pair: Column) -> Column:
        start = state["at"] + pair["gap"]
        end = start + F.length(pair["value"])
        hit = F.struct(start.alias("start"), end.alias("end"), pair["value"].alias("value"))
        return F.struct(F.concat(state["hits"], F.array(hit)).alias("hits"), end.alias("at"))

    def add_run(state: Column, run: Column) -> Column:
        moved = F.transform(run["hits"], lambda h: F.struct(
            (h["start"] + state["at"]).alias("start"), (h["end"] + state["at"]).alias("end"), h["value"].alias("value")
        ))
        return F.struct(F.concat(state["hits"], moved).alias("hits"), (state["at"] + run["at"]).alias("at"))

    begin = F.struct(none.alias("hits"), F.lit(0).alias("at"))
    pairs = F.zip_with(gaps, values, lambda g, v: F.struct(F.length(g).alias("gap"), v.alias("value")))
    pairs = F.filter(pairs, lambda p: p["value"].isNotNull())  # there is a gap after the last match

    def summed(pairs: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(pairs), F.lit(RUN))
        runs = F.transform(starts, lambda k: F.aggregate(F.slice(pairs, k, F.lit(RUN)), begin, add))
        many = F.aggregate(runs, begin, add_run, lambda s: s["hits"])
        return F.when(F.size(pairs) > RUN, many).otherwise(F.aggregate(pairs, begin, add, lambda s: s["hits"]))

    return F.when(text.rlike(pattern), _once(pairs, summed)).otherwise(none)


def _once(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def base_hits(text: Column, pattern: str, group: int, least: int) -> Column:
    """Matches of a base pattern whose group has at least so many characters."""
    hits = located(text, HEX_RUN if pattern == BASE[2][1] else pattern)
    return F.filter(hits, lambda h: F.length(F.regexp_extract(h["value"], pattern, group)) >= least)


def high_entropy(value: Column, alphabet: str, bits: float, window: int) -> Column:
    """First start and last end of the windows of ``value`` whose Shannon entropy reaches ``bits``,
    as ``(first, last)``; first is -1 if none does.

    One pass over the characters. The state holds the window and the sum of c * log2(c) over the counts
    in it; a step changes the sum by the counts of the entering and of the leaving character alone, and
    looks at the sum that the step before left. Entropy is log2(window) - sum / window. A value holds
    characters of the ``alphabet`` only.
    """
    term = lambda c: c * math.log2(c) if c > 1 else 0.0
    growth = F.array(*[F.lit(term(c + 1) - term(c)) for c in range(window + 1)])  # when a count c grows by one
    count = lambda text, ch: F.length(text) - F.length(F.replace(text, ch, F.lit("")))

    def looked(state: Column) -> list[Column]:
        hit = (state["at"] >= window) & (math.log2(window) - state["total"] / window >= bits)
        return [
            F.when(hit & (state["first"] < 0), state["at"] - window).otherwise(state["first"]).alias("first"),
            F.when(hit, state["at"]).otherwise(state["last"]).alias("last"),
        ]

    def step(state: Column, ch: Column) -> Column:
        held = state["held"]
        entered = state["total"] + F.get(growth, count(held, ch))
        leaving = F.call_function("substring", held, F.lit(1), F.lit(1))
        # Its count once the new character is in, less one: the count that it goes down to.
        left = count(held, leaving) - F.when(leaving == ch, 0).otherwise(1)
        full = state["at"] >= window
        total = F.when(full, entered - F.get(growth, left)).otherwise(entered)
        kept = F.when(full, F.call_function("substring", held, F.lit(2), F.lit(window))).otherwise(held)
        return F.struct(
            F.concat(kept, ch).alias("held"), total.alias("total"), (state["at"] + 1).alias("at"), *looked(state)
        )

    begin = F.struct(
        F.lit("").alias("held"), F.lit(0.0).alias("total"), F.lit(0).alias("at"),
        F.lit(-1).alias("first"), F.lit(-1).alias("last"),
    )
    characters = F.filter(F.split(value, ""), lambda ch: (ch != "") & F.contains(F.lit(alphabet), ch))
    return F.aggregate(characters, begin, step, lambda s: F.struct(*looked(s)))


def entropy_hits(text: Column, window: int = 20) -> Column:
    """Spans of high entropy in candidate strings that no allow-list pattern suppresses. A suppressed
    candidate is not lost as a whole: its parts between ``/`` and ``=`` are candidates of their own."""
    sized = lambda pattern: pattern.replace("{20,}", f"{{{window},}}")
    allowed = lambda h: h["value"].rlike("|".join(ALLOW))
    found = []
    for kind in CLASSES:

        def parts(h: Column) -> Column:
            inner = F.filter(located(h["value"], sized(PART)), lambda p: ~allowed(p))
            return F.transform(inner, lambda p: F.struct(
                (h["start"] + p["start"]).alias("start"), (h["start"] + p["end"]).alias("end"), p["value"].alias("value")
            ))

        hits = located(text, sized(kind.pattern))
        hits = F.flatten(F.transform(hits, lambda h: F.when(allowed(h), parts(h)).otherwise(F.array(h))))
        found.append(F.filter(F.transform(hits, _measured(kind, window)), lambda h: h["start"].isNotNull()))
    return F.array_distinct(F.concat(*found))


def _measured(kind: CharClass, window: int):
    def span(h: Column) -> Column:
        return _once(
            high_entropy(h["value"], kind.alphabet, kind.bits, window),
            lambda best: F.struct(
                F.when(best["first"] >= 0, h["start"] + best["first"]).alias("start"),
                (h["start"] + best["last"]).alias("end"),
                F.call_function("substring", h["value"], best["first"] + 1, best["last"] - best["first"]).alias("value"),
            ),
        )

    return span


def scan_secrets(docs: DataFrame, window: int = 20) -> DataFrame:
    """``docs`` with one array of ``(start, end, value)`` per kind: ``assign``, ``access``, ``hex`` and
    ``entropy``. Columns of ``docs`` with these names are replaced.

    Texts are scanned whole; a null text counts as empty and has no spans. Rows are independent of
    each other, so repeats and ties need no rule and nothing is shuffled.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    found = {name: base_hits(text, *rest) for name, *rest in BASE}
    return docs.withColumns({**found, ENTROPY: entropy_hits(text, window)})


def span_digest(*kinds: str) -> Column:
    """``kind:start:end`` of the named kinds' arrays, by start and then in the order named, joined by
    commas."""

    def tagged(order: int, kind: str) -> Column:
        parts = lambda h: F.struct(
            h["start"].alias("start"), F.lit(order).alias("order"), h["end"].alias("end"), F.lit(kind).alias("kind")
        )
        return F.transform(F.col(kind), parts)

    spans = F.array_sort(F.concat(*[tagged(i, k) for i, k in enumerate(kinds)]))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
