"""Benchmark decontamination by templates: typed placeholders, hash-joined windows, consistent slots.

Column expressions and joins only. Numbers, names and units become placeholders; runs of template
tokens that a document shares with a benchmark item are found by equality; each value that stands in an
item's placeholders must map to one value of the document.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillbook.llm.common import small
from tillbook.sources import write_and_read

#: Tokens of a window. Windows of documents and items start at every token, so that every shared run of
#: WINDOW tokens is seen, wherever it stands. A shorter item is one window of its own length.
WINDOW = 5

#: Units that follow a number.
UNITS = (
    "km|hm|dm|cm|mm|nm|m|kg|mg|g|lb|lbs|oz|l|ml|s|ms|min|h|hours?|minutes?|seconds?|days?|weeks?|months?|years?"
    "|miles?|feet|ft|inch(?:es)?|meters?|metres?|dollars?|euros?|percent|kb|mb|gb|tb|hz|khz|mhz|ghz|w|kw|v|kv"
)
#: Marks put before names and units, from the private use area.
NAME, UNIT = "", ""
NUMBER = r"[0-9]+(?:[.,][0-9]+)*"
#: A marked name, and what may stand between two of one title: up to three numbers and other capitalised words.
NAMED, BETWEEN = rf"{NAME}\p{{L}}+[,;:]?", rf" (?:(?:{NUMBER}|\p{{Lu}}\p{{L}}*)[,;:]? ){{0,3}}"


def marked(text: Column) -> Column:
    """The text with marks before names (capitalised words inside a sentence) and units (after a
    number). Capitals tell no names in a title: a run of four and more such words loses its marks."""
    named = F.regexp_replace(text, r"(?<=[\p{Ll},;:0-9] )(\p{Lu}\p{Ll}+)", f"{NAME}$1")
    title = rf"(?:(?={NAMED}(?:{BETWEEN}{NAMED}){{3}})|\G(?!\A)({BETWEEN})){NAME}(\p{{L}}+[,;:]?)"
    named = F.regexp_replace(named, title, "$1$2")
    return F.regexp_replace(named, rf"(?<=[0-9] ?)((?i:{UNITS}))(?!\p{{L}})", f"{UNIT}$1")


def template(text: Column) -> Column:
    """Template tokens, each followed by one space: lower-cased letter runs, ``#`` for a number, ``@`` for
    a name, ``%`` for a unit."""
    out = F.regexp_replace(marked(text), r"[#@%]", " ")
    out = F.regexp_replace(out, NUMBER, " # ")
    out = F.regexp_replace(out, f"{NAME}\\p{{L}}+", " @ ")
    out = F.regexp_replace(out, f"{UNIT}\\p{{L}}+", " % ")
    return F.concat(F.trim(F.regexp_replace(F.lower(out), r"[^\p{L}#@%]+", " ")), F.lit(" "))


def tokens(text: Column) -> Column:
    """The same tokens one by one, as an array of ``(t, v)``: template token and lower-cased value."""
    found = F.regexp_extract_all(marked(text), F.lit(f"[{NAME}{UNIT}]?\\p{{L}}+|{NUMBER}"), F.lit(0))

    def token(word: Column) -> Column:
        first = F.substring(word, 1, 1)
        kind = F.when(first == NAME, "@").when(first == UNIT, "%").when(first.rlike("[0-9]"), "#")
        plain = F.lower(F.regexp_replace(word, f"[{NAME}{UNIT}]", ""))
        return F.struct(F.coalesce(kind, plain).alias("t"), plain.alias("v"))

    return F.transform(found, token)


def slot_values(part: Column) -> Column:
    """Values of the placeholders among some tokens, each behind its placeholder."""
    return F.transform(F.filter(part, lambda x: x["t"].isin("#", "@", "%")), lambda x: F.concat(x["t"], x["v"]))


def windows(rows: DataFrame, width: int) -> DataFrame:
    """``rows`` with a column ``tokens`` exploded to ``window``, ``at`` and ``slots`` (array of values
    that stand in placeholders), at every token; shorter texts are one window."""
    starts = F.sequence(F.lit(1), F.greatest(F.size("tokens") - width + 1, F.lit(1)))

    def window(at: Column) -> Column:
        part = F.slice(F.col("tokens"), at, F.lit(width))
        words = F.array_join(F.transform(part, lambda x: x["t"]), " ")
        return F.struct(at.alias("at"), F.concat(words, F.lit(" ")).alias("window"), slot_values(part).alias("slots"))

    kept = [c for c in rows.columns if c != "tokens"]
    found = rows.filter(F.size("tokens") > 0).select(*kept, F.explode(F.transform(starts, window)).alias("_w"))
    return found.select(*kept, "_w.*")


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    width: int = WINDOW,
    share: float = 0.5,
    run: int = 13,
) -> DataFrame:
    """Documents that contain benchmark items: ``doc_id``, ``text_key`` (hash of the text), ``item_id``,
    ``n_windows``, ``n_shared``, ``exact`` (all slot values equal).

    A document leaks an item when, on one alignment of the two, they share at least ``share`` of the
    item's windows or a run of ``run`` tokens' worth of windows, and every slot value of the item stands
    for one value of the document in the shared windows (two may stand for the same). ``exact`` tells
    verbatim copies from re-parameterised ones. Texts in title case are read without names, see ``marked``.

    Whole texts of all documents are read; the hashes of their windows join those of the item windows, and
    only documents with such a window are looked at token by token. Items of equal templates are one class,
    and are told apart by their values only in documents that hold enough of the template. Rows agreeing in
    id and text are one result. Null and empty texts and items share nothing. Items of fewer than ``width``
    tokens are looked for by windows of their own length, so a document with that run of template tokens
    leaks them.
    """
    text_key = F.xxhash64("text").alias("text_key")
    named = benchmark.filter("item_id is not null").select("item_id", tokens(F.col("text")).alias("tokens"))
    whole = F.xxhash64(F.array_join(F.transform("tokens", lambda x: x["t"]), " ")).alias("class")
    items = write_and_read(named.filter(F.size("tokens") > 0).select("item_id", whole, "tokens").distinct())
    sample = items.groupBy("class").agg(F.first("tokens").alias("tokens"))
    known = write_and_read(windows(sample, width).select("class", F.col("at").alias("item_at"), "window"))
    length = F.size(F.split("window", " ")) - 1
    widths = [r[0] for r in known.select(length).distinct().collect()]  # at most ``width`` of them
    every = lambda w: F.regexp_extract_all(template(F.col("text")), F.lit(f"(?=((?:[^ ]+ ){{{w}}}))[^ ]+ "), F.lit(1))
    chunks = F.concat(F.array().cast("array<string>"), *[every(w) for w in sorted(widths)])
    hashed = F.xxhash64("window").alias("window_key")
    pieces = docs.select("doc_id", text_key, F.explode(chunks).alias("window")).select("doc_id", "text_key", hashed)
    keys = small(write_and_read(known.select(hashed).distinct()))
    hits = write_and_read(pieces.join(keys, "window_key", "left_semi").select("doc_id", "text_key").distinct())

    near = hits.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key"))
    # Written, as a filter on the tokens would otherwise be pushed below the join and read every text.
    some = write_and_read(docs.select("doc_id", "text", text_key).join(small(near), same, "left_semi"))
    split = some.select("doc_id", "text_key", tokens(F.col("text")).alias("tokens"))
    parts = [windows(split.filter(F.size("tokens") >= w), w) for w in sorted(widths) or [width]]
    found = reduce(DataFrame.union, parts)
    pairs = found.join(small(known), "window").withColumn("shift", F.col("at") - F.col("item_at"))
    on = ["doc_id", "text_key", "class", "shift"]
    seen = F.collect_set(F.struct("item_at", "slots")).alias("seen")
    shared = pairs.groupBy(*on).agg(F.countDistinct("item_at").alias("n_shared"), seen)
    sizes = write_and_read(known.groupBy("class").agg(F.count("*").alias("n_windows")))
    enough = (F.col("n_shared") >= F.col("n_windows") * share) | (F.col("n_shared") >= run - width + 1)
    aligned = shared.join(small(sizes), "class").filter(enough)

    # Items of one template meet a document here for the first time, where it holds that template.
    pair = lambda a, b: F.struct(a.alias("item"), b.alias("document"))
    values = lambda x: F.zip_with(slot_values(F.slice("tokens", x["item_at"], F.lit(width))), x["slots"], pair)
    slots = F.array_distinct(F.flatten(F.transform("seen", values)))
    matched = aligned.join(small(items), "class").withColumn("slots", slots)
    consistent = F.size(F.array_distinct(F.transform("slots", lambda x: x["item"]))) == F.size("slots")
    exact = F.forall("slots", lambda x: x["item"] == x["document"])
    best = matched.filter(consistent).withColumn("exact", exact).groupBy("doc_id", "text_key", "item_id")
    return best.agg(
        F.max("n_windows").alias("n_windows"), F.max("n_shared").alias("n_shared"), F.max("exact").alias("exact")
    )


def drop_leaks(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without the documents that leak a benchmark item; same columns."""
    leaks = write_and_read(find_leaks(docs, benchmark, **options).select("doc_id", "text_key").distinct())
    leaks = leaks.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"))
    rows = docs.select(F.struct("*").alias("row"))
    same = F.col("row.doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("row.text") == F.col("_key"))
    return rows.join(small(leaks), same, "left_anti").select("row.*")
