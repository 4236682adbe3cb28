"""Ranked lexical search, term at a time with a limited number of accumulators.

1. Every document is tokenised once; its length and its counts of the terms that some item asks for are
   written (the index). Numbers of documents, of terms, and of documents per term come from all of it.
2. The index is read in blocks of documents, each turned into lists by term. For every item the lists
   are taken rarest term first. A document gets an accumulator when a list names it, until the bounds of
   the lists left add up to less than the k-th best score so far: no new document can then enter. The
   documents that have accumulators are updated exactly to the last list. The k-th best score carries
   over from block to block of a task, so that later blocks stop early.
3. The best of all tasks are ranked.

Items are taken in groups of bounded size, each group in passes of its own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillbook.llm.arrow_text import binary_array, text_parts
from tillbook.operators.ranking import number_rows
from tillbook.sources import write_and_read

#: Bytes of terms and items of one group; runs of items with more are a group by themselves.
GROUP_BYTES, GROUP_ITEMS = 4 << 20, 2_000
#: Items whose sizes are added up before they are grouped.
RUN = 50
#: Postings of a block of documents.
BLOCK = 1_000_000
#: Share of a document's length in the denominator, and the saturation, in hundredths and eighths.
LENGTH_SHARE, SATURATION = 90, 8

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_BYTES = np.arange(256)
#: Fixed by the byte: part of a term (ASCII letters and digits and all else but ASCII), and in small letters.
INSIDE = (_BYTES >= 0x80) | np.isin(_BYTES, list(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"))
SMALL = np.where((_BYTES >= 0x41) & (_BYTES <= 0x5A), _BYTES + 32, _BYTES).astype(np.uint8)


def terms_of(text: Column) -> Column:
    """Distinct terms of a text; a null text has none."""
    found = F.regexp_extract_all(_small_letters(text), F.lit(f"({TERM})"), F.lit(1))
    return F.array_distinct(F.coalesce(found, F.array().cast("array<string>")))


def _small_letters(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def separators(data: np.ndarray) -> np.ndarray:
    """Places behind bytes that are in no term."""
    return np.flatnonzero(~INSIDE[data]) + 1


def count_terms(texts: pa.Array, terms: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(n, doc, term, tf)``: the number of terms of every text, and in parallel arrays, ordered by text
    and term, how often a text holds each of the distinct ``terms`` (bytes) that it holds."""
    n, keys, counts = np.zeros(len(texts), np.int64), [], []
    width = max(1, len(terms))
    for first, data, offsets in text_parts(texts, separators):
        inside = INSIDE[data]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        at = offsets[:-1][offsets[:-1] < len(data)]
        begins[at] = inside[at]  # a text does not go on in the next one
        starts = np.flatnonzero(begins)
        if len(starts):
            per_text = np.diff(np.searchsorted(starts, offsets))
            n[first : first + len(per_text)] += per_text
            places = np.cumsum(inside)[starts] - 1
            found = pc.index_in(binary_array(SMALL[data[inside]], places), value_set=terms)
            owner = first + np.repeat(np.arange(len(per_text)), per_text)
            known = found.is_valid().to_numpy(zero_copy_only=False)
            code = pc.fill_null(found, 0).to_numpy(zero_copy_only=False)
            key, count = np.unique(owner[known] * width + code[known], return_counts=True)
            keys.append(key)
            counts.append(count)
    if not keys:
        return n, *(np.empty(0, np.int64) for _ in range(3))
    key, place = np.unique(np.concatenate(keys), return_inverse=True)  # parts of one long text meet here
    tf = np.zeros(len(key), np.int64)
    np.add.at(tf, place, np.concatenate(counts))
    return n, key // width, key % width, tf


def index_documents(docs: DataFrame, terms: list[str]) -> DataFrame:
    """``doc_id``, ``n`` (terms of the document, with repeats), ``terms`` (numbers of those of ``terms`` that
    it holds) and ``tfs`` (how often) of every document with at least one term."""
    known = sorted(t.encode() for t in terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value_set = pa.array(known, pa.large_binary())
        for batch in batches:
            n, doc, term, tf = count_terms(batch.column("text"), value_set)
            ends = pa.array(np.searchsorted(doc, np.arange(len(batch) + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(v.astype(np.int32))) for v in (term, tf)]
            out = pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), *lists], ["doc_id", "n", "terms", "tfs"])
            yield out.filter(pa.array(n > 0))

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n bigint, terms array<int>, tfs array<int>")


@dataclass
class Lists:
    """Postings of a block of documents by term: ``starts[t]`` to ``starts[t + 1]`` of ``docs`` (places in the
    block, in order) and ``scores`` (what the term adds to them), and the largest score of each list."""

    starts: np.ndarray
    docs: np.ndarray
    scores: np.ndarray
    bounds: np.ndarray

    def of(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        part = slice(self.starts[term], self.starts[term + 1])
        return self.docs[part], self.scores[part]


def block_lists(n: np.ndarray, sizes: np.ndarray, terms: np.ndarray, tfs: np.ndarray, weights: np.ndarray, documents: int, length: int) -> Lists:
    """The lists of a block of documents with ``n`` terms each and ``sizes`` postings each."""
    m = 100 - LENGTH_SHARE + (LENGTH_SHARE * n * documents) // length
    doc = np.repeat(np.arange(len(n)), sizes)
    tf = tfs.astype(np.int64)
    scores = weights[terms] * ((1_000_000_000 * tf) // (1000 * tf + SATURATION * m[doc]))
    order = np.argsort(terms, kind="stable")
    starts = np.searchsorted(terms[order], np.arange(len(weights) + 1))
    bounds = np.zeros(len(weights), np.int64)
    np.maximum.at(bounds, terms, scores)
    return Lists(starts, doc[order], scores[order], bounds)


def best_of_block(lists: Lists, size: int, item: np.ndarray, k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents of a block and their scores for an item (its terms, rarest first): all that may be among
    the ``k`` best, if ``floor`` is the k-th best score known from elsewhere (0: none).

    A document without an accumulator when these stop being made scores less than the bounds left,
    which are below the k-th best partial score; equal scores are not lost.
    """
    left = np.append(np.cumsum(lists.bounds[item][::-1])[::-1], 0)
    partial = np.zeros(size, np.int64)
    held = np.zeros(size, bool)
    at = 0
    for at, term in enumerate(item):
        best = floor
        count = int(held.sum()) if at else 0
        if count >= k:
            best = max(best, int(np.partition(partial[held], count - k)[count - k]))
        if left[at] < best:
            break
        docs, scores = lists.of(term)
        partial[docs] += scores
        held[docs] = True
    else:
        at = len(item)
    survivors = np.flatnonzero(held)
    for term in item[at:]:
        docs, scores = lists.of(term)
        if len(survivors) * 16 < len(docs):  # few survivors look themselves up
            place = np.minimum(np.searchsorted(docs, survivors), len(docs) - 1)
            same = docs[place] == survivors
            partial[survivors[same]] += scores[place[same]]
        else:
            same = held[docs]
            partial[docs[same]] += scores[same]
    scores = partial[survivors]
    keep = (scores > 0) & (scores >= floor)
    return survivors[keep], scores[keep]


def _search(index: DataFrame, items: dict[int, np.ndarray], weights: np.ndarray, documents: int, length: int, k: int) -> DataFrame:
    """``(item, doc_id, score)``: the ``k`` best of each task for every item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = None
        ids = {i: [] for i in items}  # per item, the best (score, id) so far
        floors = dict.fromkeys(items, 0)
        for batch in blocks(batches):
            kind = batch.schema.field("doc_id").type
            terms, tfs = batch.column("terms"), batch.column("tfs")
            sizes = pc.list_value_length(terms).to_numpy(zero_copy_only=False)
            n = batch.column("n").to_numpy()
            flat = [c.flatten().to_numpy() for c in (terms, tfs)]
            lists = block_lists(n, sizes, *flat, weights, documents, length)
            names = batch.column("doc_id").to_pylist()
            for i, item in items.items():
                docs, scores = best_of_block(lists, len(n), item, k, floors[i])
                if len(docs) > 4 * k:  # equal scores stay, the smallest ids are chosen below
                    docs, scores = _tied(docs, scores, k)
                if len(docs):
                    found = ids[i] + [(-int(s), names[d] is not None, names[d]) for d, s in zip(docs, scores)]
                    ids[i] = sorted(found, key=lambda r: (r[0], r[1], r[2] if r[1] else 0))[:k]
                    if len(ids[i]) == k:
                        floors[i] = -ids[i][-1][0]
        if kind is not None:
            rows = [(i, name, -s) for i, found in ids.items() for s, _, name in found]
            columns = list(zip(*rows)) or [[], [], []]
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int32()), pa.array(columns[1], kind), pa.array(columns[2], pa.int64())],
                ["item", "doc_id", "score"],
            )

    kind = index.schema["doc_id"].dataType.simpleString()
    return index.mapInArrow(run, f"item int, doc_id {kind}, score bigint")


def _tied(docs: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The documents that score at least as much as the k-th best."""
    least = np.partition(scores, len(scores) - k)[len(scores) - k]
    return docs[scores >= least], scores[scores >= least]


def blocks(batches: Iterator[pa.RecordBatch], most: int = BLOCK) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of the index with about ``most`` postings."""
    for batch in batches:
        ends = np.concatenate([[0], np.cumsum(pc.list_value_length(batch.column("terms")).to_numpy(zero_copy_only=False))])
        at = 0
        while at < len(batch):
            end = max(at + 1, int(np.searchsorted(ends, ends[at] + most, "right")) - 1)
            yield batch.slice(at, end - at)
            at = end


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` documents with the highest scores above 0 for every item, as ``item_id``, ``rank``, ``doc_id``
    and ``score``; equal scores rank by ``doc_id``, a null id first.

    Terms are maximal runs of ASCII letters and digits and of everything that is not ASCII, with A-Z in
    lower case. With N documents that hold a term, L terms in all, n terms in the document, df documents
    with the term and tf of it in the document, the term adds
    ``floor(1000 ln((2N + 2) / (2df + 1))) * ((10**9 * tf) div (1000 * tf + 8 * (10 + (90 * n * N) div L)))``.

    Null and empty texts have no terms and are no documents. Rows of ``items`` with equal ids (null is one
    too) are one item with the terms of all of them; an item without terms gets no rows. Repeated
    documents are documents of their own and rank beside each other. Columns of other names are not
    looked at. Empty tables give an empty result.
    """
    kinds = {c: t.simpleString() for c, t in (("item_id", items.schema["item_id"].dataType), ("doc_id", docs.schema["doc_id"].dataType))}
    queries = items.select("item_id", F.explode(terms_of(F.col("text"))).alias("term"))
    queries = queries.groupBy("item_id").agg(F.collect_set("term").alias("terms"))
    queries = write_and_read(number_rows(queries, [F.col("item_id")], "item"))
    found = None
    for low, high in item_groups(queries):
        group = queries.filter(F.col("item").between(low, high))
        part = _search_group(docs, group, k)
        found = part if found is None else found.unionByName(part)
    if found is None:
        empty = f"item_id {kinds['item_id']}, rank int, doc_id {kinds['doc_id']}, score bigint"
        return docs.sparkSession.createDataFrame([], empty)
    return found


def item_groups(queries: DataFrame) -> list[tuple[int, int]]:
    """First and last number of the items of each group, of bounded items and bytes of terms."""
    size = F.aggregate("terms", F.lit(0).cast("bigint"), lambda a, t: a + F.octet_length(t) + 8)
    runs = queries.groupBy(F.floor(F.col("item") / RUN).cast("int").alias("run"))
    runs = runs.agg(F.sum(size).alias("size"), F.max("item").alias("last"))
    out, held, first, last = [], 0, 0, 0
    for row in runs.orderBy("run").toLocalIterator():
        if held and (held + row["size"] > GROUP_BYTES or row["last"] - first >= GROUP_ITEMS):
            out.append((first, row["run"] * RUN - 1))
            first, held = row["run"] * RUN, 0
        held += row["size"]
        last = row["last"]
    return [*out, (first, last)] if held else out


def _search_group(docs: DataFrame, group: DataFrame, k: int) -> DataFrame:
    rows = group.select("item", "terms").collect()  # bounded by item_groups
    terms = sorted({t for r in rows for t in r["terms"]}, key=str.encode)
    code = {t: i for i, t in enumerate(terms)}
    index = write_and_read(index_documents(docs, terms))
    documents, length = index.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    counted = index.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).collect()
    df = np.zeros(len(terms), np.int64)
    for r in counted:  # one row per term of the group
        df[r["term"]] = r["df"]
    weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
    by_item = {r["item"]: np.array(sorted((code[t] for t in r["terms"]), key=lambda c: (df[c], c)), np.int64) for r in rows}
    by_item = {i: v[df[v] > 0] for i, v in by_item.items()}
    best = _search(index, by_item, weights, documents, max(1, length), k)
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_first())
    ranked = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    names = F.broadcast(group.select("item", "item_id"))  # bounded by item_groups
    return ranked.join(names, "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
