"""Records of CSV text with line breaks inside quotes, found in parallel in the parts of a file.

Whether a line begins inside quotes depends on all quotes before it in its file. A first scan counts the
quotes of every part of a file (odd or even); these summaries, one row per part, are added up along the file,
which tells whether a part begins inside quotes. A second scan then finds the records of every part where
they are read: no line is moved but the pieces of the few records that go from one part to the next.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillbook.shared import write_and_read

#: Bytes from which a record is not put together: a quote that is never closed.
RECORD_BYTES = 64 << 20

_RECORD = "\u001e"


def line_feeds(text: Column, feed: str = "\n") -> Column:
    """Every kind of line break as ``feed``."""
    for found in ("\r\n", "\r", "\n"):
        text = text if found == feed else F.replace(text, F.lit(found), F.lit(feed))
    return text


def filled(line: Column) -> Column:
    """Not an empty or blank line."""
    return line.rlike(r"[^ \t\r\n]")


def records_of(text: Column, multiline: bool) -> Column:
    """Filled records of a text. With ``multiline`` line breaks inside quotes belong to a field."""
    if not multiline:
        return F.filter(F.split(line_feeds(text), "\n"), filled)
    # Pieces at even places lie outside quotes: only their line breaks end a record.
    pieces = F.transform(
        F.split(text, '"'),
        lambda piece, i: F.when(i % 2 == 0, line_feeds(piece, _RECORD)).otherwise(piece),
    )
    return F.filter(F.split(F.array_join(pieces, '"'), _RECORD), filled)


def _odd_quotes(line: Column) -> Column:
    return (F.octet_length(line) - F.octet_length(F.replace(line, F.lit('"'), F.lit("")))) % 2


class _Open:
    """A record of which not all lines were seen yet: its text, or beyond the limit only its first line."""

    def __init__(self, front: bool, limit: int):
        self.front, self.limit, self.at, self.first, self.bytes, self.texts = front, limit, None, None, 0, []

    def add(self, lines: pa.Array, at: int) -> None:
        if self.at is None:
            self.at, self.first = at, lines[0].as_py()
        self.bytes += pc.sum(pc.binary_length(lines)).as_py() + len(lines)
        self.texts = [*self.texts, *lines.to_pylist()] if self.bytes <= self.limit else []

    def rows(self, file: str, start: int, closed: bool) -> pa.RecordBatch:
        """As a record if it began and ended in this part, else as a piece of one."""
        piece, whole = self.front or not closed, self.bytes <= self.limit
        line = "\n".join(self.texts) if whole else self.first
        values = [[file], [start], [self.at], [line], [whole], [piece], [self.front], [self.first if piece else None], [self.bytes]]
        return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, _FOUND)], schema=_FOUND)


_FOUND = pa.schema(
    [
        ("file", pa.string()), ("start", pa.int64()), ("at", pa.int64()), ("line", pa.string()), ("whole", pa.bool_()),
        ("piece", pa.bool_()), ("front", pa.bool_()), ("first", pa.string()), ("bytes", pa.int64()),
    ]
)
_FOUND_SQL = (
    "file string, start bigint, at bigint, line string, whole boolean, piece boolean, front boolean, first string, "
    "bytes bigint"
)


def _runs(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch cut where another part of a file begins."""
    start, file = batch["start"].to_numpy(), batch["file"].dictionary_encode().indices.to_numpy()
    cuts = np.flatnonzero((np.diff(start) != 0) | (np.diff(file) != 0)) + 1
    for begin, end in zip([0, *cuts], [*cuts, batch.num_rows]):
        yield batch.slice(begin, end - begin)


def _records_in_parts(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Records that lie in one part of a file, and pieces of others, from lines in the order of the file."""
    part, opened = None, None
    for run in (run for batch in batches if batch.num_rows for run in _runs(batch)):
        if part != (run["file"][0].as_py(), run["start"][0].as_py()):
            if opened:
                yield opened.rows(*part, False)
            part = run["file"][0].as_py(), run["start"][0].as_py()
            opened = _Open(True, limit) if run["inside"][0].as_py() else None
        lines, at = run["line"], run["at"].to_numpy()
        quotes = np.cumsum(pc.count_substring(lines, '"').to_numpy()) + (opened is not None)
        begins = np.flatnonzero(np.concatenate([[opened is not None], quotes[:-1] % 2]) == 0)
        if opened:
            rest = begins[0] if len(begins) else len(lines)
            opened.add(lines.slice(0, rest), int(at[0]))
            if len(begins) or quotes[-1] % 2 == 0:
                yield opened.rows(*part, True)
                opened = None
        if quotes[-1] % 2 and len(begins):
            opened = _Open(False, limit)
            opened.add(lines.slice(begins[-1]), int(at[begins[-1]]))
            lines, begins = lines.slice(0, begins[-1]), begins[:-1]
        if len(begins):
            yield _closed(part, lines, at, begins, limit)
    if opened:
        yield opened.rows(*part, False)


def _closed(part: tuple[str, int], lines: pa.Array, at: np.ndarray, begins: np.ndarray, limit: int) -> pa.RecordBatch:
    """The records that begin at these lines; the last one ends with the last line."""
    n, ends = len(begins), [*begins[1:], len(lines)]
    before = np.concatenate([[0], np.cumsum(pc.binary_length(lines).to_numpy() + 1)])
    size = before[ends] - before[begins]
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([*begins, len(lines)], pa.int32()), lines), "\n")
    whole = pa.array(size <= limit)
    line = pc.if_else(whole, joined, lines.take(pa.array(begins)))
    no = pa.array(np.zeros(n, bool))
    columns = [
        pa.array([part[0]] * n, pa.string()), pa.array(np.full(n, part[1])), pa.array(at[begins]), line, whole, no, no,
        pa.nulls(n, pa.string()), pa.array(size),
    ]
    return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, _FOUND)], schema=_FOUND)


def quoted_records(lines: DataFrame, record_bytes: int = RECORD_BYTES, *, scanned: bool = True) -> DataFrame:
    """``(file, place, line, whole)``: the filled records of files from their lines.

    ``lines`` is a scan: every part of a file lies in one partition, in its order; if not, say so by ``scanned``,
    and the lines are brought into this form. It has ``file``, ``start``
    (where the part of the file begins that the line was read from), ``at`` (a number that rises within the
    part) and ``line``, its text up to a line feed. ``place`` orders the records of a file. A record of more
    than ``record_bytes`` is given by its first line with ``whole`` false.

    Only the pieces are written, the other records follow from the scan. Only those parts that begin inside quotes are sent to all tasks, by their
    file and place: at most one small row for each point at which Spark divides a file.
    """
    parts = lines.groupBy("file", "start").agg((F.sum(_odd_quotes(F.col("line"))) % 2).alias("odd"))
    earlier = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    inside = parts.withColumn("inside", F.sum("odd").over(earlier) % 2 == 1).filter("inside").drop("odd")
    marked = lines.join(F.broadcast(inside), ["file", "start"], "left")
    marked = marked.select("file", F.col("start").cast("bigint").alias("start"), F.col("at").cast("bigint").alias("at"), F.coalesce("line", F.lit("")).alias("line"), F.coalesce("inside", F.lit(False)).alias("inside"))
    marked = marked.withColumn("file", F.col("file").cast("string"))
    if not scanned:
        marked = marked.repartition("file", "start").sortWithinPartitions("file", "start", "at")
    found = marked.mapInArrow(lambda batches: _records_in_parts(batches, record_bytes), _FOUND_SQL)
    broken = write_and_read(found.filter("piece").repartition("file", "start"))
    single = found.filter("not piece").select("file", F.struct("start", "at").alias("place"), "line", "whole")

    # The last record that was begun in a part goes on at the front of the next.
    along = Window.partitionBy("file").orderBy("start", "at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    place = F.struct("start", "at")
    begun = F.last(F.when(~F.col("front"), place), ignorenulls=True).over(along)
    pieces = broken.select("file", "start", "at", "front", "bytes").withColumn("record", begun)
    sizes = pieces.groupBy("file", "record").agg(F.sum("bytes").alias("total"))
    pieces = pieces.join(sizes, ["file", "record"]).select("file", "start", "at", "record", "total")
    pieces = broken.join(pieces, ["file", "start", "at"])
    long = pieces.filter((F.col("total") > record_bytes) & ~F.col("front"))
    long = long.select("file", F.col("record").alias("place"), F.col("first").alias("line"), F.lit(False).alias("whole"))
    usual = pieces.filter(F.col("total") <= record_bytes).groupBy("file", "record").agg(
        F.sort_array(F.collect_list(F.struct("start", "at", "line"))).alias("texts")
    )
    usual = usual.select(
        "file", F.col("record").alias("place"), F.array_join("texts.line", "\n").alias("line"), F.lit(True).alias("whole"),
    )
    # A carriage return outside quotes ends a record as well.
    cut = single.unionByName(usual).unionByName(long).select("file", "place", "whole", F.posexplode(records_of(F.col("line"), True)).alias("k", "line"))
    place = F.struct("place.start", "place.at", "k")
    file = F.col("file").cast(lines.schema["file"].dataType).alias("file")
    return cut.select(file, place.alias("place"), "line", "whole")
