"""Upload envelopes that are too large for one row: base64 payloads decoded in chunks by many tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillbook.operators.ingest import parse_csv_lines, with_layout
from tillbook.operators.ranking import join_by_key
from tillbook.shared import write_and_read
from tillbook.sources.records import line_feeds, quoted_records, filled
from tillbook.sources.uploads import repair
from tillbook.spec import TENANT, LedgerSpec

#: Characters of a chunk; a multiple of four, which base64 can be cut at.
CHUNK = 4 << 20

#: One character for each byte, so that lines can be cut and joined before they are read as UTF-8.
_BYTES = "ISO-8859-1"


def _chunks(uploads: DataFrame, chunk: int) -> DataFrame:
    """``(upload, user_id, file, named, csv, k, part)``: the payloads cut into chunks, one row each. An upload
    without a payload has one empty chunk."""
    payload = F.coalesce(F.translate(F.split_part("contents", F.lit(","), F.lit(2)), " \t\r\n", ""), F.lit(""))
    named = F.coalesce((F.col("contents") != "") & (F.col("filename") != ""), F.lit(False))
    csv = F.coalesce(F.lower("filename").endswith(".csv"), F.lit(False))
    rows = uploads.select(
        F.monotonically_increasing_id().alias("upload"), TENANT, F.col("filename").alias("file"),
        named.alias("named"), csv.alias("csv"), F.when(named & csv, payload).otherwise("").alias("payload"),
    )
    pieces = F.greatest(F.lit(1), F.ceil(F.length("payload") / chunk)).cast("int")
    cut = rows.withColumn("last", pieces - 1).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("last"))))
    part = F.substr("payload", F.col("k") * chunk + 1, F.lit(chunk))
    return write_and_read(cut.select("upload", TENANT, "file", "named", "csv", "last", "k", part.alias("part")))


def _lines(chunks: DataFrame) -> DataFrame:
    """``(file, start, at, line)`` of the decoded chunks: ``file`` is the upload, ``start`` the chunk in which the
    line begins and ``at`` its number in the upload. What lies at the borders of chunks is put together."""
    text = F.decode(F.try_to_binary("part", F.lit("base64")), _BYTES)
    cut = chunks.select("upload", "k", F.split(text, "\n").alias("pieces"))
    counts = cut.select("upload", "k", (F.size("pieces") - 1).alias("feeds"))
    earlier = Window.partitionBy("upload").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    begins = counts.select("upload", "k", F.coalesce(F.sum("feeds").over(earlier), F.lit(0)).alias("begins"))
    pieces = cut.join(begins, ["upload", "k"]).select(
        "upload", "k", "begins", F.size("pieces").alias("many"), F.posexplode("pieces").alias("i", "piece")
    )
    numbered = pieces.select(
        F.col("upload").alias("file"), "k", (F.col("begins") + F.col("i")).alias("at"), "piece",
        ((F.col("i") == 0) | (F.col("i") == F.col("many") - 1)).alias("border"),
    )
    inner = numbered.filter("not border").select("file", F.col("k").alias("start"), "at", "piece")
    border = numbered.filter("border").groupBy("file", "at").agg(
        F.min("k").alias("start"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "piece"))), lambda p: p["piece"]), "").alias("piece")
    )
    every = inner.unionByName(border)
    return every.select("file", "start", "at", repair(F.encode("piece", _BYTES).cast("string")).alias("line"))


def decode_large_uploads(uploads: DataFrame, spec: LedgerSpec, multiline: bool = False, chunk: int = CHUNK) -> DataFrame:
    """Rows of envelopes as :func:`decode_uploads` gives them, for payloads of any size.

    A payload is cut at multiples of four characters, and its chunks are decoded, divided into lines and
    parsed by different tasks. Lines over the border of chunks, and with ``multiline`` records over line breaks, are put together
    by their number. Chunks and lines are written to the shared folder once.
    """
    if chunk % 4:
        raise ValueError("a chunk is a multiple of four characters")
    chunks = _chunks(uploads, chunk).repartition("upload", "k")
    # Padding ends a payload; within it, it is as wrong as any other character.
    broken = F.try_to_binary("part", F.lit("base64")).isNull() | ((F.col("k") < F.col("last")) & F.contains("part", F.lit("=")))
    files = write_and_read(
        chunks.groupBy("upload", TENANT, "file", "named", "csv").agg(F.bool_or(broken).alias("broken"))
    )
    good = chunks.join(files.filter("named and csv and not broken").select("upload"), "upload", "left_semi")
    lines = _lines(good)
    if multiline:
        records = quoted_records(lines, scanned=False)
    else:
        cut = lines.select("file", "start", "at", F.posexplode(F.split(line_feeds(F.col("line")), "\n")).alias("k", "line"))
        cut = cut.filter(filled(F.col("line")))
        records = cut.select("file", F.struct("start", "at", "k").alias("place"), "line", F.lit(True).alias("whole"))
    records = write_and_read(records.withColumnRenamed("file", "upload"))
    heads = records.groupBy("upload").agg(F.min_by("line", "place").alias("_head"), F.min("place").alias("_top"), F.count("*").alias("_n"))
    known = with_layout(files.join(heads, "upload", "left"), F.col("_head"), spec)
    reason = (
        F.when(~F.col("named"), "no_file").when(~F.col("csv"), "unsupported_file")
        .when(F.col("broken"), "bad_encoding").when(F.coalesce("_n", F.lit(0)) < 2, "no_rows")
    )
    known = write_and_read(known.withColumn("reject_reason", reason))
    refused = known.filter("reject_reason is not null").select(TENANT, "file", "layout", F.lit(None).cast("string").alias("line"), "reject_reason")
    usable = known.filter("reject_reason is null").select("upload", TENANT, "file", "layout", "_top")
    body = join_by_key(records, usable, ["upload"], ["line"]).filter(F.col("place") != F.col("_top"))
    unclosed = F.when(~F.col("whole"), "unclosed_quote")
    rows = body.select(TENANT, "file", "layout", "line", unclosed.alias("reject_reason"))
    return parse_csv_lines(rows.unionByName(refused), spec)
