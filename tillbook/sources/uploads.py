"""Uploaded CSV files, read from a folder or from a table of base64 envelopes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillbook.operators.ingest import csv_fields, parse_csv_lines, with_layout
from tillbook.operators.ranking import join_by_key
from tillbook.sources.records import filled, quoted_records, records_of
from tillbook.spec import TENANT, LedgerSpec

CSV_GLOB = "*.[cC][sS][vV]"
_CORRUPT = "_corrupt_record"


def repair(text: Column) -> Column:
    """Text without the bytes that are not UTF-8 and without a leading byte order mark."""
    valid = F.replace(F.make_valid_utf8(text), F.lit("\ufffd"), F.lit(""))
    return F.ltrim(valid, F.lit("\ufeff"))


def _decoded(text: Column) -> Column:
    """Text with its percent escapes resolved; a plus sign stays one."""
    return F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))


def read_csv_ledger(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """CSV files that share one header, all columns as text, and ``reject_reason``: ``too_many_fields``
    where a row is wider than the header. Files whose header differs make the read fail; read those with
    :func:`read_csv_uploads`. ``multiline`` allows line breaks inside quotes, at the price of one task
    per file.
    """
    options = {
        "header": True, "escape": '"', "multiLine": multiline, "pathGlobFilter": CSV_GLOB,
        "recursiveFileLookup": True,
    }
    header = spark.read.csv(path, inferSchema=False, **options).columns
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*header, _CORRUPT]])
    rows = spark.read.schema(schema).csv(
        path, enforceSchema=False, columnNameOfCorruptRecord=_CORRUPT, **options
    )
    wide = F.size(csv_fields(F.col(_CORRUPT))) > len(header)  # a row may also be short
    kept = [F.col(f"`{c}`") for c in header]
    return rows.select(*kept, F.when(wide, "too_many_fields").alias("reject_reason"))


def read_csv_uploads(
    spark: SparkSession, path: str, spec: LedgerSpec, tenant: str | None = None, multiline: bool = False
) -> DataFrame:
    """Files that may differ in their columns and order, as text columns of the ledger.

    The tenant is ``tenant``, or comes from a ``user_id=...`` folder on the path (null without one).
    Every file's first filled line is its header. Files stay splittable: headers are found in one pass
    over the lines and looked up by file in a second, so no list of files passes through the driver.
    ``multiline`` allows line breaks inside quotes; the parts of a file are still read by many tasks (see
    :func:`quoted_records`), and only records that cross a part are written.

    Every line but the headers gives a row. ``reject_reason`` tells those of the parsing step,
    ``unclosed_quote`` (an odd number of quotes in a line, or with ``multiline`` a record beyond its limit) and ``repeated_header``. A file that gives
    no lines is one row: ``unsupported_file`` if it is not named as CSV, ``no_rows`` if it holds a
    header at most. Files of zero bytes are invisible to Spark's readers and give nothing.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    files = files.select(F.col("_metadata.file_path").alias("file"))
    source = spark.read.option("recursiveFileLookup", True)
    feeds = {"lineSep": "\n"} if multiline else {}
    text = source.text(path, pathGlobFilter=CSV_GLOB, **feeds).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("_start"),
        repair(F.col("value")).alias("line"),
    )
    if multiline:
        numbered = text.select("file", F.col("_start").alias("start"), F.monotonically_increasing_id().alias("at"), "line")
        lines = quoted_records(numbered).withColumnRenamed("place", "_at")
        heads = lines.groupBy("file").agg(
            F.min_by("line", "_at").alias("_head"), F.min("_at").alias("_top"), F.count("*").alias("_n")
        )
    else:
        lines = text.filter(filled(F.col("line"))).withColumn("_at", F.monotonically_increasing_id())
        at_top = F.when(F.col("_start") == 0, F.col("_at"))
        heads = lines.groupBy("file").agg(
            F.min_by("line", at_top).alias("_head"), F.min(at_top).alias("_top"), F.count("*").alias("_n")
        )
    heads = with_layout(heads, F.col("_head"), spec)
    body = join_by_key(lines, heads.filter("_n > 1"), ["file"], ["line"])
    # The places of both scans agree: they read the same files in the same parts.
    body = body.filter(F.col("_at") != F.col("_top"))
    quotes = F.length("line") - F.length(F.replace("line", F.lit('"'), F.lit("")))
    reason = F.when(F.col("line") == F.col("_head"), "repeated_header")
    reason = reason.when(~F.col("whole") if multiline else quotes % 2 == 1, "unclosed_quote")
    rows = body.select("file", "layout", "line", reason.alias("reject_reason"))

    is_csv = F.lower("file").endswith(".csv")
    empty = files.join(heads.select("file", "_n", "layout"), "file", "left").filter(F.coalesce("_n", F.lit(0)) < 2)
    refused = F.when(is_csv, "no_rows").otherwise("unsupported_file")
    empty = empty.select("file", "layout", F.lit(None).cast("string").alias("line"), refused.alias("reject_reason"))

    folder = F.regexp_extract("file", rf"/{TENANT}=([^/]+)/", 1)
    # The path is encoded as a URI, and the folder name inside it may be escaped once more.
    name = _decoded(F.nullif(folder, F.lit("")))
    owner = F.lit(tenant) if tenant is not None else F.coalesce(_decoded(name), name)
    return parse_csv_lines(rows.unionByName(empty).withColumn(TENANT, owner), spec)


def decode_uploads(uploads: DataFrame, spec: LedgerSpec, multiline: bool = False) -> DataFrame:
    """Rows of a table of envelopes ``(user_id, filename, contents)`` as text columns of the ledger.

    ``contents`` is ``data:<type>;base64,<payload>``, of a size that suits one row; for larger ones see
    :func:`decode_large_uploads`. A file that cannot be used gives one row whose
    ``reject_reason`` is ``no_file``, ``unsupported_file``, ``bad_encoding`` or ``no_rows``. ``multiline`` allows
    line breaks inside quotes; it then takes every quote for a text delimiter.
    """
    payload = F.try_to_binary(F.split_part("contents", F.lit(","), F.lit(2)), F.lit("base64"))
    is_csv = F.lower("filename").endswith(".csv")
    named = F.coalesce((F.col("contents") != "") & (F.col("filename") != ""), F.lit(False))
    decoded = (
        uploads.select(
            TENANT,
            F.col("filename").alias("file"),
            named.alias("_named"),
            F.coalesce(is_csv, F.lit(False)).alias("_csv"),
            F.when(is_csv, repair(payload.cast("string"))).alias("_text"),
        )
        .withColumn("_lines", records_of(F.col("_text"), multiline))
    )
    reason = (
        F.when(~F.col("_named"), "no_file")
        .when(~F.col("_csv"), "unsupported_file")
        .when(F.col("_text").isNull(), "bad_encoding")
        .when(F.size("_lines") < 2, "no_rows")
    )
    usable = decoded.select(TENANT, "file", "_lines", reason.alias("reject_reason")).withColumn(
        "_lines", F.when(F.col("reject_reason").isNull(), F.col("_lines"))
    )
    body = F.slice("_lines", F.lit(2), F.size("_lines"))
    rows = (
        with_layout(usable, F.get("_lines", F.lit(0)), spec)
        .withColumn("line", F.explode_outer(body))
        .drop("_lines")
    )
    return parse_csv_lines(rows, spec)
