"""Uploads and entries: parsing, typing and a stated reason for every row set aside."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillbook.functions import (
    CSV_NA_TOKENS,
    DATE_FORMATS,
    clean_header,
    day_first_vote,
    has_text,
    month_first,
    null_if_na,
    strip_ws,
    to_amount,
    to_day,
)
from tillbook.operators.clean import conform, normalize_columns
from tillbook.operators.ranking import join_by_key
from tillbook.spec import TENANT, LedgerSpec

# One CSV field after a comma: quoted with doubled quotes inside, or anything up to the next comma.
_FIELD = r',("[^"]*+(?:""[^"]*+)*+"[^,]*|[^,]*)'


def csv_fields(line: Column) -> Column:
    """Fields of one CSV line as an array of any length, quotes removed."""
    quoted = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(_FIELD), F.lit(1))
    return F.when(F.contains(line, F.lit('"')), F.transform(quoted, _unquote)).otherwise(
        F.split(line, ",")
    )


def _unquote(field: Column) -> Column:
    whole = F.substring(field, F.lit(2), F.length(field) - 2)
    closed = F.when(field.endswith('"'), whole).otherwise(
        F.regexp_replace(field, r'(?s)^"(.*)"([^"]*)$', "$1$2")
    )
    doubled = F.replace(closed, F.lit('""'), F.lit('"'))
    return F.when(field.startswith('"') & (F.length(field) > 1), doubled).otherwise(field)


def with_layout(files: DataFrame, header: Column, spec: LedgerSpec) -> DataFrame:
    """Add ``layout``, how a file with this header line is laid out: its width, the place of each
    ledger column (0 when absent) and whether one is named twice. Computed once per file.

    Names that differ in the file but fall together once cleaned count as twice; of names that
    repeat exactly the first is taken.
    """
    wanted = F.array(*[F.lit(c) for c in spec.upload_columns])
    spellings = F.array_distinct(F.arrays_zip("_header", "_names"))
    hits = F.filter(spellings, lambda pair: F.array_contains(wanted, pair["_names"]))
    layout = F.struct(
        F.size("_header").alias("width"),
        *[F.array_position("_names", c).cast("int").alias(c) for c in spec.upload_columns],
        (F.size(hits) > F.size(F.array_intersect("_names", wanted))).alias("clash"),
    )
    return (
        files.withColumn("_header", csv_fields(header))
        .withColumn("_names", F.transform("_header", clean_header))
        .withColumn("layout", layout)
        .drop("_header", "_names")
    )


def settled(df: DataFrame) -> DataFrame:
    """``df`` with its columns computed once per row.

    A filter on a computed column is normally pushed below and computes it again, in full for every
    mention. It is not pushed through a generator, here one that yields each row as it is.
    """
    return df.select(F.inline(F.array(F.struct("*"))))


def parse_csv_lines(lines: DataFrame, spec: LedgerSpec) -> DataFrame:
    """Text columns of the ledger from CSV texts ``line`` and their file's ``layout``.

    Each line finds its columns through its own file's layout, so files may order them differently.
    A column the file lacks is null. Adds ``reject_reason`` where the line or its header is unusable,
    unless the input already gives one.
    """
    reason = F.when(F.col("layout.clash"), "duplicate_header").when(
        F.size("_fields") > F.col("layout.width"), "too_many_fields"
    )
    if "reject_reason" in lines.columns:
        reason = F.coalesce(F.col("reject_reason"), reason)
    kept = [c for c in (TENANT, "file") if c in lines.columns]
    place = lambda c: F.col(f"layout.{c}")
    values = [
        F.when(place(c) > 0, F.get("_fields", place(c) - 1)).alias(c) for c in spec.upload_columns
    ]
    return lines.withColumn("_fields", csv_fields(F.col("line"))).select(
        *kept, *values, reason.alias("reject_reason")
    )


def date_orders(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per file, whether its dates are written day first: ``by`` and ``day_first``.

    Every date that can be read one way only votes for it, ``13/04/2024`` for day first and ``04/13/2024``
    for month first. The majority decides; a file without such dates, or with as many of both, is read
    month first. Votes are counted in every task before the shuffle, and the result has one row per file.
    """
    votes = df.select(*by, day_first_vote(F.col("date").cast("string")).alias("_vote"))
    return votes.groupBy(*by).agg((F.coalesce(F.sum("_vote"), F.lit(0)) > 0).alias("day_first"))


def with_date_orders(df: DataFrame, by: Sequence[str], to: str = "date") -> DataFrame:
    """``df`` with ``to``, the dates of day-first files written month first where they could be read both ways."""
    keys = [f"_by{i}" for i in range(len(by))]
    # A null file or tenant is one of its own.
    named = df.withColumns({k: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")) for k, c in zip(keys, by)})
    judged = join_by_key(named, date_orders(named, keys), keys, ["date"])
    moved = F.when(F.col("day_first"), month_first(F.col("date"))).otherwise(F.col("date"))
    return judged.withColumn(to, moved).drop(*keys, "day_first")


def flag_upload(
    df: DataFrame,
    spec: LedgerSpec,
    na_tokens: Sequence[str] = CSV_NA_TOKENS,
    date_formats: Sequence[str] = DATE_FORMATS,
    amount: T.DataType | None = None,
    files: Sequence[str] = (),
) -> DataFrame:
    """Upload rows as text plus typed ``_date`` and ``_amount`` and a ``reject_reason``.

    ``files`` names the columns that tell files apart (such as tenant and ``file``); the order of day and
    month is then decided once for each file (see :func:`date_orders`), else date by date.

    Reasons: those of the parsing step, ``missing_tenant``, ``empty_row``, ``missing_amount``, ``bad_amount`` and
    ``missing_party``. A date that cannot be read becomes null and does not reject the row.
    """
    df = normalize_columns(df)
    columns = [*spec.upload_columns]
    extra = [c for c in ("file", "reject_reason") if c in df.columns]
    table = settled(conform(df, [*columns, *extra]))
    table = table.withColumns({c: null_if_na(F.col(c).cast("string"), na_tokens) for c in columns})
    table = with_date_orders(table, files, "_date") if files else table.withColumn("_date", F.col("date"))
    text = T.StringType()
    typed = table.withColumns(
        {
            "_date": to_day(F.col("_date"), text, date_formats),
            "_amount": to_amount(F.col(spec.amount), text, amount),
        }
    )
    empty = F.coalesce(*columns).isNull()
    orphan = F.col(TENANT).isNull() if TENANT in typed.columns else F.lit(False)
    reason = (
        F.when(orphan, "missing_tenant")
        .when(empty, "empty_row")
        .when(F.col(spec.amount).isNull(), "missing_amount")
        .when(F.col("_amount").isNull(), "bad_amount")
        .when(~F.coalesce(has_text(F.col(spec.party)), F.lit(False)), "missing_party")
    )
    if "reject_reason" in extra:
        reason = F.coalesce(F.col("reject_reason"), reason)
    return settled(typed.withColumn("reject_reason", reason))


def ingest_upload(df: DataFrame, spec: LedgerSpec, **options) -> tuple[DataFrame, DataFrame]:
    """``(accepted, quarantine)`` of an upload; together they hold every input row.

    Accepted rows are typed and ready to append; quarantined rows keep their text and a reason.
    Party text is stored as uploaded, not trimmed. Options are those of :func:`flag_upload`.
    """
    flagged = flag_upload(df, spec, **options)
    tenant = [c for c in (TENANT,) if c in flagged.columns]
    accepted = flagged.filter(F.col("reject_reason").isNull()).select(
        *tenant,
        F.col("_date").alias("date"),
        spec.party,
        F.col("_amount").alias(spec.amount),
        F.coalesce("category", F.lit("")).alias("category"),
    )
    quarantine = flagged.filter(F.col("reject_reason").isNotNull()).drop("_date", "_amount")
    return accepted, quarantine


def _typed_entry(df: DataFrame, spec: LedgerSpec, formats: Sequence[str]) -> DataFrame:
    kinds = {f.name: f.dataType for f in df.schema.fields}
    into = T.DoubleType() if isinstance(kinds[spec.amount], T.StringType) else kinds[spec.amount]
    given = F.col("date").isNotNull() & (F.col("date").cast("string") != "")
    complete = (
        given & has_text(F.col(spec.party)) & F.col(spec.amount).isNotNull()
    )
    return df.withColumns(
        {
            "_complete": F.coalesce(complete, F.lit(False)),
            "_bad_amount": to_amount(F.col(spec.amount), kinds[spec.amount], into).isNull(),
            "date": to_day(F.col("date"), kinds["date"], formats),
            spec.party: strip_ws(F.col(spec.party)),
            spec.amount: to_amount(F.col(spec.amount), kinds[spec.amount], into),
            "category": strip_ws(F.coalesce("category", F.lit(""))),
        }
    )


def validate_entries(
    df: DataFrame, spec: LedgerSpec, date_formats: Sequence[str] = DATE_FORMATS
) -> DataFrame:
    """Manual entries typed and trimmed, with ``reject_reason``: ``missing_field``,
    ``bad_amount``, ``negative_amount`` or ``bad_date`` (null when the entry is good).
    """
    reason = (
        F.when(~F.col("_complete"), "missing_field")
        .when(F.col("_bad_amount"), "bad_amount")
        .when(F.col(spec.amount) < 0, "negative_amount")
        .when(F.col("date").isNull(), "bad_date")
    )
    return _typed_entry(df, spec, date_formats).withColumn("reject_reason", reason).drop(
        "_complete", "_bad_amount"
    )


def validate_edits(
    df: DataFrame, spec: LedgerSpec, date_formats: Sequence[str] = DATE_FORMATS
) -> DataFrame:
    """Record edits typed and trimmed, with ``reject_reason``: ``no_record``, ``missing_field``,
    ``bad_date`` or ``bad_amount``. Negative amounts pass, unlike in entries.
    """
    known = F.coalesce(F.col("id").cast("string") != "", F.lit(False))
    reason = (
        F.when(~known, "no_record")
        .when(~F.col("_complete"), "missing_field")
        .when(F.col("date").isNull(), "bad_date")
        .when(F.col("_bad_amount"), "bad_amount")
    )
    return _typed_entry(df, spec, date_formats).withColumn("reject_reason", reason).drop(
        "_complete", "_bad_amount"
    )
