"""A stored ledger with versions: every change is one atomic step, and old versions stay readable.

Data files are written once and never altered. A version is a table of files with the range of tenants,
dates and ids in each; it becomes visible when its one small commit file is renamed to its number, which
fails if another writer took that number first. A job that stops anywhere before leaves the ledger as it
was, with some unused files. Batch numbers of appends are kept with the version, so that an append that
is run again adds nothing.

Files are ordered by tenant, date and id, and a reader opens only those whose ranges it needs.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable
from dataclasses import asdict, dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillbook.operators.changes import append_rows, apply_changes
from tillbook.operators.filters import Day, as_day
from tillbook.operators.ranking import keep_by_key
from tillbook.shared import write_and_read
from tillbook.spec import BY, KEY, TENANT, LedgerSpec, ledger_schema

#: How often a writer tries again after others committed first, tenants up to which a change set names
#: them one by one to skip files, rows of a data file, the part of these below which a file is small, and
#: equal rows that are moved as one when they get ids.
TRIES, LISTED_TENANTS, FILE_ROWS, SMALL_PART, COPIES = 20, 1_000, 5_000_000, 0.5, 100

FILES = (
    "file string, rows bigint, undated bigint, min_tenant string, max_tenant string, min_date date, max_date date, "
    "min_id string, max_id string"
)


@dataclass(frozen=True)
class Store:
    """Where a ledger is stored, and of which kind it is."""

    path: str
    spec: LedgerSpec
    amount: T.DataType | None = None

    @property
    def schema(self) -> T.StructType:
        return ledger_schema(self.spec, self.amount)


@dataclass(frozen=True)
class Version:
    """A committed state: its number, its table of files, its table of batch numbers, and what made it."""

    number: int
    files: str
    batches: str
    made_by: str


class Conflict(Exception):
    """Another writer committed this version first."""


# --- commits -------------------------------------------------------------------------------------


def _path(spark: SparkSession, path: str):
    """A path for Hadoop's file systems."""
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if there is no such folder."""
    folder = _path(spark, path)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    return [status.getPath().getName() for status in system.listStatus(folder)] if system.exists(folder) else []


def versions(spark: SparkSession, store: Store) -> list[int]:
    """Numbers of all versions, in order."""
    names = names_in(spark, f"{store.path}/commits")
    return sorted(int(name.removesuffix(".json")) for name in names if name.endswith(".json"))


def version_of(spark: SparkSession, store: Store, number: int | None = None) -> Version | None:
    """A version by its number, the latest one without; None if nothing is stored yet."""
    known = versions(spark, store)
    if number is None:
        if not known:
            return None
        number = known[-1]
    if number not in known:
        raise ValueError(f"there is no version {number}")
    path = _path(spark, f"{store.path}/commits/{number:020d}.json")
    stream = path.getFileSystem(spark._jsc.hadoopConfiguration()).open(path)
    try:
        return Version(**json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
    finally:
        stream.close()


def publish(spark: SparkSession, store: Store, version: Version) -> None:
    """Make a version visible by one rename that fails if its number is taken."""
    staged = _path(spark, f"{store.path}/staged/{uuid.uuid4().hex}.json")
    final = _path(spark, f"{store.path}/commits/{version.number:020d}.json")
    out = staged.getFileSystem(spark._jsc.hadoopConfiguration()).create(staged, False)
    try:
        out.write(bytearray(json.dumps(asdict(version)).encode()))
    finally:
        out.close()
    if not rename_new(spark, staged, final):
        raise Conflict(version.number)


def rename_new(spark: SparkSession, source, target) -> bool:
    """Rename a Hadoop path to one that does not exist; False if it does."""
    conf = spark._jsc.hadoopConfiguration()
    system = source.getFileSystem(conf)
    system.mkdirs(target.getParent())
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), conf)
    no_options = spark._sc._gateway.new_array(getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        context.rename(system.makeQualified(source), system.makeQualified(target), no_options)
    except Py4JJavaError as error:
        if "FileAlreadyExistsException" in error.java_exception.getClass().getName():
            return False
        raise
    return True


#: Files and batches of a new version (None: the batches stay), or None if no new version is needed.
Made = tuple[DataFrame, DataFrame | None] | None


def _commit(
    spark: SparkSession, store: Store, made_by: str, build: Callable[[Version | None], Made]
) -> Version | None:
    """Commit what ``build`` makes of the latest version (files, and batches if they change; None: no
    change is needed), and build anew when another writer was first."""
    for _ in range(TRIES):
        base = version_of(spark, store)
        made = build(base)
        if made is None:
            return base
        files, batches = made
        folder = f"manifests/{uuid.uuid4().hex}"
        files.select(*[c.split()[0] for c in FILES.split(", ")]).write.parquet(f"{store.path}/{folder}/files")
        batch_folder = base.batches if base else ""
        if batches is not None:
            batches.write.parquet(f"{store.path}/{folder}/batches")
            batch_folder = f"{folder}/batches"
        version = Version(base.number + 1 if base else 1, f"{folder}/files", batch_folder, made_by)
        try:
            publish(spark, store, version)
            return version
        except Conflict:
            continue
    raise Conflict(f"{TRIES} tries")


# --- files ---------------------------------------------------------------------------------------


def files_of(spark: SparkSession, store: Store, version: Version | None) -> DataFrame:
    """The files of a version and the ranges in them."""
    if version is None:
        return spark.createDataFrame([], FILES)
    return spark.read.schema(FILES).parquet(f"{store.path}/{version.files}")


def _batches_of(spark: SparkSession, store: Store, version: Version | None) -> DataFrame:
    if version is None or not version.batches:
        return spark.createDataFrame([], "batch string")
    return spark.read.schema("batch string").parquet(f"{store.path}/{version.batches}")


def _write_files(spark: SparkSession, store: Store, rows: DataFrame, parts: int | None = None) -> DataFrame:
    """Write rows as new data files in the order of tenant, date and id, and return their ranges. Without
    a number of ``parts`` AQE merges small ones."""
    keys = [TENANT, "date", "id"]
    rows = rows.select(*store.schema.names)
    dealt = rows.repartitionByRange(parts, *keys) if parts else rows.repartitionByRange(*keys)
    return _write_sorted(spark, store, dealt.sortWithinPartitions(*keys))


def _write_sorted(spark: SparkSession, store: Store, rows: DataFrame) -> DataFrame:
    """Write rows that lie in the order of tenant, date and id as new data files, and return their ranges."""
    folder, keys = f"data/{uuid.uuid4().hex}", [TENANT, "date", "id"]
    rows.select(*store.schema.names).write.option("maxRecordsPerFile", FILE_ROWS).parquet(f"{store.path}/{folder}")
    written = spark.read.schema(store.schema).parquet(f"{store.path}/{folder}")
    ranges = [
        F.count("*").alias("rows"), F.count_if(F.col("date").isNull()).alias("undated"),
        *[f(c).alias(f"{n}_{'tenant' if c == TENANT else c}") for c in keys for n, f in (("min", F.min), ("max", F.max))],
    ]
    # Ranges of texts alone would be aggregated by a sort of all rows by file; with a set beside them (here
    # of nothing, as nulls are left out) they are kept in a hash table that has one entry per file.
    named = written.select(F.col("_metadata.file_name").alias("file"), *keys)
    by_file = named.groupBy("file").agg(*ranges, F.collect_set(F.lit(None).cast("int")).alias("_none"))
    return write_and_read(by_file.withColumn("file", F.concat(F.lit(f"{folder}/"), "file"))).drop("_none")


def _rows(spark: SparkSession, store: Store, files: DataFrame) -> DataFrame:
    """The rows of some files; their names come to the driver, as the files of any scan do."""
    names = [f"{store.path}/{r['file']}" for r in files.select("file").collect()]
    if not names:
        return spark.createDataFrame([], store.schema)
    return spark.read.schema(store.schema).parquet(*names)


def _may_hold(tenants: Iterable[str] | None, start: Day, end: Day) -> Column:
    """Whether a file may hold rows of some tenants and days (both inclusive)."""
    keep = F.lit(True)
    if tenants is not None:
        listed = F.array(*[F.lit(t) for t in tenants]).cast("array<string>")
        keep = keep & F.exists(listed, lambda t: t.between(F.col("min_tenant"), F.col("max_tenant")))
    if as_day(start):
        keep = keep & (F.col("max_date") >= F.lit(as_day(start)))
    if as_day(end):
        keep = keep & (F.col("min_date") <= F.lit(as_day(end)))
    return keep


def version_changes(spark: SparkSession, store: Store, old: int, new: int) -> tuple[DataFrame, DataFrame]:
    """``(removed, added)``: the rows of files that only the old version has, and of files that only the new one
    has. Rows that were only moved to another file are in both; files that both versions have are not read.
    """
    before, after = (files_of(spark, store, version_of(spark, store, n)) for n in (old, new))
    removed, added = before.join(after, "file", "left_anti"), after.join(before, "file", "left_anti")
    return _rows(spark, store, removed), _rows(spark, store, added)


# --- reading and writing -------------------------------------------------------------------------


def read_store(
    spark: SparkSession,
    store: Store,
    tenants: Iterable[str] | DataFrame | None = None,
    start: Day = None,
    end: Day = None,
    version: int | None = None,
) -> DataFrame:
    """Rows of a version (the latest without), of some tenants and days or all. Files outside of these
    are not opened. What is read does not change while others commit."""
    listed = None if tenants is None or isinstance(tenants, DataFrame) else list(tenants)
    files = files_of(spark, store, version_of(spark, store, version)).filter(_may_hold(listed, start, end))
    rows = _rows(spark, store, files)
    for day, keep in ((as_day(start), "__ge__"), (as_day(end), "__le__")):
        if day:
            rows = rows.filter(getattr(F.col("date"), keep)(F.lit(day)))
    if isinstance(tenants, DataFrame):
        return keep_by_key(rows, tenants, BY)
    return rows if listed is None else rows.filter(F.col(TENANT).isin(listed))


def derived_ids(rows: DataFrame, batch: str) -> DataFrame:
    """``rows`` with an id made of the batch, all values of the row and a number among equal rows, so that
    the same batch gives the same ids however it is partitioned. Equal rows are counted, not gathered."""
    return _copies(_counted(rows, batch))


def _counted(rows: DataFrame, batch: str) -> DataFrame:
    """Distinct rows with a ``_digest`` of the batch and their values (128 bits of a SHA-256, made once per
    distinct row), each standing for the equal rows of the numbers ``_first`` to ``_last``, a bounded many."""
    columns = rows.columns
    counted = rows.groupBy(*columns).agg(F.count("*").alias("_n"))
    content = F.to_json(F.struct(F.lit(batch).alias("batch"), F.struct(*columns).alias("row")), {"ignoreNullFields": "false"})
    named = counted.withColumn("_digest", F.left(F.sha2(content, 256), F.lit(32)))
    numbered = named.withColumn("_first", F.explode(F.sequence(F.lit(1).cast("bigint"), "_n", F.lit(COPIES).cast("bigint"))))
    return numbered.withColumn("_last", F.least(F.col("_first") + COPIES - 1, "_n")).drop("_n")


def _copies(counted: DataFrame) -> DataFrame:
    """The rows that counted ones stand for, with ids that sort as digest and number do."""
    rows = counted.withColumn("_k", F.explode(F.sequence("_first", "_last")))
    number = F.lpad(F.col("_k").cast("string"), 12, "0")
    return rows.withColumn("id", F.concat_ws("-", "_digest", number)).drop("_digest", "_first", "_last", "_k")


def _write_with_ids(spark: SparkSession, store: Store, rows: DataFrame, batch: str, tenant: str | None) -> DataFrame:
    """Write rows with derived ids as :func:`_write_files` does. Counted rows are moved and sorted, and become
    copies with ids, which lie in the same order, where they are written."""
    counted = _counted(rows, batch)
    if tenant is not None:
        counted = counted.withColumn(TENANT, F.lit(tenant))
    kinds = {f.name: f.dataType for f in store.schema.fields}
    order = [F.col(c).cast(kinds[c]) for c in (TENANT, "date")] + [F.col("_digest"), F.col("_first")]
    dealt = counted.repartitionByRange(*order).sortWithinPartitions(*order)
    return _write_sorted(spark, store, append_rows(spark.createDataFrame([], store.schema), _copies(dealt)))


def append_batch(spark: SparkSession, store: Store, rows: DataFrame, batch: str, tenant: str | None = None) -> Version:
    """Add the rows of a batch, once: a batch that was committed before changes nothing.

    Rows without an ``id`` get one from the batch and their values (see :func:`derived_ids`). A job that
    failed may be run again with the same batch. Two jobs that append the same batch at a time add it
    once, as the later one finds it committed when it tries again.
    """
    written = None

    def build(base: Version | None):
        nonlocal written
        batches = _batches_of(spark, store, base)
        if not batches.filter(F.col("batch") == batch).isEmpty():
            return None
        if written is None:  # a second try adds the files that the first one wrote
            if "id" in rows.columns:
                written = _write_files(spark, store, append_rows(spark.createDataFrame([], store.schema), rows, tenant))
            else:
                written = _write_with_ids(spark, store, rows, batch, tenant)
        files = files_of(spark, store, base).unionByName(written)
        return files, batches.unionAll(spark.createDataFrame([(batch,)], "batch string"))

    return _commit(spark, store, f"append {batch}", build)


def change_store(spark: SparkSession, store: Store, changes: DataFrame) -> Version | None:
    """Apply a change set (see :func:`apply_changes`) as one version. Only files that hold a changed record
    are rewritten; inserted records go to new files. Files that cannot hold a changed tenant are not
    opened."""
    changes = write_and_read(changes)
    keys = write_and_read(changes.select(*KEY).distinct())

    def build(base: Version | None):
        files = files_of(spark, store, base)
        tenants = [r[0] for r in keys.select(TENANT).distinct().limit(LISTED_TENANTS + 1).collect()]
        likely = files
        if len(tenants) <= LISTED_TENANTS:
            likely = files.filter(_may_hold([t for t in tenants if t is not None], None, None))
        touched = _touched(spark, store, likely, keys)  # a written table
        old = _rows(spark, store, touched)
        written = _write_files(spark, store, apply_changes(old, changes, store.spec))
        if touched.isEmpty() and written.isEmpty():
            return None
        return files.join(touched, "file", "left_anti").unionByName(written), None

    return _commit(spark, store, "change", build)


def _touched(spark: SparkSession, store: Store, files: DataFrame, keys: DataFrame) -> DataFrame:
    """Names of the files that hold a record of ``keys``."""
    name = F.array_join(F.slice(F.split(F.col("_metadata.file_path"), "/"), -3, 3), "/")
    names = [f"{store.path}/{r['file']}" for r in files.select("file").collect()]
    if not names:
        return spark.createDataFrame([], "file string")
    rows = spark.read.schema(store.schema).parquet(*names).select(*KEY, name.alias("file"))
    return write_and_read(rows.join(keys, list(KEY), "left_semi").select("file").distinct())


def clear_store(spark: SparkSession, store: Store, tenants: Iterable[str]) -> Version | None:
    """Remove all rows of some tenants as one version."""
    listed = list(tenants)

    def build(base: Version | None):
        files = files_of(spark, store, base)
        holds = write_and_read(files.filter(_may_hold(listed, None, None)))
        if holds.isEmpty():
            return None
        # A file of one tenant is dropped unread; of others the remaining rows are written again.
        mixed = holds.filter(F.col("min_tenant") != F.col("max_tenant"))
        rest = _rows(spark, store, mixed).filter(~F.col(TENANT).isin(listed))
        return files.join(holds.select("file"), "file", "left_anti").unionByName(_write_files(spark, store, rest)), None

    return _commit(spark, store, "clear", build)


def compact_store(spark: SparkSession, store: Store, rows: int = FILE_ROWS) -> Version | None:
    """Merge small files, those with less than half of ``rows``, into files of about ``rows`` each that do
    not overlap. Larger files are not opened, and the rows stay as they are. A version whose small files
    are no more than the merged ones would be stays too.
    """

    def build(base: Version | None):
        files = files_of(spark, store, base)
        few = write_and_read(files.filter(F.col("rows") < rows * SMALL_PART))
        many, total = few.agg(F.count("*"), F.coalesce(F.sum("rows"), F.lit(0))).first()
        parts = -(-total // rows)
        if many <= max(1, parts):
            return None
        written = _write_files(spark, store, _rows(spark, store, few), parts)
        return files.join(few.select("file"), "file", "left_anti").unionByName(written), None

    return _commit(spark, store, "compact", build)
