"""Ledgers, uploads and change sets derived from warehouse tables of orders and their lines.

These feed the registered queries. Nothing is broadcast by hint: Catalyst picks each join from the
sizes of the tables. Columns a query does not use are pruned from the scans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillbook.spec import EXPENSES, SALES, TENANT, LedgerSpec


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines with their order, customer and the shared ledger columns.

    Orders meet their customers first, so that the far more numerous lines move once less.
    """
    line, orders, customer = (_table(spark, folder, t) for t in ("lineitem", "orders", "customer"))
    owned = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
    joined = line.join(owned, F.col("l_orderkey") == F.col("o_orderkey"))
    quantity = F.col("l_quantity").cast("int").cast("string")
    keys = [F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]
    return joined.withColumns(
        {
            TENANT: F.concat(F.lit("t"), F.col("c_nationkey").cast("string")),
            "id": F.concat_ws("-", *keys, quantity),
            "_price": F.col("l_extendedprice").cast("decimal(18,2)"),
        }
    )


def _sales_lines(spark: SparkSession, folder: str) -> DataFrame:
    return _lines(spark, folder).join(
        _table(spark, folder, "part"), F.col("l_partkey") == F.col("p_partkey")
    )


def _expense_lines(spark: SparkSession, folder: str) -> DataFrame:
    return _lines(spark, folder).join(
        _table(spark, folder, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")
    )


def _dated(day: str) -> Column:
    return F.when(F.col("l_quantity") != 50, F.col(day).cast("date"))


def _category(c: str) -> Column:
    """Blank for returned lines and for all lines of one tenant."""
    blank = (F.col("l_returnflag") == "R") | (F.col("c_nationkey") == 7)
    return F.when(blank, F.lit("")).otherwise(F.col(c))


def sales_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """Parts as products, priced lines as sales; lines of quantity 50 have no date."""
    return _sales_lines(spark, folder).select(
        TENANT,
        "id",
        _dated("o_orderdate").alias("date"),
        F.col("p_name").alias("product"),
        F.col("_price").alias("sales"),
        _category("p_type").alias("category"),
    )


def expense_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """Suppliers as vendors, discounts as amounts."""
    return _expense_lines(spark, folder).select(
        TENANT,
        "id",
        _dated("l_shipdate").alias("date"),
        F.col("s_name").alias("vendor"),
        (F.col("_price") * F.col("l_discount").cast("decimal(4,2)")).alias("amount"),
        _category("l_linestatus").alias("category"),
    )


def _raw(lines: DataFrame, spec: LedgerSpec, day: str, party: str, category: str) -> DataFrame:
    """Ledger lines as an untidy upload: every value is text, dates are spelled in many ways, some
    values are unusable and some rows are empty.
    """
    quantity, price = F.col("l_quantity"), F.col("_price").cast("string")
    date = (
        F.when(quantity == 50, "not a date")
        .when(quantity == 49, F.date_format(day, "MM/dd/yyyy"))
        .when(quantity == 48, F.date_format(day, "d-MMM-yy"))
        .when(quantity == 47, F.date_format(day, "yyyy-MM-dd'T'10:00:00'Z'"))
        .when(quantity == 46, F.date_format(day, "M/d/yyyy 0:00"))
        .when(quantity == 45, F.date_format(day, "MMMM d, yyyy"))
        .when(quantity == 44, F.date_format(day, "yyyy.MM.dd"))
        .otherwise(F.date_format(day, "yyyy-MM-dd"))
    )
    amount = (
        F.when(quantity == 1, "n/a")
        .when(quantity == 2, F.concat(F.lit("₵"), price))
        .when(quantity == 3, "")
        .when(quantity == 6, "1,234")
        .when(quantity == 7, F.concat(F.lit(" "), price, F.lit(" ")))
        .when(quantity == 8, "1d")
        .when(quantity == 9, F.concat(F.lit("-"), price))
        .otherwise(price)
    )
    name = (
        F.when(quantity == 4, "   ").when(quantity == 5, "NA").when(quantity == 42, "\t").otherwise(F.col(party))
    )
    filled = quantity != 43
    return lines.select(
        TENANT,
        "id",
        F.when(filled, date).alias("date"),
        F.when(filled, name).alias(spec.party),
        F.when(filled, amount).alias(spec.amount),
        F.when(filled & (F.col("l_returnflag") != "R"), F.col(category)).alias("category"),
    )


def raw_sales(spark: SparkSession, folder: str) -> DataFrame:
    return _raw(_sales_lines(spark, folder), SALES, "o_orderdate", "p_name", "p_type")


def raw_expenses(spark: SparkSession, folder: str) -> DataFrame:
    return _raw(_expense_lines(spark, folder), EXPENSES, "l_shipdate", "s_name", "l_linestatus")


def goals(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    """Sales targets or expense budgets: one row per nation, a quarter of them not set."""
    step = {"target": 1e8, "budget": 5e6}[kind]
    key = F.col("n_nationkey")
    return _table(spark, folder, "nation").select(
        F.concat(F.lit("t"), key.cast("string")).alias(TENANT), (F.lit(step) * (key % 4)).alias("goal")
    )


def _quoted(c: str) -> Column:
    """CSV field in quotes; null is an empty field."""
    text = F.replace(F.col(c), F.lit('"'), F.lit('""'))
    return F.coalesce(F.concat(F.lit('"'), text, F.lit('"')), F.lit(""))


def uploads(spark: SparkSession, folder: str) -> DataFrame:
    """Every raw sale as a small base64 upload, in two column layouts, with blank lines, a byte that
    is not UTF-8 in some product names, upper-case file endings and some refused file types.
    """
    raw = raw_sales(spark, folder)
    kind = F.split_part("id", F.lit("-"), F.lit(1)).cast("bigint") % 4
    name = F.replace(F.coalesce("product", F.lit("")), F.lit('"'), F.lit('""'))
    start = F.concat(_quoted("date"), F.lit(',"'), name)
    end = F.concat(_quoted("sales"), F.lit(","), _quoted("category"))
    plain, moved = kind % 2 == 0, kind % 2 == 1
    before = F.when(plain, F.concat(F.lit("date,product,sales,category\n\n"), start)).when(
        moved, F.concat(F.lit(' SALES ,Category,note,"Date",Product\r\n'), end, F.lit(",x,"), start)
    )
    after = F.when(plain, F.concat(F.lit('",'), end, F.lit("\n"))).when(moved, F.lit('"\r\n \r\n'))
    noise = F.unhex(F.when(kind == 2, "FF").otherwise(""))
    ending = F.when(F.col("category").isNull(), ".txt").when(kind == 3, ".CSV").otherwise(".csv")
    payload = F.concat(F.encode(before, "UTF-8"), noise, F.encode(after, "UTF-8"))
    return raw.select(
        TENANT,
        F.concat("id", ending).alias("filename"),
        F.concat(F.lit("data:text/csv;base64,"), F.base64(payload)).alias("contents"),
    )


def entries(spark: SparkSession, folder: str) -> DataFrame:
    """Raw sales as manual entries: dates as text, amounts as numbers, names with outer space."""
    raw = raw_sales(spark, folder)
    return raw.select(
        TENANT,
        "id",
        "date",
        F.concat(F.lit(" "), F.col("product"), F.lit("\t")).alias("product"),
        F.col("sales").try_cast("double").alias("sales"),
        F.col("category"),
    )


def changes(spark: SparkSession, folder: str) -> DataFrame:
    """A change set over the sales ledger: each line's quantity decides what happens to its record,
    some records change twice, and some changes name a tenant that does not own the record.
    """
    line = _sales_lines(spark, folder)
    quantity = F.col("l_quantity").cast("int")
    step = lambda op, seq, suffix="": F.struct(
        F.lit(op).alias("op"), F.lit(seq).cast("bigint").alias("seq"), F.lit(suffix).alias("suffix")
    )
    steps = (
        F.when(quantity <= 5, F.array(step("update", 1)))
        .when(quantity <= 8, F.array(step("delete", 1)))
        .when(quantity <= 10, F.array(step("update", 1), step("delete", 2)))
        .when(quantity <= 12, F.array(step("delete", 1), step("update", 2)))
        .when(quantity <= 14, F.array(step("delete", 1), step("insert", 2)))
        .when(quantity <= 16, F.array(step("insert", 1, "-new")))
        .when(quantity == 17, F.array(step("insert", 1, "-new"), step("update", 2, "-new")))
        .when(quantity == 18, F.array(step("update", 1, "-none")))
        .when(quantity == 19, F.array(step("delete", 1)))
    )
    owner = F.when(quantity == 19, F.lit("someone else")).otherwise(F.col(TENANT))
    return (
        line.withColumn(TENANT, owner)
        .select("*", F.inline(steps))
        .select(
            TENANT,
            F.concat("id", "suffix").alias("id"),
            "op",
            "seq",
            F.date_add(_dated("o_orderdate"), F.col("seq").cast("int")).alias("date"),
            F.concat("p_name", F.lit(" v"), F.col("seq").cast("string")).alias("product"),
            (F.col("_price") + F.col("seq")).cast("decimal(18,2)").alias("sales"),
            F.lit("changed").alias("category"),
        )
    )
