"""The operators on the given tables, one registered query each, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillbook.llm import (
    decontaminate, embeddings, jaccard, licenses, mixing, quality, search, secrets, sharding, spelling, tokens, toxicity, urls,
)
from tillbook.llm.common import utf8_bytes
from tillbook.sources import write_and_read

#: The rules of the url query.
URL_RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def op1_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    """Words the mix takes of every document."""
    plan = mixing.mix_plan(_documents(spark, folder).select("doc_id", "text", "source"))
    return plan.select(
        F.col("doc.doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken")
    )


def op2_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark items that documents contain."""
    benchmark = spark.read.parquet(f"{folder}/benchmark.parquet")
    leaks = decontaminate.find_leaks(_documents(spark, folder), benchmark)
    return leaks.select("doc_id", "item_id", "n_windows", "n_shared", "exact")


def op3_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Spans of secrets in every document."""
    found = secrets.scan_secrets(_documents(spark, folder).select("doc_id", "text"))
    kinds = [name for name, *_ in secrets.BASE]
    return found.select(
        "doc_id",
        *[F.size(k).cast("bigint").alias(f"n_{k}") for k in kinds],
        F.sha2(secrets.span_digest(*kinds), 256).alias("base_sha256"),
        secrets.span_digest(*kinds, secrets.ENTROPY).alias("spans"),
    )


def op4_near_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Links, component and survivor of every vector."""
    return embeddings.link_vectors(spark.read.parquet(f"{folder}/embeddings.parquet"))


def op5_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Verdict on every page's url."""
    pages = spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "url")
    judged = urls.filter_urls(pages, URL_RULES)
    return judged.select(F.col("page.page_id"), "host", "path", "rule", "verdict")


def op6_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of every document."""
    docs = _documents(spark, folder).select("doc_id", "text")
    model = toxicity.fit_documents(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    tagged = toxicity.tag_documents(docs, model)
    places = F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["end"]))
    return tagged.select(
        F.col("row.doc_id"),
        quality.held_out(F.col("row.doc_id"), 4, 2).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
        F.array_join(places, ",").alias("spans"),
    )


def op7_shard(spark: SparkSession, folder: str) -> DataFrame:
    """Shard and slot of every document."""
    docs = _documents(spark, folder)
    text = F.col("text")
    rows = docs.select(
        "doc_id",
        (utf8_bytes(text) + 16).alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        sharding.copy_key(text, F.col("doc_id")).alias("key"),
    )
    placed = sharding.shard_rows(rows, F.col("key"), F.col("size"), shards=40)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op8_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    """Component of every document."""
    linked = jaccard.linked_documents(_documents(spark, folder))
    return linked.select("doc_id", "n_shingles", "component_id")


def op9_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Quality of every document."""
    docs = _documents(spark, folder).select("doc_id", "text")
    known = quality.held_out(F.col("row.doc_id")).alias("held_out")
    stats = write_and_read(quality.with_statistics(docs).select(F.col("row.doc_id"), known, "stats"))
    rows = quality.training_rows(
        spark.read.parquet(f"{folder}/labels.parquet"),
        ~quality.held_out(F.col("doc_id")), "quality", quality.MAX_TRAINING_ROWS,
    )
    training = write_and_read(stats.join(rows, "doc_id").select("stats", "label"))
    scored = stats.withColumn("score", quality.fit(training).score(F.col("stats")))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op10_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Licences in every document."""
    found = licenses.scan_licenses(_documents(spark, folder).select("doc_id", "text"))
    return found.select(
        "doc_id",
        F.size("sentences").cast("bigint").alias("n_sentences"),
        F.array_join("sentences", ";").alias("sentences"),
        F.array_join("licenses", ";").alias("licenses"),
    )


def op11_spelling(spark: SparkSession, folder: str) -> DataFrame:
    """Spelling variants among the words of all documents."""
    return spelling.spelling_variants(_documents(spark, folder))


def op12_search(spark: SparkSession, folder: str) -> DataFrame:
    """The ten best documents for every benchmark item."""
    return search.search(_documents(spark, folder), spark.read.parquet(f"{folder}/benchmark.parquet"), k=10)


def op13_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of every document, and whether there are more than 512."""
    import public_tokenizers

    return tokens.token_report(_documents(spark, folder), public_tokenizers.path("byte_bpe_50k.json"), limit=512)


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_mix_sources, op2_decontaminate, op3_secret_scan, op4_near_vectors, op5_url_filter,
        op6_toxicity, op7_shard, op8_jaccard_join, op9_quality, op10_license_scan,
        op11_spelling, op12_search, op13_token_counts,
    )
    return {f.__name__: f for f in found}
