"""The registered queries of the training-data operators, each over the whole of its table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabwright.llm import chunk_coding, fingerprints, licenses, packing, pii, quality, secrets, sharding, simhash, url_filters
from tabwright.llm.oracles import license_sql, quality_sql, url_filter_sql
from tabwright.llm.spans import digest_of


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: A dated list of hosts and paths: (entry, action, date).
URL_LIST_EVENTS = (
    ("spam-farm.example.org", "block", "2024-02-01"),
    ("cheap-pills.example.com", "block", "2024-01-15"),
    ("cheap-pills.example.com", "remove", "2024-06-01"),
    ("cheap-pills.example.com", "block", "2024-09-01"),
    ("example.net", "block", "2024-10-15"),
    ("blog.ththan.example.net", "allow", "2024-11-01"),
    ("blog.ththan.example.net", "remove", "2024-12-01"),
    ("ththed.example.org", "block", "2024-03-10"),
    ("ththed.example.org/en", "allow", "2024-05-20"),
    ("www.therti.example.org", "block", "2024-07-07"),
)


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages with a time of fetching, which they lack: a day of 2024 from the page's id."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return pages.withColumn("fetched_at", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") * 37 % 366).cast("int")))


def op1_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    prints = fingerprints.fingerprint_edits(documents(spark, sf_dir))
    return prints.select("doc_id", "n_chars", F.sha2(F.col("edited_text").cast("binary"), 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def _counted(spans: str, kinds: tuple[str, ...]) -> list:
    return [F.size(F.filter(F.col(spans)["kind"], lambda k: k == F.lit(kind))).cast("long").alias(f"n_{kind}") for kind in kinds]  # noqa: B023  evaluated at once


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.personal_data(documents(spark, sf_dir))
    return found.select("doc_id", *_counted("base", pii.KINDS), F.sha2(digest_of(F.col("base")).cast("binary"), 256).alias("base_sha256"), digest_of(F.col("spans")).alias("spans"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(documents(spark, sf_dir))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(documents(spark, sf_dir))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(documents(spark, sf_dir))
    return found.select("doc_id", *_counted("base", secrets.KINDS[:3]), F.sha2(digest_of(F.col("base")).cast("binary"), 256).alias("base_sha256"), digest_of(F.col("spans")).alias("spans"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = chunk_coding.encode(documents(spark, sf_dir), decoded=True)
    return coded.select(
        "doc_id",
        F.expr("octet_length(ids) div 4").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.createDataFrame([(e, a, d) for e, a, d in URL_LIST_EVENTS], "entry string, action string, since string")
    return url_filters.filter_urls(captures(spark, sf_dir), events.withColumn("since", F.col("since").cast("date")))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = quality.quality_report(documents(spark, sf_dir))
    return report.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.document_shards(documents(spark, sf_dir), shards=8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")


QUERIES = {
    "op1_merkle": op1_merkle,
    "op2_pii": op2_pii,
    "op3_licenses": op3_licenses,
    "op4_packing": op4_packing,
    "op5_secrets": op5_secrets,
    "op6_bpe": op6_bpe,
    "op7_url_filters": op7_url_filters,
    "op8_simhash": op8_simhash,
    "op9_quality": op9_quality,
    "op10_sharding": op10_sharding,
}

#: The others need hashes, tokenizers or iteration; the tests hold them against plain Python.
ORACLES: dict[str, str] = {
    "op3_licenses": license_sql(licenses.TEMPLATES, licenses.PHRASES),
    "op7_url_filters": url_filter_sql(URL_LIST_EVENTS),
    "op9_quality": quality_sql(quality.QualityRules()),
}
