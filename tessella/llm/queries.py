"""The ten operators as queries over the driver's tables; each takes (spark, sf_dir)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import licenses, line_dedup, media, mixing, near_dedup, neighbours, oracles, pieces, quality, repeats, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digests(table(spark, sf_dir, "documents"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op5_transport_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digests(media.store_texts(table(spark, sf_dir, "documents")))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select("doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), F.col("_taken").alias("taken"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), exact_bytes=line_dedup.EXACT_BYTES)
    return out.select("doc_id", F.col("_line_n").alias("n_lines"), F.col("_line_removed").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_near_dedup, op2_quality, op3_repeats, op4_licenses, op5_transport_streams, op6_mixing, op7_line_dedup, op8_pieces, op9_warc, op10_neighbours)}

ORACLES: dict[str, str] = {
    "op1_near_dedup": oracles.NEAR_SQL,
    "op3_repeats": oracles.REPEATS_SQL,
    "op4_licenses": oracles.licenses_sql(licenses.PHRASES, [(label, licenses.plain_words(text)) for label, text in licenses.BODIES], licenses.DRIFT, licenses.COVER),
    "op6_mixing": oracles.MIXING_SQL,
    "op7_line_dedup": oracles.LINES_SQL,
    "op9_warc": oracles.WARC_SQL,
}
