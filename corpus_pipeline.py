"""A training corpus from raw documents: five stages, each one operator over all that the last one kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of documents.

Defined cases, stage by stage. Extra columns pass through all stages but the last, whatever their
names: what a stage adds for itself has a name that docs does not use. Empty tables stay empty.
Quality: null and empty texts are scored like others; texts of any length are scored whole; ties at
the cut are kept; repeated rows fare alike. Line dedup: rows with null or empty texts stay; a document
that held text and of which nothing is left goes. Near-dedup: of repeated rows (equal id and text) one
stays; of rows with equal ids and other texts each stays with the id; rows with a null id or without
words stay. Mixing: documents of no words go (there is nothing to take); repeated rows are documents
by themselves. Encoding: null texts have null ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.llm import line_dedup, mixing, near_dedup, pieces, quality
from tessella.llm.shared import cut, held, unused

NEAR_PERCENT = 80  # similarity of word 5-shingles from which documents are near-duplicates
NEAR_BANDS, NEAR_ROWS = 40, 6  # a link of 0.80 misses all bands with chance 1e-6


def with_n_chars(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model rejects go; it is fitted on their labels."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    own = unused(docs.columns, ("score",))["score"]
    return quality.scored(docs, model, "text", name=own).where(F.col(own) >= quality.THRESHOLD).select(docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that stand (nearly) elsewhere go; documents of which nothing is left go with them."""
    out, own = line_dedup.dedup_lines(docs, exact_bytes=line_dedup.EXACT_BYTES), line_dedup.added(docs)
    empty = (F.col(own["line_removed"]) > 0) & (F.regexp_count(F.coalesce("text", F.lit("")), F.lit("[^\\x20\\x09-\\x0D]")) == 0)
    return with_n_chars(out.where(~empty).select(docs.columns))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-duplicate documents the one with the smallest id stays; of repeated rows, one."""
    kept = near_dedup.near_duplicates(docs, percent=NEAR_PERCENT, bands=NEAR_BANDS, rows=NEAR_ROWS).where("kept and doc_id is not null").select("doc_id").distinct()
    own = unused(docs.columns, ("row_number",))["row_number"]
    one = Window.partitionBy("doc_id", F.xxhash64("text"), F.hash("text")).orderBy(F.lit(0))
    out = docs.join(kept, "doc_id", "left_semi").withColumn(own, F.row_number().over(one)).where(F.col(own) == 1)
    return out.select(docs.columns).union(docs.where("doc_id is null"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source's target weight of words; a document taken twice or three times is that many rows."""
    out, own = mixing.mix(docs), mixing.added(docs)
    times = F.floor(F.col(own["taken"]) / F.greatest(own["size"], F.lit(1)) + 0.5).cast("int")
    rows = out.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), times.alias("times")).where("times > 0")
    return rows.select("row", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("time")).select("row.*")


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids with merge-dropout, and the text that they decode to."""
    out = pieces.encode(docs.select("doc_id", "source", "text"), decoded="text")
    return out.select("doc_id", "source", F.size("ids").alias("n_pieces"), "ids", "text")


STAGES = [
    ("quality classifier", keep_quality),
    ("line dedup", drop_repeated_lines),
    ("MinHash near-dedup", keep_one_of_each_group),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding and decoding", encode_pieces),
]

#: Trained scores and keyed segmentation have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), held()
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), "stage", before)  # what the stages before have written goes
    return STAGES[-1][1](spark, docs, sf_dir)
