"""The corpus pipeline: toxicity, line dedup, near-dedup, decontamination, mixing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; ``run`` writes each stage's result as
Parquet in the shared folder and gives it to the next.  All stages but the last return the columns of
``documents``.  The stages fit models and cluster texts, which SQL cannot express: ``ORACLE_SQL`` is None
and each stage is tested against a plain version on a small table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larmor.llm import decontaminate, linededup, mixing, simhash, toxicity
from larmor.llm.common import crc32_of, materialize, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.5; learned from labelled rows outside the held-out fifth."""
    labels = table(spark, sf_dir, "labels").where(crc32_of("doc_id") % 5 != 0)
    return toxicity.reject(docs, toxicity.fit(docs, labels))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its text reduced to the lines that stay; ``n_chars`` follows the text.

    A document all of whose lines went keeps its row, with an empty text.
    """
    return linededup.dedup(docs).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of linked fingerprints one row stays: that of the smallest id, rows without an id last.

    Rows that share the id are told apart by their text's hash, and rows alike in both by all their columns, so
    that exactly one row of a component is left whatever ids repeat or are null.
    """
    keyed = docs.withColumn("__row", F.struct(F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("d"), F.xxhash64("text").alias("t")))
    numbered = keyed.withColumn("__fp", F.xxhash64("__row"))
    # Each (id, text) is a document of the index under a number of its own.
    groups = simhash.near_duplicates(numbered.select(F.col("__fp").alias("doc_id"), "text")).select("doc_id", "component_id").distinct()
    groups = groups.join(numbered.select(F.col("__fp").alias("doc_id"), F.col("__row").alias("at")).distinct(), "doc_id")
    best = groups.groupBy("component_id").agg(F.min(F.struct("at", "doc_id")).alias("best")).select(F.col("best.doc_id").alias("__fp"))
    return numbered.join(best, "__fp", "left_semi").dropDuplicates(["__fp"]).select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that benchmark passages do not cover by a twentieth of their words or more.

    A decision belongs to a row's id and text: rows without an id are judged like all others, and of rows that
    repeat an id those with clean texts stay.
    """
    keyed = docs.withColumn("__key", F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text"))
    asked = keyed.select(F.col("__key").alias("doc_id"), "text")
    found = decontaminate.contamination(asked, table(spark, sf_dir, "benchmark"))
    bad = found.where("contaminated").select(F.col("doc_id").alias("__key")).distinct()
    return keyed.join(bad, "__key", "left_anti").select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's size, its source's target and the words that the mix takes of it."""
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "copies", "taken")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("simhash_near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
