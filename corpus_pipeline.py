"""Cleaning a corpus of documents for training, stage by stage.

1. ``language_id`` learns from the documents' languages and drops documents
   without a letter, and those whose calibrated score is under ``LEAST_SCORE``.
2. ``line_dedup`` removes the later of matching lines from the texts; a
   document that had lines and keeps none goes.
3. ``near_dedup`` keeps the first document of each group of near-duplicates
   (five-word shingles, similarity .8 or more); of rows that repeat the same id
   and text one stays.
4. ``decontaminate`` drops documents that give away a benchmark item.
5. ``packing`` cuts and packs what is left into sequences of 2048 tokens.

Each stage works on all rows that the one before kept and, but for the last,
returns the columns of its input. Null, empty and very long texts, repeated
rows, null ids, empty tables and extra columns are defined by the operators'
docstrings; documents with empty texts are dropped by the first stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohort_spark.llm.decontaminate import contaminated
from cohort_spark.llm.frames import written
from cohort_spark.llm.lang_id import identify
from cohort_spark.llm.line_dedup import dedup_lines
from cohort_spark.llm.minhash import near_duplicates
from cohort_spark.llm.packing import pack

#: Calibrated probability under which a document's language is not told.
LEAST_SCORE = 0.4


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = identify(docs, F.lit(True), carry=True)
    return out.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select("row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = dedup_lines(docs).where("n_lines = 0 or n_removed < n_lines")
    # the length follows the text
    return out.select(*[F.col("text") if c == "text" else F.length("text").cast(t).alias(c) if c == "n_chars" else F.col(f"row.`{c}`")
                        for c, t in docs.dtypes])


def _fresh(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` does not have."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` without the rows that ``gone`` names by doc_id and text_hash."""
    ids, hashes = _fresh(docs, "gone_id"), _fresh(docs, "gone_hash")
    gone = gone.select(F.col("doc_id").alias(ids), F.col("text_hash").alias(hashes)).distinct()
    return docs.join(gone, F.col("doc_id").cast("bigint").eqNullSafe(F.col(ids)) & (F.xxhash64(F.col("text").cast("string")) == F.col(hashes)), "left_anti")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = written(near_duplicates(docs, shingle=5, threshold=80), "near")
    out = _without(docs, found.where("not stays"))
    kept = found.where("stays and n_shingles > 0").groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n"))
    if not kept.where("n > 1").isEmpty():  # rows that repeat id and text: one stays
        repeat = _fresh(docs, "repeat_")
        row = Window.partitionBy("doc_id", F.xxhash64(F.col("text").cast("string"))).orderBy(*[F.col(f"`{c}`").cast("string") for c in docs.columns if c != "text"])
        wordless = ~F.coalesce(F.col("text").cast("string"), F.lit("")).rlike(r"[^ \t\n\x0B\f\r]")
        out = out.withColumn(repeat, F.row_number().over(row)).where((F.col(repeat) == 1) | wordless).drop(repeat)
    return out


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet")
    return _without(docs, written(contaminated(docs, benchmark).select("doc_id", "text_hash"), "leaks"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs)


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("packing", packing)]

#: Language identification and packing have no restatement in SQL; the tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of ``sf_dir``, each written and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
