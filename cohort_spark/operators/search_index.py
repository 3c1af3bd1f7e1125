"""Substring index for the free-text searches.

The case-folded text of each search column is cut into its distinct runs of
three characters; a posting is (run, column, row). A query looks its own runs
up, keeps the rows that hold all of them in one column, and confirms these on
the text itself, so the result is that of the scan. Postings are written by hash
buckets of the run, a run of very many rows over several files; a query opens
the buckets of its runs only. Queries of fewer than three characters have no
runs and scan the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules as R
from .cohorts import SEARCH_COLUMNS, search_predicate

RUN = 3
BUCKETS = 64
#: Files of a bucket at most.
SPREAD = 8


def _runs(text: Column) -> Column:
    """Distinct runs of a text; none for shorter ones."""
    n = F.length(text)
    each = F.transform(F.sequence(F.lit(1), F.greatest(n - RUN + 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(RUN)))
    return F.when(n >= RUN, F.array_distinct(each)).otherwise(F.array().cast("array<string>"))


def _bucket(run: Column) -> Column:
    return F.pmod(F.xxhash64(run), F.lit(BUCKETS)).cast("int")


def build_index(df: DataFrame, path: str, columns: tuple[str, ...] = SEARCH_COLUMNS) -> None:
    """Write the rows (with a row number ``_row``) and the postings of ``columns`` under ``path``."""
    df.withColumn("_row", F.monotonically_increasing_id()).write.mode("overwrite").parquet(f"{path}/rows")
    rows = df.sparkSession.read.parquet(f"{path}/rows")  # numbered once and for all
    texts = [F.struct(F.lit(c).alias("column"), F.lower(R.c(c).cast("string")).alias("text")) for c in columns if c in df.columns]
    each = rows.select("_row", F.explode(F.array(*texts)).alias("t")).select("_row", "t.column", "t.text").where("text is not null")
    postings = each.select("_row", "column", F.explode(_runs(F.col("text"))).alias("run"))
    postings = postings.withColumn("bucket", _bucket(F.col("run")))
    (postings.repartition("bucket", F.pmod(F.xxhash64("_row"), F.lit(SPREAD))).sortWithinPartitions("bucket", "run")
     .write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings"))


def candidates(spark: SparkSession, path: str, q: str, columns: tuple[str, ...]) -> DataFrame | None:
    """``_row`` of the rows that hold all runs of ``q`` in one of ``columns``; None for a query without runs."""
    runs = sorted({q[i: i + RUN] for i in range(len(q) - RUN + 1)})
    if not runs:
        return None
    # one row a run of the query
    buckets = sorted({r["b"] for r in spark.createDataFrame([(r,) for r in runs], "run string").select(_bucket(F.col("run")).alias("b")).collect()})
    found = spark.read.parquet(f"{path}/postings").where(F.col("bucket").isin(buckets) & F.col("run").isin(runs) & F.col("column").isin(*columns))
    return found.groupBy("_row", "column").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(runs)).select("_row").distinct()


def indexed_rows(spark: SparkSession, path: str, q: str, columns: tuple[str, ...] = SEARCH_COLUMNS) -> DataFrame:
    """Rows in which ``q`` (trimmed, any case) is part of one of ``columns``; all rows for an empty query."""
    rows, qn = spark.read.parquet(f"{path}/rows"), q.strip().lower()
    found = candidates(spark, path, qn, columns)
    if found is not None:
        rows = rows.join(found, "_row", "left_semi")
    return (rows.where(search_predicate(rows, q, columns)) if qn else rows).drop("_row")
