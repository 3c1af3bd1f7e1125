"""Snapshots clustered by key.

The rows are kept as a table bucketed and sorted by the trimmed key, with a
Parquet bloom filter on it. A lookup opens one bucket of it, and a join with
requests moves the requests only: the stored side is read bucket by bucket as
it lies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules as R
from ..operators.normalize import first_per_key
from ..profile import DEFAULT, Profile


def write_keyed(df: DataFrame, name: str, path: str, buckets: int = 16, prof: Profile = DEFAULT) -> DataFrame:
    """Write ``df`` as the table ``name`` under ``path``, clustered by the trimmed key."""
    key = prof.key
    keyed = df.withColumn(key, F.trim(R.c(key).cast("string")))
    (keyed.repartition(buckets, R.c(key)).write.mode("overwrite").option("path", path)
     .option(f"parquet.bloom.filter.enabled#{key}", "true").bucketBy(buckets, key).sortBy(key).saveAsTable(name))
    return df.sparkSession.table(name)


def lookup(spark: SparkSession, name: str, key: str, prof: Profile = DEFAULT) -> DataFrame:
    """P6 on the store: the rows of one key."""
    return spark.table(name).where(R.c(prof.key) == F.lit(key.strip()))


def _wanted(req: DataFrame, prof: Profile) -> DataFrame:
    return req.withColumn(prof.key, F.trim(R.c(prof.key).cast("string")))


def stored_semi_join(spark: SparkSession, name: str, keys: DataFrame, prof: Profile = DEFAULT) -> DataFrame:
    """J3 on the store: stored rows whose key is requested."""
    return spark.table(name).join(_wanted(keys, prof).select(prof.key), prof.key, "left_semi")


def stored_batch_lookup(spark: SparkSession, name: str, req: DataFrame, pos: str, base_order: str, prof: Profile = DEFAULT) -> DataFrame:
    """J2 on the store: for each requested key the first stored row by ``base_order``."""
    first = first_per_key(spark.table(name), [prof.key], base_order)
    return _wanted(req, prof).select(prof.key, R.c(pos).alias(pos)).join(first, prof.key)
