"""Versioned bundles of tables (S6, S7): whole or absent.

A bundle is published as a new folder ``version=<number>-<random>`` under a root:
its tables first, and last a manifest with the digest of each. A folder without
a manifest is one that is still written, or whose writer was killed; readers pass
over it and follow the newest version whose tables all match their digests.
Nothing is overwritten, so a bundle in use stays readable."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "version string, number bigint, tables map<string, struct<n: bigint, digest: string>>"
ERRORS = (PySparkException, Py4JJavaError)
#: Conditions of reading what is not there or not whole; any other error of the storage is raised.
BROKEN = ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA", "CANNOT_READ_FILE_FOOTER", "FAILED_READ_FILE.FILE_NOT_EXIST", "FAILED_READ_FILE.CANNOT_READ_FILE_FOOTER")


def broken(exc: Exception) -> bool:
    """The files that were to be read are missing or malformed."""
    text = str(exc)
    return any(c in text for c in BROKEN) or "is not a Parquet file" in text


def digest(df: DataFrame) -> tuple[int, str]:
    """Number of rows and a sum of row hashes, whatever their order."""
    row = F.xxhash64(F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns)])))
    r = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(row.cast("decimal(38,0)")), F.lit(0)).cast("string").alias("d")).first()
    return r["n"], r["d"]


def _manifests(spark: SparkSession, root: str) -> list:
    """(number, version, tables) of all versions with a manifest, newest first."""
    try:
        found = spark.read.schema(MANIFEST).json(f"{root}/version=*/manifest").where("version is not null and tables is not null")
        return found.orderBy(F.desc("number"), F.desc("version")).collect()  # one row a version
    except ERRORS as exc:
        if broken(exc):
            return []
        raise


def publish(spark: SparkSession, root: str, tables: dict[str, DataFrame]) -> str:
    """Write ``tables`` as a new version and return its folder."""
    known = _manifests(spark, root)
    number = known[0]["number"] + 1 if known else 1
    version = f"{number:08d}-{uuid.uuid4().hex[:8]}"
    path = f"{root}/version={version}"
    sums = {}
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{path}/{name}")
        sums[name] = digest(spark.read.parquet(f"{path}/{name}"))
    _finish(spark, path, version, number, sums)
    return path


def _finish(spark: SparkSession, path: str, version: str, number: int, sums: dict) -> None:
    spark.createDataFrame([(version, number, sums)], MANIFEST).coalesce(1).write.json(f"{path}/manifest")


def newest(spark: SparkSession, root: str, verify: bool = True) -> str | None:
    """Folder of the newest whole version; None where there is none. Without
    ``verify`` the manifest, which is written last, is taken at its word."""
    for m in _manifests(spark, root):
        path = f"{root}/version={m['version']}"
        if not verify:
            return path
        try:
            if all(digest(spark.read.parquet(f"{path}/{name}")) == (s["n"], s["digest"]) for name, s in m["tables"].items()):
                return path
        except ERRORS as exc:
            if not broken(exc):
                raise
    return None


def table(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}")
