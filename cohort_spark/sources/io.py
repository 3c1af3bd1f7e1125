"""Sources and sinks.

Yearly snapshots live as one table partitioned by ``ano`` (Parquet or CSV),
so reading one year is partition pruning, and stacking years is one scan.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import profile as P
from ..session import scratch_path

BOM = "﻿"


class SnapshotError(ValueError):
    pass


def write_snapshots(df: DataFrame, path: str, year: str = "ano", fmt: str = "parquet") -> None:
    """Store stacked snapshots partitioned by year (one folder per year)."""
    w = df.write.mode("overwrite").partitionBy(year)
    if fmt == "csv":
        w.option("header", True).option("sep", ";").csv(path)
    else:
        w.parquet(path)


def read_snapshot(spark: SparkSession, path: str, year: int, fmt: str = "parquet", schema: T.StructType | None = None,
                  check_empty: bool = True) -> DataFrame:
    """One yearly snapshot. Errors if the path or the year is missing, or
    the snapshot is empty (one cheap ``isEmpty`` probe)."""
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    try:
        if fmt == "csv":
            df = reader.option("header", True).option("sep", ";").csv(path)
        else:
            df = reader.parquet(path)
    except AnalysisException as exc:
        raise SnapshotError(f"snapshot path not found: {path}") from exc
    if "ano" not in df.columns:
        raise SnapshotError(f"not a year-partitioned snapshot table: {path}")
    one = df.filter(F.col("ano") == year)
    if check_empty and one.isEmpty():
        raise SnapshotError(f"snapshot {year} is missing or empty in {path}")
    return one


def stack_years(frames: dict[int, DataFrame], year: str = "ano") -> DataFrame:
    """Union by name of yearly frames tagged with the year; missing
    columns become null. A frame that has the year column already, such as all
    years that share their columns read in one scan, keeps its own."""
    tagged = [df if year in df.columns else df.withColumn(year, F.lit(int(y))) for y, df in sorted(frames.items())]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def write_export_csv(rows: DataFrame, path: str, bom: bool = True) -> None:
    """S3: ``;``-separated CSV with header; the UTF-8 BOM is written as the
    first character of the first header name (Excel reads it as the BOM)."""
    out = rows
    if bom:
        first = rows.columns[0]
        out = rows.withColumnRenamed(first, BOM + first)
    out.write.mode("overwrite").option("header", True).option("sep", ";").option("encoding", "UTF-8") \
        .option("emptyValue", "").csv(path)


def read_export_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Read an S3 / S8 style file back: the BOM is stripped from the first
    column name by reading with an explicit schema."""
    return spark.read.schema(schema).option("header", True).option("sep", ";").option("encoding", "UTF-8").csv(path)


LEDGER_SCHEMA = T.StructType([
    T.StructField("sheet", T.StringType()),
    T.StructField("ra", T.StringType()),
    T.StructField("nome", T.StringType()),
    T.StructField("turma", T.StringType()),
    T.StructField("data", T.DateType()),
    T.StructField("disciplina", T.StringType()),
    T.StructField("observacao", T.StringType()),
])


def write_ledger(rows: DataFrame, path: str) -> None:
    """S8 writer: intervention ledger ``sheet;ra;nome;turma;data;disciplina;observacao``."""
    write_export_csv(rows.select(*[f.name for f in LEDGER_SCHEMA.fields]), path, bom=True)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger with its fixed schema (``data`` as DATE)."""
    return read_export_csv(spark, path, LEDGER_SCHEMA).withColumn("data", F.col("data").cast("date"))


def request_schema(columns: dict[str, T.DataType]) -> T.StructType:
    """All-nullable request schema plus a corrupt-record column."""
    fields = [T.StructField(k, v, True) for k, v in columns.items()]
    fields.append(T.StructField("_corrupt_record", T.StringType(), True))
    return T.StructType(fields)


def read_requests(spark: SparkSession, path: str, columns: dict[str, T.DataType]) -> tuple[DataFrame, DataFrame]:
    """JSON request records (one object per line, or arrays of objects),
    any subset of columns. Returns (records, rejects): lines that are not
    objects land in the reject frame instead of failing the job."""
    schema = request_schema(columns)
    raw = (spark.read.schema(schema).option("mode", "PERMISSIVE")
           .option("columnNameOfCorruptRecord", "_corrupt_record").json(path))
    # The reject frame keeps every field: whether a line is corrupt depends on
    # the fields parsed, so consume it whole (write or collect it); Spark
    # refuses a scan that would read the corrupt-record column alone.
    good = raw.filter(F.col("_corrupt_record").isNull()).drop("_corrupt_record")
    bad = raw.filter(F.col("_corrupt_record").isNotNull())
    return good, bad


def write_requests(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


METADATA_SCHEMA = T.StructType([
    T.StructField("model_name", T.StringType()),
    T.StructField("model_version", T.StringType()),
    T.StructField("trained_at", T.StringType()),
    T.StructField("task", T.StringType()),
    T.StructField("target", T.StringType()),
    T.StructField("risk_thresholds", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("feature_columns", T.ArrayType(T.StringType())),
    T.StructField("metrics", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("notes", T.ArrayType(T.StringType())),
])


def write_metadata(spark: SparkSession, meta: dict, path: str) -> None:
    """One-row run table written as JSON (overwrite)."""
    row = {f.name: meta.get(f.name) for f in METADATA_SCHEMA.fields}
    spark.createDataFrame([row], METADATA_SCHEMA).coalesce(1).write.mode("overwrite").json(path)


def metadata_frame(spark: SparkSession, meta: dict | None) -> DataFrame:
    """The run table as a frame of one row; empty without ``meta``."""
    row = [{f.name: meta.get(f.name) for f in METADATA_SCHEMA.fields}] if meta else []
    return spark.createDataFrame(row, METADATA_SCHEMA)


def first_dict(df: DataFrame) -> dict:
    """The single row of a run table as a dict ({} without one)."""
    rows = df.limit(1).collect()
    return rows[0].asDict(recursive=True) if rows else {}


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """S6 read; unreadable or missing -> empty frame with the schema."""
    try:
        df = spark.read.schema(METADATA_SCHEMA).option("multiLine", True).json(path).filter(F.col("model_name").isNotNull())
        df.isEmpty()  # reads it: broken files show now
        return df
    except PySparkException:
        return spark.createDataFrame([], METADATA_SCHEMA)


def metadata_dict(spark: SparkSession, path: str) -> dict:
    """The run table's single row as a dict ({} when unreadable)."""
    return first_dict(read_metadata(spark, path))


def default_metadata(features: list[str], metrics: dict) -> dict:
    return {
        "model_name": P.MODEL_NAME,
        "model_version": P.MODEL_VERSION,
        "task": "probability of the next year's target, cut into risk labels",
        "target": "low index, low IPS or lowest stone in the next year",
        "risk_thresholds": {"muito_alto_gte": P.PROBA_CUTS[0], "alto_gte": P.PROBA_CUTS[1],
                            "medio_gte": P.PROBA_CUTS[2]},
        "feature_columns": list(features),
        "metrics": {k: (None if v is None else float(v)) for k, v in metrics.items()},
        "notes": [json.dumps({"split": "temporal"})],
    }
