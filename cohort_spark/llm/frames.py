"""Spark helpers of this subpackage: written intermediates in the shared
folder, Arrow plumbing and connected components."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir

_WRITTEN: list[tuple[SparkSession, str]] = []


FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str, free: bool = False) -> DataFrame:
    """Write ``df`` as Parquet into the cluster-shared folder and read it back:
    cuts the lineage, survives lost executors, and is read column by column.
    The folders are removed when the driver ends. With ``free`` the shuffle
    files go as soon as it is written, not when the driver next collects garbage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex[:12]}"
    before = spark.conf.get(FREE, "false")
    if free:
        spark.conf.set(FREE, "true")
    try:
        df.write.parquet(path)
    finally:
        if free:
            spark.conf.set(FREE, before)
    _WRITTEN.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


@atexit.register
def remove_written() -> None:
    """Remove the written intermediates of sessions that still run."""
    while _WRITTEN:
        spark, path = _WRITTEN.pop()
        try:
            jvm, jsc = spark._jvm, spark.sparkContext._jsc
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session is gone; its folder is the cluster's to clean
            continue


def batches_of(table: pa.Table, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for b in table.cast(schema).to_batches():
        if b.num_rows:
            yield b


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that tasks
    can import it wherever the driver found it (what ``--py-files`` does)."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    d = tempfile.mkdtemp(prefix="py-files-")  # on the driver, which serves the archive until it ends
    atexit.register(shutil.rmtree, d, ignore_errors=True)
    src = os.path.join(d, "src", os.path.basename(package))
    shutil.copytree(package, src, ignore=shutil.ignore_patterns("__pycache__", "*.pyc"))
    spark.sparkContext.addPyFile(shutil.make_archive(os.path.join(d, f"{os.path.basename(package)}_py"), "zip", os.path.join(d, "src")))
    _SHIPPED.add(app)


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` over non-empty batches, one call for each."""
    def run(batches):
        for b in batches:
            if b.num_rows:
                yield from fn(b)
    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """Smallest node id reachable from each node that has an edge: (node, component).

    Alternates large-star and small-star steps on the edge list; each step is
    one shuffle by node with a partial minimum, and the edges are written to
    the shared folder after each round. A hub of any size costs its own edges
    only: no neighbour list is ever collected."""
    e = written(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct(), "edges")
    seen = None
    for _ in range(rounds):
        # large star: connect every larger neighbour to the smallest node around
        both = e.select("a", "b").unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = (both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        # small star: connect every smaller neighbour and the node itself to the smallest
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        joined = down.join(low, "a")
        small = (joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .unionAll(low.select("a", F.col("m").alias("b")))
                 .where("a <> b").distinct())
        e = written(small, "edges")
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return (e.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
            .unionAll(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()))
