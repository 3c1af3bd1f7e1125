"""Structured Streaming jobs (T1, T2) built from the batch operators.

T1 scores request records as they arrive: each micro-batch is joined with the
newest version of the stored snapshot (unknown keys kept, as received), then
scored by the rule; a request that is sent again is scored once.

T2 monitors drift continuously: the reference edges are fixed (computed once
in batch, literals of the plan), arriving rows are binned against them and
counted in a keyed state per (event-time window, feature), which a timer closes
at the window's end; the PSI of every window that a batch touched or closed is
computed in ``foreachBatch`` against the reference shares.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from .. import profile as P
from ..functions import rules as R
from ..functions.numeric import is_finite, to_double
from ..operators import drift as D
from ..operators.enrich import enrich_requests
from ..operators.reports import prediction_rows
from ..operators.scoring import score_rule
from ..profile import DEFAULT, Profile
from ..session import ship_package
from ..sources import bundles as B
from ..sources import io as IO


def scoring_stream(requests: DataFrame, base: DataFrame, prof: Profile = DEFAULT) -> DataFrame:
    """T1 plan on a streaming request frame: J1 (keep unmatched) -> C3/C4 -> S4."""
    enriched = enrich_requests(base, requests, unmatched="keep", prof=prof)
    return prediction_rows(score_rule(enriched, prof), prof=prof)


def publish_snapshot(spark: SparkSession, store_dir: str, base: DataFrame) -> str:
    """Write the static side of T1 as a new version of the store."""
    return B.publish(spark, store_dir, {"snapshot": base})


def run_scoring(spark: SparkSession, request_dir: str, schema: T.StructType, store_dir: str, sink_dir: str,
                checkpoint_dir: str, identity: list[str] | None = None, retry_window: str = "1 day") -> None:
    """Run T1 over the files that came since the last run (``availableNow``).

    Every micro-batch joins the newest version of the stored snapshot
    (:func:`publish_snapshot`), read from the store, so a new snapshot holds from
    the next batch on and a running stream need not be restarted. A batch is one
    folder of the sink, which a retried batch overwrites. With ``identity``
    columns a request that is sent again within ``retry_window`` of its first
    arrival (by the times of the files) is scored once; requests without an
    identity are all scored."""
    stream = spark.readStream.schema(schema).json(request_dir)
    if identity:
        stream = stream.select("*", F.col("_metadata.file_modification_time").alias("_arrived"))
        known = F.coalesce(*[F.col(f"`{c}`").isNotNull() for c in identity][:1])
        for c in identity[1:]:
            known = known & F.col(f"`{c}`").isNotNull()
        stream = stream.withColumn("_identity", F.when(known, F.to_json(F.struct(*[F.col(f"`{c}`") for c in identity]))).otherwise(F.uuid()))
        stream = stream.withWatermark("_arrived", retry_window).dropDuplicatesWithinWatermark(["_identity"]).drop("_arrived", "_identity")

    def emit(batch: DataFrame, epoch: int) -> None:
        path = B.newest(spark, store_dir, verify=False)
        if path is None:
            raise IO.SnapshotError(f"no snapshot published in {store_dir}")
        scoring_stream(batch, B.table(spark, path, "snapshot")).write.mode("overwrite").parquet(f"{sink_dir}/epoch={epoch}")

    q = (stream.writeStream.option("checkpointLocation", checkpoint_dir).foreachBatch(emit).trigger(availableNow=True).start())
    q.awaitTermination()


def reference_shares(ref: DataFrame, features: list[str], bins: int = P.PSI_BINS) -> tuple[DataFrame, DataFrame]:
    """Fixed reference side: (edges per feature, share per feature and bin)."""
    vals = D.long_values(ref, features, "ref")
    edges = D.quantile_edges(vals, bins)
    counts = _bin(vals, edges, bins).filter("bin > 0").groupBy("feature", "bin").agg(F.count(F.lit(1)).alias("c"))
    grid = edges.select("feature", F.explode(F.sequence(F.lit(1), F.greatest(F.col("m") - 1, F.lit(1)))).alias("bin"))
    full = grid.join(counts, ["feature", "bin"], "left").fillna({"c": 0})
    tot = full.groupBy("feature").agg(F.sum("c").alias("tot"))
    shares = full.join(tot, "feature").select(
        "feature", "bin", (F.col("c").cast("double") / F.greatest(F.col("tot"), F.lit(1)).cast("double")).alias("r"))
    return edges, shares


def _bin(values: DataFrame, edges: DataFrame, bins: int) -> DataFrame:
    """Bin index against fixed edges (last edge closed); 0 outside of them."""
    # edges: one row per feature, at most bins + 1 values -> bounded broadcast
    return values.join(F.broadcast(edges), "feature").withColumn("bin", D.bin_of(bins))


def windowed_bin_counts(stream: DataFrame, edges: DataFrame, features: list[str], time_col: str,
                        window: str, watermark: str, bins: int = P.PSI_BINS) -> DataFrame:
    """T2 stateful part: counts per (event-time window, feature, bin); bin 0
    counts the values outside the reference edges, so that a window whose
    values are all outside is counted too."""
    types = {f.name: f.dataType for f in stream.schema.fields}
    feats = [f for f in features if f in types]
    args = ", ".join(f"'{f}', `_v{i}`" for i, f in enumerate(feats))
    vals = stream.select(F.col(time_col).cast("timestamp").alias("ts"),
                         *[to_double(R.c(f), types[f]).alias(f"_v{i}") for i, f in enumerate(feats)])
    long = vals.select("ts", F.expr(f"stack({len(feats)}, {args}) as (feature, value)")).filter(
        is_finite(F.col("value")))
    binned = _bin(long, edges, bins)
    return (binned.withWatermark("ts", watermark)
            .groupBy(F.window("ts", window).alias("win"), "feature", "bin").agg(F.count(F.lit(1)).alias("c")))


def psi_of_windows(batch: DataFrame, shares: DataFrame, edges: DataFrame, eps: float = P.PSI_EPS) -> DataFrame:
    """PSI per window and feature from its bin counts. ``cur_count`` counts
    all values of the window, shares are taken over those inside the edges."""
    keys = batch.groupBy("win", "feature").agg(F.sum("c").alias("cur_count"))
    grid = keys.join(shares, "feature")
    full = grid.join(batch, ["win", "feature", "bin"], "left").fillna({"c": 0})
    tot = full.groupBy("win", "feature").agg(F.sum("c").alias("tot"))
    s = full.join(tot, ["win", "feature"]).join(edges.select("feature", "m"), "feature").select(
        "win", "feature", "m",
        F.greatest(F.col("c").cast("double") / F.greatest(F.col("tot"), F.lit(1)).cast("double"), F.lit(eps)).alias("cc"),
        F.greatest(F.col("r"), F.lit(eps)).alias("r"), "cur_count")
    psi = s.groupBy("win", "feature", "m").agg(
        F.sum((F.col("cc") - F.col("r")) * F.log(F.col("cc") / F.col("r"))).alias("psi_sum"),
        F.max("cur_count").alias("cur_count"))
    value = F.when(F.col("m") < 3, F.lit(0.0)).otherwise(F.bround("psi_sum", 9))
    return psi.select(F.col("win.start").alias("window_start"), F.col("win.end").alias("window_end"), "feature",
                      value.alias("psi"), R.psi_status(value).alias("status"), "cur_count")


def bin_against(value: Column, edges: list[float]) -> Column:
    """Bin (from 1) of a finite ``value`` between sorted ``edges``, the last one
    closed; 0 outside of them; null for other values. The edges stand in the plan."""
    place = F.lit(0)
    for e in edges:
        place = place + (value >= e).cast("int")
    if edges:
        place = F.when(value == edges[-1], len(edges) - 1).otherwise(place)
    return F.when(is_finite(value), F.when((place >= 1) & (place < len(edges)), place).otherwise(0))


class WindowCounts(StatefulProcessor):
    """State of one (window, feature): its count in each bin. What is counted so
    far is told with every batch that adds to it, and for the last time by a
    timer at the window's end, after which the state is gone. Rows for a window
    that has ended are told as late and counted nowhere else."""

    def init(self, handle) -> None:
        self.handle = handle
        self.counts = handle.getMapState("counts", "bin int", "c bigint")

    def _told(self, key, kind: str):
        for b, c in self.counts.iterator():
            yield Row(window_start=key[0], window_end=key[1], feature=key[2], bin=b[0], c=c[0], kind=kind)

    def handleInputRows(self, key, rows, timerValues):
        come = Counter()
        for r in rows:
            come[r["bin"]] += r["c"]
        if key[1] <= timerValues.getCurrentWatermarkInMs():
            for b, c in come.items():
                yield Row(window_start=key[0], window_end=key[1], feature=key[2], bin=b, c=c, kind="late")
            return
        # the state is asked once a batch and bin, whatever the rows
        for b, c in come.items():
            known = self.counts.getValue((b,)) if self.counts.containsKey((b,)) else (0,)
            self.counts.updateValue((b,), (known[0] + c,))
        self.handle.registerTimer(key[1])
        yield from self._told(key, "open")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        yield from self._told(key, "closed")
        self.counts.clear()

    def close(self) -> None:
        pass


#: Counts of a feature that a task holds before it adds them up or hands them on.
HELD_COUNTS = 1 << 16


def _added(counts: list[pa.Table], keys: list[str]) -> pa.Table:
    """Sums of ``c`` by ``keys`` over several tables."""
    t = pa.concat_tables(counts).group_by(keys).aggregate([("c", "sum")])
    return t.rename_columns({"c_sum": "c"}).select([*keys, "c"])


WINDOW_COUNTS = "window_start bigint, window_end bigint, feature string, bin int, c bigint, kind string"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def window_states(stream: DataFrame, edges: dict[str, list[float]], time_col: str, window: str, watermark: str) -> DataFrame:
    """T2 stateful part: bin counts of windows (milliseconds), told as ``open``,
    ``closed`` or ``late``. Each task counts its rows before the shuffle to the
    state, so a hot window costs one row a task and bin."""
    types = {f.name: f.dataType for f in stream.schema.fields}
    feats = [f for f in edges if f in types]
    at = stream.select(F.col(time_col).cast("timestamp").alias("ts"), *[bin_against(to_double(R.c(f), types[f]), edges[f]).alias(f"b{i}") for i, f in enumerate(feats)])
    win = F.window("ts", window)
    # the event time itself is not handed on: Spark would drop late rows before the state sees them
    wide = at.withWatermark("ts", watermark).select(win.alias("w"), *[f"b{i}" for i in range(len(feats))]).select(
        F.unix_millis("w.start").alias("window_start"), F.unix_millis("w.end").alias("window_end"), *[f"b{i}" for i in range(len(feats))])

    keys = ["window_start", "window_end", "bin"]

    def told(f, t):
        t = t.append_column("feature", pa.array([f] * t.num_rows, pa.string()))
        return t.select(["window_start", "window_end", "feature", "bin", "c"]).to_batches()

    def counted(batches):
        held = {f: [] for f in feats}
        for b in batches:
            for i, f in enumerate(feats):
                t = pa.table([b.column(0), b.column(1), b.column(2 + i)], names=keys).drop_null()
                held[f].append(t.group_by(keys).aggregate([([], "count_all")]).rename_columns([*keys, "c"]))
                if sum(t.num_rows for t in held[f]) > HELD_COUNTS:
                    held[f] = [_added(held[f], keys)]
                    if held[f][0].num_rows > HELD_COUNTS // 2:  # more windows than a task holds
                        yield from told(f, held[f].pop())
        for f in feats:
            if held[f]:
                yield from told(f, _added(held[f], keys))
    counts = wide.mapInArrow(counted, "window_start bigint, window_end bigint, feature string, bin int, c bigint")
    return counts.groupBy("window_start", "window_end", "feature").transformWithState(WindowCounts(), WINDOW_COUNTS, "Update", "EventTime")


def run_drift_monitor(spark: SparkSession, source_dir: str, schema: T.StructType, ref: DataFrame,
                      features: list[str], time_col: str, sink_dir: str, checkpoint_dir: str,
                      window: str = "90 days", watermark: str = "30 days") -> None:
    """Run T2 over the files that came since the last run. The PSI of every
    window that a batch touched or closed goes to one folder per epoch, which a
    retried batch overwrites (:func:`drift_windows` reads the last word on each
    window); the counts of rows that came after their window had closed go to
    :func:`late_rows`. Nothing of the source is read twice: open windows stand in
    the state."""
    edges, shares = reference_shares(ref, features)
    edges = edges.cache()
    shares = shares.cache()
    fixed = {r["feature"]: r["edges"] for r in edges.collect()}  # at most bins + 1 numbers a feature
    ship_package(spark)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)  # the state of keyed processors
    try:
        stream = spark.readStream.schema(schema).parquet(source_dir)
        told = window_states(stream, {f: fixed[f] for f in features if f in fixed}, time_col, window, watermark)

        def emit(batch: DataFrame, epoch: int) -> None:
            batch = batch.persist()
            win = F.struct(F.timestamp_millis("window_start").alias("start"), F.timestamp_millis("window_end").alias("end")).alias("win")
            on_time = batch.where("kind <> 'late'")
            closed = on_time.groupBy(win, "feature").agg(F.bool_or(F.col("kind") == "closed").alias("closed"))
            psi = psi_of_windows(on_time.select(win, "feature", "bin", "c"), shares, edges)
            psi = psi.join(closed.select(F.col("win.start").alias("window_start"), "feature", "closed"), ["window_start", "feature"])
            psi.select("window_start", "window_end", "feature", "psi", "status", "cur_count", "closed").write.mode("overwrite").parquet(f"{sink_dir}/epoch={epoch}")
            late = batch.where("kind = 'late'").groupBy(F.timestamp_millis("window_start").alias("window_start"), F.timestamp_millis("window_end").alias("window_end"),
                                                        "feature").agg(F.sum("c").alias("late_count"))
            late.write.mode("overwrite").parquet(f"{_late_dir(sink_dir)}/epoch={epoch}")
            batch.unpersist()

        q = (told.writeStream.outputMode("update").option("checkpointLocation", checkpoint_dir)
             .foreachBatch(emit).trigger(availableNow=True).start())
        q.awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
        edges.unpersist()
        shares.unpersist()


def _late_dir(sink_dir: str) -> str:
    return f"{sink_dir.rstrip('/')}-late"


def drift_windows(spark: SparkSession, sink_dir: str) -> DataFrame:
    """The last word on every window: ``window_start, window_end, feature, psi,
    status, cur_count, closed`` (false while the watermark has not passed its end)."""
    told = spark.read.parquet(sink_dir)
    row = F.struct("psi", "status", "cur_count", "closed")
    return told.groupBy("window_start", "window_end", "feature").agg(F.max_by(row, "epoch").alias("r")).select("window_start", "window_end", "feature", "r.*")


def late_rows(spark: SparkSession, sink_dir: str) -> DataFrame:
    """Rows refused because their window had closed: ``epoch, window_start, window_end, feature, late_count``."""
    return spark.read.parquet(_late_dir(sink_dir))
