"""Stream = batch: T1 over files equals the batch plan on the same records."""

import pytest
from pyspark.sql import functions as F

from cohort_spark.plans.catalog import REQUEST_SCHEMA
from cohort_spark.session import scratch_path
from cohort_spark.sources import io as IO
from cohort_spark.sources import tables as T_
from cohort_spark.streaming import (drift_windows, late_rows, psi_of_windows, publish_snapshot, reference_shares, run_drift_monitor, run_scoring,
                                    scoring_stream, windowed_bin_counts)

SMALL = "/root/testdata/sf0.001"


def test_stream_scoring_equals_batch(spark):
    src, sink, ck = (scratch_path(spark, n) for n in ("t-in", "t-out", "t-ck"))
    reqs = T_.requests(spark, SMALL)
    IO.write_requests(reqs, src)
    base = T_.snapshot(spark, SMALL, 1996)
    store = scratch_path(spark, "t-store")
    publish_snapshot(spark, store, base)
    run_scoring(spark, src, REQUEST_SCHEMA, store, sink, ck)
    got = spark.read.parquet(sink)
    want = scoring_stream(spark.read.schema(REQUEST_SCHEMA).json(src), base)
    cols = sorted(want.columns)
    assert got.select(cols).exceptAll(want.select(cols)).count() == 0
    assert want.select(cols).exceptAll(got.select(cols)).count() == 0
    assert got.filter(F.col("ra").isNull()).count() == 0


FEATURES = list(T_.LINE_FEATURES)
COLUMNS = ["window_start", "window_end", "feature", "psi", "status", "cur_count", "closed"]


def drift_in_batch(spark, rows, ref):
    """All windows of the rows at once; closed where they end before the last event less 30 days."""
    edges, shares = reference_shares(ref, FEATURES)
    want = psi_of_windows(windowed_bin_counts(rows, edges, FEATURES, "l_shipdate", "90 days", "30 days"), shares, edges)
    last = rows.agg(F.max(F.col("l_shipdate").cast("timestamp"))).first()[0]
    return want.withColumn("closed", F.col("window_end") <= F.lit(last) - F.expr("INTERVAL 30 DAYS")).select(COLUMNS)


def same(a, b):
    a, b = a.select(COLUMNS), b.select(COLUMNS)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_stream_drift_equals_batch_after_a_restart_too(spark):
    """Files in order of time, run by run on one checkpoint: after each run every
    window, open ones included, equals the batch result of what has come, and
    only new files are read."""
    src, sink, ck = (scratch_path(spark, n) for n in ("d-in", "d-out", "d-ck"))
    li = T_.read_table(spark, SMALL, "lineitem").select("l_shipdate", *FEATURES)
    ref = T_.feature_side(spark, SMALL, current=False)
    ends = ["1996-01-01", "1998-06-15", "2100-01-01"]
    start = "1900-01-01"
    for end in ends:
        part = li.where((F.col("l_shipdate") >= F.lit(start).cast("timestamp_ntz")) & (F.col("l_shipdate") < F.lit(end).cast("timestamp_ntz")))
        part.write.mode("append").parquet(src)
        run_drift_monitor(spark, src, li.schema, ref, FEATURES, "l_shipdate", sink, ck)
        got = drift_windows(spark, sink)
        same(got, drift_in_batch(spark, spark.read.parquet(src), ref))
        assert got.where("not closed").count() > 0 and late_rows(spark, sink).count() == 0
        start = end
    epochs = spark.read.parquet(sink).groupBy("window_start", "feature").agg(F.count_distinct("epoch").alias("n"))
    assert epochs.where("n > 4").count() == 0  # a window is told when it is touched or closed, not in every run


def test_rows_after_their_window_closed_are_reported(spark):
    src, sink, ck = (scratch_path(spark, n) for n in ("l-in", "l-out", "l-ck"))
    ref = spark.range(1000).select((F.col("id") % 100).cast("double").alias("f"))

    def rows(first, n):
        return spark.range(n).select(F.expr(f"timestamp_ntz'2020-01-01' + make_interval(0, 0, 0, cast(id + {first} as int))").alias("t"), (F.col("id") % 90).cast("double").alias("f"))
    rows(0, 300).write.parquet(src)
    run_drift_monitor(spark, src, rows(0, 1).schema, ref, ["f"], "t", sink, ck)
    before = sorted(map(tuple, drift_windows(spark, sink).where("closed").collect()))
    rows(0, 40).unionAll(rows(299, 5)).coalesce(1).write.mode("append").parquet(src)
    run_drift_monitor(spark, src, rows(0, 1).schema, ref, ["f"], "t", sink, ck)
    assert sorted(map(tuple, drift_windows(spark, sink).where("closed").collect())) == before
    assert late_rows(spark, sink).agg(F.sum("late_count")).first()[0] == 40
    assert drift_windows(spark, sink).agg(F.sum("cur_count")).first()[0] == 305


def test_resent_requests_and_a_new_snapshot(spark):
    """A file sent again is scored once; the next run's requests meet the snapshot published in between."""
    src, sink, ck, store = (scratch_path(spark, n) for n in ("r-in", "r-out", "r-ck", "r-store"))
    base = T_.snapshot(spark, SMALL, 1996)
    key = base.orderBy("RA").first()["RA"]
    schema = REQUEST_SCHEMA

    def send(*rows):
        spark.createDataFrame([(r, p, None, None, "c") for r, p in rows], schema).coalesce(1).write.mode("append").json(src)

    def scores():
        return sorted((r["ra"], r["risk_score"]) for r in spark.read.parquet(sink).collect())
    publish_snapshot(spark, store, base.withColumn("INDE 22", F.lit(2.0)))
    send((key, 1), (key, 2), (key, None), (key, None))
    run_scoring(spark, src, schema, store, sink, ck, identity=["pos"])
    assert scores() == [(key, 0.8)] * 4
    publish_snapshot(spark, store, base.withColumn("INDE 22", F.lit(9.0)))
    send((key, 2), (key, 3), (key, 3))  # 2 was there before, 3 comes twice
    run_scoring(spark, src, schema, store, sink, ck, identity=["pos"])
    assert scores() == [(key, pytest.approx(0.1))] + [(key, 0.8)] * 4
    plan = spark.read.parquet(sink)
    assert plan.select("epoch").distinct().count() >= 2
    with pytest.raises(Exception, match="no snapshot published"):
        run_scoring(spark, src, schema, store + "-none", sink, scratch_path(spark, "r-ck2"))


class _Counts:
    """A map state that notes how often it is asked."""

    def __init__(self):
        self.held, self.asked = {}, 0

    def containsKey(self, k):
        self.asked += 1
        return k in self.held

    def getValue(self, k):
        return self.held[k]

    def updateValue(self, k, v):
        self.held[k] = v

    def iterator(self):
        return iter(self.held.items())


def test_the_state_is_asked_once_a_bin_and_batch():
    """Many counts of one bin, as many tasks send them, are added up before the state is asked."""
    from types import SimpleNamespace

    from cohort_spark.streaming.jobs import WindowCounts
    p = WindowCounts()
    p.counts, p.handle = _Counts(), SimpleNamespace(registerTimer=lambda end: None)
    now = SimpleNamespace(getCurrentWatermarkInMs=lambda: 5)
    for _ in range(2):
        told = list(p.handleInputRows((0, 10, "f"), iter([{"bin": i % 3, "c": 2} for i in range(300)]), now))
    assert p.counts.asked == 6 and sorted((r["bin"], r["c"], r["kind"]) for r in told) == [(b, 400, "open") for b in range(3)]
    late = list(p.handleInputRows((0, 5, "f"), iter([{"bin": 1, "c": 2}] * 4), now))
    assert [(r["bin"], r["c"], r["kind"]) for r in late] == [(1, 8, "late")] and p.counts.asked == 6


def test_a_task_hands_on_one_count_for_each_window_and_bin(spark, monkeypatch):
    """What a task sends to the state follows its windows and bins, not the batches it reads; more windows than it holds are handed on in parts."""
    from cohort_spark.streaming import jobs as J
    sent = {}

    def keep(counts, *keys):
        sent["rows"] = counts
        raise StopIteration
    rows = spark.range(50_000, numPartitions=1).select(F.expr("timestamp'2020-01-01' + make_interval(0, 0, 0, cast(id % 400 as int))").alias("t"), (F.col("id") % 20).cast("double").alias("f"))
    monkeypatch.setattr(type(rows), "groupBy", keep)
    for held in (1 << 16, 8):
        monkeypatch.setattr(J, "HELD_COUNTS", held)
        with pytest.raises(StopIteration):
            J.window_states(rows, {"f": [0.0, 10.0, 19.0]}, "t", "90 days", "30 days")
        got = sent["rows"].collect()
        assert sum(r["c"] for r in got) == 50_000
        if held > 8:
            assert len(got) == len({(r["window_start"], r["bin"]) for r in got}) < 20
