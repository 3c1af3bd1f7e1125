"""Lossless requests, drift windows outside the edges, and the model path's fallbacks."""
from __future__ import annotations

import json
import os

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from cohort_spark.operators.enrich import batch_lookup, enrich_requests
from cohort_spark.operators.scoring import score
from cohort_spark.plans import model as MO
from cohort_spark.session import scratch_path
from cohort_spark.sources import io as IO
from cohort_spark.sources import tables as T_


def base(spark):
    return spark.createDataFrame([("1", "A", 5.0), ("2", "B", None)], "RA string, Nome string, `INDE 22` double")


def test_requests_without_key_are_kept(spark):
    req = spark.createDataFrame([("1", " 7.5 "), (" 2 ", "7,5"), (None, "3"), ("  ", "x"), ("9", "4")], "RA string, `INDE 22` string")
    got = sorted(((r["RA"], r["Nome"], r["INDE 22"]) for r in enrich_requests(base(spark), req).collect()), key=repr)
    assert got == sorted([("1", "A", 7.5), ("2", "B", None), (None, None, 3.0), (None, None, None), ("9", None, 4.0)], key=repr)
    assert enrich_requests(base(spark), req, unmatched="drop").count() == 2


def test_requests_without_key_column(spark):
    req = spark.createDataFrame([("Z", 6.5), ("Y", 2.0)], "Nome string, `INDE 22` double")
    got = enrich_requests(base(spark), req).collect()
    assert sorted(r["INDE 22"] for r in got) == [2.0, 6.5] and {r["RA"] for r in got} == {None}


def test_batch_lookup_has_a_defined_first_row(spark):
    b = base(spark).unionAll(spark.createDataFrame([("1", "AA", 9.0)], "RA string, Nome string, `INDE 22` double"))
    req = spark.createDataFrame([("1", 1)], "RA string, pos int")
    rows = {(r["Nome"], len(r)) for f in (b, b.orderBy(F.desc("Nome")).repartition(3)) for r in batch_lookup(f, req).collect()}
    assert rows == {("A", 4)}


def test_orders_are_read_whole(spark):
    df = T_.pupil_year(spark, SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "1996" not in plan and "1999" not in plan
    years = {r["ano"] for r in df.select("ano").distinct().collect()}
    assert sorted(years) == T_.order_years(spark, SMALL) and len(years) > 3


def test_drift_window_with_all_values_outside(spark):
    from cohort_spark.streaming import drift_windows, run_drift_monitor
    src, sink, ck = (scratch_path(spark, n) for n in ("o-in", "o-out", "o-ck"))
    ref = spark.range(1000).select((F.col("id") % 100).cast("double").alias("f"))
    stream = spark.range(300).select(F.expr("timestamp_ntz'2020-01-01' + make_interval(0, 0, 0, cast(id as int))").alias("t"),
                                     F.when(F.col("id") < 90, F.col("id") * 1.0).otherwise(1e6 + F.col("id")).alias("f"))
    stream.write.parquet(src)
    run_drift_monitor(spark, src, stream.schema, ref, ["f"], "t", sink, ck)
    got = drift_windows(spark, sink)
    far = got.where("window_start >= timestamp'2020-05-01'").collect()
    assert far and all(r.status == "DRIFT" and r.cur_count > 0 for r in far)
    assert got.where("not closed").count() > 0
    assert got.agg(F.sum("cur_count")).first()[0] == 300  # every row is in one window


def test_unknown_category_has_no_entry(spark):
    train = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 3.0)], "f_Turma string, f_IEG double")
    fitted = MO.learn_encoding(train, ["Turma"], ["IEG"])
    rows = spark.createDataFrame([("zz", 2.0), ("b", 3.0), (None, None)], "f_Turma string, f_IEG double")
    got = [r["features"].asDict() for r in MO.feature_matrix(rows, fitted).orderBy(F.desc("f_Turma")).collect()]
    assert [g["size"] for g in got] == [4, 4, 4] and [g["indices"] for g in got] == [[3], [1, 3], [0, 3]]  # unknown; known; the mode and the median
    assert got[0]["values"] == [0.0] and got[1]["values"][1] == pytest.approx(1.5 ** 0.5)


def test_split_takes_text_keys(spark):
    df = spark.createDataFrame([(f"RA-{i}", 2020, i % 4 == 0) for i in range(200)], "RA string, ano int, y boolean")
    out = MO.stratified_split(df.withColumn("y", F.col("y").cast("int")))
    assert {r["y"]: r["n"] for r in out.where("is_test").groupBy("y").agg(F.count("*").alias("n")).collect()} == {0: 30, 1: 10}


def test_unusable_bundle_falls_back_to_the_rule(spark):
    df = T_.snapshot(spark, SMALL, 1996)
    fitted = MO.Fitted(["Turma"], ["IEG"], df.limit(0), {}, {}, [(0, 1, "f_no_such_feature", None, 0.5, False, 0.0, 1, 0.0, 0.0)])
    for bundle in (None, (fitted, ["Turma"], ["IEG"]), (fitted._replace(rows=[]), ["Turma"], ["IEG"]), ("no model", ["Turma"], []), ()):
        out, used = score(df, bundle)
        assert not used and out.select("_risk_label").first() is not None


@pytest.mark.parametrize("indent", [None, 2])
def test_run_table_in_one_line_or_many(spark, tmp_path, indent):
    (tmp_path / "m.json").write_text(json.dumps({"model_name": "m", "model_version": "1", "feature_columns": ["a"], "metrics": {"f1": 0.5}}, indent=indent))
    assert [r["model_name"] for r in IO.read_metadata(spark, str(tmp_path)).collect()] == ["m"]
    (tmp_path / "m.json").write_text("{ broken")
    assert IO.read_metadata(spark, str(tmp_path)).count() == 0
    assert IO.read_metadata(spark, str(tmp_path / "none")).count() == 0


def test_export_parts_are_in_order(spark):
    from cohort_spark.operators import cohorts as C
    from cohort_spark.operators.scoring import score_rule
    rows = C.export_frame(score_rule(T_.snapshot(spark, SMALL, 1997)))
    path = scratch_path(spark, "ordered")
    IO.write_export_csv(rows.orderBy(*C.export_keys()), path)
    lines = []
    for f in sorted(x for x in os.listdir(path.removeprefix("file://")) if x.startswith("part-")):
        with open(os.path.join(path.removeprefix("file://"), f), encoding="utf-8-sig") as h:
            lines += [x.split(";") for x in h.read().splitlines()[1:]]
    key = [(x[4], float(x[3]) if x[3] else 1e9, x[0]) for x in lines]
    assert key == sorted(key) and len(key) == rows.count()


def test_training_without_a_test_year(spark):
    from cohort_spark.plans.catalog import _labelled
    df = _labelled(spark, SMALL).where("ano < 1998")
    row = MO.train_job(spark, df, 2050, scratch_path(spark, "notest"), params={"rounds": 2})[0].first()
    assert row["n_train"] > row["n_test"] > 0
