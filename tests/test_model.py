"""Model path mechanics on sf0.001. The boosted trees use few iterations
here only to keep the test short; the registered queries use the full
hyper-parameters."""

import os
import statistics

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from cohort_spark.functions import rules as R
from cohort_spark.operators.scoring import score
from cohort_spark.plans import model as MD
from cohort_spark.session import scratch_path
from cohort_spark.sources import bundles as B
from cohort_spark.sources import tables as T_

SMALL = "/root/testdata/sf0.001"


def labelled(spark):
    return R.next_year_target(T_.pupil_year(spark, SMALL)).withColumnRenamed("target_next", "y")


def test_fit_score_save_load(spark):
    train = labelled(spark).filter(F.col("ano") < 1998).drop("ano", "RA", "Nome")
    model, cat, num = MD.train(train, "y", params={"rounds": 3})
    assert cat == ["Indicado", "Instituição de ensino", "Turma"] and "INDE 22" in num

    # exact medians and the most frequent categories are carried by the fitted model
    rows = [r["INDE 22"] for r in train.where("y is not null").select("INDE 22").collect()]
    assert model.numeric["f_INDE_22"][0] == pytest.approx(statistics.median(rows), abs=1e-12) and set(model.modes) == set(model.used[0])

    test = T_.pupil_year(spark, SMALL, (1998,))
    pr = MD.probabilities(model, test, cat, num, keep=["RA"])
    vals = [r._proba for r in pr.collect()]
    assert vals and all(0.0 <= v <= 1.0 for v in vals)

    out = scratch_path(spark, "model-test")
    MD.save_artifacts(spark, model, cat, num, {"roc_auc": 0.5}, out)
    bundle, meta = MD.load_bundle(spark, out)
    assert meta["model_version"] == "1.0.0" and meta["feature_columns"] == cat + num
    again = MD.probabilities(bundle[0], test, bundle[1], bundle[2], keep=["RA"])
    assert sorted((r.RA, r._proba) for r in again.collect()) == sorted((r.RA, r._proba) for r in pr.collect())

    scored, used = score(test, bundle)
    assert used and scored.filter(F.col("_risk_label").isNull()).count() == 0
    assert {r._future_label for r in scored.select("_future_label").distinct().collect()} <= {
        "Alta Defasagem", "Risco Moderado", "Baixo Risco"}
    info = MD.model_info(spark, out).orderBy("position").collect()
    assert [r.feature for r in info] == cat + num

    missing, _ = MD.load_bundle(spark, out + "-missing")
    rule, used = score(test, missing)
    assert missing is None and not used and "_risk_label" in rule.columns


def test_absent_features_are_filled_by_the_mode_and_the_median(spark):
    train = labelled(spark).filter(F.col("ano") < 1998).drop("ano", "RA", "Nome")
    model, cat, num = MD.train(train, "y", params={"rounds": 5})
    rows = T_.pupil_year(spark, SMALL, (1998,)).limit(20)
    without = rows.drop("Turma", "IPS")
    given = without.withColumn("Turma", F.lit(model.modes["f_Turma"])).withColumn("IPS", F.lit(model.numeric["f_IPS"][0]))
    blank = without.withColumn("Turma", F.lit(None).cast("string")).withColumn("IPS", F.lit(None).cast("double"))
    of = lambda df: sorted((r.RA, r._proba) for r in MD.probabilities(model, df, cat, num, keep=["RA"]).collect())
    assert of(without) == of(given)
    # an empty cell of a column that is there is the blank level, not the mode
    assert MD.prepare(blank, cat, num).select("f_Turma").distinct().first()[0] == MD.BLANK_CATEGORY


def test_a_killed_or_damaged_publication_leaves_the_old_bundle(spark, monkeypatch):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "n int, s string")
    root = scratch_path(spark, "bundle")
    assert B.newest(spark, root) is None
    first = B.publish(spark, root, {"t": df, "empty": df.limit(0)})
    assert B.newest(spark, root) == first and B.table(spark, first, "t").count() == 2
    with monkeypatch.context() as m, pytest.raises(KeyboardInterrupt):
        m.setattr(B, "_finish", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
        B.publish(spark, root, {"t": df.limit(1), "empty": df})  # killed before the manifest
    assert B.newest(spark, root) == first
    second = B.publish(spark, root, {"t": df.limit(1)})
    assert B.newest(spark, root) == second
    local = second.removeprefix("file:")
    for f in os.listdir(os.path.join(local, "t")):
        if f.startswith("part-"):
            with open(os.path.join(local, "t", f), "r+b") as h:
                h.truncate(40)
    for f in os.listdir(os.path.join(local, "t")):  # checksums of the local file system
        if f.endswith(".crc"):
            os.remove(os.path.join(local, "t", f))
    assert B.newest(spark, root) == first
    # an unreadable storage is not "no bundle"
    monkeypatch.setattr(B, "digest", lambda df: (_ for _ in ()).throw(PySparkException("connection reset")))
    with pytest.raises(PySparkException):
        B.newest(spark, root)


def test_stratified_split_counts(spark):
    py = T_.pupil_year(spark, SMALL)
    df = py.select("RA", "ano", R.same_year_target(py).alias("y"))
    sp = MD.stratified_split(df, "y")
    per = {r.y: (r.n, r.t) for r in sp.groupBy("y").agg(F.count(F.lit(1)).alias("n"),
                                                         F.count_if("is_test").alias("t")).collect()}
    n = sum(v[0] for v in per.values())
    assert sum(v[1] for v in per.values()) == -(-n * 2 // 10)       # ceil(0.2 n)
    for nc, tc in per.values():
        assert abs(tc - 0.2 * nc) <= 1


def test_split_selects_without_sorting_the_rows(spark):
    py = T_.pupil_year(spark, SMALL)
    df = py.select("RA", "ano", R.same_year_target(py).alias("y"))
    plan = MD.stratified_split(df, "y")._jdf.queryExecution().executedPlan().toString()
    alone = df._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and "Window" not in plan
    assert plan.count("Exchange hashpartitioning") == alone.count("Exchange hashpartitioning")  # rows stay where they are


def test_split_of_hot_keys_and_equal_rows(spark):
    """A key on a third of the rows: still exactly the allotted rows of each class, and no row is lost."""
    rows = [("7", 2020, 1, i % 4) for i in range(200)] + [("7", 2020, 1, 9)] * 100 + [(str(i), 2020, i % 3 and 1, i) for i in range(600)] + [(None, 2020, 0, 1)] * 3 + [("x", 2020, None, 1)] * 5
    df = spark.createDataFrame(rows, "RA string, ano int, y int, v int")
    for size in (0.0, 0.1, 0.2, 0.35, 0.5, 1.0):
        sp = MD.stratified_split(df, "y", size)
        assert sp.columns == df.columns + ["is_test"]
        assert sp.drop("is_test").exceptAll(df).count() == 0 and df.exceptAll(sp.drop("is_test")).count() == 0
        got = {r["y"]: r["t"] for r in sp.groupBy("y").agg(F.count_if("is_test").alias("t")).collect()}
        counts = [5, 203, 700]
        assert [got[None], got[0], got[1]] == MD._test_rows_per_class(counts, size) and sum(got.values()) == -(-908 * size // 1)
    assert MD.stratified_split(df.limit(0), "y").count() == 0
