"""AUC / AP against brute force; weights; stratified split counts."""

import random

from pyspark.sql import functions as F

from cohort_spark.operators import metrics as M
from cohort_spark.operators.ranks import global_row_number, running_totals


def brute_auc(ys, ss):
    pos = [s for y, s in zip(ys, ss) if y == 1]
    neg = [s for y, s in zip(ys, ss) if y != 1]
    tot = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p in pos for n in neg)
    return tot / (len(pos) * len(neg))


def brute_ap(ys, ss):
    P = sum(ys)
    ap, prev_r = 0.0, 0.0
    for t in sorted(set(ss), reverse=True):
        sel = [y for y, s in zip(ys, ss) if s >= t]
        tp = sum(sel)
        r = tp / P
        ap += (r - prev_r) * (tp / len(sel))
        prev_r = r
    return ap


def test_rank_metrics_brute_force(spark):
    rnd = random.Random(3)
    for _ in range(3):
        ys = [rnd.randint(0, 1) for _ in range(150)]
        ss = [round(rnd.random(), 2) for _ in range(150)]  # many ties
        df = spark.createDataFrame(list(zip(ys, ss)), "y int, score double")
        row = M.rank_metrics(df).first()
        assert abs(row.roc_auc - brute_auc(ys, ss)) < 1e-9
        assert abs(row.pr_auc - brute_ap(ys, ss)) < 1e-9


def test_single_class_gives_null(spark):
    df = spark.createDataFrame([(1, 0.3), (1, 0.9)], "y int, score double")
    row = M.evaluation(df).first()
    assert row.roc_auc is None and row.f1 is None


def test_threshold_metrics_zero_division(spark):
    df = spark.createDataFrame([(1, 0.2), (0, 0.1)], "y int, score double")
    row = M.threshold_metrics(df).first()
    assert (row.precision, row.recall, row.f1) == (0.0, 0.0, 0.0)


def test_class_weights(spark):
    df = spark.createDataFrame([(1,), (0,), (0,), (0,)], "y int")
    w = sorted(r.w for r in M.class_weights(df).collect())
    assert w == [4 / 6, 4 / 6, 4 / 6, 2.0]
    one = spark.createDataFrame([(1,), (1,)], "y int")
    assert [r.w for r in M.class_weights(one).collect()] == [1.0, 1.0]


def test_global_row_number_and_running_totals(spark):
    rnd = random.Random(5)
    rows = [(i, rnd.choice("abc"), rnd.randint(1, 9)) for i in range(500)]
    df = spark.createDataFrame(rows, "id int, g string, v int")
    rn = {r.id: r.row_number for r in global_row_number(df, [F.col("v").desc(), F.col("id")], partitions=7).collect()}
    want = {rid: i + 1 for i, (rid, _, _) in enumerate(sorted(rows, key=lambda t: (-t[2], t[0])))}
    assert rn == want
    rt = running_totals(df, ["g"], "id", ["v"], partitions=5).collect()
    for r in rt:
        assert r.cum_v_before == sum(v for i, g, v in rows if g == r.g and i < r.id)
