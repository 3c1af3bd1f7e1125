"""One key holding a third of all rows: results stay whole and exact, and
the hot key is never gathered into one task."""

import random

from pyspark.sql import functions as F

from cohort_spark.operators import cohorts as C
from cohort_spark.operators.enrich import enrich_requests
from cohort_spark.operators.normalize import first_per_key
from cohort_spark.operators.ranks import running_totals


def _hot_rows(n=3000, seed=11):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        key = "HOT" if i % 3 == 0 else f"k{rnd.randint(0, 400)}"
        rows.append((key, i, rnd.randint(0, 50)))
    return rows


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_first_per_key_hot_key(spark):
    rows = _hot_rows()
    df = spark.createDataFrame(rows, "RA string, pos long, v int").repartition(8)
    out = first_per_key(df, ["RA"], "pos")
    got = {r.RA: (r.pos, r.v) for r in out.collect()}
    want = {}
    for k, p, v in sorted(rows, key=lambda t: t[1]):
        want.setdefault(k, (p, v))
    assert got == want
    plan = _plan(out)
    # combined map-side before the shuffle on the key
    assert "partial_min_by" in plan


def test_running_totals_hot_group_spans_partitions(spark):
    rows = _hot_rows()
    df = spark.createDataFrame(rows, "g string, o long, v int")
    out = running_totals(df, ["g"], "o", ["v"], partitions=12)
    got = {(r.g, r.o): r.cum_v_before for r in out.collect()}
    acc = {}
    for g, o, v in sorted(rows, key=lambda t: t[1]):
        assert got[(g, o)] == acc.get(g, 0)
        acc[g] = acc.get(g, 0) + v
    # the hot group (a third of the rows) is split over several range partitions
    ranged = df.repartitionByRange(12, "g", "o").withColumn("pid", F.spark_partition_id())
    hot_parts = ranged.filter(F.col("g") == "HOT").select("pid").distinct().count()
    assert hot_parts >= 3


def test_top_k_hot_group_limits_before_shuffle(spark):
    rows = [(str(i), "HOT" if i % 3 == 0 else f"s{i % 40}", (i * 7919 % 1000) / 1000.0, "Alto", 5.0)
            for i in range(3000)]
    df = spark.createDataFrame(rows, "RA string, escola string, _risk_score double, _risk_label string, "
                                     "_media double").withColumn("Nome", F.col("RA")).withColumn("Turma", F.lit("T"))
    top = C.top_high_risk(df, 15, by=["escola"])
    got = [r.ra for r in top.filter(F.col("escola") == "HOT").orderBy("row_number").collect()]
    hot = sorted((r for r in rows if r[1] == "HOT"), key=lambda r: (-r[2], r[0]))
    assert got == [r[0] for r in hot[:15]]
    assert "WindowGroupLimit" in _plan(top) and "Partial" in _plan(top)


def test_enrich_hot_request_key(spark):
    base = spark.createDataFrame([("1", 5.0, "Sim"), ("2", 7.0, None)], "RA string, `INDE 22` double, Indicado string")
    reqs = [("1" if i % 3 == 0 else str(3 + i % 50), i, None) for i in range(900)]
    req = spark.createDataFrame(reqs, "RA string, pos long, `INDE 22` double")
    out = enrich_requests(base, req, unmatched="keep")
    assert out.count() == 900          # every request kept, none dropped or capped
    hot = out.filter(F.col("RA") == "1")
    assert hot.count() == 300 and hot.filter(F.col("`INDE 22`") == 5.0).count() == 300
