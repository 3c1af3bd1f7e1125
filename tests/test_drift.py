"""PSI and histograms against a numpy statement of the rule."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from hypothesis import given, settings
from hypothesis import strategies as st

from cohort_spark.operators import drift as D


def numpy_psi(ref, cur, bins=10, eps=1e-6):
    ref = np.asarray([x for x in ref if x is not None and np.isfinite(x)], dtype=float)
    cur = np.asarray([x for x in cur if x is not None and np.isfinite(x)], dtype=float)
    if ref.size == 0 or cur.size == 0:
        return None
    edges = np.unique(np.quantile(ref, np.linspace(0, 1, bins + 1)))
    if edges.size < 3:
        return 0.0
    r, _ = np.histogram(ref, bins=edges)
    c, _ = np.histogram(cur, bins=edges)
    r = np.clip(r / max(r.sum(), 1), eps, None)
    c = np.clip(c / max(c.sum(), 1), eps, None)
    return float(np.sum((c - r) * np.log(c / r)))


def spark_psi(spark, ref, cur):
    rdf = spark.createDataFrame(pd.DataFrame({"f": pd.Series(ref, dtype="float64")}), "f double")
    cdf = spark.createDataFrame(pd.DataFrame({"f": pd.Series(cur, dtype="float64")}), "f double")
    return D.psi_table(rdf, cdf, ["f"]).first()


values = st.lists(st.one_of(st.integers(0, 20).map(float), st.floats(-50, 50, allow_nan=False)), min_size=1,
                  max_size=60)


@settings(max_examples=6, deadline=None)
@given(values, values)
def test_psi_matches_numpy(spark, ref, cur):
    row = spark_psi(spark, ref, cur)
    want = numpy_psi(ref, cur)
    if want is None:
        assert row.psi is None and row.status == "SEM_DADOS"
    else:
        assert abs(row.psi - want) < 1e-7


def test_psi_cases(spark):
    same = [float(i % 13) for i in range(200)]
    r = spark_psi(spark, same, same)
    assert r.psi == 0.0 and r.status == "OK"
    r = spark_psi(spark, same, [])
    assert r.psi is None and r.status == "SEM_DADOS" and r.ref_count == 200 and r.cur_count == 0
    r = spark_psi(spark, [3.0] * 50, same)
    assert r.psi == 0.0
    r = spark_psi(spark, same, [x + 100 for x in same] + [5.0])   # outside values dropped
    assert abs(r.psi - numpy_psi(same, [x + 100 for x in same] + [5.0])) < 1e-7
    r = spark_psi(spark, same, [x * 0.3 for x in same])
    assert r.status == "DRIFT"


def test_histogram_matches_numpy(spark):
    rng = np.random.default_rng(7)
    ref, cur = rng.normal(0, 1, 300), rng.normal(0.5, 2, 250)
    rdf = spark.createDataFrame(pd.DataFrame({"f": ref}))
    cdf = spark.createDataFrame(pd.DataFrame({"f": cur}))
    h = D.histogram(rdf, cdf, ["f"], bins=10).toPandas()
    for side, arr in (("ref", ref), ("cur", cur)):
        want, _ = np.histogram(arr, bins=10)
        got = h[h.side == side].sort_values("bin")["count"].tolist()
        assert got == want.tolist()


def test_psi_on_lineitem_matches_numpy(spark):
    from cohort_spark.sources import tables as T_
    sf = "/root/testdata/sf0.01"
    ref = T_.feature_side(spark, sf, current=False)
    cur = T_.feature_side(spark, sf, current=True)
    got = {r.feature: r.psi for r in D.psi_table(ref, cur, list(T_.LINE_FEATURES)).collect()}
    rp, cp = ref.toPandas(), cur.toPandas()
    for f in T_.LINE_FEATURES:
        assert abs(got[f] - numpy_psi(rp[f].tolist(), cp[f].tolist())) < 1e-9


def _quantiles(spark, columns, bins=10):
    rows = [(name, float(v)) for name, vs in columns.items() for v in vs]
    got = D.quantile_values(spark.createDataFrame(rows, "feature string, value double"), bins).collect()
    return {(r.feature, r.k): r.q for r in got}


COLUMNS = {"one": [4.0], "two": [1.0, 2.0], "ties": [0.0] * 700 + [1.0] * 300, "normal": np.random.default_rng(3).normal(0, 1, 30000),
           "sorted": np.arange(25000.0), "hot": [5.0] * 9000 + list(np.random.default_rng(4).random(11000) * 10)}


def test_quantiles_match_numpy(spark):
    got = _quantiles(spark, COLUMNS)
    for name, vs in COLUMNS.items():
        for k, want in enumerate(np.quantile(np.array(vs, dtype=float), [i * (1.0 / 10) for i in range(11)])):
            assert abs(got[name, k] - want) < 1e-9, (name, k)


def test_quantiles_read_only_the_brackets(spark):
    rows = spark.range(200000).select(F.lit("f").alias("feature"), F.col("id").cast("double").alias("value"))
    near = D._bracketed(rows, 10)
    assert near.count() < 200000 * 11 * 2 * (D.MARGIN + 1) / D.SKETCH + 20
    assert near.agg(F.sum("w")).first()[0] == 200000


def test_quantiles_without_good_brackets_are_exact(spark, monkeypatch):
    monkeypatch.setattr(D, "_bracketed", lambda values, bins: values.groupBy("feature").agg(
        F.min("value").alias("value"), F.max("value").alias("top"), F.count(F.lit(1)).alias("w")))
    got = _quantiles(spark, COLUMNS)
    for name, vs in COLUMNS.items():
        for k, want in enumerate(np.quantile(np.array(vs, dtype=float), [i * (1.0 / 10) for i in range(11)])):
            assert abs(got[name, k] - want) < 1e-9, (name, k)
