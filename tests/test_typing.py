"""Typing rules N1, N2, N4, N5, N9, N10 on small frames."""

from pyspark.sql import functions as F

from cohort_spark.functions import numeric as N
from cohort_spark.operators import normalize as NM


def test_numeric_guard(spark):
    vals = [" 5 ", "1e3", "1d", "1f", "1,5", "1_000", "0x10", "", "abc", "nan", "inf", "-2.5", None]
    df = spark.createDataFrame([(v,) for v in vals], "s string")
    got = [r.x for r in df.select(N.to_double(F.col("s")).alias("x")).collect()]
    assert got[:2] == [5.0, 1000.0]
    assert got[2:10] == [None] * 8          # Java suffixes and other non-numbers are missing; nan -> null
    assert got[10] == float("inf") and got[11] == -2.5 and got[12] is None


def test_binary_target_and_truthy(spark):
    vals = ["Sim", " s ", "NÃO", "x", "0", "no", "", "2.5", "abc", "ok", None, "-1"]
    df = spark.createDataFrame([(v,) for v in vals], "s string")
    rows = df.select(N.binary_target(F.col("s")).alias("t"), N.truthy(F.col("s")).alias("b")).collect()
    assert [r.t for r in rows] == [1, 1, 0, 1, 0, 0, 0, 1, 0, 0, 0, 0]
    assert [r.b for r in rows] == [True, False, False, True, False, False, False, False, False, True, False, False]


def test_standardize_duplicates(spark):
    df = spark.createDataFrame([(1, "a", "b", "c", 2.0)], ["RA ", "Nome Anonimizado", "Fase Ideal", "Fase ideal", "Mat"])
    out = NM.standardize_columns(df)
    assert out.columns == ["RA", "Nome", "Fase ideal", "Matem"]
    assert out.first()["Fase ideal"] == "b"  # the first of the duplicates is kept


def test_next_year_and_first_per_key(spark):
    df = spark.createDataFrame([("S2022",), ("S22",), ("x2024y",)], "s string")
    assert [r.n for r in df.select(NM.next_year(F.col("s")).alias("n")).collect()] == ["2023", "próximo ano", "2025"]
    rq = spark.createDataFrame([("1", 5, "b"), ("1", 2, "a"), ("2", 9, "c")], "RA string, pos long, v string")
    got = sorted((r.RA, r.pos, r.v) for r in NM.first_per_key(rq, ["RA"], "pos").collect())
    assert got == [("1", 2, "a"), ("2", 9, "c")]


def test_feature_choice():
    cat, num = NM.split_features(["RA", "Nome", "Turma", "INDE 22", "Indicado", "Rec Av1", "ano", "IEG"])
    assert cat == ["Indicado", "Turma"] and num == ["IEG", "INDE 22"]


def test_requests_reject_frame(spark):
    from pyspark.sql import types as T

    from cohort_spark.session import scratch_path
    from cohort_spark.sources.io import read_requests
    path = scratch_path(spark, "req-json")
    import os
    os.makedirs(path.replace("file:", ""), exist_ok=True)
    with open(os.path.join(path.replace("file:", ""), "part.json"), "w") as fh:
        fh.write('{"RA": "111", "INDE 22": 5.0}\n{"RA": "222"}\n[1, 2]\n{not json\n')
    good, bad = read_requests(spark, path, {"RA": T.StringType(), "INDE 22": T.DoubleType()})
    assert sorted(r.RA for r in good.collect()) == ["111", "222"]
    assert len(bad.collect()) == 2


def test_regex_search(spark):
    from cohort_spark.operators.cohorts import search
    df = spark.createDataFrame([("Ana", "T1"), ("Bruno", "T2"), (None, "X")], "Nome string, Turma string")
    assert [r.Nome for r in search(df, "^an").collect()] == []          # literal by default
    assert [r.Nome for r in search(df, "^an", regex=True).collect()] == ["Ana"]
    assert [r.Nome for r in search(df, "t2").collect()] == ["Bruno"]


def test_decimal_comma_matches_python_formatting(spark):
    import random

    from cohort_spark.functions.text import decimal_comma
    rnd = random.Random(9)
    vals = [rnd.uniform(-10, 10) for _ in range(300)] + [0.125, 6.25, 6.35, 6.45, 2.675, -0.04, 0.005, 1e-9]
    vals += [k / 8 for k in range(-40, 41)]                 # exact binary ties
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    for places in (1, 2):
        got = [r.t for r in df.select(decimal_comma(F.col("x"), places).alias("t")).collect()]
        want = [f"{v:.{places}f}".replace(".", ",") for v in vals]
        assert got == want
