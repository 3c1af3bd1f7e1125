"""The cohort cube against the single indicators; year lists; request rejects."""
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from cohort_spark.operators import cohorts as C
from cohort_spark.operators import longitudinal as L
from cohort_spark.operators.enrich import enrich_requests, unknown_requests
from cohort_spark.operators.scoring import score_rule
from cohort_spark.sources import tables as T_

SCHOOL = "Instituição de ensino"


@pytest.fixture(scope="module")
def scored(spark):
    df = score_rule(T_.pupil_year(spark, SMALL)).persist()
    yield df
    df.unpersist()


def rows(df):
    return sorted(map(tuple, df.select(sorted(df.columns)).collect()), key=repr)


@pytest.fixture(scope="module")
def cube(scored):
    df = C.cohort_cube(scored).persist()
    yield df
    df.unpersist()


@pytest.mark.parametrize("year,school", [(1996, None), (1998, "FRANCE"), (1997, "no such school"), (1997, "Todas")])
def test_slices_equal_the_single_indicators(scored, cube, year, school):
    cohort = C.filter_with_fallback(scored.where(F.col("ano") == year), school)
    frames = C.cube_frames(C.cube_slice(cube, year, school))
    want = {"indicadores": C.risk_indicators(cohort), "media_geral": C.overall_mean(cohort), "disciplinas": C.below_pass(cohort),
            "tendencia": C.stone_trend(cohort), "acoes": C.action_counts(cohort), "alertas": C.alert_count(cohort)}
    assert frames.keys() == want.keys()
    for name in want:
        assert rows(frames[name]) == rows(want[name]), name


def test_the_cube_shuffles_sums_not_rows(scored):
    plan = C.cohort_cube(score_rule(scored.select(*[c for c in scored.columns if not c.startswith("_")])))._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("Expand"):]
    assert "HashAggregate" in below  # the grouping sets are made from the sums by (year, school)


def test_a_hot_key_is_settled_before_it_is_gathered(spark):
    """A key on a third of the rows, its years repeating: one row a year, the greatest marks count."""
    hot = spark.range(3000).select(F.lit("hot").alias("RA"), (2015 + F.col("id") % 5).cast("int").alias("ano"), (F.col("id") % 7).cast("double").alias("INDE 22"))
    cold = spark.range(6000).select((F.col("id") % 2000).cast("string").alias("RA"), (2015 + F.floor(F.col("id") / 2000)).cast("int").alias("ano"), (F.col("id") % 9).cast("double").alias("INDE 22"))
    df = hot.unionAll(cold).unionAll(hot.limit(5).withColumn("RA", F.lit(None).cast("string")))
    df = df.withColumn("_risk_label", F.lit("Médio")).withColumns({s: F.lit(1.0) for s in ("Pedra 20", "Pedra 21", "Pedra 22")})
    got = {r["RA"]: r for r in L.progress_steps(df).collect()}
    assert len(got) == 2001 and got["hot"]["n_years"] == 5 and got["hot"]["steps_without"] == 4 and got["hot"]["last_inde"] == 6.0
    counted = L.actions_by_year(df, {"n": F.col("INDE 22") > 3})
    want = df.groupBy("ano").agg(F.count_if(F.col("INDE 22") > 3).alias("n"))
    assert rows(counted.select("ano", "n")) == rows(want)
    one = L.progress_counts(df).first()
    assert {(r["sem_progresso"], r["proxima_fase"]) for r in counted.collect()} == {(one["sem_progresso"], one["proxima_fase"])}
    lists = L.year_lists(df).where("RA = 'hot'").select(F.size("years")).first()[0]
    assert lists == 5


def test_one_shuffle_where_years_do_not_repeat(scored):
    plan = L.progress_steps(scored, one_row_a_year=True)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(RA") == 1 and "Window" not in plan and "Sort " not in plan.split("InMemoryTableScan")[0]


def test_rejects_are_what_enrichment_does_not_find(spark):
    base = spark.createDataFrame([("1", "A"), ("2", "B")], "RA string, Nome string")
    for req in (spark.createDataFrame([(" 1 ", 1), ("3", 2), (None, 3), ("  ", 4)], "` RA ` string, pos int"),
                spark.createDataFrame([("x", 1), ("y", 2)], "Nome string, pos int")):
        kept = enrich_requests(base, req).groupBy("pos").count().count()
        unknown = {r["pos"] for r in unknown_requests(base, req).collect()}
        known = {r["pos"] for r in enrich_requests(base, req, unmatched="drop").collect()}
        assert unknown | known == {r["pos"] for r in req.collect()} and not unknown & known and kept == req.count()
