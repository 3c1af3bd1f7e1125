"""Substring index, key-clustered store and stored drift references: the rows of
the plain operators, from less reading."""
import os

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from cohort_spark.operators import cohorts as C
from cohort_spark.operators import drift as D
from cohort_spark.operators.search_index import build_index, indexed_rows
from cohort_spark.session import scratch_path
from cohort_spark.sources import keystore as K
from cohort_spark.sources import tables as T_


def rows(df):
    return sorted(map(tuple, df.select(sorted(df.columns)).collect()), key=repr)


@pytest.fixture(scope="module")
def people(spark):
    names = ["Ana Maria", "MARIANA", "João", "Žofie Ñandú", "mar", "", None, "a  b", "100% Mar_iana", "aaaaaa"]
    return spark.createDataFrame([(str(i), n, t, float(i)) for i, (n, t) in enumerate((n, t) for n in names for t in ("Turma 1", "T2", None))],
                                 "RA string, Nome string, Turma string, Matem double")


@pytest.fixture(scope="module")
def path(spark, people):
    path = scratch_path(spark, "index")
    build_index(people, path)
    return path


@pytest.mark.parametrize("q", ["mar", "MARIA", "ñandú", "turma", "%", "", "  ", "aaaa", "arian", "0.0", "a  b", "1"])
def test_index_finds_what_the_scan_finds(spark, people, path, q):
    assert rows(indexed_rows(spark, path, q)) == rows(C.search(people, q))
    assert rows(indexed_rows(spark, path, q, ("Nome",))) == rows(C.search(people, q, ("Nome",)))


def test_a_query_opens_the_buckets_of_its_runs(spark, path):
    from cohort_spark.operators.search_index import candidates
    found = candidates(spark, path, "mari", ("Nome",))
    plan = found._jdf.queryExecution().executedPlan().toString()
    buckets = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "bucket" in buckets and "IN" in buckets
    # files opened, as told by the scan's own metric
    found.collect()
    scan = found._jdf.queryExecution().executedPlan().toString()
    every = len(spark.read.parquet(f"{path}/postings").inputFiles())
    named = [int(x) for x in buckets.split("IN (")[1].split(")")[0].split(",")]
    opened = spark.read.parquet(f"{path}/postings").where(F.col("bucket").isin(named)).select(F.input_file_name()).distinct().count()
    assert scan and 0 < opened <= 2 * len(named) < every


def test_store_opens_one_bucket_and_keeps_its_side_in_place(spark):
    df = T_.snapshot(spark, SMALL, 1996).withColumn("ord", F.col("RA").cast("bigint"))
    name = scratch_path(spark, "keyed").rsplit("/", 1)[1].replace("-", "_")
    K.write_keyed(df, name, scratch_path(spark, "keyed"), buckets=8)
    key = df.orderBy("RA").first()["RA"]
    one = K.lookup(spark, name, f" {key} ")
    assert rows(one) == rows(C.lookup(df, key))
    one.collect()
    scan = one._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
    assert 0 < scan.metrics().apply("numOutputRows").value() < df.count() / 4  # rows of one bucket of eight
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        req = T_.requests(spark, SMALL)
        semi = K.stored_semi_join(spark, name, req)
        first = K.stored_batch_lookup(spark, name, req, "pos", "ord")
        for j in (semi, first):
            plan = j._jdf.queryExecution().executedPlan().toString()
            assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan  # the requests' only
        from cohort_spark.operators import enrich as J
        assert rows(semi) == rows(J.semi_join(df, req)) and rows(first) == rows(J.batch_lookup(df, req, "pos", "ord"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql(f"DROP TABLE {name}")


def test_stored_references_merge_and_compare_exactly(spark):
    inf = float("inf")
    make = lambda vals: spark.createDataFrame([(a, b) for a, b in vals], "f double, g double")
    a = make([(float(i % 50), 1.0) for i in range(400)] + [(inf, None), (None, 1.0)])
    b = make([(i / 7, 1.0) for i in range(333)] + [(-inf, None)])
    cur = make([(i / 5, 2.0) for i in range(200)] + [(inf, 1.0), (None, None)]).withColumn("h", F.lit(3.0))
    state = D.merged_counts([D.value_counts(a, ["f", "g"]), D.value_counts(b, ["f", "g"])])
    got = D.psi_against(D.reference_profile(state), cur, ["f", "g"])
    assert rows(got) == rows(D.psi_table(a.unionAll(b), cur, ["f", "g"]))
    none = D.psi_against(D.reference_profile(state), cur.limit(0), ["f", "g"])
    assert rows(none) == rows(D.psi_table(a.unionAll(b), cur.limit(0), ["f", "g"]))


def test_a_new_period_does_not_read_the_reference(spark):
    from cohort_spark.sources import bundles as B
    ref = spark.range(500).select((F.col("id") % 40).cast("double").alias("f"))
    store = scratch_path(spark, "profile")
    B.publish(spark, store, {"profile": D.reference_profile(D.value_counts(ref, ["f"]))})
    profile = B.table(spark, B.newest(spark, store), "profile")
    out = D.psi_against(profile, spark.range(300).select((F.col("id") % 44).cast("double").alias("f")), ["f"])
    assert all("/profile/" in f for f in out.inputFiles()) and out.first()["ref_count"] == 500
