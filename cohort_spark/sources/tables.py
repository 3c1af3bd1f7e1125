"""Binding of the driver's Parquet tables to the pupil schema.

The test data has no pupil table, so yearly pupil snapshots are derived from
``orders`` (one row per customer and order year), joined to ``customer`` and
``nation``. Every mark is formed from integer cents or integer counts so the
result does not depend on the order of floating-point additions.

Views (names used by the registered queries):

``pupil_year``  orders ⋈ customer ⋈ nation, every year in ``orders``
``requests``    events (request records keyed by user id)
``feat_ref`` / ``feat_cur``  lineitem shipped before / from ``DRIFT_SPLIT_YEAR``
``scored``      labels ⋈ documents (binary label + score in 0..1); ``doc_scores`` the score of every document
``raw_text``    messy texts formed from events (typing rules)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TEST_YEAR = 2001         # temporal split: years before train, this year tests
DRIFT_REF_YEAR = 1996    # snapshots that the pupil drift compares
DRIFT_CUR_YEAR = 1998
DRIFT_SPLIT_YEAR = 1998  # line items shipped before are the reference, the others current
LINE_FEATURES = ("l_quantity", "l_discount", "l_tax", "l_extendedprice")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _year_window(col: str, years: tuple[int, ...]) -> Column:
    """Range predicate on a timestamp so the scan can push it down."""
    lo, hi = min(years), max(years) + 1
    return (F.col(col) >= F.lit(f"{lo}-01-01").cast("timestamp_ntz")) & (
        F.col(col) < F.lit(f"{hi}-01-01").cast("timestamp_ntz"))


def order_years(spark: SparkSession, sf_dir: str) -> list[int]:
    """The years that ``orders`` holds, rising (one row per year reaches the driver)."""
    found = read_table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("y")).where("y is not null").distinct()
    return sorted(r["y"] for r in found.collect())


def pupil_year(spark: SparkSession, sf_dir: str, years: tuple[int, ...] | None = None) -> DataFrame:
    """One pupil row per (customer, order year), of every year or the given ones."""
    orders = read_table(spark, sf_dir, "orders").select(
        "o_custkey", "o_orderdate", "o_totalprice", "o_orderpriority", "o_orderstatus")
    if years is not None:
        orders = orders.filter(_year_window("o_orderdate", years))
    prio = F.col("o_orderpriority")
    status = F.col("o_orderstatus")
    per_year = (
        orders.withColumn("ano", F.year("o_orderdate"))
        .groupBy("o_custkey", "ano")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint")).alias("cents"),
            F.min("o_totalprice").alias("pmin"),
            F.max("o_totalprice").alias("pmax"),
            F.count_if(prio.startswith("1-")).alias("p1"),
            F.count_if(prio.startswith("2-")).alias("p2"),
            F.count_if(prio.startswith("3-")).alias("p3"),
            F.count_if(prio.startswith("4-")).alias("p4"),
            F.count_if(prio.startswith("5-")).alias("p5"),
            F.count_if(status == "F").alias("nf"),
            F.count_if(status == "O").alias("no"),
            F.count_if(status == "P").alias("np"),
            F.count_if((status == "P") & prio.startswith("1-")).alias("npu"),
        )
    )
    customer = read_table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    nation = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    n = F.col("n").cast("double")

    def share(x: str) -> Column:
        return F.col(x).cast("double") / n

    def stone(x: str) -> Column:
        return F.when(F.col(x) > 0, F.col(x).cast("double"))

    return (
        per_year.join(customer, per_year.o_custkey == customer.c_custkey)
        .join(nation, customer.c_nationkey == nation.n_nationkey)
        .select(
            F.col("o_custkey").cast("string").alias("RA"),
            F.col("ano").cast("int").alias("ano"),
            F.col("c_name").alias("Nome"),
            F.col("c_mktsegment").alias("Turma"),
            F.col("n_name").alias("Instituição de ensino"),
            (F.col("cents").cast("double") / n / F.lit(5e6)).alias("INDE 22"),
            (F.col("pmin") / F.lit(5e4)).alias("Matem"),
            (F.col("pmax") / F.lit(5e4)).alias("Portug"),
            F.when(F.col("n") >= 2, (F.col("pmin") + F.col("pmax")) / F.lit(1e5)).alias("Inglês"),
            stone("p1").alias("Pedra 20"),
            stone("p2").alias("Pedra 21"),
            stone("p3").alias("Pedra 22"),
            share("nf").alias("IEG"),
            share("no").alias("IPS"),
            share("p4").alias("IDA"),
            share("p5").alias("IAA"),
            share("np").alias("IPV"),
            share("p1").alias("IAN"),
            F.when(F.col("nf") > 0, F.lit("Sim")).when(F.col("no") > 0, F.lit("Não")).alias("Indicado"),
            F.when(F.col("npu") > 0, F.lit("Encaminhado")).when(F.col("np") > 0, F.lit("")).alias("Rec Psicologia"),
            F.when(F.col("np") >= 2, F.lit("OK")).alias("Rec Av1"),
            F.when(F.col("nf") >= 3, F.lit(" ")).alias("Rec Av2"),
            F.when(F.col("no") == F.col("n"), F.lit("Inativo")).otherwise(F.lit("Ativo")).alias("Ativo/ Inativo"),
        )
    )


def snapshot(spark: SparkSession, sf_dir: str, year: int) -> DataFrame:
    """One yearly snapshot (no ``ano`` column, like a sheet)."""
    return pupil_year(spark, sf_dir, (year,)).drop("ano")


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request records: RA = user id, an optional INDE override on purchases."""
    ev = read_table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    return ev.select(
        F.col("user_id").cast("string").alias("RA"),
        F.col("event_id").alias("pos"),
        F.when(F.col("event_type") == "purchase", F.col("value") / F.lit(50.0)).alias("INDE 22"),
        F.when(F.col("event_type") == "signup", F.lit("Sim"))
        .when(F.col("event_type") == "error", F.lit(" ")).alias("Indicado"),
        F.col("event_type").alias("canal"),
    )


def feature_side(spark: SparkSession, sf_dir: str, current: bool) -> DataFrame:
    """Line items on one side of the split year; every dated row is on one side."""
    li = read_table(spark, sf_dir, "lineitem").select("l_shipdate", *LINE_FEATURES)
    split = F.lit(f"{DRIFT_SPLIT_YEAR}-01-01").cast("timestamp_ntz")
    return li.filter(F.col("l_shipdate") >= split if current else F.col("l_shipdate") < split).select(*LINE_FEATURES)


def _doc_score() -> Column:
    n = F.col("n_chars").cast("double")
    return n / (n + F.lit(2000.0))


def doc_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score in 0..1 for every document."""
    return read_table(spark, sf_dir, "documents").select("doc_id", _doc_score().alias("score"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Binary label ``y`` and score in 0..1 (ties included)."""
    labels = read_table(spark, sf_dir, "labels").select("doc_id", "quality")
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return labels.join(docs, "doc_id").select(
        "doc_id",
        F.col("quality").cast("int").alias("y"),
        _doc_score().alias("score"),
    )


def _cents_text(v: Column) -> Column:
    """A double with two decimals written from its integer cents."""
    cents = F.round(v * 100).cast("bigint")
    return F.concat((cents / 100).cast("bigint").cast("string"), F.lit("."),
                    F.lpad((cents % 100).cast("string"), 2, "0"))


def raw_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messy texts derived from ``events`` for the typing rules."""
    ev = read_table(spark, sf_dir, "events").select("event_id", "event_type", "value", "props")
    t = _cents_text(F.col("value"))
    et = F.col("event_type")
    return ev.select(
        F.col("event_id").alias("id"),
        F.when(et == "click", t)
        .when(et == "view", F.concat(F.lit(" "), t, F.lit(" ")))
        .when(et == "purchase", F.replace(t, F.lit("."), F.lit(",")))
        .when(et == "signup", F.concat(t, F.lit("d")))
        .otherwise(F.col("props")).alias("txt"),
        F.when(et == "click", F.lit(" Sim "))
        .when(et == "view", F.lit("NÃO"))
        .when(et == "purchase", F.lit("x"))
        .when(et == "signup", t)
        .otherwise(F.lit("ok")).alias("flag"),
    )
