"""Registered queries: one per inventory ID, each ``f(spark, sf_dir) -> DataFrame``
over the driver's tables bound to the pupil schema (see
:mod:`cohort_spark.sources.tables`). Keys are ``<id>_<short name>``.

Ordered outputs (lists, exports) carry an explicit ``row_number`` so that an
order-insensitive comparison still sees the order.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import profile as P
from ..functions import numeric as N
from ..functions import rules as R
from ..functions import text as X
from ..operators import cohorts as C
from ..operators import drift as D
from ..operators import enrich as J
from ..operators import longitudinal as L
from ..operators import metrics as M
from ..operators import normalize as NM
from ..operators import reports as RP
from ..operators.ranks import global_row_number
from ..operators.scoring import score_raw_prediction, score_rule
from ..session import scratch_path
from ..sources import io as IO
from ..sources import tables as T_

SCHOOL = "Instituição de ensino"
DEFAULT_YEAR = 1996      # the default snapshot (first year)
LIST_YEAR = 1997         # snapshot used by the list / search queries
SEARCH_Q = "customer#00000012"
LOOKUP_KEY = "123"
SCHOOL_NAME = "NATION_7"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def scored_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All bound years, rule-scored."""
    return score_rule(T_.pupil_year(spark, sf_dir))


def scored_year(spark: SparkSession, sf_dir: str, year: int) -> DataFrame:
    return score_rule(T_.pupil_year(spark, sf_dir, (year,)))


def _school(df: DataFrame) -> DataFrame:
    return df.withColumnRenamed(SCHOOL, "escola")


# ------------------------------------------------------------------ sources

@register("s1_read_snapshot")
def s1_read_snapshot(spark, sf_dir):
    """Write the stacked snapshots partitioned by year, read one year back."""
    path = scratch_path(spark, "snapshots")
    IO.write_snapshots(T_.pupil_year(spark, sf_dir), path)
    one = IO.read_snapshot(spark, path, LIST_YEAR)
    return one.select("RA", "ano", "Nome", F.col("`INDE 22`").alias("inde"), F.col("`Pedra 22`").alias("pedra_22"))


def _other_years(spark, sf_dir, years: list[int]) -> dict[int, DataFrame]:
    """The years after the first, which share their columns, in one scan."""
    return {years[1]: T_.pupil_year(spark, sf_dir, tuple(years[1:]))} if years[1:] else {}


@register("s2_stack_years")
def s2_stack_years(spark, sf_dir):
    """Union by name of all snapshots; the first lacks the English mark."""
    years = T_.order_years(spark, sf_dir)
    st = IO.stack_years({years[0]: T_.snapshot(spark, sf_dir, years[0]).drop("Inglês"), **_other_years(spark, sf_dir, years)})
    return st.select("RA", "ano", F.col("`INDE 22`").alias("inde"), F.col("Inglês").alias("ingles"),
                     F.col("Indicado").alias("indicado"))


@register("s3_export_csv")
def s3_export_csv(spark, sf_dir):
    """High-risk export written as ;-separated CSV with BOM, read back, ordered."""
    rows = C.export_frame(scored_year(spark, sf_dir, LIST_YEAR))
    path = scratch_path(spark, "export")
    IO.write_export_csv(rows.orderBy(*C.export_keys()), path)  # part files in O2 order
    schema = T.StructType([T.StructField("RA", T.StringType()), T.StructField("Aluno", T.StringType()),
                           T.StructField("Turma", T.StringType()), T.StructField("Média", T.DoubleType()),
                           T.StructField("Risco", T.StringType())])
    back = IO.read_export_csv(spark, path, schema)
    return C.export_order(back)


@register("s4_predictions")
def s4_predictions(spark, sf_dir):
    """Prediction rows of the enriched requests (rule scorer)."""
    base = T_.snapshot(spark, sf_dir, DEFAULT_YEAR)
    enriched = J.enrich_requests(base, T_.requests(spark, sf_dir), unmatched="keep")
    return RP.prediction_rows(score_rule(enriched))


@register("s5_requests_json")
def s5_requests_json(spark, sf_dir):
    """Requests written as JSON lines and read back with an all-nullable schema."""
    path = scratch_path(spark, "requests")
    IO.write_requests(T_.requests(spark, sf_dir), path)
    good, _bad = IO.read_requests(spark, path, {"RA": T.StringType(), "pos": T.LongType(),
                                                "INDE 22": T.DoubleType(), "Indicado": T.StringType(),
                                                "canal": T.StringType()})
    return good.select("RA", "pos", F.col("`INDE 22`").alias("inde"), F.col("Indicado").alias("indicado"),
                       "canal")


@register("s8_ledger")
def s8_ledger(spark, sf_dir):
    """Intervention ledger rows for the parent-meeting list, CSV round trip."""
    sc = scored_years(spark, sf_dir)
    rows = C.parent_meeting_list(sc).select(
        F.concat(F.lit("S"), F.col("ano").cast("string")).alias("sheet"),
        F.col("RA").alias("ra"), F.col("Nome").alias("nome"), F.col("Turma").alias("turma"),
        F.make_date(F.col("ano"), F.lit(12), F.lit(31)).alias("data"),
        F.when(N.nz(F.col("Matem") < P.PASS_MARK), F.lit("Matemática")).otherwise(F.lit("Português")).alias("disciplina"),
        F.concat(F.lit("INDE "), X.decimal_comma(F.col("`INDE 22`"), 1)).alias("observacao"),
    )
    path = scratch_path(spark, "ledger")
    IO.write_ledger(rows, path)
    back = IO.read_ledger(spark, path)
    return back.withColumn("data", F.date_format("data", "yyyy-MM-dd"))


# ------------------------------------------------------------ normalisation

@register("n1_standardize_columns")
def n1_standardize_columns(spark, sf_dir):
    cu = T_.read_table(spark, sf_dir, "customer")
    na = T_.read_table(spark, sf_dir, "nation")
    raw = cu.join(na, cu.c_nationkey == na.n_nationkey).select(
        F.col("c_custkey").cast("string").alias(" RA "), F.col("c_name").alias("Nome Anonimizado"),
        F.col("n_name").alias("Escola"), F.col("c_acctbal").alias("Mat"),
        F.col("c_mktsegment").alias("Fase Ideal"), F.lower("c_mktsegment").alias("Fase ideal"),
        F.col("c_nationkey").alias("Idade "))
    return NM.standardize_columns(raw)


@register("n2_coerce_numeric")
def n2_coerce_numeric(spark, sf_dir):
    rt = T_.raw_text(spark, sf_dir)
    return rt.select("id", "txt", N.to_double(F.col("txt")).alias("num"))


@register("n3_clean_numeric")
def n3_clean_numeric(spark, sf_dir):
    rt = T_.raw_text(spark, sf_dir)
    v = rt.select("id", N.to_double(F.col("txt")).alias("num"))
    return v.filter(N.is_finite(F.col("num")))


@register("n4_binary_target")
def n4_binary_target(spark, sf_dir):
    rt = T_.raw_text(spark, sf_dir)
    return rt.select("id", "flag", N.binary_target(F.col("flag")).alias("target"))


@register("n5_truthy")
def n5_truthy(spark, sf_dir):
    rt = T_.raw_text(spark, sf_dir)
    return rt.select("id", "flag", N.truthy(F.col("flag")).alias("truthy"))


@register("n6_categorical_clean")
def n6_categorical_clean(spark, sf_dir):
    py = T_.pupil_year(spark, sf_dir)
    return py.select("RA", "ano", N.categorical_clean(F.col("Indicado")).alias("indicado"),
                     N.categorical_clean(F.col("`Rec Psicologia`")).alias("rec_psicologia"),
                     N.categorical_clean(F.col("`Pedra 20`")).alias("pedra_20"))


@register("n7_feature_choice")
def n7_feature_choice(spark, sf_dir):
    py = T_.pupil_year(spark, sf_dir)
    return NM.feature_frame(py, keep=["RA", "ano"])


@register("n8_align_schema")
def n8_align_schema(spark, sf_dir):
    cat, num = NM.split_features(T_.pupil_year(spark, sf_dir).columns)
    return NM.align_columns(T_.requests(spark, sf_dir), cat + num, keep=["RA", "pos"])


@register("n9_next_year")
def n9_next_year(spark, sf_dir):
    o = T_.read_table(spark, sf_dir, "orders").select(
        F.concat(F.lit("S"), F.year("o_orderdate").cast("string")).alias("sheet"))
    n = T_.read_table(spark, sf_dir, "nation").select(F.col("n_name").alias("sheet"))
    sheets = o.unionByName(n).distinct()
    return sheets.select("sheet", NM.base_year(F.col("sheet")).alias("base_year"),
                         NM.next_year(F.col("sheet")).alias("next_year"))


@register("n10_first_per_key")
def n10_first_per_key(spark, sf_dir):
    rq = T_.requests(spark, sf_dir)
    first = NM.first_per_key(rq, ["RA"], "pos")
    return first.select("RA", "pos", "canal")


# ------------------------------------------------------------------ scalars

def _per_pupil(spark, sf_dir, *cols) -> DataFrame:
    sc = scored_years(spark, sf_dir)
    return sc.select("RA", "ano", *cols)


@register("c1_subject_mean")
def c1_subject_mean(spark, sf_dir):
    return _per_pupil(spark, sf_dir, F.col("_media").alias("media"))


@register("c2_mean_class")
def c2_mean_class(spark, sf_dir):
    return _per_pupil(spark, sf_dir, R.mean_class(F.col("_media")).alias("media_classe"))


@register("c3_rule_score")
def c3_rule_score(spark, sf_dir):
    return _per_pupil(spark, sf_dir, F.bround("_risk_score", 9).alias("risk_score"))


@register("c4_rule_label")
def c4_rule_label(spark, sf_dir):
    return _per_pupil(spark, sf_dir, F.col("_risk_label").alias("risk_label"))


def _docs(spark, sf_dir) -> DataFrame:
    return T_.scored(spark, sf_dir)


@register("c5_proba_label")
def c5_proba_label(spark, sf_dir):
    d = T_.doc_scores(spark, sf_dir)
    return d.select("doc_id", R.proba_label(F.col("score")).alias("risk_label"),
                    F.bround(R.proba_score(F.col("score")), 9).alias("risk_score"))


@register("c6_future_label")
def c6_future_label(spark, sf_dir):
    d = T_.doc_scores(spark, sf_dir)
    return d.select("doc_id", R.future_label(F.col("score")).alias("future_label"))


@register("c7_minmax_scale")
def c7_minmax_scale(spark, sf_dir):
    docs = T_.read_table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").cast("double").alias("raw"))
    return docs.select("doc_id", F.bround(R.minmax_scaled(docs, "raw"), 12).alias("scaled"))


@register("c8_same_year_target")
def c8_same_year_target(spark, sf_dir):
    py = T_.pupil_year(spark, sf_dir)
    return py.select("RA", "ano", R.same_year_target(py).alias("target"))


@register("c8_next_year_target")
def c8_next_year_target(spark, sf_dir):
    """C8, horizon 1: the same-year rule read on the following year's row."""
    out = R.next_year_target(T_.pupil_year(spark, sf_dir))
    return out.select("RA", "ano", "target_next")


@register("c9_decimal_display")
def c9_decimal_display(spark, sf_dir):
    sc = scored_years(spark, sf_dir)
    return sc.select("RA", "ano", X.decimal_comma(F.col("`INDE 22`"), 1).alias("inde_txt"),
                     X.decimal_comma(F.col("_media"), 1).alias("media_txt"),
                     X.decimal_comma(F.col("IEG"), 2).alias("ieg_txt"),
                     X.decimal_comma(F.col("Inglês"), 1).alias("ingles_txt"))


def _flag(name: str):
    def q(spark, sf_dir):
        return RP.flags(scored_years(spark, sf_dir)).select("ra", "ano", name)
    return q


for _id, _col in (("c10_latest_stone", "ultima_pedra"), ("c11_recovery_filled", "recuperacao"),
                  ("c12_cohort_follow_up", "acomp_coorte"), ("c13_pupil_follow_up", "acomp_aluno"),
                  ("c14_parent_meeting", "reuniao_pais")):
    register(_id)(_flag(_col))


@register("c15_recommendation")
def c15_recommendation(spark, sf_dir):
    return RP.texts(scored_years(spark, sf_dir)).select("ra", "ano", "recomendacao")


@register("c16_diagnosis")
def c16_diagnosis(spark, sf_dir):
    return RP.texts(scored_years(spark, sf_dir)).select("ra", "ano", "diagnostico")


@register("c17_pupil_profile")
def c17_pupil_profile(spark, sf_dir):
    return RP.pupil_profile(scored_years(spark, sf_dir))


@register("c18_subject_status")
def c18_subject_status(spark, sf_dir):
    return RP.pupil_profile(scored_years(spark, sf_dir)).select(
        "ra", "ano", "status_matem", "status_portug", "status_ingles")


@register("c19_confidence")
def c19_confidence(spark, sf_dir):
    return RP.pupil_profile(scored_years(spark, sf_dir)).select("ra", "ano", "confianca")


def _pupil_drift(spark, sf_dir) -> DataFrame:
    ref = T_.snapshot(spark, sf_dir, T_.DRIFT_REF_YEAR)
    cur = T_.snapshot(spark, sf_dir, T_.DRIFT_CUR_YEAR)
    return D.psi_table(ref, cur, list(P.DRIFT_FEATURES))


@register("c20_psi_status")
def c20_psi_status(spark, sf_dir):
    return _pupil_drift(spark, sf_dir).select("feature", "status")


# ------------------------------------------------------------------ filters

@register("p1_filter_school")
def p1_filter_school(spark, sf_dir):
    return C.filter_school(scored_years(spark, sf_dir), SCHOOL_NAME).select("RA", "ano", "_risk_label")


@register("p2_search")
def p2_search(spark, sf_dir):
    return C.search(scored_years(spark, sf_dir), SEARCH_Q).select("RA", "ano", "Nome")


def _indexed(spark, sf_dir, years=None) -> str:
    from ..operators.search_index import build_index
    path = scratch_path(spark, "search")
    build_index(T_.pupil_year(spark, sf_dir, years), path, (*C.SEARCH_COLUMNS, "RA"))
    return path


@register("p2_indexed_search")
def p2_indexed_search(spark, sf_dir):
    """P2 by the substring index."""
    from ..operators.search_index import indexed_rows
    return indexed_rows(spark, _indexed(spark, sf_dir), SEARCH_Q).select("RA", "ano", "Nome")


@register("p4_indexed_search")
def p4_indexed_search(spark, sf_dir):
    """P4 on the rows that the substring index finds."""
    from ..operators.search_index import indexed_rows
    found = indexed_rows(spark, _indexed(spark, sf_dir, (LIST_YEAR,)), SEARCH_Q, ("RA", "Nome", "Turma"))
    return C.search_pupils(found.drop("ano"), SEARCH_Q, P.SEARCH_LIMIT)


@register("p3_filter_fallback")
def p3_filter_fallback(spark, sf_dir):
    sc = scored_years(spark, sf_dir)
    unknown = C.filter_with_fallback(sc, "ATLANTIS").select("RA", "ano", F.lit("unknown").alias("case"))
    known = C.filter_with_fallback(sc, SCHOOL_NAME).select("RA", "ano", F.lit("known").alias("case"))
    return unknown.unionByName(known)


@register("p4_search_pupils")
def p4_search_pupils(spark, sf_dir):
    out = C.search_pupils(T_.snapshot(spark, sf_dir, LIST_YEAR), SEARCH_Q, P.SEARCH_LIMIT)
    return out


@register("p5_search_scored")
def p5_search_scored(spark, sf_dir):
    return C.search_pupils(scored_year(spark, sf_dir, LIST_YEAR), SEARCH_Q, P.SEARCH_SCORED_LIMIT, scored=True)


@register("p6_lookup")
def p6_lookup(spark, sf_dir):
    return C.lookup(scored_years(spark, sf_dir), LOOKUP_KEY).select(
        "RA", "ano", F.bround("_risk_score", 9).alias("risk_score"), F.col("_risk_label").alias("risk_label"))


def _keyed_store(spark, df: DataFrame, name: str) -> str:
    from ..sources.keystore import write_keyed
    path = scratch_path(spark, name)
    table = path.rsplit("/", 1)[1].replace("-", "_")
    write_keyed(df, table, path)
    return table


@register("p6_store_lookup")
def p6_store_lookup(spark, sf_dir):
    """P6 on the key-clustered store: one bucket is read."""
    from ..sources.keystore import lookup
    return lookup(spark, _keyed_store(spark, scored_years(spark, sf_dir), "keyed"), LOOKUP_KEY).select(
        "RA", "ano", F.bround("_risk_score", 9).alias("risk_score"), F.col("_risk_label").alias("risk_label"))


@register("j3_store_semi_join")
def j3_store_semi_join(spark, sf_dir):
    """J3 on the key-clustered store: the stored side is not moved."""
    from ..sources.keystore import stored_semi_join
    table = _keyed_store(spark, T_.snapshot(spark, sf_dir, DEFAULT_YEAR), "keyed")
    return stored_semi_join(spark, table, T_.requests(spark, sf_dir)).select("RA", "Nome")


@register("p7_high_risk")
def p7_high_risk(spark, sf_dir):
    return C.high_risk_rows(scored_years(spark, sf_dir)).select("RA", "ano", "_risk_label")


def _ordered_list(rows: DataFrame) -> DataFrame:
    lst = C.list_rows(rows)
    return global_row_number(lst, [F.col("ano").asc(), F.col("risk_score").desc(), F.col("ra").asc()])


@register("p8_follow_up_list")
def p8_follow_up_list(spark, sf_dir):
    return _ordered_list(C.follow_up_list(scored_years(spark, sf_dir)))


@register("p9_parent_meeting_list")
def p9_parent_meeting_list(spark, sf_dir):
    return _ordered_list(C.parent_meeting_list(scored_years(spark, sf_dir)))


@register("p10_temporal_split")
def p10_temporal_split(spark, sf_dir):
    train, test = C.temporal_split(T_.pupil_year(spark, sf_dir), T_.TEST_YEAR)
    return train.select("RA", "ano", F.lit("train").alias("split")).unionByName(
        test.select("RA", "ano", F.lit("test").alias("split")))


# -------------------------------------------------------------------- joins

@register("j1_enrich_requests")
def j1_enrich_requests(spark, sf_dir):
    base = T_.snapshot(spark, sf_dir, DEFAULT_YEAR)
    out = J.enrich_requests(base, T_.requests(spark, sf_dir), unmatched="keep")
    return out.select("RA", "pos", F.col("`INDE 22`").alias("inde"), F.col("Indicado").alias("indicado"),
                      "canal", "Nome")


@register("j1_unknown_requests")
def j1_unknown_requests(spark, sf_dir):
    base = T_.snapshot(spark, sf_dir, DEFAULT_YEAR)
    return J.unknown_requests(base, T_.requests(spark, sf_dir)).select("RA", "pos")


@register("j2_batch_lookup")
def j2_batch_lookup(spark, sf_dir):
    base = scored_year(spark, sf_dir, DEFAULT_YEAR)
    out = J.batch_lookup(base, T_.requests(spark, sf_dir), pos="pos")
    return out.select(F.col("RA").alias("ra"), "pos", F.bround("_risk_score", 9).alias("risk_score"),
                      F.col("_risk_label").alias("risk_label"))


@register("j3_semi_join")
def j3_semi_join(spark, sf_dir):
    base = T_.snapshot(spark, sf_dir, DEFAULT_YEAR)
    return J.semi_join(base, T_.requests(spark, sf_dir)).select("RA", "Nome")


# ------------------------------------------------------------- aggregations

@register("a1_risk_indicators")
def a1_risk_indicators(spark, sf_dir):
    """Share of high-risk pupils per year and school (the flagship query)."""
    return C.risk_indicators(_school(scored_years(spark, sf_dir)), by=["ano", "escola"])


@register("a2_overall_mean")
def a2_overall_mean(spark, sf_dir):
    return C.overall_mean(_school(scored_years(spark, sf_dir)), by=["ano", "escola"])


@register("a3_below_pass")
def a3_below_pass(spark, sf_dir):
    return C.below_pass(_school(scored_years(spark, sf_dir)), by=["ano", "escola"])


@register("a4_stone_trend")
def a4_stone_trend(spark, sf_dir):
    return C.stone_trend(T_.pupil_year(spark, sf_dir), by=["ano"])


@register("a5_action_counts")
def a5_action_counts(spark, sf_dir):
    sc = scored_years(spark, sf_dir)
    return L.actions_by_year(sc, C.action_flags(sc))


@register("a6_alert_count")
def a6_alert_count(spark, sf_dir):
    return C.alert_count(_school(scored_years(spark, sf_dir)), by=["ano", "escola"])


@register("a6_cohort_cube")
def a6_cohort_cube(spark, sf_dir):
    """A1–A6 with P1 and P3: all cohorts (year and school, year, school, all) in one pass."""
    return C.cohort_cube(scored_years(spark, sf_dir))


@register("a6_dashboard")
def a6_dashboard(spark, sf_dir):
    """The dashboard job for one year's cohort, its tables read back as (table, measure, value)."""
    from .dashboard import write_dashboard
    out = scratch_path(spark, "dashboard")
    names = write_dashboard(T_.pupil_year(spark, sf_dir), LIST_YEAR, out)
    tables = {n: spark.read.parquet(f"{out}/{n}") for n in names}
    tables["tendencia"] = tables["tendencia"].groupBy().agg(*[F.max(F.when(F.col("label") == s, F.col(c))).alias(f"{c} {s}") for s in P.DEFAULT.stones for c in ("media", "risco")])
    tables["media_geral"] = tables["media_geral"].drop("media_geral_display")
    for n in ("alunos_alto_risco", "escolas"):
        tables[n] = tables[n].agg(F.count(F.lit(1)).alias("linhas"))
    long = [df.select(F.lit(n).alias("tabela"), F.explode(F.map_from_arrays(F.array(*map(F.lit, df.columns)), F.array(*[R.c(c).cast("double") for c in df.columns]))).alias("medida", "valor"))
            for n, df in tables.items()]
    return reduce(DataFrame.unionAll, long)


@register("a7_schools")
def a7_schools(spark, sf_dir):
    return C.schools(T_.pupil_year(spark, sf_dir))


def _train_frame(spark, sf_dir) -> DataFrame:
    py = T_.pupil_year(spark, sf_dir)
    return py.withColumn("y", R.same_year_target(py))


@register("a8_class_weights")
def a8_class_weights(spark, sf_dir):
    train, _ = C.temporal_split(_train_frame(spark, sf_dir), T_.TEST_YEAR)
    return M.class_weights(train.select("RA", "ano", "y"), "y").withColumn("w", F.bround("w", 12))


@register("a9_dataset_sizes")
def a9_dataset_sizes(spark, sf_dir):
    train, test = C.temporal_split(T_.pupil_year(spark, sf_dir), T_.TEST_YEAR)
    return M.dataset_sizes(train, test)


def _line_sides(spark, sf_dir):
    return T_.feature_side(spark, sf_dir, current=False), T_.feature_side(spark, sf_dir, current=True)


@register("a10_histogram")
def a10_histogram(spark, sf_dir):
    ref, cur = _line_sides(spark, sf_dir)
    h = D.histogram(ref, cur, list(T_.LINE_FEATURES), bins=10)
    return h.withColumn("left_edge", F.bround("left_edge", 9))


@register("a11_psi")
def a11_psi(spark, sf_dir):
    ref, cur = _line_sides(spark, sf_dir)
    return D.psi_table(ref, cur, list(T_.LINE_FEATURES)).select("feature", "psi")


@register("a12_drift")
def a12_drift(spark, sf_dir):
    ref, cur = _line_sides(spark, sf_dir)
    return D.psi_table(ref, cur, list(T_.LINE_FEATURES))


@register("a12_drift_profile")
def a12_drift_profile(spark, sf_dir):
    """A12 against stored references: the states of two earlier periods are
    published, merged without reading their rows again, and the profile made of
    them is compared with the current period."""
    from ..sources import bundles as B
    li = T_.read_table(spark, sf_dir, "lineitem").select("l_shipdate", *T_.LINE_FEATURES)
    ref = li.where(F.col("l_shipdate") < F.lit(f"{T_.DRIFT_SPLIT_YEAR}-01-01").cast("timestamp_ntz"))
    early = F.col("l_shipdate") < F.lit(f"{T_.DRIFT_REF_YEAR}-01-01").cast("timestamp_ntz")
    store, features = scratch_path(spark, "profiles"), list(T_.LINE_FEATURES)
    paths = [B.publish(spark, f"{store}/{n}", {"values": D.value_counts(rows, features)}) for n, rows in (("early", ref.where(early)), ("late", ref.where(~early)))]
    state = D.merged_counts([B.table(spark, p, "values") for p in paths])
    profile = B.publish(spark, f"{store}/all", {"profile": D.reference_profile(state)})
    return D.psi_against(B.table(spark, profile, "profile"), T_.feature_side(spark, sf_dir, current=True), features)


@register("a13_status_summary")
def a13_status_summary(spark, sf_dir):
    return D.status_summary(_pupil_drift(spark, sf_dir))


@register("a14_threshold_metrics")
def a14_threshold_metrics(spark, sf_dir):
    m = M.threshold_metrics(_docs(spark, sf_dir))
    return m.select("tp", "fp", "fn", "tn", *[F.bround(c, 12).alias(c) for c in ("precision", "recall", "f1")])


@register("a15_roc_auc")
def a15_roc_auc(spark, sf_dir):
    return M.rank_metrics(_docs(spark, sf_dir)).select("roc_auc")


@register("a16_avg_precision")
def a16_avg_precision(spark, sf_dir):
    return M.rank_metrics(_docs(spark, sf_dir)).select("pr_auc")


@register("a17_evaluation")
def a17_evaluation(spark, sf_dir):
    ev = M.evaluation(_docs(spark, sf_dir))
    return ev.select("n_pos", "n_neg", "roc_auc", "pr_auc",
                     *[F.bround(c, 12).alias(c) for c in ("f1", "precision", "recall")])


# ------------------------------------------------------------- longitudinal

@register("l1_no_progress")
def l1_no_progress(spark, sf_dir):
    return L.no_progress(scored_years(spark, sf_dir), one_row_a_year=True)


@register("l2_next_phase")
def l2_next_phase(spark, sf_dir):
    out = L.next_phase(scored_years(spark, sf_dir), one_row_a_year=True)
    return out.select("RA", F.bround("first_inde", 9).alias("first_inde"),
                      F.bround("last_inde", 9).alias("last_inde"), "last_label")


@register("l3_evolution")
def l3_evolution(spark, sf_dir):
    return L.evolution(scored_years(spark, sf_dir), keys=T_.requests(spark, sf_dir), one_row_a_year=True)


@register("l4_top_high_risk")
def l4_top_high_risk(spark, sf_dir):
    out = C.top_high_risk(scored_years(spark, sf_dir), P.TOP_HIGH_RISK, by=["ano"])
    return out.select("ano", "row_number", "ra", "nome", "turma", "media", "media_classe", "risco",
                      F.bround("risk_score", 9).alias("risk_score"))


# ------------------------------------------------------------------- orders

@register("o1_full_list")
def o1_full_list(spark, sf_dir):
    out = C.full_list(scored_year(spark, sf_dir, LIST_YEAR))
    return out.select("row_number", "ra", "nome", "turma", "media", "media_classe", "risco",
                      F.bround("risk_score", 9).alias("risk_score"))


@register("o2_export_order")
def o2_export_order(spark, sf_dir):
    return C.export_order(C.export_frame(scored_year(spark, sf_dir, LIST_YEAR)))


@register("o3_drift_order")
def o3_drift_order(spark, sf_dir):
    res = _pupil_drift(spark, sf_dir)
    # one row per monitored feature: a global window over a bounded table
    w = Window.orderBy(F.col("psi").desc_nulls_last(), F.col("feature"))
    return res.select(F.row_number().over(w).alias("row_number"), "feature", "psi", "status",
                      "ref_count", "cur_count")


@register("o4_union_by_name")
def o4_union_by_name(spark, sf_dir):
    """O4 / S2 with scoring per snapshot: the first year has no INDE column,
    so its rule score falls back to the subject mean (C3 branch)."""
    years = T_.order_years(spark, sf_dir)
    first = score_rule(T_.snapshot(spark, sf_dir, years[0]).drop("INDE 22"))
    st = IO.stack_years({years[0]: first, **{y: score_rule(f) for y, f in _other_years(spark, sf_dir, years).items()}})
    return st.select("RA", "ano", F.bround("_risk_score", 9).alias("risk_score"),
                     F.col("_risk_label").alias("risk_label"), F.col("`INDE 22`").alias("inde"))


# -------------------------------------------------------------------- model

_TRAINED: dict[tuple, tuple] = {}
TEST_YEAR = T_.TEST_YEAR
#: The last year whose rows have a next-year target: rows before train the model, this year's test it.
MODEL_TEST_YEAR = TEST_YEAR - 1


def _labelled(spark, sf_dir) -> DataFrame:
    """Stacked snapshots with the same-year target (C8) as ``y``."""
    py = T_.pupil_year(spark, sf_dir)
    return py.withColumn("y", R.same_year_target(py))


def _next_labelled(spark, sf_dir) -> DataFrame:
    """Stacked snapshots with the target of the next year (C8) as ``y``; null where there is no next year."""
    return R.next_year_target(T_.pupil_year(spark, sf_dir)).withColumnRenamed("target_next", "y")


def _trained(spark: SparkSession, sf_dir: str) -> tuple:
    """Train once per application and data folder (M8): (bundle folder, fitted model)."""
    from .model import train_job
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _TRAINED:
        out = scratch_path(spark, "model")
        _, fitted = train_job(spark, _next_labelled(spark, sf_dir), MODEL_TEST_YEAR, out)
        _TRAINED[key] = (out, fitted)
    return _TRAINED[key]


def trained_dir(spark: SparkSession, sf_dir: str) -> str:
    return _trained(spark, sf_dir)[0]


@register("m5_stratified_split")
def m5_stratified_split(spark, sf_dir):
    from .model import stratified_split
    df = _labelled(spark, sf_dir).select("RA", "ano", "y")
    return stratified_split(df, "y").select("RA", "ano", "y", "is_test")


def _train_features(spark, sf_dir):
    from .model import prepare
    df = _labelled(spark, sf_dir)
    cat, num = NM.split_features([c for c in df.columns if c not in ("y", "RA", "Nome", "ano")])
    return prepare(df, cat, num, keep=["RA", "ano", "y"]), cat, num


@register("m1_category_modes")
def m1_category_modes(spark, sf_dir):
    """M1: most frequent value and category count per categorical feature on
    the training years (one job)."""
    from .model import category_modes
    prepared, cat, _ = _train_features(spark, sf_dir)
    return category_modes(prepared.filter(F.col("ano") < TEST_YEAR), cat)


@register("m2_numeric_medians")
def m2_numeric_medians(spark, sf_dir):
    """M2: exact median per numeric feature on the training years (one job),
    the values the fitted pipeline imputes."""
    from ..operators.drift import exact_medians
    from .model import _safe
    prepared, _, num = _train_features(spark, sf_dir)
    back = {_safe(c): c for c in num}
    names = F.create_map(*[x for k, v in back.items() for x in (F.lit(k), F.lit(v))])
    med = exact_medians(prepared.filter(F.col("ano") < TEST_YEAR), list(back))
    return med.select(names[F.col("feature")].alias("feature"), F.bround("median", 9).alias("median"))


@register("m3_feature_matrix")
def m3_feature_matrix(spark, sf_dir):
    """M1–M3: the encoding learnt on the training years applied to every
    pupil-year: size of the feature row and its non-zeros."""
    from .model import feature_matrix, learn_encoding
    prepared, cat, num = _train_features(spark, sf_dir)
    out = feature_matrix(prepared, learn_encoding(prepared.filter(F.col("ano") < TEST_YEAR), cat, num))
    return out.select("RA", "ano", F.col("features.size").alias("n_features"),
                      F.size(F.filter("features.values", lambda x: F.abs(x) >= 5e-10)).alias("nnz"))


@register("m4_root_candidates")
def m4_root_candidates(spark, sf_dir):
    """M4: every split the first tree's root chooses from, with the sums of its
    left side and its gain (second order, L2)."""
    from .model import learn_encoding, prepare, root_candidates
    df = _next_labelled(spark, sf_dir)
    cat, num = NM.split_features([c for c in df.columns if c not in ("y", "RA", "Nome", "ano")])
    train = prepare(df, cat, num, keep=["ano", "y"]).where((F.col("ano") < MODEL_TEST_YEAR) & F.col("y").isNotNull())
    out = root_candidates(train, learn_encoding(train, cat, num))
    return out.select("feature", "category", F.bround("cut", 9).alias("cut"), "n_left", *[F.bround(c, 6).alias(c) for c in ("g_left", "h_left", "gain")])


@register("m4_train_evaluate")
def m4_train_evaluate(spark, sf_dir):
    """M4 + A14–A17: boosted trees fitted on the years before the test year,
    metrics on the test year (the run table written by the job)."""
    from .model import run_table
    return run_table(spark, trained_dir(spark, sf_dir)).select(F.explode("metrics").alias("metric", "value"))


@register("m6_model_scores")
def m6_model_scores(spark, sf_dir):
    from .model import load_bundle, score_with_model
    bundle, _ = load_bundle(spark, trained_dir(spark, sf_dir))
    sc = score_with_model(T_.pupil_year(spark, sf_dir, (TEST_YEAR,)), bundle)
    return sc.select("RA", "ano", F.bround("_risk_score", 9).alias("risk_score"),
                     F.col("_risk_label").alias("risk_label"), "_future_label")


@register("m7_scorer_choice")
def m7_scorer_choice(spark, sf_dir):
    """M7: a missing or broken bundle selects the rule scorer (used_model false)."""
    from ..operators.scoring import score
    from .model import load_bundle
    bundle, meta = load_bundle(spark, scratch_path(spark, "no-model"))
    sc, used = score(T_.snapshot(spark, sf_dir, DEFAULT_YEAR), bundle)
    return RP.prediction_rows(sc, model_version=meta.get("model_version"), used_model=used)


@register("m7_raw_predictions")
def m7_raw_predictions(spark, sf_dir):
    """M7 with a scorer that gives no probability (C7, then C5, C6, C1): the
    falling mark stands for its raw predictions."""
    py = T_.pupil_year(spark, sf_dir)
    sc = score_raw_prediction(py.withColumn("_raw", -R.c("INDE 22")), "_raw")
    return sc.select("RA", "ano", F.bround("_risk_score", 9).alias("risk_score"), F.col("_risk_label").alias("risk_label"),
                     F.col("_future_label").alias("future_label"), F.bround("_media", 9).alias("media"))


@register("m8_train_job")
def m8_train_job(spark, sf_dir):
    """M8: the whole job (temporal split, fit, evaluate, save) — run once per
    session by ``trained_dir`` — and its run table read back."""
    from .model import run_table
    meta = run_table(spark, trained_dir(spark, sf_dir))
    m = F.col("metrics")
    return meta.select("model_name", "model_version", "trained_at",
                       *[m[k].alias(k) for k in ("n_train", "n_test", "n_pos", "n_neg", "roc_auc", "pr_auc",
                                                 "f1", "precision", "recall")])


@register("m9_model_info")
def m9_model_info(spark, sf_dir):
    from .model import model_info
    return model_info(spark, trained_dir(spark, sf_dir))


@register("s6_metadata")
def s6_metadata(spark, sf_dir):
    """Run table written and read back (features, thresholds, sizes)."""
    from .model import run_table
    meta, m = run_table(spark, trained_dir(spark, sf_dir)), F.col("metrics")
    return meta.select("model_name", "model_version", F.size("feature_columns").alias("n_features"),
                       *[F.col("risk_thresholds")[k].alias(k) for k in ("muito_alto_gte", "alto_gte", "medio_gte")],
                       *[m[k].cast("bigint").alias(k) for k in ("n_train", "n_test", "n_pos", "n_neg")])


@register("s7_model_roundtrip")
def s7_model_roundtrip(spark, sf_dir):
    """The published bundle loads back and scores like the fitted model:
    the difference of the two probabilities for every row."""
    from .model import load_bundle, probabilities
    out, fitted = _trained(spark, sf_dir)
    (model, cat, num), _ = load_bundle(spark, out)
    rows = T_.pupil_year(spark, sf_dir, (TEST_YEAR,))
    both = probabilities((fitted, model), rows, cat, num, keep=["RA", "ano"])
    return both.select("RA", "ano", (F.col("_proba") - F.col("_proba1")).alias("difference"))


# ---------------------------------------------------------------- streaming

REQUEST_SCHEMA = T.StructType([T.StructField("RA", T.StringType()), T.StructField("pos", T.LongType()),
                               T.StructField("INDE 22", T.DoubleType()), T.StructField("Indicado", T.StringType()),
                               T.StructField("canal", T.StringType())])


@register("t1_stream_scoring")
def t1_stream_scoring(spark, sf_dir):
    """Request files scored by a Structured Streaming job (availableNow)
    against the newest version of a stored snapshot."""
    from ..streaming import publish_snapshot, run_scoring
    src, sink, ck, store = (scratch_path(spark, n) for n in ("t1-in", "t1-out", "t1-ck", "t1-store"))
    IO.write_requests(T_.requests(spark, sf_dir), src)
    publish_snapshot(spark, store, T_.snapshot(spark, sf_dir, DEFAULT_YEAR))
    run_scoring(spark, src, REQUEST_SCHEMA, store, sink, ck, identity=["pos"])
    return spark.read.parquet(sink).drop("epoch")


@register("t2_stream_drift")
def t2_stream_drift(spark, sf_dir):
    """Lineitem rows streamed by ship date; PSI per closed 90-day window
    against the fixed edges of the reference side; windows still open at the
    watermark are marked as not closed."""
    from ..streaming import drift_windows, run_drift_monitor
    src, sink, ck = (scratch_path(spark, n) for n in ("t2-in", "t2-out", "t2-ck"))
    li = T_.read_table(spark, sf_dir, "lineitem").select("l_shipdate", *T_.LINE_FEATURES)
    li.write.mode("overwrite").parquet(src)
    ref = T_.feature_side(spark, sf_dir, current=False)
    run_drift_monitor(spark, src, li.schema, ref, list(T_.LINE_FEATURES), "l_shipdate", sink, ck)
    return drift_windows(spark, sink)
