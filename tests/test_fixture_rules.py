"""Hand-computed values on the two-pupil fixture (FIXTURES.md F1)."""

from fixture_f1 import snapshot, stacked
from pyspark.sql import functions as F

from cohort_spark.operators import cohorts as C
from cohort_spark.operators import longitudinal as L
from cohort_spark.operators.reports import pupil_profile
from cohort_spark.operators.scoring import score_rule


def _by_ra(df, col):
    return {r["RA"] if "RA" in r else r["ra"]: r[col] for r in df.collect()}


def test_rule_score_and_label(spark):
    sc = score_rule(snapshot(spark))
    assert _by_ra(sc, "_risk_score") == {"111": 0.5, "222": 0.25}
    assert _by_ra(sc, "_risk_label") == {"111": "Alto", "222": "Regular"}
    means = _by_ra(sc, "_media")
    assert abs(means["111"] - 17 / 3) < 1e-12 and means["222"] == 7.5


def test_indicators(spark):
    sc = score_rule(snapshot(spark))
    ind = C.risk_indicators(sc).first()
    assert (ind.n_high, ind.pct_high, ind.n_medium, ind.n_regular, ind.total) == (1, 50, 0, 1, 2)
    m = C.overall_mean(sc).first()
    assert m.media_geral == 6.25 and m.media_geral_display == "6,2"  # half-even on the binary value
    bp = C.below_pass(sc).first()
    assert (bp.matematica, bp.portugues, bp.ingles) == (1, 0, 0)
    tr = {r.label: (r.media, r.risco) for r in C.stone_trend(sc).collect()}
    assert tr == {"Pedra 20": (3.0, 1), "Pedra 21": (3.0, 1), "Pedra 22": (3.0, 1)}


def test_actions_and_alerts(spark):
    sc = score_rule(snapshot(spark))
    st = score_rule(stacked(spark))
    a = C.action_counts(sc, progress=L.progress_counts(st)).first()
    assert (a.plano_reforco, a.acompanhamento, a.reuniao_pais, a.sem_progresso, a.proxima_fase) == (1, 1, 1, 2, 0)
    assert C.alert_count(sc).first().alertas == 2


def test_empty_cohort_is_zero(spark):
    sc = score_rule(snapshot(spark)).filter(F.lit(False))
    ind = C.risk_indicators(sc).first()
    assert (ind.n_high, ind.pct_high, ind.total) == (0, 0, 0)
    tr = C.stone_trend(sc).collect()
    assert sorted((r.label, r.media, r.risco) for r in tr) == [
        ("Pedra 20", 0.0, 0), ("Pedra 21", 0.0, 0), ("Pedra 22", 0.0, 0)]


def test_evolution_single_and_unknown(spark):
    st = score_rule(stacked(spark, (2022,)))
    keys = spark.createDataFrame([("111",), ("999",)], "RA string")
    ev = {r.RA: (r.sem_progresso, r.proxima_fase, r.mensagem) for r in L.evolution(st, keys).collect()}
    # one year: no step ever rose -> no progress (differs from L1)
    assert ev["111"] == (True, False, "")
    assert ev["999"] == (False, False, "Histórico insuficiente.")


def test_profile_page(spark):
    p = {r.ra: r for r in pupil_profile(score_rule(snapshot(spark))).collect()}
    a = p["111"]
    assert (a.media, a.inde_22, a.ieg, a.matem, a.status_matem, a.status_portug) == ("5,7", "5,0", "0,30", "5,0",
                                                                                     "Abaixo", "Ok")
    assert a.indicado == "Sim" and a.reunioes_pais == "Aluno crítico indicado"
    assert a.acompanhamento == "Sinal para acompanhamento" and a.confianca == 50
    assert p["222"].rec_av1 == "OK" and p["222"].indicado == "Não"


def test_top_and_lists(spark):
    sc = score_rule(snapshot(spark))
    top = C.top_high_risk(sc).collect()
    assert [(r.ra, r.row_number, r.media) for r in top] == [("111", 1, "5,7")]
    assert [r.ra for r in C.follow_up_list(sc).collect()] == []
    assert [r.RA for r in C.parent_meeting_list(sc).collect()] == ["111"]


def test_dashboard_job(spark):
    from cohort_spark.plans.dashboard import write_dashboard
    from cohort_spark.session import scratch_path
    out = scratch_path(spark, "dash")
    names = write_dashboard(stacked(spark), 2022, out, school="Escola X")
    got = {n: spark.read.parquet(f"{out}/{n}").collect() for n in names}
    ind = got["indicadores"][0]
    assert (ind.n_high, ind.pct_high, ind.total) == (1, 50, 2)
    assert got["media_geral"][0].media_geral_display == "6,2"
    a = got["acoes"][0]
    assert (a.plano_reforco, a.acompanhamento, a.reuniao_pais, a.sem_progresso, a.proxima_fase) == (1, 1, 1, 2, 0)
    assert got["alertas"][0].alertas == 2 and [r.escola for r in got["escolas"]] == ["Escola X"]
    # an unknown school falls back to every school
    out2 = scratch_path(spark, "dash2")
    write_dashboard(stacked(spark), 2022, out2, school="Escola Z")
    assert spark.read.parquet(f"{out2}/indicadores").first().total == 2
