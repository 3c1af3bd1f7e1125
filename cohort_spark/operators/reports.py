"""Per-pupil reports (C13–C19, C17 profile, S4 prediction rows) as one wide
projection over the whole scored table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import profile as P
from ..functions import numeric as N
from ..functions import rules as R
from ..functions import text as X
from ..profile import DEFAULT, Profile


def _num(df: DataFrame, name: str, places: int):
    return X.decimal_comma(R.c(name), places) if name in df.columns else F.lit(P.MISSING_DISPLAY)


def _txt(df: DataFrame, name: str):
    return X.display_or_dash(R.c(name)) if name in df.columns else F.lit(P.MISSING_DISPLAY)


def pupil_profile(scored: DataFrame, risk_type: str = "risco_fallback", prof: Profile = DEFAULT) -> DataFrame:
    """C17 (+ C13, C14, C18, C19): the pupil page's indicators for every pupil."""
    lab = F.col(prof.label)
    follow = R.pupil_follow_up(scored, prof)
    meeting = R.parent_meeting(scored, lab, prof)
    subj = list(prof.subjects)
    return scored.select(
        F.trim(R.c(prof.key).cast("string")).alias("ra"),
        *([R.c(prof.year)] if prof.year in scored.columns else []),
        (F.trim(R.c(prof.name).cast("string")) if prof.name in scored.columns else F.lit("Não Informado")).alias("nome"),
        (F.trim(R.c(prof.klass).cast("string")) if prof.klass in scored.columns else F.lit("-")).alias("turma"),
        F.lit(risk_type).alias("risk_type"),
        F.bround(F.col(prof.score), 9).alias("risk_score"),
        lab.alias("risco"),
        R.confidence_percent(F.col(prof.score)).alias("confianca"),
        X.decimal_comma(F.col(prof.mean), 1).alias("media"),
        _num(scored, prof.inde, 1).alias("inde_22"),
        _num(scored, prof.ieg, 2).alias("ieg"),
        _num(scored, subj[0], 1).alias("matem"),
        _num(scored, subj[1], 1).alias("portug"),
        _num(scored, subj[2], 1).alias("ingles"),
        *[(R.subject_status(R.c(s)) if s in scored.columns else F.lit("Abaixo")).alias(f"status_{n}")
          for s, n in zip(subj, ("matem", "portug", "ingles"))],
        _num(scored, prof.iaa, 2).alias("iaa"),
        _num(scored, prof.ips, 2).alias("ips"),
        _num(scored, prof.ida, 2).alias("ida"),
        _num(scored, prof.ipv, 2).alias("ipv"),
        _num(scored, prof.ian, 2).alias("ian"),
        *[(F.coalesce(R.c(s).cast("string"), F.lit(P.MISSING_DISPLAY)) if s in scored.columns
           else F.lit(P.MISSING_DISPLAY)).alias(f"pedra_{s[-2:]}") for s in prof.stones],
        _txt(scored, prof.psychology).alias("rec_psicologia"),
        F.when(R.indicated(scored, prof), F.lit("Sim")).otherwise(F.lit("Não")).alias("indicado"),
        *[_txt(scored, s).alias(f"rec_av{i + 1}") for i, s in enumerate(prof.recovery)],
        F.when(follow, F.lit(X.FOLLOW_UP_MESSAGES[0])).otherwise(F.lit(X.FOLLOW_UP_MESSAGES[1])).alias("acompanhamento"),
        F.when(meeting, F.lit(X.PARENT_MEETING_MESSAGES[0])).otherwise(
            F.lit(X.PARENT_MEETING_MESSAGES[1])).alias("reunioes_pais"),
    )


def prediction_rows(scored: DataFrame, model_version: str | None = P.MODEL_VERSION, used_model: bool = False,
                    prof: Profile = DEFAULT) -> DataFrame:
    """``ra, risk_label, risk_score, risk_type, model_version, used_model``."""
    ra = F.trim(R.c(prof.key).cast("string")) if prof.key in scored.columns else F.lit("")
    return scored.select(
        F.coalesce(ra, F.lit("")).alias("ra"),
        F.col(prof.label).alias("risk_label"),
        F.bround(F.col(prof.score), 9).alias("risk_score"),
        F.lit("risco_futuro").alias("risk_type"),
        F.lit(model_version).cast("string").alias("model_version"),
        F.lit(used_model).alias("used_model"),
        *[c for c in ("pos",) if c in scored.columns],
    )


def texts(scored: DataFrame, prof: Profile = DEFAULT) -> DataFrame:
    """C15 + C16 for every pupil."""
    lab = F.col(prof.label)
    return scored.select(
        F.trim(R.c(prof.key).cast("string")).alias("ra"),
        *([R.c(prof.year)] if prof.year in scored.columns else []),
        X.recommendation(scored, lab, F.col(prof.mean), prof).alias("recomendacao"),
        X.diagnosis(scored, lab, prof).alias("diagnostico"),
    )


def flags(scored: DataFrame, prof: Profile = DEFAULT) -> DataFrame:
    """C10–C14 for every pupil."""
    lab = F.col(prof.label)
    return scored.select(
        F.trim(R.c(prof.key).cast("string")).alias("ra"),
        *([R.c(prof.year)] if prof.year in scored.columns else []),
        R.latest_stone(scored, prof).alias("ultima_pedra"),
        R.recovery_filled(scored, prof).alias("recuperacao"),
        R.cohort_follow_up(scored, prof).alias("acomp_coorte"),
        R.pupil_follow_up(scored, prof).alias("acomp_aluno"),
        R.parent_meeting(scored, lab, prof).alias("reuniao_pais"),
        N.truthy(R.c(prof.indicated)).alias("indicado") if prof.indicated in scored.columns else F.lit(False).alias("indicado"),
    )
