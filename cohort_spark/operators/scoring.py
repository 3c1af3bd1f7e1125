"""Scoring a snapshot (C3–C7, M7): adds ``_risk_score``, ``_risk_label`` and
``_media`` to every row, by rule or by a fitted model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..functions import rules as R
from ..profile import DEFAULT, Profile

SCORE_COLUMNS = ("Matem", "Portug", "Inglês", "INDE 22", "Pedra 20", "Pedra 21", "Pedra 22", "IEG", "IPS")


def score_rule(df: DataFrame, prof: Profile = DEFAULT) -> DataFrame:
    """Rule scorer (C3, C4) plus the subject mean."""
    df = N.coerce_numeric(df, prof.numeric)
    inde = R.rule_inde(df, prof)
    return df.select(
        "*",
        R.rule_score(inde).alias(prof.score),
        R.rule_label(inde).alias(prof.label),
        R.subject_mean(df, prof).alias(prof.mean),
    )


def score_probability(df: DataFrame, proba_col: str, prof: Profile = DEFAULT) -> DataFrame:
    """Probability scorer (C5) on a probability column, plus C6 and C1."""
    p = F.col(proba_col)
    return df.select(
        "*",
        R.proba_score(p).alias(prof.score),
        R.proba_label(p).alias(prof.label),
        R.future_label(p).alias("_future_label"),
        R.subject_mean(df, prof).alias(prof.mean),
    )


def score_raw_prediction(df: DataFrame, pred_col: str, prof: Profile = DEFAULT) -> DataFrame:
    """C7 then C5: min-max scaled raw predictions when no probability exists."""
    scaled = R.minmax_scaled(df, pred_col)
    return score_probability(df.withColumn("_scaled", scaled), "_scaled", prof).drop("_scaled")


def score(df: DataFrame, model=None, prof: Profile = DEFAULT) -> tuple[DataFrame, bool]:
    """M7: model scorer when a usable model is given, else the rule.

    The choice is made once per plan on the driver (not per row). The model
    path is validated against the frame's columns first, because a lazy plan
    cannot fall back silently after it has started running."""
    if model is not None:
        from ..plans.model import model_features_present, score_with_model
        if model_features_present(df, model):
            return score_with_model(df, model, prof), True
    return score_rule(df, prof), False
