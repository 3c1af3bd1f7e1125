"""Scalar rules as column expressions.

Functions that depend on which columns a snapshot has take the DataFrame and
decide on ``df.columns`` at plan time; the per-row work is one expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import profile as P
from ..profile import DEFAULT, Profile
from .numeric import blank, nz, truthy


def c(name: str) -> Column:
    """Column by exact name (names have spaces, accents and slashes)."""
    return F.col(f"`{name}`")


def has(df: DataFrame, name: str) -> bool:
    return name in df.columns


def null_double() -> Column:
    return F.lit(None).cast("double")


def subject_mean(df: DataFrame, prof: Profile = DEFAULT) -> Column:
    """Mean of the non-null subject marks present in ``df``; null if none."""
    present = [s for s in prof.subjects if has(df, s)]
    if not present:
        return null_double()
    total = None
    count = None
    for s in present:
        v = F.coalesce(c(s), F.lit(0.0))
        k = c(s).isNotNull().cast("int")
        total = v if total is None else total + v
        count = k if count is None else count + k
    return F.when(count > 0, total / count)


def mean_class(mean: Column) -> Column:
    """Null -> ok, < 6 bad, < 7 ok, else good."""
    lo, hi = P.MEAN_CLASS_CUTS
    return (
        F.when(mean.isNull(), F.lit("ok"))
        .when(mean < lo, F.lit("bad"))
        .when(mean < hi, F.lit("ok"))
        .otherwise(F.lit("good"))
    )


def rule_inde(df: DataFrame, prof: Profile = DEFAULT) -> Column:
    """C3 input: the INDE column if it exists, else the subject mean if all
    three subject columns exist, else null; then null -> 6.0, clipped 0..10."""
    if has(df, prof.inde):
        raw = c(prof.inde)
    elif all(has(df, s) for s in prof.subjects):
        raw = subject_mean(df, prof)
    else:
        raw = null_double()
    return F.least(F.greatest(F.coalesce(raw.cast("double"), F.lit(P.RULE_DEFAULT_INDE)), F.lit(0.0)), F.lit(10.0))


def rule_score(inde_clipped: Column) -> Column:
    """Risk score = clip(1 - inde/10, 0, 1)."""
    return F.least(F.greatest(F.lit(1.0) - inde_clipped / F.lit(10.0), F.lit(0.0)), F.lit(1.0))


def rule_label(inde_clipped: Column) -> Column:
    """C4: label from the clipped INDE."""
    a, b, d = P.RULE_CUTS
    return (
        F.when(inde_clipped < a, F.lit("Muito Alto"))
        .when(inde_clipped < b, F.lit("Alto"))
        .when(inde_clipped < d, F.lit("Médio"))
        .otherwise(F.lit("Regular"))
    )


def proba_label(p: Column, cuts: tuple[float, float, float] = P.PROBA_CUTS) -> Column:
    """4-level label of a probability (null -> 0, clipped 0..1)."""
    s = F.least(F.greatest(F.coalesce(p, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    hi, mid, lo = cuts
    return (
        F.when(s >= hi, F.lit("Muito Alto"))
        .when(s >= mid, F.lit("Alto"))
        .when(s >= lo, F.lit("Médio"))
        .otherwise(F.lit("Regular"))
    )


def proba_score(p: Column) -> Column:
    """C5 score: null -> 0, clipped 0..1."""
    return F.least(F.greatest(F.coalesce(p, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))


def future_label(p: Column) -> Column:
    """3-level future label."""
    hi, lo = P.FUTURE_CUTS
    return (
        F.when(p >= hi, F.lit("Alta Defasagem"))
        .when(p >= lo, F.lit("Risco Moderado"))
        .otherwise(F.lit("Baixo Risco"))
    )


def minmax_scaled(df: DataFrame, column: str) -> Column:
    """(x - min) / (max - min) over the whole frame; constant -> 0.

    min and max are one scalar subquery each (computed once, no join)."""
    stats = df.agg(F.min(c(column)).alias("mn"), F.max(c(column)).alias("mx"))
    mn = stats.select("mn").scalar()
    mx = stats.select("mx").scalar()
    return F.when(mx > mn, (c(column) - mn) / (mx - mn)).otherwise(F.lit(0.0))


def same_year_target(df: DataFrame, prof: Profile = DEFAULT) -> Column:
    """INDE < 4 or IPS < 0.4 or Pedra 22 <= 1 (null -> false), as 0/1."""
    parts = []
    if has(df, prof.inde):
        parts.append(nz(c(prof.inde) < P.TARGET_INDE_LT))
    if has(df, prof.ips):
        parts.append(nz(c(prof.ips) < P.TARGET_IPS_LT))
    if has(df, prof.stones[-1]):
        parts.append(nz(c(prof.stones[-1]) <= P.TARGET_PEDRA_LE))
    out = F.lit(False)
    for p in parts:
        out = out | p
    return out.cast("int")


def next_year_target(stacked: DataFrame, prof: Profile = DEFAULT) -> DataFrame:
    """C8 with ``horizon=1``: the target of year t is the same-year rule
    evaluated on the key's row of year t + 1 (null when that row is absent, or
    the key is null; any of several rows of that year counts). One shuffle on
    the key and a range frame of exactly the next year, no join."""
    w = Window.partitionBy(R_key(prof)).orderBy(c(prof.year).cast("int")).rangeBetween(1, 1)
    nxt = F.max(same_year_target(stacked, prof)).over(w)
    return stacked.withColumn("target_next", F.when(R_key(prof).isNotNull(), nxt))


def R_key(prof: Profile) -> Column:
    """The trimmed key as text."""
    return F.trim(c(prof.key).cast("string"))


def latest_stone(df: DataFrame, prof: Profile = DEFAULT) -> Column:
    """Latest non-null of Pedra 22, 21, 20 as text, else '-'."""
    present = [c(s).cast("string") for s in reversed(prof.stones) if has(df, s)]
    return F.coalesce(*present, F.lit(P.MISSING_DISPLAY)) if present else F.lit(P.MISSING_DISPLAY)


def recovery_filled(df: DataFrame, prof: Profile = DEFAULT) -> Column:
    """C11: some recovery note is filled; false when no such column exists."""
    present = [s for s in prof.recovery if has(df, s)]
    out = F.lit(False)
    for s in present:
        out = out | ~blank(c(s))
    return out


def cohort_follow_up(df: DataFrame, prof: Profile = DEFAULT) -> Column:
    """Inactive status, or IEG < .4, or a psychology note."""
    out = F.lit(False)
    if has(df, prof.status):
        out = out | nz(F.lower(c(prof.status).cast("string")).contains(P.INACTIVE_MARK))
    if has(df, prof.ieg):
        out = out | nz(c(prof.ieg) < P.LOW_ENGAGEMENT)
    if has(df, prof.psychology):
        out = out | ~blank(c(prof.psychology))
    return out


def pupil_follow_up(df: DataFrame, prof: Profile = DEFAULT) -> Column:
    """IEG < .4, or IPS < .4, or a psychology note (no status test)."""
    out = F.lit(False)
    if has(df, prof.ieg):
        out = out | nz(c(prof.ieg) < P.LOW_ENGAGEMENT)
    if has(df, prof.ips):
        out = out | nz(c(prof.ips) < P.LOW_ENGAGEMENT)
    if has(df, prof.psychology):
        out = out | ~blank(c(prof.psychology))
    return out


def indicated(df: DataFrame, prof: Profile = DEFAULT) -> Column:
    """N5 on the indicated column; false when the column is absent."""
    return truthy(c(prof.indicated)) if has(df, prof.indicated) else F.lit(False)


def high_risk(label: Column) -> Column:
    """P7 predicate."""
    return nz(label.isin(*P.HIGH_RISK_LABELS))


def parent_meeting(df: DataFrame, label: Column, prof: Profile = DEFAULT) -> Column:
    """C14: high-risk label and truthy Indicado."""
    return high_risk(label) & indicated(df, prof)


def subject_status(mark: Column) -> Column:
    """C18: 'Abaixo' below the pass mark, else 'Ok'. A missing mark shows as
    below (the page compares the missing '-' as 0)."""
    return F.when(nz(mark >= P.PASS_MARK), F.lit("Ok")).otherwise(F.lit("Abaixo"))


def confidence_percent(score: Column) -> Column:
    """round(score * 100), half to even."""
    return F.bround(F.coalesce(score, F.lit(0.0)) * 100.0, 0).cast("int")


def psi_status(psi: Column) -> Column:
    """C20: null -> SEM_DADOS, < .10 OK, < .25 ATENCAO, else DRIFT."""
    lo, hi = P.PSI_CUTS
    return (
        F.when(psi.isNull(), F.lit("SEM_DADOS"))
        .when(psi < lo, F.lit("OK"))
        .when(psi < hi, F.lit("ATENCAO"))
        .otherwise(F.lit("DRIFT"))
    )
