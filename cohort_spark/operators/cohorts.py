"""Cohort indicators, filters, lists and orders.

Indicators accept ``by`` grouping columns (school, class, year); with
``by=[]`` they return the single cohort row, zeros on empty input.
All counts are ``count_if`` aggregates, so Spark combines them map-side
before the shuffle on the grouping keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import profile as P
from ..functions import numeric as N
from ..functions import rules as R
from ..functions import text as X
from ..profile import DEFAULT, Profile
from .ranks import global_row_number, scalars


def _agg(df: DataFrame, by: list[str], *aggs: Column) -> DataFrame:
    return df.groupBy(*[R.c(b) for b in by]).agg(*aggs) if by else df.agg(*aggs)


def _pct(n: Column, total: Column) -> Column:
    return F.coalesce(F.bround(F.try_divide(n.cast("double"), total.cast("double")) * 100.0, 0).cast("int"),
                      F.lit(0))


def risk_indicators(scored: DataFrame, by: list[str] | None = None, prof: Profile = DEFAULT) -> DataFrame:
    """A1: high / medium / regular counts, integer percents, total."""
    by = by or []
    lab = F.col(prof.label)
    out = _agg(
        scored, by,
        F.count_if(R.high_risk(lab)).alias("n_high"),
        F.count_if(N.nz(lab == "Médio")).alias("n_medium"),
        F.count_if(N.nz(lab == "Regular")).alias("n_regular"),
        F.count(F.lit(1)).alias("total"),
    )
    return out.select(
        *by, "n_high", _pct(F.col("n_high"), F.col("total")).alias("pct_high"),
        "n_medium", _pct(F.col("n_medium"), F.col("total")).alias("pct_medium"),
        "n_regular", _pct(F.col("n_regular"), F.col("total")).alias("pct_regular"),
        "total",
    )


def overall_mean(scored: DataFrame, by: list[str] | None = None, prof: Profile = DEFAULT) -> DataFrame:
    """A2: mean INDE if any is present, else mean of the subject means; with
    its decimal-comma display (C9)."""
    by = by or []
    inde = F.avg(R.c(prof.inde)) if prof.inde in scored.columns else F.lit(None).cast("double")
    out = _agg(scored, by, F.coalesce(inde, F.avg(R.subject_mean(scored, prof))).alias("mean_raw"))
    # the last digits of a sum depend on its order: settle them before a tie is rounded
    return out.select(*by, F.bround(F.bround("mean_raw", 12), 6).alias("media_geral"),
                      X.decimal_comma(F.col("mean_raw"), 1).alias("media_geral_display"))


def below_pass(scored: DataFrame, by: list[str] | None = None, prof: Profile = DEFAULT) -> DataFrame:
    """A3: count of marks below the pass mark per subject (0 if absent)."""
    by = by or []
    names = ("matematica", "portugues", "ingles")
    aggs = [F.count_if(N.nz(R.c(s) < P.PASS_MARK)).alias(n) if s in scored.columns else F.lit(0).alias(n)
            for s, n in zip(prof.subjects, names)]
    return _agg(scored, by, *aggs)


def stone_trend(df: DataFrame, by: list[str] | None = None, prof: Profile = DEFAULT) -> DataFrame:
    """A4: per stone column, mean (2 places half-even; 0 if none) and the
    count at or below the risk stone. One aggregate, then stacked to rows."""
    by = by or []
    aggs = []
    for i, s in enumerate(prof.stones):
        if s in df.columns:
            v = R.c(s)
            aggs += [F.coalesce(F.bround(F.avg(v), 2), F.lit(0.0)).alias(f"m{i}"),
                     F.count_if(N.nz(v <= P.STONE_RISK_LE)).alias(f"r{i}")]
        else:
            aggs += [F.lit(0.0).alias(f"m{i}"), F.lit(0).cast("bigint").alias(f"r{i}")]
    wide = _agg(df, by, *aggs)
    k = len(prof.stones)
    args = ", ".join(f"'{s}', m{i}, r{i}" for i, s in enumerate(prof.stones))
    return wide.select(*[R.c(b) for b in by], F.expr(f"stack({k}, {args}) as (label, media, risco)"))


def action_flags(scored: DataFrame, prof: Profile = DEFAULT) -> dict[str, Column]:
    """Conditions counted by A5: reinforcement, follow-up and parent meeting."""
    lab = F.col(prof.label)
    has_rec = any(s in scored.columns for s in prof.recovery)
    return {"plano_reforco": R.high_risk(lab) & ~R.recovery_filled(scored, prof) if has_rec else F.lit(False),
            "acompanhamento": R.cohort_follow_up(scored, prof), "reuniao_pais": R.parent_meeting(scored, lab, prof)}


def action_counts(scored: DataFrame, by: list[str] | None = None, progress: DataFrame | None = None,
                  prof: Profile = DEFAULT) -> DataFrame:
    """A5: reinforcement, follow-up and parent-meeting counts, plus the
    longitudinal counts (L1, L2) of ``progress`` — the one-row frame of
    ``longitudinal.progress_counts`` — read as one scalar subquery. For all
    years of one table ``longitudinal.actions_by_year`` gives both in one pass."""
    by = by or []
    out = _agg(scored, by, *[F.count_if(c).alias(n) for n, c in action_flags(scored, prof).items()])
    if progress is not None:
        sc = scalars(progress)
        out = out.select("*", *[sc[c].alias(c) for c in progress.columns])
    return out


def cohort_cube(scored: DataFrame, prof: Profile = DEFAULT) -> DataFrame:
    """A1–A6 of every cohort a page can ask for: one row for each year and
    school, each year, each school (trimmed) and all of them (``por_ano`` and
    ``por_escola`` say by which the row is). The rows are read and shuffled
    once, as sums and counts by (year, school); the other cohorts, and all means,
    are made from these."""
    year, school = prof.year, prof.school
    lab = F.col(prof.label)
    sums = {"n_high": R.high_risk(lab), "n_medium": N.nz(lab == "Médio"), "n_regular": N.nz(lab == "Regular"), "total": F.lit(True),
            **action_flags(scored, prof), "indicados": R.indicated(scored, prof), "muito_alto": N.nz(lab == "Muito Alto")}
    for s, n in zip(prof.subjects, ("matematica", "portugues", "ingles")):
        sums[n] = N.nz(R.c(s) < P.PASS_MARK) if s in scored.columns else F.lit(False)
    means = {"inde": R.c(prof.inde) if prof.inde in scored.columns else F.lit(None).cast("double"), "media": R.subject_mean(scored, prof)}
    for i, s in enumerate(prof.stones):
        means[f"m{i}"] = R.c(s).cast("double") if s in scored.columns else F.lit(None).cast("double")
        sums[f"r{i}"] = N.nz(means[f"m{i}"] <= P.STONE_RISK_LE)
    school_col = F.trim(R.c(school).cast("string")) if school in scored.columns else F.lit(None).cast("string")
    base = scored.groupBy(R.c(year).alias("ano"), school_col.alias("escola")).agg(
        *[F.count_if(c).alias(n) for n, c in sums.items()],
        *[f(c).alias(f"{n}_{k}") for n, c in means.items() for k, f in (("sum", F.sum), ("n", F.count))])
    ano, escola = F.col("ano"), F.col("escola")
    cube = base.groupingSets([[ano, escola], [ano], [escola], []], ano, escola).agg(
        (F.grouping("ano") == 0).alias("por_ano"), (F.grouping("escola") == 0).alias("por_escola"),
        *[F.sum(n).alias(n) for n in sums], *[F.sum(f"{n}_{k}").alias(f"{n}_{k}") for n in means for k in ("sum", "n")])
    mean = {n: F.try_divide(F.col(f"{n}_sum"), F.col(f"{n}_n")) for n in means}
    overall = F.coalesce(mean["inde"], mean["media"])
    return cube.select(
        "ano", "escola", "por_ano", "por_escola",
        *[c for n in ("high", "medium", "regular") for c in (F.col(f"n_{n}"), _pct(F.col(f"n_{n}"), F.col("total")).alias(f"pct_{n}"))], "total",
        F.bround(F.bround(overall, 12), 6).alias("media_geral"), X.decimal_comma(overall, 1).alias("media_geral_display"),
        "matematica", "portugues", "ingles",
        *[c for i in range(len(prof.stones)) for c in (F.coalesce(F.bround(mean[f"m{i}"], 2), F.lit(0.0)).alias(f"m{i}"), F.col(f"r{i}"))],
        *action_flags(scored, prof), (F.col("n_high") + F.col("indicados")).alias("alertas"),
        F.col("muito_alto").alias("alertas_acompanhamento"), F.col("n_high").alias("alertas_reuniao"))


def cube_slice(cube: DataFrame, year: int, school: str | None = None) -> DataFrame:
    """The cube's row of a year, and of a school in it if it has rows (P3:
    an unknown school shows all schools)."""
    rows = cube.where(F.col("por_ano") & (F.col("ano") == year))
    whole = rows.where(~F.col("por_escola"))
    if not school or school == "Todas":
        return whole
    one = rows.where(F.col("por_escola") & (F.col("escola") == school))
    return one if not one.isEmpty() else whole


def cube_frames(row: DataFrame, prof: Profile = DEFAULT) -> dict[str, DataFrame]:
    """A1–A6 as their own functions return them, from a row of the cube."""
    stones = ", ".join(f"'{s}', m{i}, r{i}" for i, s in enumerate(prof.stones))
    return {
        "indicadores": row.select("n_high", "pct_high", "n_medium", "pct_medium", "n_regular", "pct_regular", "total"),
        "media_geral": row.select("media_geral", "media_geral_display"),
        "disciplinas": row.select("matematica", "portugues", "ingles"),
        "tendencia": row.select(F.expr(f"stack({len(prof.stones)}, {stones}) as (label, media, risco)")),
        "acoes": row.select("plano_reforco", "acompanhamento", "reuniao_pais"),
        "alertas": row.select("alertas", "alertas_acompanhamento", "alertas_reuniao"),
    }


def alert_count(scored: DataFrame, by: list[str] | None = None, prof: Profile = DEFAULT) -> DataFrame:
    """High-risk count plus truthy-Indicado count (a pupil can count
    twice), and the list pages' variants: ``Muito Alto`` count (follow-up
    list) and high-risk count (parent-meeting list)."""
    by = by or []
    lab = F.col(prof.label)
    return _agg(scored, by,
                (F.count_if(R.high_risk(lab)) + F.count_if(R.indicated(scored, prof))).alias("alertas"),
                F.count_if(N.nz(lab == "Muito Alto")).alias("alertas_acompanhamento"),
                F.count_if(R.high_risk(lab)).alias("alertas_reuniao"))


def schools(df: DataFrame, prof: Profile = DEFAULT) -> DataFrame:
    """Distinct trimmed non-blank schools (sort with ``orderBy`` when shown)."""
    s = F.trim(R.c(prof.school).cast("string"))
    return df.select(s.alias("escola")).filter(F.col("escola").isNotNull() & (F.col("escola") != "")).distinct()


# ---------------------------------------------------------------- filters

def filter_school(df: DataFrame, school: str | None, prof: Profile = DEFAULT) -> DataFrame:
    """Equality on the trimmed school; no-op without school or column."""
    if not school or prof.school not in df.columns:
        return df
    return df.filter(F.trim(R.c(prof.school).cast("string")) == F.lit(school))


SEARCH_COLUMNS = ("Nome", "Turma", "Matem", "Portug", "Inglês")


def search_predicate(df: DataFrame, q: str, columns: tuple[str, ...] = SEARCH_COLUMNS, regex: bool = False) -> Column:
    """P2 predicate: case-folded ``q`` inside any of the columns (literal
    contains; ``regex=True`` uses ``rlike``). A null cell never matches."""
    qn = q.strip().lower()
    out = F.lit(False)
    for name in columns:
        if name not in df.columns:
            continue
        s = F.lower(R.c(name).cast("string"))
        hit = s.rlike(qn) if regex else s.contains(qn)
        out = out | N.nz(hit)
    return out


def search(df: DataFrame, q: str | None, columns: tuple[str, ...] = SEARCH_COLUMNS, regex: bool = False) -> DataFrame:
    """Free-text filter; no-op for an empty query."""
    if not q or not q.strip():
        return df
    return df.filter(search_predicate(df, q, columns, regex))


def filter_with_fallback(df: DataFrame, school: str | None, q: str | None = None,
                         prof: Profile = DEFAULT) -> DataFrame:
    """School + search filter; when the school is unknown or keeps no row,
    all schools are kept. One plan: the hit count is a scalar subquery."""
    base = search(df, q)
    if not school or school == "Todas" or prof.school not in df.columns:
        return base
    hit = N.nz(F.trim(R.c(prof.school).cast("string")) == F.lit(school))
    n_hit = base.filter(hit).select(F.count(F.lit(1))).scalar()
    return base.filter(hit | (n_hit == 0))


def search_pupils(df: DataFrame, q: str, limit: int = P.SEARCH_LIMIT, prof: Profile = DEFAULT,
                  scored: bool = False) -> DataFrame:
    """Key, name or class containing ``q`` (case-insensitive), first
    ``limit`` by key. Returns the risk label when the frame is scored."""
    qn = q.strip().lower()
    if not qn:
        return df.limit(0)
    pred = F.lit(False)
    for name in (prof.key, prof.name, prof.klass):
        if name in df.columns:
            pred = pred | N.nz(F.lower(R.c(name).cast("string")).contains(qn))
    label = F.col(prof.label) if (scored and prof.label in df.columns) else F.lit("Regular")
    order = [F.trim(R.c(prof.key)).asc()]
    out = df.filter(pred).orderBy(*order).limit(limit)
    return out.select(F.trim(R.c(prof.key)).alias("ra"), R.c(prof.name).alias("nome"),
                      R.c(prof.klass).alias("turma"), label.alias("risco"))


def lookup(df: DataFrame, key: str, prof: Profile = DEFAULT) -> DataFrame:
    """Rows of one key (trimmed comparison); many keys: see enrich.batch_lookup."""
    return df.filter(F.trim(R.c(prof.key).cast("string")) == F.lit(str(key).strip()))


def high_risk_rows(scored: DataFrame, prof: Profile = DEFAULT) -> DataFrame:
    """P7."""
    return scored.filter(R.high_risk(F.col(prof.label)))


def follow_up_list(scored: DataFrame, prof: Profile = DEFAULT) -> DataFrame:
    """Label Muito Alto (order: score desc, key)."""
    return scored.filter(N.nz(F.col(prof.label) == "Muito Alto"))


def parent_meeting_list(scored: DataFrame, prof: Profile = DEFAULT) -> DataFrame:
    """High risk and truthy Indicado (order: score desc, key)."""
    return scored.filter(R.parent_meeting(scored, F.col(prof.label), prof))


def temporal_split(df: DataFrame, test_year: int, prof: Profile = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """P10: train = years before ``test_year``, test = that year (partition
    pruning applies when the table is partitioned by year)."""
    y = F.col(prof.year)
    return df.filter(y < test_year), df.filter(y == test_year)


def list_rows(scored: DataFrame, prof: Profile = DEFAULT, extra: list[str] | None = None) -> DataFrame:
    """Pupil list projection: key, name, class, mean display, class, label
    (plus the year and any ``extra`` columns, e.g. grouping keys)."""
    mean = F.col(prof.mean)
    extra = [c for c in (extra or []) if c != prof.year]
    return scored.select(
        F.trim(R.c(prof.key).cast("string")).alias("ra"),
        F.trim(R.c(prof.name).cast("string")).alias("nome"),
        F.trim(R.c(prof.klass).cast("string")).alias("turma"),
        X.decimal_comma(mean, 1).alias("media"),
        R.mean_class(mean).alias("media_classe"),
        F.col(prof.label).alias("risco"),
        F.col(prof.score).alias("risk_score"),
        *([R.c(prof.year)] if prof.year in scored.columns else []),
        *[R.c(c) for c in extra],
    )


def top_high_risk(scored: DataFrame, k: int = P.TOP_HIGH_RISK, by: list[str] | None = None,
                  prof: Profile = DEFAULT) -> DataFrame:
    """L4: top ``k`` high-risk pupils by score (ties by key) per group.

    ``row_number() <= k`` over a partitioned window is planned with a partial
    window-group limit before the shuffle, so a hot group ships at most ``k``
    rows per input partition."""
    by = by or []
    rows = list_rows(high_risk_rows(scored, prof), prof, extra=by)
    order = [F.col("risk_score").desc(), F.col("ra").asc()]
    if not by:
        w = Window.partitionBy(F.lit(0)).orderBy(*order)
    else:
        w = Window.partitionBy(*[R.c(b) for b in by]).orderBy(*order)
    return rows.withColumn("row_number", F.row_number().over(w)).filter(F.col("row_number") <= k)


def full_list(scored: DataFrame, prof: Profile = DEFAULT) -> DataFrame:
    """O1: every pupil by score desc (ties by key), with its position."""
    rows = list_rows(scored, prof)
    extra = [F.col(prof.year).asc()] if prof.year in rows.columns else []
    return global_row_number(rows, [F.col("risk_score").desc(), F.col("ra").asc(), *extra])


def export_frame(scored: DataFrame, prof: Profile = DEFAULT) -> DataFrame:
    """S3 / O2: high-risk export rows (RA, Aluno, Turma, Média 1 place, Risco)
    in label-alphabetical, then mean-ascending (nulls last) order."""
    hr = high_risk_rows(scored, prof)
    rows = hr.select(
        F.trim(R.c(prof.key).cast("string")).alias("RA"),
        F.trim(R.c(prof.name).cast("string")).alias("Aluno"),
        F.trim(R.c(prof.klass).cast("string")).alias("Turma"),
        F.bround(F.col(prof.mean), 1).alias("Média"),
        F.col(prof.label).alias("Risco"),
    )
    return rows


def export_keys() -> list:
    """O2: label, then mean (missing last), then key."""
    return [F.col("Risco").asc(), F.col("Média").asc_nulls_last(), F.col("RA").asc()]


def export_order(rows: DataFrame) -> DataFrame:
    """O2 with visible positions."""
    return global_row_number(rows, export_keys())
