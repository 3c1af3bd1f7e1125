"""Cohort dashboard job: every indicator of one year's cohort (optionally
one school and a search) plus the longitudinal counts over all years.

The stacked table is scored once and persisted (memory and disk; a lost
block is recomputed from lineage). Without a search the indicators are a row of
the cohort cube, which serves every year and school and is written beside
them; with a search they are counted on the rows found. Every output is written
as its own table under ``out_dir``, and the cache is released.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import profile as P
from ..operators import cohorts as C
from ..operators import longitudinal as L
from ..operators.ranks import scalars
from ..operators.scoring import score
from ..profile import DEFAULT, Profile


def dashboard_frames(scored: DataFrame, year: int, school: str | None = None, q: str | None = None,
                     prof: Profile = DEFAULT, cube: DataFrame | None = None) -> dict[str, DataFrame]:
    """The dashboard's outputs from a scored multi-year table; from a row of
    the ``cube`` where it is given and nothing is searched for."""
    of_year = scored.filter(F.col(prof.year) == year)
    cohort = C.filter_with_fallback(of_year, school, q, prof)
    if cube is not None and not (q and q.strip()) and not C.cube_slice(cube, year).isEmpty():
        frames = C.cube_frames(C.cube_slice(cube, year, school), prof)
    else:
        frames = {"indicadores": C.risk_indicators(cohort, prof=prof), "media_geral": C.overall_mean(cohort, prof=prof),
                  "disciplinas": C.below_pass(cohort, prof=prof), "tendencia": C.stone_trend(cohort, prof=prof),
                  "acoes": C.action_counts(cohort, prof=prof), "alertas": C.alert_count(cohort, prof=prof)}
    progress = scalars(L.progress_counts(scored, prof=prof))
    frames["acoes"] = frames["acoes"].select("*", *[progress[c].alias(c) for c in ("sem_progresso", "proxima_fase")])
    frames["alunos_alto_risco"] = C.top_high_risk(cohort, P.TOP_HIGH_RISK, prof=prof)
    frames["escolas"] = C.schools(of_year, prof)
    return frames


def write_dashboard(stacked: DataFrame, year: int, out_dir: str, school: str | None = None, q: str | None = None,
                    bundle=None, prof: Profile = DEFAULT) -> list[str]:
    """Score once (model ``bundle`` when usable, else the rule — M7),
    persist, write the cube and every output under ``out_dir``; returns the
    names of the outputs."""
    out = out_dir.rstrip("/")
    scored, _used = score(stacked, bundle, prof)
    scored = scored.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        C.cohort_cube(scored, prof).write.mode("overwrite").parquet(f"{out}/cubo")
        frames = dashboard_frames(scored, year, school, q, prof, cube=scored.sparkSession.read.parquet(f"{out}/cubo"))
        for name, df in frames.items():
            df.write.mode("overwrite").parquet(f"{out}/{name}")
        return list(frames)
    finally:
        scored.unpersist()
