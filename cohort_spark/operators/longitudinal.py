"""Year-over-year rules (L1–L3) and the action counts by year (A5) from one
summary per key.

A key's rows are first settled by (key, year), an aggregate that is combined
map-side: a key that holds a third of all rows, because its years repeat,
arrives as one row a year. What is left of a key is a list of its years, which
is put in order and walked by array functions; no window, no sort of the rows,
and one shuffle on the key after the settling. Of several rows of one year the
one with the greatest marks (then label) counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import profile as P
from ..functions import rules as R
from ..profile import DEFAULT, Profile


def _z(name: str) -> Column:
    return F.coalesce(R.c(name).cast("double"), F.lit(0.0))


def year_lists(stacked: DataFrame, prof: Profile = DEFAULT, counts: dict[str, Column] | None = None,
               one_row_a_year: bool = False) -> DataFrame:
    """``RA, years``: per key its years in order, each with the settled marks
    (inde, stones, label) and the sums of ``counts`` over all rows of the year.
    Rows without a key form one list (their marks compare with nothing).
    ``one_row_a_year`` says that (key, year) does not repeat, and saves the settling."""
    counts = counts or {}
    marks = F.struct(_z(prof.inde).alias("inde"), *[_z(s).alias(f"p{i}") for i, s in enumerate(prof.stones)], F.col(prof.label).alias("label"))
    rows = stacked.select(R.c(prof.key).cast("string").alias("RA"), R.c(prof.year).alias("ano"), marks.alias("m"), *[c.cast("bigint").alias(n) for n, c in counts.items()])
    if not one_row_a_year:
        rows = rows.groupBy("RA", "ano").agg(F.max("m").alias("m"), *[F.sum(n).alias(n) for n in counts])
    return rows.groupBy("RA").agg(F.sort_array(F.collect_list(F.struct("ano", "m", *counts))).alias("years"))


def _walked(lists: DataFrame, prof: Profile) -> list[Column]:
    """Columns of the progress summary of ``years``: steps without and with a
    rise, number of years, first and last INDE, last label."""
    y = F.col("years")
    names = ["inde", *[f"p{i}" for i in range(len(prof.stones))]]

    def rose(i):
        now, before = F.get(y, i)["m"], F.get(y, i - 1)["m"]
        up = F.lit(False)
        for n in names:
            up = up | (now[n] > before[n])
        return up
    steps = F.slice(F.sequence(F.lit(0), F.size(y)), F.lit(2), F.greatest(F.size(y) - 1, F.lit(0)))
    up = F.size(F.filter(steps, rose)).cast("bigint")
    n = F.size(y).cast("bigint")
    return [(n - 1 - up).alias("steps_without"), up.alias("steps_with"), n.alias("n_years"), F.get(y, F.lit(0))["m"]["inde"].alias("first_inde"),
            F.element_at(y, -1)["m"]["inde"].alias("last_inde"), F.element_at(y, -1)["m"]["label"].alias("last_label")]


def progress_steps(stacked: DataFrame, prof: Profile = DEFAULT, one_row_a_year: bool = False) -> DataFrame:
    """Per key: steps without / with progress, years seen, first and last
    INDE (null -> 0) and the last label."""
    lists = year_lists(stacked.filter(R.c(prof.key).isNotNull()), prof, one_row_a_year=one_row_a_year)
    return lists.select("RA", *_walked(lists, prof))


def actions_by_year(scored: DataFrame, counts: dict[str, Column], min_steps: int = P.NO_PROGRESS_MIN_STEPS, prof: Profile = DEFAULT) -> DataFrame:
    """A5: per year the sums of ``counts`` (conditions as 0 / 1) and, the same
    in every row, the keys kept by L1 and by L2. The rows are read once: the
    lists of years carry both."""
    lists = year_lists(scored, prof, counts)
    steps = lists.select("RA", "years", *_walked(lists, prof))
    kept = {"sem_progresso": F.col("steps_without") >= min_steps, "proxima_fase": _next_phase(steps)}
    none = [F.lit(0).cast("bigint").alias(n) for n in kept]
    per_year = F.transform("years", lambda y: F.struct(F.lit(False).alias("whole"), y["ano"].alias("ano"), *[y[n].alias(n) for n in counts], *none))
    whole = F.struct(F.lit(True).alias("whole"), F.lit(None).cast(scored.schema[prof.year].dataType).alias("ano"), *[F.lit(0).cast("bigint").alias(n) for n in counts],
                     *[(F.col("RA").isNotNull() & F.coalesce(c, F.lit(False))).cast("bigint").alias(n) for n, c in kept.items()])
    out = steps.select(F.explode(F.concat(per_year, F.array(whole))).alias("r")).select("r.*").groupBy("whole", "ano").agg(*[F.sum(n).alias(n) for n in (*counts, *kept)])
    # one row a year, and one of the keys
    every = Window.partitionBy(F.lit(0))
    return out.select("whole", "ano", *counts, *[F.max(n).over(every).alias(n) for n in kept]).where("not whole").drop("whole")


def no_progress(stacked: DataFrame, min_steps: int = P.NO_PROGRESS_MIN_STEPS, prof: Profile = DEFAULT, one_row_a_year: bool = False) -> DataFrame:
    """L1: keys with at least ``min_steps`` year steps without progress."""
    return progress_steps(stacked, prof, one_row_a_year).filter(F.col("steps_without") >= min_steps).select("RA", "steps_without")


def _next_phase(steps: DataFrame) -> Column:
    return (F.col("last_inde") > F.col("first_inde")) & F.coalesce(
        F.col("last_label").isin(*P.NEXT_PHASE_LABELS), F.lit(False))


def next_phase(stacked: DataFrame, prof: Profile = DEFAULT, one_row_a_year: bool = False) -> DataFrame:
    """L2: last INDE above the first and last label Regular or Médio."""
    steps = progress_steps(stacked, prof, one_row_a_year)
    return steps.filter(_next_phase(steps)).select("RA", "first_inde", "last_inde", "last_label")


def progress_counts(stacked: DataFrame, min_steps: int = P.NO_PROGRESS_MIN_STEPS,
                    prof: Profile = DEFAULT) -> DataFrame:
    """One row: the number of keys kept by L1 and by L2 (one job)."""
    steps = progress_steps(stacked, prof)
    return steps.agg(F.count_if(F.col("steps_without") >= min_steps).alias("sem_progresso"),
                     F.count_if(_next_phase(steps)).alias("proxima_fase"))


def evolution(stacked: DataFrame, keys: DataFrame | None = None, prof: Profile = DEFAULT, one_row_a_year: bool = False) -> DataFrame:
    """L3: per key, ``sem_progresso`` (no step ever rose, also with a single
    year), ``proxima_fase`` (as L2) and a message. With ``keys`` (a frame with
    a ``RA`` column) every requested key gets a row; keys without history get
    both flags false and the insufficient-history message."""
    steps = progress_steps(stacked, prof, one_row_a_year)
    ev = steps.select(
        "RA",
        (F.col("steps_with") == 0).alias("sem_progresso"),
        _next_phase(steps).alias("proxima_fase"),
        F.lit("").alias("mensagem"),
    )
    if keys is None:
        return ev
    req = keys.select(F.trim(F.col("RA").cast("string")).alias("RA")).distinct()
    return req.join(ev, "RA", "left").select(
        "RA",
        F.coalesce("sem_progresso", F.lit(False)).alias("sem_progresso"),
        F.coalesce("proxima_fase", F.lit(False)).alias("proxima_fase"),
        F.coalesce("mensagem", F.lit(P.NO_HISTORY_MESSAGE)).alias("mensagem"),
    )
