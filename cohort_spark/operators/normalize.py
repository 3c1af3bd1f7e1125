"""Header and schema normalisation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import profile as P
from ..functions import numeric as N
from ..functions import rules as R


def standardize_columns(df: DataFrame, rename: dict[str, str] | None = None) -> DataFrame:
    """Trim headers, rename by the map, keep the first of duplicated names.

    Spark resolves names case-insensitively, so duplicates are settled by
    position on case-folded names (``Fase Ideal`` renamed to ``Fase ideal``
    next to an existing ``Fase ideal`` keeps the first)."""
    rename = P.RENAME_MAP if rename is None else rename
    positional = [f"_c{i}" for i in range(len(df.columns))]
    raw = df.toDF(*positional)
    seen: set[str] = set()
    cols = []
    for i, name in enumerate(df.columns):
        new = rename.get(str(name).strip(), str(name).strip())
        fold = new.casefold()
        if fold in seen:
            continue
        seen.add(fold)
        cols.append(F.col(positional[i]).alias(new))
    return raw.select(*cols)


def split_features(columns: list[str], exclude_text: bool = True) -> tuple[list[str], list[str]]:
    """Allowed, not forbidden and present; sorted categorical, then
    numeric. The free-text recovery notes are left out of the model."""
    barred = {*P.FORBIDDEN_FEATURES, *(P.RECOVERY_TEXT_COLUMNS if exclude_text else ())}
    by_role: dict[bool, list[str]] = {True: [], False: []}  # categorical or not
    for name in sorted(({*P.ALLOWED_FEATURES} & {*columns}) - barred):
        by_role[name in P.CATEGORICAL_FEATURES].append(name)
    if not any(by_role.values()):
        raise ValueError("no usable feature column")
    return by_role[True], by_role[False]


def feature_frame(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """N7 + N6 + N2: the model's feature columns, categorical cleaned to
    strings ('' for missing), numeric as double."""
    cat, num = split_features(df.columns)
    types = {f.name: f.dataType for f in df.schema.fields}
    return df.select(
        *[R.c(k) for k in (keep or [])],
        *[N.categorical_clean(R.c(c)).alias(c) for c in cat],
        *[N.to_double(R.c(c), types[c]).alias(c) for c in num],
    )


def align_columns(df: DataFrame, features: list[str], categorical: set[str] | frozenset[str] = P.CATEGORICAL_FEATURES,
                  keep: list[str] | None = None) -> DataFrame:
    """The given feature list in order; missing ones as typed nulls;
    other columns dropped (except ``keep``)."""
    types = {f.name: f.dataType for f in df.schema.fields}
    out = [R.c(k) for k in (keep or []) if k in df.columns]
    for f in features:
        if f in categorical:
            out.append((N.categorical_clean(R.c(f)) if f in types else F.lit(None).cast("string")).alias(f))
        else:
            out.append((N.to_double(R.c(f), types[f]) if f in types else F.lit(None).cast("double")).alias(f))
    return df.select(*out)


def next_year(sheet):
    """Year after the 4 digits of a snapshot name, else 'próximo ano'."""
    digits = F.regexp_replace(sheet.cast("string"), r"[^0-9]", "")
    return F.when(F.length(digits) == 4, (digits.cast("int") + 1).cast("string")).otherwise(
        F.lit(P.NEXT_YEAR_FALLBACK))


def base_year(sheet):
    """Digits of a snapshot name, or 'base' when it has none."""
    digits = F.regexp_replace(sheet.cast("string"), r"[^0-9]", "")
    return F.when(F.length(digits) > 0, digits).otherwise(F.lit("base"))


def first_per_key(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row per key, the one first in ``order`` (the ingest position).

    A ``min_by`` aggregate instead of ``row_number``: it is combined map-side,
    so a key holding a third of all rows never reaches one task whole."""
    others = [c for c in df.columns if c not in keys]
    first = F.min_by(F.struct(*[R.c(c) for c in others]), R.c(order)).alias("_first")
    return df.groupBy(*[R.c(k) for k in keys]).agg(first).select(
        *[R.c(k) for k in keys], *[F.col(f"_first.`{c}`").alias(c) for c in others])


def schema_of(df: DataFrame) -> dict[str, T.DataType]:
    return {f.name: f.dataType for f in df.schema.fields}
