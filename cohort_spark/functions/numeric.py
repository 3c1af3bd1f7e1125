"""Typing rules as column expressions.

All of them stay JVM-side (no Python UDF) so they fuse into whole-stage
codegen with the scan that feeds them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import profile as P

# Text accepted as a number: optional blanks and sign, decimal with optional
# exponent, or inf / infinity / nan. Anything else (``1d``, ``1,5``, ``0x10``,
# ``1_000``, blank) is not a number. The guard is needed because ``try_cast``
# also accepts Java suffixes such as ``1d`` / ``1f``.
NUMERIC_TEXT = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?|[nN][aA][nN])\s*$"


def nan_to_null(c: Column) -> Column:
    """NaN becomes null (pandas NaN means missing; Spark NaN sorts above all)."""
    return F.when(F.isnan(c), F.lit(None).cast("double")).otherwise(c)


def to_double(c: Column, dtype: T.DataType | None = None) -> Column:
    """N2 for one column: numbers as they are, text through the numeric guard,
    bad value -> null, NaN -> null (±inf kept)."""
    if dtype is not None and isinstance(dtype, (T.NumericType,)):
        return nan_to_null(c.cast("double"))
    if dtype is not None and isinstance(dtype, T.BooleanType):
        return c.cast("double")
    s = c.cast("string")
    parsed = F.when(s.rlike(NUMERIC_TEXT), s.try_cast("double"))
    return nan_to_null(parsed)


def coerce_numeric(df: DataFrame, columns: tuple[str, ...] | list[str] | None = None) -> DataFrame:
    """Cast the known numeric columns that exist in ``df`` to double."""
    wanted = set(columns if columns is not None else P.NUMERIC_COLUMNS)
    types = {f.name: f.dataType for f in df.schema.fields}
    cols = []
    for name in df.columns:
        if name in wanted:
            cols.append(to_double(F.col(f"`{name}`"), types[name]).alias(name))
        else:
            cols.append(F.col(f"`{name}`"))
    return df.select(*cols)


def is_finite(c: Column) -> Column:
    """N3 predicate: non-null, non-NaN and finite."""
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def clean_numeric(df: DataFrame, column: str, dtype: T.DataType | None = None) -> DataFrame:
    """Coerce one column and keep only finite values."""
    v = to_double(F.col(f"`{column}`"), dtype)
    return df.select(v.alias(column)).filter(is_finite(F.col(f"`{column}`")))


def binary_target(c: Column, dtype: T.DataType | None = None) -> Column:
    """Mixed-type target to 0/1."""
    if dtype is not None and isinstance(dtype, T.BooleanType):
        return F.coalesce(c, F.lit(False)).cast("int")
    if dtype is not None and isinstance(dtype, T.IntegralType):
        return F.coalesce(c > 0, F.lit(False)).cast("int")
    s = F.lower(F.trim(c.cast("string")))
    num = to_double(c, None)
    return (
        F.when(s.isin(*P.TARGET_POSITIVES), F.lit(1))
        .when(s.isin(*P.TARGET_NEGATIVES), F.lit(0))
        .otherwise(F.coalesce(num > 0, F.lit(False)).cast("int"))
    )


def truthy(c: Column) -> Column:
    """Truthy flag (null -> false)."""
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin(*P.TRUTHY_VALUES), F.lit(False))


def categorical_clean(c: Column) -> Column:
    """Stringify, missing -> ''."""
    s = c.cast("string")
    return F.when(s.isNull() | (s == "nan"), F.lit("")).otherwise(s)


def blank(c: Column) -> Column:
    """True when a free-text cell is empty: null, blank or the text ``nan``."""
    s = F.lower(F.trim(c.cast("string")))
    return F.coalesce(s.isin("", "nan"), F.lit(True))


def nz(pred: Column) -> Column:
    """Null-as-false predicate (a comparison with a missing value is false)."""
    return F.coalesce(pred, F.lit(False))
