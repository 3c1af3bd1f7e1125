"""Request enrichment and lookups.

Joins are equi-joins on the trimmed key; Spark picks the strategy from size
statistics (AQE turns a small side into a broadcast at run time and splits a
skewed key's partitions), so no side is broadcast on trust.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import rules as R
from ..functions.numeric import to_double
from ..profile import DEFAULT, Profile
from .normalize import first_per_key, standardize_columns


def _filled(col, dtype: T.DataType):
    """A request value that should win: not null and, for text, not blank."""
    if isinstance(dtype, T.StringType):
        return col.isNotNull() & (F.trim(col) != "")
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return col.isNotNull() & ~F.isnan(col)
    return col.isNotNull()


def _typed(col, have: T.DataType, want: T.DataType):
    """A request value in the stored column's type; what cannot be read is null."""
    if isinstance(want, (T.FloatType, T.DoubleType)):
        return to_double(col, have).cast(want)
    return col.try_cast(want)


def _keyed(req: DataFrame, key: str) -> DataFrame:
    """Requests with standard headers (N1) and the trimmed key; a request
    without a key, or without a key column, has a null one."""
    r = standardize_columns(req)
    given = F.trim(R.c(key).cast("string")) if key in r.columns else F.lit(None).cast("string")
    return r.withColumn(key, F.when(given != "", given))  # null matches no key


def enrich_requests(base: DataFrame, req: DataFrame, unmatched: str = "keep", prof: Profile = DEFAULT) -> DataFrame:
    """Stored rows of the requested keys joined with the requests on the
    trimmed key; for shared columns a filled request value wins; request-only
    columns are kept; a key repeated in the requests repeats the row.

    One ``requests LEFT JOIN base`` (a stream-static join when the requests
    stream). Request headers are standardised (N1) and values for numeric
    columns coerced (N2: bad text is no value) first. A request without a key,
    or without a key column, matches nothing and counts as unknown.
    ``unmatched``: ``'keep'`` keeps requests whose key is unknown,
    as they came; ``'drop'`` drops them; ``'all_or_nothing'`` drops them only when
    some key matched, else keeps every request unchanged."""
    key = prof.key
    b = base.withColumn(key, F.trim(R.c(key).cast("string")))
    r = _keyed(req, key)
    btypes = {f.name: f.dataType for f in b.schema.fields}
    rtypes = {f.name: f.dataType for f in r.schema.fields}
    shared = [c for c in r.columns if c in btypes and c != key]
    only_req = [c for c in r.columns if c not in btypes]
    rr = r.select(R.c(key), *[R.c(c).alias(f"{c}__in") for c in shared + only_req])
    bb = b.select(*[R.c(c) for c in b.columns], F.lit(True).alias("_matched"))
    joined = rr.join(bb, key, "left")
    hit = F.col("_matched").isNotNull()
    cols = []
    for c in b.columns:
        if c == key:
            cols.append(R.c(key))
        elif c in shared:
            vin = _typed(F.col(f"`{c}__in`"), rtypes[c], btypes[c])
            win = _filled(vin, btypes[c])
            cols.append(F.when(~hit, vin).when(win, vin).otherwise(R.c(c)).alias(c))
        else:
            cols.append(R.c(c))
    cols += [F.col(f"`{c}__in`").alias(c) for c in only_req]
    out = joined.select(*cols, hit.alias("_hit"))
    if unmatched == "drop":
        out = out.filter(F.col("_hit"))
    elif unmatched == "all_or_nothing":
        n_matched = out.filter(F.col("_hit")).select(F.count(F.lit(1))).scalar()
        out = out.filter(F.col("_hit") | (n_matched == 0))
    return out.drop("_hit")


def unknown_requests(base: DataFrame, req: DataFrame, prof: Profile = DEFAULT) -> DataFrame:
    """J1 reject side: requests that :func:`enrich_requests` finds no stored
    row for, by the same rules for headers and keys (left anti join)."""
    key = prof.key
    b = base.select(F.trim(R.c(key).cast("string")).alias(key))
    return _keyed(req, key).join(b, key, "left_anti")


def batch_lookup(base: DataFrame, req: DataFrame, pos: str = "pos", base_order: str | None = None,
                 prof: Profile = DEFAULT) -> DataFrame:
    """For each requested key (in request order ``pos``) the first stored
    row of that key; unknown keys are skipped. 'First' is by ``base_order``, or
    without one by the stored row's own values (the same row in every run)."""
    key = prof.key
    b = base.withColumn(key, F.trim(R.c(key).cast("string")))
    if base_order is None:
        order = F.struct(*[R.c(c).cast("string").alias(f"o{i}") for i, c in enumerate(b.columns)])
        first = first_per_key(b.withColumn("_ord", order), [key], "_ord").drop("_ord")
    else:
        first = first_per_key(b, [key], base_order)
    r = req.select(F.trim(R.c(key).cast("string")).alias(key), R.c(pos).alias(pos))
    return r.join(first, key, "inner")


def semi_join(base: DataFrame, keys: DataFrame, prof: Profile = DEFAULT) -> DataFrame:
    """Stored rows whose key is requested."""
    key = prof.key
    k = keys.select(F.trim(R.c(key).cast("string")).alias("_k"))
    return base.join(k, F.trim(R.c(key).cast("string")) == F.col("_k"), "left_semi")
