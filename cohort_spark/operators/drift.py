"""Feature drift (A10–A13): histograms and the population stability index
for many features in one job.

Plan (no per-feature loop, no group collected into one task, no shuffle of
the distinct values):

1. ``stack`` the monitored columns to ``(feature, value)`` (N3 applied). A
   mergeable sketch per feature gives a bracket around each quantile.
2. Exact reference quantiles: one scan counts the rows between the brackets
   (one row per feature and gap) and the distinct values inside them (well
   under 1 % of the rows). Running totals of these counts give the two order
   statistics around each quantile, interpolated the way numpy's ``linear``
   method does. Should a bracket miss its rank, all values are counted.
3. Edges per feature (``array_sort(array_distinct)``, at most ``bins + 1``)
   are broadcast — one row per feature, bounded by the feature count.
4. One scan of both sides counts ``(side, feature, bin)`` with unrolled
   comparisons; PSI is summed per feature over its bins.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import profile as P
from ..functions import numeric as N
from ..functions import rules as R
from ..session import cut_lineage
from .ranks import running_totals


def long_values(df: DataFrame, features: list[str], side: str, finite: bool = True) -> DataFrame:
    """Unpivot ``features`` to (side, feature, value); N3 when ``finite``."""
    types = {f.name: f.dataType for f in df.schema.fields}
    feats = [f for f in features if f in types]
    args = ", ".join(f"'{f}', `_v{i}`" for i, f in enumerate(feats))
    vals = df.select(*[N.to_double(R.c(f), types[f]).alias(f"_v{i}") for i, f in enumerate(feats)])
    out = vals.select(F.lit(side).alias("side"), F.expr(f"stack({len(feats)}, {args}) as (feature, value)"))
    return out.filter(N.is_finite(F.col("value"))) if finite else out.filter(F.col("value").isNotNull())


def _lerp(a: Column, b: Column, t: Column) -> Column:
    """numpy's linear interpolation (two formulas around t = 0.5)."""
    d = b - a
    return F.when(t >= 0.5, b - d * (F.lit(1.0) - t)).otherwise(a + d * t)


#: Relative rank error of the sketch is 1 / SKETCH; brackets are MARGIN errors wide on each side.
SKETCH = 10_000
MARGIN = 3


def _bracketed(values: DataFrame, bins: int) -> DataFrame:
    """``(feature, value, top, w)``: the distinct values near each quantile
    with their counts, and one row (smallest and largest value, count) for
    each gap between the brackets."""
    at = [k / bins for k in range(bins + 1)]
    slack = MARGIN / SKETCH
    ends = [max(p - slack, 0.0) for p in at] + [min(p + slack, 1.0) for p in at]
    sketch = values.groupBy("feature").agg(F.percentile_approx("value", ends, SKETCH).alias("near"),
                                           F.min("value").alias("mn"), F.max("value").alias("mx"))
    # one row per feature: bounded by the feature count
    j = values.join(F.broadcast(sketch), "feature")
    v = F.col("value")
    inside, gap = F.lit(False), F.lit(0)
    for k, p in enumerate(at):  # unrolled comparisons, so that the scan stays compiled
        lo = F.col("mn") if p <= slack else F.get("near", F.lit(k))
        hi = F.col("mx") if p >= 1 - slack else F.get("near", F.lit(bins + 1 + k))
        inside = inside | ((v >= lo) & (v <= hi))
        gap = gap + (v > hi).cast("int")
    j = j.select("feature", "value", inside.alias("inside"), gap.alias("gap"))
    return (j.groupBy("feature", F.when(F.col("inside"), v).alias("at"), F.when(~F.col("inside"), F.col("gap")).alias("gap"))
            .agg(F.min("value").alias("value"), F.max("value").alias("top"), F.count(F.lit(1)).alias("w"))
            .select("feature", "value", "top", "w"))


def _order_statistics(weighted: DataFrame, bins: int) -> DataFrame:
    """The rows of ``weighted`` (feature, value, top, w) that hold the two
    order statistics around each quantile k/bins: (feature, k, t, which, value, top)."""
    cum = running_totals(weighted, ["feature"], "value", ["w"])
    n = cum.groupBy("feature").agg(F.max(F.col("cum_w_before") + F.col("w")).alias("n"))  # cum is written already
    k = F.explode(F.sequence(F.lit(0), F.lit(bins))).alias("k")
    h = (F.col("n") - 1).cast("double") * (F.col("k").cast("double") * F.lit(1.0 / bins))
    targets = n.select("feature", "n", k).select("feature", "k", "n", h.alias("h"), F.floor(h).cast("bigint").alias("lo"))
    both = F.array(F.struct(F.lit(0).alias("which"), F.col("lo").alias("r")),
                   F.struct(F.lit(1).alias("which"), F.least(F.col("lo") + 1, F.col("n") - 1).alias("r")))
    ranks = targets.select(F.col("feature").alias("t_feature"), "k", (F.col("h") - F.col("lo")).alias("t"), F.explode(both).alias("x"))
    # features x (bins + 1) x 2 rows -> broadcast is bounded
    rk = F.broadcast(ranks.select("t_feature", "k", "t", "x.which", "x.r"))
    return cum.join(rk, (F.col("feature") == F.col("t_feature")) & (F.col("r") >= F.col("cum_w_before"))
                    & (F.col("r") < F.col("cum_w_before") + F.col("w"))).select("feature", "k", "t", "which", "value", "top")


def quantile_values(values: DataFrame, bins: int = P.PSI_BINS) -> DataFrame:
    """Exact quantiles at k/bins (k = 0..bins) per feature of finite
    ``(feature, value)`` rows, interpolated like numpy's ``linear`` method:
    ``(feature, k, q)``."""
    values = values.select("feature", "value")
    hit = cut_lineage(_order_statistics(_bracketed(values, bins), bins))
    if not hit.where("value < top").isEmpty():  # a rank fell between the brackets
        return counted_quantiles(values.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("w")), bins)
    return _interpolated(hit)


def counted_quantiles(counts: DataFrame, bins: int = P.PSI_BINS) -> DataFrame:
    """As :func:`quantile_values`, from the distinct values with their counts ``(feature, value, w)``."""
    return _interpolated(_order_statistics(counts.select("feature", "value", F.col("value").alias("top"), "w"), bins))


def _interpolated(hit: DataFrame) -> DataFrame:
    pair = hit.groupBy("feature", "k", "t").agg(
        F.max(F.when(F.col("which") == 0, F.col("value"))).alias("a"),
        F.max(F.when(F.col("which") == 1, F.col("value"))).alias("b"))
    return pair.select("feature", "k", _lerp(F.col("a"), F.col("b"), F.col("t")).alias("q"))


def quantile_edges(values: DataFrame, bins: int = P.PSI_BINS) -> DataFrame:
    """Exact quantile edges per feature: ``(feature, edges array<double>, m)``,
    sorted and unique; m: their number (at most ``bins + 1``)."""
    return _edges(quantile_values(values, bins))


def _edges(q: DataFrame) -> DataFrame:
    edges = q.groupBy("feature").agg(F.array_sort(F.array_distinct(F.collect_list("q"))).alias("edges"))
    return edges.select("feature", "edges", F.size("edges").alias("m"))


def bin_of(bins: int = P.PSI_BINS) -> Column:
    """Bin (from 1) of ``value`` between the ``m`` ``edges`` of its row, the
    last one closed; 0 outside of them or without edges."""
    v = F.col("value")
    b = F.lit(0)  # unrolled comparisons, so that the scan stays compiled
    for k in range(bins + 1):
        b = b + F.coalesce((v >= F.get("edges", F.lit(k))).cast("int"), F.lit(0))
    b = F.when(v == F.get("edges", F.col("m") - 1), F.col("m") - 1).otherwise(b)
    return F.when((b >= 1) & (b < F.col("m")), b).otherwise(0)


def exact_medians(df: DataFrame, columns: list[str]) -> DataFrame:
    """Exact median (mean of the two middle values) of the finite values of
    each column, all columns in one job: ``(feature, median)``; a column
    without finite values has no row."""
    q = quantile_values(long_values(df, columns, "x"), 2)
    return q.filter(F.col("k") == 1).select("feature", F.col("q").alias("median"))


def psi_table(ref: DataFrame, cur: DataFrame, features: list[str], bins: int = P.PSI_BINS,
              eps: float = P.PSI_EPS) -> DataFrame:
    """A11 + A12: one row per feature present on both sides:
    ``feature, psi, status, ref_count, cur_count`` (PSI null when a side has
    no finite value, 0.0 with fewer than three distinct edges). The counts
    are of the non-null values, ±inf included; the PSI is of the finite ones."""
    feats = [f for f in features if f in ref.columns and f in cur.columns]
    edges = quantile_edges(long_values(ref, feats, "ref"), bins)
    values = long_values(ref, feats, "ref", finite=False).unionByName(long_values(cur, feats, "cur", finite=False))
    # one row per feature, at most bins + 1 doubles each
    j = values.join(F.broadcast(edges), "feature", "left")
    place = F.when(N.is_finite(F.col("value")), bin_of(bins)).otherwise(-1)
    counts = j.groupBy("feature", "m", place.alias("bin")).agg(F.count_if(F.col("side") == "ref").alias("r"),
                                                               F.count_if(F.col("side") == "cur").alias("c"))
    return _psi_of(counts, eps)


def _psi_of(counts: DataFrame, eps: float) -> DataFrame:
    """PSI rows from counts of both sides ``(feature, m, bin, r, c)``."""
    # at most bins + 2 entries per feature; a bin empty on both sides adds nothing
    per = counts.groupBy("feature", "m").agg(
        F.array_sort(F.collect_list(F.struct("bin", "r", "c"))).alias("all"), F.sum("r").alias("ref_count"), F.sum("c").alias("cur_count"),
        *[F.sum(F.when(F.col("bin") >= least, F.col(s))).alias(f"{s}_{name}") for s in ("r", "c") for name, least in (("finite", 0), ("inside", 1))])

    def share(x: Column, side: str) -> Column:
        total = F.greatest(F.coalesce(F.col(f"{side}_inside"), F.lit(0)), F.lit(1))
        return F.greatest(x[side].cast("double") / total.cast("double"), F.lit(eps))

    total = F.aggregate(F.filter("all", lambda x: x["bin"] >= 1), F.lit(0.0),
                        lambda acc, x: acc + (share(x, "c") - share(x, "r")) * F.log(share(x, "c") / share(x, "r")))
    value = (F.when(F.coalesce("r_finite", F.lit(0)) == 0, F.lit(None).cast("double"))
             .when(F.coalesce("c_finite", F.lit(0)) == 0, F.lit(None).cast("double"))
             .when(F.col("m") < 3, F.lit(0.0))
             .otherwise(F.bround(total, 9)))
    out = per.select("feature", value.alias("psi"), "ref_count", "cur_count")
    return out.select("feature", "psi", R.psi_status(F.col("psi")).alias("status"), "ref_count", "cur_count")


# --------------------------------------------------------- stored references

def value_counts(df: DataFrame, features: list[str]) -> DataFrame:
    """The state of a reference that can be stored and merged: the distinct
    non-null values of each feature with their counts ``(feature, value, w)``,
    ±inf included. Exact, and never larger than the values themselves."""
    return long_values(df, [f for f in features if f in df.columns], "x", finite=False).groupBy("feature", "value").agg(F.count(F.lit(1)).alias("w"))


def merged_counts(states: list[DataFrame]) -> DataFrame:
    """The state of all rows of several references, from their states."""
    return reduce(DataFrame.unionByName, states).groupBy("feature", "value").agg(F.sum("w").alias("w"))


def reference_profile(state: DataFrame, bins: int = P.PSI_BINS) -> DataFrame:
    """What a comparison needs of a reference: ``feature, edges, m, counts``
    (bin -> rows; -1 for infinite values, 0 for finite ones without edges), one row a feature."""
    edges = _edges(counted_quantiles(state.where(N.is_finite(F.col("value"))), bins))
    # one row per feature, at most bins + 1 doubles each
    j = state.join(F.broadcast(edges), "feature", "left")
    place = F.when(N.is_finite(F.col("value")), bin_of(bins)).otherwise(-1)
    per = j.groupBy("feature", "edges", "m", place.alias("bin")).agg(F.sum("w").alias("w"))
    return per.groupBy("feature", "edges", "m").agg(F.map_from_entries(F.collect_list(F.struct("bin", "w"))).alias("counts"))


def psi_against(profile: DataFrame, cur: DataFrame, features: list[str], bins: int = P.PSI_BINS, eps: float = P.PSI_EPS) -> DataFrame:
    """A12 of a new period against a stored profile: the same rows as
    :func:`psi_table` with the reference itself, which is not read."""
    feats = [f for f in features if f in cur.columns]
    ref = profile.where(F.col("feature").isin(feats))
    j = long_values(cur, feats, "cur", finite=False).join(F.broadcast(ref.select("feature", "edges", "m")), "feature", "left")
    place = F.when(N.is_finite(F.col("value")), bin_of(bins)).otherwise(-1)
    now = j.groupBy("feature", "m", place.alias("bin")).agg(F.lit(0).cast("bigint").alias("r"), F.count(F.lit(1)).alias("c"))
    then = ref.select("feature", "m", F.explode("counts").alias("bin", "r")).withColumn("c", F.lit(0).cast("bigint"))
    both = now.unionByName(then).groupBy("feature", "m", "bin").agg(F.sum("r").alias("r"), F.sum("c").alias("c"))
    return _psi_of(both, eps)


def drift_ordered(results: DataFrame) -> DataFrame:
    """O3: PSI descending, nulls last, ties by feature."""
    return results.orderBy(F.col("psi").desc_nulls_last(), F.col("feature"))


def status_summary(results: DataFrame) -> DataFrame:
    """Count per status, all four statuses present (zeros included)."""
    aggs = [F.count_if(F.col("status") == s).alias(f"n{i}") for i, s in enumerate(P.PSI_STATUSES)]
    args = ", ".join(f"'{s}', n{i}" for i, s in enumerate(P.PSI_STATUSES))
    return results.agg(*aggs).select(F.expr(f"stack({len(P.PSI_STATUSES)}, {args}) as (status, n)"))


def histogram(ref: DataFrame, cur: DataFrame, features: list[str], bins: int = 10) -> DataFrame:
    """A10: equal-width histogram per (side, feature) between its own min and
    max (last bin closed; a constant feature spans value ± 0.5), with the
    bin edges laid out as numpy's ``linspace`` does. Two scans with partial
    aggregates: sides x features rows, then sides x features x bins rows are
    shuffled, whatever the input."""
    feats = [f for f in features if f in ref.columns and f in cur.columns]
    values = long_values(ref, feats, "ref").unionByName(long_values(cur, feats, "cur"))
    stats = values.groupBy("side", "feature").agg(F.min("value").alias("mn"), F.max("value").alias("mx"))
    lo = F.when(F.col("mx") > F.col("mn"), F.col("mn")).otherwise(F.col("mn") - 0.5)
    hi = F.when(F.col("mx") > F.col("mn"), F.col("mx")).otherwise(F.col("mx") + 0.5)
    st = stats.select("side", "feature", lo.alias("lo"), hi.alias("hi"),
                      ((hi - lo) / F.lit(float(bins))).alias("step"))
    # one row per (side, feature): bounded by 2 x feature count
    j = values.join(F.broadcast(st), ["side", "feature"])
    b = F.lit(0)  # unrolled comparisons, so that the scan stays compiled
    for k in range(1, bins):
        b = b + (F.col("value") >= F.lit(float(k)) * F.col("step") + F.col("lo")).cast("int")
    counts = j.groupBy("side", "feature", b.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    grid = st.select("side", "feature", "lo", "step", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return grid.join(counts, ["side", "feature", "bin"], "left").select(
        "side", "feature", "bin",
        (F.col("bin").cast("double") * F.col("step") + F.col("lo")).alias("left_edge"),
        F.coalesce("count", F.lit(0)).cast("bigint").alias("count"))
