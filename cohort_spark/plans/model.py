"""Model path (M1–M9, S6, S7): encoding, boosted trees, training job, scoring.

What a fit learns is kept as tables: the categories of each feature with their
numbers, the most frequent category, median, mean and deviation of each feature,
and the nodes of the trees. The categorical cleaning (N6) and numeric typing
(N2) run before them on both the training and the serving path (one function,
:func:`prepare`). The tables are published as a versioned bundle.
"""

from __future__ import annotations

import math
from datetime import datetime, timezone
from typing import NamedTuple

from pyspark import StorageLevel
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import profile as P
from ..functions import numeric as N
from ..functions import rules as R
from ..operators import boosting as G
from ..operators import metrics as M
from ..operators.normalize import split_features
from ..operators.ranks import running_totals
from ..operators.scoring import score_probability
from ..profile import DEFAULT, Profile
from ..session import ship_package
from ..sources import bundles as B
from ..sources import io as IO

#: An empty category is a level of its own.
BLANK_CATEGORY = "<blank>"


class Fitted(NamedTuple):
    """Learnt tables of a fit: ``categories`` (feature, value, code), ``modes``
    (feature -> most frequent category), ``numeric`` (feature -> median, mean,
    deviation; features without any value are not in it) and the tree nodes."""

    cat: list[str]
    num: list[str]
    categories: DataFrame
    modes: dict[str, str]
    numeric: dict[str, tuple[float, float, float]]
    rows: list[tuple]

    @property
    def used(self) -> tuple[list[str], list[str]]:
        return [_safe(c) for c in self.cat], [_safe(c) for c in self.num if _safe(c) in self.numeric]


def _safe(name: str) -> str:
    """Column name without spaces or accents."""
    return "f_" + "".join(ch if ch.isalnum() and ch.isascii() else "_" for ch in name)


def feature_columns(df: DataFrame, cat: list[str], num: list[str]) -> list:
    """N8 + N6 + N2 as expressions: categorical as cleaned strings (an empty
    cell is the blank level), numeric as double; a feature that the frame does
    not have is null, and is filled by what the fit learnt."""
    types = {f.name: f.dataType for f in df.schema.fields}
    cols = []
    for c in cat:
        e = N.categorical_clean(R.c(c)) if c in types else F.lit(None).cast("string")
        cols.append(F.when(e == "", F.lit(BLANK_CATEGORY)).otherwise(e).alias(_safe(c)))
    for c in num:
        e = N.to_double(R.c(c), types[c]) if c in types else F.lit(None).cast("double")
        cols.append(e.alias(_safe(c)))
    return cols


def prepare(df: DataFrame, cat: list[str], num: list[str], keep: list[str] | None = None) -> DataFrame:
    """The feature columns (plus ``keep``) ready for the fitted pipeline."""
    return df.select(*[R.c(k) for k in (keep or []) if k in df.columns], *feature_columns(df, cat, num))


def category_modes(df: DataFrame, cat: list[str]) -> DataFrame:
    """M1: per categorical column, the most frequent value (ties: smallest)
    and the number of categories, in one job: ``(feature, mode, n_categories)``.
    Value counts are combined map-side; the result has one row per column."""
    safe = [_safe(c) for c in cat]
    args = ", ".join(f"'{c}', `{s}`" for c, s in zip(cat, safe))
    long = df.select(F.expr(f"stack({len(cat)}, {args}) as (feature, value)")).filter(F.col("value").isNotNull())
    counts = long.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("feature").agg(
        F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("mode"),
        F.count(F.lit(1)).alias("n_categories"))


def numeric_medians(df: DataFrame, num: list[str]) -> dict[str, float]:
    """M2 imputation values: exact medians of the safe numeric columns (one
    distributed job; one value per column reaches the driver)."""
    if not num:
        return {}
    from ..operators.drift import exact_medians
    med = exact_medians(df, [_safe(c) for c in num])
    return {r["feature"]: r["median"] for r in med.collect()}


def numeric_scales(df: DataFrame, medians: dict[str, float]) -> dict[str, tuple[float, float, float]]:
    """M2: median, mean and population deviation (1 for a constant) of each
    column after its nulls are filled; one aggregate."""
    if not medians:
        return {}
    filled = {c: F.coalesce(F.col(c), F.lit(m)) for c, m in medians.items()}
    r = df.agg(*[f(filled[c]).alias(f"{n}_{i}") for i, c in enumerate(medians) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    # a constant has no deviation but for the rounding of its mean
    return {c: (m, r[f"m_{i}"], r[f"s_{i}"] if r[f"s_{i}"] > 1e-12 * max(1.0, abs(r[f"m_{i}"])) else 1.0) for i, (c, m) in enumerate(medians.items())}


def filled(df: DataFrame, fitted: Fitted) -> DataFrame:
    """``prepare``d rows with nulls filled: categories by the most frequent, numbers by the median."""
    modes = {c: F.coalesce(F.col(c), F.lit(fitted.modes.get(c))).alias(c) for c in fitted.used[0]}
    medians = {c: F.coalesce(F.col(c), F.lit(fitted.numeric[c][0])).alias(c) for c in fitted.used[1]}
    made = {**modes, **medians}
    return df.select(*[made.get(c, F.col(f"`{c}`")) for c in df.columns])


def feature_matrix(df: DataFrame, fitted: Fitted) -> DataFrame:
    """M1–M3: ``prepare``d rows with ``features``, a sparse row (size, indices,
    values): the columns of each categorical feature hold 1 at the number of
    its category (none for an unknown one), then the scaled numeric ones. The
    categories are joined, feature by feature."""
    cat, num = fitted.used
    sizes = {r["feature"]: r["n"] for r in fitted.categories.groupBy("feature").agg(F.count(F.lit(1)).alias("n")).collect()}
    out, offset, own = filled(df, fitted), 0, df.columns
    ones = []
    for i, c in enumerate(cat):
        d = fitted.categories.where(F.col("feature") == c).select(F.col("value").alias(f"_v{i}"), F.col("code").alias(f"_c{i}"))
        out = out.join(d, out[c] == F.col(f"_v{i}"), "left")
        ones.append(F.when(F.col(f"_c{i}").isNotNull(), F.struct((F.col(f"_c{i}") + offset).alias("i"), F.lit(1.0).alias("v"))))
        offset += sizes.get(c, 0)
    for i, c in enumerate(num):
        _, mean, deviation = fitted.numeric[c]
        ones.append(F.struct(F.lit(offset + i).alias("i"), ((F.col(c) - mean) / deviation).alias("v")))
    every = F.array_compact(F.array(*ones))
    row = F.struct(F.lit(offset + len(num)).alias("size"), F.transform(every, lambda x: x["i"]).alias("indices"), F.transform(every, lambda x: x["v"]).alias("values"))
    return out.select(*[F.col(f"`{c}`") for c in own], row.alias("features"))


#: Key hashes lie below this; a bucket of the first count holds HASH_STEP of them.
HASHES, HASH_STEP = 1000003, 100


def _test_rows_per_class(counts: list[int], test_size: float) -> list[int]:
    """Largest-remainder allocation of ceil(test_size·n) over the classes, in their order."""
    n = sum(counts)
    n_test = math.ceil(float(n) * test_size)
    share = [float(n_test) * float(c) / float(n) for c in counts]
    out = [math.floor(x) for x in share]
    for i in sorted(range(len(counts)), key=lambda i: (-(share[i] - out[i]), i))[: n_test - sum(out)]:
        out[i] += 1
    return out


def stratified_split(df: DataFrame, label: str = "y", test_size: float = 0.2, key: str = "RA",
                     year: str = "ano") -> DataFrame:
    """M5: deterministic stratified split, adds ``is_test``: of each class the
    first rows in order of a key hash, then the key and the year. The test count
    per class follows the largest-remainder allocation of ceil(test_size·n).

    The last test row of a class is selected, not sorted for: one count by hash
    bucket (at most 10,001 a class) finds its bucket, and only that bucket's
    distinct keys are put in order. The rows themselves are then compared with
    the selected key where they are. Rows that share it are told apart by a hash
    of the whole row; of rows that are equal throughout as many copies as needed
    are test rows. A null class is a class."""
    # numeric keys by their value, other texts by their hash
    k = F.coalesce(R.c(key).try_cast("bigint"), F.xxhash64(R.c(key).cast("string")))
    h = F.pmod(F.pmod(k, F.lit(HASHES)) * F.lit(999983) + R.c(year), F.lit(HASHES))
    order = F.struct(F.coalesce(h, F.lit(-1)).alias("h"), k.alias("k"), R.c(key).cast("string").alias("s"), R.c(year).alias("a"))
    keyed = df.withColumn("_o", order)
    rows = keyed.select(F.col(label).alias("c"), "_o")
    bucket = F.floor(F.col("_o.h") / HASH_STEP).cast("bigint").alias("b")
    counted = rows.groupBy("c", bucket).agg(F.count(F.lit(1)).alias("n"))
    found = counted.groupBy("c").agg(F.sum("n").alias("n"), F.sort_array(F.collect_list(F.struct("b", "n"))).alias("buckets")).collect()
    found.sort(key=lambda r: (r["c"] is not None, r["c"] if r["c"] is not None else 0))  # a row a class, in order
    wanted = []
    for r, left in zip(found, _test_rows_per_class([r["n"] for r in found], test_size) if found else []):
        for x in r["buckets"] if left else []:
            if left <= x["n"]:
                wanted.append((r["c"], x["b"], left))
                break
            left -= x["n"]
    out = [F.col(f"`{c}`") for c in df.columns]
    if not wanted:
        return df.withColumn("is_test", F.lit(False))
    cuts = _select(rows.withColumn("b", bucket), wanted, "b", "_o")
    # a class whose cut falls between rows that share the key
    ties = [(r["c"], r["_o"], r["left"]) for r in cuts if r["left"] < r["n"]]
    whole = F.xxhash64(F.to_json(F.struct(*out)))
    second = _select(keyed.select(F.col(label).alias("c"), "_o", whole.alias("r")), ties, "_o", "r") if ties else []
    split = {(r["c"], r["_o"]): r for r in second}
    schema = T.StructType([T.StructField("_c", df.schema[label].dataType), T.StructField("_cut", keyed.schema["_o"].dataType), T.StructField("_r", T.LongType()),
                           T.StructField("_left", T.LongType()), T.StructField("_n", T.LongType())])
    local = [(r["c"], r["_o"], *((s["r"], s["left"], s["n"]) if (s := split.get((r["c"], r["_o"]))) else (None, None, None))) for r in cuts]
    # one row a class
    j = keyed.join(F.broadcast(df.sparkSession.createDataFrame(local, schema)), F.col(label).eqNullSafe(F.col("_c")), "left")
    same = F.col("_o") == F.col("_cut")
    at = F.when(F.col("_r").isNull(), F.lit(True)).otherwise(whole <= F.col("_r"))
    test = F.coalesce(F.when(same, at).otherwise(F.col("_o") < F.col("_cut")), F.lit(False))
    if not any(s["left"] < s["n"] for s in second):
        return j.select(*out, test.alias("is_test"))
    # equal rows on both sides of the cut: each copy is made from one of them
    copies = F.coalesce(same & (whole == F.col("_r")) & (F.col("_left") < F.col("_n")), F.lit(False))
    one = j.where(copies).groupBy("_c", "_left", "_n").agg(F.first(F.struct(*out)).alias("row"))
    made = one.select("row.*", F.explode(F.transform(F.sequence(F.lit(1).cast("bigint"), F.col("_n")), lambda i: i <= F.col("_left"))).alias("is_test"))
    return j.where(~copies).select(*out, test.alias("is_test")).unionAll(made)


def _select(rows: DataFrame, wanted: list[tuple], inside: str, order: str) -> list:
    """For each class ``c`` of ``wanted`` (class, value of ``inside``, rank from 1)
    the value of ``order`` at that rank among its rows: rows (c, <inside>, <order>,
    left, n), the value being held by ``n`` rows of which ``left`` are wanted."""
    schema = T.StructType([T.StructField("_i", T.IntegerType()), T.StructField("_c", rows.schema["c"].dataType),
                           T.StructField("_at", rows.schema[inside].dataType), T.StructField("_rank", T.LongType())])
    to = F.broadcast(rows.sparkSession.createDataFrame([(i, *x) for i, x in enumerate(wanted)], schema))  # one row a class
    mine = rows.join(to, F.col("c").eqNullSafe(F.col("_c")) & (F.col(inside) == F.col("_at")))
    values = mine.groupBy("_i", "c", inside, order, "_rank").agg(F.count(F.lit(1)).alias("n"))
    cum = running_totals(values, ["_i"], order, ["n"])  # by number: a null class is one of them
    before = F.col("cum_n_before")
    return cum.where((before < F.col("_rank")) & (F.col("_rank") <= before + F.col("n"))).select(
        "c", inside, order, (F.col("_rank") - before).alias("left"), "n").collect()


def learn_encoding(prepared: DataFrame, cat: list[str], num: list[str]) -> Fitted:
    """M1 + M2: the encoding of ``prepare``d training rows, without trees."""
    modes = {r["feature"]: r["mode"] for r in category_modes(prepared, cat).collect()} if cat else {}
    safe = [_safe(c) for c in cat]
    spark = prepared.sparkSession
    categories = G.category_table(prepared, safe) if cat else spark.createDataFrame([], "feature string, value string, code int")
    names = {c: _safe(c) for c in cat}
    return Fitted(cat, num, categories, {names[c]: m for c, m in modes.items()}, numeric_scales(prepared, numeric_medians(prepared, num)), [])


def train(df_train: DataFrame, label: str = "y", params: dict | None = None, keep: list[str] | None = None):
    """M8 core: N7 feature choice, weights (A8), fit. Returns (model, cat, num).
    Rows without a label take no part."""
    cat, num = split_features([c for c in df_train.columns if c != label])
    # every stage of the fit reads the prepared frame: keep it, and release it afterwards
    prepared = prepare(df_train, cat, num, keep=[label] + (keep or [])).where(F.col(label).isNotNull()).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        ship_package(prepared.sparkSession)
        fitted = learn_encoding(prepared, cat, num)
        weighted = M.class_weights(filled(prepared, fitted), label, "w")
        fitted = fitted._replace(categories=IO.kept(fitted.categories, "categories"))
        model = G.fit(weighted, *fitted.used, fitted.categories, label, "w", G.Params(**{**P.BOOST_PARAMS, **(params or {})}))
        fitted = fitted._replace(rows=G.tree_rows(model, fitted.categories))
    finally:
        prepared.unpersist()
    return fitted, cat, num


def _probability(model: Fitted, columns: dict[str, Column] | None = None) -> Column:
    cat, num = model.used
    ship_package(model.categories.sparkSession)
    columns = columns or {c: F.col(c) for c in cat + num}
    return G.probability(G.Scorer(model.rows, cat, num), [columns[c] for c in cat], [columns[c] for c in num])


def probabilities(model, df: DataFrame, cat: list[str], num: list[str],
                  keep: list[str] | None = None) -> DataFrame:
    """M6: probability of class 1 for every row (``_proba``). Of several models
    (a tuple of them) the others' stand beside it, as ``_proba1`` and so on."""
    models = (model,) if isinstance(model, Fitted) else model
    prepared = prepare(df, cat, num, keep=keep)
    out = []
    for i, m in enumerate(models):
        safe = set(m.used[0] + m.used[1])
        full = {c: F.coalesce(F.col(c), F.lit(m.modes.get(c) if c in m.used[0] else m.numeric[c][0])) for c in safe}
        out.append(_probability(m, full).alias("_proba" + str(i or "")))
    return prepared.select(*[R.c(k) for k in (keep or [])], *out)


def score_with_model(df: DataFrame, bundle, prof: Profile = DEFAULT) -> DataFrame:
    """M6 + C5/C6 on a snapshot: all original columns plus the score, labels
    and subject mean. ``bundle`` is ``(model, cat, num)``."""
    model, cat, num = bundle
    base = N.coerce_numeric(df, prof.numeric)
    original = base.columns
    # the features stand beside the columns: no join back to the input
    out = filled(base.select("*", *feature_columns(base, cat, num)), model)
    scored = out.select(*[R.c(c) for c in original], _probability(model).alias("_proba"))
    return score_probability(scored, "_proba", prof).drop("_proba")


def model_features_present(df: DataFrame, bundle) -> bool:
    """M7 validation: the bundle's features can be made from this frame
    (missing ones are allowed: they are aligned as nulls). A bundle that cannot
    be unpacked, or whose trees ask for a feature it does not have, is unusable."""
    try:
        model, cat, num = bundle
        if not isinstance(model, Fitted) or not (cat or num) or not model.rows:
            return False
        G.Scorer(model.rows, *model.used)
        return bool(filled(prepare(df, cat, num), model).columns)
    except (TypeError, ValueError, AttributeError, KeyError, PySparkException):
        return False


def evaluate(model: Fitted, df_test: DataFrame, cat: list[str], num: list[str], label: str = "y") -> DataFrame:
    """A14–A17 on the labelled rows of the test set."""
    pr = probabilities(model, df_test.where(R.c(label).isNotNull()), cat, num, keep=[label]).select(F.col(label).alias("y"), F.col("_proba").alias("score"))
    return M.evaluation(pr)


def save_artifacts(spark: SparkSession, model: Fitted, cat: list[str], num: list[str], metrics: dict,
                   out_dir: str) -> str:
    """S6 + S7: the learnt tables and the run table as a new version of the
    bundle under ``out_dir``; returns the version's folder."""
    meta = IO.default_metadata(cat + num, metrics)
    meta["trained_at"] = datetime.now(timezone.utc).isoformat(timespec="seconds").replace("+00:00", "Z")
    meta["notes"] = ["categorical=" + ",".join(cat), "numeric=" + ",".join(num)]
    modes = spark.createDataFrame(sorted(model.modes.items()), "feature string, mode string")
    numeric = spark.createDataFrame([(c, *s) for c, s in sorted(model.numeric.items())], "feature string, median double, mean double, deviation double")
    trees = spark.createDataFrame(model.rows, G.TREE_SCHEMA)
    return B.publish(spark, out_dir, {"categories": model.categories, "modes": modes, "numeric": numeric, "trees": trees,
                                      "metadata": IO.metadata_frame(spark, meta)})


def load_bundle(spark: SparkSession, out_dir: str):
    """S7 read: ((model, cat, num), run table) of the newest whole version, or
    (None, {}) where there is none (then the rule scorer is used). Errors of the
    storage other than missing or malformed files are raised."""
    path = B.newest(spark, out_dir)
    if path is None:
        return None, {}
    meta = IO.first_dict(B.table(spark, path, "metadata"))
    feats = meta.get("feature_columns") or []
    cat = [c for c in feats if c in P.CATEGORICAL_FEATURES]
    num = [c for c in feats if c not in P.CATEGORICAL_FEATURES]
    modes = {r["feature"]: r["mode"] for r in B.table(spark, path, "modes").collect()}  # one row a feature
    numeric = {r["feature"]: (r["median"], r["mean"], r["deviation"]) for r in B.table(spark, path, "numeric").collect()}
    rows = sorted((tuple(r) for r in B.table(spark, path, "trees").collect()), key=lambda r: r[:2])  # at most 2^(depth+1) a round
    return (Fitted(cat, num, B.table(spark, path, "categories"), modes, numeric, rows), cat, num), meta


def run_table(spark: SparkSession, out_dir: str) -> DataFrame:
    """S6 read: the run table of the newest whole version; empty where there is none."""
    path = B.newest(spark, out_dir)
    return B.table(spark, path, "metadata") if path else IO.metadata_frame(spark, None)


def model_info(spark: SparkSession, out_dir: str) -> DataFrame:
    """M9: one row per feature with the stored model name and version."""
    return run_table(spark, out_dir).select("model_name", "model_version", F.posexplode("feature_columns").alias("position", "feature"))


def train_job(spark: SparkSession, stacked: DataFrame, test_year: int, out_dir: str, label: str = "y",
              params: dict | None = None) -> tuple[DataFrame, Fitted]:
    """M8: temporal split (P10), or a stratified split (M5) when the test
    year is empty; fit; evaluate; publish. Rows without a label take no part.
    Returns the metrics row and the model."""
    # read by the split, the fit, the evaluation and the sizes: made once
    stacked = IO.kept(stacked.where(R.c(label).isNotNull()), "labelled")
    train_df = stacked.filter(F.col("ano") < test_year)
    test_df = stacked.filter(F.col("ano") == test_year)
    if test_df.isEmpty():
        split = stratified_split(stacked, label)
        train_df = split.filter(~F.col("is_test")).drop("is_test")
        test_df = split.filter(F.col("is_test")).drop("is_test")
    model, cat, num = train(train_df.drop("ano", P.DEFAULT.key), label, params)
    ev = evaluate(model, test_df, cat, num, label)
    sizes = M.dataset_sizes(train_df, test_df)
    row = ev.first().asDict()
    row.update(sizes.first().asDict())
    save_artifacts(spark, model, cat, num, row, out_dir)
    return spark.createDataFrame([row]), model


def root_candidates(prepared: DataFrame, fitted: Fitted, label: str = "y", bins: int = 255, l2: float = 0.1) -> DataFrame:
    """M4: every split that the root of the first tree chooses from: feature,
    category or cut, rows, gradient and hessian of the left side, and the gain."""
    weighted = M.class_weights(filled(prepared.where(F.col(label).isNotNull()), fitted), label, "w")
    return G.root_candidates(weighted, *fitted.used, fitted.categories, label, "w", G.Params(bins=bins, l2=l2))
