"""Classification metrics and sample weights.

Rank metrics are computed from distinct thresholds: ``groupBy(score)`` first
(pre-aggregated, one row per distinct score), then running totals over range
partitions (:mod:`.ranks`) — never a global window on one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import profile as P
from .ranks import running_totals, scalars


def class_weights(df: DataFrame, label: str = "y", name: str = "w") -> DataFrame:
    """Balanced weights n/(2·pos) and n/(2·neg); all 1 if a class is empty.
    The counts come from one aggregate, read as one scalar subquery."""
    sc = scalars(df.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(label) == 1).alias("pos")))
    n, pos = sc["n"], sc["pos"]
    neg = n - pos
    w = (F.when((pos == 0) | (neg == 0), F.lit(1.0))
         .when(F.col(label) == 1, n.cast("double") / (F.lit(2.0) * pos.cast("double")))
         .otherwise(n.cast("double") / (F.lit(2.0) * neg.cast("double"))))
    return df.withColumn(name, w)


def dataset_sizes(train: DataFrame, test: DataFrame) -> DataFrame:
    """One row with n_train and n_test."""
    return train.select(F.count(F.lit(1)).alias("n_train")).withColumn(
        "n_test", test.select(F.count(F.lit(1))).scalar())


def _div0(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def threshold_metrics(scored: DataFrame, label: str = "y", score: str = "score",
                      threshold: float = P.PROBA_THRESHOLD) -> DataFrame:
    """Precision, recall and F1 of ``score >= threshold`` (0 on x/0),
    plus the confusion counts."""
    pred = F.col(score) >= threshold
    y = F.col(label) == 1
    c = scored.agg(F.count_if(pred & y).alias("tp"), F.count_if(pred & ~y).alias("fp"),
                   F.count_if(~pred & y).alias("fn"), F.count_if(~pred & ~y).alias("tn"))
    return c.select(
        "tp", "fp", "fn", "tn",
        _div0(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        _div0(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"),
        _div0(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"),
    )


def threshold_table(scored: DataFrame, label: str = "y", score: str = "score") -> DataFrame:
    """Distinct thresholds (descending) with positives / negatives at each and
    the totals strictly above each."""
    per = scored.groupBy(F.col(score).alias("s")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg"))
    return running_totals(per, [], "s", ["pos", "neg"], descending=True)


def rank_metrics(scored: DataFrame, label: str = "y", score: str = "score") -> DataFrame:
    """A15 + A16 + A17: ROC AUC (ties count one half) and average precision
    Σ (Rₙ − Rₙ₋₁)·Pₙ over distinct thresholds; both null unless the set has
    both classes."""
    t = threshold_table(scored, label, score)
    tp = F.col("cum_pos_before") + F.col("pos")
    allp = F.col("cum_pos_before") + F.col("cum_neg_before") + F.col("pos") + F.col("neg")
    sums = t.agg(
        F.sum("pos").alias("P"), F.sum("neg").alias("N"),
        F.sum(F.col("neg").cast("double") * (F.col("cum_pos_before").cast("double") + F.col("pos") / 2.0)).alias("u"),
        F.sum(F.col("pos").cast("double") * (tp.cast("double") / allp.cast("double"))).alias("ap_num"),
    )
    ok = (F.col("P") > 0) & (F.col("N") > 0)
    return sums.select(
        F.when(ok, F.bround(F.col("u") / (F.col("P").cast("double") * F.col("N").cast("double")), 12)).alias("roc_auc"),
        F.when(ok, F.bround(F.col("ap_num") / F.col("P").cast("double"), 12)).alias("pr_auc"),
        F.col("P").alias("n_pos"), F.col("N").alias("n_neg"),
    )


def evaluation(scored: DataFrame, label: str = "y", score: str = "score") -> DataFrame:
    """A14–A17 in one row: metrics null unless both classes are present."""
    r = rank_metrics(scored, label, score)
    m = scalars(threshold_metrics(scored, label, score))
    ok = (F.col("n_pos") > 0) & (F.col("n_neg") > 0)
    # the threshold metrics are one scalar subquery (no join)
    return r.select(
        "n_pos", "n_neg", "roc_auc", "pr_auc",
        *[F.when(ok, m[x]).alias(x) for x in ("f1", "precision", "recall")],
    )
