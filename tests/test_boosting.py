"""Histogram boosting against trees grown from raw values by plain numpy."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from cohort_spark.operators import boosting as G


def rows(seed, n=400):
    r = np.random.default_rng(seed)
    color = r.choice(["red", "green", "blue", "rare", None], n, p=[0.4, 0.3, 0.2, 0.05, 0.05])
    a, b = r.normal(size=n).round(2), r.integers(0, 5, n).astype(float)
    p = 1 / (1 + np.exp(-(2 * a + (color == "blue") * 2 - b * 0.5)))
    y = (r.random(n) < p).astype(int)
    a[r.random(n) < 0.15] = np.nan
    w = np.where(y == 1, 1.5, 0.75)
    return [(None if c is None else str(c), None if np.isnan(x) else float(x), float(z), int(t), float(u)) for c, x, z, t, u in zip(color, a, b, y, w)]


SCHEMA = "color string, a double, b double, y int, w double"


def brute(data, p):
    """(base, trees): each tree a dict node -> (feature, category or cut, missing left) or a leaf value, and the margins."""
    color = np.array([r[0] for r in data], object)
    num = {"a": np.array([np.nan if r[1] is None else r[1] for r in data]), "b": np.array([r[2] for r in data])}
    y, w = np.array([r[3] for r in data]), np.array([r[4] for r in data])
    share = (w * y).sum() / w.sum()
    base = round(float(np.log(share / (1 - share))), 9)
    margin, trees = np.full(len(data), base), []
    scale = 2.0 ** (24 - np.ceil(np.log2(max(1, w.max()))))
    for _ in range(p.rounds):
        q = 1 / (1 + np.exp(-margin))
        g, h = np.rint(w * (q - y) * scale) / scale, np.rint(w * q * (1 - q) * scale) / scale
        tree, members = {}, {1: np.arange(len(data))}
        for level in range(p.depth + 1):
            for k in range(1 << level, 2 << level):
                if k not in members:
                    continue
                i = members[k]
                best = (1e-12, None, None)
                tried = [("color", c, False, color[i] == c) for c in sorted({c for c in color if c is not None})]
                for f in ("a", "b"):
                    v, every = num[f][i], np.unique(num[f][~np.isnan(num[f])])
                    missing = np.isnan(v)
                    for side in (False, True) if missing.any() else (False,):
                        tried += [(f, c, side, (v <= c) | (missing & side)) for c in every[:-1]]
                    if missing.any():
                        tried.append((f, np.inf, False, ~missing))
                if level < p.depth:
                    for f, c, side, left in tried:
                        l, r = i[left], i[~left]
                        if min(len(l), len(r)) < p.least_rows or min(h[l].sum(), h[r].sum()) < 1e-3:
                            continue
                        gain = g[l].sum() ** 2 / (h[l].sum() + p.l2) + g[r].sum() ** 2 / (h[r].sum() + p.l2) - g[i].sum() ** 2 / (h[i].sum() + p.l2)
                        if gain > best[0] + 1e-9:
                            best = (gain, (f, c, side), left)
                if best[1] is None:
                    value = -p.rate * g[i].sum() / (h[i].sum() + p.l2)
                    tree[k] = (None, value, len(i))
                    margin[i] += value
                else:
                    tree[k] = best[1]
                    members[2 * k], members[2 * k + 1] = i[best[2]], i[~best[2]]
        trees.append(tree)
    return base, trees, 1 / (1 + np.exp(-margin))


@pytest.fixture(scope="module")
def fitted(spark):
    data = rows(1)
    p = G.Params(rounds=8, depth=3, least_rows=12, rate=0.3)
    df = spark.createDataFrame(data, SCHEMA).repartition(5)
    categories = G.category_table(df, ["color"])
    return data, p, df, categories, G.fit(df, ["color"], ["a", "b"], categories, params=p)


def test_trees_equal_brute_force(fitted):
    data, p, _, categories, model = fitted
    base, trees, _ = brute(data, p)
    assert model.base == base
    got = [{} for _ in trees]
    for t, k, feature, category, cut, missing, value, n, *_ in G.tree_rows(model, categories):
        if t >= 0:
            got[t][k] = (feature, category or cut, missing) if feature else (None, value, n)
    for mine, theirs in zip(got, trees):
        assert mine.keys() == theirs.keys()
        for k, x in theirs.items():
            if x[0] is None:
                assert mine[k][2] == x[2] and mine[k][1] == pytest.approx(x[1], abs=1e-9)
            else:
                assert mine[k][:2] == x[:2]
    assert any(x[0] == "a" and x[2] for t in got for x in t.values()) and any(x[0] == "color" for t in got for x in t.values())


def test_scores_equal_brute_force(spark, fitted):
    data, p, df, categories, model = fitted
    scorer = G.Scorer(G.tree_rows(model, categories), ["color"], ["a", "b"])
    got = spark.createDataFrame([(i, *r) for i, r in enumerate(data)], "i int, " + SCHEMA).repartition(3)
    got = got.select("i", G.probability(scorer, [F.col("color")], [F.col("a"), F.col("b")]).alias("p")).orderBy("i").collect()
    assert np.allclose([r["p"] for r in got], brute(data, p)[2], atol=1e-9)


def test_partitions_do_not_show(spark, fitted, monkeypatch):
    """The same model from other partitions, smaller blocks, and with lineage cut on the way."""
    _, p, df, categories, model = fitted
    monkeypatch.setattr(G, "CUT_EVERY", 2)
    monkeypatch.setattr(G, "KEEP_EVERY", 2)
    for parts in (1, 40):  # 40: sums travel over a tree of tasks
        again = G.fit(df.repartition(parts), ["color"], ["a", "b"], categories, params=p)
        assert again.trees == model.trees and again.base == model.base


def test_cuts_are_exact_quantiles(spark):
    r = np.random.default_rng(0)
    v = np.r_[r.normal(size=900), np.full(100, 0.5)]
    df = spark.createDataFrame([(float(x), float(i % 3)) for i, x in enumerate(v)], "v double, few double")
    got = {}
    for x in G.numeric_cuts(df, ["v", "few"], bins=16).collect():
        got.setdefault(x["feature"], []).append((x["cut"], x["n_left"]))
    assert sorted(got["few"]) == [(0.0, 334), (1.0, 667)]
    s = np.sort(v)
    want = sorted({s[-(-k * 1000 // 16) - 1] for k in range(1, 16)})
    assert [c for c, _ in sorted(got["v"])] == want and all(n == (v <= c).sum() for c, n in got["v"])


def test_category_numbers(spark):
    df = spark.createDataFrame([("b", "x"), ("a", None), ("b", "x"), ("c", "")], "s string, t string")
    got = sorted(map(tuple, G.category_table(df, ["s", "t"]).collect()))
    assert got == [("s", "a", 0), ("s", "b", 1), ("s", "c", 2), ("t", "", 0), ("t", "x", 1)]


def test_degenerate_inputs(spark):
    one = spark.createDataFrame([("a", 1.0, 1, 1.0)] * 30, "s string, v double, y int, w double")
    model = G.fit(one, ["s"], ["v"], G.category_table(one, ["s"]), params=G.Params(rounds=3))
    assert all(t[1].feature == G.LEAF for t in model.trees)
    with pytest.raises(ValueError):
        G.fit(one.limit(0), ["s"], ["v"], G.category_table(one, ["s"]))


def test_bins_take_as_few_bytes_as_hold_them(spark, fitted):
    """A step reads all bins: one byte each where a feature has up to 255 of them, more for larger dictionaries."""
    _, p, df, categories, _ = fitted
    lay = G.layout(df, categories, ["color"], ["a", "b"], p.bins)
    assert {b[0].dtype.itemsize for b in G.binned(df, lay, categories, "y", "w").collect()} == {1}
    many = df.select(F.concat(F.lit("c"), F.monotonically_increasing_id().cast("string")).alias("color"), "a", "b", "y", "w").localCheckpoint()
    names = G.category_table(many, ["color"])
    wide = G.layout(many, names, ["color"], ["a", "b"], p.bins)
    blocks = G.binned(many, wide, names, "y", "w").collect()
    assert {b[0].dtype.itemsize for b in blocks} == {2} and sorted(x for b in blocks for x in b[0][0]) == list(range(400))


def test_jobs_do_not_grow_with_the_rounds(spark, fitted):
    """All rounds are one stage; a job for each level of each tree was most of the time."""
    _, p, df, categories, _ = fitted
    jobs = []
    for rounds in (2, 8):
        spark.sparkContext.setJobGroup(f"fit-{rounds}", "fit")
        model = G.fit(df, ["color"], ["a", "b"], categories, params=p._replace(rounds=rounds))
        assert len(model.trees) == rounds
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"fit-{rounds}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[1] - jobs[0] < 6  # not even one for each of the six rounds more


def test_one_stage_equals_a_job_for_each_level(spark, fitted, monkeypatch):
    """With several tasks, whose sums are added along a tree of them, and where blocks are too large for it."""
    _, p, df, categories, model = fitted
    monkeypatch.setattr(G, "BLOCK", 40)
    monkeypatch.setattr(G, "FAN_IN", 2)
    assert G.fit(df, ["color"], ["a", "b"], categories, params=p).trees == model.trees
    monkeypatch.setattr(G, "TASK_BYTES", 0)
    monkeypatch.setattr(G, "CUT_EVERY", 2)
    monkeypatch.setattr(G, "KEEP_EVERY", 2)
    by_jobs = []
    monkeypatch.setattr(G, "_fit_by_jobs", lambda *a, f=G._fit_by_jobs: by_jobs.append(f(*a)) or by_jobs[0])
    assert G.fit(df.repartition(40), ["color"], ["a", "b"], categories, params=p).trees == model.trees and by_jobs


def test_without_a_folder_that_tasks_can_open(spark, fitted, monkeypatch):
    _, p, df, categories, model = fitted
    monkeypatch.setattr(G, "scratch_path", lambda spark, name: "/proc/nowhere")
    assert G.fit(df, ["color"], ["a", "b"], categories, params=p).trees == model.trees


def test_exchange_gives_up_on_a_folder_that_is_not_shared(tmp_path):
    mine = G.Exchange(str(tmp_path / "a"), 0)
    mine.tell("0", {"x": [1]})
    assert G.Exchange(str(tmp_path / "a"), 1).hear("0") == {"x": [1]}
    mine.wait = 0.05
    with pytest.raises(TimeoutError):
        mine.hear("1")
