"""Ranked search and hard negatives: against brute force, and their SQL."""
import math
import os
import random
import re
from collections import Counter

import numpy as np
import pytest
from conftest_llm import ODD, docs_of  # noqa: F401  (docs_of is a fixture)
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cohort_spark.llm import impact_rank as R
from cohort_spark.llm import multi_index as M

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_rank(docs, items, k=20):
    each = [(d, Counter(terms_of(t)), len(terms_of(t))) for d, t in docs]
    total, length = sum(n > 0 for *_, n in each), sum(n for *_, n in each)
    df = Counter(t for _, c, _ in each for t in c)
    out = []
    for item, text in items:
        scores = []
        for d, c, n in each:
            if n:
                m = 75 + 25 * n * total // length
                s = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in terms_of(text) if c[t])
                if s > 0:
                    scores.append((-s, d is None, d, s))
        scores.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(item, r + 1, d, s) for r, (_, _, d, s) in enumerate(scores[:k])]
    return sorted(out, key=repr)


def ranked(spark, docs, items, k=20, **more):
    d = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("n", F.lit("clash")).withColumn("rank", F.lit(1)).withColumn("item", F.lit(1))
    i = spark.createDataFrame(items, "item_id bigint, text string").withColumn("copies", F.lit("clash")).withColumn("score", F.lit(0))
    return sorted((tuple(x) for x in R.rank(d, i, k, **more).select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def corpus(seed, n=300):
    r = random.Random(seed)
    words = ["the", "of", "Straße", "naïve", "x1", "2024", "漢字", "extraordinarily_long", "extraordinarilylongword1", "extraordinarilylongword2"] + [f"w{i}" for i in range(60)]
    weights = [60, 40] + [3] * (len(words) - 2)
    docs = [(i, r.choice([" ", ", ", "\n"]).join(r.choices(words, weights, k=r.choice([0, 1, 5, 40, 200])))) for i in range(n)]
    docs += [(n + i, docs[i][1]) for i in range(0, n, 7)]  # equal texts have equal scores
    items = [(i, " ".join(r.choices(words, weights, k=r.choice([1, 2, 12, 40])))) for i in range(12)]
    return docs, items + [(50, None), (51, "   "), (52, "no such term"), (53, "the The THE the")]


@pytest.mark.parametrize("depth,docs_a_shard", [(R.DEPTH, R.DOCS), (2, 40)])
def test_ranks_equal_brute_force(spark, monkeypatch, depth, docs_a_shard):
    monkeypatch.setattr(R, "DEPTH", depth)
    monkeypatch.setattr(R, "DOCS", docs_a_shard)
    docs, items = corpus(3)
    assert ranked(spark, docs, items) == brute_rank(docs, items)


def test_ranks_of_odd_repeated_and_empty_rows(spark, monkeypatch):
    docs = ODD + [(20, "The end. THE END"), (20, "the end the end"), (None, "words too")]
    items = [(1, "the end"), (1, "the end"), (2, "long"), (None, "a null id"), (3, "漢字 ß")]
    want = brute_rank(docs, items)
    assert ranked(spark, docs, items) == want and len(want) > 8
    monkeypatch.setattr(R, "ITEMS", 2)  # several blocks of items
    assert ranked(spark, docs, items) == want
    assert ranked(spark, docs, items, k=1) == brute_rank(docs, items, 1)
    assert ranked(spark, [], items) == [] and ranked(spark, docs, []) == []




def test_reads_stop_before_the_lists_end():
    """An item whose best documents stand out does not read its lists to the end."""
    n = 20_000
    count = np.full(n, 1, np.int64)
    count[:30] = np.arange(40, 10, -1)
    number, doc, tf = np.zeros(n, np.int64), np.arange(n), count
    shard = R.Shard(np.full(n, 100, np.int64), np.arange(n + 1), number, tf, np.array([5000]), n, 100 * n)
    seen = []
    whole = np.add.at
    try:
        np.add.at = lambda a, i, v: (seen.append(len(i)), whole(a, i, v))
        at, score = shard.search(np.array([0]), np.array([1]), np.zeros(0, np.int64), 20)
    finally:
        np.add.at = whole
    assert set(range(20)) <= set(doc[at].tolist()) and sum(seen) < n / 10 and len(at) < 40


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 6), st.integers(1, 9))
def test_one_shard_equals_sorting(seed, lists, k):
    """Ties everywhere: few distinct impacts, documents in some lists only."""
    r = np.random.default_rng(seed)
    n = 60
    present = r.random((n, lists)) < 0.5
    tf = r.integers(1, 4, (n, lists))
    doc, number = np.nonzero(present)
    off = np.r_[0, np.cumsum(present.sum(1))]
    weight, repeats = r.integers(0, 3, lists) * 7, r.integers(1, 3, lists)
    length = np.full(n, 9)
    shard = R.Shard(length, off, number, tf[present], weight, n, int(length.sum()))
    m = 75 + 25 * length * n // int(length.sum())
    score = (present * weight * repeats * (10**9 * tf // (1000 * tf + 12 * m[:, None]))).sum(1)
    at, got = shard.search(np.arange(lists), repeats, np.zeros(0, np.int64), k)
    assert (score[at] == got).all()
    best = np.lexsort((np.arange(n), -score))[:k]
    assert set(best[score[best] > 0].tolist()) <= set(at.tolist())


# --- hard negatives ------------------------------------------------------------

def brute_negatives(rows, positives=5, negatives=3):
    good = {}
    for i, v, label in rows:
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            w = [math.floor(256 * x) for x in v]
            good[i] = min(good.get(i, (label, w)), (label, w))
    inner = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for a, (la, va) in good.items():
        if a % 5 == 0:
            other = [(-inner(va, v), i, lb) for i, (lb, v) in good.items() if i != a]
            for s, p, _ in sorted(x for x in other if x[2] == la)[:positives]:
                ps = -s
                fit = sorted((t, i) for t, i, lb in other if lb != la and 50 * ps <= -100 * t <= 95 * ps)[:negatives]
                out += [(a, p, r + 1, i, ps, -t) for r, (t, i) in enumerate(fit)]
    return sorted(out)


def vectors(seed, n=400, dim=9):
    r = np.random.default_rng(seed)
    centre = r.normal(size=(6, dim))
    rows = []
    for i in range(n):
        v = centre[r.integers(6)] * r.choice([0.2, 1.0, 3.0]) + r.normal(size=dim) * r.choice([0.0, 0.1, 1.0])
        rows.append((i, [float(np.float32(x)) for x in v], int(r.integers(3))))
    rows += [(n + i, rows[3][1], int(r.integers(3))) for i in range(150)]  # a hot group of equal vectors
    rows += [(None, rows[0][1], 1), (2000, None, 1), (2005, rows[0][1], None), (2010, [1.0, None], 1), (2015, [float("nan")] * dim, 1),
             (2020, [float("inf")] * dim, 1), (2025, [], 1), (2030, [2.0, 1.0], 2), (2035, [0.0] * dim, 0), (5, rows[9][1], 0), (5, rows[9][1], 0)]
    return rows


@pytest.mark.parametrize("sizes", [{}, {"BLOCK": 40, "CELL": 8, "PART": 20, "PROBE": 30, "BATCH": 7}])
def test_negatives_equal_brute_force(spark, monkeypatch, sizes):
    for k, v in sizes.items():
        monkeypatch.setattr(M, k, v)
    rows = vectors(4)
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").withColumn("block", F.lit("clash")).withColumn("a", F.lit(2))
    got = M.hard_negatives(df, F.col("vec_id") % 5 == 0)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = brute_negatives(rows)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 300
    assert M.hard_negatives(df.limit(0), F.lit(True)).count() == 0
    assert M.hard_negatives(df.where("vec_id = 5"), F.lit(True)).count() == 0


def test_sums_beyond_53_bits_are_exact(spark):
    r = np.random.default_rng(2)
    rows = [(i, [float(x) for x in r.integers(-2**20, 2**20, 40)], int(r.integers(2))) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    assert sorted(map(tuple, M.hard_negatives(df, F.col("vec_id") % 5 == 0).collect())) == brute_negatives(rows)


def test_the_heap_pops_all_pairs_in_order():
    r = np.random.default_rng(0)
    b1, b2 = r.normal(size=7).round(1), r.normal(size=5).round(1)
    pops = list(M.in_order(b1, b2))
    assert sorted((i, j) for i, j, _ in pops) == [(i, j) for i in range(7) for j in range(5)]
    assert all(x[2] >= y[2] for x, y in zip(pops, pops[1:])) and all(abs(b1[i] + b2[j] - s) < 1e-12 for i, j, s in pops)


def test_blocks_far_below_are_not_visited(spark, monkeypatch):
    """Well separated groups: after the probe nearly no block's bound reaches the windows."""
    monkeypatch.setattr(M, "BLOCK", 50)
    monkeypatch.setattr(M, "PROBE", 100)
    monkeypatch.setattr(M, "CELL", 8)
    r = np.random.default_rng(1)
    centre = np.eye(12)[:, :12] * 8
    rows = [(i, [float(x) for x in centre[i % 12] + r.normal(size=12) * 0.02], (i // 12) % 2) for i in range(1200)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    sent = []
    routes = M._routes
    monkeypatch.setattr(M, "_routes", lambda *a, **k: (sent.append((routes(*a, **k).count(), k["rest"])), routes(*a, **k))[1])
    got = M.hard_negatives(df, F.col("vec_id") % 5 == 0)
    assert sorted(map(tuple, got.collect())) == brute_negatives(rows)
    assert all(n < 240 * 24 / 4 for n, rest in sent if rest), sent


@pytest.mark.parametrize("name", ["op12_ranked_search", "op13_hard_negatives"])
def test_queries_equal_their_sql(spark, name):
    import pandas as pd
    from conftest import MEDIUM
    from oracle_check import duck, rows_of

    from cohort_spark.llm.queries import QUERIES, SQL
    assert os.path.isdir(MEDIUM)
    got = QUERIES[name](spark, MEDIUM)
    mine, theirs = rows_of(pd.DataFrame(got.collect(), columns=got.columns), 12), rows_of(duck(MEDIUM).execute(SQL[name]).df(), 12)
    assert mine == theirs and len(mine[1]) > 50
