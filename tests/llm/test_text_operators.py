"""Near-duplicates, line dedup, passages, contamination: against brute force."""
import hashlib
import random

import pytest
from conftest_llm import ODD, docs_of, words_of  # noqa: F401  (docs_of is a fixture)
from hypothesis import given, settings
from hypothesis import strategies as st

from cohort_spark.llm import decontaminate as D
from cohort_spark.llm import minhash as M
from cohort_spark.llm import substring_dedup as S
from cohort_spark.llm.line_dedup import dedup_lines


def corpus(seed, n=60, words=40):
    """Texts with exact copies, near copies and shared passages."""
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    passage = r.choices(vocabulary, k=45)
    out = []
    for i in range(n):
        kind = r.random()
        if out and kind < 0.2:
            w = list(out[r.randrange(len(out))])
        elif out and kind < 0.5:
            w = list(out[r.randrange(len(out))])
            for _ in range(r.randint(1, 6)):
                if w:
                    w[r.randrange(len(w))] = r.choice(vocabulary)
        else:
            w = r.choices(vocabulary, k=r.randint(0, words))
            if kind > 0.8:
                at = r.randint(0, len(w))
                w[at:at] = passage
        out.append(w)
    return [(i, "\n".join(" ".join(w[k: k + 17]) for k in range(0, len(w), 17))) for i, w in enumerate(out)]


def shingle_set(text, k):
    w = words_of(text, lower=True)
    return {tuple(w[i: i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute_components(rows, k):
    sets = [shingle_set(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, len(sets[i]), least.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)), key=repr)


@pytest.mark.parametrize("seed,k", [(1, 2), (2, 5)])
def test_near_duplicates_equal_brute_force(spark, docs_of, seed, k):
    rows = corpus(seed) + [(100 + i if i is not None else None, t) for i, t in ODD]
    got = M.near_duplicates(docs_of(rows), shingle=k).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == brute_components(rows, k)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicates_of_one_large_family(spark, docs_of):
    """A family whose leaders do not settle it: variants of one text, some near, some far."""
    r = random.Random(5)
    base = [f"b{i}" for i in range(100)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(r.randint(0, 14)):
            w[r.randrange(100)] = f"n{i}_{r.randrange(1000)}"
        rows.append((i, " ".join(w)))
    got = M.near_duplicates(docs_of(rows)).collect()
    assert sorted(((x.doc_id, x.n_shingles, x.component_id) for x in got), key=repr) == brute_components(rows, 2)


def test_near_duplicates_under_shared_and_null_ids(spark, docs_of):
    """Several texts under one id or without one: each text is compared by its own set, and one of each family is kept."""
    import corpus_pipeline

    def family(c, n):
        w = [f"{c}{i}" for i in range(n)]
        return " ".join(w), " ".join([*w[:-1], "other"])
    (a, a2), (b, b2), (c, c2), (d, d2), (e, e2) = (family(x, n) for x, n in (("a", 40), ("b", 80), ("c", 40), ("d", 90), ("e", 50)))
    rows = [(1, a), (1, b), (2, a2), (3, b2), (None, c), (None, d), (None, c2), (None, d2), (5, e), (5, e2)]
    got = M.near_duplicates(docs_of(rows)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == brute_components(rows, 2)
    assert sorted((r.doc_id for r in got if r.stays), key=repr) == sorted([1, 1, None, None, 5], key=repr)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    left = sorted(r.text[0] for r in corpus_pipeline.near_dedup(spark, docs_of(rows), "").collect())
    assert left == ["a", "b", "c", "d", "e"]


def test_circulant_signatures_estimate_similarity():
    import numpy as np

    from cohort_spark.llm import arrays as A
    x = A.splitmix(2000, 1)
    a, b = x[:1500], x[500:]
    sig = M.signatures(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), 512)
    assert abs((sig[0] == sig[1]).mean() - 0.5) < 0.08


def brute_passages(rows, length):
    seen = {}
    words = [words_of(t) for _, t in rows]
    for w in words:
        for i in range(len(w) - length + 1):
            seen[tuple(w[i: i + length])] = seen.get(tuple(w[i: i + length]), 0) + 1
    out = []
    for (d, _), w in zip(rows, words):
        gone = set()
        for i in range(len(w) - length + 1):
            if seen[tuple(w[i: i + length])] > 1:
                gone.update(range(i, i + length))
        out.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed,length,seed_words", [(3, 35, 6), (4, 8, 3), (5, 1, 1)])
def test_passages_equal_brute_force(spark, docs_of, seed, length, seed_words):
    rows = corpus(seed) + ODD[:6] + [(50, "a b " * 400), (51, "z " * 300)]
    got = S.remove_repeats(docs_of(rows), length, seed_words).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got), key=repr) == brute_passages(rows, length)
    for r in got:
        assert sum(x.end - x.begin for x in r.removed) == r.n_removed and all(x.end - x.begin >= length for x in r.removed)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60), st.integers(1, 9))
def test_winnowed_owner_is_the_leftmost_least(values, width):
    import numpy as np
    v = np.array(values, np.uint64) << np.uint64(40)
    if len(v) >= width:
        want = [min(range(i, i + width), key=lambda p: (values[p], p)) for i in range(len(v) - width + 1)]
        assert S._owners(v, width).tolist() == want


def brute_lines(rows, k):
    lines = [(d, i, x) for d, t in rows if t is not None for i, x in enumerate(t.split("\n"))]
    order = sorted(range(len(lines)), key=lambda p: (lines[p][0] is not None, lines[p][0] or 0, lines[p][1]))
    kept, seen = {}, []
    for p in order:
        s = shingle_set(lines[p][2], k)
        key = lines[p][:2]
        if s and any(100 * len(s & o) >= 80 * len(s | o) for o, q in seen if q != key):
            kept[key] = False
        else:
            kept[key] = True
        if s:
            seen.append((s, key))
    out = []
    for d, t in rows:
        stay = [x for i, x in enumerate(t.split("\n")) if kept[d, i]] if t is not None else []
        n = sum(bool(words_of(x)) for x in t.split("\n")) if t is not None else 0
        out.append((d, "\n".join(stay) if t is not None else None, n, n - sum(bool(words_of(x)) for x in stay)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("k", [5, 1])
def test_line_dedup_equals_brute_force(spark, docs_of, k):
    rows = corpus(6, n=50, words=90) + [(100 + i if i is not None else None, t) for i, t in ODD]
    out = dedup_lines(docs_of(rows), k)
    assert sorted(((r.doc_id, r.text, r.n_lines, r.n_removed) for r in out.collect()), key=repr) == brute_lines(rows, k)
    assert out.select("row.row", "row.unit").distinct().collect()[0] == ("r", "u")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_line_dedup_of_lines_one_word_longer(spark, docs_of):
    """Lines of 8 and of 9 words (4 and 5 tokens), the longer one later and earlier, the word before and after."""
    def line(c, n):
        return " ".join(f"{c}{i}" for i in range(n))
    rows = [(1, line("a", 8)), (2, line("a", 9)), (3, line("b", 9)), (4, line("b", 8)), (5, line("c", 8)), (6, "new " + line("c", 8)),
            (7, "new " + line("d", 8)), (8, line("d", 8)), (9, line("e", 7)), (10, line("e", 8))]
    got = {r.doc_id: r.n_removed for r in dedup_lines(docs_of(rows)).collect()}
    assert got == {1: 0, 2: 1, 3: 0, 4: 1, 5: 0, 6: 1, 7: 0, 8: 1, 9: 0, 10: 0}
    assert sorted((d, n) for d, _, _, n in brute_lines(rows, 5)) == sorted(got.items())
    # at 60 per cent 2 tokens match 3, and 1 does not match 2
    rows = [(1, line("a", 7)), (2, line("a", 6)), (3, line("b", 6)), (4, line("b", 7)), (5, line("c", 5)), (6, line("c", 6))]
    assert {r.doc_id: r.n_removed for r in dedup_lines(docs_of(rows), threshold=60).collect()} == {1: 0, 2: 1, 3: 0, 4: 1, 5: 0, 6: 0}


@pytest.mark.parametrize("k,phrase", [(5, 20), (5, 55), (1, 8)])
def test_line_dedup_with_frequent_runs(spark, docs_of, monkeypatch, k, phrase):
    """Runs of many lines come last in the order: lines that keep enough others, and lines that have to be ordered anew."""
    from cohort_spark.llm import line_dedup as L
    monkeypatch.setattr(L, "FREQUENT", 6)
    r = random.Random(k + phrase)
    common = [f"c{i}" for i in range(phrase)]
    rows = []
    for i in range(60):
        w = [f"x{i}_{j}" for j in range(r.randint(0, 40))]
        w[len(w) // 2: len(w) // 2] = common
        if rows and r.random() < 0.3:
            w = words_of(rows[-1][1])
            w[r.randrange(len(w))] = f"y{i}"
        sep = r.choice([" ", "  ", "\t", " \x0b", "\r "])
        rows.append((i, sep.join(w).capitalize() + sep))
    rows += [(100 + i, t) for i, t in enumerate(t for _, t in corpus(7, n=40, words=90))] + [(None, rows[3][1]), (3, rows[3][1])]
    got = dedup_lines(docs_of(rows), k).collect()
    assert sorted(((x.doc_id, x.text, x.n_lines, x.n_removed) for x in got), key=repr) == brute_lines(rows, k)


def test_frequent_runs_pair_no_lines(spark):
    """Of lines that share a passage and nothing else, none meet in the joins; a run of all words of a line stays."""
    from pyspark.sql import functions as F

    from cohort_spark.llm import line_dedup as L
    passage = " ".join(f"c{i}" for i in range(20))
    rows = [(i, 0, " ".join(f"x{i}_{j}" for j in range(60)) + " " + passage) for i in range(200)]
    firsts = L._first_lines(spark.createDataFrame(rows, "doc_id bigint, tie bigint, text string"), 5, 80)
    each = firsts.select("key", F.explode("prefix").alias("token"))
    assert firsts.count() == 200 and each.count() == 200 * (76 - 61 + 1)
    assert each.groupBy("token").count().where("count > 1").count() == 0


def brute_tiles(item, doc, m):
    """Greedy string tiling by definition."""
    fi, fd, tiles = [True] * len(item), [True] * len(doc), []
    while True:
        best, at = m - 1, []
        for i in range(len(item)):
            for j in range(len(doc)):
                n = 0
                while i + n < len(item) and j + n < len(doc) and fi[i + n] and fd[j + n] and item[i + n] == doc[j + n]:
                    n += 1
                if n > best:
                    best, at = n, [(i, j)]
                elif n == best and n >= m:
                    at.append((i, j))
        if best < m:
            return tiles
        for i, j in at:
            if all(fi[i: i + best]) and all(fd[j: j + best]):
                fi[i: i + best] = [False] * best
                fd[j: j + best] = [False] * best
                tiles.append((i, j, best))


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=14), st.lists(st.integers(0, 2), max_size=18), st.integers(1, 3))
def test_tiles_equal_definition(item, doc, m):
    import numpy as np
    pairs = [(i, j) for i in range(len(item) - m + 1) for j in range(len(doc) - m + 1) if item[i: i + m] == doc[j: j + m]]
    i, j = (np.array(x, np.int64) for x in (zip(*pairs) if pairs else ((), ())))
    assert D.tile(len(item), len(doc), i, j, m) == brute_tiles(item, doc, m)


def test_contamination_both_ways(spark, docs_of):
    r = random.Random(8)
    items = [" ".join(r.choices([f"q{i}" for i in range(500)], k=30)) for _ in range(12)]
    w = items[3].split()
    reordered = " ".join(["intro", *w[20:], "then", *w[10:20], "and", *w[:10]])
    rows = corpus(9) + [(200, "before " + items[0] + " after"), (201, reordered), (202, " ".join(w[:12])), (203, items[1].upper()), (None, items[2]), (200, "before " + items[0] + " after")] + ODD
    bench = spark.createDataFrame([*enumerate(items), (50, None), (51, ""), (52, "too short"), (53, items[0])], "item_id bigint, text string")
    out = {n: sorted(((x.doc_id, x.item_id, x.n_item_words, x.n_covered) for x in D.contaminated(docs_of(rows), bench, broadcast_words=n).collect()), key=repr)
           for n in (10**6, 0)}
    want = [(200, 0, 30, 30), (200, 0, 30, 30), (200, 53, 30, 30), (200, 53, 30, 30), (201, 3, 30, 30), (203, 1, 30, 30), (None, 2, 30, 30)]
    assert out[10**6] == out[0] == sorted(want, key=repr)


def test_empty_tables(spark, docs_of):
    none = docs_of([])
    bench = spark.createDataFrame([], "item_id bigint, text string")
    assert M.near_duplicates(none).count() == 0 and S.remove_repeats(none).count() == 0
    assert dedup_lines(none).count() == 0 and D.contaminated(none, bench).count() == 0
    assert D.contaminated(docs_of(ODD), bench).count() == 0 and D.contaminated(docs_of(ODD), bench, broadcast_words=0).count() == 0


@pytest.mark.parametrize("name", ["op2_line_dedup", "op8_minhash_near_dedup", "op9_substring_dedup"])
def test_queries_equal_their_sql(spark, name):
    import oracle_check as oc
    import pandas as pd

    from cohort_spark.llm.queries import QUERIES, SQL
    sf = "/root/testdata/sf0.001"
    df = QUERIES[name](spark, sf)
    got = pd.DataFrame(df.collect(), columns=df.columns)
    assert oc.rows_of(got, 9) == oc.rows_of(oc.duck(sf).execute(SQL[name]).df(), 9)


def test_kept_text_digest(spark):
    from cohort_spark.llm.queries import QUERIES
    rows = QUERIES["op9_substring_dedup"](spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == 200 and any(r.kept_sha256 == hashlib.sha256(b"").hexdigest() for r in rows)


def test_passages_of_thousands_of_equal_rows(spark, docs_of):  # noqa: F811
    """Marks do not multiply with the rows that repeat id and text."""
    text = " ".join(f"w{i}" for i in range(300))
    got = S.remove_repeats(docs_of([(1, text)] * 3_000 + [(None, text + " end")] * 2_000), length=35)
    assert got.groupBy("doc_id", "n_words", "n_removed").count().orderBy("doc_id").collect() == [(None, 301, 301, 2_000), (1, 300, 300, 3_000)]


def test_pipeline_stages_keep_columns_of_any_name(spark, docs_of):  # noqa: F811
    import corpus_pipeline
    from pyspark.sql import functions as F
    rows = [(1, "some words of a text that repeats"), (1, "some words of a text that repeats"), (2, "another text of some words altogether"), (3, None)]
    docs = docs_of(rows)
    for name in ("gone_id", "gone_hash", "repeat_", "GONE_ID"):
        docs = docs.withColumn(name, F.lit(name)) if name.lower() not in {c.lower() for c in docs.columns} else docs
    out = corpus_pipeline.near_dedup(spark, docs, "")
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == [1, 2, 3]
    assert {(r.gone_id, r.gone_hash, r.repeat_) for r in out.collect()} == {("gone_id", "gone_hash", "repeat_")}
