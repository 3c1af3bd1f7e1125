"""Language model, language identification, word pieces, neighbours, pages, packing, pipeline."""
import collections
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from conftest_llm import ODD, docs_of, words_of  # noqa: F401  (docs_of is a fixture)
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cohort_spark.llm import ann as N
from cohort_spark.llm import html_extract as H
from cohort_spark.llm import lang_id as L
from cohort_spark.llm import lm_score as LM
from cohort_spark.llm import packing as P
from cohort_spark.llm import token_count as T
from cohort_spark.llm.queries import QUERIES, table

SF = "/root/testdata/sf0.001"


# --- language model

def test_lm_counts_and_base_equal_brute_force(spark):
    rows = QUERIES["op1_lm_scoring"](spark, SF).collect()
    texts = {r.doc_id: words_of(r.text, True) + ["\n"] for r in table(spark, SF, "documents").collect()}
    held = {d: zlib.crc32(str(d).encode()) % 5 == 1 for d in texts}
    c = collections.Counter(w for d, ws in texts.items() if not held[d] for w in ws)
    n, v = sum(c.values()), len(c)
    assert len(rows) == len(texts)
    for r in rows:
        ws = texts[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(ws), sum(w in c for w in ws), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), rel=1e-9)
    mine = [r for r in rows if r.held_out]
    assert sum(r.score for r in mine) > sum(r.base_score for r in mine)  # lower perplexity than the base


def test_lm_probabilities_sum_to_one():
    """Over the vocabulary and one unknown word, in every context, also one never met."""
    import pyarrow as pa
    r = random.Random(1)
    texts = [" ".join(r.choices([f"w{i}" for i in range(40)], weights=range(40, 0, -1), k=30)) for _ in range(50)]
    tok, ctx, _ = LM.tokens(pa.array(texts))
    pairs = LM.Pairs(tok, ctx)
    v = len(pairs.words)
    shards = 3
    every = LM.Pairs(np.repeat(pairs.words, LM.CONTEXTS + 1), np.tile(np.arange(LM.CONTEXTS + 1, dtype=np.uint8), v))
    count = np.zeros(len(every.keys))
    np.add.at(count, np.searchsorted(every.keys, pairs.keys[pairs.of]), 1)
    prob_in, parts, got = [], [], {}
    for s, w, p in every.by_shard(shards):
        local = np.searchsorted(w, every.word[p])
        data = LM._pack(every.words[w], np.bincount(local, minlength=len(w)).astype(np.uint8), (every.keys[p] & 255).astype(np.uint8), count[p].astype(np.uint32))
        out = list(LM._serve(pa.table({"grp": [7], "shard": pa.array([s], pa.int32()), "data": [data]}), shards))
        got[s] = (w, p, LM._unpack(out[0][2]))
        parts.append(LM._unpack(out[1][2]))
    totals = LM.Totals(parts)
    assert totals.vocabulary == v and totals.tokens == len(tok)
    mass = np.zeros(LM.CONTEXTS + 1)
    for w, p, (_, parent, c, t) in got.values():
        at = np.searchsorted(w, every.word[p])
        ctx_ = (every.keys[p] & 255).astype(np.int64)
        q = totals.probability(ctx_, c, t, parent[:, 0][:, at].astype(float), parent[:, 1][:, at].astype(float))
        assert (q > 0).all()
        np.add.at(mass, ctx_, q)
    zero = np.zeros((LM.SAMPLES, LM.CONTEXTS + 1))
    every_ctx = np.arange(LM.CONTEXTS + 1)
    mass += totals.probability(every_ctx, np.zeros(len(every_ctx)), zero, zero, zero)
    assert np.allclose(mass, 1, atol=1e-9) and not prob_in


def test_seating_keeps_its_customers():
    r = np.random.default_rng(3)
    key = np.unique(r.integers(0, 50, 400) * 256 + r.integers(0, 9, 400))
    _, word = np.unique(key >> 8, return_inverse=True)
    count = r.integers(1, 30, len(key))
    s = LM.Seating(word, key & 255, count, word.max() + 1, 1.0, 1)
    for _ in range(20):
        s.round()
        assert (np.bincount(s.dish, weights=s.size, minlength=len(count)) == count).all() and (s.size > 0).all()
        customers, tables = s.parent()
        assert (customers == np.bincount(word, weights=s.tables(), minlength=word.max() + 1)).all()
        assert (tables >= 1).all() and (tables <= customers).all() and (np.diff(s.dish) >= 0).all()


def test_lm_contexts_are_whole_words(spark, docs_of):
    """Two words of one class (the same last three bytes) are followed by words of their own."""
    r = random.Random(4)
    after = {"soothe": [f"left{i}" for i in range(5)], "bathe": [f"right{i}" for i in range(5)]}
    rows = [(i, " ".join(w for _ in range(20) for h in [r.choice(list(after))] for w in (h, r.choice(after[h])))) for i in range(60)]
    tests = {(h, f): i for i, (h, f) in enumerate(((h, f) for h in after for f in after), 1000)}
    rows += [(i, " ".join(w for x in after[f] for w in (h, x))) for (h, f), i in tests.items()]
    got = {x.doc_id: x for x in LM.score(docs_of(rows), F.col("doc_id") < 1000).collect()}
    for h in after:
        own, other = (got[tests[h, f]] for f in sorted(after, key=lambda f: f != h))
        assert own.n_known == own.n_tokens == other.n_known == 11
        assert own.score > other.score + 5  # five words that follow one in five times, or never


def test_lm_probabilities_sum_to_one_after_each_word():
    """Over the vocabulary and one unknown word, after every word of the vocabulary, over groups and shards."""
    r = random.Random(2)
    vocabulary = [f"w{i}" for i in range(12)]
    texts = [" ".join(r.choices(vocabulary, weights=range(12, 0, -1), k=25)) for _ in range(40)]
    every = [f"{a} {b}" for a in vocabulary for b in [*vocabulary, "unknown"]] + vocabulary + ["unknown"] + vocabulary
    groups = [(texts[:20], True), (texts[20:], True), (every, False)]
    shards, parts, got, asked, sums = 3, [], [], {}, {}
    for g, (t, train) in enumerate(groups):
        for s, data in LM._requests(pa.table({"text": t, "train": [train] * len(t)}), shards):
            asked.setdefault(s, []).append((g, data))
    table = lambda rows: pa.table({k: list(c) for k, c in zip(("grp", "shard", "data"), zip(*rows))})
    for s, rows in asked.items():
        for row in LM._serve(table([(g, s, d) for g, d in rows]), shards):
            if row[0] in (LM.PARTS, LM.ASKED):
                sums.setdefault(row[1], []).append(row)
            else:
                (got if row[0] >= 0 else parts).append(row)
    for rows in sums.values():
        got += LM._words_before(table(rows))
    totals = LM.Totals([LM._unpack(d) for _, _, d in parts])
    assert totals.tokens == sum(len(t.split()) + 1 for t in texts) and totals.vocabulary == 13
    tok, ctx, size = LM.tokens(pa.array(every))
    pairs = LM.Pairs(tok, ctx, grams=True)
    of_word, *more = LM._answered(pairs, table([x for x in got if x[0] == 2]), shards)
    prob = totals.gram_probability(pairs, of_word, *more)[pairs.gram_of]
    begin = np.concatenate([[0], np.cumsum(size)])
    n = len(vocabulary)
    for i in range(n):  # the words after this one, an unknown one, and the end
        mass = sum(prob[begin[i * (n + 1) + j] + 1] for j in range(n + 1)) + prob[begin[n * (n + 1) + i] + 1]
        assert mass == pytest.approx(1, abs=1e-9)
    # tables of a context are those that its words got, and no more than its customers
    _, _, _, _, gram_count, gram_tables, before = LM._answered(pairs, table([x for x in got if x[0] == 2]), shards)
    for s in range(LM.SAMPLES):
        mine = np.bincount(pairs.before, weights=gram_tables[s], minlength=len(of_word))
        inner = of_word > 0
        assert ((gram_tables[s] >= 1) == (gram_count >= 1)).all() and (gram_tables[s] <= gram_count).all()
        assert (mine[inner] <= before[s][inner]).all() and (before[s] <= of_word).all()


def test_many_customers_come_and_go_at_once():
    """Hundreds of customers of one dish follow the tables above, and parent customers follow them."""
    r = np.random.default_rng(5)
    word, context = np.repeat(np.arange(4), 3), np.tile(np.arange(3), 4)
    s = LM.Seating(word, context, np.array([2000, 3, 1] * 4), 4, 1.0, 1)
    expected = s.count.copy()
    for _ in range(6):
        left, come = r.integers(0, 4, 900) * 3, r.integers(0, 12, 700)
        expected += np.bincount(come, minlength=12) - np.bincount(left, minlength=12)
        s.round(left, come)
        assert (s.count == expected).all() and (s.size > 0).all()
        assert (np.bincount(s.dish, weights=s.size, minlength=12) == expected).all()
        assert (s.parent()[0] == np.bincount(word, weights=s.tables(), minlength=4)).all()


def expected_tables(customers, weight, discount):
    """Mean number of tables of a dish, from the exact distribution given the weight of a new table."""
    p = np.full(customers + 1, -np.inf)
    p[1] = 0.0
    t = np.arange(customers + 1)
    for n in range(1, customers):  # logs of generalised Stirling numbers
        p = np.logaddexp(p + np.log(np.maximum(n - discount * t, 1e-300)), np.r_[-np.inf, p[:-1]])
    p = np.exp(p + t * np.log(weight) - (p + t * np.log(weight)).max())
    return (p * t).sum() / p.sum()


@pytest.mark.parametrize("customers", [2, 4, 8, 40, 1500])
def test_a_sweep_seats_all_customers(customers):
    """Numbers of tables as in the exact distribution, for dishes that are swept one by one and in pieces."""
    class Fixed(LM.Tables):
        discount, weight = LM.DISCOUNT, 2.0

        def open(self):
            return np.full(len(self.count), self.weight)
    k, got = 600, []
    s = Fixed(np.full(k, customers), np.ones(k, np.int64), np.random.default_rng(customers))
    for i in range(24):
        before = s.number.copy()
        left, come = s.sweep()
        assert (before - np.bincount(left, minlength=k) + np.bincount(come, minlength=k) == s.number).all()
        assert (np.bincount(s.dish, weights=s.size, minlength=k) == customers).all() and (s.size > 0).all()
        got += [s.number.mean()] * (i >= 8)
    assert np.mean(got) == pytest.approx(expected_tables(customers, 2.0, LM.DISCOUNT), rel=0.05)


def test_a_round_seats_all_customers():
    """Tables of nearly equal sizes, as they begin, are gone after one round; one customer of each dish would leave them."""
    word, context = np.repeat(np.arange(30), 3), np.tile(np.arange(3), 30)
    s = LM.Seating(word, context, np.full(90, 4000), 30, 1.0, 7)
    s.round()
    for dish in range(90):
        mine = s.size[s.dish == dish]
        assert len(mine) < 5 or mine.max() - mine.min() > 0.2 * mine.mean()


def test_lm_odd_texts(spark, docs_of):
    out = LM.score(docs_of(ODD), F.lit(True)).collect()
    assert sorted((r.n_tokens for r in out)) == sorted(len(words_of(t)) + 1 for _, t in ODD)
    assert all(math.isfinite(r.score) and r.score <= 0 for r in out)
    assert all(r.score == 0 and r.n_known == 0 for r in LM.score(docs_of(ODD), F.lit(False)).where("n_tokens = 1").collect())
    assert LM.score(docs_of([]), F.lit(True)).count() == 0


# --- language identification

def test_language_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    out = QUERIES["op3_language_id"](spark, sf).join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id").where("held_out")
    r = out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")).alias("a"), F.min("score").alias("lo"), F.max("score").alias("hi")).first()
    assert r.a > 0.97 and 0 <= r.lo <= r.hi <= 1


def test_language_odd_texts(spark, docs_of):
    out = {(r.doc_id, r.lang_pred) for r in L.identify(docs_of(ODD), F.lit(True)).collect()}
    assert {(1, "und"), (2, "und"), (3, "und"), (10, "und"), (4, "en"), (None, "en")} <= out
    assert {r.lang_pred for r in L.identify(docs_of(ODD), F.lit(False)).collect()} == {"und"}
    assert L.identify(docs_of([]), F.lit(True)).count() == 0
    carried = L.identify(docs_of(ODD), F.lit(True), carry=True).select("row.*")
    assert carried.count() == len(ODD) and carried.columns == docs_of(ODD).columns


def test_ngrams_equal_definition():
    texts = ["Ab, c!", "", "1 2", "ÉÀ xyz", "x"]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    off = np.cumsum([0] + [len(t.encode()) for t in texts])
    for order, (_, text) in enumerate(L.ngrams(raw, off), 1):
        want = []
        for k, t in enumerate(texts):
            words = "".join(c.lower() if c.isalpha() else " " for c in t).split()
            want += [k] * sum({1: len(w), 2: len(w) + 1, 3: len(w)}[order] for w in words)
            if order == 2 and words:
                pass
        assert len(text) == len(want) and text.tolist() == want


def test_temperature_is_calibrated():
    r = np.random.default_rng(1)
    logits = r.normal(size=(4000, 3)) * 2
    truth = np.array([r.choice(3, p=p) for p in L._softmax(logits)])
    assert L.temperature(logits * 5, truth) == pytest.approx(5, rel=0.15)


# --- word pieces

@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("abc", min_size=1, max_size=4), max_size=8), st.text("abcd", max_size=14))
def test_automaton_equals_greedy_longest_match(pieces, word):
    vocabulary = {p.encode() for p in pieces} | {b"a", b"b"}
    w, n, i = word.encode(), 0, 0
    while i < len(w):
        k = max((k for k in range(1, 5) if w[i: i + k] in vocabulary and i + k <= len(w)), default=0)
        if not k:
            n = 1
            break
        i, n = i + k, n + 1
    assert T.Automaton(sorted(vocabulary)).length(w) == n


def test_token_counts(spark, docs_of):
    out = {r.doc_id: r for r in T.count_tokens(docs_of(ODD)).collect()}
    assert (out[1].n_tokens, out[2].n_words, out[5].n_words) == (0, 0, 60_000)
    vocabulary = set(T.read_vocabulary(T.default_vocabulary()))
    for r in QUERIES["op4_token_counts"](spark, SF).join(table(spark, SF, "documents").select("doc_id", "text"), "doc_id").limit(20).collect():
        n = 0
        for w in words_of(r.text):
            b, i = b" " + w.encode(), 0
            while i < len(b):
                i += max(k for k in range(1, 40) if b[i: i + k] in vocabulary)
                n += 1
        assert n == r.n_tokens
    assert T.count_tokens(docs_of([])).count() == 0


# --- neighbours

def exact_neighbours(rows, k):
    ok = [(i, np.array(v, float)) for i, v in rows if v is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    out = {}
    for a, (i, v) in enumerate(ok):
        if i is not None and i % 20 == 0:
            best = sorted((-float(v @ w), j) for b, (j, w) in enumerate(ok) if a != b and j is not None)
            out[i] = [(j, -s) for s, j in best[:k]]
    return out


def test_neighbours_are_exact_on_small_tables(spark):
    r = np.random.default_rng(2)
    rows = [(i, (r.normal(size=8) * r.uniform(0.1, 3)).tolist()) for i in range(300)]
    rows += [(400, None), (420, [0.0] * 8), (440, [float("nan")] * 8), (460, [1.0, None] + [0.0] * 6), (480, [float("inf")] * 8), (500, rows[0][1]), (501, rows[0][1])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id bigint, embedding array<double>, score int")
    got = collections.defaultdict(list)
    for x in N.nearest(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got[x.query_id].append((x.vec_id, x.score))
    want = exact_neighbours(rows, 20)
    assert set(got) == set(want)
    for q in want:
        assert [j for j, _ in got[q]] == [j for j, _ in want[q]] and np.allclose([s for _, s in got[q]], [s for _, s in want[q]])
    assert N.nearest(df.where("vec_id < 3"), F.col("vec_id") == 0).count() == 2
    assert N.nearest(df.limit(0), F.lit(True)).count() == 0


def test_neighbour_recall(spark):
    sf = "/root/testdata/sf0.1"
    rows = [(r.vec_id, r.embedding) for r in table(spark, sf, "embeddings").collect()]
    x = np.array([v for _, v in rows], float)
    found = collections.defaultdict(set)
    for r in QUERIES["op6_nearest_neighbours"](spark, sf).collect():
        found[r.query_id].add(r.vec_id)
    hits = []
    for a, (i, _) in enumerate(rows):
        if i % 20 == 0:
            s = x @ x[a]
            s[a] = -np.inf
            hits.append(len(found[i] & {rows[b][0] for b in np.argsort(-s)[:20]}) / 20)
    assert np.mean(hits) >= 0.9


# --- pages

PAGE = """<!doctype html><html><head><title>T</title><style>p{}</style></head><body class="has-sidebar"><header class="site"><a href="/">Site</a></header>
<nav><ul><li><a href=1>Home</a><li><a href=2>News</a></ul></nav><div class="cookie-notice">We use cookies, please accept.</div>
<article><header><h1>A &amp; B</h1></header><p>First   paragraph,\nwith <b>bold</b> and <a href=3>a link</a>.<p>Second &#8211; one.<br>Line.</p><!-- no <p>text</p> -->
<script>var x = "</p><p>no";</script><div class="ad">Buy now</div><p>Third.</p></article>
<aside>Related</aside><section id="comments"><article class="comment"><p>Nice words here, thank you very much, dear author.</p></article></section>
<form><p>Send</p><input></form><footer>&copy; 2020</footer></body></html>"""


def test_main_text():
    want = "A & B\nFirst paragraph, with bold and a link.\nSecond – one. Line.\nThird."
    assert H.main_text(PAGE, H.DEFAULT) == want
    assert [H.main_text(x, H.DEFAULT) for x in ("", "   ", "<", "<p", "<script>x", "<!-- x")] == ["", "", "", "", "", ""]
    assert H.main_text("<div>" * 3000 + "<p>deep words, many of them, in a paragraph here.", H.DEFAULT)


def test_wrappers_of_most_of_a_page_are_no_marks():
    text = ["The river rose again in the night, and the lower town, as so often, was under water.", "Nobody had counted the boats, but there were enough, said the keeper of the bridge.",
            "In the morning the water fell, the streets were swept, and the market opened at noon."]
    body = "".join(f"<p>{t}</p>" for t in text)
    menu = '<ul><li><a href="/">Home</a></li><li><a href="/a">About us</a></li></ul>'
    for page in (f'<body><form action="/">{menu}<div>{body}</div></form></body>', f"<body><form><nav>{menu}</nav><article>{body}</article></form></body>",
                 f'<body><div class="layout with-sidebar"><div>{body}</div><div class="sidebar">{menu}</div></div></body>',
                 f"<body><div>{body}</div><form><p>Send us a word, please.</p></form></body>"):
        assert H.main_text(page, H.DEFAULT) == "\n".join(text)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.floats(-3, 3), min_size=1, max_size=7), st.lists(st.tuples(st.integers(0, 6), st.integers(0, 6), st.floats(0, 2)), max_size=10))
def test_cut_is_minimal(odds, edges):
    n = len(odds)
    edges = [(a, b, c) for a, b, c in edges if a < n and b < n and a != b]

    def cost(side):
        return sum(o if o > 0 and not s else -o if o < 0 and s else 0 for o, s in zip(odds, side)) + sum(c for a, b, c in edges if side[a] != side[b])
    least = min(cost([m >> i & 1 == 1 for i in range(n)]) for m in range(1 << n))
    assert cost(H.source_side(odds, edges)) == pytest.approx(least, abs=1e-6)


def test_pages_query(spark):
    import html
    import re
    for r in QUERIES["op7_html_extraction"](spark, SF).join(table(spark, SF, "pages").select("page_id", "html"), "page_id").collect():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)[1].replace("<br>", " ")
        parts = [" ".join(html.unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split("</?(?:p|h1)>", inner)]
        assert r.text == "\n".join(x for x in parts if x) and r.n_chars == len(r.text)
    odd = spark.createDataFrame([(1, None, None, 1), (None, "u", "", 2), (2, "u", PAGE, 3), (2, "u", PAGE, 3)], "page_id bigint, url string, html string, text int")
    assert sorted(r.n_chars for r in H.extract(odd).collect())[:2] == [0, 0] and H.extract(odd).count() == 4 and H.extract(odd.limit(0)).count() == 0


# --- packing

@settings(max_examples=25, deadline=None)
@given(st.lists(st.integers(0, 60), min_size=17, max_size=17))
def test_plan_uses_up_the_supply(supply):
    supply = np.array([0, *supply[1:]])
    used = np.zeros(17, int)
    for pattern, times in P.plan(supply, 3):
        assert sum(pattern) <= 16 and times > 0
        for b in pattern:
            used[b] += times
    assert (used == supply).all()


def test_nnls_meets_its_conditions():
    r = np.random.default_rng(4)
    a, b = r.random((12, 30)), r.random(12)
    x = P.nnls(a, b)
    g = a.T @ (b - a @ x)
    assert (x >= 0).all() and (g <= 1e-6).all() and np.abs(g[x > 0]).max() < 1e-6


def check_packed(rows, texts, window=2048):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(P.default_tokenizer())
    left = collections.Counter()
    for t in texts:
        ids = np.array([*tok.encode(t[1] or "", add_special_tokens=False).ids, 1], "<u4")
        left.update((t[0], s, len(ids[s: s + window]), zlib.crc32(ids[s: s + window].tobytes()), len(ids)) for s in range(0, len(ids), window))
    assert collections.Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows) == left
    seq = collections.defaultdict(list)
    for r in rows:
        seq[r.sequence_id].append(r)
    for s in seq.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window
    return sum(r.length for r in rows) / (window * max(1, len(seq)))


def test_packing(spark, docs_of):
    texts = [(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()]
    assert check_packed(QUERIES["op10_packing"](spark, SF).collect(), texts) > 0.95
    odd = [*ODD, (20, "İstanbul ΣΑΣ'S don't <|endoftext|> x.y,z!! 123 ́e \x1c\x85 ok")]
    check_packed(P.pack(docs_of(odd), bucket_rows=3).collect(), odd)
    rows = P.pack(docs_of(odd), with_ids=True).collect()
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in rows)
    assert P.pack(docs_of([])).count() == 0


# --- pipeline

def test_pipeline_stages(spark, docs_of, tmp_path):
    import corpus_pipeline as C
    assert [n for n, _ in C.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontaminate", "packing"]
    r = random.Random(11)
    word = lambda: "".join(r.choices("abcdefghij", k=6))
    text = lambda n: " ".join(word() for _ in range(n))
    base, item, shared = text(60), text(30), text(12)
    near = base.split()
    near[30] = "changed"
    rows = [(0, base + "\n" + shared), (1, " ".join(near)), (2, "12 %%"), (3, None), (4, text(30) + "\n" + shared), (5, text(5) + " " + item + " " + text(5)), (6, text(50)), (6, text(50)), (None, text(40))]
    rows.append(rows[6])
    docs = docs_of(rows)
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    run = {n: f for n, f in C.STAGES}
    a = run["language_id"](spark, docs, str(tmp_path))
    assert a.columns == docs.columns and sorted((x.doc_id for x in a.collect()), key=repr) == sorted([0, 1, 4, 5, 6, 6, 6, None], key=repr)
    b = run["line_dedup"](spark, a, str(tmp_path))
    by = {x.doc_id: x for x in b.collect()}
    assert b.dtypes == docs.dtypes and by[4].text == rows[4][1].split("\n")[0] and by[4].n_chars == len(by[4].text) and 1 not in by
    c = run["near_dedup"](spark, docs, str(tmp_path))
    assert c.columns == docs.columns
    assert sorted((x.doc_id for x in c.collect()), key=repr) == sorted([0, 1, 2, 3, 4, 5, 6, 6, None], key=repr)
    d = run["decontaminate"](spark, c, str(tmp_path))
    assert sorted((x.doc_id for x in d.collect()), key=repr) == sorted([0, 1, 2, 3, 4, 6, 6, None], key=repr)
    e = run["packing"](spark, d, str(tmp_path)).collect()
    check_packed(e, [(x.doc_id, x.text) for x in d.collect()])
    for f in run.values():
        assert f(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_pipeline_query(spark):
    import __spark_entry__ as E
    assert "pipeline" in E.queries()
    rows = E.queries()["pipeline"](spark, SF)
    assert rows.count() > 0 and "sequence_id" in rows.columns


def test_short_documents_are_packed_by_their_exact_length(spark, docs_of):  # noqa: F811
    from cohort_spark.llm.packing import pack
    got = pack(docs_of([(i, "") for i in range(2_000)] + [(5_000 + i, "a") for i in range(500)]))
    assert got.select("sequence_id").distinct().count() == 2  # 2,000 + 1,000 ids
    per = got.groupBy("sequence_id").agg({"length": "sum"}).collect()
    assert sum(r[1] for r in per) == got.agg({"length": "sum"}).first()[0] and max(r[1] for r in per) <= 2048
    again = {}
    for r in got.orderBy("sequence_id", "offset").collect():
        assert r["offset"] == again.get(r["sequence_id"], 0)
        again[r["sequence_id"]] = r["offset"] + r["length"]


def test_counts_beyond_32_bits_are_served_whole():
    from cohort_spark.llm.lm_score import _narrow
    for x, kind in ((np.array([3, 2**32 - 1]), np.uint32), (np.array([3, 2**32 + 5]), np.int64), (np.zeros((3, 0), np.int64), np.uint32)):
        assert _narrow(x).dtype == kind and (_narrow(x) == x).all()
