"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn
    return add


# --- op8: circulant MinHash near-duplicates ---------------------------------

WORDS = (r"[x FOR x IN string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
         r"'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') IF x <> '']")

OP8_SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS} AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) = 1 THEN [ws[1]]
      ELSE list_distinct([ws[i] || ' ' || ws[i + 1] FOR i IN range(1, len(ws))]) END AS ss FROM w),
n AS (SELECT doc_id, len(ss) AS n FROM s),
t AS (SELECT doc_id, unnest(ss) AS sh FROM s),
f AS (SELECT sh, count(*) AS df FROM t GROUP BY sh),
r AS (SELECT t.doc_id, t.sh, n.n, row_number() OVER (PARTITION BY t.doc_id ORDER BY f.df, t.sh) AS rk
      FROM t JOIN f USING (sh) JOIN n USING (doc_id)),
p AS (SELECT doc_id, sh, n FROM r WHERE rk <= n - ceil(n * 80 / 100.0) + 1),
c AS (SELECT DISTINCT x.doc_id AS a, y.doc_id AS b FROM p x JOIN p y ON x.sh = y.sh AND x.doc_id < y.doc_id
      AND 100 * least(x.n, y.n) >= 80 * greatest(x.n, y.n)),
i AS (SELECT c.a, c.b, count(*) AS k FROM c JOIN t x ON x.doc_id = c.a JOIN t y ON y.doc_id = c.b AND y.sh = x.sh GROUP BY ALL),
e AS (SELECT i.a, i.b FROM i JOIN n x ON x.doc_id = i.a JOIN n y ON y.doc_id = i.b WHERE 100 * k >= 80 * (x.n + y.n - k)),
g AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach AS (SELECT doc_id, doc_id AS root FROM n UNION SELECT g.b, reach.root FROM reach JOIN g ON g.a = reach.doc_id AND reach.root < g.b)
SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, m.root AS component_id, n.doc_id = m.root AS kept
FROM n JOIN (SELECT doc_id, min(root) AS root FROM reach GROUP BY doc_id) m USING (doc_id)
"""


@query("op8_minhash_near_dedup", OP8_SQL)
def op8(spark, sf_dir):
    from .minhash import near_duplicates
    out = near_duplicates(table(spark, sf_dir, "documents"), shingle=2, threshold=80)
    return out.select("doc_id", "n_shingles", "component_id", "kept")


# --- op9: repeated passages by seed and extend -------------------------------

PLAIN_WORDS = r"[x FOR x IN string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+') IF x <> '']"

OP9_SQL = f"""
WITH w AS (SELECT doc_id, {PLAIN_WORDS} AS ws FROM documents),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + 34], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w WHERE len(ws) >= 35)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY g) AS n FROM g) WHERE n > 1),
c AS (SELECT DISTINCT doc_id, i + unnest(range(0, 35)) AS p FROM r),
t AS (SELECT doc_id, unnest(ws) AS x, generate_subscripts(ws, 1) AS p FROM w),
k AS (SELECT t.doc_id, count(*) FILTER (WHERE c.p IS NOT NULL) AS gone, string_agg(t.x, ' ' ORDER BY t.p) FILTER (WHERE c.p IS NULL) AS kept
      FROM t LEFT JOIN c ON t.doc_id = c.doc_id AND t.p = c.p GROUP BY t.doc_id)
SELECT w.doc_id, CAST(len(w.ws) AS BIGINT) AS n_words, CAST(coalesce(k.gone, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(k.kept, '')) AS kept_sha256
FROM w LEFT JOIN k USING (doc_id)
"""


@query("op9_substring_dedup", OP9_SQL)
def op9(spark, sf_dir):
    from pyspark.sql import functions as F

    from .substring_dedup import remove_repeats
    out = remove_repeats(table(spark, sf_dir, "documents"), length=35)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


# --- op4: word-piece counts ---------------------------------------------------

@query("op4_token_counts")
def op4(spark, sf_dir):
    from .token_count import count_tokens
    return count_tokens(table(spark, sf_dir, "documents"))


# --- op5: benchmark decontamination -------------------------------------------

@query("op5_decontamination")
def op5(spark, sf_dir):
    from .decontaminate import contaminated
    out = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.drop("text_hash")


# --- op10: packing --------------------------------------------------------------

@query("op10_packing")
def op10(spark, sf_dir):
    from .packing import pack
    return pack(table(spark, sf_dir, "documents"))


# --- op2: line dedup --------------------------------------------------------------

OP2_SQL = r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS p FROM documents),
w AS (SELECT doc_id, p, line, [x FOR x IN string_split_regex(lower(line), '[ \t\x0B\f\r]+') IF x <> ''] AS ws FROM l),
s AS (SELECT doc_id, p, line, ws, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
      ELSE list_sort(list_distinct([array_to_string(ws[i:i + 4], ' ') FOR i IN range(1, len(ws) - 3)])) END AS ss FROM w),
g AS (SELECT *, min((doc_id, p)) OVER (PARTITION BY ss) AS f FROM s WHERE len(ss) > 0),
c AS (SELECT doc_id, p, ss, len(ss) AS n, row_number() OVER (ORDER BY doc_id, p) AS id FROM g WHERE f = (doc_id, p)),
t AS (SELECT id, n, unnest(ss) AS sh FROM c),
df AS (SELECT sh, count(*) AS df FROM t GROUP BY sh),
r AS (SELECT t.id, t.n, t.sh, row_number() OVER (PARTITION BY t.id ORDER BY df.df, t.sh) AS rk FROM t JOIN df USING (sh)),
x AS (SELECT id, n, sh FROM r WHERE rk <= n - ceil(n * 80 / 100.0) + 1),
a AS (SELECT DISTINCT u.id AS i, v.id AS j FROM x u JOIN x v ON u.sh = v.sh AND u.id < v.id AND 100 * least(u.n, v.n) >= 80 * greatest(u.n, v.n)),
k AS (SELECT a.i, a.j, count(*) AS o FROM a JOIN t u ON u.id = a.i JOIN t v ON v.id = a.j AND v.sh = u.sh GROUP BY ALL),
gone AS (SELECT DISTINCT k.j AS id FROM k JOIN c u ON u.id = k.i JOIN c v ON v.id = k.j WHERE 100 * k.o >= 80 * (u.n + v.n - k.o)),
keep AS (SELECT doc_id, p FROM c WHERE id NOT IN (SELECT id FROM gone))
SELECT w.doc_id, CAST(count(*) FILTER (WHERE len(w.ws) > 0) AS BIGINT) AS n_lines,
       CAST(count(*) FILTER (WHERE len(w.ws) > 0 AND keep.p IS NULL) AS BIGINT) AS n_removed,
       sha256(coalesce(string_agg(w.line, chr(10) ORDER BY w.p) FILTER (WHERE len(w.ws) = 0 OR keep.p IS NOT NULL), '')) AS text_sha256
FROM w LEFT JOIN keep ON keep.doc_id = w.doc_id AND keep.p = w.p GROUP BY w.doc_id
"""


@query("op2_line_dedup", OP2_SQL)
def op2(spark, sf_dir):
    from pyspark.sql import functions as F

    from .line_dedup import dedup_lines
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


# --- op3: language identification ------------------------------------------------

def remainder(n: int):
    """crc32 of doc_id as text, modulo n."""
    from pyspark.sql import functions as F
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(n))


@query("op3_language_id")
def op3(spark, sf_dir):
    from pyspark.sql import functions as F

    from .lang_id import identify
    out = identify(table(spark, sf_dir, "documents"), F.coalesce(remainder(4) != 2, F.lit(True)))
    return out.select("doc_id", F.coalesce(remainder(4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


# --- op6: approximate nearest neighbours -------------------------------------------

@query("op6_nearest_neighbours")
def op6(spark, sf_dir):
    from pyspark.sql import functions as F

    from .ann import nearest
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


# --- op7: main text of pages ---------------------------------------------------------

@query("op7_html_extraction")
def op7(spark, sf_dir):
    from .html_extract import extract
    return extract(table(spark, sf_dir, "pages"))


# --- op1: language-model scores -----------------------------------------------------

@query("op1_lm_scoring")
def op1(spark, sf_dir):
    from pyspark.sql import functions as F

    from .lm_score import score
    out = score(table(spark, sf_dir, "documents"), F.coalesce(remainder(5) != 1, F.lit(True)))
    return out.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


# --- op11: document fingerprints ------------------------------------------------------

@query("op11_order_minhash")
def op11(spark, sf_dir):
    from .order_minhash import compare_next
    return compare_next(table(spark, sf_dir, "documents"))


# --- op12: ranked lexical search ------------------------------------------------------

TERMS = (r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
         r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')")

OP12_SQL = f"""
WITH d AS (SELECT doc_id, {TERMS} AS ts FROM documents),
g AS (SELECT count(*) FILTER (WHERE len(ts) > 0) AS docs, CAST(sum(len(ts)) AS BIGINT) AS total FROM d),
q AS (SELECT item_id, t, count(*) AS c FROM (SELECT item_id, unnest({TERMS}) AS t FROM benchmark) GROUP BY ALL),
p AS (SELECT doc_id, n, t, count(*) AS tf FROM (SELECT doc_id, len(ts) AS n, unnest(ts) AS t FROM d) GROUP BY ALL),
w AS (SELECT t, CAST(floor(1000 * ln(CAST(2 * any_value(docs) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, g GROUP BY t),
s AS (SELECT q.item_id, p.doc_id, CAST(sum(q.c * w.w * ((1000000000 * p.tf) // (1000 * p.tf + 12 * (100 - 25 + ((25 * p.n * g.docs) // g.total))))) AS BIGINT) AS score
      FROM q JOIN p USING (t) JOIN w USING (t), g GROUP BY ALL),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 20
"""


@query("op12_ranked_search", OP12_SQL)
def op12(spark, sf_dir):
    from .impact_rank import rank
    return rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


# --- op13: hard negatives ---------------------------------------------------------------

OP13_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
             [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS c
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
             AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT a.vec_id AS anchor_id, o.vec_id, a.label = o.label AS same,
             CAST(list_sum([a.c[i] * o.c[i] FOR i IN range(1, len(a.c) + 1)]) AS BIGINT) AS score
      FROM v a JOIN v o ON a.vec_id <> o.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
             row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS rank
      FROM p JOIN s USING (anchor_id) WHERE NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""


@query("op13_hard_negatives", OP13_SQL)
def op13(spark, sf_dir):
    from pyspark.sql import functions as F

    from .multi_index import hard_negatives
    turned = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", turned), F.col("vec_id") % 50 == 0)
