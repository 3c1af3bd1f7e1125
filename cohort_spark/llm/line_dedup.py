"""Line dedup by an exact set-similarity join; DataFrame functions only.

A line's tokens are the distinct runs of ``shingle`` words in it (the whole
line where it has fewer words); two lines match if the Jaccard similarity of
their token sets is at least ``threshold`` per cent. A line is removed if any
earlier line matches it; earlier: by doc_id, then by line number.

The join. Tokens of a line are ordered by their hash, frequent ones last.
Lines with equal sets are one class, led by the first of them.
Two sets that match share a token among the first
``n - ceil(threshold * n / 100) + 1`` of each (prefix filter), have sizes
within the threshold of each other (length filter), and the places of the
shared tokens, or the tokens of both prefixes that are not shared, leave room
for the overlap they need (positional filter). What
passes is compared in full.

Skew. Prefixes are first taken longer than need be, and their tokens counted in
a fixed number of hash buckets. Frequent ones come last in the order (64 KB of
classes of counts, part of the plan). Most lines keep enough tokens that are not
frequent; of the others all tokens are counted, and ordered anew from the text.
Of a token that several classes have in their prefixes, each class is
first compared with the earliest class only; classes that this does not
remove with the earlier class that can overlap them most, and those still left
with all earlier classes that pass the filters. A family of variants of one
line is mostly settled in the first steps, which compare one pair for a line
and token, or a line. Tokens of one class alone, which are nearly all, are gone
before any join.

Words are separated by white space and compared in lower case; tokens are
identified by 64-bit hashes of the hashes of their words. Defined cases: lines without words are kept and
match nothing; a null text stays null and an empty one empty; rows that repeat
the same id and text are the same lines, so neither removes the other's;
extra columns are handed on in a struct; an empty table gives an
empty result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import written

BUCKET_BITS = 16
#: A bucket of tokens is frequent with so many more tokens than the mean, or so many deviations of chance.
FREQUENT, DEVIATIONS = 64, 6
#: Lines up to which the ones to look up again or to leave out are sent to every task.
BROADCAST_DOCS = 500_000


def _plain(text: Column) -> Column:
    """Lower case, one space for each run of white space within a line."""
    odd = F.contains(text, F.lit("  "))
    for c in "\t\x0b\f\r":
        odd = odd | F.contains(text, F.lit(c))
    return F.lower(F.when(odd, F.regexp_replace(text, r"[ \t\x0B\f\r]+", " ")).otherwise(text))


def _words(plain: Column) -> Column:
    """Words of a line; a line without words has the empty string alone."""
    return F.split(F.trim(plain), " ")


def _bucket(h: Column) -> Column:
    return h.bitwiseAND(F.lit((1 << BUCKET_BITS) - 1)).cast("int")


def _class(h: Column, classes: bytes) -> Column:
    """Class of counts of a token's bucket, 0 for those that are not frequent."""
    return F.ascii(F.substring(F.lit(bytearray(classes)), _bucket(h) + 1, F.lit(1)).cast("string"))


def _lines(texts: DataFrame) -> DataFrame:
    """(key, words) of all lines. No row is filtered here, and the arrays are
    exploded with their nulls: a condition would be evaluated below the
    projection, and split every line a second time."""
    at = texts.select("doc_id", "tie", F.posexplode_outer(F.split(_plain(F.col("text")), "\n")).alias("line_no", "line"))
    return at.select(F.struct("doc_id", "tie", "line_no").alias("key"), _words(F.coalesce("line", F.lit(""))).alias("words"))


def _tokens(lines: DataFrame, k: int) -> DataFrame:
    """(key, t): the distinct tokens of the lines (key, words), by their hashes. Each word is hashed once."""
    none = F.array().cast("array<bigint>")
    h = lines.select("key", F.when(F.get("words", F.lit(0)) != "", F.transform("words", lambda w: F.xxhash64(w))).otherwise(none).alias("h"))
    n = F.size("h")
    runs = F.transform(F.sequence(F.lit(0), F.greatest(n - k, F.lit(0))), lambda i: F.xxhash64(*[F.get(F.col("h"), i + j) for j in range(k)]))
    t = F.when(n >= k, F.sort_array(F.array_distinct(runs))).when(n > 0, F.array(F.xxhash64("h"))).otherwise(none)
    return h.select("key", t.alias("t"))


def _need(size: Column, threshold: int) -> Column:
    """Length of the prefix of a set of ``size``."""
    return size - F.floor((size * threshold + 99) / 100).cast("int") + 1


def _prefix(t: Column, size: Column, threshold: int, more: bool = False) -> Column:
    """Prefix of a set of ``size``; with ``more`` half as long again, and four tokens."""
    n = _need(size, threshold)
    return F.slice(t, F.lit(1), F.greatest(n + F.shiftright(n, 1) + 4 if more else n, F.lit(0)))


def _first_lines(texts: DataFrame, k: int, threshold: int) -> DataFrame:
    """Classes of lines with equal token sets: key (doc_id, tie, line_no) of the first,
    size, prefix, top_class (the class of counts of its last token)."""
    t = _tokens(_lines(texts), k)
    t = t.select(F.xxhash64("t").alias("s1"), F.xxhash64(F.lit(1), F.col("t")).alias("s2"), "key",
                 F.size("t").alias("size"), _prefix(F.col("t"), F.size("t"), threshold, more=True).alias("prefix"))
    same = t.groupBy("s1", "s2").agg(F.min("key").alias("key"), F.first("size").alias("size"), F.first("prefix").alias("prefix"))
    firsts = written(same.where("size > 0").select("key", "size", "prefix"), "lines", free=True)  # not the class of blank lines
    return _frequent_last(firsts, texts, k, threshold)


def _frequent(tokens: DataFrame, least: float) -> dict[int, int]:
    """The hash buckets with ``least`` tokens or more, and how many each has."""
    each = tokens.select(F.explode(tokens.columns[0]).alias("h")).groupBy(_bucket(F.col("h")).alias("b"))
    return dict(each.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).collect())


def _frequent_last(firsts: DataFrame, texts: DataFrame, k: int, threshold: int) -> DataFrame:
    """``firsts`` with their prefixes, frequent tokens behind all others."""
    size, prefix = F.col("size"), F.col("prefix")
    mean = (firsts.agg(F.sum(F.size(prefix))).first()[0] or 0) / (1 << BUCKET_BITS)
    least = mean + max(FREQUENT, DEVIATIONS * mean ** 0.5)
    seen = _frequent(firsts.select("prefix"), least)
    if not seen:
        return firsts.select("key", "size", _prefix(prefix, size, threshold).alias("prefix"), F.lit(0).alias("top_class"))

    def classes() -> bytes:
        out = bytearray(1 << BUCKET_BITS)
        for b, n in seen.items():
            out[b] = n.bit_length()
        return bytes(out)

    def rare(table: bytes) -> Column:
        return F.filter("prefix", lambda h: _class(h, table) == 0)

    def short(firsts: DataFrame, rare: Column, name: str) -> DataFrame:
        return _sets(written(firsts.where(F.size(rare) < _need(size, threshold)).select("key"), name), texts, k)
    for b, n in _frequent(short(firsts, rare(classes()), "hot").select("t"), least).items():
        seen[b] = max(n, seen.get(b, 0))
    table = classes()
    firsts = written(firsts.select("key", "size", _prefix(rare(table), size, threshold).alias("prefix")), "lines")
    ranked = F.array_sort(F.transform("t", lambda h: F.struct(_class(h, table).alias("c"), h.alias("h"))))["h"]
    again = short(firsts, prefix, "again").select("key", F.size("t").alias("size"), _prefix(ranked, F.size("t"), threshold).alias("prefix"))
    kept = firsts.where(F.size(prefix) >= _need(size, threshold)).select("*", F.lit(0).alias("top_class"))
    return kept.unionAll(written(again.select("*", _class(F.element_at("prefix", -1), table).alias("top_class")), "lines"))


def _sets(keys: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """(key, t) of the lines in ``keys`` (written, without repeats)."""
    docs = keys.groupBy("key.doc_id", "key.tie").agg(F.collect_set("key.line_no").alias("wanted"))
    wanted = docs.select(F.col("doc_id").alias("w_id"), F.col("tie").alias("w_tie"), "wanted")
    few = keys.count() <= BROADCAST_DOCS
    hit = texts.join(F.broadcast(wanted) if few else wanted, texts["doc_id"].eqNullSafe(F.col("w_id")) & (texts["tie"] == F.col("w_tie")))
    # repeated rows are the same lines: one of them is enough
    at = hit.select("doc_id", "tie", "wanted", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    lines = (at.where(F.array_contains("wanted", F.col("line_no")))
             .select(F.struct("doc_id", "tie", "line_no").alias("key"), _words(_plain(F.col("line"))).alias("words")))
    return _tokens(lines, k).dropDuplicates(["key"])


def _matching(pairs: DataFrame, texts: DataFrame, k: int, threshold: int) -> DataFrame:
    """Of the (late, early) pairs, the late ones of those whose full sets match."""
    sets = _sets(written(pairs.select(F.explode(F.array("late", "early")).alias("key")).distinct(), "ends"), texts, k)
    both = (pairs.join(sets.select(F.col("key").alias("late"), F.col("t").alias("tl")), "late")
            .join(sets.select(F.col("key").alias("early"), F.col("t").alias("te")), "early"))
    common = F.size(F.array_intersect("tl", "te"))
    return both.where(100 * common >= threshold * (F.size("tl") + F.size("te") - common)).select("late").distinct()


def kept_lines(texts: DataFrame, k: int = 5, threshold: int = 80) -> DataFrame:
    """Lines that no earlier line matches: (doc_id, tie, line_no)."""
    firsts = _first_lines(texts, k, threshold)
    # a set that is too small to match one with a token more matches equal sets only
    entries = firsts.where(f"100 * size >= {threshold} * (size + 1)").select(
        "key", "size", "top_class", F.element_at("prefix", -1).alias("top"), F.posexplode("prefix").alias("pos", "token"))
    same = Window.partitionBy("token")
    shared = entries.withColumn("n", F.count(F.lit(1)).over(same)).where("n > 1").drop("n")
    mine = written(shared.withColumn("lead", F.min(F.struct("key", "size", "pos")).over(same)), "entries", free=True)
    # length and positional filter
    star = mine.where(F.expr(f"lead.key < key and 100 * least(size, lead.size) >= {threshold} * greatest(size, lead.size) and "
                             f"{100 + threshold} * least(size - pos, lead.size - lead.pos) >= {threshold} * (size + lead.size)"))
    star = written(star.select(F.col("key").alias("late"), F.col("lead.key").alias("early")).distinct(), "star")
    gone = written(_matching(star, texts, k, threshold), "gone")
    settled = gone.select(F.col("late").alias("key"))
    left = mine.join(F.broadcast(settled) if gone.count() <= BROADCAST_DOCS else settled, "key", "left_anti")
    rest = left.alias("x").join(mine.alias("y"), F.expr(f"x.token = y.token and y.key < x.key and 100 * least(x.size, y.size) >= {threshold} * greatest(x.size, y.size)"))
    # all common tokens up to the earlier end of the two prefixes are counted; what comes after it bounds the overlap
    rest = rest.groupBy(F.col("x.key").alias("late"), F.col("y.key").alias("early")).agg(
        F.count(F.lit(1)).alias("common"), *[F.first(f"{z}.{c}").alias(f"{z}_{c}") for z in "xy" for c in ("size", "top_class", "top")])
    x_top, y_top = (F.struct(f"{z}_top_class", f"{z}_top") for z in "xy")  # as the tokens are ordered
    after = F.least(F.when(x_top <= y_top, F.col("x_size") - _need(F.col("x_size"), threshold)),
                    F.when(y_top <= x_top, F.col("y_size") - _need(F.col("y_size"), threshold)))
    rest = rest.withColumn("bound", F.col("common") + after).where(F.expr(f"{100 + threshold} * bound >= {threshold} * (x_size + y_size)"))
    rest = written(rest.select("late", "early", "bound")
                   .join(star, ["late", "early"], "left_anti"), "rest")
    if not rest.isEmpty():
        # the likeliest match of each line first, all others of those that this does not remove
        best = written(rest.groupBy("late").agg(F.max_by("early", F.struct("bound", "early")).alias("early")), "best")
        more = written(_matching(best, texts, k, threshold), "gone")
        gone = gone.unionAll(more)
        last = written(rest.join(more, "late", "left_anti").join(best, ["late", "early"], "left_anti").select("late", "early"), "last")
        if not last.isEmpty():
            gone = gone.unionAll(_matching(last, texts, k, threshold))
    gone = gone.select("late.*").distinct()
    at = firsts.select("key.*")
    same = [at[c].eqNullSafe(gone[c]) for c in ("doc_id", "tie", "line_no")]
    return at.join(gone, same, "left_anti")


def dedup_lines(docs: DataFrame, k: int = 5, threshold: int = 80) -> DataFrame:
    """One row per document: doc_id, text without the later of matching lines,
    n_lines (lines with words), n_removed, row (the other columns of ``docs`` as a struct)."""
    other = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    base = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), F.struct(*other).alias("row"))
    ids = base.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("d")).first()
    # ids that repeat are told apart by their texts
    base = base.withColumn("tie", F.lit(0).cast("bigint") if ids["n"] == ids["d"] else F.xxhash64("text"))
    kept = kept_lines(base.select("doc_id", "tie", "text"), k, threshold)
    kept = (kept.groupBy("doc_id", "tie").agg(F.sort_array(F.collect_list("line_no")).alias("kept"))
            .select(F.col("doc_id").alias("k_id"), F.col("tie").alias("k_tie"), "kept"))
    j = base.join(kept, base["doc_id"].eqNullSafe(F.col("k_id")) & (F.col("tie") == F.col("k_tie")), "left")
    # one flag for each line: runs of false between the kept ones
    steps = F.transform("kept", lambda x, i: F.concat(
        F.array_repeat(F.lit(False), x - F.when(i > 0, F.get(F.col("kept"), i - 1)).otherwise(F.lit(-1)) - 1), F.array(F.lit(True))))
    j = j.withColumn("lines", F.split("text", "\n")).withColumn("flags", F.coalesce(F.flatten(steps), F.array().cast("array<boolean>")))
    blank = lambda x: ~x.rlike(r"[^ \t\x0B\f\r]")
    j = j.withColumn("n", F.coalesce(F.size(F.filter("lines", lambda x: ~blank(x))), F.lit(0)))
    both = F.arrays_zip(F.col("lines").alias("l"), F.col("flags").alias("f"))
    j = j.withColumn("left", F.filter(both, lambda s: F.coalesce(s["f"], F.lit(False)) | blank(s["l"])))
    n, stay = F.greatest("n", F.lit(0)), F.greatest(F.coalesce(F.size("kept"), F.lit(0)), F.lit(0))  # the size of null may be -1
    return j.select("doc_id", F.when(F.col("text").isNotNull(), F.array_join(F.transform("left", lambda s: s["l"]), "\n")).alias("text"),
                    n.cast("bigint").alias("n_lines"), (n - stay).cast("bigint").alias("n_removed"), "row")
