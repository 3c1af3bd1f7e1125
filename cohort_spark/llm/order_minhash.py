"""Document fingerprints by Order MinHash; DataFrame functions only.

A text's k-mers are its runs of ``k`` words (`[^\\x20\\x09-\\x0D]+`), each numbered by how often
it occurred before in the text. Every coordinate of a fingerprint selects the
``picks`` least numbered k-mers under an order of its own, puts the selected
ones back into text order and hashes the tuple of k-mers. Two fingerprints
agree in a coordinate if both texts hold the same least k-mers, as often and in
the same order, so their likeness (the share of equal coordinates) falls with
the edit distance, where plain MinHash does not see order or repetition.

The orders. Numbered k-mers have one random place on a ring of 2^64 places, and
the order of coordinate j begins at its own point of the ring: the least ones
are those that follow the point. Each order is a random permutation, the
points are spread evenly, and one sort of a text's k-mers serves all
coordinates, whatever their number. Places are compared by their upper bits,
the lower ones hold the position in the text.

How it is spread. A text is worked on within its row, by array functions in
layers of projections; nothing is exploded, and the memory of a task is that of
its longest text. Rows that repeat doc_id and text are one row with a count, made
before the shuffle, so a group of copies of any size stays small. The next
document is found by global positions of (doc_id, hash) pairs, without texts;
then the beginning of the next text, cut to the length that is needed, is
joined to each row.

Defined cases: a null text is empty; a text without words has the
fingerprint of no k-mers, which equals that of another such text only; a text
with fewer than ``k`` words is one k-mer; texts that differ in white space only
are equal here; documents are ordered by
descending doc_id (null last), then by hash of the text; rows that repeat
doc_id and text follow each other and give a row each; extra columns are not
read; an empty table gives an empty result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranks import global_row_number
from .frames import written

#: White space between words.
SPACE = " \t\n\x0b\f\r"
KMER = 2
PICKS = 2
COORDINATES = 64
#: Bits of a place that hold the position in the text.
POSITION_BITS = 24
LONG_BITS = 31


def _words(text: Column) -> Column:
    """Hash of each word."""
    words = F.split(F.btrim(text, F.lit(SPACE)), f"[{SPACE}]+")
    return F.when(text.rlike(f"[^{SPACE}]"), F.transform(words, lambda x: F.xxhash64(x))).otherwise(F.array().cast("array<bigint>"))


def _kmers(words: Column, k: int) -> Column:
    """Hash of each run of ``k`` words, by position; fewer words are one run."""
    n = F.size(words)
    runs = F.transform(F.sequence(F.lit(0), F.greatest(n - k, F.lit(0))), lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(k)]))
    return F.when(n >= k, runs).when(n > 0, F.array(F.xxhash64(words))).otherwise(F.array().cast("array<bigint>"))


def _upto(n: Column) -> Column:
    """0 .. n-1; empty for 0."""
    return F.slice(F.sequence(F.lit(0), n), F.lit(1), n)


def fingerprints(df: DataFrame, texts: dict[str, str], k: int = KMER, picks: int = PICKS, coordinates: int = COORDINATES) -> DataFrame:
    """``df`` with a column for each of ``texts`` (name of a column without
    nulls -> name of its fingerprint): ``coordinates`` numbers of 32 bits."""
    own, names = [F.col(f"`{c}`") for c in df.columns], list(texts.values())
    low = F.when(F.col("wide_"), F.lit((1 << LONG_BITS) - 1)).otherwise(F.lit((1 << POSITION_BITS) - 1)).cast("bigint")

    def layer(d: DataFrame, keep: str, **columns) -> DataFrame:
        """A projection: columns of ``df``, of the layers named in ``keep``, and new ones for each text."""
        rest = [F.col(f"{p}_{o}") for p in keep.split() for o in names]
        return d.select(*own, "low_", "high_", *rest, *[f(o).alias(f"{p}_{o}") for p, f in columns.items() for o in names])

    def each(prefix):
        return lambda o: F.col(f"{prefix}_{o}")
    w, h, s, b, c, y, v, at = (each(p) for p in "w h s b c y v at".split())
    of = {o: t for t, o in texts.items()}
    longest = F.greatest(*[F.length(t) for t in texts], F.lit(0))
    d = df.withColumn("wide_", longest >= (1 << POSITION_BITS) - 1)
    d = d.withColumn("low_", low).withColumn("high_", F.bitwise_not(low))
    d = layer(d, "", w=lambda o: _words(F.col(of[o])))
    d = layer(d, "", h=lambda o: _kmers(w(o), k))
    # equal k-mers next to each other, in text order
    place = lambda x, p: x.bitwiseAND(F.col("high_")).bitwiseOR(p.cast("bigint"))
    position = lambda x: x.bitwiseAND(F.col("low_")).cast("int")
    d = layer(d, "h", s=lambda o: F.sort_array(F.transform(h(o), place)))
    d = layer(d, "h s", b=lambda o: F.filter(_upto(F.size(s(o))), lambda i: (i == 0) | (
        F.get(s(o), i).bitwiseXOR(F.get(s(o), i - 1)).bitwiseAND(F.col("high_")) != 0)))
    # occurrence numbers, beside s
    d = layer(d, "h s", c=lambda o: F.flatten(F.transform(b(o), lambda first, i: F.sequence(
        F.lit(0), F.coalesce(F.get(b(o), i + 1), F.size(s(o))) - first - 1))))
    step = (1 << 64) // coordinates
    points = [((j * step - (1 << 63)) >> LONG_BITS) << LONG_BITS for j in range(coordinates)]
    points = F.array(*[F.lit(p) for p in points])
    d = layer(d, "h", y=lambda o: F.sort_array(F.concat(
        # not by index: a column that a lambda alone refers to would be made anew for each element
        F.zip_with(s(o), c(o), lambda x, seen: place(F.xxhash64(F.get(h(o), position(x)), seen), position(x))),
        F.transform(points, lambda p: p.bitwiseOR(F.col("low_"))))))
    is_point = lambda x: x.bitwiseAND(F.col("low_")) == F.col("low_")
    d = layer(d, "h", v=lambda o: F.filter(y(o), lambda x: ~is_point(x)),
              at=lambda o: F.filter(F.transform(y(o), lambda x, i: F.when(is_point(x), i)), lambda i: i.isNotNull()))

    def coordinate(o):
        n = F.size(v(o))
        turn = F.sequence(F.lit(0), F.least(n, F.lit(picks)) - 1)
        chosen = lambda i: F.sort_array(F.transform(turn, lambda t: position(F.get(v(o), (i + t) % n))))
        tuples = F.transform(at(o), lambda a, j: F.xxhash64(F.transform(chosen(a - j), lambda p: F.get(h(o), p))))
        none = F.array_repeat(F.xxhash64(F.lit("")), coordinates)
        return F.transform(F.when(n > 0, tuples).otherwise(none), lambda x: F.shiftright(x, 32).cast("int"))
    return d.select(*own, *[coordinate(o).alias(o) for o in names])


def written_out(fingerprint: Column) -> Column:
    """A fingerprint as a string of 8 hexadecimal digits a coordinate."""
    digits = lambda x: F.lpad(F.hex(x.cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")
    return F.lower(F.array_join(F.transform(fingerprint, digits), ""))


def likeness(x: Column, y: Column) -> Column:
    """Share of equal coordinates of two fingerprints."""
    return F.size(F.filter(F.zip_with(x, y, lambda a, b: a == b), lambda same: same)) / F.size(x)


def _expanded(rows: DataFrame, piece: int = 1000) -> DataFrame:
    """Each row as often as its column ``times`` says; many copies are made by many tasks."""
    few = rows.where(F.col("times") <= piece)
    many = rows.where(F.col("times") > piece).withColumn("from_", F.explode(F.sequence(F.lit(0), F.col("times") - 1, F.lit(piece))))
    many = many.repartition("key", "hash", "from_").withColumn("times", F.least(F.lit(piece), F.col("times") - F.col("from_"))).drop("from_")
    return few.unionAll(many).withColumn("times", F.explode(F.array_repeat(F.lit(0), F.col("times").cast("int")))).drop("times")


def compare_next(docs: DataFrame, k: int = KMER, picks: int = PICKS, coordinates: int = COORDINATES) -> DataFrame:
    """For each document: doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next, next_doc_id. The edited text has
    its last half (rounded down) replaced by as much of the beginning of the
    next document, in descending order of doc_id (after the last: the first)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"))
    # keys without nulls, so that all joins are on the same partitioning
    base = base.select("doc_id", "text", F.coalesce("doc_id", F.lit(0)).alias("key"), F.xxhash64("text", F.col("doc_id").isNull()).alias("hash"))
    whole = base.groupBy("key", "hash").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"))
    whole = whole.where("copies > 0")  # both uses need all its columns, so that its texts are shuffled once
    keys = base.groupBy("key", "hash").agg(F.first("doc_id").alias("doc_id"), F.max(F.length("text")).alias("n"))
    placed = global_row_number(keys, [F.col("doc_id").desc_nulls_last(), F.col("hash").asc()], "at")
    total = max(1, placed.count())
    before = placed.select(F.col("key").alias("p_key"), F.col("hash").alias("p_hash"), F.expr("n div 2").alias("need"), (F.col("at") % total + 1).alias("at"))
    links = placed.select("key", "hash", "at").join(before, "at").drop("at")
    heads = whole.select("key", "hash", "text", "doc_id").join(links, ["key", "hash"]).select(
        F.col("p_key").alias("key"), F.col("p_hash").alias("hash"), F.expr("left(text, cast(need as int))").alias("head"),
        F.col("doc_id").alias("next_doc_id"), F.col("key").alias("next_key"), F.col("hash").alias("next_hash"))
    rows = whole.join(heads, ["key", "hash"]).withColumn("n_chars", F.length("text").cast("bigint"))
    # of equal rows all but the last are followed by an equal one
    after = F.struct("head", "next_doc_id", "next_key", "next_hash", F.lit(1).cast("bigint").alias("times"), F.lit(True).alias("last"))
    again = F.struct(F.expr("left(text, cast(n_chars div 2 as int))").alias("head"), F.col("doc_id").alias("next_doc_id"),
                     F.col("key").alias("next_key"), F.col("hash").alias("next_hash"), (F.col("copies") - 1).alias("times"), F.lit(False).alias("last"))
    rows = rows.select("key", "hash", "doc_id", "text", "n_chars", F.explode(F.when(F.col("copies") > 1, F.array(after, again)).otherwise(F.array(after))).alias("a"))
    rows = rows.select("key", "hash", "doc_id", "text", "n_chars", F.concat(F.expr("left(text, cast(n_chars - n_chars div 2 as int))"), "a.head").alias("edited"),
                       "a.next_doc_id", "a.next_key", "a.next_hash", "a.times", "a.last")
    rows = fingerprints(rows, {"text": "fp", "edited": "edited_fp"}, k, picks, coordinates)
    rows = written(rows.select("key", "hash", "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fp", "edited_fp",
                               "next_doc_id", "next_key", "next_hash", "times", "last"), "order")
    follows = rows.where("last").select(F.col("key").alias("next_key"), F.col("hash").alias("next_hash"), F.col("fp").alias("next_fp"))
    out = _expanded(rows.where("last").join(follows, ["next_key", "next_hash"])
                    .unionByName(rows.where("not last").withColumn("next_fp", F.col("fp"))))
    return out.select("doc_id", "n_chars", "edited_sha256", written_out(F.col("fp")).alias("fingerprint"), written_out(F.col("edited_fp")).alias("edited_fingerprint"),
                      likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"), "next_doc_id")
