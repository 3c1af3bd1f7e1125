"""Near-duplicate documents by circulant MinHash.

Two permutations make the whole signature: a first one scatters the shingles
over the 2^32 positions of a circle, the second one gives every position its
rank, and coordinate ``k`` is the least rank after the second permutation has
been shifted by ``k`` positions around the circle. Signatures are cut into
bands; documents that agree on a band are candidates, and a candidate pair is
a link only if its full shingle sets satisfy
``100 * |A & B| >= threshold * |A | B|``. Links are joined into components.

Skew. Documents with equal sets are one class from the start (grouped on a
128-bit hash of the set), so exact copies never meet each other. Within a
band bucket, classes are first compared with two leaders only (the smallest
class and the one that shares the most bucket members). Classes of buckets
that these leave in different components are then joined on the rarest
shingles of their sets (the prefix that two sets of this similarity must
share, at positions that leave room for the overlap they need), and the pairs found across components are confirmed too. So no link
between components of a bucket is missed; a bucket whose members are all
alike costs as many pairs as it has members, not their square, and texts that
only share a common passage do not meet, because its shingles are frequent.

Defined cases: a null or wordless text has the empty set, is linked with
nothing and is its own component; a text with fewer words than a shingle has
its whole sequence as one shingle; repeated rows and repeated ids are one
class and get the same component; a null id never names a component unless
all its members have none (then the component is null). Of each component one
(doc_id, text) is kept: the least id that is not null and, of several texts under
it, the one with the least hash. Rows that repeat both are kept alike.
Extra columns of the input are ignored. An empty table gives an empty result."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays as A
from .frames import components, map_arrow, written

#: A pair of similarity .8 meets in at least one of 32 bands of 4 with
#: probability 1 - (1 - .8^4)^32 = 1 - 5e-8.
BANDS, ROWS = 32, 4

_U32 = np.uint32


def _rank(x: np.ndarray) -> np.ndarray:
    """Second permutation: a fixed bijection of the 2^32 positions."""
    x = x ^ (x >> _U32(16))
    x *= _U32(0x85EBCA6B)
    x ^= x >> _U32(13)
    x *= _U32(0xC2B2AE35)
    x ^= x >> _U32(16)
    return x


def signatures(shingles: np.ndarray, first: np.ndarray, size: int) -> np.ndarray:
    """Circulant MinHash of each non-empty set: (sets, size) of 32-bit ranks.

    ``shingles`` holds the sets one after the other, ``first`` their starts
    (n + 1 entries, every set non-empty)."""
    out = np.empty((len(first) - 1, size), np.uint32)
    # first permutation: the position of a shingle on the circle
    place = (A.mix(shingles * A.U64(0xFF51AFD7ED558CCD) + A.U64(7)) >> A.U64(32)).astype(np.uint32)
    step = 1 << 16
    sets = len(first) - 1
    i = 0
    while i < sets:  # pieces that stay in the cache
        j = max(i + 1, int(np.searchsorted(first, first[i] + step, side="right")) - 1)
        own, at = place[first[i]: first[j]], first[i:j] - first[i]
        for k in range(size):
            out[i:j, k] = np.minimum.reduceat(_rank(own - _U32(k)), at)
        i = j
    return out


def _sets(batch: pa.RecordBatch, shingle: int):
    """Per chunk of rows: first row, number of rows, shingles, starts."""
    raw, offsets = A.text_buffers(batch.column("text"))
    for i, j in A.chunks(offsets):
        o = offsets[i: j + 1]
        h, _, _, first = A.word_hashes(raw[o[0]: o[-1]], o - o[0], lower=True)
        s, at = A.shingles(h, first, shingle)
        yield i, j, s, at


_SIGNED = "doc_id bigint, text_hash bigint, n_shingles bigint, node binary, bands array<bigint>"


def sign(docs: DataFrame, shingle: int = 2, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per document: set size, 128-bit hash of the set (empty for none), band hashes."""
    def run(batch):
        ids = batch.column("doc_id")
        for i, j, s, at in _sets(batch, shingle):
            n = np.diff(at)
            full = np.flatnonzero(n)
            sig = signatures(s, np.append(at[:-1][full], len(s)), bands * rows) if len(full) else np.zeros((0, bands * rows), np.uint32)
            key = sig.reshape(len(full), bands, rows).astype(np.uint64)
            acc = np.zeros((len(full), bands), np.uint64) + np.arange(bands, dtype=np.uint64)
            for r in range(rows):
                acc = A.mix(acc * A.U64(0x9FB21C651E98DF25) + key[:, :, r])
            name = np.zeros((len(n), 2), np.uint64)
            if len(full):
                # sums over the mixed members of a set identify it: 128 bits
                name[full, 0] = np.add.reduceat(A.mix(s + A.U64(3)), at[:-1][full])
                name[full, 1] = np.add.reduceat(A.mix(s ^ A.U64(0x5851F42D4C957F2D)), at[:-1][full])
            size = np.zeros(len(n) + 1, np.int32)
            size[1:] = np.cumsum(np.where(n > 0, 16, 0))
            node = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(size.tobytes()), pa.py_buffer(name[full].tobytes())])
            lens = np.zeros(len(n) + 1, np.int64)
            lens[1:] = np.cumsum(np.where(n > 0, bands, 0))
            yield pa.record_batch([
                ids.slice(i, j - i), batch.column("text_hash").slice(i, j - i), pa.array(n.astype(np.int64)), node,
                pa.ListArray.from_arrays(pa.array(lens.astype(np.int32)), pa.array(A.signed(acc.ravel()))),
            ], names=["doc_id", "text_hash", "n_shingles", "node", "bands"])
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_arrow(texts.withColumn("text_hash", F.xxhash64("text")), run, _SIGNED)


def _full_sets(docs: DataFrame, shingle: int) -> DataFrame:
    """(node, members): the sorted shingle hashes of each document, 8 bytes each."""
    def run(batch):
        ids = batch.column("node")
        for i, j, s, at in _sets(batch, shingle):
            data = s.astype("<u8").tobytes()
            off = (at * 8).astype(np.int32)
            yield pa.record_batch([ids.slice(i, j - i), pa.Array.from_buffers(
                pa.binary(), j - i, [None, pa.py_buffer(off.tobytes()), pa.py_buffer(data)])], names=["node", "members"])
    return map_arrow(docs.select("node", "text"), run, "node binary, members binary")


def _confirm(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Pairs whose full sets reach the threshold: (a, b)."""
    both = (pairs.join(sets.select(F.col("node").alias("a"), F.col("members").alias("ma")), "a")
            .join(sets.select(F.col("node").alias("b"), F.col("members").alias("mb")), "b"))

    def run(batch):
        keep = np.zeros(batch.num_rows, bool)
        ma, mb = batch.column("ma"), batch.column("mb")
        for r in range(batch.num_rows):
            x = np.frombuffer(ma[r].as_buffer(), "<u8")
            y = np.frombuffer(mb[r].as_buffer(), "<u8")
            low, high = (x, y) if len(x) <= len(y) else (y, x)
            if 100 * len(low) < threshold * len(high):
                continue
            at = np.searchsorted(high, low)
            at[at == len(high)] = 0
            common = int((high[at] == low).sum())
            keep[r] = 100 * common >= threshold * (len(x) + len(y) - common)
        out = batch.filter(pa.array(keep))
        if out.num_rows:
            yield pa.record_batch([out.column("a"), out.column("b")], names=["a", "b"])
    return map_arrow(both.select("a", "b", "ma", "mb"), run, "a binary, b binary")


#: Shingle counts are kept for so many hash buckets: what is sent to the tasks has this size whatever the input.
BUCKETS = 1 << 18


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> A.U64(64 - 18)).astype(np.int64)


def _frequencies(sets: DataFrame) -> np.ndarray:
    """How many set members fall in each hash bucket, over all ``sets``."""
    def run(batch):
        n = np.zeros(BUCKETS, np.int64)
        members = [np.frombuffer(m.as_buffer(), "<u8") for m in batch.column("members")]
        n += np.bincount(_bucket(np.concatenate(members)), minlength=BUCKETS)
        at = np.flatnonzero(n)
        yield pa.record_batch([pa.array(at), pa.array(n[at])], names=["bucket", "n"])
    out = np.zeros(BUCKETS, np.int64)
    got = map_arrow(sets.select("members"), run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out[got["bucket"].to_numpy()] = got["n"].to_numpy()
    return out


def _prefixes(sets: DataFrame, threshold: int) -> DataFrame:
    """(node, size, c, token, room): the rarest members of each set, as many as
    a set of this similarity must share one of; room: members from there on."""
    counts = _frequencies(sets)

    def run(batch):
        tokens, n = [], np.zeros(batch.num_rows, np.int64)
        for r, m in enumerate(batch.column("members")):
            h = np.frombuffer(m.as_buffer(), "<u8")
            n[r] = len(h) - -(-threshold * len(h) // 100) + 1
            tokens.append(h[np.lexsort((h, counts[_bucket(h)]))[: n[r]]])
        rows = pa.array(np.repeat(np.arange(batch.num_rows), n))
        room = np.repeat(np.cumsum(n) - n + batch.column("size").to_numpy(), n) - np.arange(n.sum())
        yield pa.record_batch([*(batch.column(c).take(rows) for c in ("node", "size", "c")), pa.array(A.signed(np.concatenate(tokens))), pa.array(room)],
                              names=["node", "size", "c", "token", "room"])
    return map_arrow(sets.select("node", "size", "c", "members"), run, "node binary, size bigint, c binary, token bigint, room bigint")


def near_duplicates(docs: DataFrame, shingle: int = 2, threshold: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept, text_hash
    (xxhash64 of the text, which tells rows of one id apart)."""
    signed = written(sign(docs, shingle, bands, rows), "minhash")
    # classes of equal sets, named by the hash of the set
    classes = written(signed.where("n_shingles > 0").groupBy("node")
                      .agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("first"), F.first("bands").alias("bands"), F.first("n_shingles").alias("size")), "classes")
    slots = classes.select("node", "size", F.explode("bands").alias("band"))
    shared = slots.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    slots = written(slots.join(shared, "band").select("band", "n", "node", "size"), "slots")
    # the class that shares the most bucket members is the most central one
    weight = slots.groupBy("node").agg(F.sum("n").alias("w"))
    slots = written(slots.join(weight, "node").select("band", "node", "size", "w"), "slots")
    near = F.expr(f"100 * least(x_size, y_size) >= {int(threshold)} * greatest(x_size, y_size)")

    def pair(x, y):
        return F.least(x, y).alias("a"), F.greatest(x, y).alias("b")

    lead = slots.groupBy("band").agg(
        F.min(F.struct("node", "size")).alias("p"), F.max(F.struct("w", "node", "size")).alias("q"))
    star = (slots.withColumnRenamed("size", "x_size").join(lead, "band")
            .select("node", "x_size", F.explode(F.array(
                F.struct(F.col("p.node").alias("o"), F.col("p.size").alias("y_size")),
                F.struct(F.col("q.node").alias("o"), F.col("q.size").alias("y_size")))).alias("l"))
            .select("node", "x_size", "l.o", "l.y_size").where(F.col("node") != F.col("o")).where(near)
            .select(*pair("node", "o")).distinct())
    star = written(star, "star")
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("text_hash", F.xxhash64("text"))

    def ends(pairs):
        return pairs.select(F.col("a").alias("node")).unionAll(pairs.select(F.col("b").alias("node"))).distinct()

    def sets_of(wanted):
        """Full sets of the classes ``wanted``, from one document of each."""
        ids = wanted.join(classes.select("node", F.col("first.doc_id").alias("first_id"), F.col("first.text_hash").alias("first_hash")), "node")
        # other texts under the same id, or without one, are not the class's
        rows_ = texts.join(ids, texts["doc_id"].eqNullSafe(ids["first_id"]) & (texts["text_hash"] == ids["first_hash"])).select("node", "text")
        # rows that repeat id and text have the same set
        return _full_sets(rows_, shingle).groupBy("node").agg(F.first("members").alias("members"))

    links = written(_confirm(star, sets_of(ends(star)), threshold), "links")
    label = written(components(links), "labels")
    # buckets whose classes are still in different components: compare across them
    named = slots.join(label, "node", "left").select("band", "node", "size", F.coalesce("component", "node").alias("c"))
    open_ = named.groupBy("band").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("band")
    left = written(named.join(open_, "band").select("node", "size", "c").distinct(), "open")
    rest = None
    if not left.isEmpty():
        open_sets = written(sets_of(left.select("node")).join(left, "node"), "sets")
        tokens = written(_prefixes(open_sets, threshold), "tokens")
        mixed = tokens.groupBy("token").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("token")
        tokens = written(tokens.join(mixed, "token"), "mixed")
        x = tokens.select("token", F.col("node").alias("x"), F.col("size").alias("x_size"), F.col("room").alias("x_room"), F.col("c").alias("cx"))
        y = tokens.select("token", F.col("node").alias("y"), F.col("size").alias("y_size"), F.col("room").alias("y_room"), F.col("c").alias("cy"))
        room = F.expr(f"{100 + int(threshold)} * least(x_room, y_room) >= {int(threshold)} * (x_size + y_size)")
        rest = (x.join(y, (x["token"] == y["token"]) & (x["cx"] < y["cy"]) & near & room)
                .select(*pair("x", "y")).distinct().join(star, ["a", "b"], "left_anti"))
        rest = written(rest, "rest")
    if rest is not None and not rest.isEmpty():
        more = _confirm(rest, open_sets.select("node", "members"), threshold)
        links = written(links.unionAll(more), "links")
        label = written(components(links), "labels")
    named = classes.join(label, "node", "left").select("node", "first", F.coalesce("component", "node").alias("c"))
    least = named.groupBy("c").agg(F.min("first").alias("least"))
    of = named.join(least, "c").select("node", F.col("least.doc_id").alias("component_id"), F.col("least.text_hash").alias("kept_hash"))
    s = signed.select("doc_id", "text_hash", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("node")).alias("node"))
    out = s.join(of, "node", "left")
    cid = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    kept = F.col("doc_id").eqNullSafe(cid)
    stays = kept & (F.col("node").isNull() | (F.col("text_hash") == F.col("kept_hash")))
    return out.select("doc_id", "n_shingles", cid.alias("component_id"), kept.alias("kept"), stays.alias("stays"), "text_hash")
