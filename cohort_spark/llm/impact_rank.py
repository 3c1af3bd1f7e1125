"""Ranked lexical search by sequential reads of impact-sorted lists (NRA).

Terms are the maximal runs of ASCII letters, digits and characters beyond ASCII,
A-Z in lower case. A posting's impact is its whole contribution to a score,
``w * ((10^9 * tf) div (1000 * tf + 12 * m))`` with integer weights ``w`` of the
term and ``m`` of the document, so scores are exact integers and lists can be
sorted by impact.

The method. For each item the lists of its terms are read from the highest
impact down, all to the same depth, without looking up any document. A document
read in some lists has a lower bound, the sum of what was read, and an upper
one, which adds the last impact read of every list that has not shown it (an
exhausted list adds nothing). Reading goes on until no document that was not
seen, and none whose interval is still open, can reach the score of the last
place: equal to it counts as reaching, as ties go by doc_id. Then membership,
order and scores are final. Once no unseen document can enter, only the
documents that still can are followed.

How it is spread. Documents are sharded: the best ``k`` of all are among the best
``k`` of each shard, and a shard's lists are bounded by its size, so the list of
a word that a third of all documents hold is never in one place. One pass over
the texts writes, for each document, its number of terms and the counts of
those that occur in items; statistics (number of documents, of terms, of
documents a term) are aggregated from it, and a second pass ranks. A task works
through its shards one after another, and each begins from the last place of
those before, so most stop after a few reads; it hands on ``k`` rows an item.
Items are taken in blocks of bounded size (``ITEMS`` rows, ``CHARS``
characters), whose terms and weights go to every task.

A term is found by a 64-bit hash and confirmed by its length and its first and
last 8 bytes.

Defined cases: null and empty texts have no terms; an item without terms, or
whose terms no document holds, gives no row; items that repeat item_id and text
give their rows each; rows of documents that repeat are documents each; equal
scores go by ascending doc_id, null last; extra columns are not read; empty
tables give an empty result."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrays import chunks, text_buffers, word_hashes
from .frames import map_arrow, ship, written

ITEMS = 4096
CHARS = 1 << 22
#: Postings and documents of a shard, and entries read of each list at first.
POSTINGS = 1 << 21
DOCS = 10_000
DEPTH = 256

# bytes of terms in lower case, all others as a space
_TERM = np.full(256, 0x20, np.uint8)
for _a, _b in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B), (0x80, 0x100)):
    _TERM[_a:_b] = np.arange(_a, _b)
_TERM[0x41:0x5B] += 0x20


def terms(column) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, hash, start, end) of all terms of a text column, and the first term of each text."""
    raw, offsets = text_buffers(column)
    raw = _TERM[raw]
    return raw, *word_hashes(raw, offsets)


def _ends(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last 8 bytes of terms as numbers; of shorter terms all bytes."""
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(raw) + 1,), "<u8", padded, strides=(1,))
    size = np.minimum(ends - starts, 8).astype(np.uint64)
    mask = np.where(size == 8, ~np.uint64(0), (np.uint64(1) << (size * np.uint64(8)) % np.uint64(64)) - np.uint64(1))
    return eight[starts] & mask, eight[np.maximum(ends - 8, starts)] & mask


class Items:
    """Terms of a block of items: sorted hashes, and each item's terms with their repeats."""

    def __init__(self, texts: pa.Array):
        raw, h, s, e, first = terms(texts)
        self.hashes, at, number = np.unique(h, return_index=True, return_inverse=True)
        self.size = (e - s)[at]
        self.head, self.tail = _ends(raw, s[at], e[at])
        self.of = [np.unique(number[a:b], return_counts=True) for a, b in zip(first[:-1], first[1:])]

    def find(self, raw, h, s, e) -> tuple[np.ndarray, np.ndarray]:
        """Of terms, the places of those that occur in items, and their numbers."""
        if not len(self.hashes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        n = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        hit = np.flatnonzero((self.hashes[n] == h) & (self.size[n] == e - s))
        n = n[hit]
        head, tail = _ends(raw, s[hit], e[hit])
        same = (self.head[n] == head) & (self.tail[n] == tail)
        return hit[same], n[same]


def _counted(docs: DataFrame, items: Items) -> DataFrame:
    """(doc_id, n, terms, tfs): all terms of a document counted, and those of items with their counts."""
    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        offsets = text_buffers(batch["text"])[1]
        for a, b in chunks(offsets):
            raw, h, s, e, first = terms(batch["text"].slice(a, b - a))
            hit, number = items.find(raw, h, s, e)
            doc = np.searchsorted(first, hit, side="right") - 1
            key, tf = np.unique(doc * max(1, len(items.hashes)) + number, return_counts=True)
            doc, number = np.divmod(key, max(1, len(items.hashes)))
            off = pa.array(np.searchsorted(doc, np.arange(b - a + 1)).astype(np.int32))
            yield pa.record_batch([batch["doc_id"].slice(a, b - a), pa.array(np.diff(first).astype(np.int64)),
                                   pa.ListArray.from_arrays(off, pa.array(number.astype(np.int32))),
                                   pa.ListArray.from_arrays(off, pa.array(tf.astype(np.int64)))], names=["doc_id", "n", "terms", "tfs"])
    return map_arrow(docs, run, "doc_id bigint, n bigint, terms array<int>, tfs array<bigint>")


class Shard:
    """Impact-sorted lists of some documents."""

    def __init__(self, n: np.ndarray, off: np.ndarray, number: np.ndarray, tf: np.ndarray, weight: np.ndarray, documents: int, length: int):
        m = 75 + (25 * n * documents) // max(1, length)
        doc = np.repeat(np.arange(len(n)), np.diff(off))
        impact = weight[number] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[doc]))
        order = np.lexsort((doc, -impact, number))
        self.doc, self.impact, self.docs = doc[order], impact[order], len(n)
        self.begin = np.searchsorted(number[order], np.arange(len(weight) + 1))

    def search(self, lists: np.ndarray, repeats: np.ndarray, known: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents that may be among the best ``k`` beside the ``known`` scores (of other documents), with their scores."""
        begin, end = self.begin[lists], self.begin[lists + 1]
        some = (end > begin)
        some[some] &= self.impact[begin[some]] > 0
        begin, end, repeats = begin[some], end[some], repeats[some]
        lower, seen = np.zeros(self.docs, np.int64), np.zeros((self.docs, len(begin)), bool)
        head = self.impact[begin] * repeats
        known = np.sort(known)[::-1][:k]
        alive = np.zeros(0, np.int64)  # documents seen that can still enter
        closed, depth, step = False, 0, DEPTH
        while True:
            last = max(1, known[k - 1] if len(known) == k else 1)
            if len(alive):
                both = np.concatenate([known, lower[alive]])
                if len(both) >= k:
                    last = max(last, int(np.partition(both, len(both) - k)[len(both) - k]))
                upper = lower[alive] + head.sum() - seen[alive] @ head
                alive = alive[upper >= last]
            closed = closed or head.sum() < last
            # every interval that can reach the last place is a point
            if closed and (not len(alive) or not ((~seen[alive]) & (head > 0)).any()):
                return alive, lower[alive]
            # the next reads, all lists to the same depth
            a, b = np.minimum(begin + depth, end), np.minimum(begin + depth + step, end)
            size = b - a
            of = np.repeat(np.arange(len(a)), size)
            at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + a[of]
            doc, impact = self.doc[at], self.impact[at] * repeats[of]
            if closed:
                follow = np.zeros(self.docs, bool)
                follow[alive] = True
                mine = follow[doc]
                doc, impact, of = doc[mine], impact[mine], of[mine]
            np.add.at(lower, doc, impact)
            seen[doc, of] = True
            if not closed:
                alive = np.flatnonzero(lower > 0)
            read = b > a
            head[read] = self.impact[b[read] - 1] * repeats[read]
            head[b == end] = 0
            depth, step = depth + step, step * 4


def _ranked(index: DataFrame, items: Items, weight: np.ndarray, documents: int, length: int, k: int) -> DataFrame:
    """(item, doc_id, score): of each task the best ``k`` documents of each item."""
    last, widest = np.iinfo(np.int64).max, max((len(lists) for lists, _ in items.of), default=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [(np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)) for _ in items.of]
        for batch in batches:
            for part in _shards(batch, widest):
                off = part["terms"].offsets.to_numpy().astype(np.int64)
                shard = Shard(part["n"].to_numpy(), off - off[0], part["terms"].flatten().to_numpy().astype(np.int64), part["tfs"].flatten().to_numpy(), weight, documents, length)
                ids, none = part["doc_id"].fill_null(last).to_numpy(), part["doc_id"].is_null().to_numpy(zero_copy_only=False)
                for i, (lists, repeats) in enumerate(items.of):
                    at, score = shard.search(lists, repeats, best[i][2], k)
                    if len(at):
                        d, z, s = (np.concatenate(x) for x in zip(best[i], (ids[at], none[at], score)))
                        order = np.lexsort((d, z, -s))[:k]
                        best[i] = d[order], z[order], s[order]
        rows = [len(b[0]) for b in best]
        if sum(rows):
            d, z, s = (np.concatenate([b[c] for b in best]) for c in range(3))
            yield pa.record_batch([pa.array(np.repeat(np.arange(len(best)), rows)), pa.array(d, pa.int64(), mask=z.astype(bool)), pa.array(s, pa.int64())], names=["item", "doc_id", "score"])
    ship(index.sparkSession)
    return index.mapInArrow(run, "item bigint, doc_id bigint, score bigint")


def _shards(batch: pa.RecordBatch, widest: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with at most about ``POSTINGS`` postings and ``DOCS`` documents, fewer for items of very many terms."""
    docs = max(1, min(DOCS, (1 << 23) // max(1, widest)))
    off = batch["terms"].offsets.to_numpy()
    a = 0
    while a < batch.num_rows:
        b = min(max(a + 1, int(np.searchsorted(off, off[a] + POSTINGS, side="right")) - 1), a + docs, batch.num_rows)
        yield batch.slice(a, b - a)
        a = b


def rank(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """The ``k`` best documents (doc_id, text) of each item (item_id, text):
    item_id, rank, doc_id, score. Scores are above 0."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    asked = items.select(F.col("item_id").cast("bigint").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    asked = asked.groupBy("item_id", "text").agg(F.count(F.lit(1)).alias("copies"))
    size = asked.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars")).first()
    blocks = max(1, -(-size["n"] // ITEMS), -(-size["chars"] // CHARS))
    out = [_block(docs, asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b), k) for b in range(blocks)]
    return reduce(DataFrame.unionAll, out)


def _block(docs: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """Ranks for a block of items, whose size is bounded."""
    block = asked.orderBy("item_id", "text").toArrow()
    items = Items(block["text"])
    index = written(_counted(docs, items), "postings")
    total = index.agg(F.count_if(F.col("n") > 0).alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("length")).first()
    df = np.zeros(len(items.hashes), np.int64)
    for r in index.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n")).collect():  # terms of the block
        df[r["t"]] = r["n"]
    weight = np.floor(1000 * np.log((2 * total["documents"] + 2) / (2 * df + 1))).astype(np.int64)
    found = _ranked(index, items, weight, total["documents"], total["length"], k)
    w = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    found = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    # one row for each item of the block
    names = found.sparkSession.createDataFrame([(i, r["item_id"], r["copies"]) for i, r in enumerate(block.select(["item_id", "copies"]).to_pylist())],
                                               "item bigint, item_id bigint, copies bigint")
    found = found.join(F.broadcast(names), "item").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return found.select("item_id", "rank", "doc_id", "score")
