"""Benchmark decontamination by greedy string tiling.

A document and a benchmark item are compared if they share a seed, a run of
``min_match`` words, found by running Karp-Rabin hashes over both. For such a
pair the longest matches of words that are still unmarked are marked first,
again and again, until none of ``min_match`` words is left; the marked tiles
never overlap, and their order in the document does not matter, so reordered
passages are covered too. The item is contaminated by the document if the
tiles cover at least ``coverage`` of its words.

While the benchmark has at most ``broadcast_words`` words (checked before the
plan is made), its seeds are sent to the tasks, which tile each document where
they read it: no shuffle at all. A larger benchmark is joined by seed: seeds of
documents that a bit map of fixed size does not rule out are shuffled, pairs
made distinct, and each pair tiled with its two texts.

Words are ``[^\\x20\\x09-\\x0D]+``, A-Z in lower case. Defined cases: null and
empty texts share nothing; items of fewer than ``min_match`` words are too
short to tell and are never reported; repeated rows of either table are
reported each; null ids are reported as null; extra columns are ignored; an
empty table on either side gives an empty result."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays as A
from .frames import map_arrow, written

#: Benchmark words up to which its seeds are sent to every task (about 30 bytes each).
BROADCAST_WORDS = 1 << 20
MAP_BITS = 1 << 24

_TILE = pa.struct([("item_pos", pa.int64()), ("doc_pos", pa.int64()), ("length", pa.int64())])
_OUT = "doc_id bigint, item_id bigint, n_item_words bigint, n_covered bigint, coverage double, tiles array<struct<item_pos:bigint,doc_pos:bigint,length:bigint>>, text_hash bigint"


def tile(n_item: int, n_doc: int, i: np.ndarray, j: np.ndarray, m: int) -> list[tuple[int, int, int]]:
    """Greedy tiling from seeds: item words i..i+m-1 equal document words j..j+m-1.

    Seeds next to each other on a diagonal make a longer match. Of the longest
    matches left, those are marked first that begin first in the item, then in
    the document."""
    order = np.lexsort((i, j - i))
    i, j = i[order], j[order]
    free_item, free_doc = np.ones(n_item, bool), np.ones(n_doc, bool)
    tiles = []
    while len(i):
        new = np.ones(len(i), bool)
        new[1:] = (j[1:] - i[1:] != j[:-1] - i[:-1]) | (i[1:] != i[:-1] + 1)
        at = np.flatnonzero(new)
        length = np.diff(np.append(at, len(i))) + m - 1
        best = length.max()
        top = at[length == best]
        for k in top[np.lexsort((j[top], i[top]))].tolist():
            a, b = int(i[k]), int(j[k])
            if free_item[a: a + best].all() and free_doc[b: b + best].all():
                free_item[a: a + best] = False
                free_doc[b: b + best] = False
                tiles.append((a, b, int(best)))
        # seeds whose words are all free still count
        used = np.concatenate([[0], np.cumsum(~free_item)]), np.concatenate([[0], np.cumsum(~free_doc)])
        keep = (used[0][i + m] == used[0][i]) & (used[1][j + m] == used[1][j])
        i, j = i[keep], j[keep]
    return tiles


def _words(column) -> tuple[np.ndarray, np.ndarray]:
    raw, offsets = A.text_buffers(column)
    h, _, _, first = A.word_hashes(raw, offsets, lower=True)
    return h, first


def _seeds(h: np.ndarray, first: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text and first word of every run of m words inside one text."""
    if len(h) < m:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.arange(len(h) - m + 1)
    text = A.segment_of(first)
    at = at[text[at] == text[at + m - 1]]
    return A.Runs(h).of(at, at + m), text[at], at


class _Benchmark:
    """Seeds of all items in order of their hashes, with a bit map in front."""

    def __init__(self, ids: list, column, m: int):
        self.ids, self.m = ids, m
        self.words, self.first = _words(column)
        seed, item, at = _seeds(self.words, self.first, m)
        order = np.argsort(seed, kind="stable")
        self.seed, self.item, self.at = seed[order], item[order], at[order]
        self.map = np.zeros(MAP_BITS // 8, np.uint8)
        place = self.seed & A.U64(MAP_BITS - 1)
        np.bitwise_or.at(self.map, (place >> A.U64(3)).astype(np.int64), np.uint8(1) << (place & A.U64(7)).astype(np.uint8))


def _may_hold(bit_map: np.ndarray, seed: np.ndarray) -> np.ndarray:
    place = seed & A.U64(len(bit_map) * 8 - 1)
    return ((bit_map[(place >> A.U64(3)).astype(np.int64)] >> (place & A.U64(7)).astype(np.uint8)) & 1).astype(bool)


def _report(rows: list, threshold: float) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[]] * 6
    return pa.record_batch([
        pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64()),
        pa.array([c / n for n, c in zip(cols[2], cols[3])], pa.float64()),
        pa.array([[{"item_pos": a, "doc_pos": b, "length": n} for a, b, n in t] for t in cols[4]], pa.list_(_TILE)),
        pa.array(cols[5], pa.int64()),
    ], names=["doc_id", "item_id", "n_item_words", "n_covered", "coverage", "tiles", "text_hash"])


def _judge(doc_id, text_hash, item_id, n_item: int, n_doc: int, i, j, m: int, coverage: float, out: list) -> None:
    tiles = tile(n_item, n_doc, i, j, m)
    covered = sum(t[2] for t in tiles)
    if covered >= coverage * n_item:
        out.append((doc_id, item_id, n_item, covered, sorted(tiles), text_hash))


def _by_broadcast(texts: DataFrame, items: DataFrame, m: int, coverage: float) -> DataFrame:
    got = items.toArrow()
    bench = _Benchmark(got["item_id"].to_pylist(), got["text"], m)

    def run(batch):
        raw, offsets = A.text_buffers(batch.column("text"))
        ids, out = batch.column("doc_id"), []
        for r, s in A.chunks(offsets):
            o = offsets[r: s + 1]
            h, _, _, first = A.word_hashes(raw[o[0]: o[-1]], o - o[0], lower=True)
            seed, text, at = _seeds(h, first, m)
            hit = np.flatnonzero(_may_hold(bench.map, seed)) if len(bench.seed) else []
            if not len(hit):
                continue
            seed, text, at = seed[hit], text[hit], at[hit]
            lo, hi = np.searchsorted(bench.seed, seed), np.searchsorted(bench.seed, seed, side="right")
            n = hi - lo
            k = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)  # benchmark seeds met
            text, at = np.repeat(text, n), np.repeat(at, n)
            item = bench.item[k]
            order = np.lexsort((item, text))
            text, at, item, k = text[order], at[order], item[order], k[order]
            new = np.ones(len(text), bool)
            new[1:] = (text[1:] != text[:-1]) | (item[1:] != item[:-1])
            cut = np.append(np.flatnonzero(new), len(text))
            for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
                t, i = int(text[a]), int(item[a])
                _judge(ids[r + t].as_py(), batch.column("text_hash")[r + t].as_py(), bench.ids[i], int(bench.first[i + 1] - bench.first[i]), int(first[t + 1] - first[t]),
                       bench.at[k[a:b]] - bench.first[i], at[a:b] - first[t], m, coverage, out)
        if out:
            yield _report(out, coverage)
    return map_arrow(texts, run, _OUT)


def _by_shuffle(texts: DataFrame, items: DataFrame, m: int, coverage: float) -> DataFrame:
    items = items.withColumn("item", F.monotonically_increasing_id())
    items = written(items, "items")  # freezes the numbers

    def item_seeds(batch):
        h, first = _words(batch.column("text"))
        seed, text, _ = _seeds(h, first, m)
        yield pa.record_batch([batch.column("item").take(pa.array(text)), pa.array(A.signed(seed))], names=["item", "seed"])
    seeds = written(map_arrow(items, item_seeds, "item bigint, seed bigint").distinct(), "seeds")
    place = F.expr(f"seed & {MAP_BITS - 1}L")
    got = (seeds.groupBy(F.shiftright(place, 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(seed & 63L as int))")).alias("bits"))
           .toArrow())  # at most MAP_BITS / 64 rows
    bits = np.zeros(MAP_BITS // 64, np.int64)
    bits[got["word"].to_numpy()] = got["bits"].to_numpy()
    bit_map = bits.astype("<i8").view(np.uint8)

    def doc_seeds(batch):
        h, first = _words(batch.column("text"))
        seed, text, _ = _seeds(h, first, m)
        at = np.flatnonzero(_may_hold(bit_map, seed))
        rows = pa.array(text[at])
        yield pa.record_batch([batch.column("doc_id").take(rows), batch.column("text_hash").take(rows), pa.array(A.signed(seed[at]))],
                              names=["doc_id", "text_hash", "seed"])
    found = map_arrow(texts, doc_seeds, "doc_id bigint, text_hash bigint, seed bigint").distinct()
    pairs = found.join(seeds, "seed").select("doc_id", "text_hash", "item").distinct()
    p = pairs.select(F.col("doc_id").alias("p_id"), F.col("text_hash").alias("p_hash"), "item")
    both = (texts.join(p, (texts["text_hash"] == p["p_hash"]) & texts["doc_id"].eqNullSafe(p["p_id"]))
            .join(items.select("item", "item_id", F.col("text").alias("item_text")), "item"))

    def run(batch):
        h, first = _words(batch.column("text"))
        g, start = _words(batch.column("item_text"))
        hs, ht, ha = _seeds(h, first, m)
        gs, gt, ga = _seeds(g, start, m)
        hf, gf = np.searchsorted(ht, np.arange(batch.num_rows + 1)), np.searchsorted(gt, np.arange(batch.num_rows + 1))
        out = []
        for r in range(batch.num_rows):
            x, y = hs[hf[r]: hf[r + 1]], gs[gf[r]: gf[r + 1]]
            order = np.argsort(y, kind="stable")
            lo, hi = np.searchsorted(y[order], x), np.searchsorted(y[order], x, side="right")
            n = hi - lo
            k = order[np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
            _judge(batch.column("doc_id")[r].as_py(), batch.column("text_hash")[r].as_py(), batch.column("item_id")[r].as_py(), int(start[r + 1] - start[r]), int(first[r + 1] - first[r]),
                   ga[gf[r]: gf[r + 1]][k] - start[r], np.repeat(ha[hf[r]: hf[r + 1]], n) - first[r], m, coverage, out)
        if out:
            yield _report(out, coverage)
    return map_arrow(both.select("doc_id", "text_hash", "text", "item_id", "item_text"), run, _OUT)


def contaminated(docs: DataFrame, benchmark: DataFrame, min_match: int = 5, coverage: float = 0.5,
                 broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """One row per document and benchmark item it gives away: doc_id, item_id,
    n_item_words, n_covered, coverage, tiles (item_pos, doc_pos, length),
    text_hash (xxhash64 of the text, which tells rows of one id apart)."""
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = texts.withColumn("text_hash", F.xxhash64("text"))
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text"))
    # a text of n bytes has at most (n + 1) / 2 words
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes"), F.count(F.lit(1)).alias("n")).first()
    if size["bytes"] // 2 + size["n"] <= broadcast_words:
        return _by_broadcast(texts, items, min_match, coverage)
    return _by_shuffle(texts, items, min_match, coverage)
