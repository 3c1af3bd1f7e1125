"""Removal of repeated passages by seed and extend.

Seeds are winnowed: of every ``length - seed + 1`` consecutive seed-word
hashes the least is an anchor, so each window of ``length`` words owns exactly
one anchor and equal windows own equal anchors. Anchors that occur once cannot
be part of a repeat. Around each occurrence of the others the match is
extended to both sides: the consecutive windows that own it form a unit (at
most ``length - seed + 1`` of them), and a window of a unit is a repeat if its
word sequence also starts anywhere else. The covering ranges of repeated
windows are the maximal repeats of at least ``length`` words; their words are
removed in every place. Decisions are taken on the input alone.

Skew. Occurrences of an anchor never meet in pairs: equal units are counted
as one class by a plain aggregate, which Spark combines before the shuffle. An
anchor all of whose occurrences are one class is settled by that count alone.
Only units of anchors with several classes (the ends of repeats) have their
windows written out, one row for each class and window, and these are counted
in the same way; so a passage that a third of all documents share costs one
row per task and class. Units that occur very often are looked up, not joined.
The anchors with several classes reach the tasks as a
bit map of fixed size; it may let others pass, which the counts then settle.

Words are ``[^\\x20\\x09-\\x0D]+``, unchanged. Windows, units and anchors are
compared by 64-bit hashes of their word hashes.

Defined cases: null and empty texts have no words (kept text is empty); a text
shorter than ``length`` loses nothing; repeated rows are occurrences of their
own, so both lose their windows; rows are told apart by id and text, a null id
is a value like any other; extra columns are ignored; an empty table gives an
empty result."""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays as A
from .frames import map_arrow, written

#: Bits of the map of anchors with several classes: 8 MB, whatever the input.
MAP_BITS = 1 << 26
_POS = A.U64((1 << 28) - 1)


def _owners(grams: np.ndarray, width: int) -> np.ndarray:
    """Position of the least of each ``width`` consecutive values (leftmost of equals)."""
    key = (grams & ~_POS) | (np.arange(len(grams), dtype=np.uint64) & _POS)
    span = 1
    while span * 2 <= width:
        key = np.minimum(key[:-span], key[span:])
        span *= 2
    if span < width:
        key = np.minimum(key[: len(key) - (width - span)], key[width - span:])
    at = np.arange(len(key), dtype=np.int64)
    return at + ((key & _POS).astype(np.int64) - at) % (int(_POS) + 1)


def _units(hashes: np.ndarray, first: np.ndarray, length: int, seed: int):
    """Per unit: text, anchor hash, first window, number of windows (word positions of the chunk)."""
    n = len(hashes)
    none = np.zeros(0, np.int64)
    if n < length:
        return none, np.zeros(0, np.uint64), none, none, None
    runs = A.Runs(hashes)
    at = np.arange(n - seed + 1)
    grams = runs.of(at, at + seed)
    owner = _owners(grams, length - seed + 1)  # one for each window of the chunk
    begin = np.arange(len(owner))
    text = A.segment_of(first)
    inside = text[begin] == text[begin + length - 1]
    begin, owner = begin[inside], owner[inside]
    if not len(begin):
        return none, np.zeros(0, np.uint64), none, none, runs
    new = np.ones(len(begin), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (begin[1:] != begin[:-1] + 1)
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, len(begin)))
    return text[begin[at]], grams[owner[at]], begin[at], count, runs


def _chunked(batch: pa.RecordBatch):
    raw, offsets = A.text_buffers(batch.column("text"))
    for i, j in A.chunks(offsets):
        o = offsets[i: j + 1]
        piece = raw[o[0]: o[-1]]
        h, starts, ends, first = A.word_hashes(piece, o - o[0])
        yield i, piece, h, starts, ends, first


def _units_of(texts: DataFrame, length: int, seed: int) -> DataFrame:
    """Every unit: where it begins, its hash, its anchor and how many windows it has."""
    def run(batch):
        ids, rid = batch.column("doc_id"), batch.column("rid")
        for i, _, h, _, _, first in _chunked(batch):
            text, anchor, begin, count, runs = _units(h, first, length, seed)
            if not len(begin):
                continue
            rows = pa.array(text + i)
            yield pa.record_batch([
                ids.take(rows), rid.take(rows), pa.array(begin - first[text]),
                pa.array(A.signed(runs.of(begin, begin + count + length - 1))), pa.array(A.signed(anchor)), pa.array(count.astype(np.int32)),
            ], names=["doc_id", "rid", "start", "unit", "anchor", "size"])
    return map_arrow(texts.select("doc_id", "rid", "text"), run, "doc_id bigint, rid bigint, start bigint, unit bigint, anchor bigint, size int")


def _bit_map(anchors: DataFrame) -> np.ndarray:
    """Bit map of the anchors, eight to a byte."""
    place = F.expr(f"anchor & {MAP_BITS - 1}L")
    got = (anchors.groupBy(F.shiftright(place, 6).alias("word"))
           .agg(F.bit_or(F.expr("shiftleft(1L, cast(anchor & 63L as int))")).alias("bits")).toArrow())  # at most MAP_BITS / 64 rows
    out = np.zeros(MAP_BITS // 64, np.int64)
    out[got["word"].to_numpy()] = got["bits"].to_numpy()
    return out.astype("<i8").view(np.uint8)


def _windows_of(texts: DataFrame, length: int, seed: int, chosen: np.ndarray) -> DataFrame:
    """Units whose anchors the bit map holds, with the hashes of their windows."""
    def run(batch):
        for _, _, h, _, _, first in _chunked(batch):
            _, anchor, begin, count, runs = _units(h, first, length, seed)
            place = anchor & A.U64(MAP_BITS - 1)
            at = np.flatnonzero((chosen[(place >> A.U64(3)).astype(np.int64)] >> (place & A.U64(7)).astype(np.uint8)) & 1)
            if not len(at):
                continue
            begin, count = begin[at], count[at]
            off = np.zeros(len(at) + 1, np.int64)
            np.cumsum(count, out=off[1:])
            window = np.arange(off[-1]) - np.repeat(off[:-1], count) + np.repeat(begin, count)
            yield pa.record_batch([
                pa.array(A.signed(runs.of(begin, begin + count + length - 1))),
                pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(A.signed(runs.of(window, window + length)))),
            ], names=["unit", "windows"])
    return map_arrow(texts.select("text"), run, "unit bigint, windows array<bigint>")


def _cut(joined: DataFrame, length: int) -> DataFrame:
    """Texts without the words that marked windows cover."""
    schema = "doc_id bigint, n_words bigint, n_removed bigint, kept string, removed array<struct<begin:bigint,end:bigint>>"
    span = pa.struct([("begin", pa.int64()), ("end", pa.int64())])

    def run(batch):
        texts, marks = batch.column("text"), batch.column("marks")
        n_words, n_removed, kept, removed = [], [], [], []
        for r in range(batch.num_rows):
            t = texts[r].as_buffer()
            words = (t.to_pybytes() if t is not None else b"").split()
            n_words.append(len(words))
            spans, gone = [], 0
            if marks[r].is_valid and len(words):
                m = marks[r].values
                start = m.field("start").to_numpy()
                mask = m.field("mask").to_numpy().astype("<i8")
                bits = np.unpackbits(mask.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                w, b = np.nonzero(bits)
                begin = start[w] + b
                edge = np.bincount(begin, minlength=len(words) + 1) - np.bincount(begin + length, minlength=len(words) + 1)
                keep = np.cumsum(edge[: len(words)]) == 0
                step = np.diff(np.concatenate([[1], keep.astype(np.int8), [1]]))
                spans = [{"begin": int(x), "end": int(y)} for x, y in zip(np.flatnonzero(step == -1), np.flatnonzero(step == 1))]
                gone = int(len(words) - keep.sum())
                words = compress(words, keep.tolist())
            n_removed.append(gone)
            kept.append(b" ".join(words))
            removed.append(spans)
        yield pa.record_batch([batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
                               pa.array(kept, pa.binary()).cast(pa.string()), pa.array(removed, pa.list_(span))],
                              names=["doc_id", "n_words", "n_removed", "kept", "removed"])
    return map_arrow(joined.select("doc_id", "text", "marks"), run, schema)


def remove_repeats(docs: DataFrame, length: int = 35, seed: int = 6) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept (the words left,
    joined by one space), removed (ranges of word positions).

    ``length - seed`` may be at most 62: a unit's windows are one bit each."""
    if not 1 <= seed <= length <= seed + 62:
        raise ValueError("1 <= seed <= length <= seed + 62 is asked for")
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = texts.withColumn("rid", F.xxhash64("doc_id", "text"))
    units = written(_units_of(texts, length, seed), "units")
    classes = units.groupBy("unit").agg(F.count(F.lit(1)).alias("n"), F.first("anchor").alias("anchor"), F.first("size").alias("size"))
    anchors = written(classes.groupBy("anchor").agg(F.count(F.lit(1)).alias("classes"), F.sum("n").alias("n"), F.first("unit").alias("unit"), F.first("size").alias("size"))
                      .where("classes > 1 or n > 1"), "anchors")
    # one class, several times: all its windows are repeats
    whole = anchors.where("classes = 1").select("unit", "n", F.expr("shiftleft(1L, size) - 1").alias("mask"))
    # several classes: count their windows
    shared = _windows_of(texts, length, seed, _bit_map(anchors.where("classes > 1").select("anchor")))
    shared = written(shared.groupBy("unit").agg(F.count(F.lit(1)).alias("n"), F.first("windows").alias("windows")), "shared")
    each = shared.select("unit", "n", F.posexplode("windows").alias("k", "window"))
    twice = each.groupBy("window").agg(F.sum("n").alias("n")).where("n > 1").select("window")
    masks = each.join(twice, "window").select("unit", "n", F.expr("shiftleft(1L, k)").alias("mask")).unionAll(whole)
    masks = written(masks.groupBy("unit").agg(F.bit_or("mask").alias("mask"), F.max("n").alias("n")), "masks")
    # units that occur very often (runs of one word, copies of one text) would
    # be hot keys: those with over a thousandth of all rows, a thousand at most,
    # are looked up in every task, the others joined
    often = max(1000, units.count() // 1000)
    hot = F.broadcast(masks.where(F.col("n") > often).select("unit", F.col("mask").alias("hot")))
    place = units.select("doc_id", "rid", "start", "unit").join(hot, "unit", "left")
    found = (place.where("hot is not null").select("doc_id", "rid", "start", F.col("hot").alias("mask"))
             .unionAll(place.where("hot is null").join(masks.where(F.col("n") <= often), "unit").select("doc_id", "rid", "start", "mask")))
    # rows that repeat id and text mark the same places: one mark for each, however many rows
    found = found.groupBy("doc_id", "rid", "start").agg(F.bit_or("mask").alias("mask"))
    marks = found.groupBy("doc_id", "rid").agg(F.collect_list(F.struct("start", "mask")).alias("marks"))
    m = marks.select(F.col("doc_id").alias("m_id"), F.col("rid").alias("m_rid"), "marks")
    joined = texts.join(m, (texts["rid"] == m["m_rid"]) & texts["doc_id"].eqNullSafe(m["m_id"]), "left")
    return _cut(joined.select("doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("text"), "marks"), length)
