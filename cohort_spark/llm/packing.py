"""Packing documents into training sequences by histogram and non-negative
least squares.

Documents become token ids and are cut every ``window`` ids; what is left of
each is shorter than a window. The histogram of these lengths (rounded up to
``unit`` ids) is all the planner sees: it enumerates every combination of at
most ``depth`` lengths that fills a window, solves the repeat counts of the
combinations against the histogram by non-negative least squares, rounds them
down to whole counts within the supply, and packs what remains greedily,
largest first, again by counts. The plan is a list of patterns with repeat
counts whose size depends on the window and the unit only.

The pieces are then dealt to the patterns in parallel: a piece's rank within
its length is the number of pieces of that length in earlier hash buckets plus
its rank in its own, and the rank names pattern, repeat and slot.

A worker keeps the ids of words met before (tokens never cross white space in
this vocabulary), up to a bound.

Defined cases: a null text is the empty text and has only the end id; a text
of any length is encoded whole; repeated rows are packed each; null ids stay
null; extra columns are ignored; an empty table gives an empty result."""

from __future__ import annotations

import os
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import arrays as A
from .frames import map_arrow, written

#: Words of each of a worker's two tables, and the longest kept there.
KEPT_WORDS, KEPT_BYTES = 400_000, 64


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit bytes, word by word.

    The vocabulary's tokens never cross white space, nor the step from letters
    to a mark of ``_MARKS``, so a word's ids are those of its letters and of the
    marks behind them. Words of letters alone are encoded many at a time in one
    line; the ids that end a word give the cuts, and should their number differ
    from that of the words, each is encoded by itself."""

    _MARKS = b".,;:!?"

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        # two tables: a full one is kept as the old one until the next is full
        self.kept: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _one_by_one(self, words: list[bytes], out: dict[bytes, bytes]) -> None:
        for w, e in zip(words, self.tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)):
            out[w] = np.array(e.ids, "<u4").tobytes()

    def _encode(self, words: list[bytes], out: dict[bytes, bytes]) -> None:
        plain, other = [], []
        for w in words:
            (plain if w.decode().isalpha() else other).append(w)
        for i in range(0, len(plain), 4096):
            part = plain[i: i + 4096]
            ids = np.array(self.tokenizer.encode_batch_fast([b" ".join(part).decode()], add_special_tokens=False)[0].ids, "<u4")
            cut = ((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()
            if len(cut) != len(part):
                self._one_by_one(part, out)
                continue
            data = ids.tobytes()
            for w, a, b in zip(part, [0, *cut], cut):
                out[w] = data[a:b]
        for i in range(0, len(other), 4096):
            self._one_by_one(other[i: i + 4096], out)

    def learn(self, words: set[bytes]) -> dict[bytes, bytes]:
        """A table with the ids of ``words``."""
        new = words.difference(self.kept)
        if len(self.kept) + len(new) > KEPT_WORDS:
            self.old, self.kept, new = self.kept, {}, words
        kept, old, todo, split = self.kept, self.old, [], []
        for w in new:
            ids = old.get(w)
            if ids is not None:
                kept[w] = ids
                continue
            stem = w.rstrip(self._MARKS)
            if not stem or len(stem) == len(w) or not stem.decode().isalpha():
                todo.append(w)
            else:
                split.append((w, stem, w[len(stem):]))
        parts = {p for _, a, b in split for p in (a, b)}
        found = {p: ids for p in parts if (ids := kept.get(p) or old.get(p)) is not None}
        self._encode([*todo, *(p for p in parts if p not in found and p not in kept)], found)
        for w, a, b in split:
            found[w] = found[a] + found[b]
        if len(new) > KEPT_WORDS or any(len(w) > KEPT_BYTES for w in found):
            return {**kept, **found}  # too much to keep
        kept.update(found)
        return kept

    def texts(self, texts: list[bytes]) -> list[bytes]:
        words = [t.split() for t in texts]
        of = self.learn(set().union(*words))
        return [b"".join(map(of.__getitem__, w)) for w in words]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _encoded(column, path: str):
    """Row and id bytes of every text."""
    raw, offsets = A.text_buffers(column)
    enc = encoder(path)
    for i, j in A.chunks(offsets):
        o = offsets[i: j + 1].tolist()
        yield from zip(range(i, j), enc.texts([raw[a:b].tobytes() for a, b in zip(o[:-1], o[1:])]))


def pieces(texts: DataFrame, path: str, window: int, end_id: int, with_ids: bool) -> DataFrame:
    """Pieces of every document, in order, with their checksums (and ids)."""
    end = np.array([end_id], "<u4").tobytes()
    step = window * 4

    def run(batch):
        row, start, length, crc, total, ids = [], [], [], [], [], []

        def flush():
            rows = pa.array(row, pa.int64())
            out = [batch.column("doc_id").take(rows), batch.column("rid").take(rows), pa.array(start, pa.int64()), pa.array(length, pa.int64()),
                   pa.array(crc, pa.int64()), pa.array(total, pa.int64())]
            names = ["doc_id", "rid", "start", "length", "ids_crc32", "doc_tokens"]
            if with_ids:
                out.append(pa.array([np.frombuffer(b, "<u4").astype(np.int32) for b in ids], pa.list_(pa.int32())))
                names.append("ids")
            for x in (row, start, length, crc, total, ids):
                x.clear()
            return pa.record_batch(out, names=names)
        for r, b in _encoded(batch.column("text"), path):
            b += end
            for k in range(0, len(b), step):
                part = b[k: k + step]
                row.append(r)
                start.append(k // 4)
                length.append(len(part) // 4)
                crc.append(zlib.crc32(part))
                total.append(len(b) // 4)
                if with_ids:
                    ids.append(part)
            if len(row) >= 4096:
                yield flush()
        if row:
            yield flush()
    schema = "doc_id bigint, rid bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint" + (", ids array<int>" if with_ids else "")
    return map_arrow(texts.select("doc_id", "rid", "text"), run, schema)


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 2000) -> np.ndarray:
    """Least squares with non-negative unknowns by an active set (Lawson and Hanson)."""
    n = a.shape[1]
    x, free = np.zeros(n), np.zeros(n, bool)
    gradient = a.T @ b
    tolerance = 1e-9 * max(1.0, float(np.abs(gradient).max(initial=0)))
    for _ in range(rounds):
        if free.all() or gradient[~free].max(initial=-np.inf) <= tolerance:
            break
        free[np.flatnonzero(~free)[gradient[~free].argmax()]] = True
        while True:
            at = np.flatnonzero(free)
            s = np.linalg.lstsq(a[:, at], b, rcond=None)[0]
            if s.min(initial=1.0) > 0:
                break
            bad = s <= 0
            ratio = x[at][bad] / np.maximum(x[at][bad] - s[bad], 1e-300)
            x[at] += ratio.min() * (s - x[at])
            x[at[x[at] <= 1e-12]] = 0
            free[at[x[at] <= 1e-12]] = False
            if not free.any():
                s = np.zeros(0)
                at = np.zeros(0, int)
                break
        x[:] = 0
        x[at] = s
        gradient = a.T @ (b - a @ x)
    return x


def combinations(size: int, depth: int) -> list[tuple[int, ...]]:
    """All falling sequences of at most ``depth`` positive numbers with the sum ``size``."""
    out = []

    def grow(head: tuple[int, ...], left: int, most: int):
        if left == 0:
            out.append(head)
        elif len(head) < depth:
            for x in range(min(left, most), 0, -1):
                grow((*head, x), left - x, x)
    grow((), size, size)
    return out


def plan(supply: np.ndarray, depth: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of bins (falling) with repeat counts that use up ``supply``.

    ``supply[b]``: pieces of bin b; bins 1..size, a pattern's sum is at most size."""
    left, size = supply.astype(np.int64).copy(), len(supply) - 1
    out: list[tuple[tuple[int, ...], int]] = []

    def take(pattern: tuple[int, ...], times: int):
        bins, need = np.unique(pattern, return_counts=True)
        times = int(min(times, (left[bins] // need).min()))
        if times > 0:
            left[bins] -= need * times
            out.append((pattern, times))
    if left[1:].sum():
        combos = combinations(size, depth)
        a = np.zeros((size, len(combos)))
        for k, c in enumerate(combos):
            for b in c:
                a[b - 1, k] += 1
        # what stays of short lengths is packed easily, so it weighs less
        weight = np.where(np.arange(1, size + 1) * 4 >= size, 1.0, 0.1)
        scale = max(1.0, float(left.max()))
        x = nnls(a * weight[:, None], left[1:] / scale * weight) * scale
        for k in np.argsort(-x, kind="stable").tolist():
            if x[k] < 1 - 1e-9:
                break
            take(combos[k], int(x[k] + 1e-9))
    out.extend(greedy(left, size))
    return out


def greedy(supply: np.ndarray, size: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths that use up ``supply`` (a count for each length): the
    longest, then the longest that fits, and so on, as often as there is supply."""
    left, out = supply.copy(), []
    while left[1:].any():
        pattern, room, free = [], size, left.copy()
        while room:
            fits = np.flatnonzero(free[1: room + 1])
            if not len(fits):
                break
            b = int(fits[-1]) + 1
            n = min(int(free[b]), room // b)
            pattern.extend([b] * n)
            free[b] -= n
            room -= b * n
        bins, need = np.unique(pattern, return_counts=True)
        times = int((left[bins] // need).min())
        left[bins] -= need * times
        out.append((tuple(pattern), times))
    return out


def pack(docs: DataFrame, window: int = 2048, unit: int = 8, depth: int = 3, end_id: int = 1,
         tokenizer: str | None = None, with_ids: bool = False, bucket_rows: int = 50_000) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset (and ids, an array of int, if asked for).

    ``tokenizer``: path of a tokenizer file that every executor has."""
    if window % unit:
        raise ValueError("window must be a multiple of unit")
    path = tokenizer or default_tokenizer()
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = texts.withColumn("rid", F.xxhash64("doc_id", "text"))
    # short pieces are binned by their length itself, below the bins of the others
    short = min(8 * unit, window)
    length = F.col("length")
    place = F.when(length < short, length).otherwise(F.ceil(length / unit) + short)
    cut = written(pieces(texts, path, window, end_id, with_ids), "pieces").withColumn("bin", place.cast("int"))
    size = window // unit
    supply = np.zeros(short + size + 1, np.int64)
    for r in cut.groupBy("bin").count().collect():  # at most short + window / unit rows
        supply[r["bin"]] = r["count"]
    # per bin: from which rank on a slot of which pattern is served
    taken, table, base = np.zeros(len(supply), np.int64), [[] for _ in supply], 0
    of_long = [(tuple(b + short for b in p), times) for p, times in plan(np.r_[0, supply[short + 1:]], depth)]
    for pattern, times in of_long + greedy(supply[:short], window):
        for slot, b in enumerate(pattern):
            table[b].append((int(taken[b]), base, slot))
            taken[b] += times
        base += times
    served = [np.array(t, np.int64).reshape(-1, 3) for t in table]
    # rank of each piece within its bin, bucket by bucket
    buckets = max(1, -(-int(supply.sum()) // bucket_rows))
    cut = cut.withColumn("bucket", F.pmod(F.xxhash64("rid", "start"), F.lit(buckets)).cast("int"))
    before = Window.partitionBy("bin").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut.groupBy("bin", "bucket").agg(F.count(F.lit(1)).alias("n")).select("bin", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    local = F.row_number().over(Window.partitionBy("bin", "bucket").orderBy("doc_id", "rid", "start"))
    ranked = cut.withColumn("local", local - 1).join(offsets, ["bin", "bucket"]).withColumn("rank", F.col("before") + F.col("local"))
    keep = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *(["ids"] if with_ids else [])]

    def deal(batch):
        bins, rank = batch.column("bin").to_numpy(), batch.column("rank").to_numpy()
        seq, slot = np.zeros(len(bins), np.int64), np.zeros(len(bins), np.int64)
        for b in np.unique(bins).tolist():
            at = np.flatnonzero(bins == b)
            k = np.searchsorted(served[b][:, 0], rank[at], side="right") - 1
            seq[at] = served[b][k, 1] + rank[at] - served[b][k, 0]
            slot[at] = served[b][k, 2]
        yield pa.record_batch([*(batch.column(c) for c in keep), pa.array(seq), pa.array(slot)], names=[*keep, "sequence_id", "slot"])
    schema = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint" + (", ids array<int>" if with_ids else "")
    dealt = map_arrow(ranked.select(*keep, "bin", "rank"), deal, schema + ", sequence_id bigint, slot bigint")
    inside = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    return dealt.select(*keep[:5], "sequence_id", F.coalesce(F.sum("length").over(inside), F.lit(0)).alias("offset"), *keep[5:])
