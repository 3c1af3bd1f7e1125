"""Hard negatives of anchors, found through an inverted multi-index.

The index. Vectors are cut into two halves, and each half has a codebook of its
own (centroids of a bounded sample, ``SAMPLE`` rows; every row is indexed). A
row lies in the cell of its two nearest centroids. For an anchor, the inner
product with a half of any row of a codebook entry is at most its inner product
with the centroid plus its length times the entry's radius (and at most its
length times the entry's greatest length); the radii are taken over all rows.
The bound of a cell is the sum of two such bounds, and the multi-sequence heap
pops the cells in descending order of it, from the two sorted lists. A search
ends when the next bound is under what it still could improve: the score of the
last place of every window. What is found is then certain, whatever the sample.

The search. Scores are integer inner products of ``floor(scale * x)``. First the
positives of each anchor (its first rows of the same label), then, for every
positive, the first rows of another label with
``low * positive <= 100 * score <= high * positive``. Both go in two steps: a
probe of the blocks that hold the anchor's first cells, and then those blocks
only whose bound reaches the score the probe left to beat.

How it is spread. Cells are packed into blocks of at most about ``BLOCK`` rows; a
cell with more (a hot group of copies) is dealt over several blocks. Anchors
are dealt in parts of about ``PART``, by their own cells; a task holds one block
and the anchors of one part that visit it. A block's answer is at most one short
list a window, and nothing that has not a chance against the probe.

Defined cases: rows with a null vec_id, label or vector, or any null or
non-finite component take no part; of rows that repeat a vec_id the one with the
smallest (label, vector) takes part; shorter vectors count as filled up with
zeros; equal scores go by smaller vec_id; an anchor without another row of its
label, or a window without a row, gives no row; extra columns are not read; an
empty table gives an empty result. Scores are exact as long as they fit a long;
beyond, the job fails."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import map_arrow, ship, written

SAMPLE = 4096
CELL = 256
BLOCK = 2048
PART = 1024
PROBE = 2048
#: Rows scored at once.
BATCH = 512
LEAST = np.iinfo(np.int64).min


def codebook(x: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """``k`` centroids by Lloyd's rounds from the first distinct rows."""
    _, first = np.unique(x, axis=0, return_index=True)
    c = x[np.sort(first)[:k]].copy()
    for _ in range(rounds):
        near = nearest_entry(x, c)[0]
        n = np.bincount(near, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


def nearest_entry(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row, and its distance."""
    near = np.argmin((c * c).sum(1) - 2 * (x @ c.T), axis=1)
    return near, np.sqrt(((x - c[near]) ** 2).sum(1))


def inner(x: np.ndarray, v: np.ndarray, exact: bool) -> np.ndarray:
    """Integer inner products of rows of ``x`` with ``v``: by floats while their sums are below 2^53 (``exact``)."""
    if exact:
        return (x @ v).astype(np.int64)
    whole = [int(a) for a in v]
    return np.array([sum(int(a) * b for a, b in zip(row, whole)) for row in x], dtype=np.int64)


class Cells:
    """Codebooks with radii, and the blocks of every cell (at most entries² of them)."""

    def __init__(self, c1, c2, cells: dict[tuple[int, int], int], radius: list[np.ndarray], length: list[np.ndarray], exact: bool):
        self.c1, self.c2, self.radius, self.length, self.exact = c1, c2, radius, length, exact
        self.half = c1.shape[1]
        self.at = np.array(sorted(cells), np.int64).reshape(-1, 2)
        self.rows = np.array([cells[tuple(c)] for c in self.at.tolist()], np.int64)
        self.first, self.pieces, self.blocks = self._packed()
        self.place = {tuple(c): i for i, c in enumerate(self.at.tolist())}

    def _packed(self):
        first, pieces, block, room = [], [], -1, 0
        for n in self.rows.tolist():
            if n > BLOCK:
                p = -(-n // BLOCK)
                first.append(block + 1)
                block, room = block + p, 0
            else:
                p = 1
                if n > room:
                    block, room = block + 1, BLOCK
                room -= n
                first.append(block)
            pieces.append(p)
        return np.array(first, np.int64), np.array(pieces, np.int64), block + 1

    def half_bounds(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row of ``v``, upper bounds of the inner product with the halves of each entry's rows."""
        out = []
        for x, c, r, n in ((v[:, : self.half], self.c1, *self._of(0)), (v[:, self.half:], self.c2, *self._of(1))):
            size = np.sqrt((x * x).sum(1))[:, None]
            out.append(np.minimum(x @ c.T + size * r, size * n) * (1 + 1e-9) + 0.5 + 1e-9 * size * n)
        return out[0], out[1]

    def _of(self, h):
        return self.radius[h], self.length[h]


def in_order(b1: np.ndarray, b2: np.ndarray) -> Iterator[tuple[int, int, float]]:
    """The multi-sequence heap: all pairs of entries by descending sum of their bounds."""
    o1, o2 = np.argsort(-b1, kind="stable").tolist(), np.argsort(-b2, kind="stable").tolist()
    s1, s2 = b1[o1].tolist(), b2[o2].tolist()
    heap = [(-(s1[0] + s2[0]), 0, 0)]
    while heap:
        bound, i, j = heapq.heappop(heap)
        yield o1[i], o2[j], -bound
        if j + 1 < len(s2):
            heapq.heappush(heap, (-(s1[i] + s2[j + 1]), i, j + 1))
        if j == 0 and i + 1 < len(s1):  # each pair has one predecessor
            heapq.heappush(heap, (-(s1[i + 1] + s2[0]), i + 1, 0))


def _matrix(column, dim: int) -> np.ndarray:
    """A list column as a matrix, filled up with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat, off = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64), column.offsets.to_numpy().astype(np.int64)
    size = np.diff(off)
    out = np.zeros((len(column), dim))
    row = np.repeat(np.arange(len(column)), size)
    out[row, np.arange(len(flat)) - np.repeat(off[:-1] - off[0], size)] = flat
    return out


def _probe(cells: Cells, b1: np.ndarray, b2: np.ndarray) -> set[int]:
    """Blocks of the first cells of the heap that hold ``PROBE`` rows."""
    blocks, rows = set(), 0
    for i, j, _ in in_order(b1, b2):
        at = cells.place.get((i, j))
        if at is not None:
            n = max(1, min(int(cells.pieces[at]), -(-(PROBE - rows) // BLOCK)))
            blocks.update(range(int(cells.first[at]), int(cells.first[at]) + n))
            rows += min(int(cells.rows[at]), n * BLOCK)
            if rows >= PROBE:
                break
    return blocks


def _routes(anchors: DataFrame, cells: Cells, dim: int, schema: str, rest: bool) -> DataFrame:
    """A row for each anchor and block it visits: the probed blocks, or those of
    the others whose bound reaches the anchor's ``beat``."""
    names = [f.split(" ")[0] for f in schema.split(", ")]

    def run(batch: pa.RecordBatch):
        for a in range(0, batch.num_rows, 64):
            part = batch.slice(a, 64)
            b1, b2 = cells.half_bounds(_matrix(part["v"], dim))
            row, block = [], []
            beat = part["beat"].to_numpy()
            for i in range(part.num_rows):
                to = _probe(cells, b1[i], b2[i])
                if rest:
                    reach = np.flatnonzero(b1[i][cells.at[:, 0]] + b2[i][cells.at[:, 1]] >= beat[i])
                    n = cells.pieces[reach]
                    every = np.repeat(cells.first[reach], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    to = np.setdiff1d(every, list(to))
                block.extend(sorted(to))
                row.extend([i] * len(to))
            if row:
                out = part.take(pa.array(row, pa.int64()))
                yield pa.record_batch([pa.array(block, pa.int64()), *out.select(names).columns], names=["block", *names])
    return map_arrow(anchors, run, f"block bigint, {schema}")


def _visit(routes: DataFrame, rows: DataFrame, cells: Cells, dim: int, same: bool, keep: int) -> DataFrame:
    """(anchor_id, window, vec_id, score): of each visited block the ``keep``
    first rows of every window that can still be among the best. A window is
    (smallest score, largest score) and takes rows of the anchor's label (``same``) or of others."""
    pairs = routes.select(F.col("block").alias("to_block"), F.col("part").alias("to_part")).distinct()
    data = rows.join(pairs, rows["block"] == pairs["to_block"]).select("to_block", "to_part", "vec_id", "label", "v", "e1", "e2")

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            e1, e2 = left["e1"].to_numpy(), left["e2"].to_numpy()
            order = np.lexsort((left["vec_id"].to_numpy(), e2, e1))
            x, ids, label = _matrix(left["v"], dim)[order], left["vec_id"].to_numpy()[order], left["label"].to_numpy()[order]
            e1, e2 = e1[order], e2[order]
            begin = np.flatnonzero(np.r_[True, (e1[1:] != e1[:-1]) | (e2[1:] != e2[:-1])])
            end = np.r_[begin[1:], len(ids)]
            of = {(int(e1[b]), int(e2[b])): (int(b), int(e)) for b, e in zip(begin, end)}
            i1, i2 = np.unique(e1), np.unique(e2)
            v, a_label, a_id = _matrix(right["v"], dim), right["label"].to_numpy(), right["anchor_id"].to_numpy()
            lows, highs = right["lows"].to_pylist(), right["highs"].to_pylist()
            b1, b2 = cells.half_bounds(v)
            for a in range(len(v)):
                windows = [_Best(lo, hi, keep) for lo, hi in zip(lows[a], highs[a])]
                heap, batch, size = in_order(b1[a][i1], b2[a][i2]), [], 0
                while True:
                    i, j, bound = next(heap, (-1, -1, -np.inf))
                    done = bound < min(w.low for w in windows)
                    if not done and (span := of.get((int(i1[i]), int(i2[j])))):
                        batch.append(np.arange(*span))
                        size += span[1] - span[0]
                    if size >= BATCH or done and size:
                        at = np.concatenate(batch)
                        at = at[(label[at] == a_label[a]) & (ids[at] != a_id[a])] if same else at[label[at] != a_label[a]]
                        score = inner(x[at], v[a], cells.exact)
                        for w in windows:
                            w.add(ids[at], score)
                        batch, size = [], 0
                    if done:
                        break
                for n, w in enumerate(windows):
                    out.append((np.full(len(w.ids), a_id[a]), np.full(len(w.ids), n), w.ids, w.scores))
        cols = [np.concatenate(z) for z in zip(*out)] if out else [np.zeros(0, np.int64)] * 4
        return pa.table([pa.array(c.astype(np.int64)) for c in cols], names=["anchor_id", "window", "vec_id", "score"])
    ship(rows.sparkSession)
    return (data.groupBy("to_block", "to_part").cogroup(routes.groupBy("block", "part"))
            .applyInArrow(search, "anchor_id bigint, window bigint, vec_id bigint, score bigint"))


class _Best:
    """The ``keep`` best rows with a score in a window; ``low`` rises to the last one's score."""

    def __init__(self, low: int, high: int, keep: int):
        self.low, self.high, self.keep = low, high, keep
        self.ids, self.scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if low > high:
            self.low = np.inf  # takes nothing

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        fits = np.flatnonzero((scores >= self.low) & (scores <= self.high))
        if len(fits):
            ids, scores = np.r_[self.ids, ids[fits]], np.r_[self.scores, scores[fits]]
            best = np.lexsort((ids, -scores))[: self.keep]
            self.ids, self.scores = ids[best], scores[best]
            if len(best) == self.keep:
                self.low = max(self.low, int(self.scores[-1]))


def _best(found: DataFrame, keep: int) -> DataFrame:
    w = Window.partitionBy("anchor_id", "window").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= keep)


def _two_steps(anchors: DataFrame, rows: DataFrame, cells: Cells, dim: int, same: bool, keep: int, name: str) -> DataFrame:
    """The ``keep`` best rows of each window of ``anchors`` (anchor_id, part, label, v, lows, highs)."""
    schema = "part bigint, anchor_id bigint, label bigint, v array<double>, lows array<bigint>, highs array<bigint>"
    first = _routes(anchors.withColumn("beat", F.lit(0.0)), cells, dim, schema, rest=False)
    probe = written(_best(_visit(first, rows, cells, dim, same, keep), keep), name)
    # the last place of a window that the probe has filled is the score to beat
    last = probe.where(F.col("rank") == keep).groupBy("anchor_id").agg(F.map_from_entries(F.collect_list(F.struct("window", "score"))).alias("last"))
    lows = F.transform("lows", lambda lo, i: F.greatest(lo, F.coalesce(F.try_element_at("last", i.cast("bigint")), F.lit(LEAST))))
    again = anchors.join(last, "anchor_id", "left").withColumn("lows", lows).drop("last")
    open_ = F.filter(F.arrays_zip("lows", "highs"), lambda w: w["lows"] <= w["highs"])
    again = again.where(F.size(open_) > 0).withColumn("beat", F.array_min(F.transform(open_, lambda w: w["lows"])).cast("double"))
    second = _visit(_routes(again, cells, dim, schema, rest=True), rows, cells, dim, same, keep)
    return written(_best(probe.drop("rank").unionAll(second), keep), name)


def hard_negatives(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256) -> DataFrame:
    """One row for each anchor, positive and negative: anchor_id, positive_id,
    rank, negative_id, positive_score, negative_score. ``vectors``: vec_id,
    label, embedding; ``is_anchor`` chooses the anchors."""
    e = F.col("embedding").cast("array<double>")
    x = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"), e.alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("a"))
    x = x.where("vec_id is not null and label is not null and v is not null").where(
        ~F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))))
    x = x.withColumn("v", F.transform("v", lambda c: F.floor(c * scale).cast("double")))
    size = x.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("vec_id").alias("ids"), F.max(F.size("v")).alias("dim"), F.count_if("a").alias("anchors")).first()
    if size["n"] != size["ids"]:
        x = x.groupBy("vec_id").agg(F.min(F.struct("label", "v", "a")).alias("s")).select("vec_id", "s.*")
    if not size["anchors"]:
        return _result(x.sparkSession)
    dim = max(2, size["dim"])
    cells, rows = _index(x, dim, size["ids"])
    parts = max(1, -(-size["anchors"] // PART))
    whole = F.array(F.lit(LEAST)), F.array(F.lit(np.iinfo(np.int64).max))
    anchors = rows.where("a").select(F.col("vec_id").alias("anchor_id"), (F.col("block") * parts / cells.blocks).cast("bigint").alias("part"), "label", "v")
    first = _two_steps(anchors.withColumn("lows", whole[0]).withColumn("highs", whole[1]), rows, cells, dim, True, positives, "positives")
    # a window for each positive
    windows = first.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("rank", "vec_id", "score"))).alias("p"))
    windows = windows.withColumn("lows", F.transform("p", lambda p: F.ceil(p["score"] * F.lit(low).cast("decimal(20,0)") / 100).cast("bigint"))) \
        .withColumn("highs", F.transform("p", lambda p: F.floor(p["score"] * F.lit(high).cast("decimal(20,0)") / 100).cast("bigint")))
    found = _two_steps(anchors.join(windows.select("anchor_id", "lows", "highs"), "anchor_id"), rows, cells, dim, False, negatives, "negatives")
    p = first.select("anchor_id", (F.col("rank") - 1).cast("bigint").alias("window"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return found.join(p, ["anchor_id", "window"]).select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def _result(spark) -> DataFrame:
    return spark.createDataFrame([], "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint")


def _index(x: DataFrame, dim: int, n: int) -> tuple[Cells, DataFrame]:
    """Codebooks from a bounded sample, all rows with their cell and block."""
    bound = max(256, min(SAMPLE, (1 << 25) // (8 * dim)))
    taken = x.select("v", "vec_id").orderBy(F.xxhash64("vec_id"), "vec_id").limit(bound).toArrow()  # at most 32 MB
    s = _matrix(taken["v"], dim)
    half = dim // 2
    k = int(np.clip(round((n / CELL) ** 0.5), 1, 64))
    c1, c2 = codebook(s[:, :half], k), codebook(s[:, half:], k)

    def assign(batch: pa.RecordBatch):
        v = _matrix(batch["v"], dim)
        (e1, d1), (e2, d2) = nearest_entry(v[:, :half], c1), nearest_entry(v[:, half:], c2)
        n1, n2 = np.sqrt((v[:, :half] ** 2).sum(1)), np.sqrt((v[:, half:] ** 2).sum(1))
        new = [pa.array(e1.astype(np.int32)), pa.array(e2.astype(np.int32)), *(pa.array(d) for d in (d1, d2, n1, n2))]
        yield pa.record_batch([*(batch[c] for c in ("vec_id", "label", "v", "a")), *new], names=["vec_id", "label", "v", "a", "e1", "e2", "d1", "d2", "n1", "n2"])
    at = written(map_arrow(x.select("vec_id", "label", "v", "a"), assign,
                           "vec_id bigint, label bigint, v array<double>, a boolean, e1 int, e2 int, d1 double, d2 double, n1 double, n2 double"), "cells")
    cells = at.groupBy("e1", "e2").agg(F.count(F.lit(1)).alias("n"), *[F.max(c).alias(c) for c in ("d1", "d2", "n1", "n2")]).collect()  # at most 64 * 64
    radius, length = [np.zeros(len(c1)), np.zeros(len(c2))], [np.zeros(len(c1)), np.zeros(len(c2))]
    for r in cells:
        for h in (0, 1):
            entry = r[f"e{h + 1}"]
            radius[h][entry] = max(radius[h][entry], r[f"d{h + 1}"])
            length[h][entry] = max(length[h][entry], r[f"n{h + 1}"])
    exact = sum(max((r[f"n{h}"] ** 2 for r in cells), default=0.0) for h in (1, 2)) < 2.0 ** 52
    index = Cells(c1, c2, {(r["e1"], r["e2"]): r["n"] for r in cells}, radius, length, exact)
    blocks = x.sparkSession.createDataFrame([(*c, f, p) for c, f, p in zip(index.at.tolist(), index.first.tolist(), index.pieces.tolist())],
                                            "e1 int, e2 int, first bigint, pieces bigint")
    rows = at.join(F.broadcast(blocks), ["e1", "e2"]).withColumn("block", F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("pieces")))
    return index, rows.select("block", "vec_id", "label", "v", "a", "e1", "e2")
