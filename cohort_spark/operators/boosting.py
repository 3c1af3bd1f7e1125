"""Second-order gradient boosting on binned features (M4).

Features are binned once: a numeric one by its exact quantiles (every distinct
value is a bin of its own up to ``bins`` of them), a categorical one by the
number of its category. Each round grows one tree level by level. For a level
every task sums the gradients and hessians of its rows by (node, feature, bin)
and only these sums leave it: their size depends on nodes, features and bins,
not on the rows. The best split of each node follows from the sums on the
driver:

* gain ``GL²/(HL+l2) + GR²/(HR+l2) - G²/(H+l2)``, leaf value ``-rate·G/(H+l2)``;
* numeric: ``value <= cut``, missing values on the side that gains more;
* categorical: one category against the rest (what a tree does on one-hot
  columns); an unknown or missing category is with the rest;
* at least ``least_rows`` rows on both sides; depth ``depth``.

Gradients are summed as integers (multiples of 2^-24 of the greatest weight), so
the model does not depend on how the rows are partitioned, and a task that is
run again gives the same sums.

Rows are held as blocks of numpy arrays, bins in as few bytes as hold them, and
go down a tree as lists of row numbers, each split reading its own feature of
its own rows. A fit is about ``rounds * depth`` dependent steps over the same
rows, so the steps are not jobs: all rounds are one barrier stage, whose tasks
hold their blocks and tell each other sums and splits through files in the
shared folder (:class:`Exchange`). Sums are added up along a tree of tasks, so a
task reads as much however many there are. A task that is lost makes Spark run
the stage anew, which gives the same trees.

Where that cannot be (blocks too large for the memory of the tasks, executors
that come and go, a shared folder that tasks cannot open), each step is a job
over the persisted blocks. The margins are then kept every ``KEEP_EVERY`` rounds, and
the lineage is cut by a checkpoint in the shared folder every ``CUT_EVERY``
times. Both ways add the same integers and grow the same trees."""

from __future__ import annotations

import itertools
import pickle
import time
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import RDD, BarrierTaskContext, StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path, shared_dir
from .ranks import running_totals

BLOCK = 1 << 14
COUNT_BITS = 15  # hold the rows of a block
#: Rounds after which the margins are kept anew (in between, the last trees are applied on the way), and
#: how many of these steps the lineage may hold.
KEEP_EVERY = 5
CUT_EVERY = 10
LEAST_HESSIAN = 1e-3
SCALE_BITS = 24
#: Bytes of blocks, with what a round adds to them, that a task of the barrier stage may hold.
TASK_BYTES = 256 << 20
#: Tasks whose sums a task adds to its own.
FAN_IN = 16
#: Seconds until the first word of the others (after it, the folder is known to be shared), and any later one.
FIRST_WORD, LATER_WORD = 60, 6 * 3600


class Params(NamedTuple):
    rounds: int = 300
    rate: float = 0.06
    depth: int = 4
    least_rows: int = 20
    l2: float = 0.1
    bins: int = 255


class Split(NamedTuple):
    """A node of a tree: a split, or a leaf where ``feature`` is -1."""

    feature: int
    cut: int          # bin of the cut, or number of the category
    missing_left: bool
    value: float      # leaf value
    n: int
    g: float
    h: float


LEAF = -1


# ------------------------------------------------------------------ binning

def category_table(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, value, code): the distinct non-null values of each column,
    numbered from 0 in order of value. The numbers are running counts over
    ranges of (feature, value), so a dictionary of any size is made and kept
    as a table."""
    args = ", ".join(f"'{c}', `{c}`" for c in columns)
    long = df.select(F.expr(f"stack({len(columns)}, {args}) as (feature, value)")).where("value is not null")
    seen = long.distinct().withColumn("one", F.lit(1))
    return running_totals(seen, ["feature"], "value", ["one"]).select("feature", "value", F.col("cum_one_before").cast("int").alias("code"))


def numeric_cuts(df: DataFrame, columns: list[str], bins: int = 255) -> DataFrame:
    """(feature, cut, n_left): the upper ends of the bins of each column but
    the last one's, and the rows up to each. With at most ``bins`` distinct
    values each ends a bin, else those at which the running count passes a
    multiple of n / bins. Exact, by integer arithmetic on counts."""
    from .drift import long_values
    values = long_values(df, columns, "x", finite=False).groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
    cum = running_totals(values, ["feature"], "value", ["n"])
    total = cum.groupBy("feature").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("values"), F.max("value").alias("last"))
    upto = F.col("cum_n_before") + F.col("n")
    # one row per feature
    out = cum.join(F.broadcast(total), "feature").withColumn("n_left", upto)
    passes = F.expr(f"({bins} * cum_n_before) div total < ({bins} * n_left) div total")
    return out.where((F.col("value") < F.col("last")) & ((F.col("values") <= bins) | passes)).select("feature", F.col("value").alias("cut"), "n_left")


class Layout(NamedTuple):
    """Features in order (categorical, then numeric) with their bins; slot ``bins[f]`` takes missing and unknown values."""

    categorical: list[str]
    numeric: list[str]
    cuts: list[np.ndarray]   # of the numeric ones
    bins: np.ndarray
    offset: np.ndarray

    @property
    def names(self) -> list[str]:
        return self.categorical + self.numeric


def layout(df: DataFrame, categories: DataFrame, categorical: list[str], numeric: list[str], bins: int) -> Layout:
    sizes = {r["feature"]: r["n"] for r in categories.groupBy("feature").agg(F.count(F.lit(1)).alias("n")).collect()} if categorical else {}
    found: dict[str, list[float]] = {c: [] for c in numeric}
    if numeric:
        for r in numeric_cuts(df, numeric, bins).select("feature", "cut").collect():  # at most features x bins values
            found[r["feature"]].append(r["cut"])
    cuts = [np.sort(np.array(found[c], np.float64)) for c in numeric]
    n = np.array([sizes.get(c, 0) for c in categorical] + [len(c) + 1 for c in cuts], np.int64)
    return Layout(categorical, numeric, cuts, n, np.r_[0, np.cumsum(n + 1)])


def binned(df: DataFrame, lay: Layout, categories: DataFrame, label: str, weight: str) -> RDD:
    """Blocks (x, y, w, margin) of rows: bins (features, rows) as integers of as few bytes as hold them."""
    coded = df
    for i, c in enumerate(lay.categorical):
        d = categories.where(F.col("feature") == c).select(F.col("value").alias(f"_v{i}"), F.col("code").alias(f"_c{i}"))
        coded = coded.join(d, coded[c] == F.col(f"_v{i}"), "left")
    coded = coded.select(*[F.col(f"_c{i}") for i in range(len(lay.categorical))], *[F.col(f"`{c}`").cast("double").alias(f"_n{i}") for i, c in enumerate(lay.numeric)],
                         F.col(label).cast("double").alias("_y"), F.col(weight).cast("double").alias("_w"))
    n_cat = len(lay.categorical)
    kind = np.min_scalar_type(int(lay.bins.max(initial=0)))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in (b.slice(a, BLOCK) for a in range(0, b.num_rows, BLOCK)):
                x = np.empty((len(lay.bins), part.num_rows), kind)
                for f in range(len(lay.bins)):
                    if f < n_cat:
                        x[f] = part.column(f).fill_null(int(lay.bins[f])).to_numpy()
                    else:
                        v = part.column(f).to_numpy(zero_copy_only=False).astype(np.float64)
                        x[f] = np.where(np.isnan(v), lay.bins[f], np.searchsorted(lay.cuts[f - n_cat], v, side="left"))
                y, w = (part.column(len(lay.bins) + i).to_numpy(zero_copy_only=False).astype(np.float64) for i in (0, 1))
                yield pa.record_batch([pa.array([a.tobytes()], pa.binary()) for a in (x, y, w)], names=["x", "y", "w"])
    n_features = len(lay.bins)

    def unpack(row):
        y = np.frombuffer(row["y"])
        return np.frombuffer(row["x"], kind).reshape(n_features, -1), y, np.frombuffer(row["w"]), np.zeros(len(y))
    return coded.mapInArrow(pack, "x binary, y binary, w binary").rdd.map(unpack)


# ------------------------------------------------------------------- growing

def _reached(x: np.ndarray, tree: dict[int, Split], bins: np.ndarray, n_cat: int, begin=((1, None),)) -> Iterator[tuple[int, np.ndarray | None]]:
    """The nodes (heap number, root 1) at which rows end, with the numbers of their rows (None: all), from the nodes where they are."""
    open_: list[tuple[int, np.ndarray | None]] = list(begin)
    while open_:
        k, rows = open_.pop()
        s = tree.get(k)
        if s is None or s.feature == LEAF:
            yield k, rows
            continue
        v = x[s.feature] if rows is None else x[s.feature].take(rows)
        if s.feature < n_cat:
            left = v == s.cut
        else:
            left = v <= s.cut
            if s.missing_left:
                left |= v == bins[s.feature]
        for child, on in ((2 * k, left), (2 * k + 1, ~left)):
            at = np.flatnonzero(on) if rows is None else rows.take(np.flatnonzero(on))  # faster than by a mask
            if len(at):
                open_.append((child, at))


def _added(margin: np.ndarray, x: np.ndarray, trees, bins: np.ndarray, n_cat: int) -> np.ndarray:
    """Margins with the leaf values of ``trees``, in their order."""
    margin = margin.copy()
    for tree in trees:
        for k, rows in _reached(x, tree, bins, n_cat):
            margin[slice(None) if rows is None else rows] += tree[k].value
    return margin


def _gradients(y, w, margin, scale) -> tuple[np.ndarray, np.ndarray]:
    p = 1.0 / (1.0 + np.exp(-margin))
    return np.rint(w * (p - y) * scale).astype(np.int64), np.rint(w * p * (1.0 - p) * scale).astype(np.int64)


def _sums(block, tree, nodes: list[int], bins, offset, n_cat, scale) -> np.ndarray:
    """Sums of (rows, gradient, hessian) by (node of ``nodes``, all of one level; feature and bin)."""
    x, y, w, margin = block
    out = np.zeros((3, len(nodes), int(offset[-1])), np.int64)
    place = {k: i for i, k in enumerate(nodes)}
    for k, rows in _reached(x, tree, bins, n_cat):
        if k not in place:
            continue
        g, h = (v.astype(np.float64) for v in (_gradients(y, w, margin, scale) if rows is None else _gradients(y[rows], w[rows], margin[rows], scale)))
        for f in range(len(bins)):
            size = int(bins[f]) + 1
            key = x[f] if rows is None else x[f][rows]
            for i, v in enumerate((None, g, h)):
                # floats of whole numbers: a block's sums are below 2^53
                out[i, place[k], offset[f]: offset[f] + size] = np.rint(np.bincount(key, v, size)).astype(np.int64)
    return out


class Sides(NamedTuple):
    """The left sides of all splits, as places in the sums of a node: those of the slots
    ``begin`` to ``end``, and of ``missing`` (the slot behind all where missing values
    are on the right); those of feature f from ``of[f]`` on, in the order of :func:`candidates`."""

    begin: np.ndarray
    end: np.ndarray
    missing: np.ndarray
    cut: np.ndarray
    missing_left: np.ndarray
    of: np.ndarray


def sides(lay: Layout) -> Sides:
    none, parts, of = int(lay.offset[-1]), [], [0]
    for f in range(len(lay.bins)):
        a, b = int(lay.offset[f]), int(lay.offset[f] + lay.bins[f])
        at = np.arange(a, b)
        if f < len(lay.categorical):
            parts.append(np.array([at, at + 1, np.full(b - a, none), at - a, np.zeros(b - a, np.int64)]))
        else:
            cut, ones = at[:-1] - a, np.ones(b - a - 1, np.int64)
            parts.append(np.array([np.r_[a * ones, a * ones, a], np.r_[at[1:], at[1:], b], np.r_[none * ones, b * ones, none],
                                   np.r_[cut, cut, b - a - 1], np.r_[0 * ones, ones, 0]]))
        of.append(of[-1] + parts[-1].shape[1])
    begin, end, missing, cut, left = np.concatenate(parts, axis=1) if parts else np.zeros((5, 0), np.int64)
    return Sides(begin, end, missing, cut, left.astype(bool), np.array(of))


def best_splits(sums: np.ndarray, lay: Layout, every: Sides, p: Params, scale: float) -> list[Split]:
    """The split of each node that gains most (first feature, cut and missing side among
    equals), or a leaf; ``sums`` are those of (rows, gradient, hessian) by node, feature and bin."""
    whole = sums[:, :, int(lay.offset[0]): int(lay.offset[1])].sum(axis=2)  # any feature's bins hold all rows of the node
    rows, gs, hs = whole[0][:, None], whole[1][:, None] / scale, whole[2][:, None] / scale
    upto = np.zeros((3, sums.shape[1], sums.shape[2] + 1), np.int64)
    np.cumsum(sums, axis=2, out=upto[:, :, 1:])
    slots = np.concatenate([sums, np.zeros((3, sums.shape[1], 1), np.int64)], axis=2)
    nl, gl, hl = upto[:, :, every.end] - upto[:, :, every.begin] + slots[:, :, every.missing]
    gl, hl = gl / scale, hl / scale
    gr, hr = gs - gl, hs - hl
    gain = gl ** 2 / (hl + p.l2) + gr ** 2 / (hr + p.l2) - gs ** 2 / (hs + p.l2)
    gain[~((nl >= p.least_rows) & (rows - nl >= p.least_rows) & (hl >= LEAST_HESSIAN) & (hr >= LEAST_HESSIAN))] = -np.inf
    out = []
    for k in range(sums.shape[1]):
        best = (0.0, None)
        for f in range(len(lay.bins)):
            part = gain[k, every.of[f]: every.of[f + 1]]
            if len(part) and part[i := int(part.argmax())] > best[0] + 1e-12:
                best = (float(part[i]), (f, int(every.of[f]) + i))
        n, g, h = int(whole[0, k]), int(whole[1, k]) / scale, int(whole[2, k]) / scale
        if best[1] is None:
            out.append(Split(LEAF, 0, False, -p.rate * g / (h + p.l2), n, g, h))
            continue
        f, i = best[1]
        cut, missing = int(every.cut[i]), bool(every.missing_left[i])
        if f >= len(lay.categorical) and sums[0, k, int(lay.offset[f]) + int(lay.bins[f])] == 0:
            # none was missing here: later ones go with the larger side
            left = int(sums[0, k, lay.offset[f]: lay.offset[f] + cut + 1].sum())
            missing = 2 * left > n
        out.append(Split(f, cut, missing, 0.0, n, g, h))
    return out


def candidates(n, g, h, lay: Layout):
    """For each feature the left sides of all splits: (rows, gradient, hessian, cut, missing left)."""
    for f in range(len(lay.bins)):
        a, b = int(lay.offset[f]), int(lay.offset[f] + lay.bins[f])
        if f < len(lay.categorical):
            yield n[a:b], g[a:b], h[a:b], np.arange(b - a), np.zeros(b - a, bool)
        else:
            nl, gl, hl = (np.cumsum(v[a: b - 1]) for v in (n, g, h))
            cut, none = np.arange(len(nl)), np.zeros(len(nl), bool)
            if n[b]:  # missing values: on either side, and all others against them
                nl, gl, hl = (np.r_[c, c + v[b], v[a:b].sum()] for c, v in ((nl, n), (gl, g), (hl, h)))
                cut, none = np.r_[cut, cut, b - a - 1], np.r_[none, ~none, False]
            yield nl, gl, hl, cut, none


def _total(blocks: RDD, fn) -> np.ndarray:
    """Sum of ``fn`` over the blocks; over a tree of tasks where there are many partitions."""
    def local(it):
        total = None
        for b in it:
            s = fn(b)
            total = s if total is None else total + s
        return [] if total is None else [total]
    each = blocks.mapPartitions(local)
    if blocks.getNumPartitions() > 32:
        return each.treeReduce(lambda a, b: a + b, depth=2)
    return sum(each.collect())


class Model(NamedTuple):
    """Fitted trees over named features."""

    layout: Layout
    base: float
    trees: list[dict[int, Split]]


def _tree(total: Callable[[dict[int, Split], list[int]], np.ndarray], lay: Layout, every: Sides, params: Params, scale: float) -> dict[int, Split]:
    """One tree, level by level; ``total`` gives the sums of all rows at the named nodes of the tree so far."""
    tree: dict[int, Split] = {}
    sums: dict[int, np.ndarray] = {}
    rows: dict[int, int] = {}
    for level in range(params.depth):
        # of two children the one with fewer rows is summed; the other is what is left of their parent
        pairs = [(2 * k, 2 * k + 1) for k, s in tree.items() if s.feature != LEAF and k.bit_length() == level]
        nodes = [1] if level == 0 else [min(p, key=lambda k: (rows[k], k)) for p in pairs]
        if not nodes:
            break
        parents, sums = sums, dict(zip(nodes, np.moveaxis(total(tree, nodes), 1, 0)))
        for k in nodes if level else []:
            sums[k ^ 1] = parents[k >> 1] - sums[k]
        rows = {}
        for k, split in zip(sorted(sums), best_splits(np.stack([sums[k] for k in sorted(sums)], axis=1), lay, every, params, scale)):
            tree[k] = split
            if split.feature != LEAF:
                for child in (2 * k, 2 * k + 1):
                    rows[child] = _side(sums[k], split, child % 2 == 0, lay)[0]
    for k, s in list(tree.items()):
        if s.feature != LEAF and k.bit_length() == params.depth:
            for child in (2 * k, 2 * k + 1):
                n, g, h = _side(sums[k], s, child % 2 == 0, lay)
                g, h = g / scale, h / scale
                tree[child] = Split(LEAF, 0, False, -params.rate * g / (h + params.l2), n, g, h)
    return tree


def _nothing_left(tree: dict[int, Split]) -> bool:
    return tree[1].feature == LEAF and abs(tree[1].value) < 1e-12


def fit(df: DataFrame, categorical: list[str], numeric: list[str], categories: DataFrame, label: str = "y", weight: str = "w", params: Params = Params()) -> Model:
    """Boosted trees for a 0/1 ``label``. Null numerics are missing values, null
    and unlisted categories unknown ones. Rows without a label or weight must be
    left out before. ``categories`` is the table of :func:`category_table`."""
    spark = df.sparkSession
    lay = layout(df, categories, categorical, numeric, params.bins)
    blocks = binned(df, lay, categories, label, weight)
    shared_dir(spark)  # sets the checkpoint folder where none is set
    blocks = blocks.persist(StorageLevel.MEMORY_AND_DISK)
    base, scale, rows = _base(blocks)
    trees = _fit_in_one_stage(spark, blocks, lay, params, base, scale, rows)
    if trees is None:
        trees = _fit_by_jobs(blocks, lay, params, base, scale, rows)
    blocks.unpersist()
    return Model(lay, base, trees)


def _fit_by_jobs(blocks: RDD, lay: Layout, params: Params, base: float, scale: float, rows: int) -> list[dict[int, Split]]:
    """The trees; a job for each level of each."""
    bins, offset, n_cat, state, trees, kept = lay.bins, lay.offset, len(lay.categorical), blocks, [], 0
    every = sides(lay)
    if rows < BLOCK * blocks.getNumPartitions():
        state = blocks.coalesce(-(-rows // BLOCK))  # small steps: no more tasks than blocks
    later: list[dict[int, Split]] = [{1: Split(LEAF, 0, False, base, 0, 0.0, 0.0)}]  # trees not yet in the margins of ``state``

    def moved(b, trees):
        x, y, w, margin = b
        return x, y, w, _added(margin, x, trees, bins, n_cat)
    for t in range(params.rounds):
        before = None
        if len(later) == KEEP_EVERY or t == 0:
            before, state, later = state, state.map(lambda b, trees=tuple(later): moved(b, trees)).persist(StorageLevel.MEMORY_AND_DISK), []
            kept += 1
            if kept % CUT_EVERY == 0:
                state.checkpoint()

        def total(tree, nodes, state=state, trees=tuple(later)):
            return _total(state, lambda b: _sums(moved(b, trees), tree, nodes, bins, offset, n_cat, scale))
        tree = _tree(total, lay, every, params, scale)
        if before is not None:
            before.unpersist()
        trees.append(tree)
        later.append(tree)
        if _nothing_left(tree):
            break
    state.unpersist()
    return trees


class Unreachable(Exception):
    """The shared folder cannot be opened by the tasks, or is not the same for all."""


class Exchange:
    """Messages between the tasks of a barrier stage: files in a shared folder, each
    written beside its name and then moved there, so that it is read whole or not at all."""

    def __init__(self, folder: str, rank: int):
        from pyarrow import fs
        self.rank, self.wait = rank, FIRST_WORD
        try:
            self.fs, self.folder = fs.FileSystem.from_uri(folder)
            self.fs.create_dir(self.folder)
        except (OSError, pa.ArrowInvalid) as exc:
            raise Unreachable(folder) from exc
        self.there = fs.FileType.File

    def tell(self, name: str, what) -> None:
        with self.fs.open_output_stream(f"{self.folder}/_{name}-{self.rank}") as out:
            out.write(pickle.dumps(what, protocol=5))
        self.fs.move(f"{self.folder}/_{name}-{self.rank}", f"{self.folder}/{name}")

    def hear(self, name: str):
        path, pause, until = f"{self.folder}/{name}", 2e-4, time.monotonic() + self.wait
        while self.fs.get_file_info([path])[0].type != self.there:
            if time.monotonic() > until:
                raise Unreachable(path) if self.wait == FIRST_WORD else TimeoutError(path)
            time.sleep(pause)
            pause = min(pause * 1.3, 0.02)
        with self.fs.open_input_file(path) as f:
            return pickle.loads(f.readall())

    def forget(self, name: str) -> None:
        self.fs.delete_file(f"{self.folder}/{name}")


class Held:
    """A block with its gradients, and the nodes where its rows are in the tree that grows."""

    def __init__(self, block, lay: Layout, base: float, scale: float):
        self.x, self.y, self.w, margin = block
        self.lay, self.n_cat, self.scale, self.margin = lay, len(lay.categorical), scale, margin + base
        self.begin()

    def begin(self) -> None:
        g, h = _gradients(self.y, self.w, self.margin, self.scale)
        # whole numbers below 2^53 in a block's sums: rows are counted beside the hessians
        self.g, self.h_n = g.astype(np.float64), h.astype(np.float64) * (1 << COUNT_BITS) + 1.0
        self.at: list[tuple[int, np.ndarray | None]] = [(1, None)]

    def sums(self, tree: dict[int, Split], nodes: list[int]) -> np.ndarray:
        """As :func:`_sums`."""
        bins, offset = self.lay.bins, self.lay.offset
        out = np.zeros((3, len(nodes), int(offset[-1])), np.int64)
        self.at = list(_reached(self.x, tree, bins, self.n_cat, self.at))
        found = dict(self.at)
        there = [(i, found[k]) for i, k in enumerate(nodes) if k in found]
        if not there:
            return out
        if there[0][1] is None:
            x, g, h_n, node = self.x, self.g, self.h_n, 0
        else:  # the rows of all nodes at once
            rows = np.concatenate([r for _, r in there])
            x, g, h_n, node = self.x, self.g[rows], self.h_n[rows], np.repeat([i for i, _ in there], [len(r) for _, r in there])
        for f in range(len(bins)):
            size = int(bins[f]) + 1
            key = x[f].astype(np.intp) if there[0][1] is None else x[f][rows] + node * size
            here, shape = np.s_[:, offset[f]: offset[f] + size], (len(nodes), size)
            both = np.bincount(key, h_n, len(nodes) * size).astype(np.int64).reshape(shape)
            out[0][here], out[2][here] = both & ((1 << COUNT_BITS) - 1), both >> COUNT_BITS
            out[1][here] = np.bincount(key, g, len(nodes) * size).reshape(shape)
        return out

    def add(self, tree: dict[int, Split]) -> None:
        for k, rows in _reached(self.x, tree, self.lay.bins, self.n_cat, self.at):
            self.margin[slice(None) if rows is None else rows] += tree[k].value
        self.begin()


def _rounds(blocks, folder: str, lay: Layout, params: Params, base: float, scale: float, fan_in: int) -> list[list[dict[int, Split]]]:
    """What a task of the barrier stage does: the first one grows the trees and says what
    it needs the sums of, the others answer. Gives the trees in the first task, if all could be reached."""
    context = BarrierTaskContext.get()
    rank, size = context.partitionId(), len(context.getTaskInfos())
    below = [r for r in range(fan_in * rank + 1, fan_in * rank + fan_in + 1) if r < size]
    held = [Held(b, lay, base, scale) for b in blocks]
    attempt = context.allGather(str(context.taskAttemptId()))[0]  # a stage that is run again has a folder of its own

    def answer(step: int, added, tree, nodes) -> np.ndarray:
        if added:
            for b in held:
                b.add(added)
        out = np.zeros((3, len(nodes), int(lay.offset[-1])), np.int64)
        for b in held:
            out += b.sums(tree, nodes)
        for r in below:
            out += exchange.hear(f"{step}-{r}")
            exchange.forget(f"{step}-{r}")
        exchange.wait = LATER_WORD
        return out
    exchange = None
    try:
        exchange = Exchange(f"{folder}/{attempt}", rank)
        if rank:
            for step in itertools.count():
                said = exchange.hear(f"{step}")
                if said is None:
                    return []
                exchange.tell(f"{step}-{rank}", answer(step, *said))
        trees: list[dict[int, Split]] = []
        steps, every, added = itertools.count(), sides(lay), None

        def total(tree, nodes):
            nonlocal added
            step = next(steps)
            exchange.tell(f"{step}", (added, tree, nodes))
            out = answer(step, added, tree, nodes)
            exchange.forget(f"{step}")  # all have read it
            added = None
            return out
        for _ in range(params.rounds):
            added = _tree(total, lay, every, params, scale)
            trees.append(added)
            if _nothing_left(added):
                break
        exchange.tell(f"{next(steps)}", None)
        return [trees]
    except Unreachable:
        if exchange and not rank:
            exchange.tell("1", None)  # those who heard the first word need not wait
        return []


def _fit_in_one_stage(spark, blocks: RDD, lay: Layout, params: Params, base: float, scale: float, rows: int) -> list[dict[int, Split]] | None:
    """The trees, from one barrier stage; None where there cannot be one."""
    conf = spark.sparkContext.getConf()
    # all tasks have to run at once: as many as there are cores
    slots = spark.sparkContext.defaultParallelism
    if conf.get("spark.default.parallelism", None) or conf.get("spark.dynamicAllocation.enabled", "false") == "true":
        return None
    tasks = max(1, min(slots, -(-rows // BLOCK)))
    row = len(lay.bins) * np.min_scalar_type(int(lay.bins.max(initial=0))).itemsize + 64  # label, weight, margin, gradients, row numbers
    if -(-rows // tasks) * row > TASK_BYTES:
        return None  # each step has work enough to be a job
    folder = scratch_path(spark, "rounds")
    fan_in = FAN_IN
    # the blocks of a partition are dealt in turn
    dealt = blocks.mapPartitionsWithIndex(lambda i, it: ((i + k, b) for k, b in enumerate(it))).partitionBy(tasks, lambda i: i).values()
    got = dealt.barrier().mapPartitions(lambda it: _rounds(it, folder, lay, params, base, scale, fan_in)).collect()  # the first task's trees
    return got[0] if got else None


def _side(sums: np.ndarray, s: Split, left: bool, lay: Layout) -> list[int]:
    """Sums of (rows, gradient, hessian) of one side of a split node."""
    a, b = int(lay.offset[s.feature]), int(lay.offset[s.feature] + lay.bins[s.feature])
    out = []
    for v in sums:
        if s.feature < len(lay.categorical):
            inside = int(v[a + s.cut])
        else:
            inside = int(v[a: a + s.cut + 1].sum()) + (int(v[b]) if s.missing_left else 0)
        out.append(inside if left else int(v[a: b + 1].sum()) - inside)
    return out


def _base(blocks: RDD) -> tuple[float, float, int]:
    """Log odds of the weighted share of class 1, the scale of integer gradients, and the rows."""
    got = blocks.map(lambda b: (float(b[2].sum()), float((b[1] * b[2]).sum()), float(b[2].max(initial=0.0)), len(b[1]))).collect()  # four numbers a block
    weights, positive = sum(x[0] for x in got), sum(x[1] for x in got)
    if not weights > 0:
        raise ValueError("no rows to train on")
    share = min(max(positive / weights, 1e-9), 1 - 1e-9)
    # rounded: the order in which weights are added must not show
    bits = SCALE_BITS - int(np.ceil(np.log2(max(1.0, max(x[2] for x in got)))))
    return float(np.round(np.log(share / (1 - share)), 9)), 2.0 ** bits, sum(x[3] for x in got)


def root_candidates(df: DataFrame, categorical: list[str], numeric: list[str], categories: DataFrame, label: str, weight: str, params: Params) -> DataFrame:
    """All splits of the first tree's root: feature, category, cut, n_left, g_left, h_left, gain (null where a side is too small)."""
    lay = layout(df, categories, categorical, numeric, params.bins)
    bins, offset, n_cat = lay.bins, lay.offset, len(categorical)
    blocks = binned(df, lay, categories, label, weight).persist(StorageLevel.MEMORY_AND_DISK)
    base, scale, _ = _base(blocks)
    n, g, h = (s[0] for s in _total(blocks, lambda b: _sums((b[0], b[1], b[2], b[3] + base), {}, [1], bins, offset, n_cat, scale)))
    blocks.unpersist()
    at = slice(int(offset[0]), int(offset[1]))
    rows, gs, hs = int(n[at].sum()), int(g[at].sum()) / scale, int(h[at].sum()) / scale
    out = []
    for f, (nl, gl, hl, cut, _) in enumerate(candidates(n, g, h, lay)):
        for i in range(len(cut)):
            a, b = gl[i] / scale, hl[i] / scale
            fits = nl[i] >= params.least_rows and rows - nl[i] >= params.least_rows and min(b, hs - b) >= LEAST_HESSIAN
            gain = a ** 2 / (b + params.l2) + (gs - a) ** 2 / (hs - b + params.l2) - gs ** 2 / (hs + params.l2)
            out.append((lay.names[f], int(cut[i]) if f < n_cat else None, None if f < n_cat else float(lay.cuts[f - n_cat][cut[i]]),
                        int(nl[i]), float(a), float(b), float(gain) if fits else None))
    found = df.sparkSession.createDataFrame(out, "feature string, code int, cut double, n_left bigint, g_left double, h_left double, gain double")
    return found.join(categories.withColumnRenamed("value", "category"), ["feature", "code"], "left").select(
        "feature", "category", "cut", "n_left", "g_left", "h_left", "gain")


# ------------------------------------------------------------- trees as rows

TREE_SCHEMA = "tree int, node int, feature string, category string, cut double, missing_left boolean, value double, n bigint, g double, h double"


def tree_rows(model: Model, categories: DataFrame) -> list[tuple]:
    """One row per node (``TREE_SCHEMA``). Only categories that a split names are looked up."""
    lay, n_cat = model.layout, len(model.layout.categorical)
    used = {(lay.categorical[s.feature], s.cut) for t in model.trees for s in t.values() if 0 <= s.feature < n_cat}
    name = {}
    if used:
        wanted = categories.sparkSession.createDataFrame(sorted(used), "feature string, code int")
        name = {(r["feature"], r["code"]): r["value"] for r in categories.join(F.broadcast(wanted), ["feature", "code"]).collect()}  # at most one a split
    out = [(-1, 1, None, None, None, False, model.base, 0, 0.0, 0.0)]
    for t, tree in enumerate(model.trees):
        for k in sorted(tree):
            s = tree[k]
            if s.feature == LEAF:
                out.append((t, k, None, None, None, False, float(s.value), s.n, s.g, s.h))
            elif s.feature < n_cat:
                out.append((t, k, lay.categorical[s.feature], name[lay.categorical[s.feature], s.cut], None, False, 0.0, s.n, s.g, s.h))
            else:
                cuts = lay.cuts[s.feature - n_cat]
                # the last bin has no upper end: all values against the missing ones
                cut = float(cuts[s.cut]) if s.cut < len(cuts) else float("inf")
                out.append((t, k, lay.numeric[s.feature - n_cat], None, cut, s.missing_left, 0.0, s.n, s.g, s.h))
    return out


class Scorer:
    """Probability of class 1 from the rows of a model."""

    def __init__(self, rows: list[tuple], categorical: list[str], numeric: list[str]):
        self.names, self.n_cat = categorical + numeric, len(categorical)
        place = {c: i for i, c in enumerate(self.names)}
        self.codes: list[dict[str, int]] = [{} for _ in categorical]
        size = 1 + max((r[1] for r in rows), default=1)
        n = 1 + max((r[0] for r in rows), default=-1)
        self.feature, self.cut = np.full((n, size), LEAF), np.zeros((n, size))
        self.missing, self.value = np.zeros((n, size), bool), np.zeros((n, size))
        self.base = 0.0
        for tree, node, feature, category, cut, missing, value, *_ in rows:
            if tree < 0:
                self.base = value
            elif feature is None:
                self.value[tree, node] = value
            else:
                f = place[feature]
                self.feature[tree, node] = f
                self.missing[tree, node] = missing
                self.cut[tree, node] = self.codes[f].setdefault(category, len(self.codes[f])) if f < self.n_cat else cut

    def probabilities(self, columns: list[pa.Array]) -> np.ndarray:
        n, k = len(columns[0]), len(self.names)
        x = np.empty((n, k))
        for f, c in enumerate(columns):
            if f < self.n_cat:
                d = c.dictionary_encode()
                code = np.array([self.codes[f].get(v, -1) for v in d.dictionary.to_pylist()] + [-1], np.float64)
                x[:, f] = code[d.indices.fill_null(len(code) - 1).to_numpy()]
            else:
                x[:, f] = c.to_numpy(zero_copy_only=False).astype(np.float64)
        flat, rows = x.ravel(), np.arange(n) * k
        margin = np.full(n, self.base)
        for t in range(len(self.feature)):
            node = np.ones(n, np.int64)
            for _ in range(int(np.log2(self.feature.shape[1]))):
                f = self.feature[t][node]
                on = f >= 0
                if not on.any():
                    break
                v, c = flat[rows + np.maximum(f, 0)], self.cut[t][node]
                left = np.where(f < self.n_cat, v == c, np.where(np.isnan(v), self.missing[t][node], v <= c))
                node = np.where(on, 2 * node + ~left, node)
            margin = margin + self.value[t][node]
        return 1.0 / (1.0 + np.exp(-margin))


def probability(scorer: Scorer, categorical: list[Column], numeric: list[Column]) -> Column:
    """Probability column from the feature columns, in the scorer's order."""
    @F.arrow_udf("double")
    def score(*columns: pa.Array) -> pa.Array:
        return pa.array(scorer.probabilities(list(columns)))
    return score(*[c.cast("string") for c in categorical], *[c.cast("double") for c in numeric])
