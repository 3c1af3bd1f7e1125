"""Language identification by sparse multinomial logistic regression.

Features are character n-grams (1 to 3 letters with the word's borders, lower
case, everything but letters as border) hashed to a fixed number of slots and
weighted by TF-IDF: share of the text's n-grams times inverse document
frequency. Document frequencies are counted over all training rows. The
weights are learned with follow-the-regularised-leader (per-coordinate rates,
L1 and L2 penalties, so most are exactly 0), and a temperature is then fitted
on rows kept apart, so that the score is a calibrated probability.

The model is fitted on a bounded sample of the labelled rows: ``sample_rows``
of them, the same number expected for each language, drawn by a hash of the
id; document frequencies, predictions and scores cover all rows and whole
texts. The sample is trained in one task, whose input that bound limits; the
weights reach the tasks as one array whose size the slots and languages fix.

Defined cases: a null text, and one without a letter, is ``und`` with score 0;
rows without a language are not learned from; with nothing to learn from,
every row is ``und``; ties go to the language that comes first by name;
repeated rows count as often as they occur; extra columns are ignored; an
empty table gives an empty result."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import arrays as A
from .frames import map_arrow

SLOT_BITS = 17
SLOTS = 1 << SLOT_BITS
#: Bytes of text whose n-grams are made at once.
PART = 1 << 19


@lru_cache(maxsize=1)
def _folded() -> np.ndarray:
    """Lower-case letter of each code point of the first plane, 0 for what is no letter."""
    out = np.zeros(1 << 16, np.uint32)
    for c in range(1 << 16):
        s = chr(c)
        if s.isalpha():
            out[c] = ord(s.lower()[0])
    return out


def _fold(points: np.ndarray) -> np.ndarray:
    low = points < (1 << 16)
    out = _folded()[np.where(low, points, 0)]
    for c in np.unique(points[~low]).tolist():
        if chr(c).isalpha():
            out[points == c] = ord(chr(c).lower()[0])
    return out


def ngrams(raw: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each order the slots of all n-grams and the text that each is from (rising)."""
    n = len(offsets) - 1
    points = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), "<u4")
    begins = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    count = np.diff(begins[offsets])
    text = np.repeat(np.arange(n), count)
    line = np.zeros(len(points) + n + 1, np.uint32)  # a border before each text and at the end
    owner = np.zeros(len(line), np.int64)
    at = np.arange(len(points)) + text + 1
    line[at] = _fold(points)
    owner[at] = text
    letter = line != 0
    keep = letter.copy()
    keep[0] = True
    keep[1:] |= letter[:-1]  # of several borders the first
    c, owner, letter = line[keep], owner[keep], letter[keep]
    k1, k2, k3 = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D)
    shift = np.uint32(32 - SLOT_BITS)
    one = c * k1
    out = [((one[letter] * k3) >> shift, owner[letter])]
    if len(c) > 1:
        two = (one[:-1] ^ (one[:-1] >> np.uint32(15))) * k2 + c[1:] * k3
        out.append((((two ^ (two >> np.uint32(13))) * k1) >> shift, np.where(letter[:-1], owner[:-1], owner[1:])))
    if len(c) > 2:
        three = (two[:-1] ^ (two[:-1] >> np.uint32(16))) * k1 + c[2:] * k2
        inner = letter[1:-1]
        out.append((((three ^ (three >> np.uint32(14))) * k3)[inner] >> shift, owner[1:-1][inner]))
    return out


def _parts(column):
    """First row, rows, and n-grams of each part of a text column."""
    raw, offsets = A.text_buffers(column)
    for i, j in A.chunks(offsets, PART):
        o = offsets[i: j + 1]
        yield i, j, ngrams(raw[o[0]: o[-1]], o - o[0])


def _by_text(grams, n: int):
    """Slots of each text, all orders together."""
    cuts = [(s, np.searchsorted(t, np.arange(n + 1))) for s, t in grams]
    for r in range(n):
        yield np.concatenate([s[c[r]: c[r + 1]] for s, c in cuts])


def _document_frequencies(rows: DataFrame) -> tuple[np.ndarray, int]:
    """In how many texts each slot occurs, and the number of texts."""
    def run(batch):
        df = np.zeros(SLOTS, np.int64)
        for i, j, grams in _parts(batch.column("text")):
            for slots in _by_text(grams, j - i):
                seen = np.zeros(SLOTS, bool)
                seen[slots] = True
                df += seen
        at = np.flatnonzero(df)
        yield pa.record_batch([pa.array(np.append(at, -1)), pa.array(np.append(df[at], batch.num_rows))], names=["slot", "n"])
    got = map_arrow(rows.select("text"), run, "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()  # at most SLOTS + 1 rows
    slot, n = got["slot"].to_numpy(), got["n"].to_numpy()
    df = np.zeros(SLOTS, np.int64)
    df[slot[slot >= 0]] = n[slot >= 0]
    return df, int(n[slot < 0].sum())


def _vectors(sample: DataFrame, idf: np.ndarray) -> DataFrame:
    """TF-IDF vectors of the sampled rows."""
    def run(batch):
        for i, j, grams in _parts(batch.column("text")):
            out = []
            for r, slots in enumerate(_by_text(grams, j - i)):
                if len(slots):
                    s, n = np.unique(slots, return_counts=True)
                    x = (SCALE * n / len(slots) * idf[s]).astype("<f4")
                    out.append((i + r, s.astype("<i4").tobytes(), x.tobytes()))
            if out:
                rows, s, x = zip(*out)
                rows = pa.array(rows)
                yield pa.record_batch([batch.column("lang").take(rows), batch.column("order").take(rows), pa.array(s, pa.binary()), pa.array(x, pa.binary())],
                                      names=["lang", "order", "slots", "weights"])
    return map_arrow(sample.select("lang", "order", "text"), run, "lang string, order bigint, slots binary, weights binary")


#: Factor that brings TF-IDF vectors to a length of about 1.
SCALE = 20.0


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def learn(rows: list[tuple[str, np.ndarray, np.ndarray]], langs: list[str], epochs: int = 3, alpha: float = 0.5, beta: float = 0.1,
          l1: float = 1e-3, l2: float = 1e-3) -> np.ndarray:
    """Weights (slots, languages) by follow-the-regularised-leader, row by row."""
    number = {c: k for k, c in enumerate(langs)}
    z, n = np.zeros((SLOTS, len(langs))), np.zeros((SLOTS, len(langs)))

    def weights(zs, ns):
        return np.where(np.abs(zs) <= l1, 0.0, -(zs - np.sign(zs) * l1) / ((beta + np.sqrt(ns)) / alpha + l2))
    for _ in range(epochs):
        for lang, s, x in rows:
            zs, ns = z[s], n[s]
            w = weights(zs, ns)
            p = _softmax(x @ w)
            p[number[lang]] -= 1
            g = x[:, None] * p
            g2 = g * g
            z[s] = zs + g - (np.sqrt(ns + g2) - np.sqrt(ns)) / alpha * w
            n[s] = ns + g2
    return weights(z, n).astype(np.float32)


def temperature(logits: np.ndarray, truth: np.ndarray) -> float:
    """The divisor of the logits with the least log loss, by golden section on its logarithm."""
    if not len(truth):
        return 1.0

    def loss(t):
        p = _softmax(logits / np.exp(t))
        return -np.log(np.maximum(p[np.arange(len(truth)), truth], 1e-300)).mean()
    a, b, r = -4.0, 4.0, (np.sqrt(5) - 1) / 2
    c, d = b - r * (b - a), a + r * (b - a)
    for _ in range(50):
        if loss(c) <= loss(d):
            b, d = d, c
            c = b - r * (b - a)
        else:
            a, c = c, d
            d = a + r * (b - a)
    return float(np.exp((a + b) / 2))


def _train(vectors: DataFrame, langs: list[str]) -> DataFrame:
    """(lang, temperature, slots, weights): the weights that are not 0."""
    def run(batches):
        rows = []
        for b in batches:
            rows += [(o, c, np.frombuffer(s, "<i4"), np.frombuffer(x, "<f4").astype(float)) for c, o, s, x in
                     zip(*(b.column(k).to_pylist() for k in ("lang", "order", "slots", "weights")))]
        rows.sort(key=lambda r: (r[0], r[1], len(r[2])))
        fit, apart = [r[1:] for r in rows if r[0] % 5], [r[1:] for r in rows if r[0] % 5 == 0]
        w = learn(fit or apart, langs)
        logits = np.array([x @ w[s] for _, s, x in apart]).reshape(len(apart), len(langs))
        t = temperature(logits, np.array([langs.index(c) for c, _, _ in apart], int))
        for k, c in enumerate(langs):
            at = np.flatnonzero(w[:, k])
            yield pa.record_batch([pa.array([c]), pa.array([t]), pa.array([at.astype("<i4").tobytes()], pa.binary()), pa.array([w[at, k].astype("<f4").tobytes()], pa.binary())],
                                  names=["lang", "temperature", "slots", "weights"])
    return vectors.repartition(1).mapInArrow(run, "lang string, temperature double, slots binary, weights binary")


def identify(docs: DataFrame, learn_from: Column, sample_rows: int = 4000, carry: bool = False) -> DataFrame:
    """One row per document: doc_id, lang_pred, score (and ``row``, the whole
    input row as a struct, if ``carry``); learned from the rows for which
    ``learn_from`` holds and lang is not null."""
    row = [F.struct("*").alias("row")] if carry else []
    rows = docs.select(*row, F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       F.col("lang").cast("string").alias("lang"), learn_from.alias("learn_from"))
    kept = [c for c in ("doc_id", "row") if c in rows.columns]
    known = rows.where("learn_from and lang is not null and text is not null")
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}  # one row for each language
    langs = sorted(counts)
    w = np.zeros((SLOTS, max(1, len(langs))), np.float32)
    t = 1.0
    if langs:
        df, n = _document_frequencies(known)
        idf = np.log((1 + n) / (1 + df)) + 1
        share = F.create_map(*[x for c in langs for x in (F.lit(c), F.lit(min(1.0, sample_rows / len(langs) / counts[c])))])
        order = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 40))
        sample = known.withColumn("order", order).where(F.col("order") < F.element_at(share, F.col("lang")) * float(1 << 40))
        got = _train(_vectors(sample, idf), langs).collect()
        for r in got:
            w[np.frombuffer(r["slots"], "<i4"), langs.index(r["lang"])] = np.frombuffer(r["weights"], "<f4")
            t = r["temperature"]
        w *= idf[:, None].astype(np.float32) * SCALE

    def run(batch):
        for i, j, grams in _parts(batch.column("row").field("text").cast(pa.string()) if carry else batch.column("text")):
            n = j - i
            total, size = np.zeros((n, w.shape[1])), np.zeros(n, np.int64)
            for slots, text in grams:
                first = np.searchsorted(text, np.arange(n + 1))
                size += np.diff(first)
                full = np.flatnonzero(np.diff(first))
                for k in range(0, w.shape[1], 8) if len(full) else ():
                    total[full, k: k + 8] += np.add.reduceat(w[slots, k: k + 8], first[full], axis=0, dtype=np.float64)
            p = _softmax(total / np.maximum(size, 1)[:, None] / t)
            best = p.argmax(axis=1)
            fit = (size > 0) & bool(langs)
            yield pa.record_batch([*(batch.column(c).slice(i, n) for c in kept), pa.array([langs[k] if f else "und" for k, f in zip(best.tolist(), fit.tolist())], pa.string()),
                                   pa.array(np.where(fit, p[np.arange(n), best], 0.0))], names=[*kept, "lang_pred", "score"])
    out = T.StructType([rows.schema[c] for c in kept]).add("lang_pred", "string").add("score", "double")
    return map_arrow(rows.select(*kept) if carry else rows.select(*kept, "text"), run, out)
