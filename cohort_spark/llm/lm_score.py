"""Scoring texts with a hierarchical Pitman-Yor language model.

A restaurant for each context serves words. A context is the whole word before,
or the begin of the text. New tables of the contexts of one class (a hash of
the last three bytes of the word before, one of ``CONTEXTS`` classes, or the
begin) are customers of the restaurant of the class, and new tables of the
classes are customers of the one parent restaurant they share, whose base is
uniform over the training vocabulary and one slot for all other words.
Seatings are sampled by Gibbs: in each round every customer of every restaurant
is taken out and seated anew, all of a dish together (drawn from all ways to seat
them) or, where these are more than eight, an eighth at a time, and in the
restaurants below too when a table appears or goes. After the burn-in the seating of every few
rounds is a sample; a word's probability is the average of its predictive
probabilities over the samples, and a text's score is the sum of their base-10
logarithms.

How it is spread. Texts are dealt into groups of bounded size. A group sends
its distinct (word, word before) pairs with their training counts, sorted and
packed, to the shards of the words (a hash), so what is shuffled is
pre-aggregated and follows the input. A shard holds all contexts of its words,
so it seats them without asking others: class and parent counts of a word are
its own, and the totals of each restaurant, which a round needs only as a
factor, are estimated from its share of the words. It answers each group with
counts and sampled tables of the words asked for, and adds its part to the
exact totals of each sample: those of the classes and of the parent are a few
numbers that all groups get; the tables of a word's own context are summed in
the shard of that word, which sends them to the groups that hold it. With
these the groups work out the probabilities and score their texts. No
vocabulary is collected or broadcast, and no word or context is left out.

Tokens: words ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case, then one end.
Words are identified by 64-bit hashes, words before by 56 bits of theirs and
the class. Defined cases: a null text is the empty
text (its end is scored); with nothing to learn from, every token has the base
probability 1; a null id is learned from and not held out; repeated rows are
counted and scored each; extra columns are ignored; an empty table gives an
empty result."""

from __future__ import annotations

import collections
import functools
import math
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import arrays as A
from .frames import ship, written

CONTEXTS = 128
BEGIN = CONTEXTS
END = A.U64(0x454E445F4F465F54)
#: Bytes of text of a group, and of the texts behind a shard's words.
GROUP_BYTES = 8 << 20
#: Discounts and strengths of the word contexts, of their classes and of the parent.
WORD_DISCOUNT, WORD_STRENGTH = 0.75, 1.0
DISCOUNT, STRENGTH = 0.75, 2.0
PARENT_DISCOUNT, PARENT_STRENGTH = 0.6, 2.0
BURN_IN, SAMPLES, APART = 6, 3, 3
#: Up to so many customers of a dish are seated anew together, more in so many pieces.
PIECES = 8


def _pack(*arrays: np.ndarray) -> bytes:
    """Rows of integers go as their steps, with the sign last; all integers in as
    few bytes as the largest needs, byte by byte place (high bytes are mostly zero)."""
    import zstandard
    out = []
    for a in arrays:
        kind, steps = a.dtype, a.ndim > 1 and a.dtype.kind in "iu" and a.dtype.itemsize > 2
        if steps:
            x = np.ascontiguousarray(a).view(f"i{kind.itemsize}")
            x = np.concatenate([x[:1], x[1:] - x[:-1]])
            x = ((x << 1) ^ (x >> (8 * kind.itemsize - 1))).view(f"u{kind.itemsize}")
        else:
            x = np.ascontiguousarray(a)
        if x.dtype.kind == "u":
            x = x.astype(np.min_scalar_type(x.max(initial=0)), copy=False)
        out.append((kind.str, a.shape, steps, x.dtype.str, x.reshape(-1).view(np.uint8).reshape(-1, x.itemsize).T.tobytes()))
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(out, protocol=5))


def _unpack(data: bytes) -> tuple[np.ndarray, ...]:
    import zstandard
    out = []
    for kind, shape, steps, narrow, planes in pickle.loads(zstandard.ZstdDecompressor().decompress(data)):
        kind, narrow = np.dtype(kind), np.dtype(narrow)
        x = np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(narrow.itemsize, -1).T).reshape(-1).view(narrow).reshape(shape)
        if steps:
            x = x.astype(f"u{kind.itemsize}")
            x = ((x >> 1).view(f"i{kind.itemsize}") ^ -(x & 1).view(f"i{kind.itemsize}"))
            for i in range(1, len(x)):
                x[i] += x[i - 1]
            x = x.view(kind)
        out.append(x.astype(kind, copy=False))
    return tuple(out)


_LOWER = np.arange(256, dtype=np.uint32)
_LOWER[65:91] += 32


def tokens(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and context of every token, and the number of tokens of each text."""
    raw, offsets = A.text_buffers(column)
    words, contexts, sizes = [], [], []
    for i, j in A.chunks(offsets):
        o = offsets[i: j + 1]
        piece = raw[o[0]: o[-1]]
        h, starts, ends, first = A.word_hashes(piece, o - o[0], lower=True)
        kind = np.zeros(len(h), np.uint32)
        for back in (1, 2, 3):
            at = ends - back
            kind = kind * np.uint32(257) + np.where(at >= starts, _LOWER[piece[np.maximum(at, 0)]] + 1, 0).astype(np.uint32) if len(h) else kind
        kind = ((kind * np.uint32(0x9E3779B1)) >> np.uint32(25)).astype(np.uint8)  # 7 bits
        n = np.diff(first)
        text = np.repeat(np.arange(len(n)), n)
        at = np.arange(len(h)) + text
        tok = np.full(len(h) + len(n), END, np.uint64)
        tok[at] = h
        ctx = np.full(len(tok), BEGIN, np.uint8)
        ctx[at + 1] = kind  # each word is followed by a word or an end
        words.append(tok)
        contexts.append(ctx)
        sizes.append(n + 1)
    if not words:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint8), np.zeros(0, np.int64)
    return np.concatenate(words), np.concatenate(contexts), np.concatenate(sizes)


def _short(words: np.ndarray) -> np.ndarray:
    """56 bits of the hash of a word, which name it as a context."""
    return words >> A.U64(8)


def _shard(short: np.ndarray, shards: int) -> np.ndarray:
    return (A.mix(short) % A.U64(shards)).astype(np.int64)


def _ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers begin, begin + 1, ... of each range."""
    return np.arange(size.sum()) + np.repeat(begin - np.cumsum(size) + size, size)


def _encode(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order and the number of each value, for values that repeat often."""
    d = pa.array(x).dictionary_encode()
    values = d.dictionary.to_numpy()
    order = np.argsort(values)
    number = np.empty(len(order), np.int64)
    number[order] = np.arange(len(order))
    return values[order], number[d.indices.to_numpy()]


class Pairs:
    """Distinct words of a group and their distinct contexts, both in order.
    With ``grams`` also the distinct words before in each pair of word and
    class; the words are then those of whole texts, one after the other."""

    def __init__(self, words: np.ndarray, contexts: np.ndarray, grams: bool = False):
        self.words, number = _encode(words)
        keys = number * 256 + contexts
        if not grams:
            self.keys, self.of = np.unique(keys, return_inverse=True)
            self.of = self.of.ravel()
        else:
            n = max(1, len(self.words))
            found, of = np.unique(keys * n + np.roll(number, 1), return_inverse=True)  # the end of a text comes before the next
            self.gram_of, self.before, keys = of.ravel(), found % n, found // n
            first = np.ones(len(keys), bool)
            first[1:] = keys[1:] != keys[:-1]
            self.keys, self.pair = keys[first], np.cumsum(first) - 1
            self.first = np.append(np.flatnonzero(first), len(keys))
        self.word = self.keys >> 8

    def by_shard(self, shards: int):
        """For each shard its words and its pairs (numbers, in order)."""
        shard = _shard(_short(self.words), shards)
        word_order, pair_order = np.argsort(shard, kind="stable"), np.argsort(shard[self.word], kind="stable")
        w = np.searchsorted(shard[word_order], np.arange(shards + 1))
        p = np.searchsorted(shard[self.word][pair_order], np.arange(shards + 1))
        for s in range(shards):
            if w[s] < w[s + 1]:
                yield s, word_order[w[s]: w[s + 1]], pair_order[p[s]: p[s + 1]]

    def grams(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many words come before each of these pairs, and the numbers of the three together."""
        size = self.first[pairs + 1] - self.first[pairs]
        return size, _ranges(self.first[pairs], size)


def _requests(table: pa.Table, shards: int):
    """For each shard: its words, the number of contexts of each, the contexts,
    the customers these have besides those that word contexts send (none), the
    number of words before in each, and these (steps of the distinct ones,
    places among them) with their training counts."""
    tok, ctx, size = tokens(table["text"])
    pairs = Pairs(tok, ctx, grams=True)
    count = np.bincount(pairs.gram_of, weights=np.repeat(table["train"].to_numpy(), size), minlength=len(pairs.pair)).astype(np.uint32)
    short = _short(pairs.words)
    for s, w, p in pairs.by_shard(shards):
        local = np.searchsorted(w, pairs.word[p])  # numbers are rising in both
        n, g = pairs.grams(p)
        before, place = np.unique(pairs.before[g], return_inverse=True)  # in order of the words' hashes
        yield s, _pack(pairs.words[w], np.bincount(local, minlength=len(w)).astype(np.uint8 if CONTEXTS < 255 else np.uint16),
                       (pairs.keys[p] & 255).astype(np.uint8), np.zeros(len(p), np.uint8), _narrow(n),
                       np.diff(short[before], prepend=A.U64(0)), _narrow(place.ravel()), count[g])


_NONE = np.zeros(0, np.int64)


@functools.lru_cache
def _seatings(customers: int, discount: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All sizes that the tables of a dish with so many customers can have: the weight of
    each way but for that of its new tables, its tables, and where its sizes begin in the last array."""
    def ways(n, most):
        if not n:
            yield ()
        for k in range(min(n, most), 0, -1):
            yield from ((k, *rest) for rest in ways(n - k, k))
    every = list(ways(customers, customers))
    alike = [math.prod(map(math.factorial, collections.Counter(w).values())) for w in every]
    weight = [math.factorial(customers) / x * math.prod(math.prod(j - discount for j in range(1, k)) / math.factorial(k) for k in w) for w, x in zip(every, alike)]
    tables = np.array([len(w) for w in every])
    return np.array(weight), tables, np.cumsum(tables) - tables, np.array([k for w in every for k in w])


def _swept(size, number, count, weight, discount, random):
    """Sizes of tables and their numbers after all customers of each dish, which has more
    than ``PIECES`` of them, were taken out once and seated anew: in so many pieces, in
    proportion to the tables.

    Of the seats of a piece, the odds that one is at a new table are those of Gibbs
    sampling for the last one, ``weight / (n - discount * tables)``; an earlier one with i
    others there also weighs that a table more leaves less to those that follow,
    ``((i - discount * tables) / (n - discount * tables)) ** discount``."""
    if not len(count):
        return size, number
    number = number.copy()
    # of each table: size, the place of the first of its customers in the dish, and one past the last; none of new tables
    end = np.cumsum(size) + np.repeat(random.integers(0, PIECES, len(count)) - np.cumsum(count) + count, number)
    at = np.array([size, end - size, end])
    ends = np.cumsum(number)
    for back in range(PIECES - 1, -1, -1):
        first = ends - number
        out = (at[2] + back) // PIECES - (at[1] + back) // PIECES
        people = np.add.reduceat(out, first)
        at[0] -= out
        empty = np.searchsorted(ends, np.flatnonzero(at[0] == 0), side="right")
        which = np.flatnonzero(people)
        m, n = people[which], (count - people)[which]
        here = (number - np.bincount(empty, minlength=len(number)))[which]
        alone = here == 0  # all are out: the first one gets a table
        n, here, m = n + alone, here + alone, m - alone
        middle, last = n + (m - 1) / 2 - discount * here, count[which] - 1 - discount * here
        odds = weight[which]
        several = np.flatnonzero(m > 1)
        odds[several] *= (middle[several] / last[several]) ** discount
        share = np.where(m > 0, odds / (odds + middle), 0.0)
        new = (random.random(len(which)) < share).astype(np.int64)
        new[several] = random.binomial(m[several], share[several])
        _join(at[0], number, ends, which[~alone], (m - new)[~alone], discount, random)
        new += alone
        got = np.flatnonzero(new)
        if len(got):
            dishes = np.repeat(which[got], new[got])
            place = ends[dishes]
            at = np.insert(at, place, 0, axis=1)
            place += np.arange(len(place))
            at[0, place] = 1
            # whoever came to a dish without tables is with its first one
            begins = place[np.cumsum(new[got]) - new[got]]
            at[0, begins[alone[got]]] += (m + 1 - new)[got][alone[got]]
            number[which[got]] += new[got]
            ends = np.cumsum(number)
    gone = np.searchsorted(ends, np.flatnonzero(at[0] == 0), side="right")
    return at[0][at[0] > 0], number - np.bincount(gone, minlength=len(number))


def _join(size, number, ends, which, people, discount, random) -> None:
    """``people`` customers of each dish in ``which`` (rising) sit down at tables that are there,
    with probability proportional to the customers of a table less the discount."""
    there = people > 0
    which, people = which[there], people[there]
    number, ends = number[which], ends[which]
    one = number == 1
    size[ends[one] - 1] += people[one]
    hot = ~one & (people > 256) & (people > 16 * number)
    for end, k, many in zip(ends[hot].tolist(), number[hot].tolist(), people[hot].tolist()):
        w = np.where(size[end - k: end] > 0, size[end - k: end] - discount, 0.0)
        size[end - k: end] += random.multinomial(many, w / w.sum())
    rest = np.flatnonzero(~one & ~hot)
    if len(rest):
        ends, number, people = ends[rest], number[rest], people[rest]
        tables = _ranges(ends - number, number)  # of these dishes only
        w = size[tables] - discount
        w[w < 0] = 0.0
        upto = np.concatenate([[0.0], np.cumsum(w)])
        last = np.cumsum(number)
        low, high = upto[last - number], upto[last]
        at = np.searchsorted(upto, np.repeat(low, people) + random.random(people.sum()) * np.repeat(high - low, people), side="right") - 1
        at = np.clip(at, np.repeat(last - number, people), np.repeat(last - 1, people))
        lost = w[at] == 0
        if lost.any():  # rounding must not seat anybody at a table that is no longer there
            dish = np.repeat(np.arange(len(rest)), people)[lost]
            for i, d in zip(np.flatnonzero(lost).tolist(), dish.tolist()):
                at[i] = last[d] - number[d] + int(np.argmax(w[last[d] - number[d]: last[d]]))
        size[tables] += np.bincount(at, minlength=len(tables))


class Tables:
    """Tables of dishes with customers, in order of the dishes, one size for each
    table; a subclass says what weight a new table of each dish has."""

    discount: float

    def __init__(self, count: np.ndarray, tables: np.ndarray, random: np.random.Generator):
        """Tables of nearly equal sizes."""
        self.count, self.number, self.random = count.astype(np.int64), tables, random
        place = np.arange(tables.sum()) - np.repeat(np.cumsum(tables) - tables, tables)
        self.size = np.repeat(self.count // tables, tables) + (place < np.repeat(self.count % tables, tables))

    @property
    def dish(self) -> np.ndarray:
        """The dish of each table."""
        return np.repeat(np.arange(len(self.number)), self.number)

    def open(self) -> np.ndarray:
        """Weight of a new table of each dish."""
        raise NotImplementedError

    def tables(self) -> np.ndarray:
        return self.number.copy()

    def _pick(self, which, weight, total):
        """A table of each dish in ``which``, with probability proportional to ``weight``."""
        end = np.cumsum(self.number)[which]
        upto = np.empty(len(weight) + 1)
        upto[0] = 0.0
        np.cumsum(weight, out=upto[1:])
        begin = end - self.number[which]
        at = np.searchsorted(upto, upto[begin] + self.random.random(len(which)) * total, side="right") - 1
        return np.clip(at, begin, end - 1)

    def _seat(self, people, sit, stand):
        """People (their dishes, in order) sit down; the dishes that got a table."""
        new = self.random.random(len(people)) * (sit + stand) >= sit
        join = people[~new]
        np.add.at(self.size, self._pick(join, self.size - self.discount, sit[~new]), 1)
        new = people[new]
        self.size = np.insert(self.size, np.cumsum(self.number)[new], 1)
        np.add.at(self.number, new, 1)
        return new

    def sweep(self, left=_NONE, come=_NONE):
        """Customers of dishes go and come, any number of one dish; then all customers
        of each dish are taken out and seated anew. The dishes that have fewer tables
        then, and those that have more, as often."""
        weight, was = self.open(), self.number
        net = np.bincount(come, minlength=len(self.count)) - np.bincount(left, minlength=len(self.count))
        self.count = self.count + net
        many = self.count > PIECES  # the others are drawn whole, wherever they were
        some = Some(self, many, weight)
        some.follow(net[many])
        self.number, drawn = np.minimum(self.count, 1), []
        for n in range(2, PIECES + 1):
            which, (ways, tables, first, parts) = np.flatnonzero(self.count == n), _seatings(n, self.discount)
            chance = np.cumsum(ways * (weight[which, None] ** np.arange(1, n + 1))[:, tables - 1], axis=1)
            way = (chance <= self.random.random((len(which), 1)) * chance[:, -1:]).sum(axis=1)
            self.number[which] = tables[way]
            drawn.append((which, parts[_ranges(first[way], tables[way])]))
        size, self.number[many] = _swept(some.size, some.number, some.count, some.weight, self.discount, self.random)
        self.size = np.ones(self.number.sum(), np.int64)
        self.size[np.repeat(many, self.number)] = size
        ends = np.cumsum(self.number)
        for which, size in drawn:
            self.size[_ranges(ends[which] - self.number[which], self.number[which])] = size
        more = self.number - was
        return np.repeat(np.arange(len(more)), np.maximum(-more, 0)), np.repeat(np.arange(len(more)), np.maximum(more, 0))

    def _draw(self, out) -> np.ndarray:
        """The tables of ``out`` customers of each dish, drawn at random."""
        upto, ends = np.cumsum(self.size), np.cumsum(self.count)
        begin = ends - self.count
        many = np.flatnonzero(2 * out > self.count)  # drawn from a list of all
        person = np.repeat(begin[many] - np.cumsum(self.count[many]) + self.count[many], self.count[many]) + np.arange(self.count[many].sum())
        dish = np.repeat(np.arange(len(many)), self.count[many])
        person = person[np.argsort(dish + self.random.random(len(dish)))]  # in order of the dishes still
        drawn = [person[np.arange(len(dish)) - np.searchsorted(dish, dish) < out[many][dish]]]
        few, need = _NONE, np.where(2 * out > self.count, 0, out)
        while need.any():  # drawn again while somebody is drawn twice
            which = np.flatnonzero(need)
            dish = np.repeat(which, need[which])
            few = np.union1d(few, begin[dish] + (self.random.random(len(dish)) * self.count[dish]).astype(np.int64))
            need[which] = out[which] - (np.searchsorted(few, ends[which]) - np.searchsorted(few, begin[which]))
        return np.searchsorted(upto, np.concatenate([*drawn, few]), side="right")



class Some(Tables):
    """Some dishes of a restaurant, whose customers go and come."""

    def __init__(self, of: Tables, which: np.ndarray, weight: np.ndarray):
        self.discount, self.random, self.weight = of.discount, of.random, weight[which]
        self.size, self.number, self.count = of.size[np.repeat(which, of.number)], of.number[which], of.count[which]

    def open(self):
        return self.weight

    def follow(self, net) -> None:
        """``net`` customers of each dish have come (gone, if negative): those that go are
        drawn at random, those that come sit down in turns of an eighth of those there."""
        if not net.any():
            return
        out, into = np.maximum(-net, 0), np.maximum(net, 0)
        self.count = self.count - net
        np.subtract.at(self.size, self._draw(out), 1)
        self.count -= out
        gone = np.searchsorted(np.cumsum(self.number), np.flatnonzero(self.size == 0), side="right")
        self.size = self.size[self.size > 0]
        np.subtract.at(self.number, gone, 1)
        while into.any():
            which = np.flatnonzero(into)
            many = np.minimum(into[which], np.maximum(1, self.count[which] // 8))
            people = np.repeat(which, many)
            self._seat(people, (self.count - self.discount * self.number)[people], self.weight[people])
            self.count[which] += many
            into[which] -= many


class Parent(Tables):
    """The parent restaurant, of the words of one shard."""

    discount = PARENT_DISCOUNT

    def __init__(self, customers: np.ndarray, share: float, random: np.random.Generator):
        self.share = share
        super().__init__(customers, np.clip(np.rint(customers ** PARENT_DISCOUNT), 1, customers).astype(np.int64), random)

    def open(self):
        weight = (PARENT_STRENGTH + PARENT_DISCOUNT * len(self.size) * self.share) / (len(self.count) * self.share + 1)
        return np.broadcast_to(weight, self.count.shape)

    def probability(self):
        return (self.count - PARENT_DISCOUNT * self.number + self.open()) / (PARENT_STRENGTH + self.count.sum() * self.share)


class Seating(Tables):
    """Class restaurants of the words of one shard. Dishes are (word, class)
    pairs with customers, in order."""

    discount = DISCOUNT

    def __init__(self, word: np.ndarray, context: np.ndarray, count: np.ndarray, words: int, share: float, seed: int):
        self.word, self.context, self.share = word, context, share
        total = np.bincount(context, weights=count, minlength=CONTEXTS + 1) * share
        of_word = np.bincount(word, weights=count, minlength=words)
        rate = np.maximum((STRENGTH + DISCOUNT * 0.5 * total[context]) * of_word[word] / max(1.0, total.sum()), 1e-9)
        tables = np.clip(np.rint(rate * np.log1p(count / rate)), 1, count).astype(np.int64)
        super().__init__(count, tables, np.random.default_rng(seed))
        self.below = Parent(np.bincount(word, weights=tables, minlength=words).astype(np.int64), share, self.random)

    def parent(self):
        """Customers and tables of each word in the parent."""
        return self.below.count, self.below.number

    def open(self):
        total = np.bincount(self.context, weights=self.number, minlength=CONTEXTS + 1) * self.share
        return (STRENGTH + DISCOUNT * total)[self.context] * self.below.probability()[self.word]

    def probability(self):
        """Predictive probability of each dish."""
        total = np.bincount(self.context, weights=self.count, minlength=CONTEXTS + 1) * self.share
        return (self.count - DISCOUNT * self.number + self.open()) / (STRENGTH + total)[self.context]

    def round(self, left=_NONE, come=_NONE):
        """Customers that word contexts send go and come; then all customers
        are taken out and seated anew, in the parent too."""
        gone, new = self.sweep(left, come)
        self.below.sweep(self.word[gone], self.word[new])


class Leaves(Tables):
    """Restaurants of the words before, over the class restaurants of a
    shard's words. Dishes are (word, word before) with two customers or more; one
    customer alone always has one table. ``direct``: customers that the
    classes have of themselves."""

    discount = WORD_DISCOUNT

    def __init__(self, pair, before, count, direct, word, context, words: int, share: float, seed: int):
        several = count >= 2
        self.pair, self.before, self.several, self.share = pair[several], before[several], several, share
        # tables of each word before: those of one customer, and all
        self.alone = np.bincount(before[~several], minlength=before.max(initial=0) + 1)
        of_word = np.bincount(word, weights=direct, minlength=words) + np.bincount(word[pair], weights=count, minlength=words)
        count, self.number = count[several], np.ones(len(self.pair), np.int64)
        rate = np.maximum(self._factor() * of_word[word[self.pair]] / max(1.0, of_word.sum() * share), 1e-9)
        tables = np.clip(np.rint(rate * np.log1p(count / rate)), 1, count).astype(np.int64)
        super().__init__(count, tables, np.random.default_rng(seed + 1_000_003))
        customers = direct + np.bincount(pair, weights=self.all_tables(), minlength=len(word)).astype(np.int64)
        self.below = Seating(word, context, customers, words, share, seed)

    def all_tables(self) -> np.ndarray:
        """Tables of all dishes, those of one customer too."""
        out = np.ones(len(self.several), np.int64)
        out[self.several] = self.number
        return out

    def _factor(self):
        """Weight of a new table of each dish, but for its probability: the tables of the
        word before at other words are estimated from those of the shard."""
        of = self.alone + np.bincount(self.before, weights=self.number, minlength=len(self.alone))
        return WORD_STRENGTH + WORD_DISCOUNT * (self.number + (of[self.before] - self.number) * self.share)

    def open(self):
        return self._factor() * self.base

    def round(self):
        """All customers are taken out and seated anew, here and in the restaurants below."""
        self.base = self.below.probability()[self.pair]
        left, come = self.sweep()
        self.below.round(self.pair[left], self.pair[come])


def _narrow(x: np.ndarray) -> np.ndarray:
    """Counts in 32 bits where all of them fit, else in 64."""
    return x.astype(np.uint32) if x.max(initial=0) < 1 << 32 else x.astype(np.int64)


def _distinct(parts: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Distinct values of all parts, in order, and their numbers in each part."""
    found, number = _encode(np.concatenate(parts))
    return found, np.split(number, np.cumsum([len(p) for p in parts])[:-1])


def _serve(table: pa.Table, shards: int):
    """Merge the counts of a shard, sample its seatings, answer each group."""
    groups, asked = table["grp"].to_pylist(), [_unpack(b) for b in table["data"].to_pylist()]
    shard = table["shard"][0].as_py()
    if len(asked[0]) == 4:  # without words before
        asked = [(*a, np.zeros(len(a[2]), np.uint8), np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.uint32)) for a in asked]
    words, place = _distinct([a[0] for a in asked])
    pair, pairs = _distinct([np.repeat(p, a[1]).astype(np.int64) * 256 + a[2] for p, a in zip(place, asked)])
    before, befores = _distinct([np.cumsum(a[5], dtype=np.uint64) for a in asked])
    gram, grams = _distinct([np.repeat(p, a[4]) * max(1, len(before)) + b[a[6]] for p, b, a in zip(pairs, befores, asked)])
    merged = lambda numbers, n, i: np.bincount(np.concatenate(numbers), weights=np.concatenate([a[i] for a in asked]), minlength=n).astype(np.int64)
    direct, count = merged(pairs, len(pair), 3), merged(grams, len(gram), 7)
    gram_pair, gram_before = gram // max(1, len(before)), gram % max(1, len(before))
    of_pair = direct + np.bincount(gram_pair, weights=count, minlength=len(pair)).astype(np.int64)
    of_word = np.bincount(pair >> 8, weights=of_pair, minlength=len(words)).astype(np.int64)
    # what has training counts is seated
    met, known = np.flatnonzero(count), np.flatnonzero(of_pair)
    seen, word = np.unique(pair[known] >> 8, return_inverse=True)
    word, context = word.ravel(), pair[known] & 255
    leaves = Leaves(np.searchsorted(known, gram_pair[met]), gram_before[met], count[met], direct[known], word, context, len(seen), float(shards), shard)
    seating = leaves.below
    t, own, full = np.zeros((SAMPLES, len(gram)), np.int64), np.zeros((SAMPLES, 2, len(pair)), np.int64), np.zeros((SAMPLES, 2, len(words)), np.int64)
    for _ in range(BURN_IN - APART):
        leaves.round()
    for s in range(SAMPLES):
        for _ in range(APART):
            leaves.round()
        t[s, met] = leaves.all_tables()
        own[s, 0, known], own[s, 1, known] = seating.count, seating.number
        full[s, 0, seen], full[s, 1, seen] = seating.parent()
    count, t, own, full, heads = _narrow(count), _narrow(t), _narrow(own), _narrow(full), _narrow(of_word)
    for g, p, q, r in zip(groups, place, pairs, grams):
        more = (count[r], t[:, r]) if len(gram) else ()
        yield g, shard, _pack(heads[p], full[:, :, p], own[:, 0][:, q], own[:, 1][:, q], *more)
    # part of the totals: per sample customers and tables of each class, and the parent's tables; words and tokens
    totals = [np.bincount(pair & 255, weights=own[s, i], minlength=CONTEXTS + 1) for i in (0, 1) for s in range(SAMPLES)]
    yield TOTALS, shard, _pack(np.array(totals), full[:, 1].sum(axis=1, dtype=np.int64), np.array([len(seen), of_word.sum()]))
    if len(gram):
        # parts of the tables of each word before, to the shards of these words; and who asked this one for which words
        part = np.array([np.bincount(gram_before, weights=x, minlength=len(before)) for x in t]).astype(np.int64)
        to = np.where(part.any(axis=0), _shard(before, shards), -1)
        order = np.argsort(to, kind="stable")
        at = np.searchsorted(to[order], np.arange(shards + 1))
        for s in range(shards):
            if at[s] < at[s + 1]:
                mine = order[at[s]: at[s + 1]]
                yield PARTS, s, _pack(np.diff(before[mine], prepend=A.U64(0)), _narrow(part[:, mine]))
        yield ASKED, shard, _pack(words, np.array(groups), *[np.diff(p, prepend=0).astype(np.uint32) for p in place])


#: In place of a group: totals, parts of the tables of words before, and the words that each group asked for.
TOTALS, PARTS, ASKED = -1, -2, -3


def _words_before(table: pa.Table):
    """Tables of the context of each word, summed in the word's shard, to the groups that hold it."""
    kind, data = table["grp"].to_numpy(), table["data"].to_pylist()
    shard = table["shard"][0].as_py()
    words, groups, *steps = _unpack(data[int(np.flatnonzero(kind == ASKED)[0])])
    short = _short(words)
    total = np.zeros((SAMPLES, len(words)), np.int64)
    for i in np.flatnonzero(kind == PARTS):
        before, part = _unpack(data[i])
        at = np.cumsum(before, dtype=np.uint64)
        total[:, np.searchsorted(short, at)] += part  # a word before is a word of its group
    total = total[:, np.searchsorted(short, short)]
    for g, step in zip(groups.tolist(), steps):
        yield g, ~shard, _pack(_narrow(total[:, np.cumsum(step, dtype=np.int64)]))


class Totals:
    """Totals of all restaurants, from the parts of the shards."""

    def __init__(self, parts: list[tuple[np.ndarray, ...]]):
        self.contexts = sum((p[0] for p in parts), np.zeros((2 * SAMPLES, CONTEXTS + 1)))
        self.parent_tables = sum((p[1].astype(float) for p in parts), np.zeros(SAMPLES))
        self.vocabulary, self.tokens = (int(x) for x in sum((p[2] for p in parts), np.zeros(2, np.int64)))

    def _of_sample(self, s, context, count, tables, customers, parent_tables):
        """Predictive probability of each (word, class) pair."""
        of = self.contexts[SAMPLES + s]
        open_ = PARENT_STRENGTH + PARENT_DISCOUNT * self.parent_tables[s]
        base = (customers - PARENT_DISCOUNT * parent_tables + open_ / (self.vocabulary + 1)) / (PARENT_STRENGTH + of.sum())
        return (count - DISCOUNT * tables + (STRENGTH + DISCOUNT * of[context]) * base) / (STRENGTH + self.contexts[s][context])

    def probability(self, context, count, tables, customers, parent_tables):
        """Average predictive probability of each (word, class) pair."""
        count = np.broadcast_to(count, (SAMPLES, len(context)))
        return sum(self._of_sample(s, context, count[s], tables[s], customers[s], parent_tables[s]) for s in range(SAMPLES)) / SAMPLES

    def gram_probability(self, pairs: Pairs, of_word, parent, count, tables, gram_count, gram_tables, before_tables):
        """Average predictive probability of each word after each word before."""
        context, out = pairs.keys & 255, np.zeros(len(pairs.pair))
        for s in range(SAMPLES):
            base = self._of_sample(s, context, count[s], tables[s], parent[s, 0][pairs.word], parent[s, 1][pairs.word])
            open_ = WORD_STRENGTH + WORD_DISCOUNT * before_tables[s]
            out += (gram_count - WORD_DISCOUNT * gram_tables[s] + open_[pairs.before] * base[pairs.pair]) / (WORD_STRENGTH + of_word)[pairs.before]
        return out / SAMPLES


def _answered(pairs: Pairs, answers: pa.Table, shards: int):
    """The numbers of a group's words, pairs and words before, from the answers of all shards."""
    given = {s: b for s, b in zip(answers["shard"].to_pylist(), answers["data"].to_pylist())}
    n_w, n_p, n_g = len(pairs.words), len(pairs.keys), len(pairs.pair)
    of_word, parent, before_tables = np.zeros(n_w, np.int64), np.zeros((SAMPLES, 2, n_w)), np.zeros((SAMPLES, n_w))
    count, tables, gram_count, gram_tables = np.zeros((SAMPLES, n_p)), np.zeros((SAMPLES, n_p)), np.zeros(n_g), np.zeros((SAMPLES, n_g))
    for s, w, p in pairs.by_shard(shards):
        _, g = pairs.grams(p)
        of_word[w], parent[:, :, w], count[:, p], tables[:, p], gram_count[g], gram_tables[:, g] = _unpack(given[s])
        before_tables[:, w], = _unpack(given[~s])
    return of_word, parent, count, tables, gram_count, gram_tables, before_tables


def _score(texts: pa.Table, answers: pa.Table, shards: int, totals: Totals):
    tok, ctx, size = tokens(texts["text"])
    pairs = Pairs(tok, ctx, grams=True)
    of_word, *more = _answered(pairs, answers, shards)
    prob = totals.gram_probability(pairs, of_word, *more)
    mine = of_word[pairs.word[pairs.pair]]
    base = np.log10((mine + 0.5) / (totals.tokens + 0.5 * (totals.vocabulary + 1)))
    at = np.concatenate([[0], np.cumsum(size)])[:-1]
    add = lambda x: np.add.reduceat(x[pairs.gram_of], at)  # noqa: E731  each text has a token at least
    return size, add((mine > 0).astype(np.int64)), add(base), add(np.log10(prob))


def _bundles(batches):
    """Rows of a batch of one group as one value, compressed."""
    options = pa.ipc.IpcWriteOptions(compression="zstd")
    for b in batches:
        grp = b.column("grp").to_numpy()
        order = np.argsort(grp, kind="stable")
        ends = np.append(np.flatnonzero(np.diff(grp[order])) + 1, len(order))
        rows, data, begin = b.select(["doc_id", "text", "train"]), [], 0
        for end in ends if len(order) else []:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.schema, options=options) as out:
                out.write_batch(rows.take(pa.array(order[begin:end])))
            data.append(sink.getvalue().to_pybytes())
            begin = end
        yield pa.record_batch([pa.array(grp[order][ends - 1] if len(order) else [], pa.int32()), pa.array(data, pa.binary())], names=["grp", "data"])


def _texts(bundles: pa.Table) -> pa.Table:
    return pa.concat_tables([pa.ipc.open_stream(b).read_all() for b in bundles["data"].to_pylist()])


def score(docs: DataFrame, train: Column, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """One row per document: doc_id, train, n_tokens, n_known, train_tokens,
    base_score, score; learned from the rows for which ``train`` holds."""
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
                        F.coalesce(train, F.lit(True)).alias("train"))
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b"), F.count(F.lit(1)).alias("n")).first()
    groups = shards = max(1, -(-(size["b"] + 8 * size["n"]) // group_bytes))
    texts = texts.withColumn("grp", F.pmod(F.xxhash64("doc_id", "text"), F.lit(groups)).cast("int"))
    ship(docs.sparkSession)
    bundles = texts.select("grp", "doc_id", "text", "train").mapInArrow(_bundles, "grp int, data binary")

    def ask(t: pa.Table) -> pa.Table:
        rows = list(_requests(_texts(t), shards))
        return pa.table([pa.array([s for s, _ in rows], pa.int32()), pa.array([t["grp"][0].as_py()] * len(rows), pa.int32()), pa.array([b for _, b in rows], pa.binary())],
                        names=["shard", "grp", "data"])

    def serve(t: pa.Table) -> pa.Table:
        rows = list(_serve(t, shards))
        return pa.table([pa.array([g for g, _, _ in rows], pa.int32()), pa.array([s for _, s, _ in rows], pa.int32()), pa.array([b for _, _, b in rows], pa.binary())],
                        names=["grp", "shard", "data"])

    def sum_up(t: pa.Table) -> pa.Table:
        rows = list(_words_before(t))
        return pa.table([pa.array([g for g, _, _ in rows], pa.int32()), pa.array([s for _, s, _ in rows], pa.int32()), pa.array([b for _, _, b in rows], pa.binary())],
                        names=["grp", "shard", "data"])
    asked = bundles.groupBy("grp").applyInArrow(ask, "shard int, grp int, data binary")
    served = written(asked.groupBy("shard").applyInArrow(serve, "grp int, shard int, data binary"), "served", free=True)
    parts = served.where(F.col("grp") == TOTALS).select("data")
    answers = served.where("grp >= 0").unionAll(served.where(F.col("grp").isin(PARTS, ASKED)).groupBy("shard").applyInArrow(sum_up, "grp int, shard int, data binary"))
    # sums of fixed length: one row for each shard, added up in the tasks

    def add(batches):
        got = [_unpack(x) for b in batches for x in b.column("data").to_pylist()]
        if got:
            t = Totals(got)
            yield pa.record_batch([pa.array([_pack(t.contexts, t.parent_tables, np.array([t.vocabulary, t.tokens]))], pa.binary())], names=["data"])
    totals = Totals([_unpack(r["data"]) for r in parts.mapInArrow(add, "data binary").collect()])  # one row for each task
    fields = "doc_id bigint, train boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"

    def work(t: pa.Table, a: pa.Table) -> pa.Table:
        if not t.num_rows:
            return pa.table([pa.array([], x) for x in (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())],
                            names=["doc_id", "train", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
        t = _texts(t)
        n, known, base, own = _score(t, a, shards, totals)
        return pa.table([t["doc_id"], t["train"], pa.array(n.astype(np.int64)), pa.array(known), pa.array(np.full(len(n), totals.tokens)), pa.array(base), pa.array(own)],
                        names=["doc_id", "train", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
    return bundles.groupBy("grp").cogroup(answers.groupBy("grp")).applyInArrow(work, fields)
