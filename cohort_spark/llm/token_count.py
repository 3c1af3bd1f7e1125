"""Word-piece counts by a linear longest-match automaton.

The vocabulary is held as a trie over bytes. Every node has a failure link
and the number of pieces that are popped when it is followed, both computed
once, breadth first: from a node that is a piece itself the link leads to the
root and pops it; otherwise it leads where the parent's link can go on with
the same byte, popping what that path pops. Greedy longest-match-first lengths
then take one pass over the bytes of a word, without going back and without
building a piece. Lengths of words met before are kept in a table of bounded
size in each Python worker.

The vocabulary is that of a byte-level tokenizer file, which has all 256
bytes, so that every word can be cut; a word is counted as it stands after a
space, as such files mark the begin of words. A word that cannot be cut with
a given vocabulary counts as one (unknown) piece.

Defined cases: null and empty texts have no words and no pieces; a text of
any length is counted whole; repeated rows are counted each; extra columns
are ignored; an empty table gives an empty result."""

from __future__ import annotations

import json
from collections import deque
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays as A
from .frames import map_arrow

#: Words whose lengths are kept in a worker, and the longest that is kept.
KEPT_WORDS, KEPT_BYTES = 1 << 18, 64


def byte_letters() -> dict[str, int]:
    """The letters that byte-level tokenizer files use for the 256 bytes:
    printable ones stand for themselves, the others for letters from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {chr(b): b for b in shown}
    for b in range(256):
        if b not in shown:
            out[chr(256 + len(out) - len(shown))] = b
    return out


def read_vocabulary(path: str) -> list[bytes]:
    """The pieces of a byte-level tokenizer file as bytes, without its special tokens."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    letters, special = byte_letters(), {t["content"] for t in spec.get("added_tokens", [])}
    return [bytes(letters[c] for c in t) for t in spec["model"]["vocab"] if t not in special]


class Automaton:
    """Greedy longest-match lengths in one pass."""

    def __init__(self, pieces: list[bytes]):
        go: dict[int, int] = {}  # node * 256 + byte -> node
        final = [False]
        for p in pieces:
            node = 0
            for c in p:
                key = node << 8 | c
                if key not in go:
                    go[key] = len(final)
                    final.append(False)
                node = go[key]
            if node:
                final[node] = True
        children: list[list[tuple[int, int]]] = [[] for _ in final]
        for key, child in go.items():
            children[key >> 8].append((key & 255, child))
        link, pops = [-1] * len(final), [0] * len(final)
        todo = deque([0])
        while todo:
            parent = todo.popleft()
            for c, node in children[parent]:
                todo.append(node)
                if final[node]:
                    link[node], pops[node] = 0, 1
                    continue
                at, n = link[parent], pops[parent]
                while at >= 0 and (at << 8 | c) not in go:
                    n += pops[at]
                    at = link[at]
                if at >= 0:
                    link[node], pops[node] = go[at << 8 | c], n
        self.go, self.link, self.pops = go, link, pops

    def length(self, word: bytes) -> int:
        """Pieces of ``word``; 1 if it cannot be cut."""
        go, link, pops = self.go, self.link, self.pops
        node = n = 0
        for c in word:
            to = go.get(node << 8 | c)
            while to is None:
                n += pops[node]
                node = link[node]
                if node < 0:
                    return 1
                to = go.get(node << 8 | c)
            node = to
        while node:
            n += pops[node]
            node = link[node]
            if node < 0:
                return 1
        return n


class Lengths(dict):
    """Lengths of words after a space, kept up to a bound."""

    def __init__(self, automaton: Automaton):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: bytes) -> int:
        n = self.automaton.length(b" " + word)
        if len(word) <= KEPT_BYTES:
            if len(self) >= KEPT_WORDS:
                self.clear()
            self[word] = n
        return n


@lru_cache(maxsize=2)
def lengths(path: str) -> Lengths:
    return Lengths(Automaton(read_vocabulary(path)))


def default_vocabulary() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def count_tokens(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """One row per document: doc_id, n_words, n_tokens.

    ``vocabulary``: path of a byte-level tokenizer file that every executor has."""
    path = vocabulary or default_vocabulary()

    def run(batch):
        of = lengths(path)
        words, tokens = [], []
        raw, offsets = A.text_buffers(batch.column("text"))
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            w = raw[a:b].tobytes().split()
            words.append(len(w))
            tokens.append(sum(map(of.__getitem__, w)))
        yield pa.record_batch([batch.column("doc_id"), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())],
                              names=["doc_id", "n_words", "n_tokens"])
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_arrow(texts, run, "doc_id bigint, n_words bigint, n_tokens bigint")
