"""Benchmark decontamination with a generalised suffix automaton of the test items.

The automaton is built over the normalised words of all items of a block. Training words stream through it and the
longest matching length is tracked: where it reaches a window (10 words, or a whole shorter item) the words of that
window are hit. A word pair that no item holds resets the automaton to its root, so whole runs of such pairs are skipped
by an array look-up before the automaton is walked; the result is the same.

Items are dealt into blocks of at most `block_words` words, which bounds the broadcast (about 750 bytes a word); each
block is one more pass over the documents, and their hits are united.

Edge cases: null texts have no words. Items without a word have no window. Rows of documents that repeat are each
reported. Items that repeat an id count once.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rewritten

#: Bytes of words: digits, letters and all beyond ASCII; A-Z fold to a-z, the rest separates.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
WINDOW = 10
#: Pairs of words are looked up in a table of so many bits' index.
PAIR_BITS = 22
WORD = re.compile(rb"[^ ]+")


def words_of(text: str | None) -> list[bytes]:
    """The normalised words of a text."""
    return text.encode("utf-8", "replace").translate(FOLD).split() if text else []


class Automaton:
    """Generalised suffix automaton over items' word numbers, with the windows that end in each state."""

    def __init__(self, items: list[tuple[object, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        coded = [(key, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]) for key, words in items if words]
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.items = [-1], [0], [set()]
        for key, numbers in coded:
            last = 0
            for n in numbers:
                last = self._extend(last, n)
        short = [dict() for _ in self.next]
        for key, numbers in coded:
            state = 0
            for n in numbers:
                state = self.next[state][n]
                at = state
                while at > 0 and key not in self.items[at]:
                    self.items[at].add(key)
                    at = self.link[at]
            if len(numbers) < window:
                short[state].setdefault(len(numbers), set()).add(key)
        self.short: list[tuple[tuple[int, frozenset], ...]] = [()] * len(self.next)
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            self.short[state] = (*self.short[self.link[state]], *((n, frozenset(k)) for n, k in short[state].items()))
        self.least = min([window, *(len(x) for _, x in coded)])
        self.pairs = np.zeros(1 << PAIR_BITS, bool)
        for _, numbers in coded:
            a = np.array(numbers, np.int64)
            self.pairs[self._slot(a[:-1], a[1:])] = True

    def _extend(self, last: int, n: int) -> int:
        """Append a word after the state `last`; states of earlier items are shared."""
        if (to := self.next[last].get(n)) is not None:
            return to if self.length[to] == self.length[last] + 1 else self._clone(last, n, to)
        new = self._state(self.length[last] + 1, {}, 0)
        at = last
        while at >= 0 and n not in self.next[at]:
            self.next[at][n] = new
            at = self.link[at]
        if at >= 0:
            to = self.next[at][n]
            self.link[new] = to if self.length[to] == self.length[at] + 1 else self._clone(at, n, to)
        return new

    def _clone(self, at: int, n: int, to: int) -> int:
        new = self._state(self.length[at] + 1, dict(self.next[to]), self.link[to])
        self.link[to] = new
        while at >= 0 and self.next[at].get(n) == to:
            self.next[at][n] = new
            at = self.link[at]
        return new

    def _state(self, length: int, following: dict[int, int], link: int) -> int:
        self.next.append(following)
        self.link.append(link)
        self.length.append(length)
        self.items.append(set())
        return len(self.next) - 1

    @staticmethod
    def _slot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a * 1_000_003 + b) & ((1 << PAIR_BITS) - 1)

    def matches(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Hit word ranges [start, end) in order, and the items whose windows occur."""
        number = self.vocabulary.get
        coded = np.array([number(w, -1) for w in words], np.int64)
        known = coded >= 0
        if not known.any():
            return [], set()
        paired = known[:-1] & known[1:]
        at = np.flatnonzero(paired)
        paired[at] = self.pairs[self._slot(coded[at], coded[at + 1])]
        edges = np.flatnonzero(np.diff(np.r_[False, paired, False]))
        runs = [(a, b + 1) for a, b in edges.reshape(-1, 2).tolist() if b - a + 1 >= self.least]
        if self.least == 1:  # items of one word: the words outside runs count too
            inside = np.zeros(len(coded) + 1, np.int64)
            for a, b in runs:
                inside[a] += 1
                inside[b] -= 1
            runs = sorted([*runs, *((i, i + 1) for i in np.flatnonzero(known & (np.cumsum(inside[:-1]) == 0)).tolist())])
        ranges: list[tuple[int, int]] = []
        items: set = set()
        for a, b in runs:
            state = length = 0
            for i, n in enumerate(coded[a:b].tolist(), a + 1):
                while state and n not in self.next[state]:
                    state = self.link[state]
                    length = self.length[state]
                if (to := self.next[state].get(n)) is not None:
                    state, length = to, length + 1
                best = 0
                if length >= self.window:
                    best, at = self.window, state
                    while self.length[self.link[at]] >= self.window:
                        at = self.link[at]
                    items |= self.items[at]
                for size, keys in self.short[state]:
                    if size <= length:
                        best = max(best, size)
                        items |= keys
                if best:
                    if ranges and ranges[-1][1] >= i - best:
                        ranges[-1] = (min(ranges[-1][0], i - best), i)
                    else:
                        ranges.append((i - best, i))
        return ranges, items


def blocks_of(items: DataFrame, block_words: int) -> Iterator[list[tuple[object, list[bytes]]]]:
    """Items in blocks of at most so many words (an item larger than that is a block), streamed to the driver."""
    block, held = [], 0
    for row in items.select("item_id", "text").orderBy("item_id").toLocalIterator():
        words = words_of(row["text"])
        if block and held + len(words) > block_words:
            yield block
            block, held = [], 0
        block.append((row["item_id"], words))
        held += len(words)
    yield block


def hits(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_words: int = 200_000) -> DataFrame:
    """The columns of docs, then n_words, ranges (array of word ranges hit) and items (ids, as strings, sorted)."""
    docs = docs.drop("n_words", "ranges", "items")
    names = docs.columns
    at = names.index("text")
    out = docs.withColumns({"n_words": F.lit(0).cast("long"), "ranges": F.array().cast("array<struct<a:int,b:int>>"), "items": F.array().cast("array<string>")})
    for block in blocks_of(items, block_words):
        automaton = docs.sparkSession.sparkContext.broadcast(Automaton(block, window))

        def run(batches, automaton=automaton):
            own = automaton.value
            for batch in batches:
                cols = list(batch.columns)
                before_ranges, before_items = cols[-2].to_pylist(), cols[-1].to_pylist()
                n_words, ranges, found = [], [], []
                for text, old, ids in zip(cols[at], before_ranges, before_items, strict=True):
                    words = words_of(text.as_py())
                    new, keys = own.matches(words)
                    n_words.append(len(words))
                    ranges.append([{"a": a, "b": b} for a, b in united([*((x["a"], x["b"]) for x in old), *new])])
                    found.append(sorted({*ids, *map(str, keys)}))
                kinds = batch.schema.types[-3:]
                yield pa.RecordBatch.from_arrays([*cols[:-3], pa.array(n_words, kinds[0]), pa.array(ranges, kinds[1]), pa.array(found, kinds[2])], batch.schema.names)

        out = out.mapInArrow(run, out.schema)
    return out


def united(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges in order with those that touch or overlap made one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and out[-1][1] >= a:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def without(text: str, ranges: list[tuple[int, int]]) -> str:
    """The text less the spans of its hit words and what stands between the words of a range."""
    raw = text.encode("utf-8", "replace")
    spans = [m.span() for m in itertools.islice(WORD.finditer(raw.translate(FOLD)), ranges[-1][1])]
    kept, last = [], 0
    for a, b in ranges:
        kept.append(raw[last : spans[a][0]])
        last = spans[b - 1][1]
    return b"".join([*kept, raw[last:]]).decode("utf-8", "replace")


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, max_coverage: float = 0.5) -> DataFrame:
    """docs with hit spans cut out; documents of which more than max_coverage of the words is hit are dropped.

    A document without a hit keeps its text byte for byte. n_chars, where there is one, follows the text.
    """

    @F.pandas_udf("string")
    def cut(text, ranges):
        return text.combine(ranges, lambda t, r: without(t, [(x["a"], x["b"]) for x in r]) if t is not None and len(r) else t)

    def change(inner: DataFrame) -> DataFrame:
        hit = F.aggregate("ranges", F.lit(0), lambda n, r: n + r["b"] - r["a"])
        found = hits(inner, items, window).filter(hit <= max_coverage * F.col("n_words")).withColumn("changed", F.size("ranges") > 0)
        return found.withColumn("text", F.when(F.col("changed"), cut("text", "ranges")).otherwise(F.col("text")))

    return rewritten(docs, change)
