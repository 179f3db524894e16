"""Periodic runs of words by recompression (operator 13)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from logwarden.llm.common import WORD, text_slices, utf8


@dataclass(frozen=True)
class Periods:
    """A run is a stretch of words of smallest period q and at least ``least`` words and ``powers`` periods."""

    least: int = 24
    powers: int = 3
    block: int = 1 << 18  # grid points looked at together

    def region(self, q: np.ndarray) -> np.ndarray:
        """Fewest consecutive words of a run of period q that equal the word q later."""
        return np.maximum(self.least - q, (self.powers - 1) * q)


@dataclass(frozen=True)
class Level:
    """One string of a grammar and its division into groups, which are the symbols of the next string.

    ``first[g]`` is where group g starts (one more entry gives the length) and ``group[i]`` the group of symbol i.
    """

    symbols: np.ndarray
    first: np.ndarray
    group: np.ndarray
    blocks: bool


class Grammar:
    """Run-length grammar of one string of numbers by recompression.

    Levels alternate between block compression, which replaces every maximal block of one symbol, and pair
    compression, which splits the alphabet into left and right symbols and replaces every pair of a left and a right one.
    Equal stretches are grouped alike except at their ends, so two places are compared in
    a bounded number of steps a level.  The first and the last symbol must be found nowhere else in the string.
    """

    def __init__(self, string: np.ndarray, seed: int = 5):
        self.levels: list[Level] = []
        rng = np.random.default_rng(seed)
        symbols = np.unique(string, return_inverse=True)[1]
        while len(symbols) > 1:
            symbols = self._compress(symbols, np.r_[True, symbols[1:] != symbols[:-1]], blocks=True)
            if len(symbols) > 1:
                symbols = self._compress(symbols, self._pair_starts(symbols, rng), blocks=False)

    @staticmethod
    def _pair_starts(symbols: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        """Where groups start; a random split that joins less than an eighth of the neighbours (a quarter is expected) is drawn anew."""
        while True:
            left = rng.integers(0, 2, int(symbols.max()) + 1).astype(bool)[symbols]
            joined = max(left[:-1] & ~left[1:], ~left[:-1] & left[1:], key=np.count_nonzero)
            if 8 * np.count_nonzero(joined) >= len(joined):
                return np.r_[True, ~joined]

    def _compress(self, symbols: np.ndarray, starts: np.ndarray, blocks: bool) -> np.ndarray:
        first = np.flatnonzero(starts)
        if len(first) == len(symbols):
            return symbols
        bounds = np.append(first, len(symbols))
        self.levels.append(Level(symbols.astype(np.int32), bounds.astype(np.int32), (np.cumsum(starts) - 1).astype(np.int32), blocks))
        # A block is its symbol and length, a pair its two symbols.
        size = np.diff(bounds)
        other = size if blocks else np.where(size == 2, symbols[bounds[1:] - 1] + 1, 0)
        return np.unique(symbols[first] * (int(other.max()) + 1) + other, return_inverse=True)[1]

    def extend(self, i: np.ndarray, j: np.ndarray, forward: bool = True) -> np.ndarray:
        """How many symbols agree from i and from j on (backwards: just before i and before j); i differs from j.

        Going up, a query passes what is left of its two groups and asks for the next ones.  Where they differ it goes
        down through their first members that differ.
        """
        step = 1 if forward else -1
        at = np.stack([i, j]) - (not forward)
        live, stopped = np.arange(len(i)), []
        for level in self.levels:
            group = level.group[at]
            begin, end = level.first[group], level.first[group + 1]
            left = end - at if forward else at - begin + 1
            fresh = (left == end - begin).all(axis=0)
            same = level.symbols[at[0]] == level.symbols[at[1]]
            at = at + step * np.where(fresh | ~same, 0, left.min(axis=0))
            # If both groups end here, so do those of the next level begin; if only one ends, the next symbols differ.
            up = fresh | same & (left[0] == left[1])
            stopped.append((live[~up], at[:, ~up]))
            live, at = live[up], level.group[at[:, up]]
        for level, (more, where) in zip(reversed(self.levels), reversed(stopped)):
            begin, end = level.first[at], level.first[at + 1]
            at = begin if forward else end - 1
            # Of different groups with one first member, the shorter block ends or the second members differ.
            agree = (end - begin).min(axis=0) if level.blocks else 1
            at = at + step * np.where(level.symbols[at[0]] == level.symbols[at[1]], agree, 0)
            live, at = np.concatenate([live, more]), np.concatenate([at, where], axis=1)
        out = np.empty(len(i), np.int64)
        out[live] = step * (at[0] - i[live]) - (not forward)
        return out


def grid(words: np.ndarray, p: Periods) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places i and periods q at which a run can be: every run of period q has a multiple i of ``p.region(q)`` with equal words at i and i + q.

    The word after or before must be equal as well.  There are about n log n places, handed out in blocks.
    """
    n = len(words)
    if n < p.least:
        return
    q = np.arange(1, n // p.powers + 1)
    stride = p.region(q)
    count = (n - q - 1) // stride + 1
    upto = np.cumsum(count)
    cuts = np.unique(np.r_[0, np.searchsorted(upto, np.arange(p.block, upto[-1], p.block)), len(q)])
    for a, b in zip(cuts[:-1], cuts[1:]):
        c = count[a:b]
        each = np.repeat(np.arange(a, b), c)
        i = (np.arange(len(each)) - np.repeat(np.cumsum(c) - c, c)) * stride[each]
        hit = np.flatnonzero(words[i] == words[i + q[each]])
        i, each = i[hit], q[each[hit]]
        after, before = np.minimum(i + each + 1, n - 1), np.maximum(i - 1, 0)
        near = (words[after - each] == words[after]) & (i + each + 1 < n) | (words[before] == words[before + each]) & (i > 0)
        yield i[near], each[near]


def find_runs(texts: list[np.ndarray], p: Periods = Periods()) -> list[np.ndarray]:
    """Rows (start, length, period) of all runs of each text of word numbers, by start and period."""
    owner, places, periods = [], [], []
    for k, words in enumerate(texts):
        for i, q in grid(words, p):
            if len(i):
                owner.append(np.full(len(i), k))
                places.append(i)
                periods.append(q)
    none = np.zeros((0, 3), np.int64)
    if not owner:
        return [none] * len(texts)
    owner, places, periods = (np.concatenate(x) for x in (owner, places, periods))
    # The grammar's string: the texts that have grid points, each between symbols found nowhere else.
    used = np.unique(owner)
    limit = 1 + max(int(texts[k].max()) for k in used)
    string = np.concatenate([*chain.from_iterable(([limit + s], texts[k]) for s, k in enumerate(used)), [limit + len(used)]])
    sizes = np.array([len(texts[k]) + 1 for k in used])
    base = (np.cumsum(sizes) - sizes + 1)[np.searchsorted(used, owner)]
    grammar, found = Grammar(string), []
    for a in range(0, len(owner), p.block):
        part = slice(a, a + p.block)
        i, q = base[part] + places[part], periods[part]
        back = grammar.extend(i, i + q, forward=False)
        length = q + back + grammar.extend(i, i + q)
        run = length >= q + p.region(q)
        found.append(np.stack([owner[part], places[part] - back, length, q])[:, run])
    rows = np.concatenate(found, axis=1)
    # Multiples of a period find the same stretch; the least is its period.
    rows = rows[:, np.lexsort(rows[[3, 2, 1, 0]])]
    rows = rows[:, np.r_[True, (rows[:3, 1:] != rows[:3, :-1]).any(axis=0)]] if rows.shape[1] else rows
    rows = rows[:, np.lexsort(rows[[3, 1, 0]])]
    cuts = np.searchsorted(rows[0], np.arange(len(texts) + 1))
    return [rows[1:, a:b].T if b > a else none for a, b in zip(cuts[:-1], cuts[1:])]


def outside_runs(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of n words stay if every run keeps its first period only."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(edge[:n]) == 0


def periodic_runs(docs: DataFrame, p: Periods = Periods(), text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row of ``docs``: its key, n_words, ``runs`` (array of start, length, period by start and period) and ``collapsed``.

    ``collapsed`` holds the words, joined by one space, that are in no run after its first period.  Texts are handled whole,
    a slice of about a megabyte at a time; a longer text is a slice of its own.  A text that is null, empty
    or white space has no words and no runs and collapses to the empty string.  Repeated rows give repeated results,
    an empty table none.  Other columns are not read.
    """
    schema = f"{key} {docs.schema[key].dataType.simpleString()}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    run_type = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (s for batch in batches for s in text_slices(batch, 1)):
            numbers: dict[bytes, int] = {}
            split = [t.split() for t in utf8(part.column(1))]
            texts = [np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words)) for words in split]
            found = find_runs(texts, p)
            kept = [words if not len(r) else [w for w, stays in zip(words, outside_runs(len(words), r)) if stays] for words, r in zip(split, found)]
            flat = np.concatenate(found)
            offsets = pa.array(np.cumsum([0] + [len(r) for r in found]), pa.int32())
            values = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat[:, c])) for c in range(3)], ["start", "length", "period"])
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([len(w) for w in split], pa.int64()), pa.ListArray.from_arrays(offsets, values).cast(run_type),
                 pa.array([b" ".join(w).decode() for w in kept], pa.string())], names=[key, "n_words", "runs", "collapsed"])

    return docs.select(key, F.col(text).cast("string").alias("text")).mapInArrow(run, schema)


def strongest(runs: Column) -> Column:
    """The run of greatest length/period, compared exactly; of equal ones the first by start and period; null if there is none."""
    better = lambda best, r: best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"])
    return F.aggregate(runs, F.lit(None).cast("struct<start:long,length:long,period:long>"),
                       lambda best, r: F.when(better(best, r), r).otherwise(best))


def with_planted_periods(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, text) in which a tenth of the texts are made periodic from some word on, as the query's contract says; a null key plants nothing."""
    h = F.crc32(F.col(key).cast("string").cast("binary"))
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    n = F.size("words")
    g = F.floor(F.col("h") / 10)
    a = F.pmod(g, n)
    period = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))
    source = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + F.pmod(i - F.col("a"), F.col("p")))
    planted = F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get("words", source(i).cast("int"))), " ")
    chosen = F.pmod(F.col("h"), F.lit(10)) == 0
    marked = docs.select(key, F.col(text).alias("text"), h.alias("h")).withColumn("words", F.when(chosen, words))
    placed = marked.withColumn("a", F.when(n > 0, a)).withColumn("p", F.when(n > 0, period))
    return placed.select(key, F.when(n > 0, planted).otherwise(F.col("text")).alias("text"))
