"""Token counts by rank-synchronous merging of ragged arrays (operator 9)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from logwarden.llm.common import text_slices
from logwarden.llm.pretokens import check_cuts, pretokens
from logwarden.llm.spmodel import BPE, NORMAL, SPACE_MARK, Model, parse

NEVER = np.iinfo(np.int32).max


class Merger:
    """Counts the symbols that are left of pretokens when no pair can be merged.

    A pair of symbols can be merged if their texts join to a piece; its rank is the place of the
    piece's score among all scores, equal scores having equal ranks.  At each step every sequence
    merges its lowest-rank pair, at all places where that can't change the order of merges, and
    else at its leftmost place only.  Characters that are no piece count by their bytes.
    """

    def __init__(self, model: Model):
        if model.model_type != BPE:
            raise ValueError("the model is not a BPE model")
        check_cuts(model)
        own = {p: i for i, (p, k) in enumerate(zip(model.pieces, model.kinds)) if k == NORMAL}
        ids = dict(own)
        for piece in own:
            for c in piece:
                ids.setdefault(c, len(model.pieces) + len(ids))
        order = {s: r for r, s in enumerate(sorted({model.scores[i] for i in own.values()}, reverse=True))}
        pairs = {(ids[p[:c]], ids[p[c:]]): i for p, i in own.items() for c in range(1, len(p)) if p[:c] in ids and p[c:] in ids}
        self.width = max(ids.values()) + 2
        keys = np.array([a * self.width + b for a, b in pairs], np.int64)
        merged = np.array(list(pairs.values()), np.int32)
        ranks = np.array([order[model.scores[i]] for i in pairs.values()], np.int32)
        at = np.argsort(keys)
        self.keys, self.merged, self.ranks = np.r_[keys[at], -1], np.r_[merged[at], 0].astype(np.int32), np.r_[ranks[at], NEVER].astype(np.int32)
        self.of_char = np.full(0x110000, self.width - 1, np.int32)
        for c, i in ids.items():
            if len(c) == 1:
                self.of_char[ord(c)] = i
        code = np.arange(0x110000)
        self.bytes_of = np.where(np.isin(self.of_char, list(own.values())) | (not model.byte_fallback), 1, 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF)).astype(np.int64)

    def look(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged symbol of pairs."""
        key = left.astype(np.int64) * self.width + right
        at = np.searchsorted(self.keys[:-1], key)
        at = np.where(self.keys[at] == key, at, len(self.keys) - 1)
        return self.ranks[at], self.merged[at]

    def counts(self, words: list[str]) -> np.ndarray:
        """Tokens of each pretoken, given without its leading space."""
        texts = [SPACE_MARK + w.replace(" ", SPACE_MARK) for w in words]
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        starts = np.cumsum(lengths) - lengths
        extra = np.add.reduceat(self.bytes_of[codes] - 1, starts) if len(texts) else lengths
        total = lengths + extra
        symbols, row = self.of_char[codes], np.repeat(np.arange(len(texts)), lengths)
        while len(symbols) > 1:
            together = row[:-1] == row[1:]
            rank, merged = self.look(symbols[:-1], symbols[1:])
            rank = np.where(together, rank, NEVER)
            head = np.flatnonzero(np.r_[True, ~together])
            low = np.minimum.reduceat(np.r_[rank, NEVER], head)
            size = np.diff(np.r_[head, len(symbols)])
            low_here = np.repeat(low, size)
            take = (rank == low_here[:-1]) & (rank < NEVER)
            if not take.any():
                break
            take = self.apart(take)
            seq = np.repeat(np.arange(len(head)), size)
            take &= ~(self.risky(symbols, merged, take, seq, low, together)[seq[:-1]] & ~first_of(take, seq[:-1]))
            symbols = symbols.copy()
            at = np.flatnonzero(take)
            symbols[at] = merged[at]
            total -= np.bincount(row[at], minlength=len(total))
            stay = np.r_[True, ~take]
            stay &= low_here < NEVER  # finished sequences leave
            symbols, row = symbols[stay], row[stay]
        return total

    @staticmethod
    def apart(take: np.ndarray) -> np.ndarray:
        """Of places in a row only every other one, from the left."""
        at = np.arange(len(take))
        begin = np.maximum.accumulate(np.where(take & ~np.r_[False, take[:-1]], at, -1))
        return take & ((at - begin) % 2 == 0)

    def risky(self, symbols: np.ndarray, merged: np.ndarray, take: np.ndarray, seq: np.ndarray, low: np.ndarray, together: np.ndarray) -> np.ndarray:
        """Sequences with several places, where one merge makes a pair that is due before the next place."""
        several = np.bincount(seq[:-1][take], minlength=len(low)) > 1
        at = np.flatnonzero(take & several[seq[:-1]])
        bad = np.zeros(len(low), bool)
        if len(at):
            after = at[(at + 2 < len(symbols)) & np.r_[together, False][np.minimum(at + 1, len(together))]]
            bad[seq[after][self.look(merged[after], symbols[after + 2])[0] <= low[seq[after]]]] = True
            before = at[(at > 0) & np.r_[False, together][at]]
            left = np.where((before > 1) & take[np.maximum(before - 2, 0)] & np.r_[False, together][np.maximum(before - 1, 0)], merged[np.maximum(before - 2, 0)], symbols[before - 1])
            bad[seq[before][self.look(left, merged[before])[0] <= low[seq[before]]]] = True
        return bad


def first_of(take: np.ndarray, seq: np.ndarray) -> np.ndarray:
    """The first taken place of each sequence."""
    at = np.flatnonzero(take)
    out = np.zeros(len(take), bool)
    out[at[np.r_[True, seq[at][1:] != seq[at][:-1]]]] = True
    return out


@lru_cache(maxsize=1)
def merger_of(data: bytes) -> tuple[Merger, dict[str, int]]:
    """The merger of a worker process and the counts it knows, which stay from one task to the next."""
    return Merger(parse(data)), {}


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096, held: int = 500_000, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes, n_tokens, over_limit, for a BPE model file of SentencePiece.

    Whole texts are cut into pretokens, of which each task merges every new one once; ``held`` bounds
    how many it remembers.  Null and empty texts have no bytes and no tokens.  Every row
    gives one row, also repeats and rows without doc_id; other columns are left out.
    """
    with open(model_path, "rb") as file:
        data = docs.sparkSession.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger, known = merger_of(data.value)
        for batch in (s for b in batches for s in text_slices(b, 1)):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            sizes = [len(t.encode("utf-8", "surrogatepass")) for t in texts]
            cut = [pretokens(t) for t in texts]
            new = list(set().union(*cut) - known.keys())
            for i in range(0, len(new), 20_000):
                known.update(zip(new[i : i + 20_000], merger.counts(new[i : i + 20_000]).tolist()))
            tokens = [sum(map(known.__getitem__, words)) for words in cut]
            if len(known) > held:  # the most frequent are met first and stay
                for word in new:
                    del known[word]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())],
                                             names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col(key).cast("long"), F.col(text).cast("string")).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
