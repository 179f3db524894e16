"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

#: ASCII white space, the separators of words in all operators.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

#: Rows that a side may have to be broadcast; callers pass narrow rows of ids and numbers only.
BROADCAST_ROWS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_or_shuffled(narrow: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A hint to broadcast ``narrow`` if it was counted to have at most ``rows`` rows; else Spark shuffles and splits skew."""
    return F.broadcast(narrow) if narrow.limit(rows + 1).count() <= rows else narrow


def text_slices(batch: pa.RecordBatch, column: int, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of a batch with about ``most`` bytes of text, so that what is made of them stays small.

    What Arrow keeps of freed arrays goes back after each batch, else a worker holds the most that any of its tasks took as long as it lives.
    """
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    first = size = 0
    for i, n in enumerate(sizes.tolist()):
        if i > first and size + n > most:
            yield batch.slice(first, i - first)
            first, size = i, 0
        size += n
    if len(sizes) > first:
        yield batch.slice(first)
    pa.default_memory_pool().release_unused()


def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; Arrow gives back what it keeps of freed arrays after each, as in :func:`text_slices`."""
    for batch in batches:
        yield batch
        pa.default_memory_pool().release_unused()


def utf8(column: pa.Array) -> list[bytes]:
    """The bytes of a text column; null counts as empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return [b or b"" for b in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()]


class WordHasher:
    """64-bit hashes of the words of many texts at once, by prefix sums over their bytes.

    A word is a run of bytes for which ``is_word`` holds.  Its hash is the polynomial
    sum of random values of its bytes modulo 2**64, then mixed; A-Z count as a-z if
    ``lower``.  Texts are handled whole; memory is about 50 bytes per byte of a block.
    """

    BASE = 0x9E3779B97F4A7C13  # odd, and BASE - 1 has one factor of two
    INVERSE = pow(BASE, -1, 1 << 64)

    def __init__(self, lower: bool = True, is_word: np.ndarray | None = None, seed: int = 11):
        space = np.zeros(256, bool)
        space[[9, 10, 11, 12, 13, 32]] = True
        self.word = ~space if is_word is None else is_word
        values = np.random.default_rng(seed).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        if lower:
            values[65:91] = values[97:123]
        values[~self.word] = 0
        self.values = values
        self.powers = self.inverses = np.ones(0, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            n = max(n, 1 << 20)
            self.powers = np.cumprod(np.r_[np.uint64(1), np.full(n, self.BASE, np.uint64)], dtype=np.uint64)
            self.inverses = np.cumprod(np.r_[np.uint64(1), np.full(n, self.INVERSE, np.uint64)], dtype=np.uint64)

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words in order, and the offsets of each text's words (one more than texts)."""
        blob = np.frombuffer(b"\n" + b"\n".join(texts) + b"\n", np.uint8)
        self._grow(len(blob) + 1)
        sums = np.zeros(len(blob) + 1, np.uint64)
        np.cumsum(self.values[blob] * self.powers[: len(blob)], out=sums[1:])
        inside = self.word[blob]
        change = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        starts, ends = change[::2], change[1::2]
        hashes = mix((sums[ends] - sums[starts]) * self.inverses[starts])
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        return hashes, np.searchsorted(starts, np.r_[0, np.cumsum(lengths + 1)] + 1)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the runs of ``size`` words of one text; of the whole sequence if it is shorter; none if it is empty."""
    k = min(size, len(words))
    if not k:
        return words
    with np.errstate(over="ignore"):
        total = np.full(len(words) - k + 1, k, np.uint64)
        for j in range(k):
            total = total * np.uint64(0x9E3779B97F4A7C15) + words[j : len(words) - k + 1 + j]
    return mix(total)
