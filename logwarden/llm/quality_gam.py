"""Quality classifier: a generalised additive model with pairwise interactions (operator 4)."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from logwarden.llm.common import text_slices

FEATURES = ("log_words", "word_length", "upper", "symbols", "digits", "punctuation", "other_bytes", "distinct_words", "top_word", "repeated_lines",
            "line_words", "sentence_words", "marked_words", "bare_words", "byte_entropy", "repeated_runs", "capital_words", "double_marks")

SYMBOLS, DIGITS, MARKS, UPPER = b"#*$%&|<>@^~_=+\\{}[]/", b"0123456789", b".,;:!?'\"()-", bytes(range(65, 91))
BARE = re.compile(rb"(?<!\S)[^\sA-Za-z\x80-\xff]+(?!\S)")
MARKED = re.compile(rb"[^\sA-Za-z0-9\x80-\xff.,;:!?'\")\]](?!\S)")
DOUBLE = re.compile(rb"([!?#*$%&])\1")
CAPITAL = re.compile(rb"(?<!\S)[A-Z]{2,}")


@dataclass(frozen=True)
class Gam:
    """``sample`` bounds the labelled rows learned from; ``bins`` and ``pair_bins`` the lookup tables.

    Each of ``rounds`` visits every feature with a tree of ``leaves`` leaves and then, for
    ``pair_rounds``, each of the ``pairs`` strongest pairs with a tree that splits both features once."""

    sample: int = 20_000
    bins: int = 32
    pair_bins: int = 8
    rounds: int = 150
    leaves: int = 3
    pairs: int = 6
    pair_rounds: int = 60
    rate: float = 0.1
    ridge: float = 1.0


def measure(text: str) -> list[float]:
    """The features of one whole text, all from its characters; zeros for no text."""
    b = text.encode("utf-8", "surrogatepass")
    words = b.split()
    if not words:
        return [0.0] * len(FEATURES)
    n, size = len(words), len(b)
    share = lambda chars: (size - len(b.translate(None, chars))) / size
    lines = [x for x in b.split(b"\n") if x.strip()]
    counts = np.bincount(np.frombuffer(b, np.uint8), minlength=256)
    seen = counts[counts > 0] / size
    kinds = Counter(words)
    runs = list(zip(words, words[1:], words[2:], words[3:], words[4:]))
    ends = sum(counts[list(b".!?")])
    return [np.log1p(n), sum(map(len, words)) / n, share(UPPER), share(SYMBOLS), share(DIGITS), share(MARKS), counts[128:].sum() / size, len(kinds) / n**0.8,
            kinds.most_common(1)[0][1] / n, 1 - len(set(lines)) / len(lines), np.log1p(n / len(lines)), np.log1p(n / (1 + ends)), len(MARKED.findall(b)) / n,
            len(BARE.findall(b)) / n, float(-(seen * np.log2(seen)).sum()), 1 - len(set(runs)) / len(runs) if runs else 0.0, len(CAPITAL.findall(b)) / n,
            len(DOUBLE.findall(b)) / n]


def features(texts: list[str | None]) -> np.ndarray:
    return np.array([measure(t or "") for t in texts], np.float32).reshape(len(texts), len(FEATURES))


def leaf_values(grad: np.ndarray, hess: np.ndarray, leaves: int, ridge: float) -> np.ndarray:
    """Newton steps of a tree grown best-first over ordered bins, as one value per bin."""
    g, h = np.r_[0, np.cumsum(grad)], np.r_[0, np.cumsum(hess)]
    gain = lambda a, b: (g[b] - g[a]) ** 2 / (h[b] - h[a] + ridge)
    parts = [(0, len(grad))]
    while len(parts) < leaves:
        best = (1e-9, None, None)
        for k, (a, b) in enumerate(parts):
            if b - a > 1:
                cut = np.arange(a + 1, b)
                won = gain(a, cut) + gain(cut, b) - gain(a, b)
                if won.max() > best[0]:
                    best = (won.max(), k, int(cut[won.argmax()]))
        if best[1] is None:
            break
        a, b = parts.pop(best[1])
        parts += [(a, best[2]), (best[2], b)]
    out = np.zeros(len(grad))
    for a, b in parts:
        out[a:b] = (g[b] - g[a]) / (h[b] - h[a] + ridge)
    return out


def quadrants(grad: np.ndarray, hess: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """Gain and cell values of the tree that splits each of two features once, over all such splits."""
    best, values = 0.0, np.zeros_like(grad)
    g, h = (np.pad(x.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for x in (grad, hess))
    n, m = grad.shape
    i, j = np.arange(1, n)[:, None], np.arange(1, m)[None, :]
    quads = [(i * 0, i, j * 0, j), (i * 0, i, j, j * 0 + m), (i, i * 0 + n, j * 0, j), (i, i * 0 + n, j, j * 0 + m)]
    cell = lambda x, a, b, c, d: x[b, d] - x[a, d] - x[b, c] + x[a, c]
    total = sum(cell(g, *q) ** 2 / (cell(h, *q) + ridge) for q in quads)
    if total.size:
        at = np.unravel_index(total.argmax(), total.shape)
        best = float(total[at])
        x, y = at[0] + 1, at[1] + 1
        for a, b, c, d in ((0, x, 0, y), (0, x, y, m), (x, n, 0, y), (x, n, y, m)):
            values[a:b, c:d] = cell(g, a, b, c, d) / (cell(h, a, b, c, d) + ridge)
    return best, values


class Tables:
    """Learned model: bin edges, a table per feature, a table per pair, and the intercept."""

    def __init__(self, x: np.ndarray, y: np.ndarray, p: Gam):
        steps = np.linspace(0, 1, p.bins + 1)[1:-1]
        self.edges = [np.unique(np.quantile(x[:, f], steps)) for f in range(x.shape[1])] if len(x) else [np.zeros(0)] * x.shape[1]
        self.coarse = [np.unique(e[np.linspace(0, len(e) - 1, p.pair_bins - 1).astype(int)]) if len(e) else e for e in self.edges]
        rate = np.clip(y.mean() if len(y) else 0.5, 0.001, 0.999)
        self.base = float(np.log(rate / (1 - rate)))
        self.single = [np.zeros(len(e) + 1) for e in self.edges]
        self.double: dict[tuple[int, int], np.ndarray] = {}
        if not len(y):
            return
        bins, wide = self.bins(x, self.edges), self.bins(x, self.coarse)
        total = np.full(len(y), self.base)
        for _ in range(p.rounds):
            for f, table in enumerate(self.single):
                if len(table) > 1:
                    grad, hess = self.steps(total, y)
                    b = bins[:, f]
                    move = p.rate * leaf_values(np.bincount(b, grad, len(table)), np.bincount(b, hess, len(table)), p.leaves, p.ridge)
                    table += move
                    total += move[b]
        grad, hess = self.steps(total, y)
        ranked = sorted(((self.look(wide, i, j, grad, hess, p)[0], i, j) for i in range(x.shape[1]) for j in range(i) if len(self.coarse[i]) and len(self.coarse[j])), reverse=True)
        self.double = {(i, j): np.zeros((len(self.coarse[i]) + 1, len(self.coarse[j]) + 1)) for _, i, j in ranked[: p.pairs]}
        for _ in range(p.pair_rounds):
            for (i, j), table in self.double.items():
                grad, hess = self.steps(total, y)
                move = p.rate * self.look(wide, i, j, grad, hess, p)[1]
                table += move
                total += move[wide[:, i], wide[:, j]]

    @staticmethod
    def bins(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(edges)], axis=1) if len(x) else np.zeros(x.shape, int)

    @staticmethod
    def steps(total: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        q = 1 / (1 + np.exp(-total))
        return y - q, q * (1 - q)

    def look(self, wide: np.ndarray, i: int, j: int, grad: np.ndarray, hess: np.ndarray, p: Gam) -> tuple[float, np.ndarray]:
        shape = len(self.coarse[i]) + 1, len(self.coarse[j]) + 1
        at = wide[:, i] * shape[1] + wide[:, j]
        return quadrants(*(np.bincount(at, v, shape[0] * shape[1]).reshape(shape) for v in (grad, hess)), p.ridge)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1: the sum of one table entry per feature and pair."""
        bins, wide = self.bins(x, self.edges), self.bins(x, self.coarse)
        total = np.full(len(x), self.base)
        for f, table in enumerate(self.single):
            total += table[bins[:, f]]
        for (i, j), table in self.double.items():
            total += table[wide[:, i], wide[:, j]]
        return 1 / (1 + np.exp(-total))


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, p: Gam = Gam(), text: str = "text", key: str = "doc_id", label: str = "quality") -> Tables:
    """A model from at most ``sample`` labelled rows that are not held out, those with the smallest hashes of their ids."""
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max(label).alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(p.sample)
    known = known.select(F.col("doc_id").alias("__id"), "y")
    rows = docs.select(F.col(key).cast("long").alias("__key"), F.col(text).cast("string").alias("__text")).join(F.broadcast(known), F.col("__key") == F.col("__id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (s for b in batches for s in text_slices(b, 2)):
            x = features(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(x.tolist(), pa.list_(pa.float32()))], names=["key", "y", "x"])

    # Rows that repeat a labelled id count once, so that no more rows come to the driver than the sample has.
    one = rows.select("__key", F.col("y").cast("int").alias("y"), "__text").mapInArrow(run, "key long, y int, x array<float>")
    got = one.groupBy("key").agg(F.min("y").alias("y"), F.min("x").alias("x")).orderBy("key").toPandas()
    x = np.array(got.x.to_list(), np.float32).reshape(len(got), len(FEATURES))
    return Tables(x, got.y.to_numpy(float), p)


def quality_scores(docs: DataFrame, labels: DataFrame, p: Gam = Gam(), text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, score, predicted.

    Labels are learned from rows whose crc32 of the id is not 1 modulo 3, and only texts are inputs of a score.
    Null, empty and blank texts have all features zero and get a score too.  Without labels
    every score is 0.5.  Every row gives one row; rows without doc_id are not held out.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, p, text, key))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (s for b in batches for s in text_slices(b, 2)):
            score = model.value.score(features(batch.column(2).to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score, pa.float64()), pa.array(score >= 0.5).cast(pa.int32())],
                                             names=["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), held_out(F.col(key)).alias("held_out"), F.col(text).cast("string").alias("text")).mapInArrow(
        run, "doc_id long, held_out boolean, score double, predicted int")
