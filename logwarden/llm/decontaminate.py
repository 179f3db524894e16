"""Benchmark decontamination by latent semantic retrieval (operator 5)."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F

from logwarden.llm.common import WordHasher, mix, small_or_shuffled, text_slices
from logwarden.llm.spans import row_key
from logwarden.session import cut_lineage

#: Bytes of words: letters and digits of ASCII, and all bytes of other characters.
WORD_BYTES = np.array([chr(b).isalnum() or b >= 128 for b in range(128)] + [True] * 128)


#: Inverse passage frequency of a word that lies in a tenth of all passages.
COMMON = 2.3
#: Passages that are counted besides those of the table, as if without its words, so that few passages make no word common.
UNSEEN = 500.0


@dataclass(frozen=True)
class Retrieval:
    """``stride`` words make a passage, two passages in a row a window.  ``buckets`` bounds the hashed
    vocabulary, ``rank`` the latent space, ``block`` the benchmark items held by each task at
    once; more items are searched block by block.  Item passages that keep less than ``kept`` of their length in
    the latent space are compared by all their words instead.  A window is a candidate at ``cosine``.  A
    candidate is a leak if the matched words, weighted by rarity and in order, have a share of
    ``verbatim`` of the item, or of ``paraphrase`` when its answer (last sentence) has ``answer``."""

    stride: int = 32
    bits: int = 17
    rank: int = 128
    oversample: int = 16
    power: int = 2
    block: int = 4096
    kept: float = 0.9
    cosine: float = 0.2
    verbatim: float = 0.6
    paraphrase: float = 0.4
    answer: float = 0.8
    seed: int = 5

    @property
    def buckets(self) -> int:
        return 1 << self.bits


def lowered(column: pa.Array) -> list[bytes]:
    return [(t or "").lower().encode("utf-8", "surrogatepass") for t in column.to_pylist()]


def bucket(words: np.ndarray, p: Retrieval) -> np.ndarray:
    return (words >> np.uint64(64 - p.bits)).astype(np.int64)


def document_frequency(docs: DataFrame, p: Retrieval, text: str) -> np.ndarray:
    """Inverse passage frequency of every bucket over all passages of all texts; its size depends on ``bits`` only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, counts, total = WordHasher(False, WORD_BYTES), np.zeros(p.buckets, np.int64), 0
        for part in (s for batch in batches for s in text_slices(batch, 0)):
            words, at = hasher(lowered(part.column(0)))
            unit, n = passages(at, p.stride)
            counts += np.bincount(np.unique(unit << p.bits | bucket(words, p)) & (p.buckets - 1), minlength=p.buckets)
            total += n
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[used, -1]), pa.array(np.r_[counts[used], total])], names=["bucket", "n"])

    sums = docs.select(F.col(text).cast("string")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    n = sums.set_index("bucket")["n"]
    df = np.zeros(p.buckets)
    df[n.index[n.index >= 0]] = n[n.index >= 0]
    return np.log((n.get(-1, 0) + UNSEEN) / (df + 0.5)).clip(0.01).astype(np.float32)


def sought(idf: np.ndarray) -> np.ndarray:
    """Weights for the search: words that lie in over a tenth of all passages count nothing, save in passages made of them."""
    return np.where(idf > COMMON, idf, 0).astype(np.float32)


def passages(at: np.ndarray, size: int) -> tuple[np.ndarray, int]:
    """The passage of each word, numbered through all texts, and the number of passages."""
    lengths = np.diff(at)
    per_text = -(-lengths // size)
    first = np.cumsum(per_text) - per_text
    inside = np.arange(at[-1]) - np.repeat(at[:-1], lengths)
    return np.repeat(first, lengths) + inside // size, int(per_text.sum())


def item_passages(items: DataFrame, idf, p: Retrieval, text: str, key: str) -> DataFrame:
    """(item, part, idx, val): unit TF-IDF vectors of the passages of every item, cut evenly.

    A passage of which over three quarters count nothing for the search has a vector of those words as well, with part -1 - part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, weights = WordHasher(False, WORD_BYTES), sought(idf.value)
        for batch in batches:
            rows = []
            ids = batch.column(0).to_pylist()
            texts = lowered(batch.column(1))
            words, at = hasher(texts) if texts else (np.zeros(0, np.uint64), np.zeros(1, int))
            for k, (i, j) in enumerate(zip(at[:-1], at[1:])):
                for part, piece in enumerate(np.array_split(words[i:j], max(1, -(-(j - i) // p.stride)))):
                    if len(piece):
                        idx, n = np.unique(bucket(piece, p), return_counts=True)
                        val = n * weights[idx]
                        if val.any():
                            rows.append((ids[k], part, idx[val > 0], val[val > 0] / np.linalg.norm(val)))
                        if 4 * n[val > 0].sum() < len(piece):
                            val = n * np.where(val > 0, 0, idf.value[idx])
                            rows.append((ids[k], -1 - part, idx[val > 0], val[val > 0] / np.linalg.norm(val)))
            yield pa.RecordBatch.from_pydict({"item": pa.array([r[0] for r in rows], pa.int64()), "part": pa.array([r[1] for r in rows], pa.int32()),
                                              "idx": pa.array([r[2] for r in rows], pa.list_(pa.int64())),
                                              "val": pa.array([r[3].tolist() for r in rows], pa.list_(pa.float32()))})

    return items.select(F.col(key).cast("long"), F.col(text).cast("string")).mapInArrow(
        run, "item long, part int, idx array<long>, val array<float>")


def randomised_svd(rows: DataFrame, p: Retrieval) -> tuple[np.ndarray, np.ndarray]:
    """Right singular vectors of the sparse matrix ``rows``: (bucket of each row, vectors).

    Every pass multiplies the matrix by a bounded block on the executors and sums by bucket in Spark; the
    driver orthonormalises that block of at most ``buckets`` x (``rank`` + ``oversample``) numbers.
    """
    spark = rows.sparkSession
    width = p.rank + p.oversample

    def product(seen: Iterator[pa.RecordBatch], basis) -> Iterator[pa.RecordBatch]:
        where, block = basis.value if basis else (None, None)
        total: dict[int, np.ndarray] = {}
        for batch in seen:
            for item, part, idx, val in zip(*(batch.column(c).to_pylist() for c in range(4))):
                idx, val = np.array(idx), np.array(val, np.float64)
                if basis:
                    left = val @ block[np.searchsorted(where, idx)]
                else:
                    own = mix(np.array([item, part, p.seed], np.int64).view(np.uint64)).sum(dtype=np.uint64)
                    left = np.random.default_rng(int(own)).standard_normal(width)
                for i, v in zip(idx.tolist(), val):
                    total[i] = total[i] + v * left if i in total else v * left
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(list(total), pa.int64()),
                                          "vec": pa.array([v.tolist() for v in total.values()], pa.list_(pa.float64()))})

    def times(basis) -> tuple[np.ndarray, np.ndarray]:
        made = rows.mapInArrow(lambda seen: product(seen, basis), "bucket long, vec array<double>")
        out = made.groupBy("bucket").agg(vector_to_array(Summarizer.sum(array_to_vector("vec"))).alias("vec")).toPandas().sort_values("bucket")
        return out.bucket.to_numpy(), np.vstack(out.vec.to_list()) if len(out) else np.zeros((0, width))

    where, block = times(None)
    for _ in range(p.power):
        if not len(where):
            break
        q = np.linalg.qr(block)[0]
        shared = spark.sparkContext.broadcast((where, q))
        block = times(shared)[1]
    if not len(where):
        return where, np.zeros((0, 1), np.float32)
    values, turn = np.linalg.eigh((q.T @ block + block.T @ q) / 2)
    keep = [i for i in np.argsort(-values)[: p.rank] if values[i] > 1e-9]
    return where, (q @ turn[:, keep]).astype(np.float32)


def weighted_lcs(item: np.ndarray, weights: np.ndarray, region: np.ndarray) -> float:
    """Greatest total weight of a common subsequence."""
    best = np.zeros(len(region) + 1, np.float32)
    for word, weight in zip(item, weights):
        best[1:] = np.maximum(best[1:], np.where(region == word, best[:-1] + weight, 0))
        np.maximum.accumulate(best, out=best)
    return float(best[-1])


def search(docs: DataFrame, held, p: Retrieval, text: str, key: str) -> DataFrame:
    """Candidates of one block of items, verified: (doc_id, row_key, item_id, cosine, lcs, answer)."""
    schema = "doc_id long, row_key long, item_id long, cosine double, lcs double, answer double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher(False, WORD_BYTES)
        idf, row_of, basis, latent, items, of_passage, whole, common = held.value
        seek = sought(idf)
        n_whole = len(of_passage) - len(latent)
        for batch in (s for b in batches for s in text_slices(b, 2, 1 << 19)):
            found = []
            block = lowered(batch.column(2))
            words, at = hasher(block)
            if not len(words):
                continue
            unit, n = passages(at, p.stride)
            text_of = np.zeros(n, np.int64)
            text_of[unit] = np.repeat(np.arange(len(block)), np.diff(at))
            # Passages are projected once; a window is a passage and the next one of its text.
            buck = bucket(words, p)
            weight = seek[buck]
            mass = np.bincount(unit, weight**2, n)
            rest = np.bincount(unit, np.where(weight > 0, 0, idf[buck]) ** 2, n)  # of the common words, for items made of them
            known = (row_of[buck] >= 0) & (weight > 0)
            u, r, v = unit[known], row_of[buck[known]], weight[known]
            starts = np.flatnonzero(np.r_[True, u[1:] != u[:-1]]) if len(u) else np.zeros(0, int)
            z = np.zeros((n, basis.shape[1]), np.float32)
            for i, j, a, b in pieces(starts, len(u)):
                z[u[starts[i:j]]] = np.add.reduceat(basis[r[a:b]] * v[a:b, None], starts[i:j] - a)
            more = np.flatnonzero(text_of[:-1] == text_of[1:])
            z[more] += z[more + 1]
            mass[more] += mass[more + 1]
            rest[more] += rest[more + 1]
            # Repeats within a window are left out of its norm, so that its cosine is never too small.
            z /= np.sqrt(mass).clip(1e-9)[:, None]
            of_word = np.searchsorted(unit, np.arange(n + 1))
            sure = set()
            for i in range(0, n, 256):
                j = min(i + 256, n)
                score = z[i:j] @ latent.T
                if n_whole:
                    # A passage more than asked for, as windows reach into the next one.
                    here = slice(of_word[i], of_word[min(j + 1, n)])
                    full = whole.dots(buck[here], unit[here] - i, idf[buck[here]], min(j + 1, n) - i, n_whole)
                    both = more[(more >= i) & (more < j)] - i
                    full[both] += full[both + 1]
                    score = np.hstack([score, full[: j - i] / np.sqrt(np.where(common, rest[i:j, None], mass[i:j, None])).clip(1e-9)])
                for window, q in np.argwhere(score >= p.cosine).tolist():
                    t, item = int(text_of[i + window]), of_passage[q]
                    if (t, item) in sure:
                        continue
                    body, weights, answer = items[item]
                    head = int(of_word[i + window])
                    region = words[max(at[t], head - len(body)) : min(at[t + 1], head + 2 * p.stride + len(body))]
                    if weights[(body[:, None] == region).any(axis=1)].sum() < p.paraphrase * weights.sum():
                        continue  # not even out of order
                    share = weighted_lcs(body, weights, region) / weights.sum()
                    if share >= p.paraphrase:
                        tail = slice(answer, None)
                        told = weighted_lcs(body[tail], weights[tail], region) / weights[tail].sum()
                        if share >= p.verbatim or told >= p.answer:
                            found.append((t, item, float(score[window, q]), share, told))
                            if share >= p.verbatim:
                                sure.add((t, item))
            at_row = pa.array([f[0] for f in found], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at_row), batch.column(1).take(at_row), pa.array([f[1] for f in found], pa.int64()),
                 *(pa.array([f[c] for f in found], pa.float64()) for c in (2, 3, 4))],
                names=["doc_id", "row_key", "item_id", "cosine", "lcs", "answer"])

    rows = docs.select(F.col(key).cast("long"), row_key(text, key), F.col(text).cast("string")).mapInArrow(run, schema)
    return rows.groupBy("doc_id", "row_key", "item_id").agg(F.max("cosine").alias("cosine"), F.max("lcs").alias("lcs"), F.max("answer").alias("answer"))


class Postings:
    """Vectors of item passages by bucket, for dot products with all their words."""

    def __init__(self, idx: list, val: list, buckets: int):
        bucket = np.concatenate(idx).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        self.row = np.repeat(np.arange(len(idx)), [len(x) for x in idx]).astype(np.int32)[order]
        self.val = np.concatenate(val).astype(np.float32)[order]
        self.at = np.searchsorted(bucket[order], np.arange(buckets + 1)).astype(np.int64)

    def dots(self, bucket: np.ndarray, unit: np.ndarray, weight: np.ndarray, n: int, width: int) -> np.ndarray:
        """(n, width): per unit the sum over its words."""
        first, size = self.at[bucket], self.at[bucket + 1] - self.at[bucket]
        place = np.arange(size.sum()) + np.repeat(first - np.cumsum(size) + size, size)
        cell = np.repeat(unit * width, size) + self.row[place]
        return np.bincount(cell, np.repeat(weight, size) * self.val[place], n * width).reshape(n, width).astype(np.float32)


def pieces(starts: np.ndarray, end: int, most: int = 256) -> Iterator[tuple[int, int, int, int]]:
    """Groups of up to ``most`` windows with the range of their words."""
    for i in range(0, len(starts), most):
        j = min(i + most, len(starts))
        yield i, j, int(starts[i]), int(starts[j]) if j < len(starts) else end


def leaks(docs: DataFrame, benchmark: DataFrame, p: Retrieval = Retrieval(), text: str = "text", key: str = "doc_id",
          item_text: str = "text", item_key: str = "item_id") -> DataFrame:
    """Benchmark items found in documents: (doc_id, row_key, item_id, cosine, lcs, answer), one row per pair.

    Every whole text is searched in overlapping windows; case and punctuation don't count.  Texts and
    items without words (null, empty) find nothing, rows without doc_id and items without
    item_id are reported with a null id.  Rows of repeated documents share one result row.  Every
    different text of an item_id is searched; the result has the greatest values of those found.  Item passages made of words
    that are in over a tenth of all passages, as leaks themselves can make them, are compared by those words.  Empty tables give no rows.
    """
    spark = docs.sparkSession
    named = benchmark.where(F.col(item_text).isNotNull()).select(F.xxhash64(item_text).alias("item_id"), F.col(item_key).cast("long").alias("name"),
                                                                 F.col(item_text).cast("string").alias("text"))
    named = cut_lineage(named.distinct(), "leak-named")
    listed = named.select("item_id", "text").dropDuplicates(["item_id"])  # equal texts are searched once; below, item_id is the text's hash
    n_blocks = -(-listed.count() // p.block)
    idf = document_frequency(docs, p, text)
    shared = spark.sparkContext.broadcast(idf)
    parts = []
    for b in range(n_blocks):
        block = listed.where(F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)) == b) if n_blocks > 1 else listed
        vectors = cut_lineage(item_passages(block, shared, p, "text", "item_id"), "leak-items")
        where, basis = randomised_svd(vectors.where("part >= 0"), p)
        row_of = np.full(p.buckets, -1, np.int32)
        row_of[where] = np.arange(len(where))
        listed_vectors = vectors.toPandas()  # of the block's items only
        if not len(listed_vectors):
            continue
        common = listed_vectors.part.to_numpy() < 0
        latent = np.zeros((len(common), basis.shape[1]), np.float32)
        for i in np.flatnonzero(~common):
            latent[i] = np.array(listed_vectors.val[i], np.float32) @ basis[row_of[listed_vectors.idx[i]]]
        length = np.linalg.norm(latent, axis=1)
        near, lossy = np.flatnonzero(length >= p.kept), np.flatnonzero(length < p.kept)
        latent = latent[near] / length[near, None]
        whole = Postings([listed_vectors.idx[i] for i in lossy], [listed_vectors.val[i] for i in lossy], p.buckets) if len(lossy) else None
        of_passage = listed_vectors["item"].to_numpy()[np.r_[near, lossy]].tolist()
        held = spark.sparkContext.broadcast((idf, row_of, basis, latent, item_words(block.toPandas(), idf, p), of_passage, whole, common[lossy]))
        parts.append(search(docs, held, p, text, key))
    out = parts[0] if parts else spark.createDataFrame([], "doc_id long, row_key long, item_id long, cosine double, lcs double, answer double")
    for more in parts[1:]:
        out = out.unionByName(more)
    of = small_or_shuffled(named.select("item_id", "name").distinct())
    return (out.join(of, "item_id").groupBy("doc_id", "row_key", F.col("name").alias("item_id"))
            .agg(F.max("cosine").alias("cosine"), F.max("lcs").alias("lcs"), F.max("answer").alias("answer")))


def item_words(items: pd.DataFrame, idf: np.ndarray, p: Retrieval) -> dict[int, tuple[np.ndarray, np.ndarray, int]]:
    """Per item of a block its word hashes, their weights, and where its answer begins: its last sentence, or else its last quarter."""
    hasher, out = WordHasher(False, WORD_BYTES), {}
    for item, text in zip(items.item_id, items.text):
        low = (text or "").lower()
        words = hasher([low.encode("utf-8", "surrogatepass")])[0]
        cut = [m.end() for m in re.finditer(r"[.!?]\s", low.rstrip())]
        head = len(hasher([low[: cut[-1]].encode("utf-8", "surrogatepass")])[0]) if cut else len(words) - len(words) // 4
        out[int(item)] = words, idf[bucket(words, p)].astype(np.float32), head if head < len(words) else max(0, len(words) - 1)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, p: Retrieval = Retrieval(), text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` in which no benchmark item was found."""
    found = leaks(docs, benchmark, p, text, key).select(F.col("row_key").alias("__leak")).distinct()
    return docs.withColumn("__row_key", row_key(text, key)).join(found, F.col("__row_key") == F.col("__leak"), "left_anti").drop("__row_key")
