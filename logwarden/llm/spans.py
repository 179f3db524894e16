"""Substring deduplication by sliding sentence spans (operator 1)."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType

from logwarden.llm.common import text_slices
from logwarden.session import cut_lineage

#: A sentence with the white space after it; the pieces of a text join to the text.
SENTENCE = re.compile(r"[^.!?。！？\n]*[.!?。！？\n]+[ \t\r\n\x0b\x0c]*|[^.!?。！？\n]+")

NO_ID = 2**63 - 1


@dataclass(frozen=True)
class Spans:
    """A span starts at every sentence and ends with the first by which it has ``sentences``
    sentences and ``least_words`` words, or ``words`` words; read backwards, one ends at every sentence.  Every longer
    run is made of such spans to its first and last sentence.  The second rule lets long sentences repeat alone,
    the third keeps a few very short ones from counting as a repeat."""

    sentences: int = 3
    least_words: int = 8
    words: int = 25


def runs(text: str, p: Spans) -> Iterator[tuple[int, int, bytes]]:
    """(first sentence, sentence after the last, 128-bit hash) of every span; white space within sentences counts as one space."""
    place, size, mark = [], [], []
    for i, s in enumerate(SENTENCE.findall(text)):
        words = s.split()
        if words:
            place.append(i)
            size.append(len(words))
            mark.append(xxhash.xxh3_128_digest(" ".join(words).encode("utf-8", "surrogatepass")))
    def enough(sentences: int, total: int) -> bool:
        return total >= p.words or (sentences >= p.sentences and total >= p.least_words)

    def span(i: int, j: int) -> tuple[int, int, bytes]:
        return place[i], place[j - 1] + 1, xxhash.xxh3_128_digest(b"".join(mark[i:j]))

    j = total = 0
    ends = []
    for i in range(len(place)):
        while j < len(place) and not enough(j - i, total):
            total += size[j]
            j += 1
        if not enough(j - i, total):
            break
        ends.append(j)
        yield span(i, j)
        total -= size[i]
    # The shortest span to end at j starts at the last i whose own shortest span ends by j.
    i = -1
    for j in range(1, len(place) + 1):
        while i + 1 < len(ends) and ends[i + 1] <= j:
            i += 1
        if i >= 0 and ends[i] < j:
            yield span(i, j)


def spans(docs: DataFrame, p: Spans, text: str, key: str) -> DataFrame:
    """(doc, row_key, h1, h2, start, stop, again) of every span of every whole text; ``again``: seen earlier in the same text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (s for b in batches for s in text_slices(b, 2)):
            rows, start, stop, again, marks = [], [], [], [], bytearray()
            for n, t in enumerate(batch.column(2).to_pylist()):
                seen: set[bytes] = set()
                for a, b, h in runs(t or "", p):
                    rows.append(n)
                    start.append(a)
                    stop.append(b)
                    again.append(h in seen)
                    marks += h
                    seen.add(h)
            at, half = pa.array(rows, pa.int64()), pa.Array.from_buffers(pa.int64(), 2 * len(rows), [None, pa.py_buffer(bytes(marks))])
            even = pa.array(range(0, 2 * len(rows), 2), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at), half.take(even), half.take(pa.array(range(1, 2 * len(rows), 2), pa.int64())),
                 pa.array(start, pa.int32()), pa.array(stop, pa.int32()), pa.array(again, pa.bool_())],
                names=["doc", "row_key", "h1", "h2", "start", "stop", "again"])

    return docs.select(F.coalesce(F.col(key).cast("long"), F.lit(NO_ID)), row_key(text, key), F.col(text).cast("string")).mapInArrow(
        run, "doc long, row_key long, h1 long, h2 long, start int, stop int, again boolean")


def row_key(text: str, key: str) -> Column:
    return F.xxhash64(F.col(key).cast("long"), F.col(text))


@F.arrow_udf(StringType())
def without(texts: pa.Array, cuts: pa.Array) -> pa.Array:
    """The texts without the sentences in the given (start, stop) ranges."""
    out = []
    for text, ranges in zip(texts.to_pylist(), cuts.to_pylist()):
        if ranges:
            gone: set[int] = set()
            for r in ranges:
                gone.update(range(r["start"], r["stop"]))
            text = "".join(s for i, s in enumerate(SENTENCE.findall(text)) if i not in gone)
        out.append(text)
    return pa.array(out, pa.string())


def repeated_ranges(docs: DataFrame, p: Spans = Spans(), text: str = "text", key: str = "doc_id") -> DataFrame:
    """(row_key, ranges): per row the sentence ranges of spans that are not the first of their kind."""
    found = spans(docs, p, text, key)
    # Document, then row, in one number, which Spark can aggregate by hash.
    turn = F.col("doc").cast("decimal(19,0)") * F.lit(1 << 60).cast("decimal(19,0)") + F.col("row_key").bitwiseAND((1 << 60) - 1).cast("decimal(19,0)")
    many = (found.where("not again").groupBy("h1", "h2").agg(F.min(turn).alias("first"), F.max(turn).alias("last"))
            .where("first < last").select("h1", "h2", "first"))
    many = cut_lineage(many, "span-repeats")  # joined by shuffle on both sides, so that Spark can split a span that very many rows hold
    late = found.join(many, ["h1", "h2"], "left").where(F.col("again") | (turn > F.col("first")))
    return late.groupBy("row_key").agg(F.collect_set(F.struct("start", "stop")).alias("ranges"))


def substring_dedup(docs: DataFrame, p: Spans = Spans(), text: str = "text", key: str = "doc_id", count: str | None = None) -> DataFrame:
    """``docs`` with every sentence removed from ``text`` that lies in a repeated span other than its first.

    The first span of a kind is the one in the document with the smallest doc_id, and the first
    there.  All rows stay; a text may become empty.  Null texts stay null, empty
    texts empty.  Different texts with one doc_id come in the order of their hashes; equal texts with one
    doc_id are one document and share a result.  Rows without doc_id come last.  Other columns are untouched; ``count``
    names a column to be added for the number of sentence ranges cut.
    """
    ranges = repeated_ranges(docs, p, text, key).select(F.col("row_key").alias("__row_key"), F.col("ranges").alias("__ranges"))
    names = docs.columns
    joined = docs.withColumn("__row_key", row_key(text, key)).join(ranges, "__row_key", "left")
    cut = joined.withColumn(text, F.when(F.col("__ranges").isNull(), F.col(text)).otherwise(without(F.col(text), F.col("__ranges"))))
    if count:
        cut = cut.withColumn(count, F.coalesce(F.size("__ranges"), F.lit(0)))
        names = [*names, count]
    return cut.select(*[f"`{n}`" for n in names])
