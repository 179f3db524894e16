"""SentencePiece encoding and decoding on the tokenizers library (operator 8)."""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from logwarden.llm.common import text_slices
from logwarden.llm.pretokens import check_cuts, pretokens
from logwarden.llm.spmodel import BPE, NORMAL, SPACE_MARK, Model, parse

if TYPE_CHECKING:
    from tokenizers import Tokenizer


def merges(model: Model) -> list[tuple[str, str]]:
    """All ways to join two pieces to a third, best score first.

    Among equal scores the leftmost place is due first, while merges have one order each.  Runs of one symbol,
    whose pieces may all have one score, grow from the left: there the longer left part is always the leftmost place.
    """
    own = {p: s for p, s, k in zip(model.pieces, model.scores, model.kinds) if k == NORMAL}
    found = [(-own[p], -c, len(p), p[:c], p[c:]) for p in own for c in range(1, len(p)) if p[:c] in own and p[c:] in own]
    return [(a, b) for *_, a, b in sorted(found)]


def build(model: Model) -> Tokenizer:
    """A tokenizer with the model's normaliser, space marks, scores and byte fallback."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    if model.model_type == BPE:
        core = models.BPE(vocab={p: i for i, p in enumerate(model.pieces)}, merges=merges(model), unk_token=model.pieces[model.unknown],
                          fuse_unk=True, byte_fallback=model.byte_fallback)
    else:
        core = models.Unigram(list(zip(model.pieces, model.scores)), unk_id=model.unknown, byte_fallback=model.byte_fallback)
    tokenizer = Tokenizer(core)
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.trims_spaces:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    steps += [normalizers.Prepend(SPACE_MARK)] if model.dummy_prefix else []
    steps += [normalizers.Replace(" ", SPACE_MARK)] if model.escapes_spaces else []
    tokenizer.normalizer = normalizers.Sequence(steps)
    tokenizer.pre_tokenizer = pre_tokenizers.Split(Regex(f"{SPACE_MARK}*[^{SPACE_MARK}]+|{SPACE_MARK}+"), "isolated")
    tokenizer.decoder = decoders.Sequence([decoders.Replace(SPACE_MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *(
        [decoders.Strip(" ", 1, 0)] if model.dummy_prefix else [])])
    return tokenizer


class Codec:
    """Ids of pretokens, each encoded, decoded and verified once and remembered in flat arrays.

    When ``held`` pretokens are known, further ones are encoded for one call and forgotten, as the most
    frequent are met first.
    """

    def __init__(self, data: bytes, threads: int, held: int):
        from sentencepiece import SentencePieceProcessor

        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        model = parse(data)
        check_cuts(model)
        self.mark = model.pieces.index(SPACE_MARK)
        self.tokenizer, self.reference, self.threads, self.held = build(model), SentencePieceProcessor(model_proto=data), threads, held
        self.place: dict[str, int] = {}
        self.ids, self.starts, self.sizes, self.same, self.back = (np.zeros(0, t) for t in (np.int32, np.int64, np.int64, bool, bool))

    def learn(self, words: list[str]) -> None:
        got = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        want = self.reference.encode(words, num_threads=self.threads)
        if "" in words:  # a space at the end of a text: the mark alone, while an empty text has no dummy prefix
            got[words.index("")] = want[words.index("")] = [self.mark]
        same = [a == b for a, b in zip(got, want)]
        back = [d == w for d, w in zip(self.tokenizer.decode_batch(got, skip_special_tokens=False), words)]
        sizes = np.fromiter(map(len, got), np.int64, len(got))
        self.starts = np.r_[self.starts, len(self.ids) + np.cumsum(sizes) - sizes]
        self.sizes, self.same, self.back = np.r_[self.sizes, sizes], np.r_[self.same, same], np.r_[self.back, back]
        self.ids = np.r_[self.ids, np.fromiter((i for x in got for i in x), np.int32, int(sizes.sum()))]
        self.place.update(zip(words, range(len(self.place), len(self.place) + len(words))))

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[bool], list[bool]]:
        """Per text: ids, whether both libraries agree, whether decoding gives the text."""
        cut = [pretokens(t) for t in texts]
        new = list(set().union(*cut) - self.place.keys())
        before, ids_before = len(self.place), len(self.ids)
        for i in range(0, len(new), 20_000):
            self.learn(new[i : i + 20_000])
        ids, same, back = [], [], []
        for text, words in zip(texts, cut):
            at = np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))
            size = self.sizes[at]
            ids.append(self.ids[np.arange(size.sum()) + np.repeat(self.starts[at] - np.cumsum(size) + size, size)])
            same.append(bool(self.same[at].all()))
            back.append(bool(self.back[at].all()) and SPACE_MARK not in text)
        if len(self.place) > self.held:
            for word in new:
                del self.place[word]
            self.ids = self.ids[:ids_before].copy()
            self.starts, self.sizes, self.same, self.back = (x[:before].copy() for x in (self.starts, self.sizes, self.same, self.back))
        return ids, same, back


@lru_cache(maxsize=1)
def codec_of(data: bytes, threads: int, held: int) -> Codec:
    """The codec of a worker process, which keeps what it has learned from one task to the next."""
    return Codec(data, threads, held)


def encode_decode(docs: DataFrame, model_path: str, threads: int = 2, held: int = 400_000, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row of ``docs``: doc_id, n_tokens, ids, parity, round_trip, for a SentencePiece model file.

    Whole texts are cut into pretokens, and every pretoken is encoded by the tokenizers library in
    batches, whose ids are the result, and verified with the reference library.  ``parity`` tells whether they agreed on all
    of a text.  ``round_trip`` tells whether the ids decode to
    the text; a literal space mark in a text comes back as a space.  Null and empty texts
    have no tokens and both flags set.  Every row gives one row, also repeats and rows without doc_id.
    """
    with open(model_path, "rb") as file:
        data = docs.sparkSession.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(data.value, threads, held)
        for part in (s for batch in batches for s in text_slices(batch, 1)):
            ids, same, back = codec.encode([t or "" for t in part.column(1).to_pylist()])
            sizes = np.fromiter(map(len, ids), np.int32, len(ids))
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), pa.array(np.concatenate(ids)))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), lists, pa.array(same), pa.array(back)],
                                             names=["doc_id", "n_tokens", "ids", "parity", "round_trip"])

    return docs.select(F.col(key).cast("long"), F.col(text).cast("string")).mapInArrow(
        run, "doc_id long, n_tokens long, ids array<int>, parity boolean, round_trip boolean")


def decode(encoded: DataFrame, model_path: str, ids: str = "ids", into: str = "text") -> DataFrame:
    """``encoded`` with the decoded text of its ids; null ids give null, no ids the empty text."""
    from pyspark.sql.types import StringType

    with open(model_path, "rb") as file:
        data = encoded.sparkSession.sparkContext.broadcast(file.read())

    @F.arrow_udf(StringType())
    def text_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tokenizer = build(parse(data.value))
        for batch in batches:
            rows = batch.to_pylist()
            texts = iter(tokenizer.decode_batch([r for r in rows if r is not None], skip_special_tokens=False))
            yield pa.array([None if r is None else next(texts) for r in rows], pa.string())

    return encoded.withColumn(into, text_of(F.col(ids)))
