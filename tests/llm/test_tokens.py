import random

import pytest
from corpus import odd_docs, odd_rows, prose

from logwarden.llm.sentencepiece_codec import build, decode, encode_decode
from logwarden.llm.spmodel import load
from logwarden.llm.token_counts import Merger, token_counts

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=PATH)


def texts():
    rng = random.Random(3)
    letters = "aabbcehinorst  \n\t▁é你😀ßШ.,0"
    made = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    return made + [" " * n + "x" for n in range(50)] + ["a" * n for n in range(120)] + ["ab" * n for n in range(60)] + ["ha" * 400 + "!", "=" * 333, "\n" * 77, "<s></s><unk>", "x ", " "]


def rows():
    return odd_rows() + [(100 + i, t) for i, t in enumerate(texts())]


def test_counts_equal_the_library(spark, library):
    got = token_counts(odd_docs(spark, rows()), PATH).collect()
    want = [(d, len((t or "").encode()), len(library.encode(t or ""))) for d, t in rows()]
    assert sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in got), key=str) == sorted(want, key=str)
    assert all(r.over_limit == (r.n_tokens > 4096) for r in got) and any(r.over_limit for r in got)


def test_ids_equal_the_library_and_come_back(spark, library):
    got = encode_decode(odd_docs(spark, rows()), PATH)
    assert sorted(((r.doc_id, r.ids) for r in got.collect()), key=str) == sorted(((d, library.encode(t or "")) for d, t in rows()), key=str)
    assert got.where("parity").count() == len(rows())
    back = {r.doc_id: r for r in decode(got, PATH).collect()}
    for d, t in rows():
        if d is not None and d != 11:
            assert back[d].text == (t or "").replace("▁", " ")
            assert back[d].round_trip == ("▁" not in (t or ""))


def test_libraries_agree_on_prose(spark):
    rng = random.Random(8)
    got = encode_decode(odd_docs(spark, [(i, prose(rng)) for i in range(50)]), PATH).collect()
    assert all(r.parity and r.round_trip for r in got)


def test_whole_texts_through_the_rebuilt_tokenizer(library):
    tokenizer, sample = build(load(PATH)), texts()
    assert [e.ids for e in tokenizer.encode_batch(sample)] == library.encode(sample)


def test_long_runs_of_spaces_agree(library):
    rng, tokenizer = random.Random(4), build(load(PATH))
    runs = [" " * n + end for n in range(200) for end in ("", "x", ".", "\n", "of", "é")]
    runs += ["".join(" " * rng.randint(0, 60) + rng.choice(["a", "the", "\t", "?"]) for _ in range(6)) for _ in range(500)]
    assert [e.ids for e in tokenizer.encode_batch(runs, add_special_tokens=False)] == library.encode(runs)


def test_merging_one_place_may_come_before_another():
    """Where a merge makes a pair that is due earlier than the next place, only the first place is merged."""
    from logwarden.llm.spmodel import BPE, NORMAL, Model

    pieces = ["▁", "a", "b", "ab", "aba", "▁b"]
    model = Model(pieces, [-9.0, -8.0, -7.0, -3.0, -1.0, -9.5], [NORMAL] * 6, BPE, True, "identity", b"", True, False, True)
    assert Merger(model).counts(["abab"]).tolist() == [3]  # mark, aba, b


def test_empty_table(spark):
    assert token_counts(odd_docs(spark, []), PATH).collect() == [] and encode_decode(odd_docs(spark, []), PATH).collect() == []
