import random

import numpy as np
from corpus import odd_docs, odd_rows, prose, sentence

from logwarden.llm.decontaminate import Retrieval, document_frequency, drop_contaminated, item_passages, leaks, randomised_svd


def bench(spark, items):
    return spark.createDataFrame([(*i, None, None) for i in items], "item_id long, text string, cosine double, idx string")


def corpus(seed=2):
    rng = random.Random(seed)
    items = [(i, " ".join(sentence(rng, rng.randint(6, 20)) for _ in range(rng.choice([1, 2, 3])))) for i in range(40)]
    rows, truth = [], set()
    for d in range(120):
        text = prose(rng, rng.randint(2, 30))
        if d % 3 == 0:
            item = rng.randrange(40)
            leak = items[item][1]
            if d % 2:
                leak = leak.upper().replace(".", " !!")
            words = text.split()
            at = rng.randrange(len(words) + 1)
            text = " ".join(words[:at] + [leak] + words[at:])
            truth.add((d, item))
        rows.append((d, text))
    return items, rows, truth


def test_every_copy_is_found_and_clean_documents_are_left(spark):
    items, rows, truth = corpus()
    found = leaks(odd_docs(spark, rows), bench(spark, items)).collect()
    assert {(r.doc_id, r.item_id) for r in found} == truth
    assert len(found) == len(truth)


def test_every_text_of_an_item_and_items_without_id_are_sought(spark):
    rng = random.Random(16)
    one, two, three = (prose(rng, 2) for _ in range(3))
    rows = [(d, f"{prose(rng, 4)} {leak} {prose(rng, 4)}") for d, leak in enumerate((one, two, three, ""))]
    found = leaks(odd_docs(spark, rows), bench(spark, [(1, one), (1, two), (None, three), (2, one)])).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(0, 1), (0, 2), (1, 1), (2, None)} and len(found) == 4


def test_blocks_of_items_give_the_same(spark):
    items, rows, truth = corpus(3)
    found = leaks(odd_docs(spark, rows), bench(spark, items), Retrieval(block=15)).collect()
    assert {(r.doc_id, r.item_id) for r in found} == truth


def test_paraphrases_with_the_answer_are_found(spark):
    rng = random.Random(6)
    question, answer = sentence(rng, 24), sentence(rng, 8)
    words = question[:-1].split()
    for i in range(0, 24, 2):
        words[i] = f"other{i}"
    half = " ".join(words)
    rows = [(1, f"{prose(rng)} {half}. {answer} {prose(rng)}"), (2, f"{prose(rng)} {half}. {prose(rng)}"), *((i, prose(rng)) for i in range(3, 40))]
    found = leaks(odd_docs(spark, rows), bench(spark, [(9, f"{question} {answer}")])).collect()
    assert [(r.doc_id, r.item_id) for r in found] == [(1, 9)] and found[0].answer > 0.99 and found[0].lcs < 0.8


def test_svd_equals_numpy_and_candidates_keep_recall(spark):
    items, rows, _ = corpus()
    p = Retrieval(rank=64)
    idf = document_frequency(odd_docs(spark, rows), p, "text")
    vectors = item_passages(bench(spark, items), spark.sparkContext.broadcast(idf), p, "text", "item_id")
    listed = vectors.toPandas()
    where, basis = randomised_svd(vectors, p)
    dense = np.zeros((len(listed), len(where)))
    for i, (idx, val) in enumerate(zip(listed.idx, listed.val)):
        dense[i, np.searchsorted(where, idx)] = val
    values = np.linalg.svd(dense, compute_uv=False)[: basis.shape[1]]
    mine = np.linalg.norm(dense @ basis, axis=0)
    assert np.allclose(basis.T @ basis, np.eye(basis.shape[1]), atol=1e-4) and np.allclose(mine, values, rtol=0.05)
    assert np.abs(dense @ basis @ basis.T - dense).max() < 1e-3 or basis.shape[1] == 64


def test_odd_rows_and_items(spark):
    rows = odd_rows()
    item = " ".join(rows[0][1].split()[20:60])
    found = leaks(odd_docs(spark), bench(spark, [(1, item), (1, item), (2, None), (3, ""), (None, item), (4, "?!")])).collect()
    assert sorted({(r.doc_id, r.item_id) for r in found}, key=str) == sorted(((d, i) for d in (1, 2, 3, None) for i in (1, None)), key=str)
    docs = odd_docs(spark)
    kept = drop_contaminated(docs, bench(spark, [(1, item)]))
    assert kept.columns == docs.columns and kept.count() == len(rows) - 5


def test_empty_tables(spark):
    assert leaks(odd_docs(spark, []), bench(spark, [(1, "some words of an item that is not there")])).collect() == []
    assert leaks(odd_docs(spark), bench(spark, [])).collect() == []


def test_copies_of_one_of_thousands_of_independent_items_are_found(spark):
    """Exact TF-IDF search with the LCS finds all copies; the latent space holds few of so many items."""
    rng = random.Random(11)
    for n in (1000, 4096):
        items = [(i, " ".join(f"w{rng.randrange(60_000)}" for _ in range(rng.randint(20, 60)))) for i in range(n)]
        rows, truth = [], set()
        for d in range(150):
            text = [f"w{rng.randrange(60_000)}" for _ in range(rng.randint(60, 200))]
            item = rng.randrange(n)
            copy = items[item][1].split()
            if d % 3 == 0:
                copy = [f"w{rng.randrange(60_000)}" if rng.random() < 0.3 else w for w in copy]
            at = rng.randrange(len(text))
            rows.append((d, " ".join(text[:at] + copy + text[at:])))
            truth.add((d, item))
        found = {(r.doc_id, r.item_id) for r in leaks(odd_docs(spark, rows), bench(spark, items)).collect()}
        assert found <= truth and len(found) >= 0.9 * len(truth), (n, len(found))
        assert {(d, i) for d, i in truth if d % 3} <= found


def test_an_item_in_a_third_of_all_rows_is_found_in_each(spark):
    rng = random.Random(12)
    item = sentence(rng, 24)
    page = f"{sentence(rng, 20)} {item} {sentence(rng, 16)}"
    rows = [(i, page if i % 3 == 0 else f"{prose(rng, 1)} {item} {prose(rng, 1)}" if i % 30 == 1 else prose(rng, 7)) for i in range(300)]
    found = leaks(odd_docs(spark, rows), bench(spark, [(1, item), (2, sentence(rng, 20))])).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(i, 1) for i in range(300) if i % 3 == 0 or i % 30 == 1}
