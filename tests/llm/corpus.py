"""Small tables with the cases every operator must stand: nulls, empty and long texts, ties, repeats, clashing columns."""

import random

WORDS = "the of and a stone river cloud amber lantern harbor meadow copper window garden silver thunder orchard velvet compass marble".split()


def sentence(rng, n=9):
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 400)) for _ in range(n)).capitalize() + "."


def prose(rng, sentences=8):
    return " ".join(sentence(rng, rng.randint(5, 12)) for _ in range(sentences))


def odd_rows(seed=1):
    """(doc_id, text) with null ids and texts, blanks, an exact copy, a repeated row and a very long text."""
    rng = random.Random(seed)
    base = prose(rng, 30)
    long = " ".join(sentence(rng) for _ in range(4000))
    return [(1, base), (2, base), (2, base), (3, base.replace(".", "!", 1)), (4, None), (5, ""), (6, " \n\t "), (7, "word"), (8, "Word"), (9, long),
            (None, base), (None, None), (10, prose(rng)), (11, prose(rng)), (11, prose(rng)), (12, "é ß 你好 😀\x00"), (13, long)]


def odd_docs(spark, rows=None):
    """The rows as documents, with columns whose names operators use inside."""
    rows = odd_rows() if rows is None else rows
    more = "fp long, sig binary, label string, key long, hub long, n long, ranges string, row_key long, words string, size int, score double, value string"
    return spark.createDataFrame([(*r, *[None] * 12) for r in rows], f"doc_id long, text string, {more}")
