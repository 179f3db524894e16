import random

from corpus import odd_docs, odd_rows, prose, sentence

from logwarden.llm.spans import SENTENCE, Spans, row_key, substring_dedup


def turns(docs):
    """The place of every row among those with its doc_id: a hash of its text."""
    return {(r.doc_id, r.text): r.k & (1 << 60) - 1 for r in docs.select("doc_id", "text", row_key("text", "doc_id").alias("k")).collect()}


def brute(rows, turn=None, p=Spans()):
    """The same by plain loops over documents in the order of their ids."""
    def order(d, text):
        return (d is None, d or 0, turn[d, text] if turn else 0)

    def all_runs(text):
        parts = SENTENCE.findall(text or "")
        at = [i for i, s in enumerate(parts) if s.split()]
        for i in range(len(at)):
            for j in range(i + 1, len(at) + 1):
                words = [w for k in at[i:j] for w in parts[k].split()]
                if len(words) >= p.words or j - i >= p.sentences and len(words) >= p.least_words:
                    yield at[i], at[j - 1] + 1, tuple(tuple(parts[k].split()) for k in at[i:j])
                    break

    first = {}
    for d, text in rows:
        for *_, run in all_runs(text):
            first[run] = min(first.get(run, (2,)), order(d, text))
    out = []
    for d, text in rows:
        gone, seen = set(), set()
        for a, b, run in all_runs(text):
            if run in seen or first[run] != order(d, text):
                gone.update(range(a, b))
            seen.add(run)
        out.append((d, text and "".join(s for i, s in enumerate(SENTENCE.findall(text)) if i not in gone)))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def test_equals_brute_force(spark):
    rng = random.Random(4)
    shared = [prose(rng, rng.choice([1, 2, 4, 7])) for _ in range(6)] + ["Yes. No. So."]
    rows = []
    for i in range(60):
        parts = [prose(rng, rng.randint(1, 4)) for _ in range(3)] + rng.choices(shared, k=2)
        rng.shuffle(parts)
        rows.append((i, rng.choice(["\n", " ", "\n\n"]).join(parts)))
    assert got(substring_dedup(odd_docs(spark, rows))) == brute(rows)


def test_odd_rows_and_columns(spark):
    docs = odd_docs(spark)
    out = substring_dedup(docs, count="n_cut")
    assert out.columns == [*docs.columns, "n_cut"]
    assert got(out) == brute(odd_rows(), turns(docs))


def test_rows_without_id_and_texts_of_one_id_lose_what_they_repeat(spark):
    rng = random.Random(15)
    shared = prose(rng, 6)
    rows = [(d, f"{prose(rng, 3)} {shared} {prose(rng, 3)}") for d in (None, None, None)]
    assert sum(shared in t for _, t in got(substring_dedup(odd_docs(spark, rows)))) == 1
    rows += [(7, f"{prose(rng, 3)} {shared} {prose(rng, 3)}") for _ in range(3)]
    docs = odd_docs(spark, rows)
    out = got(substring_dedup(docs))
    assert [d for d, t in out if shared in t] == [7] and out == brute(rows, turns(docs))


def test_one_long_sentence_repeats_alone_but_short_ones_do_not(spark):
    rng = random.Random(5)
    long = sentence(rng, 60)
    rows = [(1, f"Alpha one. {long} Beta two."), (2, f"Gamma. {long} Delta."), (3, "Yes. No. So."), (4, "Yes. No. So.")]
    assert dict(got(substring_dedup(odd_docs(spark, rows)))) == {1: rows[0][1], 2: "Gamma. Delta.", 3: rows[2][1], 4: rows[3][1]}


def test_empty_table(spark):
    assert substring_dedup(odd_docs(spark, [])).collect() == []


def brute_any_run(rows, p=Spans()):
    """A sentence goes if any run with it, of any length that meets the rule, was found earlier."""
    seen, out = set(), []
    for d, text in rows:
        parts = SENTENCE.findall(text)
        at = [i for i, s in enumerate(parts) if s.split()]
        gone = set()
        for i in range(len(at)):
            for j in range(i + 1, len(at) + 1):
                run = tuple(tuple(parts[k].split()) for k in at[i:j])
                n = sum(map(len, run))
                if n >= p.words or j - i >= p.sentences and n >= p.least_words:
                    if run in seen:
                        gone.update(range(at[i], at[j - 1] + 1))
                    seen.add(run)
        out.append((d, "".join(s for i, s in enumerate(parts) if i not in gone)))
    return sorted(out, key=str)


def test_sentences_at_the_end_of_a_repeated_passage_go(spark):
    rng = random.Random(9)
    passage = " ".join(sentence(rng, n) for n in (30, 12, 12))
    rows = [(i, f"{sentence(rng, 9)} {passage} {sentence(rng, 20)}") for i in range(2)]
    out = dict(got(substring_dedup(odd_docs(spark, rows))))
    assert out[0] == rows[0][1] and passage.split(". ")[2] not in out[1] and out[1] == rows[1][1].replace(passage + " ", "")


def test_equals_brute_force_over_runs_of_any_length(spark):
    rng = random.Random(10)
    shared = [" ".join(sentence(rng, rng.choice([2, 5, 12, 18, 30])) for _ in range(rng.randint(1, 5))) for _ in range(8)]
    rows = [(i, " ".join(x for _ in range(4) for x in (sentence(rng, rng.choice([3, 9, 24])), rng.choice(shared)))) for i in range(60)]
    assert got(substring_dedup(odd_docs(spark, rows))) == brute_any_run(rows)
