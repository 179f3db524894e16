import random
import shutil
import subprocess
import sys
from pathlib import Path

import pytest
from corpus import prose

pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402

ROOT = Path(__file__).resolve().parent.parent.parent


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """A corpus with a case for each stage."""
    d = str(tmp_path_factory.mktemp("pipeline"))
    rng = random.Random(7)
    item, shared = prose(rng, 4), prose(rng, 7)
    rows = [(i, prose(rng, 12)) for i in range(40)]
    base = rows[0][1].split()
    rows += [(100, rows[0][1]), (101, " ".join(base[:50] + ["changed"] + base[51:])), (102, f"{prose(rng, 3)} {item} {prose(rng, 3)}"),
             (103, f"{prose(rng, 9)}\n{shared}\n{prose(rng, 9)}"), (104, f"{prose(rng, 9)}\n{shared}\n{prose(rng, 9)}"), (105, "too short"), (106, None), (107, "one same line here of words\n" * 30)]
    spark.createDataFrame([(i, t, "en", "src", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, dict(rows), shared


def test_each_stage_takes_effect_and_keeps_clean_documents(spark, tables):
    d, rows, shared = tables
    docs = spark.read.parquet(f"{d}/documents.parquet")
    kept = [set(rows)]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.cut_lineage(stage(spark, docs, d), "test")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        kept.append({r.doc_id for r in docs.collect()})
    clean = set(range(40))
    assert kept[1] == kept[0] - {105, 106, 107}
    assert kept[2] == kept[1] - {100, 101}
    assert kept[3] == kept[2] and kept[4] == kept[3] - {102} and clean <= kept[4]
    text = {r.doc_id: r for r in docs.collect()}
    assert text[103].text == rows[103] and shared not in text[104].text and text[104].n_chars == len(text[104].text)
    out = corpus_pipeline.STAGES[-1][1](spark, docs, d).collect()
    assert {r.doc_id for r in out} == kept[4] and all(r.n_tokens == len(r.ids) > 0 and r.round_trip for r in out)


def test_run_equals_the_stages(spark, tables):
    d, *_ = tables
    got = {r.doc_id: r.n_tokens for r in corpus_pipeline.run(spark, d).collect()}
    assert set(got) == set(range(40)) | {103, 104}


def test_the_rest_imports_without_the_subpackage(tmp_path):
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    shutil.copytree(ROOT / "logwarden", tmp_path / "logwarden", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    (tmp_path / "logwarden" / "llm" / "__pycache__").mkdir(parents=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'sessions' in q and not any(k.startswith('op') for k in q); assert e.oracle_sql()"
    subprocess.run([sys.executable, "-B", "-c", code], check=True, cwd=tmp_path, timeout=120)
