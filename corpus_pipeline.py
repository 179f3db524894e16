"""Documents to training tokens: five stages, each over all that the one before kept.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which
is written as Parquet and read again as the next one's ``docs``.  All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from logwarden.llm.common import table
from logwarden.llm.decontaminate import drop_contaminated
from logwarden.llm.near_dups import drop_near_duplicates
from logwarden.llm.rules import keep_good
from logwarden.llm.sentencepiece_codec import encode_decode
from logwarden.llm.spans import substring_dedup
from logwarden.session import cut_lineage


def vocabulary(name: str = "piece_bpe_32k.model") -> str:
    """Path of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the n-gram ratio (operator 7)."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: five words, similarity 0.8 (operator 10)."""
    return drop_near_duplicates(docs)


def span_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without repeated sentence spans (operator 1); ``n_chars`` follows the text."""
    cut = substring_dedup(docs)
    return cut.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else cut


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item was found (operator 5)."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document (operator 8): doc_id, n_tokens, ids, parity, round_trip."""
    return encode_decode(docs, vocabulary())


STAGES = [("quality rules", quality_rules), ("near dedup", near_dedup), ("span dedup", span_dedup), ("decontamination", decontaminate), ("tokens", tokenize)]

#: Candidate search, sketches and tokenization can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; results between stages are tables in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
