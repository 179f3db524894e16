"""Registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

import corpus_pipeline
from logwarden.llm.chat import PERSPECTIVES_SQL, perspectives
from logwarden.llm.common import table
from logwarden.llm.decontaminate import leaks
from logwarden.llm.mixing import mix
from logwarden.llm.near_dups import NearDups, near_duplicates
from logwarden.llm.pages import extract
from logwarden.llm.periodic import periodic_runs, strongest, with_planted_periods
from logwarden.llm.quality_gam import quality_scores
from logwarden.llm.rules import quality_rules
from logwarden.llm.sentencepiece_codec import encode_decode
from logwarden.llm.shards import minimax_shards
from logwarden.llm.spans import substring_dedup
from logwarden.llm.spelling import occurrences, spelling_variants, with_planted_errors
from logwarden.llm.token_counts import token_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op10_minhash_near_dedup(spark: SparkSession, d: str) -> DataFrame:
    found = near_duplicates(table(spark, d, "documents").select("doc_id", "text"), NearDups(shingle=3, percent=85))
    return found.select("doc_id", "n_shingles", "component_id", "kept")


@query
def op1_substring_dedup(spark: SparkSession, d: str) -> DataFrame:
    return substring_dedup(table(spark, d, "documents").select("doc_id", "text"), count="n_cut")


@query
def op5_benchmark_decontamination(spark: SparkSession, d: str) -> DataFrame:
    found = leaks(table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "benchmark"))
    return found.select("doc_id", "item_id", F.round("cosine", 4).alias("cosine"), F.round("lcs", 4).alias("lcs"), F.round("answer", 4).alias("answer"))


@query
def op7_quality_rules(spark: SparkSession, d: str) -> DataFrame:
    found = quality_rules(table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "labels"))
    return found.select("doc_id", "rules.*")


@query
def op9_token_counts(spark: SparkSession, d: str) -> DataFrame:
    return token_counts(table(spark, d, "documents").select("doc_id", "text"), corpus_pipeline.vocabulary())


@query
def op8_sentencepiece(spark: SparkSession, d: str) -> DataFrame:
    return encode_decode(table(spark, d, "documents").select("doc_id", "text"), corpus_pipeline.vocabulary())


@query
def op2_sharding(spark: SparkSession, d: str) -> DataFrame:
    placed = minimax_shards(table(spark, d, "documents").select("doc_id", "text"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query
def op6_chat_formatting(spark: SparkSession, d: str) -> DataFrame:
    return perspectives(table(spark, d, "conversations"))


ORACLES["op6_chat_formatting"] = PERSPECTIVES_SQL


@query
def op3_html_extraction(spark: SparkSession, d: str) -> DataFrame:
    found = extract(table(spark, d, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query
def op4_quality_classifier(spark: SparkSession, d: str) -> DataFrame:
    return quality_scores(table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "labels"))


@query
def op11_spelling_variants(spark: SparkSession, d: str) -> DataFrame:
    return spelling_variants(with_planted_errors(occurrences(table(spark, d, "documents").select("doc_id", "text"))))


@query
def op12_source_mixing(spark: SparkSession, d: str) -> DataFrame:
    return mix(table(spark, d, "documents").select("doc_id", "source", "text")).select("doc_id", "size", "source_size", "target", "taken")


@query
def op13_periodic_runs(spark: SparkSession, d: str) -> DataFrame:
    found = periodic_runs(with_planted_periods(table(spark, d, "documents").select("doc_id", "text"))).withColumn("best", strongest(F.col("runs")))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    joined = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.*", F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(joined, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


@query
def pipeline(spark: SparkSession, d: str) -> DataFrame:
    return corpus_pipeline.run(spark, d)
