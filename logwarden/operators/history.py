"""First-time flags against a stored history of (entity, value) pairs."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from logwarden.functions.scalars import flag
from logwarden.functions.timestamps import micros, utc_wall
from logwarden.session import cut_lineage

PAIR = ["field", "entity", "value"]


def pairs_of(df: DataFrame, entity: str, fields: list[str], *more: str) -> DataFrame:
    """(field, entity, value, *more) per row and field; rows without entity or value are left out."""
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields]))
    named = df.select(F.col(entity).cast("string").alias("entity"), each.alias("p"), *more)
    return named.select("p.field", "entity", "p.value", *more).where("entity IS NOT NULL AND value IS NOT NULL")


def known_pairs(df: DataFrame, entity: str, fields: list[str]) -> DataFrame:
    """The distinct (field, entity, value) of ``df``."""
    return pairs_of(df, entity, fields).distinct()


def bloom_bits(hashes: np.ndarray, per_pair: int, rounds: int) -> np.ndarray:
    """A Bloom filter of 64-bit hashes with ``per_pair`` bits for each, as bytes."""
    bits = np.zeros(-(-max(len(hashes), 1) * per_pair // 64) * 64, np.uint8)
    bits[bloom_places(hashes, len(bits), rounds)] = 1
    return np.packbits(bits)


def bloom_places(hashes: np.ndarray, size: int, rounds: int) -> np.ndarray:
    """Bits that the hashes set, one row per round."""
    h = hashes.astype(np.uint64)
    step = (h >> np.uint64(32)) | np.uint64(1)
    return np.stack([(h + np.uint64(i) * step) % np.uint64(size) for i in range(rounds)]).astype(np.int64)


@dataclass(frozen=True)
class KnownPairs:
    """A folder of the pairs seen so far, one sub-folder per batch.

    A batch is written over if it is run again, and it only sees batches with smaller numbers, so a rerun after a failure
    gives the same flags and leaves the same store.  Pairs are dealt into ``parts`` by hash; beside each part of each batch lies a
    Bloom filter of ``bits`` bits a pair, so pairs never seen before are told apart without reading the pairs
    themselves.  The filters are written last: a batch without them does not count.
    """

    path: str
    parts: int = 256
    bits: int = 16
    hashes: int = 7

    def _hashed(self, pairs: DataFrame) -> DataFrame:
        hashed = pairs.select(*PAIR).withColumn("h", F.xxhash64(*PAIR))
        return hashed.withColumn("part", F.pmod("h", F.lit(self.parts)).cast("int"))

    def _read(self, spark: SparkSession, kind: str, columns: str, batch: int | None) -> DataFrame:
        schema = f"{columns}, batch long, part int"
        spark.createDataFrame([], schema).write.mode("ignore").partitionBy("batch", "part").parquet(f"{self.path}/{kind}")
        held = spark.read.schema(schema).parquet(f"{self.path}/{kind}")
        return held if batch is None else held.where(F.col("batch") < batch)

    def pairs(self, spark: SparkSession, before: int | None = None) -> DataFrame:
        """(field, entity, value, part, batch) of the finished batches."""
        finished = self._filters(spark, before).select("batch").distinct()
        held = self._read(spark, "pairs", "field string, entity string, value string", before)
        return held.join(F.broadcast(finished), "batch", "left_semi")  # one row per batch

    def _filters(self, spark: SparkSession, before: int | None) -> DataFrame:
        return self._read(spark, "filters", "bits binary", before)

    def append(self, pairs: DataFrame, batch: int) -> None:
        """Store the distinct pairs as batch ``batch``, in place of what it held."""
        new = self._hashed(pairs).dropDuplicates(PAIR)
        new.select(*PAIR, "part").write.mode("overwrite").partitionBy("part").parquet(f"{self.path}/pairs/batch={batch}")
        per_pair, rounds = self.bits, self.hashes

        def build(pdf: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"part": [pdf["part"].iloc[0]], "bits": [bloom_bits(pdf["h"].to_numpy(), per_pair, rounds).tobytes()]})

        written = self._hashed(pairs.sparkSession.read.schema("field string, entity string, value string, part int")
                               .parquet(f"{self.path}/pairs/batch={batch}"))
        filters = written.select("part", "h").groupBy("part").applyInPandas(build, "part int, bits binary")
        filters.write.mode("overwrite").partitionBy("part").parquet(f"{self.path}/filters/batch={batch}")

    def perhaps_known(self, pairs: DataFrame, batch: int | None = None) -> DataFrame:
        """The pairs (with their part) that a filter of an earlier batch may hold: all that are known and few others."""
        rounds = self.hashes
        schema = "field string, entity string, value string, h long, part int"

        def probe(mine: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
            hashes = mine["h"].to_numpy()
            hit = np.zeros(len(mine), bool)
            for held in filters["bits"]:
                bits = np.unpackbits(np.frombuffer(held, np.uint8))
                hit |= bits[bloom_places(hashes, len(bits), rounds)].all(axis=0)
            return mine[hit]

        filters = self._filters(pairs.sparkSession, batch)
        return self._hashed(pairs).groupBy("part").cogroup(filters.groupBy("part")).applyInPandas(probe, schema).select(*PAIR, "part")

    def known(self, pairs: DataFrame, batch: int | None = None) -> DataFrame:
        """The (field, entity, value) of ``pairs`` that an earlier batch holds."""
        held = self.pairs(pairs.sparkSession, batch).select("part", *PAIR)
        return self.perhaps_known(pairs, batch).join(held, ["part", *PAIR], "left_semi").select(*PAIR)

    def compact(self, spark: SparkSession, into: str) -> KnownPairs:
        """A store at ``into`` that holds all pairs as one batch with the number of the last, so that probes read one filter a part."""
        last = self._filters(spark, None).agg(F.max("batch")).first()[0]
        made = KnownPairs(into, self.parts, self.bits, self.hashes)
        if last is not None:
            made.append(self.pairs(spark), int(last))
        return made


def first_time(df: DataFrame, entity: str, fields: dict[str, str], ts: str, record: str, known: DataFrame | KnownPairs | None = None,
               batch: int | None = None, events: DataFrame | None = None) -> DataFrame:
    """Add a flag per field of ``fields`` (field: flag name): 1 on the entity's first event with this value, unless it is known.

    The first event of a pair is a minimum by time and ``record``, which combines before the
    shuffle, so a busy entity or value needs no window.  ``known`` holds (field, entity, value), or is a store, of which batches before
    ``batch`` count.  ``record`` identifies rows; rows without entity or value get 0.  ``events`` may give the
    same rows without columns that are costly to compute.
    """
    events = df if events is None else events
    at = F.struct(micros(utc_wall(events, ts)).alias("t"), F.col(record).alias("id"))
    firsts = pairs_of(events.withColumn("_at", at), entity, list(fields), "_at").groupBy(*PAIR).agg(F.min("_at").alias("_at"))
    if isinstance(known, KnownPairs):
        firsts = cut_lineage(firsts, "first-events")
        known = known.known(firsts, batch)
    new = firsts if known is None else firsts.join(known.select(*PAIR), PAIR, "left_anti")
    marks = new.groupBy(F.col("_at.id").alias("_id")).agg(*[F.max(flag(F.col("field") == f)).alias(name) for f, name in fields.items()])
    joined = df.join(marks, F.col(record) == F.col("_id"), "left").drop("_id")
    return joined.withColumns({name: F.coalesce(name, F.lit(0)) for name in fields.values()}).select(*df.columns, *fields.values())
