"""Stateful streams: cooldown, running sessions, first-seen values.

Order inside a micro-batch is event time.  The rows of a group of keys in one micro-batch are
sorted in its task, so bound micro-batches with ``maxFilesPerTrigger`` or
``maxBytesPerTrigger``; only the columns a processor needs are sent to it.
Keys are handled by groups of hashed keys, with one state and one call a micro-batch each, so that a key costs
neither calls of its own to the state store nor a frame of its own; ``groups`` bounds the calls and is fixed for a checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from logwarden import constants as K
from logwarden.functions.timestamps import micros, utc_wall

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: Groups of keys that have one state each.
KEY_GROUPS = 512


@contextmanager
def rocksdb_state(spark: SparkSession):
    """Keep the state of many keys in the RocksDB store instead of the heap."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def _group(groups: int) -> Column:
    return F.pmod(F.xxhash64("key"), F.lit(groups))


def _sorted(batches: Iterator[pd.DataFrame]) -> pd.DataFrame:
    pdf = pd.concat(list(batches), ignore_index=True)
    return pdf.sort_values(["t", "id"]) if len(pdf) > 1 else pdf


def _cooldown(pause: int, ttl: int):
    """Kept rows of a group of keys in one micro-batch; the state is the keys with the times of their last kept rows."""

    def run(group: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = dict(zip(*state.get)) if state.exists else {}
        if not state.hasTimedOut:
            pdf = _sorted(rows)
            kept = []
            for k, t, i in zip(pdf["key"], pdf["t"], pdf["id"]):
                if k not in last or t - last[k] >= pause:
                    last[k] = int(t)
                    kept.append(i)
            if kept:
                yield pd.DataFrame({"id": pd.Series(kept, dtype=pdf["id"].dtype)})
        now = max(state.getCurrentWatermarkMs(), 0)
        last = {k: t for k, t in last.items() if (t + ttl) // 1000 > now}
        if last:
            state.update((list(last), list(last.values())))
            state.setTimeoutTimestamp((min(last.values()) + ttl) // 1000)
        elif state.exists:
            state.remove()

    return run


def cooldown_stream(stream: DataFrame, fp: str, ts: str, record: str, seconds: float = K.COOLDOWN_SECONDS,
                    ttl_seconds: int = K.STATE_TTL_SECONDS, delay: str = "10 minutes", groups: int = KEY_GROUPS) -> DataFrame:
    """Identifiers of rows kept by the cooldown.

    A fingerprint's state is dropped ``ttl_seconds`` of event time after its
    last kept row; by then the cooldown is over, so results do not change.
    Rows later than ``delay`` are left out.
    """
    rows = stream.select(F.col(fp).alias("key"), F.timestamp_micros(micros(utc_wall(stream, ts))).alias("_ts"),
                         micros(utc_wall(stream, ts)).alias("t"), F.col(record).alias("id"))
    ttl = max(int(ttl_seconds), int(seconds)) * 1_000_000
    return rows.withWatermark("_ts", delay).withColumn("group", _group(groups)).groupBy("group").applyInPandasWithState(
        _cooldown(int(seconds * 1_000_000), ttl), T.StructType([rows.schema["id"]]),
        T.StructType([T.StructField("keys", T.ArrayType(rows.schema["key"].dataType)), T.StructField("last", T.ArrayType(T.LongType()))]), "append", GroupStateTimeout.EventTimeTimeout).withColumnRenamed("id", record)


def _sessions(timeout: int):
    """Session values of a group of keys' rows in one micro-batch; the state is the keys with their running sessions."""

    def run(group: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pdf = _sorted(rows)
        running = {k: v for k, *v in zip(*state.get)} if state.exists else {}
        out = []
        for k, t, i in zip(pdf["key"], pdf["t"], pdf["id"]):
            t = int(t)
            last, start, number, events = running.get(k, (t, t, 0, 0))
            if t - last > timeout:
                start, number, events = t, number + 1, 0
            # A late row joins the running session and does not move its end back.
            events, last = events + 1, max(last, t)
            running[k] = last, start, number, events
            out.append((i, number, events, max(t - start, 0) / 1e6))
        state.update((list(running), *map(list, zip(*running.values()))))
        yield pd.DataFrame(out, columns=["id", "session_id", "events_in_session", "session_duration_seconds"])

    return run


def sessions_stream(stream: DataFrame, entity: str, ts: str, record: str,
                    timeout: float = K.SESSION_TIMEOUT_SECONDS, groups: int = KEY_GROUPS) -> DataFrame:
    """Running session values per event, as the batch operator gives them for rows in order.

    The state of an entity is its key and four numbers and stays, so that session numbers go on.
    """
    rows = stream.where(F.col(entity).isNotNull()).select(
        F.col(entity).cast("string").alias("key"), micros(utc_wall(stream, ts)).alias("t"), F.col(record).alias("id"))
    id_type = rows.schema["id"].dataType.simpleString()
    return rows.withColumn("group", _group(groups)).groupBy("group").applyInPandasWithState(
        _sessions(int(timeout * 1_000_000)),
        f"id {id_type}, session_id long, events_in_session long, session_duration_seconds double",
        "keys array<string>, last array<long>, start array<long>, number array<long>, events array<long>", "append", GroupStateTimeout.NoTimeout).withColumnRenamed("id", record)


def session_windows(stream: DataFrame, entity: str, ts: str, timeout: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    """One row per closed session.

    Late rows within ``delay`` still join their session.  The session default
    ``merge.sessions.in.local.partition`` keeps a busy entity from sending
    every row to one task.
    """
    timed = stream.withColumn("_ts", F.timestamp_micros(micros(utc_wall(stream, ts)))).withWatermark("_ts", delay)
    return timed.groupBy(entity, F.session_window("_ts", timeout).alias("w")).agg(
        F.count(F.lit(1)).alias("events")).select(entity, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")


def first_seen_stream(stream: DataFrame, entity: str, field: str, ts: str, delay: str = "30 days") -> DataFrame:
    """First row per (entity, value); a pair is forgotten once the watermark passes it by ``delay``."""
    timed = stream.where(F.col(entity).isNotNull() & F.col(field).isNotNull()).withColumn(
        "_ts", F.timestamp_micros(micros(utc_wall(stream, ts)))).withWatermark("_ts", delay)
    return timed.dropDuplicatesWithinWatermark([entity, field]).drop("_ts")
