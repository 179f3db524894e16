"""Feature extractors: what each learns from a fitted frame and what it adds to another.

An extractor is an object of a class derived from :class:`Extractor`.  What it learns is a set of tables, so
its state may be as large as the data asks for; :class:`~logwarden.plans.features.FeaturePipeline` stores
them with the fitted model.  :func:`register` makes an extractor known by its name, which is how a stored model finds it again.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from logwarden import constants as K
from logwarden.functions.scalars import port_flags
from logwarden.functions.timestamps import calendar_features, utc_wall
from logwarden.operators import behavior, entity as ent, history, temporal
from logwarden.operators.history import KnownPairs


@dataclass(frozen=True)
class Feature:
    """Name, meaning, kind, number type, default and bounds of a feature."""

    name: str
    description: str
    kind: str
    dtype: str = "double"
    default: float = 0.0
    minimum: float | None = None
    maximum: float | None = None


@dataclass(frozen=True)
class FeatureConfig:
    """Columns and choices of the extractors; ``groups`` names the extractors in order.

    With ``clock_shares`` each row also gets the share that its hour and weekday have in the fitted frame.
    """

    entity: str = "src_ip"
    ts: str = "timestamp_normalized"
    record: str = "record_id"
    action: str = "action"
    dst: str = "dst_ip"
    port: str = "dst_port"
    protocol: str = "protocol"
    size: str = "bytes_total"
    numeric: list[str] = field(default_factory=lambda: ["bytes_total", "bytes_in", "bytes_out"])
    categorical: list[str] = field(default_factory=lambda: ["dst_ip", "dst_port", "action", "protocol"])
    percentiles: list[int] = field(default_factory=lambda: list(K.PERCENTILES))
    deviation: list[str] = field(default_factory=lambda: ["bytes_total", "dst_port"])
    groups: list[str] = field(default_factory=lambda: ["statistical", "temporal", "behavioral", "network"])
    include_only: list[str] | None = None
    exclude: list[str] = field(default_factory=list)
    keep_originals: bool = True
    cyclical: bool = True
    approximate_percentiles: bool = False
    clock_shares: bool = False


State = dict[str, DataFrame]


class Extractor(ABC):
    """One group of features.

    The frame ``rows`` given to :meth:`transform` has the batch's columns, the added features of earlier extractors, ``_key`` (the
    entity as text, one of its own for rows without entity) and, if the batch has times, ``_t`` (microseconds).  ``batch`` is
    the same frame before anything was added: profiles are best taken from it, as Spark then reads their columns only.
    All features must be numbers; absent columns make an extractor leave its features out, and they then get their defaults.
    """

    name: str

    @abstractmethod
    def definitions(self, c: FeatureConfig) -> list[Feature]:
        """Every feature of the extractor, in order."""

    def fit(self, df: DataFrame, c: FeatureConfig) -> State:
        """What it learns, as tables; a stored model keeps them."""
        return {}

    @abstractmethod
    def transform(self, rows: DataFrame, batch: DataFrame, c: FeatureConfig, state: State, cold: bool = False) -> DataFrame:
        """``rows`` with the features; ``cold`` says that no entity is large (see ``operators.runs``)."""


EXTRACTORS: dict[str, Extractor] = {}


def register(extractor: Extractor) -> Extractor:
    """Make ``extractor`` usable by its name in ``FeatureConfig.groups`` and in stored models."""
    EXTRACTORS[extractor.name] = extractor
    return extractor


def extractor(name: str) -> Extractor:
    if name not in EXTRACTORS:
        raise KeyError(f"feature extractor {name!r} is not registered; known: {', '.join(EXTRACTORS)}")
    return EXTRACTORS[name]


def _profile(p: DataFrame, entity: str) -> DataFrame:
    return p.withColumn("_key", F.col(entity).cast("string")).drop(*([entity] if entity != "_key" else []))


class Statistical(Extractor):
    """Distribution of each numeric and categorical field per entity of the batch."""

    name = "statistical"

    def definitions(self, c):
        out = [Feature("stat_record_count", "rows of the entity", "statistical", "long", minimum=0)]
        for f in c.numeric:
            out += [Feature(f"stat_{f}_{s}", f"{s} of {f}", "statistical") for s in ("mean", "std", "min", "max")]
            out += [Feature(f"stat_{f}_p{p}", f"percentile {p} of {f}", "statistical") for p in c.percentiles]
        for f in c.categorical:
            out += [Feature(f"stat_{f}_unique", f"distinct {f}", "statistical", "long", minimum=0),
                    Feature(f"stat_{f}_entropy", f"entropy of {f} in bits", "statistical", minimum=0)]
        return out

    def fit(self, df, c):
        """``global_stats`` per field and ``entity_means`` per entity, for reports beside the features."""
        fields = [f for f in c.numeric if f in df.columns]
        return {"global_stats": ent.global_stats(df, fields), "entity_means": ent.entity_means(df, c.entity, fields)} if fields else {}

    def transform(self, rows, batch, c, state, cold=False):
        numeric, categorical = ([f for f in names if f in batch.columns] for names in (c.numeric, c.categorical))
        profile = ent.numeric_profile(batch, c.entity, numeric)
        if numeric:
            profile = profile.join(ent.percentile_profiles(batch, c.entity, numeric, c.percentiles, approximate=c.approximate_percentiles), c.entity)
        if categorical:
            profile = profile.join(ent.category_profile(batch, c.entity, categorical), c.entity)
        return ent.attach(rows, _profile(profile, c.entity), "_key")


class Temporal(Extractor):
    """Clock position, time since earlier events and trailing counts."""

    name = "temporal"

    def definitions(self, c):
        flags = dict(dtype="int", minimum=0, maximum=1)
        clock = ["hour_sin", "hour_cos", "dow_sin", "dow_cos"] if c.cyclical else ["hour", "day_of_week"]
        out = [Feature(f"time_{n}", "clock position", "temporal") for n in clock]
        out += [Feature("time_is_weekend", "weekend", "temporal", **flags),
                Feature("time_is_business_hours", "business hours", "temporal", **flags),
                Feature("time_delta_entity_seconds", "since the entity's last event", "temporal", minimum=0),
                Feature("time_delta_global_seconds", "since the last event", "temporal", minimum=0),
                Feature("time_events_per_hour", "entity events in the past hour", "temporal", "long", minimum=0)]
        if c.clock_shares:
            out += [Feature(f"time_{n}_share", f"share of the fitted events in this {t}", "temporal", minimum=0, maximum=1)
                    for n, t in (("hour", "hour"), ("dow", "weekday"))]
        return out

    def fit(self, df, c):
        """``hour_share`` (24 rows) and ``dow_share`` (7 rows) of the fitted events."""
        if c.ts not in df.columns:
            return {}
        return {f"{n}_share": temporal.clock_distribution(df, c.ts, part) for n, part in (("hour", "hour"), ("dow", "dow"))}

    def transform(self, rows, batch, c, state, cold=False):
        if c.ts not in rows.columns:
            return rows
        wall = utc_wall(rows, c.ts)
        rows = temporal.delta_global(rows.select("*", *calendar_features(wall, cyclical=c.cyclical)), c.ts, c.record)
        rows = temporal.trailing_count(rows, c.entity, c.ts, c.record, cold=cold)
        rows = temporal.delta_entity(rows, c.entity, c.ts, c.record, cold=cold)
        if c.clock_shares and "hour_share" in state:
            for n, value in (("hour", F.hour(wall)), ("dow", F.weekday(wall))):
                table = state[f"{n}_share"]
                # At most 24 rows.
                side = F.broadcast(table.select(F.col(table.columns[0]).alias("_at"), F.col("share").alias(f"time_{n}_share")))
                rows = rows.join(side, value == F.col("_at"), "left").drop("_at")
        return rows


class Behavioral(Extractor):
    """Sessions, first-time actions and peers, and deviation from what was fitted."""

    name = "behavioral"

    def _fields(self, df, c):
        return {f: n for f, n in ((c.action, "behav_is_new_action"), (c.dst, "behav_is_new_destination")) if f in df.columns}

    def definitions(self, c):
        flags = dict(dtype="int", minimum=0, maximum=1)
        out = [Feature("behav_session_id", "session number", "behavioral", "long", minimum=0),
               Feature("behav_events_in_session", "events so far", "behavioral", "long", minimum=1),
               Feature("behav_session_duration_seconds", "seconds so far", "behavioral", minimum=0),
               Feature("behav_is_new_action", "first time action", "behavioral", **flags),
               Feature("behav_is_new_destination", "first time destination", "behavioral", **flags)]
        for f in c.deviation:
            out += [Feature(f"behav_{f}_zscore", f"z-score of {f}", "behavioral"),
                    Feature(f"behav_{f}_is_anomalous", f"unusual {f}", "behavioral", **flags)]
        return [*out, Feature("behav_deviation_score", "mean absolute z-score", "behavioral", minimum=0)]

    def fit(self, df, c):
        """``known_pairs`` (field, entity, value) and ``deviation`` (entity, mean and deviation per field)."""
        state, fields = {}, [f for f in c.deviation if f in df.columns]
        if self._fields(df, c):
            state["known_pairs"] = history.known_pairs(df, c.entity, list(self._fields(df, c)))
        if fields:
            state["deviation"] = behavior.deviation_baseline(df, c.entity, fields)
        return state

    def transform(self, rows, batch, c, state, cold=False):
        """``state['known_pairs']`` may also be a :class:`KnownPairs` store.  If it is missing every pair counts as known."""
        if c.ts in rows.columns:
            rows = behavior.sessions(rows, c.entity, c.ts, c.record, cold=cold)
            fields, known = self._fields(rows, c), state.get("known_pairs")
            if fields and known is not None:
                rows = history.first_time(rows, c.entity, fields, c.ts, c.record, known, events=batch)
        fields = [f for f in c.deviation if f in rows.columns]
        if fields and "deviation" in state:
            rows = behavior.deviation(rows, "_key", fields, _profile(state["deviation"], c.entity))
        return rows


class Network(Extractor):
    """Ports, protocols and the peers of each entity."""

    name = "network"

    def definitions(self, c):
        flags = dict(dtype="int", minimum=0, maximum=1)
        out = [Feature(f"net_{n}", n.replace("_", " "), "network", **flags) for n in ("dst_port_is_system", "dst_port_is_common", "dst_port_is_dynamic")]
        return out + [Feature("net_unique_dst_ips", "distinct peers", "network", "long", minimum=0),
                      Feature("net_unique_dst_ports", "distinct ports", "network", "long", minimum=0),
                      Feature("net_dst_port_entropy", "port entropy in bits", "network", minimum=0),
                      Feature("net_fanout_ratio", "peers per connection", "network", minimum=0, maximum=1),
                      Feature("net_is_scanner_like", "high fan-out", "network", **flags),
                      Feature("net_bytes_per_conn", "mean bytes", "network", minimum=0),
                      Feature("net_conn_count", "connections", "network", "long", minimum=0),
                      Feature("net_is_tcp", "TCP", "network", **flags), Feature("net_is_udp", "UDP", "network", **flags)]

    def fit(self, df, c):
        """``edges`` (entity, peer) and ``ports`` (events per port), for reports beside the features."""
        state = {"edges": ent.connection_edges(df, c.entity, c.dst)} if c.dst in df.columns else {}
        return state | ({"ports": ent.port_distribution(df, c.port)} if c.port in df.columns else {})

    def transform(self, rows, batch, c, state, cold=False):
        if {c.port, c.protocol} <= set(rows.columns):
            rows = rows.select("*", *port_flags(c.port, c.protocol))
        if {c.dst, c.port, c.size} <= set(rows.columns):
            rows = ent.attach(rows, _profile(ent.network_profile(batch, c.entity, c.dst, c.port, c.size), c.entity), "_key")
        return rows


for _each in (Statistical(), Temporal(), Behavioral(), Network()):
    register(_each)
