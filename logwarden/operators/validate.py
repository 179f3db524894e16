"""Declared log schemas and their validation as columns."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F, types as T

from logwarden import constants as K
from logwarden.functions.scalars import quoted


@dataclass(frozen=True)
class Requirement:
    name: str
    required: bool = False
    kind: str = "any"  # any, str, int, float, bool, list, dict
    aliases: tuple[str, ...] = ()


@dataclass(frozen=True)
class LogSchema:
    name: str
    fields: list[Requirement] = field(default_factory=list)
    require_timestamp: bool = True


# The five predefined schemas with their field aliases.
NETWORK_FLOW = LogSchema("network_flow", [
    Requirement("src_ip", True, "str", ("source_ip", "src", "srcip", "SrcIP", "SourceIP")),
    Requirement("dst_ip", True, "str", ("dest_ip", "dst", "dstip", "DstIP", "DestIP", "destination_ip")),
    Requirement("src_port", False, "int", ("source_port", "srcport", "SrcPort", "SourcePort")),
    Requirement("dst_port", False, "int", ("dest_port", "dstport", "DstPort", "DestPort", "destination_port")),
    Requirement("protocol", False, "str", ("proto", "Protocol")),
])
AUTH_EVENT = LogSchema("auth_event", [
    Requirement("user", True, "str", ("username", "user_name", "UserName", "Account", "account")),
    Requirement("action", True, "str", ("event_type", "EventType", "action_type", "Action")),
    Requirement("result", False, "str", ("status", "Status", "outcome", "Outcome", "success")),
])
WINDOWS_EVENT = LogSchema("windows_event", [
    Requirement("EventID", True, "str", ("event_id", "eventid")),
    Requirement("Channel", False, "str", ("channel", "log_name", "LogName")),
    Requirement("Computer", False, "str", ("computer", "hostname", "ComputerName")),
])
SYSLOG = LogSchema("syslog", [
    Requirement("facility", False, "int"),
    Requirement("severity", False, "int"),
    Requirement("hostname", False, "str", ("host", "source")),
    Requirement("message", True, "str", ("msg", "Message")),
])
GENERIC = LogSchema("generic", [], False)
BY_FORMAT = {"EVTX": WINDOWS_EVENT, "Syslog": SYSLOG}


def schema_for_format(name: str) -> LogSchema:
    return BY_FORMAT.get(name, GENERIC)


def _sources(df: DataFrame, r: Requirement) -> list[str]:
    hits: list[str] = []
    for wanted in (r.name, *r.aliases):
        hits += [c for c in df.columns if c == wanted and c not in hits]
        hits += [c for c in df.columns if c.lower() == wanted.lower() and c not in hits]
    return hits


# Python type names used in messages, by Spark type.
_KIND_NAMES = [(T.StringType, "str"), (T.BooleanType, "bool"), (T.IntegralType, "int"), (T.FractionalType, "float"),
               (T.ArrayType, "list"), ((T.StructType, T.MapType), "dict")]


def _kind(dtype: T.DataType) -> str:
    return next((name for cls, name in _KIND_NAMES if isinstance(dtype, cls)), type(dtype).__name__)


def _fits(kind: str, wanted: str, value: Column) -> Column:
    """Whether a value has, or as text can take, the wanted type."""
    native = {"int": ("int", "bool"), "float": ("int", "float", "bool")}.get(wanted, (wanted,))
    if kind in native:
        return F.lit(True)
    if kind == "str" and wanted == "int":
        return value.rlike(r"^\s*[+-]?\d+\s*$")
    if kind == "str" and wanted == "float":
        return value.rlike(r"(?i)^\s*[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf|infinity|nan)\s*$")
    if kind == "str" and wanted == "bool":
        return F.lower(value).isin("true", "false", "yes", "no", "1", "0")
    return F.lit(False)


def validate(df: DataFrame, schema: LogSchema) -> DataFrame:
    """Canonical fields plus ``errors``, ``warnings`` and ``valid``.

    A type mismatch only warns.  Columns outside the schema are kept.
    """
    errors, warnings, out, used = [], [], [], set()
    taken = {n.lower() for r in schema.fields for n in (r.name, *r.aliases)}
    if schema.require_timestamp:
        present = [c for c in K.REQUIRED_TIMESTAMP_FIELDS if c in df.columns]
        stamp = F.coalesce(*[F.nullif(quoted(c).cast("string"), F.lit("")) for c in present], F.lit(None).cast("string"))
        errors.append(F.when(stamp.isNull(), "Missing required timestamp field"))
        out.append(stamp.alias("timestamp"))
        used.add("timestamp")
    for r in schema.fields:
        sources = _sources(df, r)
        kinds = {_kind(df.schema[s].dataType) for s in sources}
        values = [quoted(s) if len(kinds) == 1 else quoted(s).cast("string") for s in sources]
        value = F.coalesce(*values) if values else F.lit(None).cast("string")
        if r.required:
            errors.append(F.when(value.isNull(), f"Missing required field: {r.name}"))
        if r.kind != "any" and sources:
            actual = kinds.pop() if len(kinds) == 1 else "str"
            warnings.append(F.when(value.isNotNull() & ~_fits(actual, r.kind, value),
                                   f"Field {r.name}: expected {r.kind}, got {actual}"))
        if sources:
            out.append(value.alias(r.name))
            used.add(r.name)
    none = F.array().cast("array<string>")
    rest = [quoted(c) for c in df.columns if c not in used and c.lower() not in taken]
    checked = df.select(*out, *rest,
                        (F.array_compact(F.array(*errors)) if errors else none).alias("errors"),
                        (F.array_compact(F.array(*warnings)) if warnings else none).alias("warnings"))
    return checked.withColumn("valid", F.size("errors") == 0)
