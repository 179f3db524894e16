"""Windows event XML -> flat columns."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from logwarden.functions.syslog import last_wins, let

_TEXT = "STRUCT<_VALUE: STRING>"
EVENT_SCHEMA = """
System STRUCT<
  Provider: STRUCT<_Name: STRING, _Guid: STRING, _EventSourceName: STRING>,
  EventID: STRUCT<_VALUE: STRING, _Qualifiers: STRING>,
  Version: STRING, Level: STRING, Task: STRING, Opcode: STRING, Keywords: STRING,
  TimeCreated: STRUCT<_SystemTime: STRING>,
  EventRecordID: STRING,
  Correlation: STRUCT<_ActivityID: STRING, _RelatedActivityID: STRING>,
  Execution: STRUCT<_ProcessID: STRING, _ThreadID: STRING>,
  Channel: STRING, Computer: STRING,
  Security: STRUCT<_UserID: STRING>>,
EventData STRUCT<Data: ARRAY<STRUCT<_Name: STRING, _VALUE: STRING>>, Binary: STRING>,
_corrupt STRING
"""


@F.pandas_udf(T.MapType(T.StringType(), T.StringType()))
def _user_data(xml: pd.Series) -> pd.Series:
    """Dotted keys of the free-form UserData section; no schema can name them."""
    from xml.etree import ElementTree

    def local(tag: str) -> str:
        return tag.rsplit("}", 1)[-1]

    def pairs(node, path):
        text = (node.text or "").strip()
        if text:
            yield path, text
        for name, value in node.attrib.items():
            yield f"{path}.@{name}", value
        for child in node:
            yield from pairs(child, f"{path}.{local(child.tag)}")

    def read(text):
        if text is None or "UserData" not in text:
            return {}
        try:
            root = ElementTree.fromstring(text)
        except ElementTree.ParseError:
            return {}
        sections = [n for n in root if local(n.tag) == "UserData"]
        return dict(p for s in sections[:1] for top in s for p in pairs(top, local(top.tag)))

    return xml.map(read)


def parse_events(df: DataFrame, column: str) -> DataFrame:
    """Add the columns of one event per row; all null when the text is not well-formed XML.

    The parsed event is a column of its own first, so the text is parsed once.
    """
    staged = df.withColumn("_event", F.from_xml(F.col(column), EVENT_SCHEMA, {
        "columnNameOfCorruptRecord": "_corrupt", "mode": "PERMISSIVE", "ignoreSurroundingSpaces": "false"}))
    return staged.select(*df.columns, *_event_columns(F.col("_event"), F.col(column)))


def _event_columns(event: Column, xml: Column) -> list[Column]:
    system = event["System"]

    def attribute(element: str, name: str) -> Column:
        holder = system[element]
        return F.when(holder.isNotNull(), F.coalesce(holder[f"_{name}"], F.lit(""))).alias(f"{element}.{name}")

    def text(element: str) -> Column:
        return F.when(system.isNotNull(), F.coalesce(system[element], F.lit(""))).alias(element)

    def keyed(data: Column) -> Column:
        earlier = lambda i: F.size(F.filter(
            F.slice(data, 1, i), lambda e: e["_Name"].isNull() | e["_Name"].startswith("Data")))
        return F.transform(data, lambda d, i: F.struct(
            F.coalesce(F.nullif(d["_Name"], F.lit("")), F.concat(F.lit("Data"), earlier(i))).alias("key"),
            F.coalesce(d["_VALUE"], F.lit("")).alias("value")))

    named = let(event["EventData"]["Data"], keyed)
    event_data = F.coalesce(F.map_from_entries(last_wins(named)), F.create_map().cast("map<string,string>"))
    binary = event["EventData"]["Binary"]
    with_binary = F.when(F.length(binary) > 0, F.map_concat(
        event_data, F.create_map(F.lit("Binary"), binary))).otherwise(event_data)

    return [
        F.coalesce(system["TimeCreated"]["_SystemTime"], F.lit("")).alias("timestamp"),
        attribute("Provider", "Name"), attribute("Provider", "Guid"), attribute("Provider", "EventSourceName"),
        system["EventID"]["_VALUE"].alias("EventID"), attribute("EventID", "Qualifiers"),
        text("Version"), text("Level"), text("Task"), text("Opcode"), text("Keywords"),
        system["TimeCreated"]["_SystemTime"].alias("TimeCreated"), text("EventRecordID"),
        attribute("Correlation", "ActivityID"), attribute("Correlation", "RelatedActivityID"),
        attribute("Execution", "ProcessID"), attribute("Execution", "ThreadID"),
        text("Channel"), text("Computer"), attribute("Security", "UserID"),
        with_binary.alias("EventData"), _user_data(xml).alias("UserData"),
        event["_corrupt"].alias("_corrupt_record"),
    ]
