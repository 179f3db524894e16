"""Turn raw lines into JSON records."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def envelope(line: Column, stamp: Column) -> Column:
    """Valid JSON stays; any other line is wrapped as a log record.

    ``stamp`` is the time given to wrapped lines, normally the ingest time.
    """
    text = F.regexp_replace(line, r"[\r\n]+$", "")
    wrapped = F.to_json(F.struct(
        stamp.alias("timestamp"), text.alias("raw_log"), F.lit("0.0.0.0").alias("src_ip"),
        F.lit("0.0.0.0").alias("dst_ip"), F.lit("TCP").alias("protocol"), F.lit("log_entry").alias("action")))
    return F.when(F.try_parse_json(text).isNotNull(), text).otherwise(wrapped)
