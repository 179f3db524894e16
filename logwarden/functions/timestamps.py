"""Timestamp parsing, UTC conversion and calendar features.

All expressions work on UTC wall-clock time (``TIMESTAMP_NTZ``), so results do
not depend on the session time zone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from logwarden import constants as K
from logwarden.functions.scalars import flag, quoted

_ZONE = r"(Z|[+-]\d{2}:?\d{2})$"
_TAIL = r"(\s*(Z|[+-]\d{2}:?\d{2}))?$"
# Layout and the shape of the text it is tried on, month before day.
FREE_FORMS = [
    ("yyyy/MM/dd HH:mm:ss", r"^\d{4}/\d{2}/\d{2} \d{2}:\d{2}:\d{2}"), ("yyyy/MM/dd", r"^\d{4}/\d{2}/\d{2}"),
    ("MM/dd/yyyy HH:mm:ss", r"^\d{2}/\d{2}/\d{4} \d{2}:\d{2}:\d{2}"),
    ("MM/dd/yyyy h:mm:ss a", r"^\d{2}/\d{2}/\d{4} \d{1,2}:\d{2}:\d{2} [AP]M"), ("MM/dd/yyyy", r"^\d{2}/\d{2}/\d{4}"),
    ("MMM d, yyyy HH:mm:ss", r"^[A-Z][a-z]{2} \d{1,2}, \d{4} \d{2}:\d{2}:\d{2}"), ("MMM d, yyyy", r"^[A-Z][a-z]{2} \d{1,2}, \d{4}"),
    ("MMM d yyyy HH:mm:ss", r"^[A-Z][a-z]{2} \d{1,2} \d{4} \d{2}:\d{2}:\d{2}"),
    ("d MMM yyyy HH:mm:ss", r"^\d{1,2} [A-Z][a-z]{2} \d{4} \d{2}:\d{2}:\d{2}"), ("d MMM yyyy", r"^\d{1,2} [A-Z][a-z]{2} \d{4}"),
]


def _zoned(s: Column) -> Column:
    """Append Z to text without an offset: naive time counts as UTC."""
    return F.when(s.rlike(_ZONE), s).otherwise(F.concat(s, F.lit("Z")))


def parse_timestamp(c: Column | str, year: int | None = None) -> Column:
    """Parse log time text of many layouts to TIMESTAMP, null if none fits.

    ``year`` completes layouts without one (BSD syslog); default is this year.
    """
    c = F.col(c) if isinstance(c, str) else c
    s = F.regexp_replace(c.cast("string"), r"^\s+|\s+$", "")
    squeezed = F.regexp_replace(F.regexp_replace(s, r"^[A-Z][a-z]{2},\s*", ""), r"\s+", " ")
    the_year = F.lit(str(year)) if year else F.date_format(F.current_date(), "yyyy")

    def with_zone(text: Column, layout: str) -> Column:
        normal = F.regexp_replace(F.regexp_replace(_zoned(text), r"\s+(?=(Z|[+-]\d{2}:?\d{2})$)", ""),
                                  r"([+-]\d{2}):?(\d{2})$", "$1$2")
        return F.try_to_timestamp(normal, F.lit(layout + "XX"))

    # One CASE: a layout is only tried on text of its shape, so a row runs one parser.
    out = (F.when(s.rlike(r"^\d{10}$"), F.timestamp_seconds(s.try_cast("long")))
           .when(s.rlike(r"^\d{13}$"), F.timestamp_millis(s.try_cast("long")))
           .when(s.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.concat(s, F.lit("T00:00:00Z")).try_cast("timestamp"))
           .when(s.rlike(r"^\d{4}-\d{2}-\d{2}([T ]|\s+\d)"),
                 _zoned(F.regexp_replace(s, r"^(\d{4}-\d{2}-\d{2})\s+(?=\d)", "$1T")).try_cast("timestamp"))
           .when(s.rlike(r"^\d{2}/\w{3}/\d{4}:\d{2}:\d{2}:\d{2}"), with_zone(s, "dd/MMM/yyyy:HH:mm:ss"))
           .when(s.rlike(r"^[A-Z][a-z]{2}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}"),
                 with_zone(F.concat(the_year, F.lit(" "), squeezed), "yyyy MMM d HH:mm:ss")))
    for layout, shape in FREE_FORMS:
        out = out.when(squeezed.rlike(shape + _TAIL), with_zone(squeezed, layout))
    return out


def to_utc(ts: Column) -> Column:
    """TIMESTAMP -> UTC wall clock (TIMESTAMP_NTZ)."""
    return F.convert_timezone(None, F.lit("UTC"), ts.cast("timestamp_ntz"))


def utc_wall(df: DataFrame, name: str) -> Column:
    """UTC wall clock of a column, whatever its type."""
    dtype, c = df.schema[name].dataType, quoted(name)
    if isinstance(dtype, T.TimestampNTZType):
        return c
    if isinstance(dtype, T.TimestampType):
        return to_utc(c)
    if isinstance(dtype, T.DateType):
        return c.cast("timestamp_ntz")
    return to_utc(parse_timestamp(c))


def iso8601(wall: Column) -> Column:
    """ISO text with milliseconds cut, not rounded, and a Z."""
    return F.date_format(wall, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def micros(wall: Column) -> Column:
    """Microseconds since 1970 of a UTC wall clock."""
    return F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), wall)


def calendar_features(wall: Column, prefix: str = "time", cyclical: bool = True,
                      start_hour: int = K.BUSINESS_START_HOUR, end_hour: int = K.BUSINESS_END_HOUR,
                      weekend: list[int] | None = None) -> list[Column]:
    """Hour and weekday (circle or plain), weekend and business-hour flags; 0 without a time."""
    weekend = K.WEEKEND_DAYS if weekend is None else weekend
    hour, dow = F.hour(wall), F.weekday(wall)
    if cyclical:
        def turn(v: Column, period: int, name: str) -> list[Column]:
            angle = F.lit(2.0) * F.pi() * v / F.lit(float(period))
            return [F.coalesce(F.sin(angle), F.lit(0.0)).alias(f"{prefix}_{name}_sin"),
                    F.coalesce(F.cos(angle), F.lit(0.0)).alias(f"{prefix}_{name}_cos")]
        clock = turn(hour, 24, "hour") + turn(dow, 7, "dow")
    else:
        clock = [F.coalesce(hour, F.lit(0)).alias(f"{prefix}_hour"),
                 F.coalesce(dow, F.lit(0)).alias(f"{prefix}_day_of_week")]
    return clock + [
        flag(dow.isin(weekend)).alias(f"{prefix}_is_weekend"),
        flag((hour >= start_hour) & (hour < end_hour) & ~dow.isin(weekend)).alias(f"{prefix}_is_business_hours"),
    ]
