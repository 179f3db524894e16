"""Syslog line parsing as column expressions (both RFC forms)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from logwarden import constants as K
from logwarden.functions.scalars import _col
from logwarden.functions.timestamps import iso8601, parse_timestamp, to_utc

_MARK = "\u0001"


def _groups(line: Column, pattern: str, count: int) -> Column:
    """All capture groups of an anchored pattern as an array, null if no match.

    One replacement and a split run the pattern once for all groups, where a
    ``regexp_extract`` per group would run it ``count`` times.
    """
    template = _MARK.join(f"${i}" for i in range(1, count + 1))
    return F.when(line.rlike(pattern), F.split(F.regexp_replace(line, pattern, template), _MARK, count))


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def facility_name(code: Column) -> Column:
    names = F.array(*[F.lit(n) for n in K.FACILITY_NAMES])
    return F.coalesce(F.when(code >= 0, F.get(names, code)), F.concat(F.lit("unknown("), code, F.lit(")")))


def severity_name(code: Column) -> Column:
    names = F.array(*[F.lit(n) for n in K.SEVERITY_NAMES])
    return F.coalesce(F.when(code >= 0, F.get(names, code)), F.concat(F.lit("unknown("), code, F.lit(")")))


def decode_priority(pri: Column | str) -> list[Column]:
    pri = _col(pri).cast("int")
    facility, severity = F.floor(pri / 8).cast("int"), F.pmod(pri, F.lit(8)).cast("int")
    return [
        facility.alias("facility"), facility_name(facility).alias("facility_name"),
        severity.alias("severity"), severity_name(severity).alias("severity_name"),
    ]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def last_wins(items: Column, key: str = "key") -> Column:
    """Drop array entries that have a later entry with the same key."""
    return let(items, lambda v: F.filter(v, lambda x, i: ~F.exists(
        F.slice(v, i + 2, F.size(v)), lambda y: y[key] == x[key])))


def structured_data(sd: Column | str) -> Column:
    """``[id k="v" ...]`` elements -> MAP('id.k' -> v); ``-`` gives an empty map."""
    sd = _col(sd)
    ids = F.regexp_extract_all(sd, F.lit(K.SD_ELEMENT), F.lit(1))
    bodies = F.regexp_extract_all(sd, F.lit(K.SD_ELEMENT), F.lit(2))
    elements = last_wins(F.zip_with(ids, bodies, lambda i, b: F.struct(i.alias("key"), b.alias("body"))))

    def params(element: Column) -> Column:
        names = F.regexp_extract_all(element["body"], F.lit(K.SD_PARAM), F.lit(1))
        values = F.regexp_extract_all(element["body"], F.lit(K.SD_PARAM), F.lit(2))
        return F.zip_with(names, values, lambda n, v: F.struct(
            F.concat(element["key"], F.lit("."), n).alias("key"), F.regexp_replace(v, K.SD_ESCAPED, "$1").alias("value")))

    return F.map_from_entries(last_wins(F.flatten(F.transform(elements, params))))


def is_line(line: Column | str) -> Column:
    """Whether a line has either form (a tagged BSD line has the plain form as well)."""
    line = _strip(_col(line))
    return F.coalesce(line.rlike(K.IETF_LINE) | line.rlike(K.BSD_PLAIN), F.lit(False))


def parse_lines(df: DataFrame, column: str, year: int | None = None, into: str = "parsed") -> DataFrame:
    """Add a struct of the parts of each line, null if neither form fits; RFC 5424 goes first.

    Capture groups are columns of their own first, so each pattern runs once
    per line however often its groups are used.
    """
    line = _strip(F.col(column))
    unmatched = F.col("_new").isNull()
    staged = df.withColumn("_new", _groups(line, K.IETF_LINE, 9)).withColumns({
        "_tagged": F.when(unmatched, _groups(line, K.BSD_TAGGED, 5)), "_plain": F.when(unmatched, _groups(line, K.BSD_PLAIN, 4))})
    new, tagged, plain = F.col("_new"), F.col("_tagged"), F.col("_plain")
    is_new = new.isNotNull()
    old_time = F.get(plain, F.lit(1))
    staged = staged.withColumns({"_pri": F.get(F.coalesce(new, plain), F.lit(0)).try_cast("int"),
                                 "_iso": iso8601(to_utc(parse_timestamp(old_time, year)))})
    tag = F.when(~is_new, F.get(tagged, F.lit(3)))
    dash = lambda i: F.nullif(F.get(new, F.lit(i)), F.lit("-"))
    parts = F.struct(
        F.when(is_new, F.coalesce(dash(2), F.lit(""))).otherwise(
            F.coalesce(F.regexp_replace("_iso", r"\.000Z$", ""), old_time)).alias("timestamp"),
        F.when(is_new, "RFC5424").otherwise("RFC3164").alias("format"),
        F.col("_pri").alias("priority"), *decode_priority("_pri"),
        F.get(new, F.lit(1)).try_cast("int").alias("version"),
        F.when(~is_new, old_time).alias("timestamp_raw"),
        F.when(is_new, dash(3)).otherwise(F.get(plain, F.lit(2))).alias("hostname"),
        dash(4).alias("app_name"), dash(5).alias("proc_id"), dash(6).alias("msg_id"),
        tag.alias("tag"),
        F.split_part(F.regexp_replace(tag, r"[\[\]]+$", ""), F.lit("["), F.lit(1)).alias("program"),
        _strip(F.coalesce(F.get(new, F.lit(8)), F.get(tagged, F.lit(4)), F.get(plain, F.lit(3)))).alias("message"),
        F.when(is_new, structured_data(F.get(new, F.lit(7)))).alias("sd"))
    return staged.withColumn(into, F.when(is_new | plain.isNotNull(), parts)).drop("_new", "_tagged", "_plain", "_pri", "_iso")
