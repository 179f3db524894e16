"""Canonical field names, timestamp normalization, feature selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from logwarden import constants as K
from logwarden.functions.scalars import normalize_name, quoted
from logwarden.functions.timestamps import iso8601, parse_timestamp, to_utc, utc_wall


def _filled(df: DataFrame, name: str) -> Column:
    """Value as text, null when empty; false and 0 count as empty too."""
    c, dtype = quoted(name), df.schema[name].dataType
    if isinstance(dtype, T.BooleanType):
        return F.when(c, F.lit("True"))
    if isinstance(dtype, T.NumericType):
        return F.when(c != 0, c.cast("string"))
    if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(c)
    return F.nullif(c.cast("string"), F.lit(""))


def extract_timestamp(df: DataFrame, fields: list[str] | None = None, nested: bool = True,
                      ignore_case: bool = False) -> Column:
    """First non-empty timestamp field as text, else ''.

    With ``nested`` a name also matches the end of a dotted column.
    """
    fields = K.TIMESTAMP_FIELDS if fields is None else fields
    hits: list[str] = []
    for field in fields:
        same = [c for c in df.columns if (c.lower() == field.lower() if ignore_case else c == field)]
        below = [c for c in df.columns if nested and c.endswith(f".{field}")]
        hits += [c for c in same + below if c not in hits]
    return F.coalesce(*[_filled(df, h) for h in hits], F.lit(""))


def timestamp_candidates(df: DataFrame, fields: list[str] | None = None) -> list[str]:
    """Columns tried for the event time, in order and ignoring case."""
    fields = K.TIMESTAMP_FIELDS if fields is None else fields
    hits: list[str] = []
    for field in fields:
        hits += [c for c in df.columns if c == field and c not in hits]
        hits += [c for c in df.columns if c.lower() == field.lower() and c not in hits]
    return hits


def timestamp_source(df: DataFrame, fields: list[str] | None = None) -> Column:
    """The text of the first candidate that is not empty, null if there is none."""
    return F.coalesce(*[_filled(df, c) for c in timestamp_candidates(df, fields)], F.lit(None).cast("string"))


def normalize_timestamps(df: DataFrame, fields: list[str] | None = None, output: str = "timestamp_normalized",
                         keep_original: bool = True, on_error: str = "keep", year: int | None = None) -> DataFrame:
    """Add the event time as ISO-8601 UTC text.

    The first non-empty candidate is used.  Text that does not parse leaves the
    output null (``keep``), drops the row (``drop``) or gives '' (``empty``).
    """
    found = timestamp_candidates(df, fields)
    if not found:
        return df
    raw = {c: _filled(df, c) for c in found}
    which = F.coalesce(*[F.when(raw[c].isNotNull(), F.lit(c)) for c in found])

    def one(c: str) -> Column:
        if isinstance(df.schema[c].dataType, T.StringType):
            return iso8601(to_utc(parse_timestamp(quoted(c), year)))
        if isinstance(df.schema[c].dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            return iso8601(utc_wall(df, c))
        return iso8601(to_utc(parse_timestamp(quoted(c).cast("string"), year)))

    value = None
    for c in found:
        value = F.when(which == c, one(c)) if value is None else value.when(which == c, one(c))
    out = df.withColumns({"_which": which, output: value})
    if on_error == "drop":
        out = out.where(F.col("_which").isNull() | quoted(output).isNotNull())
    elif on_error == "empty":
        out = out.withColumn(output, F.when(F.col("_which").isNotNull(), F.coalesce(quoted(output), F.lit(""))))
    if keep_original:
        out = out.withColumns({f"{c}_raw": F.when((F.col("_which") == c) & (F.coalesce(quoted(output), F.lit("")) != ""),
                                                  quoted(c)) for c in found if c != output})
    return out.drop("_which")


def field_plan(columns: list[str], aliases: dict[str, str] | None = None, drop: list[str] | None = None,
               keep: list[str] | None = None, keep_unmapped: bool = True) -> dict[str, list[str]]:
    """Canonical name -> source columns in order."""
    table = {normalize_name(a): c for a, c in (K.FIELD_ALIASES if aliases is None else aliases).items()}
    plan: dict[str, list[str]] = {}
    for column in columns:
        name = normalize_name(column)
        if name in (drop or []):
            continue
        if name in table:
            plan.setdefault(table[name], []).append(column)
        elif keep_unmapped and (keep is None or name in keep):
            plan.setdefault(name, []).append(column)
    return plan


def _same_type(df: DataFrame, sources: list[str]) -> list[Column]:
    kinds = {df.schema[s].dataType.simpleString() for s in sources}
    return [quoted(s) if len(kinds) == 1 else quoted(s).cast("string") for s in sources]


def standardize_fields(df: DataFrame, **options) -> DataFrame:
    """Rename to canonical fields in one projection.

    Colliding sources are coalesced in column order: the first one with a value wins.
    """
    plan = field_plan(df.columns, **options)
    return df.select(*[F.coalesce(*_same_type(df, s)).alias(name) for name, s in plan.items()])


def select_features(df: DataFrame, features: list[str], include_only: list[str] | None = None,
                    exclude: list[str] | None = None, keep_others: bool = True, fill: float = 0.0) -> DataFrame:
    """Keep chosen feature columns as numbers with nulls filled."""
    chosen = [f for f in features if (not include_only or f in include_only) and f not in (exclude or [])]
    columns = []
    for c in df.columns:
        if c in chosen:
            kind = df.schema[c].dataType
            number = quoted(c) if isinstance(kind, T.NumericType) else quoted(c).try_cast("double")
            if isinstance(kind, (T.DoubleType, T.FloatType)):
                number = F.when(~F.isnan(number), number)
            columns.append(F.coalesce(number, F.lit(fill).cast(kind if isinstance(kind, T.NumericType) else "double")).alias(c))
        elif keep_others:
            columns.append(quoted(c))
    return df.select(*columns)


def prepare_features(df: DataFrame, label: str = "label", features: list[str] | None = None) -> DataFrame:
    """Label plus numeric columns as doubles, with null, NaN and infinity set to 0."""
    if features is None:
        features = [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name != label]
    lost = [f for f in features if f not in df.columns]
    if lost:
        raise ValueError(f"missing feature columns: {lost}")
    clean = []
    for f in features:
        x = quoted(f).cast("double")
        bad = x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
        clean.append(F.when(bad, F.lit(0.0)).otherwise(x).alias(f))
    return df.select(quoted(label), *clean)


