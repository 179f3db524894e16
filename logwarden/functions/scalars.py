"""Column expressions: missing values, cell typing, names, ports, ratios."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F, types as T

from logwarden import constants as K


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def quoted(name: str) -> Column:
    """Column by its literal name, also when it holds dots or brackets."""
    return F.col("`" + name.replace("`", "``") + "`")


# ------------------------------------------------------------ missing values
def is_missing(c: Column | str, dtype: T.DataType | None = None,
               tokens: list[str] | None = None) -> Column:
    """True for null, NaN and strings that trim to a missing token."""
    c = _col(c)
    tokens = K.MISSING_TOKENS if tokens is None else tokens
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return c.isNull() | F.isnan(c)
    if dtype is None or isinstance(dtype, T.StringType):
        return c.isNull() | F.regexp_replace(c, r"^\s+|\s+$", "").isin(tokens)
    return c.isNull()


def null_if_missing(df: DataFrame, name: str, tokens: list[str] | None = None) -> Column:
    c = quoted(name)
    return F.when(~is_missing(c, df.schema[name].dataType, tokens), c)


# --------------------------------------------------------------- cell typing
_FLOAT = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$|^[+-]?(?i:nan)$"


def infer_type(c: Column | str) -> Column:
    """Type a CSV cell: struct(kind, as_bool, as_int, as_double, as_string).

    ``"1"`` is a boolean while ``"0"`` is an integer, and ``"no"`` stays text;
    an infinite number stays text as well.
    """
    s = F.regexp_replace(_col(c), r"^\s+|\s+$", "")
    low = F.lower(s)
    number = F.when(s.rlike(_FLOAT), s.try_cast("double"))
    finite = F.isnan(number) | (F.abs(number) < F.lit(float("inf")))
    kind = (
        F.when(s.isNull() | low.isin(K.CSV_NULL_TOKENS), "null")
        .when(low.isin(K.CSV_TRUE_TOKENS), "bool")
        .when(s.rlike(r"^-?\d+$"), "int")
        .when(number.isNotNull() & finite, "float")
        .when(low == "false", "bool")
        .otherwise("str")
    )
    return F.struct(
        kind.alias("kind"),
        F.when(kind == "bool", low != "false").alias("as_bool"),
        F.when(kind == "int", s.try_cast("long")).alias("as_int"),
        F.when(kind == "float", number).alias("as_double"),
        F.when(kind != "null", s).alias("as_string"),
    )


# --------------------------------------------------------------------- names
_NAME_BREAKS = r"[.\[\]\s\-/\\]+"


def normalize_name(name: str, lowercase: bool = True, special: bool = True,
                   replacement: str = "_") -> str:
    """Normalize one field name on the driver."""
    if special:
        parts = re.split(_NAME_BREAKS, name)
        name = replacement.join(parts).strip(replacement)
        if replacement:
            name = re.sub(f"(?:{re.escape(replacement)})+", lambda _: replacement, name)
    return name.lower() if lowercase else name


def normalize_name_col(c: Column | str) -> Column:
    """The same rule for a column that holds names."""
    broken = F.regexp_replace(_col(c), _NAME_BREAKS, "_")
    return F.lower(F.regexp_replace(F.regexp_replace(broken, "_+", "_"), "^_|_$", ""))


# --------------------------------------------------------------------- ports
def flag(condition: Column) -> Column:
    """0/1 integer, 0 for an unknown condition."""
    return F.when(condition, 1).otherwise(0)


def port_flags(port: Column | str, protocol: Column | str, prefix: str = "net") -> list[Column]:
    p = _col(port).try_cast("double")
    proto = F.lower(_col(protocol).cast("string"))
    return [
        flag((p >= 0) & (p < K.SYSTEM_PORT_END)).alias(f"{prefix}_dst_port_is_system"),
        flag(p.cast("long").isin(K.COMMON_PORTS)).alias(f"{prefix}_dst_port_is_common"),
        flag(p >= K.DYNAMIC_PORT_START).alias(f"{prefix}_dst_port_is_dynamic"),
        flag(proto == "tcp").alias(f"{prefix}_is_tcp"),
        flag(proto == "udp").alias(f"{prefix}_is_udp"),
    ]


def safe_divide(a: Column, b: Column, default: float = 0.0) -> Column:
    """a / b, or the default where b is 0."""
    return F.when(b == 0, F.lit(float(default))).otherwise(F.try_divide(a, b))


def literal_map(mapping: dict[str, object]) -> Column:
    """A constant MAP column; constant folding keeps it out of the row loop."""
    return F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])


def lookup(mapping: dict[str, object], key: Column, default: object = None) -> Column:
    found = F.try_element_at(literal_map(mapping), key)
    return found if default is None else F.coalesce(found, F.lit(default))


def banded(value: Column, bands: list[tuple[float, str]], otherwise: str, strict: bool = True) -> Column:
    """First label whose bound is exceeded (``>`` or ``>=``), bounds descending."""
    out = None
    for bound, label in bands:
        hit = value > bound if strict else value >= bound
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(otherwise)


def compact_list(*items: tuple[Column, Column]) -> Column:
    """Array of the texts whose condition holds, in order."""
    return F.array_compact(F.array(*[F.when(cond, text) for cond, text in items]))
