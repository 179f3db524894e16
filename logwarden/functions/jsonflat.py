"""Flatten nested columns to dotted names.

Objects become ``a.b``; a list is kept and also spread as ``a[0]``, ``a[1]``,
with objects inside lists as ``a[0].b``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F, types as T

from logwarden.functions.scalars import quoted


def _length_readers(dtype: T.DataType, path: tuple) -> list[tuple[tuple, Callable[[Column], Column]]]:
    """(path, function of the value giving the longest length) for every list below."""
    if isinstance(dtype, T.StructType):
        return [(p, lambda c, f=f.name, read=read: read(c.getField(f)))
                for f in dtype.fields for p, read in _length_readers(f.dataType, path + (f.name,))]
    if isinstance(dtype, T.ArrayType):
        own = [(path, F.size)]
        if not isinstance(dtype.elementType, T.StructType):
            return own
        return own + [(p, _longest(read)) for p, read in _length_readers(dtype.elementType, path + ("[]",))]
    return []


def _longest(read: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda items: F.array_max(F.transform(items, lambda x: read(x)))


def array_lengths(df: DataFrame, columns: list[str]) -> dict[tuple, int]:
    """Longest length of every list column, in one narrow aggregate."""
    found = [(p, read(quoted(n))) for n in columns for p, read in _length_readers(df.schema[n].dataType, (n,))]
    if not found:
        return {}
    row = df.agg(*[F.max(expr).alias(f"m{i}") for i, (_, expr) in enumerate(found)]).first()
    return {p: max(row[i] or 0, 0) for i, (p, _) in enumerate(found)}


def flatten(df: DataFrame, columns: list[str] | None = None,
            lengths: dict[tuple, int] | None = None, separator: str = ".") -> DataFrame:
    """Return ``df`` with nested columns spread to flat, dotted ones.

    ``lengths`` gives the number of ``[i]`` columns per list path; without it
    one aggregate over the list sizes finds them.
    """
    columns = df.columns if columns is None else columns
    nested = [c for c in columns if isinstance(df.schema[c].dataType, (T.StructType, T.ArrayType))]
    sizes = array_lengths(df, nested) if lengths is None else lengths
    out: list[Column] = []

    def walk(dtype: T.DataType, col: Column, name: str, path: tuple) -> None:
        if isinstance(dtype, T.StructType):
            for f in dtype.fields:
                walk(f.dataType, col.getField(f.name), f"{name}{separator}{f.name}", path + (f.name,))
        elif isinstance(dtype, T.ArrayType):
            out.append(col.alias(name))
            for i in range(sizes.get(path, 0)):
                item, label = F.get(col, F.lit(i)), f"{name}[{i}]"
                if isinstance(dtype.elementType, T.StructType):
                    walk(dtype.elementType, item, label, path + ("[]",))
                else:
                    out.append(item.alias(label))
        else:
            out.append(col.alias(name))

    for c in df.columns:
        if c in columns:
            walk(df.schema[c].dataType, quoted(c), c, (c,))
        else:
            out.append(quoted(c))
    return df.select(*out)


def flatten_json(df: DataFrame, column: str, schema: T.StructType | str | None = None,
                 prefix: str | None = None) -> DataFrame:
    """Parse a JSON text column and flatten it.

    Without a schema the widest one is taken from the data in one pass.  Text
    that is no JSON object gives nulls.
    """
    if schema is None:
        found = df.select(F.expr(f"schema_of_variant_agg(try_parse_json(`{column}`))")).first()[0]
        schema = found.replace("OBJECT<", "STRUCT<")
        if not schema.startswith("STRUCT<"):
            return df
    name = prefix or column
    parsed = df.withColumn(name, F.from_json(quoted(column), schema))
    return flatten(parsed, [name])
