"""Log readers: JSON, JSON Lines, CSV, syslog and event XML to DataFrames.

Every reader returns the record's fields plus ``timestamp`` (text found in the
usual fields, '' if none), ``source_file`` and ``source_format``.  Lines that do
not parse are left out; :func:`parse_errors` counts them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from logwarden import constants as K
from logwarden.functions import eventxml, jsonflat, scalars, syslog
from logwarden.operators.standardize import extract_timestamp

from logwarden.session import cut_lineage

Paths = str | list[str]
HEAD_BYTES = 65536


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^[\s﻿]+|\s+$", "")


def _finish(df: DataFrame, fmt: str, fields: list[str] | None = None, nested: bool = True, ignore_case: bool = False) -> DataFrame:
    stamp = extract_timestamp(df.drop("source_file"), fields, nested, ignore_case)
    return df.withColumns({"timestamp": stamp, "source_format": F.lit(fmt)})


def _text(spark: SparkSession, path: Paths, **options: str) -> DataFrame:
    return spark.read.options(**options).text(path).select("value", F.col("_metadata.file_path").alias("source_file"))


# ------------------------------------------------------------------------ JSON
def variant_type(text: str) -> T.DataType:
    """The type that ``schema_of_variant`` describes; always-null and mixed fields are text."""
    at = 0

    def name() -> str:
        nonlocal at
        if text[at] != "`":
            start, at = at, text.index(":", at)
            return text[start:at]
        out, at = [], at + 1
        while text[at] != "`" or text.startswith("``", at):
            at += 1 + text.startswith("``", at)
            out.append(text[at - 1])
        at += 1
        return "".join(out)

    def kind() -> T.DataType:
        nonlocal at
        if text.startswith("OBJECT<", at):
            at += len("OBJECT<")
            fields = []
            while text[at] != ">":
                at += 2 * text.startswith(", ", at)
                field = name()
                at += len(": ")
                fields.append(T.StructField(field, kind()))
            at += 1
            return T.StructType(fields)
        if text.startswith("ARRAY<", at):
            at += len("ARRAY<")
            items = kind()
            at += 1
            return T.ArrayType(items)
        start = at
        depth = 0
        while at < len(text) and (depth or text[at] not in ",>"):
            depth += (text[at] == "(") - (text[at] == ")")
            at += 1
        plain = text[start:at]
        return T.StringType() if plain in ("VOID", "VARIANT") else T.DataType.fromDDL(plain)

    return kind()


def _objects(records: DataFrame, schema: T.StructType | str | None, flatten: bool, lengths: dict | None) -> DataFrame:
    """(source_file, value: object text) -> flat columns."""
    if schema is None:
        # One narrow pass finds the widest schema, as Spark's own JSON reader does.
        found = records.select(F.expr("schema_of_variant_agg(try_parse_json(value))")).first()[0]
        schema = variant_type(found) if found.startswith("OBJECT<") else None
        if not schema:
            return records.select("source_file")
    parsed = records.select("source_file", F.from_json("value", schema).alias("_r")).select("source_file", "_r.*")
    return jsonflat.flatten(parsed, [c for c in parsed.columns if c != "source_file"], lengths) if flatten else parsed


def read_json(spark: SparkSession, path: Paths, schema: T.StructType | str | None = None, flatten: bool = True,
              lengths: dict | None = None) -> DataFrame:
    """Files holding one object or a list of objects; other list items are dropped.

    One file is one task, as the format cannot be split; use JSON Lines for
    large data.
    """
    docs = _text(spark, path, wholetext="true")
    tree = docs.select("source_file", F.try_parse_json("value").alias("v"))
    one = tree.select("source_file", F.when(F.schema_of_variant("v").startswith("ARRAY"), F.col("v")).alias("v"),
                      F.when(F.schema_of_variant("v").startswith("OBJECT"), F.col("v")).alias("o"))
    items = one.where("v IS NOT NULL").select(
        "source_file", F.explode(F.col("v").cast("array<variant>")).alias("o"))
    objects = one.where("o IS NOT NULL").select("source_file", "o").unionByName(
        items.where(F.schema_of_variant("o").startswith("OBJECT")))
    return _finish(_objects(objects.select("source_file", F.to_json("o").alias("value")), schema, flatten, lengths), "JSON")


def read_jsonl(spark: SparkSession, path: Paths, schema: T.StructType | str | None = None, flatten: bool = True,
               strict: bool = False, lengths: dict | None = None) -> DataFrame:
    """One object per line; blank lines are skipped, bad ones too unless ``strict``."""
    lines = _text(spark, path).withColumn("value", _strip(F.col("value"))).where("value <> ''")
    bad = ~is_object(F.col("value"))
    if strict:
        lines = lines.withColumn("value", F.when(bad, F.raise_error(F.concat(
            F.lit("invalid JSON line: "), F.substring("value", 1, 200)))).otherwise(F.col("value")))
    else:
        lines = lines.where(~bad)
    return _finish(_objects(lines, schema, flatten, lengths), "JSON")


def is_object(c: Column) -> Column:
    return F.coalesce(c.startswith("{") & F.try_parse_json(c).isNotNull(), F.lit(False))


# ------------------------------------------------------------------------- CSV
def file_heads(spark: SparkSession, path: Paths, recursive: bool = True, nbytes: int = HEAD_BYTES,
               pattern: str | None = None) -> DataFrame:
    """(path, head) with the first bytes of each file.

    The listing is Spark's; tasks then open the files and read only the head.
    """
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if pattern:
        listing = listing.option("pathGlobFilter", pattern)

    def heads(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for pdf in batches:
            texts = []
            for p in pdf["path"]:
                try:
                    files, inner = fs.FileSystem.from_uri(p)
                    with files.open_input_stream(inner) as stream:
                        texts.append(stream.read(nbytes).decode("utf-8", errors="replace"))
                except OSError:
                    texts.append("")
            yield pd.DataFrame({"path": pdf["path"], "head": texts})

    return listing.load(path).select("path").mapInPandas(heads, "path string, head string")


def detect_delimiter(line: Column) -> Column:
    """Most frequent of comma, semicolon, tab and pipe; the earlier one wins a tie, comma if none."""
    counts = [F.length(line) - F.length(F.replace(line, F.lit(d), F.lit(""))) for d in K.CSV_DELIMITERS]
    best = F.greatest(*counts)
    out = F.when(best == 0, ",")
    for d, n in zip(K.CSV_DELIMITERS, counts):
        out = out.when(n == best, F.lit(d))
    return out


def csv_layouts(spark: SparkSession, path: Paths, pattern: str | None = None, delimiter: str | None = None) -> dict[tuple[str, str, bool], list[str]]:
    """Files by (delimiter, header line, whether they are not UTF-8).

    Spark reads the lines, so any file system it knows will do; a row per file comes back, as
    the reader needs the list of files in any case.
    """
    reader = spark.read.option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    lines = reader.text(path).select("value", F.col("_metadata.file_path").alias("path"),
                                     F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id")).alias("at"))
    found = lines.groupBy("path").agg(F.min_by("value", "at").alias("header"), F.max(~F.is_valid_utf8("value")).alias("foreign"))
    header = F.regexp_replace("header", "^\ufeff|\r$", "")
    rows = found.select("path", header.alias("header"), "foreign", (F.lit(delimiter) if delimiter else detect_delimiter(header)).alias("d")).collect()
    groups: dict[tuple[str, str, bool], list[str]] = {}
    for r in sorted(rows, key=lambda r: r["path"]):
        groups.setdefault((r["d"], r["header"], r["foreign"]), []).append(r["path"])
    return groups


def read_csv(spark: SparkSession, path: Paths, delimiter: str | None = None, infer_types: bool = True,
             mode: str = "PERMISSIVE", multiline: bool = True, pattern: str | None = None) -> DataFrame:
    """CSV with a header row; the delimiter is found per file unless given.

    Files may have different headers: columns are matched by name, and what a file lacks is null.  A file
    that is not UTF-8 is read as Latin-1; short rows are filled with nulls.  With ``multiline`` quoted fields may
    hold line breaks, and a file is one task; turn it off for large files without such fields.
    """
    frames = []
    for (d, _, foreign), paths in sorted(csv_layouts(spark, path, pattern, delimiter).items()):
        reader = spark.read.options(header="true", sep=d, multiLine=str(multiline).lower(), mode=mode, quote='"', escape='"',
                                    encoding="ISO-8859-1" if foreign else "UTF-8")
        raw = reader.csv(paths).select("*", F.col("_metadata.file_path").alias("source_file"))
        named = {c: c.strip().lstrip("\ufeff") for c in raw.columns}
        kept = raw.select(*[scalars.quoted(c).alias(n) for c, n in named.items() if n and not n.startswith("_c")])
        data = [c for c in kept.columns if c != "source_file"]
        if data:
            frames.append(kept.where(F.coalesce(*[F.nullif(scalars.quoted(c), F.lit("")) for c in data]).isNotNull()))
    rows = union_all(frames) if frames else spark.createDataFrame([], "source_file string")
    data = [c for c in rows.columns if c != "source_file"]
    return _finish(infer_columns(rows, data) if infer_types and data else rows, "CSV", K.CSV_TIMESTAMP_FIELDS, nested=False, ignore_case=True)


def infer_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Give each text column the one type that all its cells have.

    Cells are typed one by one (see :func:`scalars.infer_type`); a column of
    different types stays text, and the cell ``1`` counts as a number among
    numbers.
    """
    text = {c: _strip(scalars.quoted(c)) for c in columns}
    kind = {c: F.when(t == "1", "one").otherwise(scalars.infer_type(scalars.quoted(c))["kind"]) for c, t in text.items()}
    seen_kinds = df.agg(*[F.collect_set(k).alias(f"k{i}") for i, k in enumerate(kind.values())]).first()
    out = {}
    for i, (c, t) in enumerate(text.items()):
        seen = set(seen_kinds[i]) - {"null"}
        value = F.when(~F.lower(t).isin(K.CSV_NULL_TOKENS), t)
        if seen and seen <= {"one", "bool"}:
            out[c] = F.when(value.isNotNull(), F.lower(t) != "false")
        elif seen and seen <= {"one", "int"}:
            out[c] = value.try_cast("long")
        elif seen and seen <= {"one", "int", "float"}:
            out[c] = value.try_cast("double")
        else:
            out[c] = value
    return df.select(*[out[c].alias(c) if c in out else scalars.quoted(c) for c in df.columns])


# ---------------------------------------------------------------- syslog, XML
def read_syslog(spark: SparkSession, path: Paths, year: int | None = None) -> DataFrame:
    """Both syslog forms, one record per line; other lines are skipped."""
    lines = _text(spark, path).where(F.trim("value") != "")
    parsed = syslog.parse_lines(lines.where(syslog.is_line("value")), "value", year, "p")
    return parsed.select("source_file", "p.*").withColumn("source_format", F.lit("Syslog"))


def read_event_xml(spark: SparkSession, path: Paths) -> DataFrame:
    """Windows events exported as XML.

    The closing tag separates records, so large exports are split over tasks.
    """
    pieces = _text(spark, path, lineSep="</Event>")
    start = F.instr("value", "<Event ") + F.when(F.instr("value", "<Event ") > 0, 0).otherwise(F.instr("value", "<Event>"))
    events = pieces.withColumn("_at", start).where("_at > 0").select(
        "source_file", F.concat(F.substr("value", F.col("_at")), F.lit("</Event>")).alias("_xml"))
    return eventxml.parse_events(events, "_xml").where("_corrupt_record IS NULL").drop("_corrupt_record").withColumn("source_format", F.lit("EVTX"))


def parse_errors(spark: SparkSession, path: Paths, fmt: str) -> DataFrame:
    """Read and rejected lines per file."""
    lines = _text(spark, path).where(F.trim("value") != "")
    fine = is_object(_strip(F.col("value"))) if fmt == "JSON" else syslog.is_line("value")
    return lines.groupBy("source_file").agg(F.count_if(fine).alias("parsed"), F.count_if(~fine).alias("rejected"))


# ------------------------------------------------------------------- dispatch
Reader = Callable[[SparkSession, Paths], DataFrame]
READERS: dict[str, Reader] = {"JSON": read_json, "JSONL": read_jsonl, "CSV": read_csv, "Syslog": read_syslog, "EVTX": read_event_xml}
EXTENSIONS: dict[str, str] = {".json": "JSON", ".jsonl": "JSONL", ".csv": "CSV", ".tsv": "CSV", ".log": "Syslog",
                              ".syslog": "Syslog", ".xml": "EVTX"}


def register(extension: str, reader: Reader, name: str | None = None) -> None:
    """Add or replace the reader of a file extension."""
    name = name or extension.lstrip(".")
    READERS[name] = reader
    EXTENSIONS[extension.lower()] = name


def detect_format(path: Column, head: Column) -> Column:
    """Format name by extension, else by content, null if unknown."""
    by_name = None
    ext = F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))
    for e, fmt in EXTENSIONS.items():
        by_name = F.when(ext == e, fmt) if by_name is None else by_name.when(ext == e, fmt)
    text = _strip(F.substring(head, 1, 1000))
    lines = F.split(text, "\n")
    same = F.lit(False)
    for d in K.CSV_DELIMITERS:
        n = [F.length(F.get(lines, F.lit(i))) - F.length(F.replace(F.get(lines, F.lit(i)), F.lit(d), F.lit(""))) for i in (0, 1)]
        same = same | F.coalesce((n[0] > 0) & (n[0] == n[1]), F.lit(False))
    one_object = F.size(lines) > 1
    looks = (F.when(text.startswith("{") & one_object & F.get(lines, F.lit(1)).startswith("{"), "JSONL")
             .when(text.startswith("{") | text.startswith("["), "JSON")
             .when(text.startswith("<") & F.substring(text, 1, 10).contains(">"), "Syslog").when(same, "CSV"))
    return F.coalesce(by_name, looks)


def formats(spark: SparkSession, path: Paths, recursive: bool = True) -> DataFrame:
    """(path, format) of the files below a path."""
    return file_heads(spark, path, recursive).select("path", detect_format(F.col("path"), F.col("head")).alias("format"))


def read_logs(spark: SparkSession, path: Paths, fmt: str | None = None, recursive: bool = True) -> DataFrame:
    """Read a file or directory; each file by the hint, its extension or its content.

    A file that cannot be parsed adds no rows.
    """
    if fmt:
        chosen = {n.lower(): r for n, r in READERS.items()}.get(fmt.lower())
        if chosen is None:
            raise ValueError(f"unknown format: {fmt}")
        return chosen(spark, path)
    found = formats(spark, path, recursive).where("format IS NOT NULL").collect()
    if not found:
        raise ValueError(f"no known log format below {path}; extensions: {', '.join(EXTENSIONS)}")
    groups: dict[str, list[str]] = {}
    for row in found:
        groups.setdefault(row["format"], []).append(row["path"])
    return union_all([READERS[f](spark, paths) for f, paths in sorted(groups.items())])


@dataclass(frozen=True)
class Scan:
    """Rows of a directory and one row per file: path, format, bytes, rows, status."""

    rows: DataFrame
    files: DataFrame


def scan_logs(spark: SparkSession, path: Paths, out: str, recursive: bool = True) -> Scan:
    """Read a directory into the tables ``out/rows`` and ``out/files``, so that no file is lost unseen.

    The status of a file is ``read``, ``rejected`` (its format is known but it gave no row) or
    ``foreign`` (no known format).  Rows are counted per file in what was written.  Spark lists no files without bytes.
    """
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path).select("path", F.col("length").alias("bytes"))
    found = cut_lineage(listing.join(formats(spark, path, recursive), "path"), "scan-files")
    names = found.where("format IS NOT NULL").limit(1).count()
    rows = read_logs(spark, path, recursive=recursive) if names else spark.createDataFrame([], "source_file string")
    rows.write.mode("overwrite").parquet(f"{out}/rows")
    written = spark.read.schema(rows.schema).parquet(f"{out}/rows")
    same = lambda c: F.regexp_replace(c, "^file:/+", "file:/")
    counts = written.groupBy(same(F.col("source_file")).alias("_file")).agg(F.count(F.lit(1)).alias("rows"))
    n = F.coalesce("rows", F.lit(0))
    status = F.when(F.col("format").isNull(), "foreign").when(n == 0, "rejected").otherwise("read")
    files = found.join(counts, same(F.col("path")) == F.col("_file"), "left").select("path", "format", "bytes", n.alias("rows"), status.alias("status"))
    files.write.mode("overwrite").parquet(f"{out}/files")
    return Scan(written, spark.read.schema(files.schema).parquet(f"{out}/files"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Rows of all frames, columns matched by name; a column of different types becomes text."""
    kinds: dict[str, set[str]] = {}
    for f in frames:
        for n, t in f.dtypes:
            kinds.setdefault(n, set()).add(t)
    mixed = {n for n, t in kinds.items() if len(t) > 1}

    def text(f: DataFrame, n: str) -> Column:
        nested = isinstance(f.schema[n].dataType, (T.ArrayType, T.MapType, T.StructType))
        return F.to_json(scalars.quoted(n)) if nested else scalars.quoted(n).cast("string")

    out = None
    for f in frames:
        same = f.select(*[text(f, n).alias(n) if n in mixed else scalars.quoted(n) for n in f.columns])
        out = same if out is None else out.unionByName(same, allowMissingColumns=True)
    return out
