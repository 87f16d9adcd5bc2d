"""The seven retail tables as ``;``-separated files with decimal comma, or as Parquet."""

import os
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import functions as F, types as T

from .. import columns as C


@dataclass(frozen=True)
class TableSpec:
    """Where a table lives, its schema (None: text columns named by the header) and its missing tokens."""

    file: str
    schema: T.StructType | None
    tokens: tuple


# File names and missing tokens. In the address table the text "NA" is a value.
DATASET = {
    "loyalty": TableSpec("raw_1_cli_fid", C.LOYALTY_SCHEMA, ("NA", "")),
    "account": TableSpec("raw_2_cli_account", C.ACCOUNT_SCHEMA, ("NA", "")),
    "address": TableSpec("raw_3_cli_address", C.ADDRESS_SCHEMA, ("",)),
    "privacy": TableSpec("raw_4_cli_privacy", None, ("NA", "")),
    "campaign": TableSpec("raw_5_camp_cat", None, ("NA", "")),
    "campaign_event": TableSpec("raw_6_camp_event", None, ("NA", "")),
    "ticket_line": TableSpec("raw_7_tic", C.TICKET_SCHEMA, ("NA", "")),
}


def null_tokens(df, tokens, columns=None):
    """Null where a text column holds one of ``tokens``."""
    names = columns or [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    return df.withColumns({n: F.when(~F.col(n).isin(*tokens), F.col(n)) for n in names})


def _typed(name, kind, decimal_comma, on_invalid="null"):
    text = F.col(name)
    if isinstance(kind, T.StringType):
        return text
    if decimal_comma and isinstance(kind, (T.DecimalType, T.DoubleType, T.FloatType)):
        text = F.translate(text, ",", ".")
    value = text.try_cast(kind)
    if on_invalid == "raise":
        said = F.concat(F.lit(f"column {name} cannot be read as {kind.simpleString()}: "), F.col(name))
        value = F.coalesce(value, F.when(F.col(name).isNotNull(), F.raise_error(said)).cast(kind))
    return value.alias(name)


def _parsed(schema):
    return T.StructType.fromDDL(schema) if isinstance(schema, str) else schema


def _reader(spark, sep, multi_line, strict):
    """Quotes are doubled inside quotes, as R and most exporters write them. A field with nothing in it is null, a
    quoted empty one is the empty text: no text stands for null."""
    options = {"sep": sep, "header": True, "quote": '"', "escape": '"', "multiLine": multi_line}
    options |= {"nullValue": "\0", "emptyValue": ""}
    # pruned columns are not split, so a record of the wrong width would pass unseen
    options |= {"mode": "FAILFAST" if strict else "PERMISSIVE", "columnPruning": not strict}
    return spark.read.options(**options)


def _text_columns(spark, path, sep, multi_line, strict, headers):
    """All columns as text, each file read by its own header."""
    reader = _reader(spark, sep, multi_line, strict)
    names = reader.csv(path).columns

    def read(paths, columns):
        kinds = T.StructType([T.StructField(c, T.StringType()) for c in columns])
        # without enforceSchema Spark compares the header of every file with the names
        return _reader(spark, sep, multi_line, strict).schema(kinds).csv(paths, enforceSchema=False)

    if headers == "same":
        return read(path, names)
    if headers != "per_file":
        raise ValueError(f"headers must be 'same' or 'per_file', not {headers!r}")
    by_header = {}
    for file in spark.read.text(path).inputFiles():
        by_header.setdefault(tuple(reader.csv(file).columns), []).append(file)
    parts = [read(files, columns) for columns, files in by_header.items()]
    return reduce(lambda x, y: x.unionByName(y), parts)


def read_delimited(
    spark, path, schema=None, decimal_comma=True, tokens=(), sep=";", multi_line=False, on_invalid="raise", headers="same"
):
    """Separated text with a header.

    With a schema its columns are picked from the file by their header names, so further columns and another order do
    no harm. Fields are read as text, missing tokens become null, and only then are numbers and dates converted.
    Without a schema all columns are text; only the header line is looked at to name them.

    ``on_invalid="raise"`` stops at a value that does not convert and at a record of the wrong width; with ``"null"``
    such values are null, and ``invalid_counts`` tells how many. ``multi_line`` allows line breaks inside quotes; such
    files are read in one task each, so it is off by default, and a broken record then has the wrong width and raises.
    All files of a folder must have the header of the first one, which is checked while they are read;
    ``headers="per_file"`` takes each by its own header instead, at the price of one small read per file.
    """
    schema = _parsed(schema)
    if on_invalid not in ("raise", "null"):
        raise ValueError(f"on_invalid must be 'raise' or 'null', not {on_invalid!r}")
    raw = _text_columns(spark, path, sep, multi_line, on_invalid == "raise", headers)
    named = raw if schema is None else raw.select(*schema.names)
    clean = null_tokens(named, tokens) if tokens else named
    if schema is None:
        return clean
    return clean.select(*[_typed(f.name, f.dataType, decimal_comma, on_invalid) for f in schema])


def invalid_counts(spark, path, schema, decimal_comma=True, tokens=(), sep=";", multi_line=False, headers="same"):
    """Rows (column, n): values of each column that do not convert to its type."""
    schema = _parsed(schema)
    raw = _text_columns(spark, path, sep, multi_line, False, headers).select(*schema.names)
    clean = null_tokens(raw, tokens) if tokens else raw
    bad = [
        F.count_if(F.col(f.name).isNotNull() & _typed(f.name, f.dataType, decimal_comma).isNull()).alias(f.name)
        for f in schema
    ]
    entries = F.array(*[F.struct(F.lit(n).alias("column"), F.col(n).alias("n")) for n in schema.names])
    return clean.agg(*bad).select(F.inline(entries))


def write_delimited(df, path, decimal_comma=True, sep=";", mode="errorifexists"):
    """Counterpart of ``read_delimited``: header, separator, decimal comma, doubled quotes; nulls as empty fields."""
    numbers = (T.DecimalType, T.DoubleType, T.FloatType)
    text = [
        F.translate(F.col(f.name).cast("string"), ".", ",").alias(f.name)
        if decimal_comma and isinstance(f.dataType, numbers)
        else F.col(f.name).cast("string").alias(f.name)
        for f in df.schema
    ]
    df.select(*text).write.csv(
        path, mode=mode, sep=sep, header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    )


def load_dataset(spark, folder, fmt="csv", only=None, **reading):
    """The retail tables by name; a table stands under its file name, with or without ``.csv``.

    ``fmt="parquet"`` reads the same names as Parquet and applies the same missing tokens. ``reading`` goes to
    ``read_delimited``.
    """
    tables = {}
    for name in only or DATASET:
        spec = DATASET[name]
        path = os.path.join(folder, f"{spec.file}.{fmt}")
        if fmt == "csv":
            tables[name] = read_delimited(spark, path, spec.schema, tokens=spec.tokens, **reading)
        elif fmt == "parquet":
            reader = spark.read.schema(spec.schema) if spec.schema else spark.read
            tables[name] = null_tokens(reader.parquet(path), spec.tokens)
        else:
            raise ValueError(f"fmt must be 'csv' or 'parquet', not {fmt!r}")
    return tables
