"""CSV and TSV files turned into typed tables."""

from __future__ import annotations

import csv
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakemill.functions.scalars import null_tokens
from lakemill.sources.records import csv_grammar, read_records

NUMERIC = (T.IntegerType, T.LongType, T.DoubleType, T.DecimalType)


def read_staged_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Stage as text, then cast: the header names the columns, values are trimmed, missing
    trailing fields are NULL, rows of NULLs are dropped. A value that does not cast fails the
    load, as an INSERT would."""
    staged = spark.read.csv(path, header=True, quote='"')
    trimmed = staged.select(
        *[F.nullif(F.trim(F.col(f"`{c}`")), F.lit("")).alias(c) for c in staged.columns]
    ).dropna(how="all")
    target = T.StructType.fromDDL(schema)
    return trimmed.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in target])


def read_csv_records(spark: SparkSession, path: str) -> DataFrame:
    """Text columns of CSV files whose quoted fields may hold line breaks, quotes doubled.

    Records are found over byte ranges (`records.read_records`), so a large file is read by many
    tasks; a line-break pair in a field stays as it is. Every file begins with the same header.
    """
    records = read_records(spark, path, csv_grammar())
    line = F.regexp_replace("value", r"\r?\n$", "")
    first = records.filter("no = 0").select(F.regexp_replace(line, "^\ufeff", "").alias("h"))
    names = [r.h for r in first.distinct().limit(2).collect()]
    if not names:
        raise ValueError(f"no header in {path}")
    if len(names) > 1:
        raise ValueError(f"the files of {path} have different headers")
    options = {"quote": '"', "escape": '"'}
    header = next(csv.reader([names[0]]))
    kind = ", ".join(f"c{i} string" for i in range(len(header)))
    rows = records.filter("no > 0").select(F.from_csv(line, kind, options).alias("r"))
    return rows.select(*[F.col(f"r.c{i}").alias(n) for i, n in enumerate(header)])


def read_named_csv(
    spark: SparkSession,
    path: str,
    columns: Sequence[str],
    rename: Mapping[str, str] | None = None,
    multi_line: bool = False,
) -> DataFrame:
    """Text columns by header name, lower-cased and renamed; NULL tokens are NULL; a column the
    file lacks is NULL. A byte-order mark is removed. Quoted values with line breaks need
    `multi_line`, which finds the records first (`read_csv_records`)."""
    if multi_line:
        raw = read_csv_records(spark, path)
    else:
        raw = spark.read.csv(path, header=True, quote='"', escape='"')
    rename = rename or {}
    lower = {c: c.strip().lower() for c in raw.columns}
    found = {rename.get(low, low): c for c, low in lower.items()}
    return raw.select(
        *[
            (null_tokens(F.col(f"`{found[c]}`")) if c in found else F.lit(None).cast("string"))
            .alias(c)
            for c in columns
        ]
    )


def read_inferred_csv(spark: SparkSession, path: str) -> DataFrame:
    """Whole numbers and floats by inference over the whole file, every other column as the
    text that stands in the file."""
    guessed = spark.read.csv(path, header=True, inferSchema=True).schema
    kept = T.StructType(
        [
            T.StructField(f.name, f.dataType if isinstance(f.dataType, NUMERIC) else T.StringType())
            for f in guessed
        ]
    )
    rows = spark.read.csv(path, header=True, schema=kept)
    wide = {f.name for f in kept if isinstance(f.dataType, T.IntegerType)}
    return rows.withColumns({c: F.col(f"`{c}`").cast("bigint") for c in wide}) if wide else rows


def read_tsv(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    r"""Tab-separated text: `\N` and missing fields are NULL, an empty field stays empty."""
    fields = F.split("value", "\t", -1)
    lines = spark.read.text(path).select(fields.alias("f"))
    return lines.select(
        *[F.nullif(F.get("f", F.lit(i)), F.lit(r"\N")).alias(c) for i, c in enumerate(columns)]
    )


def backslash_fields(df: DataFrame) -> DataFrame:
    """How many fields per column hold a backslash; they are reported, not changed."""
    counts = df.agg(*[F.count_if(F.contains(F.col(c), F.lit("\\"))).alias(c) for c in df.columns])
    return counts.unpivot([], list(df.columns), "column_name", "fields")
