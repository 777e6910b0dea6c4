"""Repair and checks: constraints as jobs, since tables in files enforce none."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakemill.functions.scalars import key_value
from lakemill.operators.joins import lacking
from lakemill.operators.relational import latest_per_key, row_count
from lakemill.session import materialise


@dataclass
class Relation:
    """A table of a dataset with its keys; `types` names declared key types for comparison.

    `position` lists the columns that give the source order, for "first duplicate wins".
    """

    rows: DataFrame
    pk: Sequence[str] = ()
    fks: Sequence[tuple[Sequence[str], str, Sequence[str]]] = ()
    types: Mapping[str, str] = field(default_factory=dict)
    position: Sequence[str] = ()

    def key(self, column: str) -> Column:
        declared = self.types.get(column)
        return key_value(column, declared) if declared else F.col(column)


def split_orphans(
    child: Relation, columns: Sequence[str], parent: Relation, parent_columns: Sequence[str]
) -> tuple[DataFrame, DataFrame]:
    """(kept, orphans). A key with a NULL part refers to nothing and is kept.

    Parent keys are made distinct first; the child is the streamed side of one left join.
    """
    names = [f"_k{i}" for i in range(len(columns))]
    known = parent.rows.select(
        *[parent.key(c).alias(n) for c, n in zip(parent_columns, names)]
    ).distinct().withColumn("_known", F.lit(True))
    keyed = child.rows.withColumns({f"_c{i}": child.key(c) for i, c in enumerate(columns)})
    match = reduce(
        lambda a, b: a & b, [F.col(f"_c{i}") == F.col(n) for i, n in enumerate(names)]
    )
    joined = keyed.join(known, match, "left")
    has_null = reduce(lambda a, b: a | b, [F.col(f"_c{i}").isNull() for i in range(len(columns))])
    keep = has_null | F.col("_known").isNotNull()
    original = child.rows.columns
    return joined.filter(keep).select(*original), joined.filter(~keep).select(*original)


def drop_orphans(tables: Mapping[str, Relation], until_stable: bool = False):
    """Remove rows whose foreign keys point at nothing; tables in parent-first order.

    One pass, as loaded data needs when there is no cycle. `until_stable` repeats until no
    row is dropped. Returns the tables and a list of (table, rule, dropped rows).
    """
    tables = dict(tables)
    dropped: list[tuple[str, str, DataFrame]] = []
    while True:
        found = []
        for name, table in list(tables.items()):
            for columns, parent, parent_columns in table.fks:
                kept, orphans = split_orphans(
                    tables[name], columns, tables[parent], parent_columns
                )
                found.append((name, f"no {parent}({', '.join(parent_columns)})", orphans))
                tables[name] = Relation(kept, table.pk, table.fks, table.types, table.position)
        dropped += found
        if not until_stable or all(rows.isEmpty() for _, _, rows in found):
            return tables, dropped
        for name, table in tables.items():
            if table.fks:
                kept = materialise(table.rows, f"kept-{name}")
                tables[name] = Relation(kept, table.pk, table.fks, table.types, table.position)


def dedupe_pk(table: Relation) -> tuple[DataFrame, DataFrame]:
    """(kept, duplicates): the first row per primary key in source order is kept.

    Keys are compared by declared type. NULL keys are equal to each other here.
    """
    order = table.position or table.rows.columns
    keys = {f"_k{i}": table.key(c) for i, c in enumerate(table.pk)}
    keyed = table.rows.withColumns(keys)
    original = table.rows.columns
    kept = latest_per_key(keyed, list(keys), [F.asc_nulls_last(c) for c in order])
    counts = keyed.groupBy(*keys).agg((row_count() - 1).alias("dropped")).filter("dropped > 0")
    return kept.select(*original), counts.select(
        *[F.col(k).alias(c) for k, c in zip(keys, table.pk)], "dropped"
    )


def report_counts(parts: Sequence[tuple[str, str, DataFrame]]) -> DataFrame:
    """(table_name, rule, n) from sets of rows."""
    counts = [
        rows.agg(row_count().alias("n")).select(
            F.lit(table).alias("table_name"), F.lit(rule).alias("rule"), "n"
        )
        for table, rule, rows in parts
    ]
    return reduce(DataFrame.unionByName, counts)


# ---------------------------------------------------------------------- constraint checks


def check_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys held by several rows; UNIQUE lets NULL parts through."""
    present = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    return df.filter(present).groupBy(*keys).agg(row_count().alias("n")).filter("n > 1")


def check_primary_key(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys held by several rows or with a NULL part."""
    missing = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    return df.groupBy(*keys).agg(row_count().alias("n")).filter((F.col("n") > 1) | missing)


def check_foreign_key(
    child: DataFrame, columns: Sequence[str], parent: DataFrame, parent_columns: Sequence[str]
) -> DataFrame:
    """Child rows with a full key that no parent row has."""
    present = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])
    names = [f"_p{i}" for i in range(len(parent_columns))]
    keys = parent.select(*[F.col(p).alias(n) for p, n in zip(parent_columns, names)])
    return lacking(child.filter(present), keys, columns, names)


def violations(df: DataFrame, condition: Column) -> DataFrame:
    """Rows that break a CHECK: only FALSE breaks it, an unknown result passes."""
    return df.filter(~F.coalesce(condition, F.lit(True)))


def allowed(column: str, values: Sequence) -> Column:
    return F.col(column).isin(*values)


def at_most_one(*columns: str) -> Column:
    """No more than one of the columns is set."""
    flags = [F.col(c).isNotNull().cast("int") for c in columns]
    return reduce(lambda a, b: a + b, flags) <= 1


def fill_defaults(df: DataFrame, defaults: Mapping[str, object]) -> DataFrame:
    """Add columns that the input lacks with their default. A NULL that was given stays."""
    absent = {c: F.lit(v) for c, v in defaults.items() if c not in df.columns}
    return df.withColumns(absent) if absent else df


def duplicate_rows(df: DataFrame) -> DataFrame:
    return df.groupBy(*df.columns).agg(row_count().alias("n")).filter("n > 1")


# ------------------------------------------------------------------------------ profiling


def missing_shares(df: DataFrame) -> DataFrame:
    """(column_name, missing) with the share of NULLs per column, from one pass."""
    shares = df.agg(
        *[F.round(F.avg(F.col(c).isNull().cast("int")), 6).alias(c) for c in df.columns]
    )
    return shares.unpivot([], list(df.columns), "column_name", "missing")


def drop_sparse(df: DataFrame, limit: float) -> DataFrame:
    """Drop columns with more than `limit` of their values missing.

    Only the list of names comes to the driver: one row per column of the table.
    """
    sparse = [r.column_name for r in missing_shares(df).filter(F.col("missing") > limit).collect()]
    return df.drop(*sparse)


NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double")


def _numeric(df: DataFrame) -> set[str]:
    return {c for c, kind in df.dtypes if kind in NUMBERS or kind.startswith("decimal")}


def _shown(kind: str, c: Column) -> Column:
    """A value that can be compared and hashed: nested ones as JSON."""
    return F.to_json(c) if kind.startswith(("array", "map", "struct")) else c


def _hashed(kind: str, c: Column) -> Column:
    """What a distinct sketch takes; other types go in as their text."""
    return c if kind in ("int", "bigint", "string") else _shown(kind, c).cast("string")


def sketch_columns(df: DataFrame) -> list[Column]:
    """Aggregates: rows, and per column NULLs, lowest, highest, a sketch of its distinct values, and
    for numbers their sum and a sketch of their quantiles. Sums are exact with six decimals where
    all values fit into 32 digits before the point, otherwise double."""
    numeric = _numeric(df)
    made = [row_count().alias("n")]
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        made += [
            F.count_if(c.isNull()).alias(f"{name}__nulls"),
            F.min(_shown(kind, c)).alias(f"{name}__lowest"),
            F.max(_shown(kind, c)).alias(f"{name}__highest"),
            F.hll_sketch_agg(_hashed(kind, c)).alias(f"{name}__distinct"),
        ]
        if name in numeric:
            exact = c.try_cast("decimal(38,6)")
            made += [
                F.when(F.count(exact) == F.count(c), F.try_sum(exact)).alias(f"{name}__sum"),
                F.sum(c.cast("double")).alias(f"{name}__rough"),
                F.kll_sketch_agg_double(c.cast("double")).alias(f"{name}__ranks"),
            ]
    return made


def file_sketches(df: DataFrame) -> DataFrame:
    """The sketches of each file of a Parquet read: one pass, and one row a file."""
    return df.withColumn("_file", F.col("_metadata.file_path")).groupBy("_file").agg(
        *sketch_columns(df)
    )


def add_sketches(spark: SparkSession, table: str, schema: str, path: str) -> DataFrame:
    """Store the sketches of the files of `table` that have none yet at `path`; returns all.

    A file is read once in its life. The names of files, which the driver lists to plan any read,
    decide which are new.
    """
    def plain(name: str) -> str:
        """One spelling of a file's name: listings differ in slashes and escapes."""
        return unquote(re.sub(r"^(\w+):/+", r"\1:/", name))

    files = {plain(f): f for f in spark.read.schema(schema).parquet(table).inputFiles()}
    probe = file_sketches(spark.read.schema(schema).parquet(table))
    try:
        stored = spark.read.schema(probe.schema).parquet(path)
        known = {plain(r._file) for r in stored.select("_file").collect()}
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        known = set()
    fresh = [f for name, f in sorted(files.items()) if name not in known]
    if fresh:
        new = file_sketches(spark.read.schema(schema).parquet(*fresh))
        new.write.mode("append").parquet(path)
    return spark.read.schema(probe.schema).parquet(path)


def merged_profile(sketches: DataFrame, quantiles: Sequence[float] = (0.5,)) -> DataFrame:
    """Per column: rows, NULLs, distinct values (estimated), lowest and highest as text, mean, and
    quantiles (estimated, NULL for what is no number), from any set of file sketches.

    The profile of a table is that of all its files; sketches of two halves give the same rows,
    NULLs, bounds and means as those of the whole, and estimates within the sketches' error.
    """
    columns = [c.removesuffix("__nulls") for c in sketches.columns if c.endswith("__nulls")]
    made = [F.sum("n").alias("n")]
    for c in columns:
        made += [
            F.sum(f"{c}__nulls").alias(f"{c}__nulls"),
            F.min(f"{c}__lowest").alias(f"{c}__lowest"),
            F.max(f"{c}__highest").alias(f"{c}__highest"),
            F.hll_sketch_estimate(F.hll_union_agg(f"{c}__distinct")).alias(f"{c}__distinct"),
        ]
        if f"{c}__sum" in sketches.columns:
            every = F.count(f"{c}__sum") == F.count(F.when(F.col("n") > F.col(f"{c}__nulls"), 1))
            exact = F.when(every, F.try_sum(f"{c}__sum").cast("double"))
            made += [
                F.coalesce(exact, F.sum(f"{c}__rough")).alias(f"{c}__sum"),
                F.kll_merge_agg_double(f"{c}__ranks").alias(f"{c}__ranks"),
            ]
    merged = sketches.agg(*made)

    def row(c: str) -> Column:
        number = f"{c}__sum" in sketches.columns
        present = F.col("n") - F.col(f"{c}__nulls")
        mean = F.lit(None).cast("double")
        ranks = F.lit(None).cast("array<double>")
        if number:
            mean = F.when(present > 0, F.round(F.col(f"{c}__sum") / present, 4))
            ranks = F.when(
                present > 0,
                F.array(*[F.kll_sketch_get_quantile_double(f"{c}__ranks", F.lit(q)) for q in quantiles]),
            )
        return F.struct(
            F.lit(c).alias("column_name"),
            F.coalesce("n", F.lit(0)).alias("n"),
            F.coalesce(f"{c}__nulls", F.lit(0)).alias("nulls"),
            F.coalesce(f"{c}__distinct", F.lit(0)).alias("distinct_values"),
            F.col(f"{c}__lowest").cast("string").alias("lowest"),
            F.col(f"{c}__highest").cast("string").alias("highest"),
            mean.alias("mean"),
            ranks.alias("quantiles"),
        )

    return merged.select(F.explode(F.array(*[row(c) for c in columns])).alias("r")).select("r.*")


def distinct_counts(df: DataFrame) -> DataFrame:
    """(column_name, distinct_values), exact: values are made distinct per task and column, then
    counted, all columns in one shuffle of (column, hash) pairs of 128 bits."""
    pairs = [
        F.when(
            F.col(f"`{c}`").isNotNull(),
            F.struct(F.lit(c).alias("column_name"), _hash_pair(_shown(kind, F.col(f"`{c}`"))).alias("v")),
        )
        for c, kind in df.dtypes
    ]
    values = df.select(F.explode(F.array(*pairs)).alias("p")).filter("p IS NOT NULL").select("p.*")
    counted = values.distinct().groupBy("column_name").agg(row_count().alias("distinct_values"))
    every = df.sparkSession.createDataFrame([(c,) for c in df.columns], "column_name string")
    return every.join(counted, "column_name", "left").na.fill(0, ["distinct_values"])


def _hash_pair(c: Column) -> Column:
    text = c.cast("string")
    return F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit("second"), text).alias("b"))


def profile(df: DataFrame, exact: bool = False) -> DataFrame:
    """Per column: rows, NULLs, distinct values, lowest, highest and mean, as text or double.

    One pass over the rows of a Parquet read or any other table. Distinct counts are estimated by
    sketches; with `exact` they are counted, in one more pass and shuffle. Means are summed with
    six decimals, where values fit, and shown with four.
    """
    found = merged_profile(df.agg(*sketch_columns(df))).drop("quantiles")
    if not exact:
        return found
    return found.drop("distinct_values").join(distinct_counts(df), "column_name").select(*found.columns)


# ---------------------------------------------------------------------------------- proof


def expected_actual(counts: DataFrame, expected: DataFrame) -> DataFrame:
    """(table_name, expected, actual, matches); a table missing on either side does not match."""
    joined = counts.join(expected, "table_name", "full")
    return joined.select(
        "table_name", "expected", F.col("n").alias("actual"),
        F.coalesce(F.col("expected") == F.col("n"), F.lit(False)).alias("matches"),
    )


def require_rows(counts: DataFrame) -> DataFrame:
    """The counts, after failing on no tables or on an empty one."""
    summary = counts.agg(row_count().alias("tables"), F.min("n").alias("least")).first()
    if summary.tables == 0:
        raise ValueError("no tables")
    if not summary.least:
        raise ValueError("a table has no rows")
    return counts


def missing_members(df: DataFrame, column: str, required: DataFrame, name: str) -> DataFrame:
    """Required key values that do not occur."""
    return required.join(df.select(F.col(column).alias(name)).distinct(), name, "left_anti")


def gather_stats(df: DataFrame) -> DataFrame:
    """(column_name, info_name, info_value): NULLs and exact distinct values of every column.

    Nothing is saved: the table is not copied, and the catalog is not touched.
    """
    found = profile(df, exact=True)
    facts = F.explode(
        F.create_map(
            F.lit("num_nulls"), F.col("nulls"), F.lit("distinct_count"), F.col("distinct_values")
        )
    ).alias("info_name", "value")
    return found.select("column_name", facts).select(
        "column_name", "info_name", F.col("value").cast("string").alias("info_value")
    )
