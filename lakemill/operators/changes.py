"""INSERT, UPDATE, DELETE and MERGE as rewrites: each returns the new state of the table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakemill.operators.joins import having
from lakemill.operators.relational import latest_per_key


def insert(target: DataFrame, rows: DataFrame) -> DataFrame:
    """Add rows; a target column the rows lack is NULL."""
    return target.unionByName(rows, allowMissingColumns=True)


def insert_if_missing(target: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add the rows whose key the target does not hold. The target is read before the insert,
    so rows that repeat a new key are all added."""
    known = target.select(*keys).distinct()
    return insert(target, rows.join(known, list(keys), "left_anti"))


def insert_next_id(target: DataFrame, numbered: DataFrame, key: str, position: str) -> DataFrame:
    """Add rows numbered 1..N in `position` under the ids that follow the highest one."""
    top = target.agg(F.coalesce(F.max(key), F.lit(0))).scalar()
    fresh = numbered.withColumn(key, top + F.col(position)).drop(position)
    return insert(target, fresh)


def update_where(df: DataFrame, condition: Column, values: Mapping[str, Column]) -> DataFrame:
    """Set columns where the condition is true; all expressions see the old row."""
    return df.withColumns(
        {
            name: F.when(condition, value).otherwise(F.col(name)).cast(df.schema[name].dataType)
            for name, value in values.items()
        }
    )


def update_pair(
    left: DataFrame,
    right: DataFrame,
    left_key: str,
    right_key: str,
    left_condition: Column,
    right_condition: Column,
    left_values: Mapping[str, Column],
    right_values: Mapping[str, Column],
) -> tuple[DataFrame, DataFrame]:
    """Update two tables from one join: a row changes only if a row of the other side meets
    its own condition under the same key."""
    left_keys = left.filter(left_condition).select(F.col(left_key).alias("_k")).distinct()
    right_keys = right.filter(right_condition).select(F.col(right_key).alias("_k")).distinct()

    def apply(df, key, partners, condition, values):
        seen = partners.withColumn("_hit", F.lit(True))
        joined = df.join(seen, F.col(key) == F.col("_k"), "left")
        both = condition & F.col("_hit").isNotNull()
        changed = joined.withColumns(
            {
                n: F.when(both, v).otherwise(F.col(n)).cast(df.schema[n].dataType)
                for n, v in values.items()
            }
        )
        return changed.select(*df.columns)

    return (
        apply(left, left_key, right_keys, left_condition, left_values),
        apply(right, right_key, left_keys, right_condition, right_values),
    )


def update_rules(
    df: DataFrame, column: str, code: str, rules: Sequence[tuple[str, object]], when: Column
) -> DataFrame:
    """Apply (LIKE pattern, value) rules in order: the last rule that matches a code wins."""
    kind = df.schema[column].dataType
    chosen = F.coalesce(
        *[F.when(F.col(code).like(p), F.lit(v).cast(kind)) for p, v in reversed(rules)],
        F.col(column),
    )
    return df.withColumn(column, F.when(when, chosen).otherwise(F.col(column)))


def update_map(
    df: DataFrame, key: str, column: str, mapping: DataFrame, map_key: str, map_value: str
) -> DataFrame:
    """Set a column from a key -> value table; keys without an entry keep their value.

    The mapping must hold a key once. Spark broadcasts it when its size allows.
    """
    values = mapping.select(F.col(map_key).alias("_k"), F.col(map_value).alias("_v"))
    joined = df.join(values, F.col(key) == F.col("_k"), "left")
    return joined.withColumn(column, F.coalesce("_v", column)).select(*df.columns)


def delete_where(df: DataFrame, condition: Column) -> DataFrame:
    """Delete rows where the condition is true; an unknown result keeps the row."""
    return df.filter(~F.coalesce(condition, F.lit(False)))


def delete_cascade(
    tables: Mapping[str, DataFrame],
    root: str,
    condition: Column,
    links: Sequence[tuple[str, str, str, str]],
) -> dict[str, DataFrame]:
    """Delete rows of `root` and everything that refers to them.

    links: (child, child column, parent, parent column), parents before children.
    """
    doomed = {root: tables[root].filter(F.coalesce(condition, F.lit(False)))}
    left = dict(tables)
    left[root] = delete_where(tables[root], condition)
    for child, column, parent, parent_column in links:
        if parent not in doomed:
            continue
        keys = doomed[parent].select(F.col(parent_column).alias("_k")).distinct()
        match = F.col(column) == F.col("_k")
        gone = tables[child].join(keys, match, "left_semi")
        doomed[child] = doomed[child].unionByName(gone) if child in doomed else gone
        left[child] = left[child].join(keys, match, "left_anti")
    return left


def blocked_deletes(
    parents: DataFrame, condition: Column, key: str, children: DataFrame, column: str
) -> DataFrame:
    """Rows a RESTRICT rule would not let go: they meet the condition and have children."""
    return having(parents.filter(condition), children, [key], [column])


def replace_partitions(df: DataFrame, path: str, partition: str) -> None:
    """Replace the stored partitions that `df` has rows for; all others stay."""
    df.hint("rebalance", F.col(partition)).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy(partition).parquet(path)


def merge(
    target: DataFrame, changes: DataFrame, keys: Sequence[str], order: Sequence[Column], op: str
) -> DataFrame:
    """Apply the latest change per key: 'delete' removes the row, anything else replaces it."""
    columns = target.columns
    latest = latest_per_key(changes, keys, order)
    untouched = target.join(latest.select(*keys), list(keys), "left_anti").select(*columns)
    return untouched.unionByName(latest.filter(F.col(op) != "delete").select(*columns))
