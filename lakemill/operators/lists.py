"""Text lists per group, kept bounded while they are built."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_HEADS = "_part int, _batch int, _total bigint, _head array<string>"


def _first_of_group(b: pa.RecordBatch, keys: int) -> np.ndarray:
    """Which rows of a sorted batch begin a group; NULL keys are equal to each other."""
    new = np.zeros(len(b), dtype=bool)
    new[0] = True
    for i in range(keys):
        this, before = b.column(i).slice(1), b.column(i).slice(0, len(b) - 1)
        other = pc.fill_null(pc.not_equal(this, before), False).to_numpy(zero_copy_only=False)
        gap = pc.not_equal(this.is_null(), before.is_null()).to_numpy(zero_copy_only=False)
        new[1:] |= other | gap
    return new


def _part_heads(keys: Sequence[str], limit: int, step: int):
    """One sorted range of (key columns.., item): per batch and group the number of items, and
    those up to and with the first that passes `limit` bytes of the group in this range."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last_key, used, number = TaskContext.get().partitionId(), None, -step, 0
        for b in batches:
            if not len(b):
                continue
            items, key_rows = b.column(len(keys)), b.select(list(keys))
            size = pc.fill_null(pc.add(pc.binary_length(items), step), 0)
            running = np.zeros(len(b) + 1, np.int64)
            np.cumsum(size.to_numpy(zero_copy_only=False), out=running[1:])
            starts = np.flatnonzero(_first_of_group(b, len(keys)))
            ends = np.append(starts[1:], len(b))
            begin = np.full(len(starts), -step)  # bytes of the group before this batch
            if last_key is not None and last_key.equals(key_rows.slice(0, 1)):
                begin[0] = used
            group = np.repeat(np.arange(len(starts)), ends - starts)
            before = running[:-1] - running[starts][group] + begin[group]
            there = items.is_valid().to_numpy(zero_copy_only=False)
            kept = there & (before <= limit)
            bounds = np.concatenate([[0], np.cumsum(np.bincount(group, kept, len(starts)))])
            yield pa.RecordBatch.from_arrays(
                [
                    *key_rows.take(pa.array(starts)).columns,
                    pa.array(np.full(len(starts), part, np.int32)),
                    pa.array(np.full(len(starts), number, np.int32)),
                    pa.array(np.bincount(group, there, len(starts)).astype(np.int64)),
                    pa.ListArray.from_arrays(
                        pa.array(bounds.astype(np.int32)), items.filter(pa.array(kept))
                    ),
                ],
                names=[*keys, "_part", "_batch", "_total", "_head"],
            )
            last_key, number = key_rows.slice(len(b) - 1, 1), number + 1
            used = int(begin[-1] + running[-1] - running[starts[-1]])

    return rows


def truncated_list(
    df: DataFrame,
    keys: Sequence[str],
    item: str,
    order: Sequence[str],
    limit: int = 4000,
    separator: str = ", ",
    marker: str = "...",
    name: str = "items",
) -> DataFrame:
    """Ordered list per group that stops at the first item past `limit` bytes and then says
    how many items were left out: `a, b, ...(3)`. NULL items are skipped; a group of them only
    has NULL.

    Rows are dealt by ranges of (keys, order) and sorted, so a group of any size spreads over
    tasks. A task keeps a running byte total per group, of which only the items up to the limit go
    on with their number; a group that spans tasks is put together from one such row per task, in
    order, and cut where its total passes the limit. `order` must settle the order of a group's
    items.
    """
    step = len(separator.encode())
    if step == 0:
        raise ValueError("a list needs a separator")
    sorting = list(dict.fromkeys([*keys, *order]))
    names = [f"_k{i}" for i in range(len(keys))]
    dealt = df.repartitionByRange(*sorting).sortWithinPartitions(*sorting)
    ranged = dealt.select(
        *[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)],
        F.col(item).cast("string").alias("_item"),
    )
    kinds = ", ".join(f"{n} {ranged.schema[n].dataType.simpleString()}" for n in names)
    heads = ranged.mapInArrow(_part_heads(names, limit, step), f"{kinds}, {_HEADS}")
    parts = F.sort_array(F.collect_list(F.struct("_part", "_batch", "_head")))
    grouped = heads.groupBy(*names).agg(
        F.sum("_total").alias("_total"),
        F.flatten(F.transform(parts, lambda p: p["_head"])).alias("_h"),
    )

    def fits(items: Column) -> Column:
        """Number of leading items whose joined length stays within the limit."""
        start = F.struct(F.lit(0).alias("n"), F.lit(-step).alias("len"), F.lit(True).alias("on"))

        def add(acc, text):
            length = acc["len"] + step + F.octet_length(text)
            on = acc["on"] & (length <= limit)
            return F.struct(
                F.when(on, acc["n"] + 1).otherwise(acc["n"]).alias("n"),
                F.when(on, length).otherwise(acc["len"]).alias("len"),
                on.alias("on"),
            )

        return F.aggregate(items, start, add, lambda acc: acc["n"])

    joined = grouped.withColumn("_n", fits(F.col("_h")))
    shown = F.array_join(F.slice("_h", F.lit(1), F.col("_n")), separator)
    left_out = F.col("_total") - F.col("_n")
    mark = F.concat(
        F.when(F.col("_n") > 0, F.lit(separator)).otherwise(F.lit("")),
        F.lit(marker + "("),
        left_out.cast("string"),
        F.lit(")"),
    )
    text = F.when(left_out == 0, shown).otherwise(F.concat(shown, mark))
    return joined.select(
        *[F.col(n).alias(k) for k, n in zip(keys, names, strict=True)],
        F.when(F.col("_total") > 0, text).alias(name),
    )


def distinct_list(
    df: DataFrame,
    keys: Sequence[str],
    item: str,
    separator: str = ", ",
    name: str = "items",
    is_distinct: bool = False,
) -> DataFrame:
    """Sorted distinct values per group as text.

    Copies are dropped map-side before anything is listed, so what a group brings together
    is its set of values, however many rows it has. Groups of NULLs only give NULL.
    `is_distinct` says that the input holds no copies.
    """
    pairs = df.select(*keys, item)
    if not is_distinct:
        pairs = pairs.distinct()
    values = F.sort_array(F.collect_list(item))
    return pairs.groupBy(*keys).agg(
        F.when(F.count(item) > 0, F.array_join(values, separator)).alias(name)
    )


def counted_list(
    df: DataFrame, keys: Sequence[str], item: str, separator: str = ", ", name: str = "items"
) -> DataFrame:
    """Sorted values per group with how often each occurs: `a x2, b x1`.

    A repeated value is one counted entry, combined map-side, so the text grows with the
    distinct values of a group and not with its rows.
    """
    counted = df.filter(F.col(item).isNotNull()).groupBy(*keys, item).agg(
        F.count(F.lit(1)).alias("_c")
    )
    entries = F.sort_array(
        F.collect_list(F.struct(F.col(item).alias("v"), F.col("_c").alias("c")))
    )
    texts = F.transform(entries, lambda p: F.concat(p["v"], F.lit(" x"), p["c"].cast("string")))
    return counted.groupBy(*keys).agg(F.array_join(texts, separator).alias(name))


def entity_list(
    df: DataFrame,
    keys: Sequence[str],
    item: str,
    ident: str,
    separator: str = ", ",
    name: str = "items",
) -> DataFrame:
    """Names of the distinct entities per group, sorted; two entities of one name are both listed.

    Copies of an entity are dropped map-side first. Groups of NULLs only give NULL.
    """
    entries = df.select(*keys, F.struct(F.col(item).alias("v"), F.col(ident).alias("id")).alias("_e"))
    present = F.when(F.col("_e.v").isNotNull(), F.col("_e"))
    listed = F.sort_array(F.collect_list(present))
    text = F.array_join(F.transform(listed, lambda e: e["v"]), separator)
    return entries.distinct().groupBy(*keys).agg(
        F.when(F.size(listed) > 0, text).alias(name)
    )
