"""Streams in several batches, restarted and replayed, against the batch result."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from lakemill.operators.relational import money_sum
from lakemill.session import work_folder
from lakemill.sources.sinks import month_bounds, period_column
from lakemill.streaming import jobs as J

CHANGES = "op string, key bigint, old_text string, text string, seq bigint"


def write(spark, path, data, schema):
    spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(path)


def copy_of(spark, output):
    return {r.key: r.text for r in J.read_copy(spark, output).collect()}


def test_copy_follows_inserts_updates_and_deletes(spark):
    source, output = work_folder(spark, "in"), work_folder(spark, "out")
    write(spark, source, [
        ("insert", 1, None, "a", 1), ("insert", 2, None, "b", 2), ("update", 1, "a", "A", 3),
    ], CHANGES)
    J.sync_text(J.read_files(spark, source, CHANGES, 1), output)
    assert copy_of(spark, output) == {1: "A", 2: "b"}
    write(spark, source, [
        ("update", 1, "A", "A", 4),  # no difference
        ("update", 2, None, "x", 5),  # unknown: does not fire
        ("delete", 2, None, None, 6), ("insert", 3, None, "c", 7),
    ], CHANGES)
    write(spark, source, [("insert", 2, None, "again", 8)], CHANGES)
    snapshot, second = work_folder(spark, "snapshot"), work_folder(spark, "snapshot")
    J.take_snapshot(spark, output, snapshot)
    J.sync_text(J.read_files(spark, source, CHANGES, 1), output)
    assert copy_of(spark, output) == {1: "A", 2: "again", 3: "c"}
    J.take_snapshot(spark, output, second, snapshot)
    for base in (snapshot, second):
        rows = J.read_copy(spark, output, base).collect()
        assert {r.key: r.text for r in rows} == {1: "A", 2: "again", 3: "c"}


def test_replayed_batch_changes_nothing(spark):
    source, output = work_folder(spark, "in"), work_folder(spark, "out")
    data = [(f"k{i % 3}", float(i)) for i in range(30)]
    write(spark, source, data, "k string, v double")
    sums = {"total": money_sum("v")}
    keys = [F.col("k")]
    J.incremental_sums(J.read_files(spark, source, "k string, v double"), output, keys, sums)
    before = J.read_batches(spark, output, "k string, total decimal(28,2)").collect()
    # A job without its progress log starts over: batch 0 is written again, in place.
    stream = J.read_files(spark, source, "k string, v double")
    again = (
        stream.writeStream.foreachBatch(
            lambda b, i: b.groupBy("k").agg(money_sum("v").alias("total"))
            .write.mode("overwrite").parquet(f"{output}/rows/batch={i}")
        )
        .option("checkpointLocation", work_folder(spark, "second"))
        .trigger(availableNow=True)
        .start()
    )
    again.awaitTermination()
    after = J.read_batches(spark, output, "k string, total decimal(28,2)").collect()
    assert sorted(before) == sorted(after)


def test_sums_over_batches_equal_one_sum(spark):
    source, output = work_folder(spark, "in"), work_folder(spark, "out")
    for part in range(3):
        data = [(f"k{i % 4}", i + part / 100) for i in range(20)]
        write(spark, source, data, "k string, v double")
    schema = "k string, v double"
    J.incremental_sums(
        J.read_files(spark, source, schema, 1), output, [F.col("k")], {"total": money_sum("v")}
    )
    stored = J.read_batches(spark, output, "k string, total decimal(28,2)")
    assert stored.select("batch").distinct().count() == 3
    got = stored.groupBy("k").agg(F.sum("total").cast("decimal(28,2)").alias("t"))
    want = spark.read.parquet(source).groupBy("k").agg(money_sum("v").alias("t"))
    assert sorted(got.collect()) == sorted(want.collect())


def test_late_rows_reach_their_month(spark):
    source, output = work_folder(spark, "in"), work_folder(spark, "out")
    day = dt.datetime
    schema = "id bigint, at timestamp_ntz"
    period = period_column(F.to_date("at"), month_bounds(2024, 2024), "2024-01-01")
    write(spark, source, [(1, day(2024, 3, 31, 23)), (2, day(2024, 4, 1))], schema)
    J.partition_rows(J.read_files(spark, source, schema, 1), output, period)
    write(spark, source, [(3, day(2024, 3, 1)), (4, day(2023, 12, 31)), (5, day(2025, 1, 1))], schema)
    stored = J.partition_rows(J.read_files(spark, source, schema, 1), output, period)
    assert sorted((r.id, r.period) for r in stored.collect()) == [
        (1, "2024-03"), (2, "2024-04"), (3, "2024-03"), (4, "OUT_OF_RANGE"), (5, "OUT_OF_RANGE"),
    ]


MOVES = "op string, key bigint, new_key bigint, old_text string, text string, seq bigint"


def folded(changes):
    """The copy that a trigger keeps which sees the changes one by one, by seq."""
    copy = {}
    for op, key, new_key, old, text, _ in sorted(changes, key=lambda c: c[5]):
        if op == "insert":
            copy[key] = text
        elif op == "delete":
            copy.pop(key, None)
        elif key != new_key:
            copy.pop(key, None)
            copy[new_key] = text
        elif old is not None and text is not None and old != text and key in copy:
            copy[key] = text
    return copy


def random_changes(n):
    rnd = random.Random(12)
    out = []
    for seq in range(n):
        key = rnd.randint(1, 9)
        op = rnd.choice(["insert", "update", "update", "update", "delete"])
        moved = op == "update" and rnd.random() < 0.2
        new_key = rnd.randint(1, 9) if moved else key
        old = rnd.choice([None, "a", f"t{seq}"])
        out.append((op, key, new_key, old, f"t{seq}" if rnd.random() < 0.9 else None, seq))
    return out


@pytest.mark.parametrize(("order", "per_batch"), [(0, 1), (1, 1), (2, 2), (3, 2), (4, None)])
def test_copy_is_the_same_for_every_order_of_files(spark, order, per_batch):
    changes = random_changes(90)
    files = [changes[i::5] for i in range(5)]
    random.Random(order).shuffle(files)
    source, output = work_folder(spark, "in"), work_folder(spark, "out")
    for part in files:
        write(spark, source, part, MOVES)
    J.sync_text(J.read_files(spark, source, MOVES, per_batch), output)
    assert copy_of(spark, output) == folded(changes)


def test_stamps_name_the_batch_of_the_change(spark):
    source, output = work_folder(spark, "in"), work_folder(spark, "out")
    batches = [
        [("insert", 1, 1, None, "a", 1), ("insert", 2, 2, None, "b", 2), ("insert", 3, 3, None, "c", 3),
         ("update", 9, 9, "x", "y", 4)],
        [("update", 1, 1, "a", "A", 10), ("update", 2, 2, "b", "b", 11), ("update", 9, 9, "p", "q", 12)],
        [("update", 3, 7, "c", "c", 20), ("delete", 2, 2, None, None, 21), ("update", 1, 1, "a", "old", 5)],
        [("insert", 9, 9, None, "late", 11), ("insert", 2, 2, None, "again", 30)],
    ]
    snapshot = work_folder(spark, "snapshot")
    for i, changes in enumerate(batches):
        write(spark, source, changes, MOVES)
        J.sync_text(J.read_files(spark, source, MOVES), output)  # stops and starts again
        if i == 1:
            J.take_snapshot(spark, output, snapshot)
    want = {1: ("A", 1), 2: ("again", 3), 7: ("c", 2), 9: ("q", 3)}
    for base in (None, snapshot):
        rows = J.read_copy(spark, output, base).collect()
        assert {r.key: (r.text, r.changed_in) for r in rows} == want
    times = {r.key: r.last_update for r in J.read_copy(spark, output).collect()}
    assert times[1] < times[7] < times[2] and times[2] == times[9]


@pytest.mark.parametrize("per_batch", [1, 3, None])
def test_running_sums_live_through_a_restart(spark, per_batch):
    source, output = work_folder(spark, "in"), work_folder(spark, "out")
    schema = "k string, v double"
    for part in range(6):
        write(spark, source, [(f"k{i % (part + 1)}", i + part / 100) for i in range(20)], schema)
        if part in (2, 5):
            stream = J.read_files(spark, source, schema, per_batch)
            J.running_sums(stream, output, [F.col("k")], {"total": money_sum("v")})
    stored = "k string, total decimal(28,2)"
    got = J.read_totals(spark, output, stored, ["k"])
    want = spark.read.parquet(source).groupBy("k").agg(money_sum("v").alias("total"))
    assert sorted(got.collect()) == sorted(want.collect())
    last = J.read_batches(spark, output, stored).groupBy("batch").count().collect()
    assert len(last) == {1: 6, 3: 2, None: 2}[per_batch]
    # a batch holds running totals, so the newest row of a key alone is its sum
    assert got.count() == 6


def test_late_rows_are_kept_aside_and_counted(spark):
    source, output = work_folder(spark, "in"), work_folder(spark, "out")
    schema = "id bigint, at timestamp_ntz, amount bigint"
    day = dt.datetime
    period = period_column(F.to_date("at"), month_bounds(2024, 2024), "2024-01-01")
    batches = [
        [(1, day(2024, 5, 1), 10), (2, day(2024, 1, 1), 20), (3, None, 1)],
        [(4, day(2024, 4, 30), 30), (5, day(2024, 4, 1), 40), (6, day(2024, 3, 31), 50)],  # mark 5-01
        [(7, day(2024, 9, 1), 60), (8, day(2023, 1, 1), 70), (9, day(2024, 4, 2), 80)],
        [(10, day(2024, 8, 2), 90), (11, day(2024, 7, 1), 100)],  # mark 9-01
    ]
    for rows in batches:
        write(spark, source, rows, schema)
        stream = J.read_files(spark, source, schema)
        J.partition_on_time(stream, output, period, "at", 30)
    stored = J.read_placed(spark, output, stream.schema)
    assert {r.id for r in stored.filter("late").collect()} == {6, 8, 11}
    places = {r.id: r.period for r in stored.collect()}
    assert (places[6], places[8], places[9]) == ("2024-03", "OUT_OF_RANGE", "2024-04")
    marks = {r.batch: (r.on_time, r.late) for r in J.read_marks(spark, output).collect()}
    assert marks == {0: (3, 0), 1: (2, 1), 2: (2, 1), 3: (1, 1)}
    assert stored.agg(F.sum("amount")).first()[0] == sum(r[2] for b in batches for r in b)
    plan = stored.filter("late")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(late" in plan
