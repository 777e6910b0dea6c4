"""Triggers and refreshes as Structured Streaming jobs.

Every job writes one folder per micro-batch below its output path and overwrites that folder
when a batch is replayed, so a job that dies between its write and its commit repeats the
batch without doubling it. Readers combine the folders.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lakemill.sources.sinks import write_by_period


def read_files(
    spark: SparkSession, path: str, schema: str, files_per_batch: int | None = None
) -> DataFrame:
    """A stream of the Parquet files at `path`, in batches of so many files if that is set."""
    reader = spark.readStream.schema(schema)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def run_batches(
    stream: DataFrame, output: str, write: Callable[[DataFrame, str], None], mode: str = "append"
) -> None:
    """Run a stream over everything available, calling `write(batch, folder)` per batch. In mode
    "update" a batch holds the groups whose state it has changed."""

    def one(batch: DataFrame, batch_id: int) -> None:
        write(batch, f"{output}/rows/batch={batch_id}")

    job = (
        stream.writeStream.foreachBatch(one)
        .outputMode(mode)
        .option("checkpointLocation", f"{output}/progress")
        .trigger(availableNow=True)
        .start()
    )
    job.awaitTermination()


def read_batches(spark: SparkSession, output: str, schema: str) -> DataFrame:
    """All batch folders of a job, with the batch number."""
    return spark.read.schema(f"{schema}, batch bigint").parquet(f"{output}/rows")


# ------------------------------------------------------------------- copy kept in step

IN, OUT, SET = "in", "out", "set"
COPY_SCHEMA = "key bigint, present boolean, text string, seq bigint, last_update timestamp"


def row_events(changes: DataFrame) -> DataFrame:
    """(key, seq, kind, text): what changes (op, key, old_text, text, seq and, where keys may
    change, new_key) do to rows of the copy.

    An update sets the text if old and new text differ, written with plain inequality: when either
    is NULL the comparison is unknown and it does not fire. An update that changes the key takes
    the row away under the old one and brings it, with its new text, under the new one.
    """
    if "new_key" not in changes.columns:
        changes = changes.withColumn("new_key", F.col("key"))

    def event(key: str, kind: str) -> Column:
        return F.array(F.struct(F.col(key).alias("key"), F.lit(kind).alias("kind")))

    update = F.col("op") == "update"
    made = (
        F.when(F.col("op") == "insert", event("key", IN))
        .when(F.col("op") == "delete", event("key", OUT))
        .when(update & (F.col("key") != F.col("new_key")), F.concat(event("key", OUT), event("new_key", IN)))
        .when(update & (F.col("old_text") != F.col("text")), event("key", SET))
    )
    return changes.select(F.explode(made).alias("e"), "seq", "text").select("e.*", "seq", "text")


def sync_text(changes: DataFrame, output: str) -> None:
    """Keep a copy of (key, text) in step with a stream of insert, update and delete rows.

    The state store keeps two changes per key: the last that brought or removed the row, and the
    last that set its text. An update counts only behind a change that brought the row, so that
    of an absent key does nothing. Both are largest `seq`, so the copy is the same however changes
    fall into files and batches and in whatever order they come. `last_update` is the time of the
    batch that brought what the row shows. A batch stores the keys it touched.
    """
    events = row_events(changes).withColumn("at", F.current_timestamp())
    kept = F.col("kind") != SET
    held = events.groupBy("key").agg(
        F.max(F.when(kept, F.struct("seq", "kind", "text", "at"))).alias("base"),
        F.max(F.when(~kept, F.struct("seq", "text", "at"))).alias("change"),
    )
    later = F.coalesce(F.col("change.seq") > F.col("base.seq"), F.lit(False))
    shown = held.select(
        "key",
        F.coalesce(F.col("base.kind") == IN, F.lit(False)).alias("present"),
        F.when(later, F.col("change.text")).otherwise(F.col("base.text")).alias("text"),
        F.greatest("base.seq", "change.seq").alias("seq"),
        F.when(later, F.greatest("base.at", "change.at")).otherwise(F.col("base.at")).alias("last_update"),
    )
    run_batches(shown, output, lambda batch, folder: batch.write.mode("overwrite").parquet(folder), "update")


def _stored_copy(spark: SparkSession, output: str, snapshot: str | None) -> DataFrame:
    """One row per key, as the newest batch left it; `changed_in` is the first batch that shows it."""
    rows = read_batches(spark, output, COPY_SCHEMA).withColumn("changed_in", F.col("batch"))
    if snapshot is not None:
        base = spark.read.schema(f"{COPY_SCHEMA}, batch bigint, changed_in bigint").parquet(snapshot)
        done = base.agg(F.coalesce(F.max("batch"), F.lit(-1))).scalar()
        rows = base.unionByName(rows.filter(F.col("batch") > done))
    # two aggregates that combine before the shuffle: equal stamps first, then the newest
    stamped = rows.groupBy("key", "last_update").agg(
        F.min("changed_in").alias("changed_in"),
        F.max("batch").alias("batch"),
        F.max_by(F.struct("present", "text", "seq"), "batch").alias("row"),
    )
    newest = F.max_by(F.struct("row", "last_update", "batch", "changed_in"), "batch")
    return stamped.groupBy("key").agg(newest.alias("n")).select(
        "key", "n.row.*", "n.last_update", "n.batch", "n.changed_in"
    )


def read_copy(spark: SparkSession, output: str, snapshot: str | None = None) -> DataFrame:
    """(key, text, last_update, changed_in) after all batches; `changed_in` is the number of the
    batch that last changed the row.

    A batch stores its touched keys only, so the merge on read works on at most those. With a
    snapshot only the batches after it are read.
    """
    rows = _stored_copy(spark, output, snapshot).filter("present")
    return rows.select("key", "text", "last_update", "changed_in")


def take_snapshot(
    spark: SparkSession, output: str, path: str, previous: str | None = None
) -> None:
    """Write the newest row per key, removed ones included, so that readers can skip old batches."""
    _stored_copy(spark, output, previous).select(
        "key", "present", "text", "seq", "last_update", "batch", "changed_in"
    ).write.parquet(path)


# ------------------------------------------------------------------------- derived rows


def derive(
    stream: DataFrame, output: str, make: Callable[[DataFrame], DataFrame]
) -> None:
    """Store `make(batch)` for every batch: derived columns, tokens or partial sums."""

    def write(batch: DataFrame, folder: str) -> None:
        make(batch).write.mode("overwrite").parquet(folder)

    run_batches(stream, output, write)


def partition_rows(stream: DataFrame, output: str, period: Column) -> DataFrame:
    """Store arriving rows under their period's folder; a row of any age goes to its period.
    Returns the stored rows with `period` and `batch`; both prune folders."""
    run_batches(stream, output, lambda batch, folder: write_by_period(batch, folder, period))
    stored = StructType([*stream.schema.fields]).add("batch", "long").add("period", "string")
    return stream.sparkSession.read.schema(stored).parquet(f"{output}/rows")


PLACED = "late boolean, period string, batch bigint"
MARKS = "mark timestamp_ntz, on_time bigint, late bigint"


def partition_on_time(
    stream: DataFrame, output: str, period: Column, at: str, allowed_days: int
) -> None:
    """Store arriving rows under their period's folder, those that come too late aside.

    The watermark of a batch is the latest `at` of all earlier batches less the allowed days; rows
    before it are late. They are kept, in folders of their own (`late=true`), and counted. A batch
    reads the marks of earlier batches only, so its replay gives the same rows and counts.
    """
    spark = stream.sparkSession

    def one(batch: DataFrame, batch_id: int) -> None:
        mark = None
        if batch_id > 0:
            earlier = spark.read.schema(f"{MARKS}, batch bigint").parquet(f"{output}/marks")
            mark = earlier.filter(F.col("batch") < batch_id).agg(F.max("mark")).scalar()
        seen = batch.select("*", F.col(at).cast("timestamp_ntz").alias("_at"))
        if batch_id > 0:
            seen = seen.withColumn("_mark", mark)
            limit = F.col("_mark") - F.expr(f"interval {allowed_days} days")
            late = F.coalesce(F.col("_at") < limit, F.lit(False))
            seen = seen.withColumn("late", late).drop("_mark")
        else:
            seen = seen.withColumn("late", F.lit(False))
        folder = f"{output}/rows/batch={batch_id}"
        placed = seen.drop("_at").withColumn("period", period)
        placed.hint("rebalance", F.col("late"), F.col("period")).write.mode("overwrite").partitionBy(
            "late", "period"
        ).parquet(folder)
        kept = read_placed(spark, output, stream.schema).filter(F.col("batch") == batch_id)
        kept.agg(
            F.max(F.col(at).cast("timestamp_ntz")).alias("mark"),
            F.count_if(~F.col("late")).alias("on_time"),
            F.count_if("late").alias("late"),
        ).write.mode("overwrite").parquet(f"{output}/marks/batch={batch_id}")

    job = (
        stream.writeStream.foreachBatch(one)
        .option("checkpointLocation", f"{output}/progress")
        .trigger(availableNow=True)
        .start()
    )
    job.awaitTermination()


def read_placed(spark: SparkSession, output: str, schema: StructType) -> DataFrame:
    """All stored rows with `late`, `period` and `batch`; each prunes folders."""
    stored = StructType([*schema.fields])
    for field in StructType.fromDDL(PLACED).fields:
        stored = stored.add(field)
    return spark.read.schema(stored).parquet(f"{output}/rows")


def read_marks(spark: SparkSession, output: str) -> DataFrame:
    """(mark, on_time, late, batch): what each batch held, and the latest time in it."""
    return spark.read.schema(f"{MARKS}, batch bigint").parquet(f"{output}/marks")


def running_sums(
    stream: DataFrame, output: str, keys: Sequence[Column], sums: dict[str, Column]
) -> None:
    """Keep a summary current in the state store: one running value per key and aggregate, carried
    from batch to batch and through a restart. A batch stores the keys it has changed, with their
    totals up to then."""
    totals = stream.groupBy(*keys).agg(*[c.alias(n) for n, c in sums.items()])
    run_batches(
        totals, output, lambda batch, folder: batch.write.mode("overwrite").parquet(folder), "update"
    )


def read_totals(spark: SparkSession, output: str, schema: str, keys: Sequence[str]) -> DataFrame:
    """The summary after all batches: the newest row per key."""
    rows = read_batches(spark, output, schema)
    values = [c for c in rows.columns if c not in (*keys, "batch")]
    newest = F.max_by(F.struct(*values), "batch").alias("_n")
    return rows.groupBy(*keys).agg(newest).select(*keys, "_n.*")


def incremental_sums(
    stream: DataFrame, output: str, keys: Sequence[Column], sums: dict[str, Column]
) -> None:
    """Keep a summary current: each batch stores its own partial sums per key.
    `sums` names additive aggregates."""

    def make(batch: DataFrame) -> DataFrame:
        return batch.groupBy(*keys).agg(*[c.alias(n) for n, c in sums.items()])

    derive(stream, output, make)
