"""Lookup routines as one set-based result for all keys; a point call is a filter on it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakemill.operators.relational import latest_per_key, row_count
from lakemill.functions.scalars import month_start


def customer_balance(
    customers: DataFrame, rentals: DataFrame, payments: DataFrame, as_of: str
) -> DataFrame:
    """Fees plus one unit per overdue day minus payments, all up to `as_of`.

    rentals(customer_id, rental_date, return_date, duration, rate);
    payments(customer_id, payment_date, amount). A rental not returned is not overdue.
    """
    day = F.lit(as_of).cast("timestamp_ntz")
    late = F.datediff("return_date", "rental_date") - F.col("duration")
    fees = (
        rentals.filter(F.col("rental_date") <= day)
        .groupBy("customer_id")
        .agg(
            F.sum("rate").alias("fees"),
            F.sum(F.when(late > 0, late).otherwise(0)).alias("overdue"),
        )
    )
    paid = (
        payments.filter(F.col("payment_date") <= day)
        .groupBy("customer_id")
        .agg(F.sum("amount").alias("paid"))
    )
    zero = F.lit(0)
    return (
        customers.join(fees, "customer_id", "left")
        .join(paid, "customer_id", "left")
        .select(
            "customer_id",
            (F.coalesce("fees", zero) + F.coalesce("overdue", zero) - F.coalesce("paid", zero))
            .cast("decimal(28,2)")
            .alias("balance"),
        )
    )


def stock(inventory: DataFrame, rentals: DataFrame) -> DataFrame:
    """Inventory with `in_stock`: no rental of the item is open."""
    out = rentals.filter("return_date IS NULL").select("inventory_id").distinct()
    flagged = inventory.join(out.withColumn("_out", F.lit(True)), "inventory_id", "left")
    return flagged.withColumn("in_stock", F.col("_out").isNull()).drop("_out")


def held_by(inventory: DataFrame, rentals: DataFrame, newest: Sequence[str]) -> DataFrame:
    """Item, the customer of its latest open rental, and how many open rentals it has.

    `newest` are the columns whose highest values mark the latest rental.
    """
    holders = (
        rentals.filter("return_date IS NULL")
        .groupBy("inventory_id")
        .agg(
            F.max_by("customer_id", F.struct(*newest)).alias("customer_id"),
            row_count().alias("open_rentals"),
        )
    )
    return (
        inventory.select("inventory_id")
        .join(holders, "inventory_id", "left")
        .withColumn("open_rentals", F.coalesce("open_rentals", F.lit(0)))
    )


def film_stock(
    inventory: DataFrame, rentals: DataFrame, in_stock: bool, film=None, store=None
) -> DataFrame:
    """(film_id, store_id, inventory_id, film_count): the items in or out of stock and how many
    there are per film and store."""
    wanted = inventory
    if film is not None:
        wanted = wanted.filter(F.col("film_id") == film)
    if store is not None:
        wanted = wanted.filter(F.col("store_id") == store)
    items = stock(wanted, rentals).filter(F.col("in_stock") == in_stock).drop("in_stock")
    counts = items.groupBy("film_id", "store_id").agg(row_count().alias("film_count"))
    return items.join(counts, ["film_id", "store_id"])


def rewards_report(
    customers: DataFrame,
    payments: DataFrame,
    min_purchases: int,
    min_amount: float,
    as_of: str,
    months_back: int = 1,
) -> DataFrame:
    """Customers with more than `min_purchases` payments and more than `min_amount` paid in the
    calendar month `months_back` before `as_of`. Both tests are strict."""
    if min_purchases <= 0 or min_amount <= 0:
        raise ValueError("both minimums must be greater than zero")
    first = month_start(F.lit(as_of), months_back)
    rich = (
        payments.filter(
            (F.col("payment_date") >= first.cast("timestamp_ntz"))
            & (F.col("payment_date") < F.add_months(first, 1).cast("timestamp_ntz"))
        )
        .groupBy("customer_id")
        .agg(F.sum("amount").alias("paid"), row_count().alias("n"))
        .filter((F.col("paid") > min_amount) & (F.col("n") > min_purchases))
    )
    return customers.join(rich, "customer_id", "left_semi")


def latest_department(history: DataFrame) -> DataFrame:
    """(emp_no, dept_no) of the newest `from_date`; ties go to the smallest department."""
    newest = latest_per_key(
        history.select("emp_no", "dept_no", "from_date"),
        ["emp_no"],
        [F.desc("from_date"), F.asc("dept_no")],
    )
    return newest.select("emp_no", "dept_no")


def current_manager(managers: DataFrame, employees: DataFrame) -> DataFrame:
    """(dept_no, manager) of the newest manager row per department."""
    newest = latest_per_key(
        managers.select("dept_no", "emp_no", "from_date"),
        ["dept_no"],
        [F.desc("from_date"), F.asc("emp_no")],
    )
    return newest.join(employees, "emp_no").select("dept_no", F.col("emp_name").alias("manager"))


def latest_dates(history: DataFrame) -> DataFrame:
    """(emp_no, from_date, to_date): the latest of each, not always of one row."""
    return history.groupBy("emp_no").agg(
        F.max("from_date").alias("from_date"), F.max("to_date").alias("to_date")
    )


def current_department(history: DataFrame) -> DataFrame:
    """The rows holding both latest dates: none when they sit on different rows, several on ties."""
    return history.join(latest_dates(history), ["emp_no", "from_date", "to_date"]).select(
        "emp_no", "dept_no", "from_date", "to_date"
    )


def null_counts(df: DataFrame) -> DataFrame:
    """(column_name, nulls) for every column, from one pass."""
    counts = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns])
    return counts.unpivot([], [F.col(f"`{c}`") for c in df.columns], "column_name", "nulls")
