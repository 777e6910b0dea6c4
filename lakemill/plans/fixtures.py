"""The generated tables seen as the rental, employee and clinic tables of the routines.

Each view is a row-wise rule over whole tables, with the same rule in SQL beside it.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lakemill.operators.relational import money
from lakemill.session import materialise

C = F.col

# Rental: a line is the rental of a part; a few lines are still open.
RENTALS_SQL = (
    "SELECT l_partkey AS inventory_id, l_orderkey AS rental_id, l_linenumber AS line,"
    " l_shipdate AS rental_date, CASE WHEN NOT (l_returnflag = 'N' AND l_linestatus = 'O'"
    " AND l_quantity > 40) THEN l_shipdate END AS return_date,"
    " CAST(l_extendedprice AS DECIMAL(18,2)) AS price FROM lineitem"
)


def rentals(t):
    is_open = (C("l_returnflag") == "N") & (C("l_linestatus") == "O") & (C("l_quantity") > 40)
    return t.lineitem.select(
        C("l_partkey").alias("inventory_id"),
        C("l_orderkey").alias("rental_id"),
        C("l_linenumber").alias("line"),
        C("l_shipdate").alias("rental_date"),
        F.when(~is_open, C("l_shipdate")).alias("return_date"),
        money("l_extendedprice").alias("price"),
    )


INVENTORY_SQL = (
    "SELECT p_partkey AS inventory_id, p_name AS film_id, p_size % 2 + 1 AS store_id FROM part"
)


def inventory(t):
    return t.part.select(
        C("p_partkey").alias("inventory_id"),
        C("p_name").alias("film_id"),
        (C("p_size") % 2 + 1).alias("store_id"),
    )


# Department history: an order puts its customer into the department of its priority.
HISTORY_SQL = (
    "SELECT o_custkey AS emp_no, substr(o_orderpriority, 1, 1) AS dept_no,"
    " CAST(o_orderdate AS DATE) AS from_date, CASE WHEN o_orderstatus = 'O'"
    " THEN DATE '9999-01-01' ELSE CAST(o_orderdate AS DATE) + CAST(o_orderkey % 400 AS INTEGER)"
    " END AS to_date FROM orders"
)


def history(t):
    start = F.to_date("o_orderdate")
    end = F.date_add(start, (C("o_orderkey") % 400).cast("int"))
    return t.orders.select(
        C("o_custkey").alias("emp_no"),
        F.substring("o_orderpriority", 1, 1).alias("dept_no"),
        start.alias("from_date"),
        F.when(C("o_orderstatus") == "O", F.lit("9999-01-01").cast("date"))
        .otherwise(end)
        .alias("to_date"),
    )


DEPARTMENTS_SQL = (
    "SELECT DISTINCT substr(o_orderpriority, 1, 1) AS dept_no, substr(o_orderpriority, 3)"
    " AS dept_name FROM orders"
)


def departments(t):
    """Stored as the small table it is, so that its size is known to the joins."""
    found = t.orders.select(
        F.substring("o_orderpriority", 1, 1).alias("dept_no"),
        F.substr("o_orderpriority", F.lit(3)).alias("dept_name"),
    ).distinct()
    return materialise(found, "departments")


MANAGERS_SQL = (
    "SELECT substr(o_orderpriority, 1, 1) AS dept_no, o_custkey AS emp_no,"
    " CAST(o_orderdate AS DATE) AS from_date FROM orders"
)


def managers(t):
    return t.orders.select(
        F.substring("o_orderpriority", 1, 1).alias("dept_no"),
        C("o_custkey").alias("emp_no"),
        F.to_date("o_orderdate").alias("from_date"),
    )


EMPLOYEES_SQL = (
    "SELECT c_custkey AS emp_no, concat_ws(' ', c_mktsegment, c_name) AS emp_name FROM customer"
)


def employees(t):
    return t.customer.select(
        C("c_custkey").alias("emp_no"),
        F.concat_ws(" ", "c_mktsegment", "c_name").alias("emp_name"),
    )


# Latest department and current manager, as SQL shared by several queries.
LATEST_DEPT_SQL = (
    "SELECT emp_no, dept_no FROM (SELECT *, row_number() OVER (PARTITION BY emp_no"
    f" ORDER BY from_date DESC, dept_no) AS r FROM ({HISTORY_SQL})) WHERE r = 1"
)
CURRENT_MANAGER_SQL = (
    "SELECT dept_no, emp_name AS manager FROM (SELECT *, row_number() OVER (PARTITION BY dept_no"
    f" ORDER BY from_date DESC, emp_no) AS r FROM ({MANAGERS_SQL})) m"
    f" JOIN ({EMPLOYEES_SQL}) e ON m.emp_no = e.emp_no WHERE r = 1"
)
CURRENT_DEPT_SQL = (
    f"SELECT h.emp_no, dept_no, h.from_date, h.to_date FROM ({HISTORY_SQL}) h JOIN"
    " (SELECT emp_no AS e, MAX(from_date) AS f, MAX(to_date) AS d"
    f" FROM ({HISTORY_SQL}) GROUP BY emp_no) ON h.emp_no = e AND h.from_date = f AND h.to_date = d"
)

# Clinic: an order is an appointment, its lines are bills.
APPOINTMENTS_SQL = (
    "SELECT o_orderkey AS appointment_id, o_custkey AS patient_id, o_orderstatus AS status,"
    " o_orderdate AS held_on FROM orders"
)


def appointments(t):
    return t.orders.select(
        C("o_orderkey").alias("appointment_id"),
        C("o_custkey").alias("patient_id"),
        C("o_orderstatus").alias("status"),
        C("o_orderdate").alias("held_on"),
    )


BILLS_SQL = (
    "SELECT l_orderkey AS appointment_id, l_partkey AS item_id, CAST(l_extendedprice AS"
    " DECIMAL(18,2)) AS amount, l_linestatus AS status, CAST(l_shipdate AS DATE) AS day"
    " FROM lineitem"
)


def bills(t):
    return t.lineitem.select(
        C("l_orderkey").alias("appointment_id"),
        C("l_partkey").alias("item_id"),
        money("l_extendedprice").alias("amount"),
        C("l_linestatus").alias("status"),
        F.to_date("l_shipdate").alias("day"),
    )
