"""Lookup routines, computed for every key at once."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakemill.operators import lookups as L
from lakemill.operators.lists import distinct_list
from lakemill.operators.relational import money, row_count
from lakemill.plans import fixtures as X
from lakemill.plans.registry import query

C = F.col
AS_OF = "1999-06-30"


@query(
    "udf_customer_balance",
    "WITH r AS (SELECT o_custkey AS k, SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS fees,"
    " SUM(greatest(0, coalesce(date_diff('day', o_orderdate, shipped), 0) - 30)) AS overdue"
    " FROM orders LEFT JOIN (SELECT l_orderkey, MAX(l_shipdate) AS shipped FROM lineitem"
    " WHERE l_returnflag = 'R' GROUP BY l_orderkey) ON l_orderkey = o_orderkey"
    f" WHERE o_orderdate <= TIMESTAMP '{AS_OF}' GROUP BY o_custkey),"
    " p AS (SELECT o_custkey AS k, SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS paid FROM orders"
    f" WHERE o_orderstatus = 'F' AND o_orderdate <= TIMESTAMP '{AS_OF}' GROUP BY o_custkey)"
    " SELECT c_custkey AS customer_id, CAST(coalesce(fees, 0) + coalesce(overdue, 0)"
    " - coalesce(paid, 0) AS DECIMAL(28,2)) AS balance FROM customer"
    " LEFT JOIN r ON c_custkey = r.k LEFT JOIN p ON c_custkey = p.k",
)
def customer_balance(t):
    returned = (
        t.lineitem.filter("l_returnflag = 'R'")
        .groupBy("l_orderkey")
        .agg(F.max("l_shipdate").alias("return_date"))
    )
    rentals = t.orders.join(returned, C("l_orderkey") == C("o_orderkey"), "left").select(
        C("o_custkey").alias("customer_id"),
        C("o_orderdate").alias("rental_date"),
        "return_date",
        F.lit(30).alias("duration"),
        money("o_totalprice").alias("rate"),
    )
    payments = t.orders.filter("o_orderstatus = 'F'").select(
        C("o_custkey").alias("customer_id"),
        C("o_orderdate").alias("payment_date"),
        money("o_totalprice").alias("amount"),
    )
    customers = t.customer.select(C("c_custkey").alias("customer_id"))
    return L.customer_balance(customers, rentals, payments, AS_OF)


OPEN_SQL = f"SELECT inventory_id FROM ({X.RENTALS_SQL}) WHERE return_date IS NULL"


@query(
    "udf_inventory_in_stock",
    f"SELECT inventory_id, inventory_id NOT IN ({OPEN_SQL}) AS in_stock FROM ({X.INVENTORY_SQL})",
)
def inventory_in_stock(t):
    return L.stock(X.inventory(t), X.rentals(t)).select("inventory_id", "in_stock")


@query(
    "udf_inventory_held_by",
    f"SELECT i.inventory_id, customer_id, coalesce(n, 0) AS open_rentals FROM ({X.INVENTORY_SQL}) i"
    " LEFT JOIN (SELECT inventory_id, o_custkey AS customer_id, COUNT(*) OVER (PARTITION BY"
    " inventory_id) AS n, row_number() OVER (PARTITION BY inventory_id ORDER BY rental_date DESC,"
    f" rental_id DESC, line DESC) AS r FROM ({X.RENTALS_SQL}) JOIN orders ON rental_id = o_orderkey"
    " WHERE return_date IS NULL) h ON i.inventory_id = h.inventory_id AND r = 1",
)
def inventory_held_by(t):
    rentals = X.rentals(t).join(t.orders, C("rental_id") == C("o_orderkey")).withColumnRenamed(
        "o_custkey", "customer_id"
    )
    return L.held_by(X.inventory(t), rentals, ["rental_date", "rental_id", "line"])


def film_sql(test: str) -> str:
    return (
        "SELECT film_id, store_id, inventory_id, COUNT(*) OVER (PARTITION BY film_id, store_id)"
        f" AS film_count FROM ({X.INVENTORY_SQL}) WHERE inventory_id {test} ({OPEN_SQL})"
    )


@query("udtf_film_in_stock", film_sql("NOT IN"))
def film_in_stock(t, film=None, store=None):
    return L.film_stock(X.inventory(t), X.rentals(t), True, film, store)


@query("udtf_film_not_in_stock", film_sql("IN"))
def film_not_in_stock(t, film=None, store=None):
    return L.film_stock(X.inventory(t), X.rentals(t), False, film, store)


@query(
    "proc_rewards_report",
    "SELECT c_custkey AS customer_id, c_name, c_acctbal FROM customer WHERE c_custkey IN ("
    "SELECT o_custkey FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1998-02-01'"
    " AND DATE '1998-02-28' GROUP BY o_custkey HAVING SUM(CAST(o_totalprice AS DECIMAL(18,2)))"
    " > 200000 AND COUNT(*) > 1)",
)
def rewards_report(t):
    customers = t.customer.select(C("c_custkey").alias("customer_id"), "c_name", "c_acctbal")
    payments = t.orders.select(
        C("o_custkey").alias("customer_id"),
        C("o_orderdate").alias("payment_date"),
        money("o_totalprice").alias("amount"),
    )
    return L.rewards_report(customers, payments, 1, 200000, as_of="1998-03-31")


@query("udf_emp_dept_id", X.LATEST_DEPT_SQL)
def emp_dept_id(t):
    return L.latest_department(X.history(t))


@query(
    "udf_emp_dept_name",
    f"SELECT emp_no, dept_name FROM ({X.LATEST_DEPT_SQL}) l JOIN ({X.DEPARTMENTS_SQL}) d"
    " ON l.dept_no = d.dept_no",
)
def emp_dept_name(t):
    return L.latest_department(X.history(t)).join(X.departments(t), "dept_no").select(
        "emp_no", "dept_name"
    )


@query("udf_emp_name", X.EMPLOYEES_SQL)
def emp_name(t):
    return X.employees(t)


@query("udf_current_manager", X.CURRENT_MANAGER_SQL)
def current_manager(t):
    return L.current_manager(X.managers(t), X.employees(t))


@query(
    "udtf_show_departments",
    f"SELECT d.dept_no, dept_name, manager, COUNT(*) AS n FROM ({X.DEPARTMENTS_SQL}) d"
    f" LEFT JOIN ({X.CURRENT_MANAGER_SQL}) m ON d.dept_no = m.dept_no"
    f" JOIN ({X.CURRENT_DEPT_SQL}) p ON d.dept_no = p.dept_no GROUP BY ALL",
)
def show_departments(t):
    heads = L.current_department(X.history(t)).groupBy("dept_no").agg(row_count().alias("n"))
    managers = L.current_manager(X.managers(t), X.employees(t))
    return (
        X.departments(t)
        .join(managers, "dept_no", "left")
        .join(heads, "dept_no")
        .select("dept_no", "dept_name", "manager", "n")
    )


@query("udf_last_day", "SELECT o_orderkey, last_day(CAST(o_orderdate AS DATE)) AS d FROM orders")
def udf_last_day(t):
    return t.orders.select("o_orderkey", F.last_day("o_orderdate").alias("d"))


@query(
    "udaf_group_concat",
    "SELECT o_custkey, string_agg(DISTINCT v, ', ' ORDER BY v) AS names FROM (SELECT o_custkey,"
    " nullif(o_orderpriority, '3-MEDIUM') AS v FROM orders) GROUP BY o_custkey",
)
def group_concat(t):
    """NULL values are skipped; a group of NULLs only gives NULL."""
    values = t.orders.select(
        "o_custkey", F.nullif("o_orderpriority", F.lit("3-MEDIUM")).alias("v")
    )
    return distinct_list(values, ["o_custkey"], "v", ", ", "names")


@query(
    "proc_null_count",
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, COUNT(*) FILTER (WHERE {e} IS NULL) AS nulls FROM orders"
        for c, e in (
            ("o_orderkey", "o_orderkey"),
            ("o_custkey", "nullif(o_custkey % 7, 0)"),
            ("o_orderstatus", "nullif(o_orderstatus, 'O')"),
            ("o_totalprice", "o_totalprice"),
            ("o_orderdate", "o_orderdate"),
            ("o_orderpriority", "nullif(o_orderpriority, '5-LOW')"),
        )
    ),
)
def null_count(t):
    """Every column of the orders, three of them with gaps."""
    gaps = {
        "o_custkey": F.nullif(F.col("o_custkey") % 7, F.lit(0)),
        "o_orderstatus": F.nullif("o_orderstatus", F.lit("O")),
        "o_orderpriority": F.nullif("o_orderpriority", F.lit("5-LOW")),
    }
    return L.null_counts(t.orders.withColumns(gaps))
