"""Hotel, clinic and booking reports over the generated tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakemill.operators.hotel import room_cost
from lakemill.operators.joins import keep_all
from lakemill.operators.relational import money, money_sum, row_count
from lakemill.plans import fixtures as X
from lakemill.plans.registry import query

C = F.col

# ----------------------------------------------------------------------------- hotel

# A line is a stay: its part is the room, its order's customer the guest.
STAYS_SQL = (
    "SELECT c_custkey, c_name, l_partkey AS room, l_orderkey, l_linenumber, l_linenumber AS adults,"
    " CAST(l_discount * 100 AS INTEGER) % 3 AS children, CAST(l_shipdate AS DATE) AS check_in,"
    " CAST(l_shipdate AS DATE) + CAST(l_quantity AS INTEGER) AS check_out, p_size FROM lineitem"
    " JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey"
    " JOIN part ON l_partkey = p_partkey"
)


def stays(t):
    """Orders meet their customers first, so the lines are moved once for both."""
    start = F.to_date("l_shipdate")
    guests = t.orders.join(t.customer, C("o_custkey") == C("c_custkey")).select(
        "o_orderkey", "c_custkey", "c_name"
    )
    return (
        t.lineitem.join(guests, C("l_orderkey") == C("o_orderkey"))
        .join(t.part, C("l_partkey") == C("p_partkey"))
        .select(
            "c_custkey", "c_name", C("l_partkey").alias("room"), "l_orderkey", "l_linenumber",
            C("l_linenumber").alias("adults"),
            (F.round(C("l_discount") * 100).cast("int") % 3).alias("children"),
            start.alias("check_in"),
            F.date_add(start, C("l_quantity").cast("int")).alias("check_out"),
            "p_size",
        )
    )


@query(
    "rpt_reservations_in_month",
    f"SELECT c_name, room, check_in, check_out FROM ({STAYS_SQL})"
    " WHERE check_out BETWEEN DATE '1998-07-01' AND DATE '1998-07-31'",
)
def reservations_in_month(t):
    return (
        stays(t)
        .filter("check_out BETWEEN DATE '1998-07-01' AND DATE '1998-07-31'")
        .select("c_name", "room", "check_in", "check_out")
    )


@query(
    "rpt_jacuzzi",
    f"SELECT c_name, room, check_in, check_out FROM ({STAYS_SQL}) WHERE p_size >= 48",
)
def jacuzzi(t):
    return stays(t).filter("p_size >= 48").select("c_name", "room", "check_in", "check_out")


@query(
    "rpt_guest_rooms",
    "SELECT c_custkey, c_name, room, check_in, check_out, CAST(adults + children AS INTEGER)"
    f" AS total_people FROM ({STAYS_SQL})",
)
def guest_rooms(t, guest=None):
    """All stays of every guest, or of one."""
    rows = stays(t)
    if guest is not None:
        rows = rows.filter(C("c_custkey") == guest)
    return rows.select(
        "c_custkey", "c_name", "room", "check_in", "check_out",
        (C("adults") + C("children")).alias("total_people"),
    )


# Rooms are numbered by size: two floors of eight rooms and two suites, repeated.
ROOM_SQL = "CASE WHEN p_size % 18 < 8 THEN 201 + p_size % 18 WHEN p_size % 18 < 16" \
    " THEN 293 + p_size % 18 ELSE 385 + p_size % 18 END"


@query(
    "rpt_room_cost",
    "SELECT p_partkey, room_number, l_orderkey, CAST(CASE"
    " WHEN class = 'family' AND adults <= 2 OR class = 'single' OR class = 'suite'"
    " AND adults <= 3 THEN price * nights"
    " WHEN class = 'family' THEN price + (adults - 2) * 10 * nights"
    " WHEN class = 'suite' THEN price + (adults - 3) * 20 * nights END AS DECIMAL(28,2)) AS total"
    f" FROM (SELECT p_partkey, {ROOM_SQL} AS room_number, CAST(p_retailprice AS DECIMAL(18,2)) AS"
    " price, CASE WHEN p_size % 18 >= 16 THEN 'suite' WHEN p_size % 18 % 8 < 4 THEN 'family'"
    " ELSE 'single' END AS class, p_size FROM part) LEFT JOIN (SELECT l_partkey, l_orderkey,"
    " l_linenumber AS adults, CAST(l_quantity AS INTEGER) AS nights FROM lineitem)"
    " ON l_partkey = p_partkey",
)
def rpt_room_cost(t):
    """Every room, with the cost of each stay or NULL."""
    slot = C("p_size") % 18
    number = F.when(slot < 8, slot + 201).when(slot < 16, slot + 293).otherwise(slot + 385)
    rooms = t.part.select(
        "p_partkey",
        number.alias("room_number"),
        money("p_retailprice").alias("price"),
        F.when(slot >= 16, 3).otherwise(2).alias("standard"),
    )
    start = F.to_date("l_shipdate")
    stayed = t.lineitem.select(
        "l_partkey", "l_orderkey", C("l_linenumber").alias("adults"), start.alias("check_in"),
        F.date_add(start, C("l_quantity").cast("int")).alias("check_out"),
    )
    cost = room_cost(
        C("room_number"), C("price"), C("standard"), C("adults"), C("check_in"), C("check_out")
    )
    return keep_all(rooms, stayed, ["p_partkey"], ["l_partkey"]).select(
        "p_partkey", "room_number", "l_orderkey", cost.cast("decimal(28,2)").alias("total")
    )


@query(
    "rpt_large_parties",
    f"SELECT room, l_orderkey, l_linenumber FROM ({STAYS_SQL}) WHERE adults + children > 2 AND"
    " (check_in BETWEEN DATE '1998-04-01' AND DATE '1998-04-30'"
    " OR check_out BETWEEN DATE '1998-04-01' AND DATE '1998-04-30')",
)
def large_parties(t):
    april = "BETWEEN DATE '1998-04-01' AND DATE '1998-04-30'"
    return (
        stays(t)
        .filter(f"adults + children > 2 AND (check_in {april} OR check_out {april})")
        .select("room", "l_orderkey", "l_linenumber")
    )


@query(
    "rpt_reservations_per_guest",
    "SELECT c_custkey, c_name, COUNT(*) AS reservations FROM orders JOIN customer"
    " ON o_custkey = c_custkey GROUP BY c_custkey, c_name ORDER BY reservations DESC, c_name",
)
def reservations_per_guest(t):
    """Counted by the guest's key; grouping by first name would merge different guests."""
    counts = t.orders.groupBy("o_custkey").agg(row_count().alias("reservations"))
    return (
        counts.join(t.customer, C("o_custkey") == C("c_custkey"))
        .select("c_custkey", "c_name", "reservations")
        .orderBy(F.desc("reservations"), "c_name", "c_custkey")
    )


@query(
    "rpt_guest_by_phone",
    "SELECT c_custkey, c_name, c_nationkey, c_mktsegment FROM customer WHERE c_name LIKE '%00077%'",
)
def guest_by_phone(t, text="00077"):
    return t.customer.filter(C("c_name").contains(text)).select(
        "c_custkey", "c_name", "c_nationkey", "c_mktsegment"
    )


# ---------------------------------------------------------------------------- clinic


def with_patients(t, per_patient: DataFrame, how: str = "left") -> DataFrame:
    """Patients with aggregates already reduced to one row per patient."""
    return t.customer.join(per_patient, C("c_custkey") == C("patient_id"), how)


@query(
    "rpt_patient_visits",
    "SELECT c_custkey, c_name, COUNT(appointment_id) AS appointments, CAST(SUM(CASE WHEN status"
    " = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS missed, CAST(MIN(held_on) AS DATE) AS first_visit,"
    " CAST(MAX(held_on) AS DATE) AS last_visit FROM customer LEFT JOIN"
    f" ({X.APPOINTMENTS_SQL}) ON c_custkey = patient_id GROUP BY c_custkey, c_name",
)
def patient_visits(t):
    visits = (
        X.appointments(t)
        .groupBy("patient_id")
        .agg(
            row_count().alias("n"),
            F.sum(F.when(C("status") == "F", 1).otherwise(0)).alias("m"),
            F.min("held_on").cast("date").alias("first_visit"),
            F.max("held_on").cast("date").alias("last_visit"),
        )
    )
    return (
        with_patients(t, visits)
        .select(
            "c_custkey", "c_name",
            F.coalesce("n", F.lit(0)).alias("appointments"),
            F.coalesce("m", F.lit(0)).alias("missed"),
            "first_visit", "last_visit",
        )
        .orderBy(F.desc("appointments"), "c_custkey")
    )


@query(
    "rpt_patient_billing",
    "SELECT c_custkey, c_name, COUNT(b.appointment_id) AS bills, CAST(SUM(amount) AS"
    " DECIMAL(28,2)) AS total, CAST(SUM(amount) AS DOUBLE) / COUNT(amount) AS mean,"
    " CAST(SUM(CASE WHEN b.status = 'O' THEN amount ELSE 0 END) AS DECIMAL(28,2)) AS unpaid"
    f" FROM customer LEFT JOIN ({X.APPOINTMENTS_SQL}) a ON c_custkey = patient_id"
    f" LEFT JOIN ({X.BILLS_SQL}) b ON a.appointment_id = b.appointment_id"
    " GROUP BY c_custkey, c_name",
)
def patient_billing(t, unpaid_status="O"):
    unpaid = F.when(C("status") == unpaid_status, C("amount")).otherwise(0)
    per_appointment = (
        X.bills(t)
        .groupBy("appointment_id")
        .agg(
            row_count().alias("n"), F.sum("amount").alias("s"), F.sum(unpaid).alias("u")
        )
    )
    per_patient = (
        X.appointments(t)
        .join(per_appointment, "appointment_id")
        .groupBy("patient_id")
        .agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("u").alias("u"))
    )
    return with_patients(t, per_patient).select(
        "c_custkey", "c_name",
        F.coalesce("n", F.lit(0)).alias("bills"),
        C("s").cast("decimal(28,2)").alias("total"),
        (C("s").cast("double") / C("n")).alias("mean"),
        F.coalesce("u", F.lit(0)).cast("decimal(28,2)").alias("unpaid"),
    )


@query(
    "rpt_prescriptions",
    "SELECT c_custkey, p_type AS medication, COUNT(DISTINCT b.appointment_id) AS prescriptions,"
    " MIN(day) AS first_use, MAX(day) AS last_use FROM customer"
    f" LEFT JOIN ({X.APPOINTMENTS_SQL}) a ON c_custkey = patient_id"
    f" LEFT JOIN ({X.BILLS_SQL}) b ON a.appointment_id = b.appointment_id"
    " LEFT JOIN part ON item_id = p_partkey GROUP BY c_custkey, p_type",
)
def prescriptions(t):
    """Reduced to one row per (appointment, medication) first: distinct counts become counts.

    An appointment without a prescription contributes a row without a medication."""
    given = (
        X.bills(t)
        .join(t.part, C("item_id") == C("p_partkey"))
        .groupBy("appointment_id", "p_type")
        .agg(F.min("day").alias("f"), F.max("day").alias("l"), F.lit(1).alias("hit"))
    )
    per_patient = (
        X.appointments(t)
        .join(given, "appointment_id", "left")
        .groupBy("patient_id", "p_type")
        .agg(
            F.count("hit").alias("n"), F.min("f").alias("first_use"), F.max("l").alias("last_use")
        )
    )
    return with_patients(t, per_patient).select(
        "c_custkey", C("p_type").alias("medication"),
        F.coalesce("n", F.lit(0)).alias("prescriptions"), "first_use", "last_use",
    )


@query(
    "rpt_lab_summary",
    "SELECT c_custkey, COUNT(b.appointment_id) AS ordered, COUNT(CASE WHEN b.status = 'F' THEN 1"
    " END) AS completed, COUNT(CASE WHEN b.status = 'O' THEN 1 END) AS pending, MAX(day) AS"
    f" latest FROM customer LEFT JOIN ({X.APPOINTMENTS_SQL}) a ON c_custkey = patient_id"
    f" LEFT JOIN ({X.BILLS_SQL}) b ON a.appointment_id = b.appointment_id GROUP BY c_custkey",
)
def lab_summary(t):
    per_appointment = (
        X.bills(t)
        .groupBy("appointment_id")
        .agg(
            row_count().alias("n"),
            F.count_if(C("status") == "F").alias("f"),
            F.count_if(C("status") == "O").alias("o"),
            F.max("day").alias("latest"),
        )
    )
    per_patient = (
        X.appointments(t)
        .join(per_appointment, "appointment_id")
        .groupBy("patient_id")
        .agg(
            F.sum("n").alias("n"), F.sum("f").alias("f"), F.sum("o").alias("o"),
            F.max("latest").alias("latest"),
        )
    )
    zero = F.lit(0)
    return with_patients(t, per_patient).select(
        "c_custkey",
        F.coalesce("n", zero).alias("ordered"),
        F.coalesce("f", zero).alias("completed"),
        F.coalesce("o", zero).alias("pending"),
        "latest",
    )


@query(
    "rpt_staff_load",
    "SELECT s_suppkey, s_name, COUNT(*) AS appointments, ROUND(AVG(COUNT(*)) OVER (), 4) AS"
    " mean_load FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY s_suppkey, s_name",
)
def staff_load(t):
    loads = t.lineitem.groupBy("l_suppkey").agg(row_count().alias("appointments"))
    named = loads.join(t.supplier, C("l_suppkey") == C("s_suppkey")).select(
        "s_suppkey", "s_name", "appointments"
    )
    mean = named.agg(F.round(F.avg("appointments"), 4)).scalar()
    return named.withColumn("mean_load", mean).orderBy(F.desc("appointments"), "s_suppkey")


@query(
    "rpt_monthly_trend",
    "SELECT CAST(month(o_orderdate) AS INTEGER) AS month, COUNT(*) AS appointments,"
    " CAST(SUM(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS no_shows"
    " FROM orders GROUP BY 1 ORDER BY 1",
)
def monthly_trend(t):
    """By month number: the years are merged."""
    return (
        t.orders.groupBy(F.month("o_orderdate").alias("month"))
        .agg(
            row_count().alias("appointments"),
            F.sum(F.when(C("o_orderstatus") == "F", 1).otherwise(0)).alias("no_shows"),
        )
        .orderBy("month")
    )


@query(
    "rpt_medication_top",
    "SELECT p_name AS medication, COUNT(*) AS times_prescribed FROM lineitem JOIN part"
    " ON l_partkey = p_partkey GROUP BY p_name ORDER BY times_prescribed DESC",
)
def medication_top(t):
    per_part = t.lineitem.groupBy("l_partkey").agg(row_count().alias("n"))
    return (
        per_part.join(t.part, C("l_partkey") == C("p_partkey"))
        .groupBy(C("p_name").alias("medication"))
        .agg(F.sum("n").alias("times_prescribed"))
        .orderBy(F.desc("times_prescribed"), "medication")
    )


@query(
    "rpt_above_average",
    "WITH b AS (SELECT o_custkey, SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS billed FROM orders"
    " GROUP BY o_custkey), m AS (SELECT CAST(SUM(billed) AS DOUBLE) / COUNT(*) AS mean FROM b)"
    " SELECT o_custkey, c_name, CAST(billed AS DECIMAL(28,2)) AS total_billed, ROUND(mean, 2) AS"
    " average_billed FROM b JOIN customer ON o_custkey = c_custkey CROSS JOIN m"
    " WHERE CAST(billed AS DOUBLE) > mean ORDER BY o_custkey",
)
def above_average(t):
    billed = t.orders.groupBy("o_custkey").agg(money_sum("o_totalprice").alias("total_billed"))
    mean = billed.agg(F.sum("total_billed").cast("double") / row_count()).scalar()
    return (
        billed.filter(C("total_billed").cast("double") > mean)
        .join(t.customer, C("o_custkey") == C("c_custkey"))
        .select("o_custkey", "c_name", "total_billed", F.round(mean, 2).alias("average_billed"))
        .orderBy("o_custkey")
    )


@query(
    "rpt_animals",
    "SELECT c_custkey, c_name, n_name AS breed, r_name AS species FROM customer"
    " JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
)
def animals(t):
    return (
        t.customer.join(t.nation, C("c_nationkey") == C("n_nationkey"))
        .join(t.region, C("n_regionkey") == C("r_regionkey"))
        .select("c_custkey", "c_name", C("n_name").alias("breed"), C("r_name").alias("species"))
    )


@query(
    "rpt_branch_managers",
    "SELECT s_suppkey, s_name, c_custkey AS manager_id, c_name AS manager FROM supplier, customer,"
    " nation WHERE s_suppkey = c_custkey AND s_nationkey = n_nationkey",
)
def branch_managers(t):
    """A branch's manager shares its key."""
    return t.spark.sql(
        "SELECT s_suppkey, s_name, c_custkey AS manager_id, c_name AS manager FROM {s}, {c}, {n}"
        " WHERE s_suppkey = c_custkey AND s_nationkey = n_nationkey",
        s=t.supplier, c=t.customer, n=t.nation,
    )


@query(
    "rpt_patient_bill_total",
    "SELECT CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS billed,"
    " COUNT(*) AS bills FROM lineitem, orders, customer WHERE l_orderkey = o_orderkey"
    " AND o_custkey = c_custkey AND c_name = 'Customer#000000077'",
)
def patient_bill_total(t, name="Customer#000000077"):
    """The sum billed to one named patient and the number of bills; NULL and 0 without any."""
    theirs = t.customer.filter(C("c_name") == name).select("c_custkey")
    orders = t.orders.join(theirs, C("o_custkey") == C("c_custkey")).select("o_orderkey")
    return t.lineitem.join(orders, C("l_orderkey") == C("o_orderkey")).agg(
        money_sum("l_extendedprice").alias("billed"), row_count().alias("bills")
    )


@query(
    "rpt_physician_departments",
    f"SELECT DISTINCT h.emp_no, emp_name, d.dept_no, dept_name FROM ({X.HISTORY_SQL}) h"
    f" JOIN ({X.EMPLOYEES_SQL}) e ON h.emp_no = e.emp_no"
    f" JOIN ({X.DEPARTMENTS_SQL}) d ON h.dept_no = d.dept_no",
)
def physician_departments(t):
    bridge = X.history(t).select("emp_no", "dept_no").distinct()
    return bridge.join(X.employees(t), "emp_no").join(X.departments(t), "dept_no").select(
        "emp_no", "emp_name", "dept_no", "dept_name"
    )


# -------------------------------------------------------------------------- bookings


@query(
    "rpt_busiest_month",
    "SELECT monthname(o_orderdate) AS arrival_month, COUNT(*) AS n FROM orders GROUP BY 1"
    " ORDER BY n DESC",
)
def busiest_month(t):
    return (
        t.orders.groupBy(F.date_format("o_orderdate", "MMMM").alias("arrival_month"))
        .agg(row_count().alias("n"))
        .orderBy(F.desc("n"), "arrival_month")
    )


@query(
    "rpt_week_weekend",
    "SELECT l_returnflag AS hotel, CAST(SUM(CAST(l_quantity AS BIGINT)) AS BIGINT) AS week_nights,"
    " CAST(SUM(l_linenumber) AS BIGINT) AS weekend_nights FROM lineitem GROUP BY 1 ORDER BY 1 DESC",
)
def week_weekend(t):
    return (
        t.lineitem.groupBy(C("l_returnflag").alias("hotel"))
        .agg(
            F.sum(C("l_quantity").cast("bigint")).alias("week_nights"),
            F.sum("l_linenumber").alias("weekend_nights"),
        )
        .orderBy(F.desc("hotel"))
    )


def ranked_counts(df: DataFrame, column: str, name: str) -> DataFrame:
    return df.groupBy(C(column).alias(name)).agg(row_count().alias("n")).orderBy(F.desc("n"), name)


def ranked_sql(table: str, column: str, name: str) -> str:
    return f"SELECT {column} AS {name}, COUNT(*) AS n FROM {table} GROUP BY 1 ORDER BY n DESC"


@query("rpt_hotel_preference", ranked_sql("lineitem", "l_linestatus", "hotel"))
def hotel_preference(t):
    return ranked_counts(t.lineitem, "l_linestatus", "hotel")


@query("rpt_room_type", ranked_sql("part", "p_type", "room_type"))
def room_type(t):
    return ranked_counts(t.part, "p_type", "room_type")


@query("rpt_market_segment", ranked_sql("customer", "c_mktsegment", "segment"))
def market_segment(t):
    return ranked_counts(t.customer, "c_mktsegment", "segment")


@query(
    "rpt_family_stays",
    "SELECT COUNT(*) AS stays, children, babies FROM (SELECT l_linenumber - 4 AS children,"
    " CAST(l_quantity AS INTEGER) - 45 AS babies FROM lineitem) WHERE children > 0 OR babies > 0"
    " GROUP BY children, babies ORDER BY 1 DESC",
)
def family_stays(t):
    counted = t.lineitem.select(
        (C("l_linenumber") - 4).alias("children"),
        (C("l_quantity").cast("int") - 45).alias("babies"),
    )
    return (
        counted.filter("children > 0 OR babies > 0")
        .groupBy("children", "babies")
        .agg(row_count().alias("stays"))
        .orderBy(F.desc("stays"), "children", "babies")
    )


DISTRIBUTIONS = (
    ("status", "orders", "o_orderstatus"),
    ("priority", "orders", "o_orderpriority"),
    ("payment", "lineitem", "l_returnflag"),
    ("extra", "events", "event_type"),
    ("traveller", "customer", "c_mktsegment"),
)


@query(
    "rpt_domain_stats",
    " UNION ALL ".join(
        f"SELECT '{d}' AS dimension, {c} AS value, COUNT(*) AS n,"
        f" ROUND(100.0::DOUBLE * COUNT(*) / SUM(COUNT(*)) OVER (), 4) AS share FROM {tab} GROUP BY 2"
        for d, tab, c in DISTRIBUTIONS
    ),
)
def domain_stats(t):
    """Value counts and shares of several columns; each table is read once. The window is over
    the counts, one row per value of a domain."""

    def counts(table):
        pairs = [
            F.struct(F.lit(d).alias("dimension"), C(c).alias("value"))
            for d, of, c in DISTRIBUTIONS
            if of == table
        ]
        rows = getattr(t, table).select(F.explode(F.array(*pairs)).alias("p"))
        return rows.groupBy("p.dimension", "p.value").agg(row_count().alias("n"))

    found = reduce(DataFrame.unionByName, [counts(n) for n in dict.fromkeys(d[1] for d in DISTRIBUTIONS)])
    total = F.sum("n").over(Window.partitionBy("dimension"))
    return found.withColumn("share", F.round(F.lit(100.0) * C("n") / total, 4))
