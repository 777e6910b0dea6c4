"""Named views, stored summaries and dimension roll-ups over the generated tables.

Facts are summed or made distinct on their own key before they meet a dimension, so a key
holding a large part of the rows is a single row by the time it is joined.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lakemill.functions.scalars import sentence_case
from lakemill.operators import lookups as L
from lakemill.operators.lists import distinct_list, truncated_list
from lakemill.operators.olap import (
    days_between,
    determines,
    rollup_along,
    rollup_from,
    time_dimension,
)
from lakemill.operators.relational import (
    cents,
    money,
    money_sum,
    row_count,
    sum_cents,
    with_group_values,
)
from lakemill.operators.summaries import create_summary, read_summary, refresh_summary
from lakemill.plans import fixtures as X
from lakemill.plans.aggregates import objects_per_supplier, truncated_sql
from lakemill.plans.registry import query
from lakemill.session import materialise, work_folder

C = F.col
PRICE = "CAST(l_extendedprice AS DECIMAL(18,2))"
LINE_TOTAL = f"CAST(l_quantity AS INTEGER) * {PRICE}"


def line_total_sum():
    """Exact total of quantity times unit price."""
    return sum_cents(C("l_quantity").cast("int") * cents("l_extendedprice"))


# ------------------------------------------------------------------------ list views


@query(
    "view_customer_list",
    "SELECT c_custkey AS id, c_name AS name, n_name AS city, r_name AS country,"
    " CASE WHEN c_acctbal > 0 THEN 'active' ELSE '' END AS notes FROM customer"
    " JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
)
def customer_list(t):
    return (
        t.customer.join(t.nation, C("c_nationkey") == C("n_nationkey"))
        .join(t.region, C("n_regionkey") == C("r_regionkey"))
        .select(
            C("c_custkey").alias("id"),
            C("c_name").alias("name"),
            C("n_name").alias("city"),
            C("r_name").alias("country"),
            F.when(C("c_acctbal") > 0, "active").otherwise("").alias("notes"),
        )
    )


@query(
    "view_staff_list",
    "SELECT s_suppkey AS id, s_name AS name, n_name AS city, r_name AS country FROM supplier"
    " JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
)
def staff_list(t):
    return (
        t.supplier.join(t.nation, C("s_nationkey") == C("n_nationkey"))
        .join(t.region, C("n_regionkey") == C("r_regionkey"))
        .select(
            C("s_suppkey").alias("id"),
            C("s_name").alias("name"),
            C("n_name").alias("city"),
            C("r_name").alias("country"),
        )
    )


# A part is a film, its brand the category, and the nations that ship it in bulk its cast.
CAST_SQL = (
    "SELECT DISTINCT l_partkey AS k, n_name FROM lineitem JOIN supplier ON l_suppkey = s_suppkey"
    " JOIN nation ON s_nationkey = n_nationkey"
)


def film_cast(t):
    pairs = t.lineitem.select("l_partkey", "l_suppkey").distinct()
    return (
        pairs.join(t.supplier, C("l_suppkey") == C("s_suppkey"))
        .join(t.nation, C("s_nationkey") == C("n_nationkey"))
        .select(C("l_partkey").alias("k"), "n_name")
    )


def film_rows(t, cast, how):
    listed = distinct_list(cast, ["k"], "n_name", ", ", "actors")
    return t.part.join(listed, C("p_partkey") == C("k"), how).select(
        C("p_partkey").alias("fid"),
        C("p_name").alias("title"),
        C("p_brand").alias("category"),
        money("p_retailprice").alias("price"),
        "actors",
    )


def film_sql(join: str, actor: str = "n_name") -> str:
    return (
        "SELECT p_partkey AS fid, p_name AS title, p_brand AS category, CAST(p_retailprice AS"
        " DECIMAL(18,2)) AS price, actors FROM part "
        f"{join} (SELECT k, string_agg({actor}, ', ' ORDER BY {actor}) AS actors"
        f" FROM ({CAST_SQL}) GROUP BY k) ON p_partkey = k"
    )


@query("view_film_list", film_sql("LEFT JOIN"))
def film_list(t):
    return film_rows(t, film_cast(t), "left")


@query("view_film_list_pg", film_sql("JOIN"))
def film_list_inner(t):
    """The form that drops films without a cast."""
    return film_rows(t, film_cast(t), "inner")


@query(
    "view_film_list_nice",
    film_sql("LEFT JOIN", "(upper(substr(n_name, 1, 1)) || lower(substr(n_name, 2)))"),
)
def film_list_nice(t):
    nice = film_cast(t).withColumn("n_name", sentence_case("n_name"))
    return film_rows(t, nice, "left")


# ------------------------------------------------------------------------ sales views


@query(
    "view_sales_by_store",
    f"SELECT s_suppkey, s_name, n_name, r_name, CAST(SUM({PRICE}) AS DECIMAL(28,2)) AS total_sales"
    " FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey ="
    " n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL"
    " ORDER BY r_name, s_suppkey",
)
def sales_by_store(t):
    sums = t.lineitem.groupBy("l_suppkey").agg(money_sum("l_extendedprice").alias("total_sales"))
    return (
        sums.join(t.supplier, C("l_suppkey") == C("s_suppkey"))
        .join(t.nation, C("s_nationkey") == C("n_nationkey"))
        .join(t.region, C("n_regionkey") == C("r_regionkey"))
        .select("s_suppkey", "s_name", "n_name", "r_name", "total_sales")
        .orderBy("r_name", "s_suppkey")
    )


CATEGORY_SQL = (
    f"SELECT p_brand AS category, CAST(SUM({PRICE}) AS DECIMAL(28,2)) AS total_sales"
    " FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand ORDER BY total_sales DESC"
)


def category_sales(t):
    per_part = t.lineitem.groupBy("l_partkey").agg(money_sum("l_extendedprice").alias("s"))
    return (
        per_part.join(t.part, C("l_partkey") == C("p_partkey"))
        .groupBy(C("p_brand").alias("category"))
        .agg(F.sum("s").cast("decimal(28,2)").alias("total_sales"))
    )


@query("view_sales_by_category", CATEGORY_SQL)
def sales_by_category(t):
    return category_sales(t).orderBy(F.desc("total_sales"), "category")


@query("mv_rental_by_category", CATEGORY_SQL)
def rental_by_category(t):
    """Created empty, filled by a refresh, then read from storage."""
    path = work_folder(t.spark, "rental_by_category")
    sales = category_sales(t)
    create_summary(sales, path)
    refresh_summary(sales, path)
    return read_summary(t.spark, path, sales.schema).orderBy(F.desc("total_sales"), "category")


# ------------------------------------------------------------------------ actor views


@query(
    "view_actor_info",
    "SELECT s_suppkey, s_name, string_agg(p_type || ': ' || titles, '; ' ORDER BY p_type)"
    " AS film_info FROM supplier LEFT JOIN (SELECT l_suppkey, p_type, string_agg(p_name, ', '"
    " ORDER BY p_name) AS titles FROM (SELECT DISTINCT l_suppkey, p_type, p_name FROM lineitem"
    " JOIN part ON l_partkey = p_partkey) GROUP BY l_suppkey, p_type) ON s_suppkey = l_suppkey"
    " GROUP BY s_suppkey, s_name",
)
def actor_info(t):
    """Titles per category, then categories per supplier; both lists hold distinct values."""
    pairs = t.lineitem.select("l_suppkey", "l_partkey").distinct()
    named = pairs.join(t.part, C("l_partkey") == C("p_partkey"))
    titles = distinct_list(named, ["l_suppkey", "p_type"], "p_name", ", ", "titles")
    lines = titles.select(
        "l_suppkey", F.concat_ws(": ", "p_type", "titles").alias("line")
    )
    info = distinct_list(lines, ["l_suppkey"], "line", "; ", "film_info", is_distinct=True)
    return t.supplier.join(info, C("s_suppkey") == C("l_suppkey"), "left").select(
        "s_suppkey", "s_name", "film_info"
    )


@query(
    "view_actor_info_json",
    "SELECT s_suppkey, s_name, film_info FROM supplier LEFT JOIN (SELECT l_suppkey,"
    " to_json(map_from_entries(list((p_type, names) ORDER BY p_type)))::VARCHAR AS film_info"
    " FROM (SELECT l_suppkey, p_type, list(DISTINCT p_name ORDER BY p_name) AS names FROM lineitem"
    " JOIN part ON l_partkey = p_partkey GROUP BY l_suppkey, p_type) GROUP BY l_suppkey)"
    " ON s_suppkey = l_suppkey",
)
def actor_info_json(t):
    info = objects_per_supplier(t)
    return t.supplier.join(info, C("s_suppkey") == C("l_suppkey"), "left").select(
        "s_suppkey", "s_name", "film_info"
    )


# --------------------------------------------------------------------- employee views


@query(
    "view_dept_emp_latest",
    "SELECT emp_no, MAX(from_date) AS from_date, MAX(to_date) AS to_date"
    f" FROM ({X.HISTORY_SQL}) GROUP BY emp_no",
)
def dept_emp_latest(t):
    return L.latest_dates(X.history(t))


@query("view_current_dept_emp", X.CURRENT_DEPT_SQL)
def current_dept_emp(t):
    return L.current_department(X.history(t))


@query(
    "view_full_employees",
    f"SELECT e.emp_no, emp_name, dept_name AS department FROM ({X.EMPLOYEES_SQL}) e"
    f" LEFT JOIN ({X.LATEST_DEPT_SQL}) l ON e.emp_no = l.emp_no"
    f" LEFT JOIN ({X.DEPARTMENTS_SQL}) d ON l.dept_no = d.dept_no",
)
def full_employees(t):
    return (
        X.employees(t)
        .join(L.latest_department(X.history(t)), "emp_no", "left")
        .join(X.departments(t), "dept_no", "left")
        .select("emp_no", "emp_name", C("dept_name").alias("department"))
    )


@query(
    "view_full_departments",
    f"SELECT d.dept_no, dept_name, manager FROM ({X.DEPARTMENTS_SQL}) d"
    f" LEFT JOIN ({X.CURRENT_MANAGER_SQL}) m ON d.dept_no = m.dept_no",
)
def full_departments(t):
    managers = L.current_manager(X.managers(t), X.employees(t))
    return X.departments(t).join(managers, "dept_no", "left").select(
        "dept_no", "dept_name", "manager"
    )


@query(
    "view_emp_details",
    "SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority, c_name, c_mktsegment,"
    " c_nationkey, n_name, n_regionkey, r_name, shipped, lines FROM orders"
    " JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"
    " JOIN region ON n_regionkey = r_regionkey JOIN (SELECT l_orderkey, CAST(MAX(l_shipdate)"
    " AS DATE) AS shipped, COUNT(*) AS lines FROM lineitem GROUP BY l_orderkey)"
    " ON o_orderkey = l_orderkey",
)
def emp_details(t):
    lines = t.lineitem.groupBy("l_orderkey").agg(
        F.max("l_shipdate").cast("date").alias("shipped"), row_count().alias("lines")
    )
    return (
        t.orders.join(lines, C("o_orderkey") == C("l_orderkey"))
        .join(t.customer, C("o_custkey") == C("c_custkey"))
        .join(t.nation, C("c_nationkey") == C("n_nationkey"))
        .join(t.region, C("n_regionkey") == C("r_regionkey"))
        .select(
            "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "c_name",
            "c_mktsegment", "c_nationkey", "n_name", "n_regionkey", "r_name", "shipped", "lines",
        )
    )


# ------------------------------------------------------------------------ order views


ITEM_ORDER = ["l_linenumber", "l_partkey"]
ITEMS_SQL = truncated_sql(
    "lineitem JOIN part ON l_partkey = p_partkey",
    "l_orderkey",
    "p_name",
    ", ".join(ITEM_ORDER),
    60,
    "items",
)


@query(
    "view_customer_order_products",
    f"SELECT o_orderkey, o_orderstatus, c_custkey, c_name, order_total, items FROM orders"
    f" JOIN (SELECT l_orderkey AS k, CAST(SUM({LINE_TOTAL}) AS DECIMAL(28,2)) AS order_total"
    f" FROM lineitem GROUP BY l_orderkey) ON o_orderkey = k JOIN ({ITEMS_SQL}) i"
    " ON o_orderkey = i.l_orderkey JOIN customer ON o_custkey = c_custkey",
)
def customer_order_products(t):
    """Order totals need the lines alone; the lists need their order and the part's name."""
    named = t.lineitem.select("l_orderkey", *ITEM_ORDER).join(
        t.part.select("p_partkey", "p_name"), C("l_partkey") == C("p_partkey")
    )
    items = truncated_list(named, ["l_orderkey"], "p_name", ITEM_ORDER, limit=60)
    totals = t.lineitem.groupBy(C("l_orderkey").alias("of_order")).agg(
        line_total_sum().alias("order_total")
    )
    return (
        items.join(t.orders, C("o_orderkey") == C("l_orderkey"))
        .join(totals, C("o_orderkey") == C("of_order"))
        .join(t.customer, C("o_custkey") == C("c_custkey"))
        .select("o_orderkey", "o_orderstatus", "c_custkey", "c_name", "order_total", "items")
    )


@query(
    "view_store_orders",
    "SELECT CASE GROUPING(r_name) * 2 + GROUPING(o_orderstatus) WHEN 1 THEN 'STORE TOTAL'"
    " WHEN 2 THEN 'STATUS TOTAL' WHEN 3 THEN 'GRAND TOTAL' END AS total, r_name AS store_name,"
    " address, o_orderstatus AS order_status, COUNT(DISTINCT o_orderkey) AS order_count,"
    f" CAST(SUM({LINE_TOTAL}) AS DECIMAL(28,2)) AS total_sales FROM (SELECT *,"
    " coalesce(nullif(r_name, 'ASIA'), 'region ' || r_regionkey) AS address FROM orders"
    " JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"
    " JOIN region ON n_regionkey = r_regionkey JOIN lineitem ON l_orderkey = o_orderkey)"
    " GROUP BY GROUPING SETS ((r_name, address), (r_name, address, o_orderstatus),"
    " (o_orderstatus), ())",
)
def store_orders(t):
    """An order has one store and one status, so distinct orders of a coarser set are the sum
    over its finest groups: the sets expand a few groups instead of every line four times."""
    per_order = t.lineitem.groupBy("l_orderkey").agg(line_total_sum().alias("sales"))
    finest = (
        t.orders.join(per_order, C("o_orderkey") == C("l_orderkey"))
        .groupBy("o_custkey", "o_orderstatus")
        .agg(row_count().alias("orders"), F.sum("sales").alias("sales"))
        .join(t.customer, C("o_custkey") == C("c_custkey"))
        .join(t.nation, C("c_nationkey") == C("n_nationkey"))
        .join(t.region, C("n_regionkey") == C("r_regionkey"))
        .withColumn(
            "address",
            F.coalesce(
                F.nullif("r_name", F.lit("ASIA")),
                F.concat(F.lit("region "), C("r_regionkey").cast("string")),
            ),
        )
        .groupBy("r_name", "address", "o_orderstatus")
        .agg(F.sum("orders").alias("orders"), F.sum("sales").alias("sales"))
    )
    return t.spark.sql(
        "SELECT CASE grouping(r_name) * 2 + grouping(o_orderstatus) WHEN 1 THEN 'STORE TOTAL'"
        " WHEN 2 THEN 'STATUS TOTAL' WHEN 3 THEN 'GRAND TOTAL' END AS total, r_name AS store_name, address,"
        " o_orderstatus AS order_status, sum(orders) AS order_count,"
        " cast(sum(sales) AS decimal(28,2)) AS total_sales FROM {g} GROUP BY GROUPING SETS"
        " ((r_name, address), (r_name, address, o_orderstatus), (o_orderstatus), ())",
        g=finest,
    )


# A part's document lists one review per remainder below p_size % 4; some parts have none.
def product_documents(t):
    reviews = F.transform(
        F.sequence(F.lit(1), C("p_size") % 4),
        lambda i: F.struct(
            (i + C("p_size") % 3).cast("int").alias("rating"),
            F.concat_ws(" ", "p_type", i.cast("string")).alias("review"),
        ),
    )
    none = F.array().cast("array<struct<rating:int,review:string>>")
    listed = F.when(C("p_size") % 4 == 0, none).otherwise(reviews)
    document = F.to_json(F.struct(listed.alias("reviews")))
    return t.part.select(
        "p_partkey",
        "p_brand",
        F.when(C("p_size") != 13, document).alias("details"),
    )


@query(
    "view_product_reviews",
    "SELECT p_brand, p_partkey, rating, ROUND(AVG(rating) OVER (PARTITION BY p_brand), 2)"
    " AS avg_rating, review FROM (SELECT p_brand, p_partkey, CASE WHEN p_size % 4 > 0 THEN"
    " CAST(i + p_size % 3 AS INTEGER) END AS rating, CASE WHEN p_size % 4 > 0 THEN"
    " p_type || ' ' || i END AS review FROM part, LATERAL (SELECT unnest(range(1,"
    " greatest(p_size % 4, 1) + 1)) AS i) r WHERE p_size <> 13)",
)
def product_reviews(t):
    """One row per review with the mean of its product line; a product without reviews keeps
    one empty row, a product without a document gives none."""
    schema = "reviews array<struct<rating:int,review:string>>"
    opened = (
        product_documents(t)
        .filter("details IS NOT NULL")
        .withColumn("r", F.explode_outer(F.from_json("details", schema)["reviews"]))
        .select("p_brand", "p_partkey", "r.rating", "r.review")
    )
    return with_group_values(
        opened, ["p_brand"], F.round(F.avg("rating"), 2).alias("avg_rating")
    )


@query(
    "view_product_orders",
    f"SELECT p_name, o_orderstatus, CAST(SUM({LINE_TOTAL}) AS DECIMAL(28,2)) AS total_sales,"
    " COUNT(*) AS order_count FROM lineitem JOIN orders ON l_orderkey = o_orderkey"
    " JOIN part ON l_partkey = p_partkey GROUP BY p_name, o_orderstatus",
)
def product_orders(t):
    """Lines are summed per (part, status) before they meet the part table."""
    lines = t.lineitem.join(
        t.orders.select("o_orderkey", "o_orderstatus"), C("l_orderkey") == C("o_orderkey")
    )
    per_part = lines.groupBy("l_partkey", "o_orderstatus").agg(
        line_total_sum().alias("s"), row_count().alias("n")
    )
    return (
        per_part.join(t.part, C("l_partkey") == C("p_partkey"))
        .groupBy("p_name", "o_orderstatus")
        .agg(
            F.sum("s").cast("decimal(28,2)").alias("total_sales"),
            F.sum("n").alias("order_count"),
        )
    )


@query(
    "view_profits",
    "SELECT l_orderkey, l_linenumber, l_partkey, unit_cost, CAST(unit_cost * CAST(l_quantity"
    " AS INTEGER) AS DECIMAL(28,2)) AS total_cost FROM lineitem JOIN (SELECT l_partkey AS p,"
    f" l_suppkey AS s, l_shipdate AS d, l_returnflag AS f, MIN({PRICE}) AS unit_cost FROM lineitem"
    " GROUP BY ALL) ON l_partkey = p AND l_suppkey = s"
    " AND l_shipdate = d AND l_returnflag = f",
)
def profits(t):
    """Sales without a cost drop out."""
    keys = ["l_partkey", "l_suppkey", "l_shipdate", "l_returnflag"]
    costs = (
        t.lineitem.groupBy(*keys)
        .agg(money(F.min("l_extendedprice")).alias("unit_cost"))
    )
    total = C("unit_cost") * C("l_quantity").cast("int")
    return t.lineitem.join(costs, keys).select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "unit_cost",
        total.cast("decimal(28,2)").alias("total_cost"),
    )


# ------------------------------------------------------------------- stored summaries


def month_sales(t):
    """Lines are summed by the first day of their month; only the months are written as text."""
    months = t.lineitem.groupBy(F.trunc("l_shipdate", "MM").alias("month")).agg(
        money_sum("l_extendedprice").alias("dollars")
    )
    return months.select(
        F.date_format("month", "yyyy-MM").alias("calendar_month_desc"), "dollars"
    )


@query(
    "mv_cal_month_sales",
    f"SELECT strftime(l_shipdate, '%Y-%m') AS calendar_month_desc, CAST(SUM({PRICE})"
    " AS DECIMAL(28,2)) AS dollars FROM lineitem GROUP BY 1",
)
def cal_month_sales(t):
    path = work_folder(t.spark, "cal_month_sales")
    sales = month_sales(t)
    refresh_summary(sales, path)
    return read_summary(t.spark, path, sales.schema)


@query(
    "mv_fweek_subcat_sales",
    "SELECT CAST(l_shipdate AS DATE) + CAST((7 - isodow(l_shipdate)) AS INTEGER)"
    " AS week_ending_day, p_type AS subcategory, l_returnflag AS channel, l_linestatus AS promo,"
    f" CAST(SUM({PRICE}) AS DECIMAL(28,2)) AS dollars, CAST(SUM(CAST(l_quantity AS BIGINT))"
    " AS BIGINT) AS quantity FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3, 4",
)
def fweek_subcat_sales(t):
    week = F.next_day(F.date_sub("l_shipdate", 1), "SUN").alias("week_ending_day")
    sales = (
        t.lineitem.join(t.part, C("l_partkey") == C("p_partkey"))
        .groupBy(
            week,
            C("p_type").alias("subcategory"),
            C("l_returnflag").alias("channel"),
            C("l_linestatus").alias("promo"),
        )
        .agg(
            money_sum("l_extendedprice").alias("dollars"),
            F.sum(C("l_quantity").cast("bigint")).alias("quantity"),
        )
    )
    path = work_folder(t.spark, "fweek_subcat_sales")
    refresh_summary(sales, path)
    return read_summary(t.spark, path, sales.schema)


@query(
    "mv_rewrite",
    f"SELECT strftime(l_shipdate, '%Y') AS calendar_year, CAST(SUM({PRICE}) AS DECIMAL(28,2))"
    " AS dollars FROM lineitem GROUP BY 1",
)
def rewrite_from_summary(t):
    """Sales per year answered from the stored month summary, not from the lines."""
    path = work_folder(t.spark, "month_summary")
    sales = month_sales(t)
    refresh_summary(sales, path)
    stored = read_summary(t.spark, path, sales.schema)
    year = F.substring("calendar_month_desc", 1, 4)
    return rollup_from(stored, {"calendar_year": year}, ["dollars"]).withColumn(
        "dollars", C("dollars").cast("decimal(28,2)")
    )


# ------------------------------------------------------------------------- dimensions

FISCAL = 3  # the fiscal year of the sample starts three months early
_F = f"(date_trunc('month', d) + INTERVAL {FISCAL} MONTH)"
_QS = "date_trunc('quarter', d)"
_YS = "date_trunc('year', d)"
_Q = "(date_trunc('quarter', d) + INTERVAL 3 MONTH - INTERVAL 1 DAY)"
_Y = "(date_trunc('year', d) + INTERVAL 1 YEAR - INTERVAL 1 DAY)"
_FQS = f"(date_trunc('quarter', {_F}) - INTERVAL {FISCAL} MONTH)"
_FQE = f"(date_trunc('quarter', {_F}) + INTERVAL 3 MONTH - INTERVAL {FISCAL} MONTH - INTERVAL 1 DAY)"
_FYS = f"(date_trunc('year', {_F}) - INTERVAL {FISCAL} MONTH)"
_FYE = f"(date_trunc('year', {_F}) + INTERVAL 12 MONTH - INTERVAL {FISCAL} MONTH - INTERVAL 1 DAY)"


def _days(a: str, b: str) -> str:
    return f"CAST(date_diff('day', {a}, {b}) + 1 AS INTEGER)"


@query(
    "dim_time",
    "SELECT CAST(d AS DATE) AS time_id, dayname(d) AS day_name,"
    " CAST(isodow(d) AS INTEGER) AS day_number_in_week, CAST(day(d) AS INTEGER) AS"
    " day_number_in_month, CAST(weekofyear(d) AS INTEGER) AS calendar_week_number,"
    f" CAST(date_diff('day', {_FYS}, d) // 7 + 1 AS INTEGER) AS fiscal_week_number,"
    " CAST(w AS DATE) AS week_ending_day, CAST(strftime(w, '%Y%m%d') AS INTEGER) AS"
    " week_ending_day_id, CAST(month(d) AS INTEGER) AS calendar_month_number,"
    f" CAST(month({_F}) AS INTEGER) AS fiscal_month_number, strftime(d, '%Y-%m') AS"
    " calendar_month_desc, CAST(strftime(d, '%Y%m') AS INTEGER) AS calendar_month_id,"
    f" strftime({_F}, '%Y-%m') AS fiscal_month_desc, CAST(strftime({_F}, '%Y%m') AS INTEGER) AS"
    " fiscal_month_id, CAST(day(last_day(d)) AS INTEGER) AS days_in_cal_month,"
    " CAST(day(last_day(d)) AS INTEGER) AS days_in_fis_month, last_day(d) AS end_of_cal_month,"
    " last_day(d) AS end_of_fis_month, monthname(d) AS calendar_month_name, monthname(d) AS"
    " fiscal_month_name, year(d) || '-Q' || quarter(d) AS calendar_quarter_desc,"
    " CAST(year(d) * 10 + quarter(d) AS INTEGER) AS calendar_quarter_id,"
    f" year({_F}) || '-Q' || quarter({_F}) AS fiscal_quarter_desc,"
    f" CAST(year({_F}) * 10 + quarter({_F}) AS INTEGER) AS fiscal_quarter_id,"
    f" {_days(_QS, _Q)} AS"
    f" days_in_cal_quarter, {_days(_FQS, _FQE)} AS days_in_fis_quarter,"
    f" CAST({_Q} AS DATE) AS end_of_cal_quarter, CAST({_FQE} AS DATE) AS end_of_fis_quarter,"
    f" CAST(quarter(d) AS INTEGER) AS calendar_quarter_number, CAST(quarter({_F}) AS INTEGER) AS"
    " fiscal_quarter_number, CAST(year(d) AS INTEGER) AS calendar_year, CAST(year(d) AS INTEGER)"
    f" AS calendar_year_id, CAST(year({_F}) AS INTEGER) AS fiscal_year, CAST(year({_F}) AS"
    " INTEGER) AS fiscal_year_id,"
    f" {_days(_YS, _Y)} AS days_in_cal_year,"
    f" {_days(_FYS, _FYE)} AS days_in_fis_year, CAST({_Y} AS DATE) AS end_of_cal_year,"
    f" CAST({_FYE} AS DATE) AS end_of_fis_year FROM (SELECT d, d + to_days(CAST(7 - isodow(d) AS"
    " INTEGER)) AS w FROM (SELECT unnest(generate_series(MIN(l_shipdate)::TIMESTAMP,"
    " MAX(l_shipdate)::TIMESTAMP, INTERVAL 1 DAY)) AS d FROM lineitem))",
)
def dim_time(t):
    return time_dimension(days_between(t.lineitem, "l_shipdate"), "day", FISCAL)


def rollup_sql(levels: str, source: str, value: str, exprs: str | None = None) -> str:
    names = [n.strip() for n in levels.split(",")]
    depth = f"{len(names)} - " + " - ".join(f"GROUPING({n})" for n in names)
    return (
        f"SELECT {levels}, CAST({depth} AS INTEGER) AS level, CAST(SUM({value}) AS DECIMAL(28,2))"
        f" AS total FROM (SELECT *{', ' + exprs if exprs else ''} FROM {source})"
        f" GROUP BY ROLLUP ({levels})"
    )


def rolled(df, levels, total=None):
    total = F.sum("v") if total is None else total
    return rollup_along(df, levels, {"total": total}).withColumn(
        "total", C("total").cast("decimal(28,2)")
    )


@query(
    "dim_customer_rollup",
    rollup_sql(
        "r_name, n_name, c_custkey",
        "orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"
        " JOIN region ON n_regionkey = r_regionkey",
        "CAST(o_totalprice AS DECIMAL(18,2))",
    ),
)
def customer_rollup(t):
    per = t.orders.groupBy("o_custkey").agg(money_sum("o_totalprice").alias("v"))
    facts = (
        per.join(t.customer, C("o_custkey") == C("c_custkey"))
        .join(t.nation, C("c_nationkey") == C("n_nationkey"))
        .join(t.region, C("n_regionkey") == C("r_regionkey"))
    )
    return rolled(facts, ["r_name", "n_name", "c_custkey"])


@query(
    "dim_product_rollup",
    rollup_sql(
        "p_brand, p_type, p_partkey", "lineitem JOIN part ON l_partkey = p_partkey", PRICE
    ),
)
def product_rollup(t):
    per = t.lineitem.groupBy("l_partkey").agg(money_sum("l_extendedprice").alias("v"))
    facts = per.join(t.part, C("l_partkey") == C("p_partkey"))
    return rolled(facts, ["p_brand", "p_type", "p_partkey"])


CALENDAR_SQL = (
    "CAST(year(l_shipdate) AS INTEGER) AS y, CAST(quarter(l_shipdate) AS INTEGER) AS q,"
    " CAST(month(l_shipdate) AS INTEGER) AS m, CAST(l_shipdate AS DATE) AS d"
)
SHIFTED = f"(date_trunc('month', l_shipdate) + INTERVAL {FISCAL} MONTH)"
FISCAL_SQL = (
    f"CAST(year({SHIFTED}) AS INTEGER) AS y, CAST(quarter({SHIFTED}) AS INTEGER) AS q,"
    f" CAST(month({SHIFTED}) AS INTEGER) AS m,"
    " CAST(l_shipdate AS DATE) + CAST((7 - isodow(l_shipdate)) AS INTEGER) AS w,"
    " CAST(l_shipdate AS DATE) AS d"
)


@query(
    "dim_time_rollup",
    "SELECT 'calendar' AS hierarchy, y, q, m, CAST(NULL AS DATE) AS w, d, level, total FROM ("
    + rollup_sql("y, q, m, d", "lineitem", PRICE, CALENDAR_SQL)
    + ") UNION ALL SELECT 'fiscal', y, q, m, w, d, level, total FROM ("
    + rollup_sql("y, q, m, w, d", "lineitem", PRICE, FISCAL_SQL)
    + ")",
)
def time_rollup(t):
    """Totals along both calendars, from one pass that sums the facts per day."""
    days = materialise(
        t.lineitem.groupBy(F.to_date("l_shipdate").alias("d")).agg(
            money_sum("l_extendedprice").alias("v")
        ),
        "days",
    )
    shifted = F.add_months(F.trunc("d", "MM"), FISCAL)
    parts = {}
    for name, day, levels in (
        ("calendar", C("d"), ["y", "q", "m", "d"]),
        ("fiscal", shifted, ["y", "q", "m", "w", "d"]),
    ):
        facts = days.select(
            F.year(day).alias("y"), F.quarter(day).alias("q"), F.month(day).alias("m"),
            F.next_day(F.date_sub("d", 1), "SUN").alias("w"), "d", "v",
        )
        parts[name] = rolled(facts, levels).withColumn("hierarchy", F.lit(name))
    return parts["fiscal"].unionByName(parts["calendar"], allowMissingColumns=True)


@query(
    "dim_channel_rollup",
    rollup_sql(
        "o_orderstatus, o_orderpriority", "orders", "CAST(o_totalprice AS DECIMAL(18,2))"
    ),
)
def channel_rollup(t):
    return rolled(t.orders, ["o_orderstatus", "o_orderpriority"], money_sum("o_totalprice"))


@query(
    "dim_promo_rollup",
    rollup_sql("l_returnflag, l_linestatus, l_linenumber", "lineitem", PRICE),
)
def promo_rollup(t):
    levels = ["l_returnflag", "l_linestatus", "l_linenumber"]
    return rolled(t.lineitem, levels, money_sum("l_extendedprice"))


@query(
    "dim_determines",
    "SELECT p_name, COUNT(*) AS combinations FROM (SELECT DISTINCT p_name, p_brand, p_type"
    " FROM part) GROUP BY p_name HAVING COUNT(*) > 1",
)
def dim_determines(t):
    return determines(t.part, "p_name", ["p_brand", "p_type"])
