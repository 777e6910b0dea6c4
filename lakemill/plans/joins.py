"""Joins of every shape the source queries use."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lakemill.operators.hierarchy import resolve_roots
from lakemill.operators.joins import having, keep_all, lacking
from lakemill.operators.periods import join_periods
from lakemill.operators.relational import money, money_sum, with_group_values
from lakemill.plans.registry import query

C = F.col


@query(
    "join_inner",
    "SELECT o_orderkey, o_custkey, c_name, o_totalprice FROM orders"
    " JOIN customer ON o_custkey = c_custkey",
)
def join_inner(t):
    return t.orders.join(t.customer, C("o_custkey") == C("c_custkey")).select(
        "o_orderkey", "o_custkey", "c_name", "o_totalprice"
    )


@query(
    "join_inner_multi",
    "SELECT r_name, n_name, CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DECIMAL(28,2))"
    " AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey"
    " JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"
    " JOIN region ON n_regionkey = r_regionkey GROUP BY r_name, n_name",
)
def join_inner_multi(t):
    """Lines are summed per order and then per customer before each join, so the joins
    move one row per key and a heavy customer is one row too."""
    per_order = t.lineitem.groupBy("l_orderkey").agg(money_sum("l_extendedprice").alias("s"))
    per_customer = (
        per_order.join(t.orders, C("l_orderkey") == C("o_orderkey"))
        .groupBy("o_custkey")
        .agg(F.sum("s").alias("s"))
    )
    return (
        per_customer.join(t.customer, C("o_custkey") == C("c_custkey"))
        .join(t.nation, C("c_nationkey") == C("n_nationkey"))
        .join(t.region, C("n_regionkey") == C("r_regionkey"))
        .groupBy("r_name", "n_name")
        .agg(F.sum("s").cast("decimal(28,2)").alias("revenue"))
    )


@query(
    "join_comma",
    "SELECT s_suppkey, s_name, n_name, r_name FROM supplier, nation, region"
    " WHERE s_nationkey = n_nationkey AND n_regionkey = r_regionkey",
)
def join_comma(t):
    """Catalyst turns the filtered comma list into equi joins; no cross product is planned."""
    return t.spark.sql(
        "SELECT s_suppkey, s_name, n_name, r_name FROM {s} s, {n} n, {r} r"
        " WHERE s_nationkey = n_nationkey AND n_regionkey = r_regionkey",
        s=t.supplier,
        n=t.nation,
        r=t.region,
    )


@query(
    "join_using",
    "SELECT doc_id, lang, quality, toxic FROM documents JOIN labels USING (doc_id)",
)
def join_using(t):
    return t.documents.select("doc_id", "lang").join(t.labels, "doc_id").select(
        "doc_id", "lang", "quality", "toxic"
    )


@query(
    "join_composite_key",
    "SELECT l_orderkey, l_linenumber, l_partkey, unit_cost FROM lineitem JOIN ("
    " SELECT l_partkey AS p, l_suppkey AS s, l_shipdate AS d, l_returnflag AS f,"
    " MIN(CAST(l_extendedprice AS DECIMAL(18,2))) AS unit_cost FROM lineitem"
    " GROUP BY ALL) ON l_partkey = p AND l_suppkey = s"
    " AND l_shipdate = d AND l_returnflag = f",
)
def join_composite_key(t):
    keys = ["l_partkey", "l_suppkey", "l_shipdate", "l_returnflag"]
    costs = (
        t.lineitem.groupBy(*keys)
        .agg(money(F.min("l_extendedprice")).alias("unit_cost"))
    )
    return t.lineitem.join(costs, keys).select(
        "l_orderkey", "l_linenumber", "l_partkey", "unit_cost"
    )


@query(
    "join_left",
    "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders"
    " ON c_custkey = o_custkey",
)
def join_left(t):
    orders = t.orders.select("o_custkey", "o_orderkey")
    return keep_all(t.customer.select("c_custkey"), orders, ["c_custkey"], ["o_custkey"]).select(
        "c_custkey", "o_orderkey"
    )


@query(
    "join_left_chain",
    "SELECT p_partkey, l_orderkey, o_custkey, c_nationkey, n_name FROM part"
    " LEFT JOIN lineitem ON p_partkey = l_partkey"
    " LEFT JOIN orders ON l_orderkey = o_orderkey"
    " LEFT JOIN customer ON o_custkey = c_custkey"
    " LEFT JOIN nation ON c_nationkey = n_nationkey",
)
def join_left_chain(t):
    return (
        keep_all(t.part, t.lineitem, ["p_partkey"], ["l_partkey"])
        .join(t.orders, C("l_orderkey") == C("o_orderkey"), "left")
        .join(t.customer, C("o_custkey") == C("c_custkey"), "left")
        .join(t.nation, C("c_nationkey") == C("n_nationkey"), "left")
        .select("p_partkey", "l_orderkey", "o_custkey", "c_nationkey", "n_name")
    )


@query(
    "join_right",
    "SELECT p_partkey, l_orderkey FROM lineitem"
    " RIGHT JOIN part ON l_partkey = p_partkey",
)
def join_right(t):
    return keep_all(t.part, t.lineitem, ["p_partkey"], ["l_partkey"]).select(
        "p_partkey", "l_orderkey"
    )


@query(
    "join_right_chain",
    "SELECT s_suppkey, o_orderkey, c_custkey FROM supplier LEFT JOIN orders"
    " ON s_suppkey = o_orderkey % 500"
    " RIGHT JOIN customer ON o_custkey = c_custkey",
)
def join_right_chain(t):
    """Left join, then right join: the order decides which unmatched rows survive."""
    stays = t.orders.withColumn("room", C("o_orderkey") % 500)
    rooms = keep_all(t.supplier, stays, ["s_suppkey"], ["room"])
    return keep_all(t.customer, rooms, ["c_custkey"], ["o_custkey"]).select(
        "s_suppkey", "o_orderkey", "c_custkey"
    )


@query(
    "join_theta",
    "SELECT l_orderkey, l_linenumber, p_partkey, p_size FROM lineitem JOIN part"
    " ON l_partkey = p_partkey AND (p_size > 45 OR l_quantity > 48)",
)
def join_theta(t):
    return t.lineitem.join(
        t.part,
        (C("l_partkey") == C("p_partkey")) & ((C("p_size") > 45) | (C("l_quantity") > 48)),
    ).select("l_orderkey", "l_linenumber", "p_partkey", "p_size")


@query(
    "join_self",
    "SELECT a.c_custkey, a.c_nationkey, COUNT(*) AS partners, MIN(b.c_custkey) AS first_partner,"
    " MAX(b.c_custkey) AS last_partner FROM customer a JOIN customer b"
    " ON a.c_nationkey = b.c_nationkey GROUP BY a.c_custkey, a.c_nationkey",
)
def join_self(t):
    """Every row with its partners on a shared attribute, the row itself included.

    The partners of a row are its group, so each row carries the group's size and range:
    listing all pairs would square the largest group.
    """
    return with_group_values(
        t.customer.select("c_custkey", "c_nationkey").filter(C("c_nationkey").isNotNull()),
        ["c_nationkey"],
        F.count(F.lit(1)).alias("partners"),
        F.min("c_custkey").alias("first_partner"),
        F.max("c_custkey").alias("last_partner"),
    )


@query(
    "join_name_match",
    "SELECT s_suppkey, c_custkey, c_nationkey FROM supplier JOIN customer"
    " ON split_part(s_name, '#', 2) = split_part(c_name, '#', 2)",
)
def join_name_match(t):
    return t.supplier.join(
        t.customer, F.split_part("s_name", F.lit("#"), F.lit(2))
        == F.split_part("c_name", F.lit("#"), F.lit(2))
    ).select("s_suppkey", "c_custkey", "c_nationkey")


@query(
    "join_cross_scalar",
    "WITH m AS (SELECT AVG(CAST(o_totalprice AS DECIMAL(18,2))) AS mean FROM orders)"
    " SELECT o_orderkey, ROUND(CAST(mean AS DOUBLE), 2) AS mean_price FROM orders"
    " CROSS JOIN m WHERE o_totalprice > mean",
)
def join_cross_scalar(t):
    """The one-row side is a scalar subquery: one number shipped with the plan."""
    mean = t.orders.agg(money_sum("o_totalprice").cast("double") / F.count("o_totalprice")).scalar()
    return t.orders.filter(C("o_totalprice") > mean).select(
        "o_orderkey", F.round(mean, 2).alias("mean_price")
    )


@query(
    "join_semi_in",
    "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN"
    " (SELECT o_custkey FROM orders WHERE o_totalprice > 450000)",
)
def join_semi_in(t):
    rich = t.orders.filter("o_totalprice > 450000")
    return having(t.customer, rich, ["c_custkey"], ["o_custkey"]).select("c_custkey", "c_name")


@query(
    "join_semi_ordered_sub",
    "SELECT c_custkey, c_name FROM customer WHERE c_custkey IS NOT NULL"
    " AND EXISTS (SELECT 1 FROM part)",
)
def join_semi_ordered_sub(t):
    """The subquery names a column of the outer row, so it only asks whether rows exist."""
    return t.customer.filter(C("c_custkey").isNotNull() & t.part.exists()).select(
        "c_custkey", "c_name"
    )


@query(
    "join_anti_null",
    "SELECT d.doc_id, lang FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"
    " WHERE l.doc_id IS NULL",
)
def join_anti_null(t):
    known = t.labels.select(C("doc_id").alias("known_id"))
    return lacking(t.documents.select("doc_id", "lang"), known, ["doc_id"], ["known_id"])


@query(
    "join_anti_orphan",
    "SELECT l_orderkey, l_linenumber FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders"
    " WHERE o_orderkey = l_orderkey AND o_orderkey % 7 <> 3)",
)
def join_anti_orphan(t):
    """Every seventh order is taken out of the parents, so that lines are orphaned."""
    parents = t.orders.filter("o_orderkey % 7 <> 3")
    return lacking(t.lineitem, parents, ["l_orderkey"], ["o_orderkey"]).select(
        "l_orderkey", "l_linenumber"
    )


@query(
    "join_scalar_subquery",
    "SELECT s_suppkey, CAST(11 * (SELECT MAX(CAST(p_retailprice AS DECIMAL(18,2))) FROM part)"
    " AS DECIMAL(28,2)) AS total_cost FROM supplier",
)
def join_scalar_subquery(t):
    price = t.part.agg(money(F.max("p_retailprice"))).scalar()
    return t.supplier.select(
        "s_suppkey", (F.lit(11) * price).cast("decimal(28,2)").alias("total_cost")
    )


@query(
    "join_correlated_scalar",
    "SELECT c_custkey, (SELECT CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(28,2))"
    " FROM orders WHERE o_custkey = c_custkey) AS pending FROM customer",
)
def join_correlated_scalar(t):
    """Aggregate once per key and join, instead of one lookup per row."""
    pending = t.orders.groupBy("o_custkey").agg(money_sum("o_totalprice").alias("pending"))
    return t.customer.join(pending, C("c_custkey") == C("o_custkey"), "left").select(
        "c_custkey", "pending"
    )


@query(
    "join_on_derived_max",
    "SELECT o_orderkey, o_custkey, o_orderdate FROM orders JOIN (SELECT o_custkey AS k,"
    " MAX(o_orderdate) AS last_date FROM orders GROUP BY o_custkey)"
    " ON o_custkey = k AND o_orderdate = last_date",
)
def join_on_derived_max(t):
    last = t.orders.groupBy("o_custkey").agg(F.max("o_orderdate").alias("o_orderdate"))
    return t.orders.join(last, ["o_custkey", "o_orderdate"]).select(
        "o_orderkey", "o_custkey", "o_orderdate"
    )


@query(
    "join_lateral_json",
    "SELECT event_id, k.key AS name, CAST(json_extract_string(props, '$.' || k.key) AS INTEGER)"
    " AS value FROM events, LATERAL (SELECT unnest(json_keys(props)) AS key) k",
)
def join_lateral_json(t):
    pairs = F.from_json("props", "map<string,int>")
    return t.events.select("event_id", F.explode_outer(pairs).alias("name", "value"))


@query(
    "join_interval",
    "SELECT o_orderkey, q.from_date AS from_date, q.to_date AS to_date FROM orders JOIN ("
    " SELECT CAST(d AS DATE) AS from_date, CAST(d + INTERVAL 3 MONTH AS DATE) AS to_date FROM"
    " generate_series((SELECT date_trunc('month', MIN(o_orderdate)) FROM orders)::TIMESTAMP,"
    " (SELECT MAX(o_orderdate) FROM orders)::TIMESTAMP, INTERVAL 3 MONTH) g(d)) q"
    " ON CAST(o_orderdate AS DATE) >= q.from_date AND CAST(o_orderdate AS DATE) < q.to_date",
)
def join_interval(t):
    """Each order with the three-month period it falls into."""
    bounds = t.orders.agg(
        F.trunc(F.min("o_orderdate").cast("date"), "MM").alias("first"),
        F.max("o_orderdate").cast("date").alias("last"),
    )
    starts = F.explode(F.sequence("first", "last", F.expr("interval 3 month")))
    periods = bounds.select(starts.alias("from_date")).withColumn(
        "to_date", F.add_months("from_date", 3)
    )
    return join_periods(
        t.orders.select("o_orderkey", "o_orderdate"), F.to_date("o_orderdate"), periods
    ).select("o_orderkey", "from_date", "to_date")


@query(
    "join_interval_keyed",
    "WITH p AS (SELECT o_custkey, d AS from_date, lead(d) OVER (PARTITION BY o_custkey ORDER BY d)"
    " AS to_date FROM (SELECT DISTINCT o_custkey, CAST(o_orderdate AS DATE) AS d FROM orders))"
    " SELECT l_orderkey, l_linenumber, l_partkey, o.o_custkey, from_date FROM lineitem JOIN orders o"
    " ON l_orderkey = o_orderkey JOIN p ON p.o_custkey = o.o_custkey AND CAST(l_shipdate AS DATE)"
    " >= from_date AND (to_date IS NULL OR CAST(l_shipdate AS DATE) < to_date)",
)
def join_interval_keyed(t):
    """Each line with the period between two order days of its customer in which it was shipped;
    the last period is open."""
    days = t.orders.select("o_custkey", F.to_date("o_orderdate").alias("from_date")).distinct()
    after = F.lead("from_date").over(Window.partitionBy("o_custkey").orderBy("from_date"))
    periods = days.withColumn("to_date", after).withColumnRenamed("o_custkey", "holder")
    lines = t.lineitem.join(t.orders, C("l_orderkey") == C("o_orderkey")).select(
        "l_orderkey", "l_linenumber", "l_partkey", "o_custkey", "l_shipdate"
    )
    held = join_periods(lines, F.to_date("l_shipdate"), periods, keys={"o_custkey": "holder"})
    return held.select("l_orderkey", "l_linenumber", "l_partkey", "o_custkey", "from_date")


@query(
    "join_recursive",
    "WITH RECURSIVE up(node, ptr, depth) AS (SELECT c_custkey, c_custkey, 0 FROM customer"
    " UNION ALL SELECT node, ptr // 10, depth + 1 FROM up WHERE ptr >= 10)"
    " SELECT node, MIN(ptr) AS root, MAX(depth) AS depth FROM up GROUP BY node",
)
def join_recursive(t):
    """Customers report to the customer whose key is a tenth of theirs."""
    links = t.customer.select(
        "c_custkey",
        F.when(C("c_custkey") >= 10, F.floor(C("c_custkey") / 10)).alias("manager"),
    )
    return resolve_roots(links, "c_custkey", "manager")
