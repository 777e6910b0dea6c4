"""Changes to whole tables, each query returning the new state."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakemill.functions import scalars as S
from lakemill.operators import changes as H
from lakemill.operators.relational import dense_row_numbers, money, row_count
from lakemill.plans.registry import query
from lakemill.session import work_folder

C = F.col


@query(
    "dml_insert_values",
    "SELECT s_suppkey, s_name, s_nationkey FROM supplier UNION ALL SELECT -1, 'New A', 3"
    " UNION ALL SELECT -2, 'New B', NULL",
)
def insert_values(t):
    new = t.spark.createDataFrame(
        [(-1, "New A", 3), (-2, "New B", None)], "s_suppkey bigint, s_name string, s_nationkey int"
    )
    return H.insert(t.supplier.select("s_suppkey", "s_name", "s_nationkey"), new)


@query(
    "dml_insert_select",
    "SELECT c_custkey AS id, c_name AS name, c_acctbal AS cost FROM customer UNION ALL"
    " SELECT 1000000 + s_suppkey, s_name, 5 * (SELECT MAX(p_retailprice) FROM part) FROM supplier",
)
def insert_select(t):
    target = t.customer.select(
        C("c_custkey").alias("id"), C("c_name").alias("name"), C("c_acctbal").alias("cost")
    )
    price = t.part.agg(F.max("p_retailprice")).scalar()
    return H.insert(
        target,
        t.supplier.select(
            (C("s_suppkey") + 1000000).alias("id"), C("s_name").alias("name"),
            (price * 5).alias("cost"),
        ),
    )


@query(
    "dml_insert_if_missing",
    "SELECT doc_id, quality FROM labels UNION ALL SELECT doc_id, -1 FROM documents"
    " WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
)
def insert_if_missing(t):
    new = t.documents.select("doc_id", F.lit(-1).alias("quality"))
    return H.insert_if_missing(t.labels.select("doc_id", "quality"), new, ["doc_id"])


@query(
    "dml_insert_next_id",
    "SELECT c_custkey, c_name FROM customer UNION ALL SELECT (SELECT MAX(c_custkey) FROM customer)"
    " + row_number() OVER (), s_name FROM supplier",
)
def insert_next_id(t):
    new = dense_row_numbers(t.supplier.select(C("s_name").alias("c_name")), "pos")
    return H.insert_next_id(t.customer.select("c_custkey", "c_name"), new, "c_custkey", "pos")


@query(
    "dml_update_where",
    "SELECT c_custkey, CASE WHEN c_nationkey = 3 THEN 'MOVED' ELSE c_mktsegment END AS"
    " c_mktsegment, CASE WHEN c_nationkey = 3 THEN c_acctbal + 10 ELSE c_acctbal END AS c_acctbal"
    " FROM customer",
)
def update_where(t):
    return H.update_where(
        t.customer.select("c_custkey", "c_nationkey", "c_mktsegment", "c_acctbal"),
        C("c_nationkey") == 3,
        {"c_mktsegment": F.lit("MOVED"), "c_acctbal": C("c_acctbal") + 10},
    ).drop("c_nationkey")


@query(
    "dml_update_scalar",
    "SELECT o_orderkey, CAST(CASE WHEN o_orderpriority = '1-URGENT' THEN 11 * (SELECT"
    " MAX(CAST(p_retailprice AS DECIMAL(18,2))) FROM part WHERE p_size = 1)"
    " WHEN o_orderpriority = '5-LOW' THEN NULL ELSE CAST(o_totalprice AS DECIMAL(18,2)) END AS"
    " DECIMAL(18,2)) AS total_cost FROM orders",
)
def update_scalar(t):
    """A subquery without a row sets NULL."""
    price = t.part.filter("p_size = 1").agg(money(F.max("p_retailprice"))).scalar()
    nothing = t.part.filter("p_size < 0").agg(money(F.max("p_retailprice"))).scalar()
    rows = t.orders.select(
        "o_orderkey", "o_orderpriority", money("o_totalprice").alias("total_cost")
    )
    urgent = H.update_where(rows, C("o_orderpriority") == "1-URGENT", {"total_cost": price * 11})
    return H.update_where(urgent, C("o_orderpriority") == "5-LOW", {"total_cost": nothing}).drop(
        "o_orderpriority"
    )


@query(
    "dml_update_join",
    "SELECT 'order' AS side, o_orderkey AS id, CASE WHEN o_orderstatus = 'O' AND o_custkey IN"
    " (SELECT c_custkey FROM customer WHERE c_acctbal < 0) THEN 'HELD' ELSE o_orderpriority END"
    " AS state FROM orders UNION ALL SELECT 'customer', c_custkey, CASE WHEN c_acctbal < 0 AND"
    " c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O') THEN 'HELD' ELSE"
    " c_mktsegment END FROM customer",
)
def update_join(t):
    """Open orders of customers in debt and those customers are held; both sides must match."""
    orders, customers = H.update_pair(
        t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"),
        t.customer.select("c_custkey", "c_acctbal", "c_mktsegment"),
        "o_custkey",
        "c_custkey",
        C("o_orderstatus") == "O",
        C("c_acctbal") < 0,
        {"o_orderpriority": F.lit("HELD")},
        {"c_mktsegment": F.lit("HELD")},
    )
    left = orders.select(
        F.lit("order").alias("side"), C("o_orderkey").alias("id"), C("o_orderpriority").alias("state")
    )
    return left.unionByName(
        customers.select(
            F.lit("customer").alias("side"), C("c_custkey").alias("id"),
            C("c_mktsegment").alias("state"),
        )
    )


# A code is matched from its start; `_` stands for exactly one character.
RULES = [
    ("Customer#0000_%", 0.5),
    ("Customer#00000_1%", 1.25),
    ("%7", 3.5),
    ("Customer#_______11", 0.0),
]


@query(
    "dml_update_rules",
    "SELECT c_custkey, CAST(CASE WHEN c_acctbal <= 0 THEN 9 WHEN c_name LIKE 'Customer#_______11'"
    " THEN 0 WHEN c_name LIKE '%7' THEN 3.5 WHEN c_name LIKE 'Customer#00000_1%' THEN 1.25"
    " WHEN c_name LIKE 'Customer#0000_%' THEN 0.5 ELSE 9 END AS DOUBLE) AS factor FROM customer",
)
def update_rules(t):
    codes = t.customer.select("c_custkey", "c_name", "c_acctbal", F.lit(9.0).alias("factor"))
    return H.update_rules(codes, "factor", "c_name", RULES, C("c_acctbal") > 0).select(
        "c_custkey", "factor"
    )


@query(
    "dml_update_map",
    "SELECT c_custkey, coalesce(s_name, c_name) AS c_name FROM customer LEFT JOIN supplier"
    " ON s_suppkey = c_custkey",
)
def update_map(t):
    return H.update_map(
        t.customer.select("c_custkey", "c_name"), "c_custkey", "c_name", t.supplier, "s_suppkey", "s_name"
    )


@query(
    "dml_delete_where",
    "SELECT o_orderkey, o_orderpriority FROM orders WHERE NOT (CAST(o_orderdate AS DATE) ="
    " DATE '1998-12-25') AND coalesce(nullif(o_orderpriority, '5-LOW') <> '1-URGENT', TRUE)",
)
def delete_where(t):
    """A priority that is unknown keeps its row."""
    day = S.day_mon_yy(F.lit("25-DEC-98"))
    on_day = F.to_date("o_orderdate") == F.add_months(day, -1200)
    urgent = F.nullif("o_orderpriority", F.lit("5-LOW")) == "1-URGENT"
    kept = H.delete_where(t.orders, on_day)
    return H.delete_where(kept, urgent).select("o_orderkey", "o_orderpriority")


@query(
    "dml_delete_cascade",
    "WITH o AS (SELECT * FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE"
    " c_acctbal >= 0)) SELECT 'customer' AS table_name, COUNT(*) AS n FROM customer"
    " WHERE c_acctbal >= 0 UNION ALL SELECT 'orders', COUNT(*) FROM o UNION ALL SELECT 'lineitem',"
    " COUNT(*) FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM o)",
)
def delete_cascade(t):
    left = H.delete_cascade(
        {"customer": t.customer, "orders": t.orders, "lineitem": t.lineitem},
        "customer",
        C("c_acctbal") < 0,
        [
            ("orders", "o_custkey", "customer", "c_custkey"),
            ("lineitem", "l_orderkey", "orders", "o_orderkey"),
        ],
    )
    counts = [
        df.agg(row_count().alias("n")).select(F.lit(name).alias("table_name"), "n")
        for name, df in left.items()
    ]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query(
    "dml_replace_partition",
    "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN o_totalprice * 2 ELSE o_totalprice END"
    " AS price, o_orderstatus AS status FROM orders WHERE o_orderstatus <> 'P'"
    " OR o_totalprice > 250000",
)
def replace_partition(t):
    path = work_folder(t.spark, "lists")
    rows = t.orders.select(
        "o_orderkey", C("o_totalprice").alias("price"), C("o_orderstatus").alias("status")
    )
    H.replace_partitions(rows, path, "status")
    fresh = rows.filter("status = 'P' AND price > 250000").withColumn("price", C("price") * 2)
    H.replace_partitions(fresh, path, "status")
    return t.spark.read.schema(rows.schema).parquet(path)


@query(
    "dml_restrict_check",
    "SELECT c_custkey FROM customer WHERE c_acctbal < 0 AND c_custkey IN (SELECT o_custkey"
    " FROM orders)",
)
def restrict_check(t):
    large = t.orders.select("o_custkey")
    return H.blocked_deletes(
        t.customer, C("c_acctbal") < 0, "c_custkey", large, "o_custkey"
    ).select("c_custkey")
