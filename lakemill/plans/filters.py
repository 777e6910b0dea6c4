"""Projections, filters, sorts, limits and set operations over the generated tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakemill.operators.relational import money_sum, on_days, stack_counts
from lakemill.plans.registry import query
from lakemill.session import SCHEMAS

# ------------------------------------------------------------------ scans and filters


@query("src_table_scan", "SELECT * FROM customer")
def table_scan(t):
    return t.customer


@query(
    "flt_compare",
    "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 400000"
    " AND o_orderstatus = 'F' AND o_orderdate < TIMESTAMP '1999-01-01'",
)
def flt_compare(t):
    return t.orders.filter(
        (F.col("o_totalprice") > 400000)
        & (F.col("o_orderstatus") == "F")
        & (F.col("o_orderdate") < F.lit("1999-01-01").cast("timestamp_ntz"))
    ).select("o_orderkey", "o_totalprice")


@query(
    "flt_between_num",
    "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice BETWEEN 100000 AND 200000",
)
def flt_between_num(t):
    return t.orders.filter(F.col("o_totalprice").between(100000, 200000)).select(
        "o_orderkey", "o_totalprice"
    )


@query(
    "flt_between_date",
    "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS order_day FROM orders"
    " WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1998-07-01' AND DATE '1998-07-31'",
)
def flt_between_date(t):
    return t.orders.filter(on_days("o_orderdate", "1998-07-01", "1998-07-31")).select(
        "o_orderkey", F.to_date("o_orderdate").alias("order_day")
    )


# A stay starts on the order day and lasts a number of days taken from the key.
STAYS_SQL = (
    "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS check_in,"
    " CAST(o_orderdate AS DATE) + CAST(o_orderkey % 45 AS INTEGER) AS check_out,"
    " o_orderkey % 4 + 1 AS adults, o_custkey % 3 AS children FROM orders"
)


def stays(t):
    start = F.to_date("o_orderdate")
    return t.orders.select(
        "o_orderkey",
        start.alias("check_in"),
        F.date_add(start, (F.col("o_orderkey") % 45).cast("int")).alias("check_out"),
        (F.col("o_orderkey") % 4 + 1).alias("adults"),
        (F.col("o_custkey") % 3).alias("children"),
    )


@query(
    "flt_or_dates",
    f"SELECT o_orderkey, check_in, check_out FROM ({STAYS_SQL}) WHERE adults + children > 2"
    " AND (check_in BETWEEN DATE '1998-04-01' AND DATE '1998-04-30'"
    " OR check_out BETWEEN DATE '1998-04-01' AND DATE '1998-04-30')",
)
def flt_or_dates(t):
    return (
        stays(t)
        .filter(F.col("adults") + F.col("children") > 2)
        .filter(
            F.expr(
                "check_in BETWEEN DATE '1998-04-01' AND DATE '1998-04-30'"
                " OR check_out BETWEEN DATE '1998-04-01' AND DATE '1998-04-30'"
            )
        )
        .select("o_orderkey", "check_in", "check_out")
    )


@query(
    "flt_overlap",
    f"SELECT o_orderkey, check_in, check_out FROM ({STAYS_SQL}) WHERE adults + children > 2"
    " AND check_in <= DATE '1998-04-30' AND check_out >= DATE '1998-04-01'",
)
def flt_overlap(t):
    """Any day of the stay falls in April, a stay spanning the whole month included."""
    return (
        stays(t)
        .filter(F.col("adults") + F.col("children") > 2)
        .filter("check_in <= DATE '1998-04-30' AND check_out >= DATE '1998-04-01'")
        .select("o_orderkey", "check_in", "check_out")
    )


@query(
    "flt_is_null",
    "SELECT o_orderkey, nullif(o_orderpriority, '1-URGENT') AS note FROM orders"
    " WHERE nullif(o_orderstatus, 'O') IS NULL"
    " AND nullif(o_orderpriority, '1-URGENT') IS NOT NULL",
)
def flt_is_null(t):
    note = F.nullif("o_orderpriority", F.lit("1-URGENT"))
    return t.orders.filter(
        F.nullif("o_orderstatus", F.lit("O")).isNull() & note.isNotNull()
    ).select("o_orderkey", note.alias("note"))


@query("flt_like_prefix", "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE 'RED%'")
def flt_like_prefix(t):
    """Case is ignored, as the default collation of the source dialect does."""
    return t.part.filter(F.col("p_name").ilike("RED%")).select("p_partkey", "p_name")


@query("flt_like_suffix", "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%bolt'")
def flt_like_suffix(t):
    return t.part.filter(F.col("p_name").endswith("bolt")).select("p_partkey", "p_name")


@query("flt_like_contains", "SELECT c_custkey, c_name FROM customer WHERE c_name LIKE '%0012%'")
def flt_like_contains(t):
    return t.customer.filter(F.col("c_name").contains("0012")).select("c_custkey", "c_name")


@query("flt_like_single", "SELECT p_partkey, p_brand FROM part WHERE p_brand LIKE 'Brand#1_%'")
def flt_like_single(t):
    """`_` stands for exactly one character, so `Brand#1` itself does not match."""
    return t.part.filter(F.col("p_brand").like("Brand#1_%")).select("p_partkey", "p_brand")


@query(
    "flt_in_list",
    "SELECT o_orderkey, o_orderpriority FROM orders"
    " WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')",
)
def flt_in_list(t):
    return t.orders.filter(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).select(
        "o_orderkey", "o_orderpriority"
    )


@query(
    "flt_boolean_tree",
    "SELECT o_orderkey FROM orders WHERE (o_totalprice > 300000 OR o_orderpriority = '1-URGENT')"
    " AND NOT (nullif(o_orderstatus, 'O') = 'F')",
)
def flt_boolean_tree(t):
    return t.orders.filter(
        ((F.col("o_totalprice") > 300000) | (F.col("o_orderpriority") == "1-URGENT"))
        & ~(F.nullif("o_orderstatus", F.lit("O")) == "F")
    ).select("o_orderkey")


@query(
    "flt_filter_agg",
    "SELECT o_orderpriority, COUNT(*) FILTER (WHERE o_orderstatus = 'F') AS n_closed,"
    " CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (WHERE o_totalprice > 250000)"
    " AS DECIMAL(28,2)) AS big_total FROM orders GROUP BY o_orderpriority",
)
def flt_filter_agg(t):
    return t.orders.groupBy("o_orderpriority").agg(
        F.expr("count(*) FILTER (WHERE o_orderstatus = 'F')").alias("n_closed"),
        F.expr(
            "cast(sum(cast(o_totalprice AS decimal(18,2))) FILTER (WHERE o_totalprice > 250000)"
            " AS decimal(28,2))"
        ).alias("big_total"),
    )


# ----------------------------------------------------------------------- projections


@query("prj_rename", 'SELECT s_suppkey AS id, s_nationkey AS "zip code" FROM supplier')
def prj_rename(t):
    return t.supplier.select(
        F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("zip code")
    )


@query(
    "prj_rename_map",
    "SELECT s_suppkey AS author_id, s_name AS author_name, s_nationkey, s_acctbal AS balance"
    " FROM supplier",
)
def prj_rename_map(t):
    return t.supplier.withColumnsRenamed(
        {"s_suppkey": "author_id", "s_name": "author_name", "s_acctbal": "balance"}
    )


@query(
    "prj_arith",
    "SELECT l_orderkey, l_linenumber, CAST(CAST(l_quantity AS INTEGER)"
    " * CAST(l_extendedprice AS DECIMAL(18,2)) AS DECIMAL(28,2)) AS total,"
    " l_linenumber + CAST(l_quantity AS INTEGER) AS heads FROM lineitem",
)
def prj_arith(t):
    whole = F.col("l_quantity").cast("int")
    return t.lineitem.select(
        "l_orderkey",
        "l_linenumber",
        (whole * F.col("l_extendedprice").cast("decimal(18,2)"))
        .cast("decimal(28,2)")
        .alias("total"),
        (F.col("l_linenumber") + whole).alias("heads"),
    )


@query(
    "prj_case",
    "SELECT o_orderkey, CASE WHEN o_totalprice > 400000 THEN 'large'"
    " WHEN o_totalprice > 200000 THEN 'medium' END AS size_class FROM orders",
)
def prj_case(t):
    return t.orders.select(
        "o_orderkey",
        F.when(F.col("o_totalprice") > 400000, "large")
        .when(F.col("o_totalprice") > 200000, "medium")
        .alias("size_class"),
    )


@query(
    "prj_if",
    "SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN 'active' ELSE '' END AS notes FROM customer",
)
def prj_if(t):
    return t.customer.select("c_custkey", F.expr("if(c_acctbal > 0, 'active', '')").alias("notes"))


@query(
    "prj_case_on_value",
    "SELECT n_nationkey, c_custkey, CASE n_regionkey WHEN 1 THEN 'first' WHEN 2 THEN 'second'"
    " WHEN 3 THEN 'third' END AS label FROM customer JOIN nation ON c_nationkey = n_nationkey",
)
def prj_case_on_value(t):
    label = F.expr(
        "CASE n_regionkey WHEN 1 THEN 'first' WHEN 2 THEN 'second' WHEN 3 THEN 'third' END"
    )
    return t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        "n_nationkey", "c_custkey", label.alias("label")
    )


@query("prj_distinct", "SELECT DISTINCT o_orderstatus FROM orders")
def prj_distinct(t):
    return t.orders.select("o_orderstatus").distinct()


@query("prj_drop_column", "SELECT s_suppkey, s_name, s_nationkey FROM supplier")
def prj_drop_column(t):
    return t.supplier.drop("s_acctbal")


@query("prj_add_column", "SELECT *, 0 AS cyp_factor, 'new' AS state FROM supplier")
def prj_add_column(t):
    return t.supplier.withColumns({"cyp_factor": F.lit(0), "state": F.lit("new")})


@query(
    "prj_const",
    "SELECT 'customer' AS origin, c_custkey AS id FROM customer UNION ALL"
    " SELECT 'supplier', s_suppkey FROM supplier",
)
def prj_const(t):
    left = t.customer.select(F.lit("customer").alias("origin"), F.col("c_custkey").alias("id"))
    right = t.supplier.select(F.lit("supplier").alias("origin"), F.col("s_suppkey").alias("id"))
    return left.unionByName(right)


@query(
    "prj_generated",
    "SELECT p_partkey, CAST(ROUND(CAST(p_size AS DECIMAL(10,4)) / 60, 2) AS DOUBLE)"
    " AS length_hours FROM part",
)
def prj_generated(t):
    hours = F.round(F.col("p_size").cast("decimal(10,4)") / 60, 2).cast("double")
    return t.part.select("p_partkey", hours.alias("length_hours"))


# ---------------------------------------------------------------------- sort and limit


@query("srt_desc", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC")
def srt_desc(t):
    return t.orders.select("o_orderkey", "o_totalprice").orderBy(
        F.col("o_totalprice").desc_nulls_last(), "o_orderkey"
    )


@query(
    "srt_multi",
    "SELECT c_mktsegment, c_nationkey, COUNT(*) AS n FROM customer"
    " GROUP BY c_mktsegment, c_nationkey ORDER BY n DESC, c_mktsegment, c_nationkey",
)
def srt_multi(t):
    return (
        t.customer.groupBy("c_mktsegment", "c_nationkey")
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), F.asc_nulls_last("c_mktsegment"), F.asc_nulls_last("c_nationkey"))
    )


@query(
    "srt_position",
    "SELECT o_orderstatus, COUNT(*) AS n FROM orders GROUP BY o_orderstatus ORDER BY 1 DESC",
)
def srt_position(t):
    return t.spark.sql(
        "SELECT o_orderstatus, count(*) AS n FROM {orders} GROUP BY o_orderstatus ORDER BY 1 DESC",
        orders=t.orders,
    )


@query(
    "srt_alias",
    "SELECT l_shipdate, COUNT(*) AS shipped FROM lineitem GROUP BY l_shipdate"
    " ORDER BY shipped DESC, l_shipdate",
)
def srt_alias(t):
    return (
        t.lineitem.groupBy("l_shipdate")
        .agg(F.count(F.lit(1)).alias("shipped"))
        .orderBy(F.desc("shipped"), "l_shipdate")
    )


@query(
    "lim_topk",
    "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 3",
)
def lim_topk(t):
    return (
        t.orders.select("o_orderkey", "o_totalprice")
        .orderBy(F.desc_nulls_last("o_totalprice"), "o_orderkey")
        .limit(3)
    )


@query("lim_first_n", "SELECT COUNT(*) AS n FROM (SELECT * FROM lineitem LIMIT 8)")
def lim_first_n(t):
    """Which rows a bare LIMIT returns is undefined; only their number can be checked."""
    return t.lineitem.limit(8).agg(F.count(F.lit(1)).alias("n"))


@query(
    "lim_offset",
    "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey"
    " LIMIT 1 OFFSET 5",
)
def lim_offset(t):
    return (
        t.orders.select("o_orderkey", "o_totalprice")
        .orderBy(F.desc_nulls_last("o_totalprice"), "o_orderkey")
        .offset(5)
        .limit(1)
    )


@query(
    "lim_top_reviews",
    "SELECT l_partkey, COUNT(*) AS reviews FROM lineitem GROUP BY l_partkey"
    " ORDER BY reviews DESC, l_partkey LIMIT 10",
)
def lim_top_reviews(t):
    return (
        t.lineitem.groupBy("l_partkey")
        .agg(F.count(F.lit(1)).alias("reviews"))
        .orderBy(F.desc("reviews"), "l_partkey")
        .limit(10)
    )


# --------------------------------------------------------------------- set operations

COUNTED = tuple(sorted(SCHEMAS))


@query(
    "set_union_all",
    " UNION ALL ".join(f"SELECT '{n}' AS table_name, COUNT(*) AS n FROM {n}" for n in COUNTED),
)
def set_union_all(t):
    return stack_counts({name: getattr(t, name) for name in COUNTED})


@query(
    "set_union_distinct",
    "SELECT l_linenumber AS n FROM lineitem UNION SELECT p_size FROM part",
)
def set_union_distinct(t):
    lines = t.lineitem.select(F.col("l_linenumber").alias("n")).distinct()
    sizes = t.part.select(F.col("p_size").alias("n")).distinct()
    return lines.union(sizes).distinct()


@query(
    "set_generated_union",
    "SELECT CAST(COUNT(*) AS BIGINT) AS tables, CAST(SUM(n) AS BIGINT) AS total_rows FROM ("
    + " UNION ALL ".join(
        f"SELECT COUNT(*) AS n FROM {n}"
        for n in COUNTED
    )
    + ")",
)
def set_generated_union(t):
    """The tables are those found in the folder."""
    counts = stack_counts({name: t.found(name) for name in t.names()})
    return counts.agg(
        F.count(F.lit(1)).alias("tables"), F.sum("n").alias("total_rows")
    )


@query(
    "agg_sum_decimal",
    "SELECT l_returnflag, CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DECIMAL(28,2))"
    " AS total FROM lineitem GROUP BY l_returnflag",
)
def agg_sum_decimal(t):
    return t.lineitem.groupBy("l_returnflag").agg(money_sum("l_extendedprice").alias("total"))
