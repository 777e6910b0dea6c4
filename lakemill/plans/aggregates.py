"""Aggregations and window functions over the generated tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakemill.operators.lists import counted_list, distinct_list, truncated_list
from lakemill.operators.olap import rollup_along
from lakemill.operators.relational import (
    dense_row_numbers,
    first_in_source_order,
    latest_per_key,
    money,
    money_sum,
    row_count,
    with_group_values,
)
from lakemill.plans.registry import query

C = F.col
PRICE = "CAST(l_extendedprice AS DECIMAL(18,2))"


@query(
    "agg_global",
    "SELECT MAX(p_size) AS max_size, MIN(p_retailprice) AS min_price, COUNT(*) AS n,"
    " COUNT(nullif(p_type, 'PROMO')) AS typed FROM part",
)
def agg_global(t):
    return t.part.agg(
        F.max("p_size").alias("max_size"),
        F.min("p_retailprice").alias("min_price"),
        row_count().alias("n"),
        F.count(F.nullif("p_type", F.lit("PROMO"))).alias("typed"),
    )


@query(
    "agg_group_count",
    "SELECT o_orderpriority, COUNT(*) AS n FROM orders GROUP BY o_orderpriority ORDER BY n DESC",
)
def agg_group_count(t):
    return t.orders.groupBy("o_orderpriority").agg(row_count().alias("n")).orderBy(
        F.desc("n"), "o_orderpriority"
    )


@query(
    "agg_group_avg",
    "SELECT l_linenumber, ROUND(AVG(l_quantity), 4) AS avg_quantity FROM lineitem"
    " GROUP BY l_linenumber",
)
def agg_group_avg(t):
    return t.lineitem.groupBy("l_linenumber").agg(
        F.round(F.avg("l_quantity"), 4).alias("avg_quantity")
    )


@query("agg_group_only", "SELECT o_custkey FROM orders GROUP BY o_custkey")
def agg_group_only(t):
    return t.orders.select("o_custkey").distinct()


@query(
    "agg_multi_group",
    "SELECT l_returnflag, l_linenumber, COUNT(*) AS n FROM lineitem WHERE l_quantity > 25"
    " OR l_discount > 0.05 GROUP BY l_returnflag, l_linenumber",
)
def agg_multi_group(t):
    return (
        t.lineitem.filter("l_quantity > 25 OR l_discount > 0.05D")
        .groupBy("l_returnflag", "l_linenumber")
        .agg(row_count().alias("n"))
    )


@query(
    "agg_multi_sum",
    "SELECT l_linestatus, CAST(SUM(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity,"
    f" CAST(SUM({PRICE}) AS DECIMAL(28,2)) AS price FROM lineitem GROUP BY l_linestatus"
    " ORDER BY 1 DESC",
)
def agg_multi_sum(t):
    return (
        t.lineitem.groupBy("l_linestatus")
        .agg(
            F.sum(C("l_quantity").cast("bigint")).alias("quantity"),
            money_sum("l_extendedprice").alias("price"),
        )
        .orderBy(F.desc("l_linestatus"))
    )


@query(
    "agg_having",
    "SELECT o_custkey, COUNT(*) AS n, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2)))"
    " AS DECIMAL(28,2)) AS total FROM orders GROUP BY o_custkey"
    " HAVING SUM(CAST(o_totalprice AS DECIMAL(18,2))) > 3000000 AND COUNT(*) > 10",
)
def agg_having(t):
    return (
        t.orders.groupBy("o_custkey")
        .agg(row_count().alias("n"), money_sum("o_totalprice").alias("total"))
        .filter("total > 3000000 AND n > 10")
    )


@query(
    "agg_conditional_sum",
    "SELECT c_custkey, CAST(SUM(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT)"
    " AS missed FROM customer LEFT JOIN orders"
    " ON c_custkey = o_custkey GROUP BY c_custkey",
)
def agg_conditional_sum(t):
    """A customer without matching orders gets 0."""
    missed = (
        t.orders.groupBy("o_custkey")
        .agg(F.sum(F.when(C("o_orderstatus") == "F", 1).otherwise(0)).alias("m"))
    )
    return t.customer.join(missed, C("c_custkey") == C("o_custkey"), "left").select(
        "c_custkey", F.coalesce("m", F.lit(0)).alias("missed")
    )


@query(
    "agg_conditional_count",
    "SELECT o_custkey, COUNT(*) AS ordered, COUNT(CASE WHEN o_orderstatus = 'F' THEN 1 END)"
    " AS completed, COUNT(CASE WHEN o_orderstatus = 'O' THEN 1 END) AS pending FROM orders"
    " GROUP BY o_custkey",
)
def agg_conditional_count(t):
    return t.orders.groupBy("o_custkey").agg(
        row_count().alias("ordered"),
        F.count(F.when(C("o_orderstatus") == "F", 1)).alias("completed"),
        F.count(F.when(C("o_orderstatus") == "O", 1)).alias("pending"),
    )


@query(
    "agg_count_distinct",
    "SELECT l_returnflag, COUNT(DISTINCT l_partkey) AS parts, CAST(SUM(CASE WHEN l_discount > 0.05"
    " THEN 1 ELSE 0 END) AS BIGINT) AS discounted FROM lineitem GROUP BY l_returnflag",
)
def agg_count_distinct(t):
    """Exact. Spark groups by (flag, part) first, so three flags still use every task."""
    return t.lineitem.groupBy("l_returnflag").agg(
        F.countDistinct("l_partkey").alias("parts"),
        F.sum(F.when(C("l_discount") > 0.05, 1).otherwise(0)).alias("discounted"),
    )


@query(
    "agg_count_distinct_null",
    "SELECT DISTINCT v, COUNT(v) AS n FROM (SELECT nullif(o_orderpriority, '5-LOW') AS v"
    " FROM orders) GROUP BY v",
)
def agg_count_distinct_null(t):
    value = F.nullif("o_orderpriority", F.lit("5-LOW")).alias("v")
    return t.orders.select(value).groupBy("v").agg(F.count("v").alias("n"))


@query(
    "agg_min_max_dates",
    "SELECT o_custkey, CAST(MIN(o_orderdate) AS DATE) AS first_visit,"
    " CAST(MAX(o_orderdate) AS DATE) AS last_visit FROM orders GROUP BY o_custkey",
)
def agg_min_max_dates(t):
    return t.orders.groupBy("o_custkey").agg(
        F.min("o_orderdate").cast("date").alias("first_visit"),
        F.max("o_orderdate").cast("date").alias("last_visit"),
    )


@query(
    "agg_group_concat",
    "SELECT o_custkey, string_agg(o_orderpriority || ' x' || n, ', ' ORDER BY o_orderpriority)"
    " AS priorities FROM (SELECT o_custkey, o_orderpriority, COUNT(*) AS n FROM orders GROUP BY ALL)"
    " GROUP BY o_custkey",
)
def agg_group_concat(t):
    return counted_list(t.orders, ["o_custkey"], "o_orderpriority", name="priorities")


@query(
    "agg_group_concat_distinct",
    "SELECT l_suppkey, string_agg(DISTINCT p_name, '; ' ORDER BY p_name) AS names FROM lineitem"
    " JOIN part ON l_partkey = p_partkey GROUP BY l_suppkey",
)
def agg_group_concat_distinct(t):
    pairs = t.lineitem.select("l_suppkey", "l_partkey").distinct()
    named = pairs.join(t.part, C("l_partkey") == C("p_partkey"))
    return distinct_list(named, ["l_suppkey"], "p_name", "; ", "names")


# Items are joined while they fit into `limit` bytes; the rest are counted.
def truncated_sql(source: str, keys: str, item: str, order: str, limit: int, name: str) -> str:
    return (
        f"WITH s AS (SELECT {keys}, {item} AS v, row_number() OVER w AS pos,"
        f" SUM(strlen({item}) + 2) OVER (PARTITION BY {keys} ORDER BY {order}"
        " ROWS UNBOUNDED PRECEDING) - 2 AS used,"
        f" COUNT(*) OVER (PARTITION BY {keys}) AS total FROM {source}"
        f" WINDOW w AS (PARTITION BY {keys} ORDER BY {order}))"
        f" SELECT {keys}, CASE WHEN COUNT(*) FILTER (WHERE used <= {limit}) = MAX(total)"
        " THEN string_agg(v, ', ' ORDER BY pos) ELSE"
        f" coalesce(string_agg(v, ', ' ORDER BY pos) FILTER (WHERE used <= {limit}) || ', ', '')"
        f" || '...(' || (MAX(total) - COUNT(*) FILTER (WHERE used <= {limit})) || ')' END"
        f" AS {name} FROM s GROUP BY {keys}"
    )


@query(
    "agg_listagg_truncate",
    truncated_sql(
        "lineitem JOIN part ON l_partkey = p_partkey",
        "l_suppkey",
        "p_name",
        "l_orderkey, l_linenumber, l_partkey",
        4000,
        "items",
    ),
)
def agg_listagg_truncate(t):
    """A supplier has some six hundred lines; their names pass 4,000 bytes."""
    named = t.part.select("p_partkey", "p_name")
    lines = t.lineitem.join(named, C("l_partkey") == C("p_partkey"))
    order = ["l_orderkey", "l_linenumber", "l_partkey"]
    return truncated_list(lines, ["l_suppkey"], "p_name", order)


GROUPED_SQL = (
    "SELECT c_mktsegment AS store, o_orderstatus AS status, COUNT(*) AS n,"
    " CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS total{extra}"
    " FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY GROUPING SETS"
    " ((c_mktsegment), (c_mktsegment, o_orderstatus), (o_orderstatus), ())"
)


def store_status_totals(t):
    """Totals of the finest group; every coarser set is summed from these few rows."""
    per_customer = t.orders.groupBy("o_custkey", C("o_orderstatus").alias("status")).agg(
        row_count().alias("n"), money_sum("o_totalprice").alias("total")
    )
    return (
        per_customer.join(t.customer, C("o_custkey") == C("c_custkey"))
        .groupBy(C("c_mktsegment").alias("store"), "status")
        .agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    )


SETS = "((store), (store, status), (status), ())"


@query("agg_grouping_sets", GROUPED_SQL.format(extra=""))
def agg_grouping_sets(t):
    return t.spark.sql(
        "SELECT store, status, sum(n) AS n, cast(sum(total) AS decimal(28,2)) AS total"
        f" FROM {{g}} GROUP BY GROUPING SETS {SETS}",
        g=store_status_totals(t),
    )


@query(
    "agg_grouping_id",
    GROUPED_SQL.format(
        extra=", CASE GROUPING(c_mktsegment) * 2 + GROUPING(o_orderstatus) WHEN 1 THEN"
        " 'STORE TOTAL' WHEN 2 THEN 'STATUS TOTAL' WHEN 3 THEN 'GRAND TOTAL' END AS label"
    ),
)
def agg_grouping_id(t):
    return t.spark.sql(
        "SELECT store, status, sum(n) AS n, cast(sum(total) AS decimal(28,2)) AS total,"
        " CASE grouping_id(store, status) WHEN 1 THEN 'STORE TOTAL' WHEN 2 THEN 'STATUS TOTAL'"
        f" WHEN 3 THEN 'GRAND TOTAL' END AS label FROM {{g}} GROUP BY GROUPING SETS {SETS}",
        g=store_status_totals(t),
    )


@query(
    "agg_rollup_hierarchy",
    f"SELECT y, q, m, CAST(SUM({PRICE}) AS DECIMAL(28,2)) AS total, CAST(3 - GROUPING(y)"
    " - GROUPING(q) - GROUPING(m) AS INTEGER) AS level FROM (SELECT *, CAST(year(l_shipdate) AS"
    " INTEGER) AS y, CAST(quarter(l_shipdate) AS INTEGER) AS q, CAST(month(l_shipdate) AS INTEGER)"
    " AS m FROM lineitem) GROUP BY ROLLUP (y, q, m)",
)
def agg_rollup_hierarchy(t):
    d = "l_shipdate"
    facts = t.lineitem.select(
        F.year(d).alias("y"), F.quarter(d).alias("q"), F.month(d).alias("m"), "l_extendedprice"
    )
    rolled = rollup_along(facts, ["y", "q", "m"], {"total": money_sum("l_extendedprice")})
    return rolled.withColumn("total", C("total").cast("decimal(28,2)"))


@query(
    "agg_object",
    "SELECT l_suppkey, to_json(map_from_entries(list((p_type, names) ORDER BY p_type)))::VARCHAR"
    " AS film_info FROM (SELECT l_suppkey, p_type, list(DISTINCT p_name ORDER BY p_name) AS names"
    " FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_suppkey, p_type)"
    " GROUP BY l_suppkey",
)
def agg_object(t):
    return objects_per_supplier(t).select("l_suppkey", "film_info")


def objects_per_supplier(t):
    """JSON object per supplier: part type -> sorted distinct part names.

    Each step works on distinct values, so an object is as large as the set of names.
    """
    pairs = t.lineitem.select("l_suppkey", "l_partkey").distinct()
    named = (
        pairs.join(t.part, C("l_partkey") == C("p_partkey"))
        .select("l_suppkey", "p_type", "p_name")
        .distinct()
    )
    titles = named.groupBy("l_suppkey", "p_type").agg(
        F.sort_array(F.collect_list("p_name")).alias("names")
    )
    entries = F.sort_array(F.collect_list(F.struct("p_type", "names")))
    return (
        titles.groupBy("l_suppkey")
        .agg(F.map_from_entries(entries).alias("m"))
        .select("l_suppkey", F.to_json("m").alias("film_info"))
    )


@query(
    "agg_array",
    "SELECT l_suppkey, CAST(SUM(c) AS BIGINT) AS n, to_json(list(struct_pack(v := p_brand, n := c)"
    " ORDER BY p_brand))::VARCHAR AS brands FROM (SELECT l_suppkey, p_brand, COUNT(*) AS c FROM"
    " lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL) GROUP BY l_suppkey",
)
def agg_array(t):
    """The array, shown as JSON text, holds each value with the number of its repeats, so that it
    grows with the distinct values of a group."""
    pairs = t.lineitem.groupBy("l_suppkey", "l_partkey").agg(row_count().alias("c"))
    counted = (
        pairs.join(t.part, C("l_partkey") == C("p_partkey"))
        .groupBy("l_suppkey", "p_brand")
        .agg(F.sum("c").alias("c"))
    )
    values = F.sort_array(F.collect_list(F.struct(C("p_brand").alias("v"), C("c").alias("n"))))
    return counted.groupBy("l_suppkey").agg(F.sum("c").alias("n"), F.to_json(values).alias("brands"))


@query(
    "agg_any_value",
    "SELECT c_custkey, MIN(c_name) AS c_name, COUNT(o_orderkey) AS n FROM customer"
    " JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey",
)
def agg_any_value(t):
    """Grouped by the true key; the other columns follow from it."""
    counts = t.orders.groupBy("o_custkey").agg(F.count("o_orderkey").alias("n"))
    return t.customer.join(counts, C("c_custkey") == C("o_custkey")).select(
        "c_custkey", "c_name", "n"
    )


@query(
    "agg_stats",
    "SELECT CAST(MIN(o_totalprice) AS DECIMAL(18,2)) AS lowest, CAST(MAX(o_totalprice)"
    " AS DECIMAL(18,2)) AS highest, ROUND(CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2)))"
    " AS DOUBLE) / COUNT(*), 4) AS mean, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2)))"
    " AS DECIMAL(28,2)) AS total FROM orders",
)
def agg_stats(t):
    total = money_sum("o_totalprice")
    return t.orders.agg(
        money(F.min("o_totalprice")).alias("lowest"),
        money(F.max("o_totalprice")).alias("highest"),
        F.round(total.cast("double") / F.count("o_totalprice"), 4).alias("mean"),
        total.alias("total"),
    )


@query(
    "agg_share",
    "SELECT event_type, COUNT(*) AS n, ROUND(100.0::DOUBLE * COUNT(*) / SUM(COUNT(*)) OVER (), 4)"
    " AS share FROM events GROUP BY event_type",
)
def agg_share(t):
    total = t.events.agg(row_count()).scalar()
    return t.events.groupBy("event_type").agg(row_count().alias("n")).withColumn(
        "share", F.round(F.lit(100.0) * C("n") / total, 4)
    )


@query(
    "agg_histogram",
    "SELECT floor(value / 0.5) * 0.5::DOUBLE AS bucket, COUNT(*) AS n FROM events GROUP BY bucket",
)
def agg_histogram(t):
    bucket = (F.floor(C("value") / 0.5) * F.lit(0.5)).alias("bucket")
    return t.events.groupBy(bucket).agg(row_count().alias("n"))


@query(
    "agg_ratio_per_parent",
    "SELECT COUNT(DISTINCT o_custkey) AS parents, COUNT(*) AS children,"
    " ROUND(COUNT(*) / COUNT(DISTINCT o_custkey), 4) AS per_parent FROM orders",
)
def agg_ratio_per_parent(t):
    """Counted per parent first, so the distinct count is a plain count of groups."""
    per = t.orders.filter("o_custkey IS NOT NULL").groupBy("o_custkey").agg(row_count().alias("n"))
    return per.agg(row_count().alias("parents"), F.sum("n").alias("children")).withColumn(
        "per_parent", F.round(C("children") / C("parents"), 4)
    )


# ---------------------------------------------------------------------------- windows


@query(
    "win_avg_partition",
    "SELECT p_partkey, p_brand, ROUND(AVG(p_size) OVER (PARTITION BY p_brand), 2) AS avg_size"
    " FROM part",
)
def win_avg_partition(t):
    return with_group_values(
        t.part.select("p_partkey", "p_brand", "p_size"),
        ["p_brand"],
        F.round(F.avg("p_size"), 2).alias("avg_size"),
    ).drop("p_size")


@query(
    "win_avg_over_agg",
    "SELECT l_suppkey, COUNT(*) AS n, ROUND(AVG(COUNT(*)) OVER (), 4) AS mean FROM lineitem"
    " GROUP BY l_suppkey",
)
def win_avg_over_agg(t):
    """The mean over all groups is one number: no window has to gather the groups."""
    loads = t.lineitem.groupBy("l_suppkey").agg(row_count().alias("n"))
    mean = loads.agg(F.round(F.avg("n"), 4)).scalar()
    return loads.withColumn("mean", mean)


@query(
    "win_latest_row",
    "SELECT o_custkey, o_orderkey, o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY"
    " o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1",
)
def win_latest_row(t):
    rows = t.orders.select("o_custkey", "o_orderkey", "o_orderdate")
    return latest_per_key(rows, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")])


@query(
    "win_row_number_key",
    "SELECT row_number() OVER () AS booking_id, l_orderkey, l_linenumber, l_partkey FROM lineitem",
)
def win_row_number_key(t):
    return dense_row_numbers(
        t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey"), "booking_id"
    )


@query(
    "win_first_per_key",
    "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM (SELECT *, row_number() OVER"
    " (PARTITION BY l_orderkey, l_linenumber ORDER BY pos) AS r FROM (SELECT *,"
    " row_number() OVER () AS pos FROM lineitem)) WHERE r = 1",
)
def win_first_per_key(t):
    return first_in_source_order(
        t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity"),
        ["l_orderkey", "l_linenumber"],
    )
