"""Repair, constraint checks, profiling and proof, on tables with dirt injected by rule."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakemill.functions import scalars as S
from lakemill.operators import quality as Q
from lakemill.operators.relational import dense_row_numbers, stack_counts, with_total
from lakemill.plans.filters import COUNTED
from lakemill.plans.registry import ORACLES, QUERIES, query
from lakemill.session import work_folder

C = F.col

# Every ninth customer key of an order points past the last customer, and every eleventh is NULL.
DIRTY_ORDERS_SQL = (
    "SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 9 = 0"
    " THEN CAST(-o_custkey - 1 AS VARCHAR) ELSE ' ' || o_custkey END AS cust, o_orderstatus"
    " FROM orders"
)


def dirty_orders(t):
    """Customer keys arrive as padded text."""
    return t.orders.select(
        "o_orderkey",
        F.when(C("o_orderkey") % 11 == 0, None)
        .when(C("o_orderkey") % 9 == 0, (-C("o_custkey") - 1).cast("string"))
        .otherwise(F.concat(F.lit(" "), C("o_custkey").cast("string")))
        .alias("cust"),
        "o_orderstatus",
    )


def dataset(t):
    """Customers, their orders and the lines of those orders, parents first."""
    return {
        "customer": Q.Relation(t.customer, pk=["c_custkey"]),
        "orders": Q.Relation(
            dirty_orders(t),
            pk=["o_orderkey"],
            fks=[(["cust"], "customer", ["c_custkey"])],
            types={"cust": "int"},
        ),
        "lineitem": Q.Relation(
            dense_row_numbers(t.lineitem, "source_row"),
            pk=["l_orderkey", "l_linenumber"],
            fks=[(["l_orderkey"], "orders", ["o_orderkey"])],
            position=["source_row"],
        ),
    }


KEPT_ORDERS_SQL = (
    f"SELECT * FROM ({DIRTY_ORDERS_SQL}) WHERE cust IS NULL OR CAST(trim(cust) AS BIGINT) IN"
    " (SELECT c_custkey FROM customer)"
)
KEPT_LINES_SQL = (
    "SELECT * FROM (SELECT *, row_number() OVER () AS source_row FROM lineitem) WHERE l_orderkey IN"
    " (SELECT o_orderkey FROM"
    f" ({KEPT_ORDERS_SQL}))"
)


@query("dq_drop_orphans", KEPT_ORDERS_SQL)
def drop_orphans(t):
    tables, _ = Q.drop_orphans(dataset(t))
    return tables["orders"].rows


FIRST_LINES_SQL = (
    "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM (SELECT *,"
    " row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY source_row) AS r"
    f" FROM ({KEPT_LINES_SQL})) WHERE r = 1"
)


@query("dq_dedupe_pk", FIRST_LINES_SQL)
def dedupe_pk(t):
    """The first in source order, after the orphan pass, as a load does it."""
    tables, _ = Q.drop_orphans(dataset(t))
    kept, _ = Q.dedupe_pk(tables["lineitem"])
    return kept.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


@query(
    "dq_drop_report",
    "WITH c AS (SELECT 'orders' AS table_name, 'no customer(c_custkey)' AS rule,"
    f" (SELECT COUNT(*) FROM orders) - (SELECT COUNT(*) FROM ({KEPT_ORDERS_SQL})) AS n"
    " UNION ALL SELECT 'lineitem', 'no orders(o_orderkey)', (SELECT COUNT(*) FROM lineitem)"
    f" - (SELECT COUNT(*) FROM ({KEPT_LINES_SQL})) UNION ALL SELECT 'lineitem',"
    f" 'duplicate primary key', (SELECT COUNT(*) FROM ({KEPT_LINES_SQL}))"
    f" - (SELECT COUNT(*) FROM ({FIRST_LINES_SQL})))"
    " SELECT * FROM c UNION ALL SELECT 'TOTAL', '', CAST(SUM(n) AS BIGINT) FROM c",
)
def drop_report(t):
    tables, dropped = Q.drop_orphans(dataset(t))
    _, duplicates = Q.dedupe_pk(tables["lineitem"])
    copies = duplicates.agg(F.coalesce(F.sum("dropped"), F.lit(0)).alias("n")).select(
        F.lit("lineitem").alias("table_name"), F.lit("duplicate primary key").alias("rule"), "n"
    )
    return with_total(Q.report_counts(dropped).unionByName(copies), ["table_name", "rule"])


@query(
    "dq_check_pk",
    "SELECT l_orderkey, l_linenumber, COUNT(*) AS n FROM lineitem GROUP BY ALL HAVING COUNT(*) > 1",
)
def check_pk(t):
    return Q.check_primary_key(t.lineitem, ["l_orderkey", "l_linenumber"])


@query(
    "dq_check_unique",
    "SELECT v AS segment, COUNT(*) AS n FROM (SELECT nullif(c_mktsegment, 'BUILDING') AS v"
    " FROM customer) WHERE v IS NOT NULL GROUP BY v HAVING COUNT(*) > 1",
)
def check_unique(t):
    """NULL may repeat."""
    segments = t.customer.select(
        F.nullif("c_mktsegment", F.lit("BUILDING")).alias("segment")
    )
    return Q.check_unique(segments, ["segment"])


@query(
    "dq_check_fk",
    f"SELECT o_orderkey, CAST(trim(cust) AS BIGINT) AS cust FROM ({DIRTY_ORDERS_SQL})"
    " WHERE cust IS NOT NULL AND CAST(trim(cust) AS BIGINT) NOT IN (SELECT c_custkey"
    " FROM customer)",
)
def check_fk(t):
    typed = dirty_orders(t).select("o_orderkey", S.key_value("cust", "int").alias("cust"))
    return Q.check_foreign_key(typed, ["cust"], t.customer, ["c_custkey"])


@query("dq_check_not_null", f"SELECT o_orderkey FROM ({DIRTY_ORDERS_SQL}) WHERE cust IS NULL")
def check_not_null(t):
    return Q.violations(dirty_orders(t), C("cust").isNotNull()).select("o_orderkey")


@query(
    "dq_check_range",
    "SELECT c_custkey, c_acctbal FROM customer WHERE NOT (c_acctbal BETWEEN -90 AND 9000)",
)
def check_range(t):
    return Q.violations(t.customer, C("c_acctbal").between(-90, 9000)).select(
        "c_custkey", "c_acctbal"
    )


@query(
    "dq_check_enum",
    "SELECT p_partkey, p_type FROM part WHERE p_type NOT IN ('SMALL', 'MEDIUM', 'LARGE')",
)
def check_enum(t):
    sizes = Q.allowed("p_type", ("SMALL", "MEDIUM", "LARGE"))
    return Q.violations(t.part, sizes).select("p_partkey", "p_type")


@query(
    "dq_check_cross_column",
    "SELECT l_orderkey, l_linenumber, l_discount, l_tax FROM lineitem WHERE l_tax > l_discount",
)
def check_cross_column(t):
    return Q.violations(t.lineitem, C("l_discount") >= C("l_tax")).select(
        "l_orderkey", "l_linenumber", "l_discount", "l_tax"
    )


@query(
    "dq_check_exclusive",
    "SELECT p_partkey FROM part WHERE CAST(p_size % 2 = 0 AS INTEGER)"
    " + CAST(p_size % 3 = 0 AS INTEGER) + CAST(p_size % 5 = 0 AS INTEGER) > 1",
)
def check_exclusive(t):
    """A river ends in at most one of river, lake and sea."""
    ends = t.part.select(
        "p_partkey",
        F.when(C("p_size") % 2 == 0, C("p_name")).alias("river"),
        F.when(C("p_size") % 3 == 0, C("p_name")).alias("lake"),
        F.when(C("p_size") % 5 == 0, C("p_name")).alias("sea"),
    )
    return Q.violations(ends, Q.at_most_one("river", "lake", "sea")).select("p_partkey")


@query(
    "dq_check_struct",
    "SELECT c_custkey FROM customer WHERE NOT (c_acctbal / 60 BETWEEN -90 AND 90"
    " AND c_acctbal / 30 > -180 AND c_acctbal / 30 <= 180)",
)
def check_struct(t):
    placed = t.customer.select(
        "c_custkey",
        F.struct(
            (C("c_acctbal") / 60).alias("latitude"), (C("c_acctbal") / 30).alias("longitude")
        ).alias("at"),
    )
    inside = (
        C("at.latitude").between(-90, 90)
        & (C("at.longitude") > -180)
        & (C("at.longitude") <= 180)
    )
    return Q.violations(placed, inside).select("c_custkey")


@query(
    "dq_default_fill",
    "SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') AS segment, 0 AS loyalty,"
    " 'new' AS state FROM customer",
)
def default_fill(t):
    given = t.customer.select(
        "c_custkey", F.nullif("c_mktsegment", F.lit("BUILDING")).alias("segment")
    )
    return Q.fill_defaults(given, {"segment": "none", "loyalty": 0, "state": "new"})


@query(
    "dq_duplicates_full_row",
    "SELECT l_partkey, l_linenumber, l_quantity, COUNT(*) AS n FROM lineitem GROUP BY ALL"
    " HAVING COUNT(*) > 1",
)
def duplicates_full_row(t):
    return Q.duplicate_rows(t.lineitem.select("l_partkey", "l_linenumber", "l_quantity"))


# Bookings: orders with sparse, rarely missing and wrongly typed columns.
def bookings(t):
    d = "o_orderdate"
    key = C("o_orderkey")
    return t.orders.select(
        key.alias("booking_id"),
        C("o_orderpriority").alias("hotel"),
        F.when(key % 8 != 0, C("o_custkey")).alias("agent"),
        F.when(key % 16 == 1, C("o_custkey")).alias("company"),
        F.when(key % 97 == 0, "NA")
        .when(key % 89 != 0, (key % 4).cast("string"))
        .alias("children"),
        F.when(key % 83 != 0, C("o_orderstatus")).alias("country"),
        (key % 2).cast("string").alias("is_canceled"),
        (key % 3 == 0).cast("int").alias("is_repeated_guest"),
        F.year(d).alias("arrival_year"),
        F.date_format(d, "MMMM").alias("arrival_month"),
        F.dayofmonth(d).alias("arrival_day"),
        F.date_format(d, "yyyy-MM-dd").alias("status_date"),
    )


@query(
    "dq_clean_bookings",
    "SELECT o_orderkey AS booking_id, o_orderpriority AS hotel, CAST(o_orderkey % 4 AS INTEGER)"
    " AS children, o_orderstatus AS country, o_orderkey % 2 = 1 AS is_canceled, o_orderkey % 3 = 0"
    " AS is_repeated_guest, CAST(o_orderdate AS DATE) AS status_date, CAST(o_orderdate AS DATE)"
    " AS arrival_date FROM orders WHERE o_orderkey % 97 <> 0 AND o_orderkey % 89 <> 0"
    " AND o_orderkey % 83 <> 0",
)
def clean_bookings(t, sparse=0.1):
    """Drop sparse columns, drop rows with rare gaps, fix types, build the arrival date."""
    complete = Q.drop_sparse(bookings(t), sparse)
    given = complete.withColumn("children", S.null_tokens("children")).dropna(
        subset=["children", "country"]
    )
    return given.select(
        "booking_id",
        "hotel",
        C("children").cast("int").alias("children"),
        "country",
        S.truthy("is_canceled").alias("is_canceled"),
        S.truthy("is_repeated_guest").alias("is_repeated_guest"),
        C("status_date").cast("date").alias("status_date"),
        S.date_from_month_name("arrival_year", "arrival_month", "arrival_day").alias(
            "arrival_date"
        ),
    )


DATE_COLUMNS = ("arrival_year", "arrival_month", "arrival_day", "status_date")


@query(
    "dq_missing_share",
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, ROUND(AVG(CAST({e} AS INTEGER)), 6) AS missing FROM orders"
        for c, e in (
            ("booking_id", "o_orderkey IS NULL"),
            ("hotel", "o_orderpriority IS NULL"),
            ("agent", "o_orderkey % 8 = 0 OR o_custkey IS NULL"),
            ("company", "o_orderkey % 16 <> 1 OR o_custkey IS NULL"),
            ("children", "o_orderkey % 97 <> 0 AND o_orderkey % 89 = 0"),
            ("country", "o_orderkey % 83 = 0 OR o_orderstatus IS NULL"),
            ("is_canceled", "o_orderkey IS NULL"),
            ("is_repeated_guest", "o_orderkey IS NULL"),
            *[(c, "o_orderdate IS NULL") for c in DATE_COLUMNS],
        )
    ),
)
def missing_share(t):
    return Q.missing_shares(bookings(t))


PROFILED = (
    ("o_orderkey", True),
    ("o_custkey", True),
    ("o_orderstatus", False),
    ("o_totalprice", True),
    ("o_orderdate", False),
    ("o_orderpriority", False),
)


@query(
    "dq_profile",
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, COUNT(*) AS n, COUNT(*) FILTER (WHERE {c} IS NULL) AS nulls,"
        f" COUNT(DISTINCT {c}) AS distinct_values, CAST(MIN({c}) AS VARCHAR) AS lowest,"
        f" CAST(MAX({c}) AS VARCHAR) AS highest, "
        + (
            f"ROUND(CAST(SUM(CAST({c} AS DECIMAL(24,6))) AS DOUBLE) / COUNT({c}), 4)"
            if numeric
            else "CAST(NULL AS DOUBLE)"
        )
        + " AS mean FROM orders"
        for c, numeric in PROFILED
    ),
)
def dq_profile(t):
    return Q.profile(t.orders.select(*[c for c, _ in PROFILED]), exact=True)


# ------------------------------------------------------------------------------- proof


@query(
    "vfy_exact_counts",
    "WITH c AS ("
    + " UNION ALL ".join(f"SELECT '{n}' AS table_name, COUNT(*) AS n FROM {n}" for n in COUNTED)
    + ") SELECT * FROM c UNION ALL SELECT 'TOTAL', CAST(SUM(n) AS BIGINT) FROM c",
)
def exact_counts(t):
    counts = stack_counts({name: getattr(t, name) for name in COUNTED})
    return with_total(counts, ["table_name"])


# Rows that each table should have: one per key. Those of a parent come from its children.
KEYS = {
    "region": "r_regionkey", "nation": "n_nationkey", "supplier": "s_suppkey", "part": "p_partkey",
    "orders": "o_orderkey", "lineitem": "l_orderkey, l_linenumber", "events": "event_id",
    "documents": "doc_id", "embeddings": "vec_id", "pages": "page_id", "benchmark": "item_id",
    "labels": "doc_id", "conversations": "conv_id, turn",
}
EXPECTED = {**{n: (n, k) for n, k in KEYS.items()}, "customer": ("orders", "o_custkey")}


@query(
    "vfy_expected_actual",
    "SELECT *, expected = actual AS matches FROM ("
    + " UNION ALL ".join(
        f"SELECT '{n}' AS table_name, (SELECT COUNT(*) FROM (SELECT DISTINCT {k} FROM {source}))"
        f" AS expected, (SELECT COUNT(*) FROM {n}) AS actual"
        for n, (source, k) in EXPECTED.items()
    )
    + ")",
)
def expected_actual(t):
    """Every table; the customers expected are those that the orders mention."""
    counts = stack_counts({name: getattr(t, name) for name in EXPECTED})
    keys = {
        name: getattr(t, source).select(*key.split(", ")).distinct()
        for name, (source, key) in EXPECTED.items()
    }
    return Q.expected_actual(counts, stack_counts(keys).withColumnRenamed("n", "expected"))


@query(
    "vfy_non_empty",
    " UNION ALL ".join(f"SELECT '{n}' AS table_name, COUNT(*) AS n FROM {n}" for n in COUNTED),
)
def non_empty(t):
    return Q.require_rows(stack_counts({name: getattr(t, name) for name in COUNTED}))


@query(
    "dq_required_members",
    "SELECT DISTINCT o_custkey + 3 AS id FROM orders WHERE o_custkey + 3 NOT IN"
    " (SELECT c_custkey FROM customer)",
)
def required_members(t):
    required = t.orders.select((C("o_custkey") + 3).alias("id")).distinct()
    return Q.missing_members(t.customer, "c_custkey", required, "id")


PRIORITY = "nullif(o_orderpriority, '5-LOW')"


@query(
    "vfy_gather_stats",
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, 'num_nulls' AS info_name, CAST(COUNT(*) FILTER (WHERE {e} IS"
        f" NULL) AS VARCHAR) AS info_value FROM orders UNION ALL SELECT '{c}', 'distinct_count',"
        f" CAST(COUNT(DISTINCT {e}) AS VARCHAR) FROM orders"
        for c, e in [(c, PRIORITY if c == "o_orderpriority" else c) for c, _ in PROFILED]
    ),
)
def gather_stats(t):
    """Statistics of every column of the orders, one of which has NULLs."""
    noted = F.nullif("o_orderpriority", F.lit("5-LOW"))
    return Q.gather_stats(t.orders.withColumn("o_orderpriority", noted))


@query(
    "dq_file_profile",
    "SELECT unnest(['event_id', 'user_id', 'value']) AS column_name, n, 0 AS nulls, unnest(lowest) AS"
    " lowest, unnest(mean) AS mean FROM (SELECT COUNT(*) AS n, [CAST(MIN(event_id) AS VARCHAR),"
    " CAST(MIN(user_id) AS VARCHAR), CAST(MIN(value) AS VARCHAR)] AS lowest, [ROUND(AVG(event_id), 4),"
    " ROUND(AVG(user_id), 4), ROUND(CAST(SUM(CAST(value AS DECIMAL(24,6))) AS DOUBLE) / COUNT(value), 4)]"
    " AS mean FROM events)",
)
def file_profile(t):
    """The profile of a table that grows: sketches of the files of a first part are stored, only
    those of the second are read for it, and both are merged."""
    table, path = work_folder(t.spark, "growing"), work_folder(t.spark, "sketches")
    schema = "event_id bigint, user_id bigint, value double"
    rows = t.events.select("event_id", "user_id", "value")
    for part in (0, 1):
        rows.filter(C("event_id") % 2 == part).write.mode("append").parquet(table)
        sketches = Q.add_sketches(t.spark, table, schema, path)
    return Q.merged_profile(sketches).select("column_name", "n", "nulls", "lowest", "mean")


VIEWS = tuple(sorted(k for k in ORACLES if k.startswith(("view_", "mv_"))))


@query(
    "vfy_view_counts",
    " UNION ALL ".join(
        f"SELECT '{v}' AS table_name, COUNT(*) AS n FROM ({ORACLES[v]})" for v in VIEWS
    ),
)
def view_counts(t):
    return stack_counts({v: QUERIES[v](t.spark, t.dir) for v in VIEWS})
