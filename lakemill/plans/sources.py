"""Loads and writes as round trips of whole tables through files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakemill.operators.relational import dense_row_numbers, money, row_count
from lakemill.plans.registry import query
from lakemill.session import SCHEMAS, spread, work_folder
from lakemill.sources import delimited as D
from lakemill.sources import dumps, sinks

C = F.col


@query(
    "src_csv_staged",
    "SELECT o_orderkey, o_custkey, o_orderstatus, CAST(o_totalprice AS DECIMAL(18,2)) AS"
    " o_totalprice, CAST(o_orderdate AS DATE) AS o_orderdate,"
    " nullif(o_orderpriority, '5-LOW') AS note FROM orders",
)
def csv_staged(t):
    path = work_folder(t.spark, "orders-csv")
    padded = t.orders.select(
        "o_orderkey",
        F.concat(F.lit("  "), C("o_custkey").cast("string"), F.lit(" ")).alias("o_custkey"),
        "o_orderstatus",
        money("o_totalprice").cast("string").alias("o_totalprice"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate"),
        F.nullif("o_orderpriority", F.lit("5-LOW")).alias("note"),
    )
    padded.write.csv(
        path, header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    )
    return D.read_staged_csv(
        t.spark,
        path,
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice decimal(18,2),"
        " o_orderdate date, note string",
    )


@query(
    "src_csv_nulls",
    "SELECT CAST(o_orderkey AS VARCHAR) AS id, CASE WHEN o_orderkey % 4 = 0 THEN"
    " o_orderpriority END AS note, CAST(NULL AS VARCHAR) AS absent FROM orders",
)
def csv_nulls(t):
    path = work_folder(t.spark, "null-csv")
    key = C("o_orderkey")
    marked = t.orders.select(
        key.alias("Order_ID"),
        F.when(key % 4 == 0, F.concat(F.lit(" "), "o_orderpriority"))
        .when(key % 4 == 1, "NA")
        .when(key % 4 == 2, " NULL ")
        .otherwise("null")
        .alias(" Note"),
    )
    marked.write.csv(path, header=True)
    return D.read_named_csv(t.spark, path, ["id", "note", "absent"], {"order_id": "id"})


@query(
    "src_csv_infer",
    "SELECT event_id, user_id, event_type, value, strftime(ts, '%Y-%m-%d') AS day FROM events",
)
def csv_infer(t):
    """Dates stay text."""
    path = work_folder(t.spark, "events-csv")
    t.events.select(
        "event_id", "user_id", "event_type", "value", F.date_format("ts", "yyyy-MM-dd").alias("day")
    ).write.csv(path, header=True)
    return D.read_inferred_csv(t.spark, path)


@query(
    "src_tsv_nulls",
    "SELECT CAST(event_id AS VARCHAR) AS event_id, CASE WHEN event_type = 'error' THEN NULL"
    " WHEN event_type = 'view' THEN '' ELSE event_type END AS kind,"
    " CASE WHEN user_id % 5 <> 0 THEN CAST(user_id AS VARCHAR) END AS remark FROM events",
)
def tsv_nulls(t):
    r"""NULL is written as `\N`, and as a missing last field."""
    path = work_folder(t.spark, "events-tsv")
    kind = (
        F.when(C("event_type") == "error", r"\N")
        .when(C("event_type") == "view", "")
        .otherwise(C("event_type"))
    )
    line = F.concat_ws("\t", C("event_id").cast("string"), kind)
    full = F.concat_ws("\t", line, C("user_id").cast("string"))
    t.events.select(F.when(C("user_id") % 5 == 0, line).otherwise(full)).write.text(path)
    return D.read_tsv(t.spark, path, ["event_id", "kind", "remark"])


CUSTOMER_KINDS = {
    "c_custkey": "int", "c_name": "text", "c_nationkey": "int", "c_acctbal": "dec(18,2)",
    "note": "text",
}
NOTE_SQL = "replace(c_mktsegment, 'U', '''') || ', (\"' || c_nationkey || '\"); x'"


def noted_customers(t):
    """Customers with a text that holds quotes, brackets, commas and a semicolon."""
    quoted = F.replace("c_mktsegment", F.lit("U"), F.lit("'"))
    return t.customer.select(
        "c_custkey", "c_name", "c_nationkey", money("c_acctbal").alias("c_acctbal"),
        F.concat(quoted, F.lit(', ("'), C("c_nationkey").cast("string"), F.lit('"); x')).alias(
            "note"
        ),
    )


@query(
    "src_sql_dump",
    f"SELECT c_custkey, c_name, c_nationkey, CAST(c_acctbal AS DECIMAL(18,2)) AS c_acctbal,"
    f" {NOTE_SQL} AS note FROM customer",
)
def sql_dump(t):
    path = work_folder(t.spark, "customer-dump")
    dumps.write_dump(noted_customers(t), path, "customer", CUSTOMER_KINDS)
    return dumps.read_inserts(
        t.spark, path, "customer",
        "c_custkey bigint, c_name string, c_nationkey int, c_acctbal decimal(18,2), note string",
    )


@query(
    "src_sql_dump_texts",
    "SELECT doc_id, replace(text, '. ', ';' || chr(10) || '''') AS text, lang FROM documents",
)
def sql_dump_texts(t):
    """Texts that hold statement ends and quotes; statements are found over byte ranges."""
    path = work_folder(t.spark, "document-dump")
    ended = F.replace("text", F.lit(". "), F.lit(";\n'"))
    rows = spread(t.documents.select("doc_id", ended.alias("text"), "lang"))
    kinds = {"doc_id": "int", "text": "text", "lang": "text"}
    dumps.write_dump(rows, path, "document", kinds, "mysql")
    schema = "doc_id bigint, text string, lang string"
    return dumps.read_inserts(t.spark, path, "document", schema, None, "mysql")


@query(
    "src_csv_multiline",
    "SELECT CAST(doc_id AS VARCHAR) AS doc_id, replace(text, '. ', '\"' || chr(10) || ',') AS text"
    " FROM documents",
)
def csv_multiline(t):
    """Quoted fields with line breaks, quotes and commas, from files that many tasks read."""
    path = work_folder(t.spark, "document-csv")
    broken = F.replace("text", F.lit(". "), F.lit('"\n,'))
    spread(t.documents.select("doc_id", broken.alias("text"))).write.csv(
        path, header=True, escape='"', quoteAll=True,
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    )
    return D.read_csv_records(t.spark, path)


@query(
    "snk_sql_dump",
    "SELECT '  (' || c_custkey || ', ''' || c_name || ''', ' || c_nationkey || ', ' ||"
    f" CAST(c_acctbal AS DECIMAL(18,2)) || ', ''' || replace({NOTE_SQL}, '''', '''''') || ''')'"
    " AS line FROM customer",
)
def sql_dump_sink(t):
    """The written tuples; how rows fall into statements depends on the partitions."""
    path = work_folder(t.spark, "dump-out")
    dumps.write_dump(noted_customers(t), path, "customer", CUSTOMER_KINDS)
    tuples = t.spark.read.text(path).filter(~C("value").startswith("INSERT INTO"))
    return tuples.select(F.regexp_replace("value", r"[,;]$", "").alias("line"))


@query(
    "src_line_rewrite",
    "SELECT doc_id, line FROM (SELECT doc_id, regexp_replace(regexp_replace(unnest(string_split("
    "text, chr(10))), 'the', 'THE', 'g'), '[0-9]+', '#', 'g') AS line FROM documents)"
    " WHERE NOT regexp_matches(line, '^\\s*$') AND NOT regexp_matches(line, 'License')",
)
def line_rewrite(t):
    """Lines of all documents: two replacements in order, then blank and license lines dropped."""
    texts = spread(t.documents.select("doc_id", "text"))
    lines = texts.select("doc_id", F.explode(F.split("text", "\n", -1)).alias("line"))
    return dumps.rewrite_lines(
        lines, [("the", "THE"), ("[0-9]+", "#")], [r"^\s*$", "License"], column="line"
    )


@query(
    "src_project_synth_key",
    "SELECT row_number() OVER () AS id, l_orderkey AS booking, l_partkey AS room,"
    " CAST(NULL AS VARCHAR) AS remark FROM lineitem",
)
def project_synth_key(t):
    """Source order gives 1..N; a target column the source lacks is NULL."""
    rows = t.lineitem.select(C("l_orderkey").alias("booking"), C("l_partkey").alias("room"))
    return dense_row_numbers(rows, "id").withColumn("remark", F.lit(None).cast("string"))


@query(
    "src_concat",
    "SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment FROM customer UNION ALL"
    " SELECT s_suppkey, s_name, NULL FROM supplier",
)
def concat(t):
    left = t.customer.select(
        C("c_custkey").alias("id"), C("c_name").alias("name"), C("c_mktsegment").alias("segment")
    )
    right = t.supplier.select(C("s_suppkey").alias("id"), C("s_name").alias("name"))
    return left.unionByName(right, allowMissingColumns=True)


BOUNDS = sinks.year_half_quarter_bounds(1997, 2000)
PERIOD_SQL = (
    "CASE "
    + " ".join(f"WHEN l_shipdate < DATE '{end}' THEN '{name}'" for name, end in BOUNDS)
    + " ELSE 'OUT_OF_RANGE' END"
)


@query(
    "snk_range_partition",
    f"SELECT 'sales' AS fact, {PERIOD_SQL} AS period, COUNT(*) AS n,"
    " CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS total FROM lineitem"
    " GROUP BY 2 UNION ALL SELECT 'payments', CASE WHEN year(o_orderdate) BETWEEN 1996 AND 1997"
    " THEN strftime(o_orderdate, '%Y-%m') ELSE 'OUT_OF_RANGE' END, COUNT(*),"
    " CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(28,2)) FROM orders GROUP BY 2",
)
def range_partition(t):
    """Sales by year, half and quarter without a lower bound; payments by month within two years."""
    facts = {
        "sales": (
            t.lineitem.select("l_shipdate", money("l_extendedprice").alias("v")),
            sinks.period_column(F.to_date("l_shipdate"), BOUNDS),
        ),
        "payments": (
            t.orders.select("o_orderdate", money("o_totalprice").alias("v")),
            sinks.period_column(
                F.to_date("o_orderdate"), sinks.month_bounds(1996, 1997), "1996-01-01"
            ),
        ),
    }
    parts = []
    for name, (rows, period) in facts.items():
        path = work_folder(t.spark, name)
        sinks.write_by_period(rows, path, period)
        stored = t.spark.read.schema("v decimal(18,2), period string").parquet(path)
        parts.append(
            stored.groupBy("period")
            .agg(row_count().alias("n"), F.sum("v").cast("decimal(28,2)").alias("total"))
            .select(F.lit(name).alias("fact"), "period", "n", "total")
        )
    return reduce(DataFrame.unionByName, parts)


@query(
    "snk_append",
    "SELECT o_orderstatus, COUNT(*) * 2 AS n FROM orders GROUP BY o_orderstatus",
)
def snk_append(t):
    path = work_folder(t.spark, "appended")
    for _ in range(2):
        sinks.append(t.orders, path)
    stored = t.spark.read.schema(SCHEMAS["orders"]).parquet(path)
    return stored.groupBy("o_orderstatus").agg(row_count().alias("n"))


@query(
    "snk_ctas_temp",
    "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders"
    " GROUP BY o_custkey HAVING COUNT(*) > 12)",
)
def ctas_temp(t):
    """The intermediate table is a DataFrame: nothing is stored, nothing has to be dropped."""
    frequent = t.orders.groupBy("o_custkey").agg(row_count().alias("n")).filter("n > 12")
    return t.customer.join(frequent, C("c_custkey") == C("o_custkey"), "left_semi").select(
        "c_custkey", "c_name"
    )
