"""Trigger jobs run over whole tables as streams of files."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakemill.functions.text import inverted_index
from lakemill.operators.relational import money, money_sum, row_count
from lakemill.plans.registry import query
from lakemill.plans.textvec import TOKENS_SQL
from lakemill.session import SCHEMAS, work_folder
from lakemill.sources.sinks import month_bounds, period_column
from lakemill.streaming import jobs as J

C = F.col


def stream(t, name):
    """A file stream takes a folder or a pattern, so the table's name is given as a pattern that
    fits a single file and a folder of files alike."""
    return J.read_files(t.spark, f"{t.dir}/{name}[.]parquet", SCHEMAS[name])


# Events as changes of a text per user, in three parts that overlap in time: sign-ups insert,
# errors delete, larger purchases move the row to another key, all others update.
PARTS = 3
CHANGES_SQL = (
    f"SELECT event_id AS seq, event_id % {PARTS} AS part, user_id AS key, CASE event_type WHEN"
    " 'signup' THEN 'insert' WHEN 'error' THEN 'delete' ELSE 'update' END AS op, CASE WHEN"
    " event_type = 'purchase' AND value > 60 THEN user_id + 1000000 ELSE user_id END AS new_key,"
    " CASE WHEN event_type = 'click' AND value > 10 THEN NULL WHEN event_type = 'view' AND value < 5"
    " THEN props ELSE event_type END AS old_text, props AS text FROM events"
)
COPY_SQL = (
    f"WITH c AS ({CHANGES_SQL}), e AS (SELECT key, seq, part, text, CASE op WHEN 'insert' THEN 'in'"
    " WHEN 'delete' THEN 'out' ELSE 'set' END AS kind FROM c WHERE op <> 'update' OR (key = new_key"
    " AND old_text <> text) UNION ALL SELECT key, seq, part, text, 'out' FROM c WHERE op = 'update'"
    " AND key <> new_key UNION ALL SELECT new_key, seq, part, text, 'in' FROM c WHERE op = 'update'"
    " AND key <> new_key), base AS (SELECT * FROM e WHERE kind <> 'set' QUALIFY row_number() OVER"
    " (PARTITION BY key ORDER BY seq DESC) = 1), change AS (SELECT * FROM e WHERE kind = 'set'"
    " QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1), copy AS (SELECT b.key,"
    " CASE WHEN c.seq > b.seq THEN c.text ELSE b.text END AS text, CASE WHEN c.seq > b.seq THEN"
    " greatest(b.part, c.part) ELSE b.part END AS changed_in FROM base b LEFT JOIN change c ON"
    " c.key = b.key WHERE b.kind = 'in')"
)


def text_changes(t):
    kind, value, user = C("event_type"), C("value"), C("user_id")
    moved = (kind == "purchase") & (value > 60)
    return t.events.select(
        C("event_id").alias("seq"),
        user.alias("key"),
        F.when(kind == "signup", "insert").when(kind == "error", "delete").otherwise("update")
        .alias("op"),
        F.when(moved, user + 1000000).otherwise(user).alias("new_key"),
        F.when((kind == "click") & (value > 10), None)
        .when((kind == "view") & (value < 5), C("props"))
        .otherwise(kind)
        .alias("old_text"),
        C("props").alias("text"),
    )


def in_parts(t, rows, part, run):
    """Write the parts of `rows` one after another into a folder and call `run(stream)` after
    each: a job that stops and starts again, a batch a part."""
    source = work_folder(t.spark, "arriving")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    for i in range(PARTS):
        rows.filter(part == i).write.mode("append").parquet(source)
        run(J.read_files(t.spark, source, schema))


def synced(t, purpose):
    output = work_folder(t.spark, purpose)
    in_parts(t, text_changes(t), C("seq") % PARTS, lambda s: J.sync_text(s, output))
    return J.read_copy(t.spark, output)


@query("stm_sync_text", f"{COPY_SQL} SELECT key, text FROM copy")
def sync_text(t):
    return synced(t, "sync-text").select("key", "text")


@query("stm_touch_updated", f"{COPY_SQL} SELECT key, CAST(changed_in AS BIGINT) AS changed_in FROM copy")
def touch_updated(t):
    """Every row carries the number of the batch that last changed it."""
    return synced(t, "touched").select("key", "changed_in")


@query(
    "stm_token_index",
    f"SELECT token, COUNT(DISTINCT doc_id) AS documents, COUNT(*) AS hits FROM ({TOKENS_SQL})"
    " GROUP BY token",
)
def token_index(t):
    """Postings stored as documents arrive; document counts read from the stored postings."""
    output = work_folder(t.spark, "token-index")
    J.derive(stream(t, "documents"), output, lambda b: inverted_index(b, "doc_id", "text"))
    postings = J.read_batches(t.spark, output, "token string, doc_id bigint, hits bigint")
    return postings.groupBy("token").agg(
        row_count().alias("documents"), F.sum("hits").alias("hits")
    )


ALLOWED_DAYS = 365


def payments(orders):
    return orders.select("o_orderkey", "o_orderdate", money("o_totalprice").alias("amount"))


def paid_in():
    return period_column(F.to_date("o_orderdate"), month_bounds(1996, 1999), "1996-01-01")


@query(
    "stm_monthly_payments",
    "SELECT CASE WHEN year(o_orderdate) BETWEEN 1996 AND 1999 THEN strftime(o_orderdate, '%Y-%m')"
    " ELSE 'OUT_OF_RANGE' END AS period, COUNT(*) AS n, CAST(SUM(CAST(o_totalprice AS"
    " DECIMAL(18,2))) AS DECIMAL(28,2)) AS amount FROM orders GROUP BY 1",
)
def monthly_payments(t):
    """Late rows belong to their period as well; they only stand in folders of their own."""
    output = work_folder(t.spark, "payments")
    paid = payments(stream(t, "orders"))
    J.partition_on_time(paid, output, paid_in(), "o_orderdate", ALLOWED_DAYS)
    return (
        J.read_placed(t.spark, output, paid.schema)
        .groupBy("period")
        .agg(row_count().alias("n"), F.sum("amount").cast("decimal(28,2)").alias("amount"))
    )


LATE_SQL = (
    f"WITH p AS (SELECT o_orderkey % {PARTS} AS batch, o_orderdate, CAST(o_totalprice AS"
    " DECIMAL(18,2)) AS amount FROM orders), marks AS (SELECT b.batch, (SELECT max(o_orderdate)"
    " FROM p WHERE p.batch < b.batch) AS mark FROM (SELECT DISTINCT batch FROM p) b)"
    f" SELECT CAST(p.batch AS BIGINT) AS batch, coalesce(o_orderdate < mark - INTERVAL {ALLOWED_DAYS} DAY,"
    " FALSE) AS late, COUNT(*) AS n, CAST(SUM(amount) AS DECIMAL(28,2)) AS amount FROM p JOIN marks"
    " USING (batch) GROUP BY 1, 2"
)


@query("stm_late_payments", LATE_SQL)
def late_payments(t):
    """Payments that come in parts: those before the watermark of their batch, counted aside."""
    output = work_folder(t.spark, "late-payments")
    paid = payments(t.orders)

    def run(part):
        J.partition_on_time(part, output, paid_in(), "o_orderdate", ALLOWED_DAYS)

    in_parts(t, paid, C("o_orderkey") % PARTS, run)
    return (
        J.read_placed(t.spark, output, paid.schema)
        .groupBy("batch", "late")
        .agg(row_count().alias("n"), F.sum("amount").cast("decimal(28,2)").alias("amount"))
    )


@query(
    "stm_incremental_mv",
    "SELECT strftime(l_shipdate, '%Y-%m') AS month, CAST(SUM(CAST(l_extendedprice AS"
    " DECIMAL(18,2))) AS DECIMAL(28,2)) AS dollars, CAST(SUM(CAST(l_quantity AS BIGINT)) AS"
    " BIGINT) AS quantity FROM lineitem GROUP BY 1",
)
def incremental_mv(t):
    output = work_folder(t.spark, "month-sales")
    J.running_sums(
        stream(t, "lineitem"),
        output,
        [F.date_format("l_shipdate", "yyyy-MM").alias("month")],
        {
            "dollars": money_sum("l_extendedprice"),
            "quantity": F.sum(C("l_quantity").cast("bigint")),
        },
    )
    schema = "month string, dollars decimal(28,2), quantity bigint"
    return J.read_totals(t.spark, output, schema, ["month"])
