"""Scalar functions applied to whole columns of the generated tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakemill.functions import scalars as S
from lakemill.plans.registry import query

C = F.col
DAY = "CAST(o_orderdate AS DATE)"


@query(
    "fn_concat",
    "SELECT c_custkey, c_name || ' ' || c_mktsegment AS strict_name, concat_ws(' ', c_name,"
    " nullif(c_mktsegment, 'BUILDING')) AS loose_name,"
    " c_name || ' ' || nullif(c_mktsegment, 'BUILDING') AS null_name FROM customer",
)
def fn_concat(t):
    """`concat` gives NULL for any NULL part; `concat_ws` skips it."""
    segment = F.nullif("c_mktsegment", F.lit("BUILDING"))
    return t.customer.select(
        "c_custkey",
        F.concat("c_name", F.lit(" "), "c_mktsegment").alias("strict_name"),
        F.concat_ws(" ", "c_name", segment).alias("loose_name"),
        F.concat("c_name", F.lit(" "), segment).alias("null_name"),
    )


@query(
    "fn_upper_lower_substr",
    "SELECT p_partkey, upper(substr(p_name, 1, 1)) || lower(substr(p_name, 2)) AS nice FROM part",
)
def fn_upper_lower_substr(t):
    return t.part.select("p_partkey", S.sentence_case("p_name").alias("nice"))


@query(
    "fn_length",
    "SELECT doc_id, CAST(length(text) AS INTEGER) AS chars, CAST(strlen(text) AS INTEGER) AS bytes"
    " FROM documents",
)
def fn_length(t):
    return t.documents.select(
        "doc_id", F.length("text").alias("chars"), F.octet_length("text").alias("bytes")
    )


@query("fn_trim", "SELECT p_partkey, trim('  ' || p_name || ' ') AS name FROM part")
def fn_trim(t):
    padded = F.concat(F.lit("  "), "p_name", F.lit(" "))
    return t.part.select("p_partkey", F.trim(padded).alias("name"))


@query(
    "fn_replace",
    "SELECT conv_id, turn, replace(text, '''', '''''') AS quoted,"
    " regexp_replace(replace(text, 'e', '\\e'), '\\\\(.)', '\\1', 'g') AS plain"
    " FROM conversations",
)
def fn_replace(t):
    slashed = F.replace("text", F.lit("e"), F.lit("\\e"))
    return t.conversations.select(
        "conv_id",
        "turn",
        F.replace("text", F.lit("'"), F.lit("''")).alias("quoted"),
        F.regexp_replace(slashed, r"\\(.)", "$1").alias("plain"),
    )


@query("fn_lower_names", "SELECT c_custkey AS key, c_name AS name FROM customer")
def fn_lower_names(t):
    loud = t.customer.select(C("c_custkey").alias("KEY"), C("c_name").alias("Name"))
    return loud.toDF(*[name.lower() for name in loud.columns])


@query(
    "fn_zfill_time",
    "SELECT o_orderkey, lpad(CAST(o_orderkey % 24 AS VARCHAR), 2, '0') || ':'"
    " || lpad(CAST(o_custkey % 60 AS VARCHAR), 2, '0') || ':00' AS at_time FROM orders",
)
def fn_zfill_time(t):
    raw = F.concat_ws(":", C("o_orderkey") % 24, C("o_custkey") % 60)
    return t.orders.select("o_orderkey", S.pad_time(raw).alias("at_time"))


@query("fn_date_part_cut", f"SELECT o_orderkey, {DAY} AS day FROM orders")
def fn_date_part_cut(t):
    raw = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    return t.orders.select("o_orderkey", S.date_part(raw).alias("day"))


@query("fn_make_date_text", f"SELECT o_orderkey, {DAY} AS arrival_date FROM orders")
def fn_make_date_text(t):
    d = "o_orderdate"
    parts = t.orders.select(
        "o_orderkey",
        F.year(d).alias("y"),
        F.date_format(d, "MMMM").alias("m"),
        F.dayofmonth(d).alias("d"),
    )
    return parts.select("o_orderkey", S.date_from_month_name("y", "m", "d").alias("arrival_date"))


@query("fn_month", "SELECT o_orderkey, CAST(month(o_orderdate) AS INTEGER) AS m FROM orders")
def fn_month(t):
    return t.orders.select("o_orderkey", F.month("o_orderdate").alias("m"))


@query("fn_year", "SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS y FROM orders")
def fn_year(t):
    return t.orders.select("o_orderkey", F.year("o_orderdate").alias("y"))


@query(
    "fn_month_start",
    f"SELECT o_orderkey, CAST(date_trunc('month', {DAY} - INTERVAL 3 MONTH) AS DATE) AS start"
    " FROM orders",
)
def fn_month_start(t):
    return t.orders.select("o_orderkey", S.month_start("o_orderdate", 3).alias("start"))


@query("fn_last_day", f"SELECT o_orderkey, last_day({DAY}) AS end_day FROM orders")
def fn_last_day(t):
    return t.orders.select("o_orderkey", F.last_day("o_orderdate").alias("end_day"))


@query(
    "fn_datediff",
    "SELECT event_id, CAST(date_diff('day', TIMESTAMP '2024-01-03 23:59:59', ts) AS INTEGER)"
    " AS days FROM events",
)
def fn_datediff(t):
    """Whole days between the date parts; the time of day does not count."""
    start = F.lit("2024-01-03 23:59:59").cast("timestamp_ntz")
    return t.events.select("event_id", F.datediff("ts", start).alias("days"))


@query(
    "fn_date_sub",
    f"SELECT o_orderkey, {DAY} - 7 AS days_before, CAST({DAY} - INTERVAL 2 MONTH AS DATE)"
    f" AS months_before, CAST({DAY} - INTERVAL 18 YEAR AS DATE) AS years_before FROM orders",
)
def fn_date_sub(t):
    d = F.to_date("o_orderdate")
    return t.orders.select(
        "o_orderkey",
        F.date_sub(d, 7).alias("days_before"),
        F.add_months(d, -2).alias("months_before"),
        F.add_months(d, -18 * 12).alias("years_before"),
    )


@query(
    "fn_interval_mul",
    "SELECT event_id, ts - TIMESTAMP '2024-01-01 00:00:00' > user_id * INTERVAL 1 DAY AS overdue"
    " FROM events",
)
def fn_interval_mul(t):
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    allowed = F.make_dt_interval(C("user_id").cast("int"))
    return t.events.select("event_id", (C("ts") - start > allowed).alias("overdue"))


@query("fn_date_cast", "SELECT event_id, CAST(ts AS DATE) AS day FROM events")
def fn_date_cast(t):
    return t.events.select("event_id", F.to_date("ts").alias("day"))


@query(
    "fn_current",
    f"SELECT o_orderkey, CAST(date_diff('day', {DAY}, DATE '2002-01-01') AS INTEGER) AS age_days,"
    " TRUE AS clock_runs FROM orders",
)
def fn_current(t, as_of="2002-01-01"):
    """Dates that depend on today take the day as an argument, so results can be repeated."""
    today = F.lit(as_of).cast("date")
    return t.orders.select(
        "o_orderkey",
        F.datediff(today, "o_orderdate").alias("age_days"),
        (F.current_date() > today).alias("clock_runs"),
    )


@query("fn_str_to_date", f"SELECT o_orderkey, {DAY} AS d1, {DAY} AS d2 FROM orders")
def fn_str_to_date(t):
    dashed = F.upper(F.date_format("o_orderdate", "dd-MMM-yy"))
    # Two-digit years read as 20xx: move the 1990s back by a century.
    short = S.day_mon_yy(dashed)
    century = F.when(F.year("o_orderdate") < 2000, F.add_months(short, -1200)).otherwise(short)
    masked = F.date_format("o_orderdate", "yyyy-MM-dd")
    return t.orders.select(
        "o_orderkey", F.to_date(masked, "yyyy-MM-dd").alias("d1"), century.alias("d2")
    )


@query(
    "fn_make_time",
    "SELECT o_orderkey, printf('%02d:%02d:%02d', 8 + o_orderkey % 8, 30, 0) AS start_time"
    " FROM orders",
)
def fn_make_time(t):
    hours = (8 + C("o_orderkey") % 8).cast("int")
    return t.orders.select(
        "o_orderkey", S.time_text(hours, F.lit(30), F.lit(0)).alias("start_time")
    )


@query(
    "fn_round",
    "SELECT c_custkey, CAST(ROUND(CAST(c_acctbal AS DECIMAL(18,2)), 1) AS DECIMAL(18,1)) AS r"
    " FROM customer",
)
def fn_round(t):
    return t.customer.select(
        "c_custkey",
        F.round(C("c_acctbal").cast("decimal(18,2)"), 1).cast("decimal(18,1)").alias("r"),
    )


@query("fn_floor", "SELECT c_custkey, CAST(floor(c_acctbal) AS BIGINT) AS f FROM customer")
def fn_floor(t):
    return t.customer.select("c_custkey", F.floor("c_acctbal").alias("f"))


@query(
    "fn_coalesce",
    "SELECT c_custkey, coalesce(nullif(c_mktsegment, 'BUILDING'), c_name) AS address FROM customer",
)
def fn_coalesce(t):
    segment = F.nullif("c_mktsegment", F.lit("BUILDING"))
    return t.customer.select("c_custkey", F.coalesce(segment, "c_name").alias("address"))


@query(
    "fn_nullif_token",
    "SELECT p_partkey, CASE WHEN p_size % 7 <> 0 THEN CAST(p_size AS VARCHAR) END AS size"
    " FROM part",
)
def fn_nullif_token(t):
    raw = F.when(C("p_size") % 14 == 0, " NA ").when(C("p_size") % 7 == 0, "").otherwise(
        C("p_size").cast("string")
    )
    return t.part.select("p_partkey", S.null_tokens(raw).alias("size"))


@query(
    "fn_elt",
    "SELECT o_orderkey, CASE o_orderkey % 5 + 1 WHEN 1 THEN 'scheduled' WHEN 2 THEN 'running'"
    " WHEN 3 THEN 'postponed' WHEN 4 THEN 'completed' END AS state FROM orders",
)
def fn_elt(t):
    """Outside the list the result is NULL."""
    n = (C("o_orderkey") % 5 + 1).cast("int")
    states = F.array(*[F.lit(s) for s in ("scheduled", "running", "postponed", "completed")])
    return t.orders.select("o_orderkey", F.get(states, n - 1).alias("state"))


@query(
    "fn_cast_bool",
    "SELECT o_orderkey, o_orderstatus = 'F' AS flag, o_orderkey % 2 = 1 AS odd FROM orders",
)
def fn_cast_bool(t):
    text = F.when(C("o_orderstatus") == "F", " Yes").when(C("o_orderstatus") == "O", "no").otherwise(
        "0"
    )
    return t.orders.select(
        "o_orderkey", S.truthy(text).alias("flag"), S.truthy(C("o_orderkey") % 2).alias("odd")
    )


@query(
    "fn_cast_int",
    "SELECT p_partkey, TRY_CAST(CASE WHEN p_size % 9 = 0 THEN 'NA' ELSE CAST(p_size AS VARCHAR)"
    " END AS INTEGER) AS n FROM part",
)
def fn_cast_int(t):
    raw = F.when(C("p_size") % 9 == 0, "NA").otherwise(C("p_size").cast("string"))
    return t.part.select("p_partkey", raw.try_cast("int").alias("n"))


@query(
    "fn_cast_decimal",
    "SELECT p_partkey, CAST(CAST(p_retailprice AS VARCHAR) AS DECIMAL(18,2)) AS price FROM part",
)
def fn_cast_decimal(t):
    return t.part.select(
        "p_partkey", C("p_retailprice").cast("string").cast("decimal(18,2)").alias("price")
    )


@query("fn_cast_date", f"SELECT o_orderkey, {DAY} AS day FROM orders")
def fn_cast_date(t):
    return t.orders.select(
        "o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").cast("date").alias("day")
    )


@query(
    "fn_key_value",
    "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey",
)
def fn_key_value(t):
    """Keys that arrive as padded text on one side and as numbers on the other."""
    text_keys = t.orders.select(
        "o_orderkey", F.concat(F.lit(" 0"), C("o_custkey").cast("string")).alias("k")
    )
    return text_keys.join(
        t.customer, S.key_value("k", "int") == S.key_value("c_custkey", "int")
    ).select("o_orderkey", "c_name")


@query(
    "fn_json_path",
    "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,"
    " json_extract_string(props, '$.missing') AS missing FROM events",
)
def fn_json_path(t):
    return t.events.select(
        "event_id",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
        F.get_json_object("props", "$.missing").alias("missing"),
    )


@query(
    "fn_is_json",
    "SELECT event_id, event_type <> 'error' AS valid FROM events",
)
def fn_is_json(t):
    broken = F.when(C("event_type") == "error", F.substring("props", 1, 4)).otherwise(C("props"))
    return t.events.select("event_id", S.is_json(broken).alias("valid"))


@query(
    "fn_array_members",
    "SELECT p_partkey, list_contains(string_split(p_name, ' '), 'bolt') AS is_bolt FROM part",
)
def fn_array_members(t):
    return t.part.select(
        "p_partkey", F.array_contains(F.split("p_name", " "), "bolt").alias("is_bolt")
    )


@query(
    "fn_struct_field",
    "SELECT s_suppkey, CAST(s_nationkey AS DOUBLE) AS latitude, s_acctbal AS longitude"
    " FROM supplier",
)
def fn_struct_field(t):
    placed = t.supplier.select(
        "s_suppkey",
        F.struct(
            C("s_nationkey").cast("double").alias("latitude"), C("s_acctbal").alias("longitude")
        ).alias("coordinates"),
    )
    return placed.select("s_suppkey", "coordinates.latitude", "coordinates.longitude")


@query(
    "fn_uuid",
    "SELECT COUNT(*) AS n, COUNT(*) AS well_formed FROM customer",
)
def fn_uuid(t):
    """Random ids cannot be compared; their number and form can."""
    ids = t.customer.select(F.uuid().alias("id"))
    form = "^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$"
    return ids.agg(
        F.count("id").alias("n"), F.count(F.when(C("id").rlike(form), 1)).alias("well_formed")
    )


@query(
    "fn_rand",
    "SELECT o_orderkey, TRUE AS in_range FROM orders",
)
def fn_rand(t):
    scaled = F.floor(F.lit(10000000) + F.rand(7) * 89999999)
    return t.orders.select("o_orderkey", scaled.between(10000000, 99999999).alias("in_range"))


@query(
    "fn_time_of_day",
    "SELECT event_id, strftime(ts, '%H:%M:%S') AS at_time FROM events"
    " WHERE strftime(ts, '%H:%M:%S') BETWEEN '09:00:00' AND '17:30:00'",
)
def fn_time_of_day(t):
    """Padded HH:mm:ss text sorts as time does."""
    at = F.date_format("ts", "HH:mm:ss")
    return t.events.select("event_id", at.alias("at_time")).filter(
        C("at_time").between("09:00:00", "17:30:00")
    )
