"""NULL keys, ties, empty inputs, dirty text and skewed groups."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from lakemill.functions import scalars as S
from lakemill.functions import vectors
from lakemill.functions.text import inverted_index, search, search_index
from lakemill.functions.vectors import top_k
from lakemill.operators import changes as H
from lakemill.operators import hierarchy
from lakemill.operators import lookups as L
from lakemill.operators import quality as Q
from lakemill.operators.hierarchy import resolve_roots
from lakemill.operators.lists import distinct_list, truncated_list
from lakemill.operators.olap import determines, rollup_along, time_dimension
from lakemill.operators.periods import join_periods, valid_on
from lakemill.operators.relational import (
    dense_row_numbers,
    first_in_source_order,
    latest_per_key,
    money_sum,
    with_group_values,
)
from lakemill.session import materialise, work_folder
from lakemill.sources import delimited, dumps, sinks


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def folder(spark, purpose="test"):
    return work_folder(spark, purpose)


# ------------------------------------------------------------------------------- lists


def brute_truncated(items, limit):
    text, used = "", 0
    for i, item in enumerate(items):
        longer = item if i == 0 else f"{text}, {item}"
        if len(longer.encode()) > limit:
            break
        text, used = longer, i + 1
    if used == len(items):
        return text
    return f"{text}{', ' if used else ''}...({len(items) - used})"


@pytest.mark.parametrize("limit", [12, 60, 4000])
def test_truncated_list_matches_brute_force(spark, limit):
    rng = random.Random(3)
    groups = {
        g: ["x" * rng.randint(0, 9) + "é" * rng.randint(0, 2) for _ in range(n)]
        for g, n in {"hot": 3000, "a": 1, "b": 7, "c": 40}.items()
    }
    data = [(g, i, v) for g, items in groups.items() for i, v in enumerate(items)]
    df = spark.createDataFrame(data, "g string, pos int, v string").repartition(5)
    got = {r.g: r["items"] for r in truncated_list(df, ["g"], "v", ["pos"], limit).collect()}
    assert got == {g: brute_truncated(items, limit) for g, items in groups.items()}


@pytest.mark.parametrize("partitions", [1, 9])
def test_truncated_list_of_a_group_over_many_tasks(spark, partitions):
    """One group holds most rows; NULL and text keys; batches smaller than a group."""
    rng = random.Random(6)
    data = [("hot" if i % 5 else None, i % 3, i, rng.choice(["é" * (i % 4), None, "abc", ""])) for i in range(2000)]
    want = {}
    for g, h, _, v in sorted(data, key=lambda r: r[2]):
        want.setdefault((g, h), []).append(v)
    want = {k: brute_truncated([v for v in vs if v is not None], 700) for k, vs in want.items()}
    df = spark.createDataFrame(data, "g string, h int, pos int, v string").repartition(5)
    names = ("spark.sql.shuffle.partitions", "spark.sql.execution.arrow.maxRecordsPerBatch")
    before = [spark.conf.get(n) for n in names]
    for n, v in zip(names, (partitions, 50), strict=True):
        spark.conf.set(n, str(v))
    try:
        got = {(r.g, r.h): r["items"] for r in truncated_list(df, ["g", "h"], "v", ["pos"], 700).collect()}
    finally:
        for n, v in zip(names, before, strict=True):
            spark.conf.set(n, v)
    assert got == want


def test_truncated_list_reads_its_source_once(spark):
    path = folder(spark)
    spark.createDataFrame([("a", 1, "x")], "g string, p int, v string").write.parquet(path)
    df = spark.read.schema("g string, p int, v string").parquet(path)
    plan = truncated_list(df, ["g"], "v", ["p"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("rangepartitioning") == 1


def test_truncated_list_skips_nulls_and_keeps_null_groups(spark):
    df = spark.createDataFrame(
        [("a", 1, None), ("a", 2, "x"), ("b", 1, None), (None, 1, "y")], "g string, p int, v string"
    )
    assert rows(truncated_list(df, ["g"], "v", ["p"])) == [("a", "x"), ("b", None), (None, "y")]


def test_distinct_list(spark):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (1, "b"), (2, None)], "k int, v string")
    assert rows(distinct_list(df, ["k"], "v")) == [(1, "a, b"), (2, None)]


# ------------------------------------------------------------------- keys and positions


def test_dense_numbers_over_many_files(spark):
    path = folder(spark)
    spark.range(1000).repartition(7).write.parquet(path)
    numbered = dense_row_numbers(spark.read.parquet(path), "n")
    assert sorted(r.n for r in numbered.collect()) == list(range(1, 1001))


def test_first_in_source_order(spark):
    path = folder(spark)
    data = [(i, i % 5 if i % 3 else 0) for i in range(500)]
    spark.createDataFrame(data, "i int, k int").coalesce(1).write.parquet(path)
    want = {}
    for i, k in data:
        want.setdefault(k, i)
    got = first_in_source_order(spark.read.parquet(path), ["k"])
    assert {r.k: r.i for r in got.collect()} == want


def test_latest_per_key_takes_one_row_on_ties(spark):
    df = spark.createDataFrame([(1, 5, "a"), (1, 5, "b"), (None, 1, "c")], "k int, t int, v string")
    got = latest_per_key(df, ["k"], [F.desc("t"), F.asc("v")])
    assert rows(got) == [(1, 5, "a"), (None, 1, "c")]


def test_latest_per_key_limits_before_the_shuffle(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("k"), "id")
    plan = latest_per_key(df, ["k"], [F.desc("id")])._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_group_values_keep_null_groups(spark):
    df = spark.createDataFrame([(1, 2), (1, 4), (None, 7)], "k int, v int")
    got = with_group_values(df, ["k"], F.avg("v").alias("m"))
    assert rows(got) == [(1, 2, 3.0), (1, 4, 3.0), (None, 7, 7.0)]


def test_money_sum_is_exact_and_signed(spark):
    values = [0.1] * 10 + [-19999999.99, 1234567.89, None]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert str(df.agg(money_sum("v")).first()[0]) == "-18765431.10"
    assert df.filter("v > 1e9").agg(money_sum("v")).first()[0] is None


# ---------------------------------------------------------------------------- scalars


def test_scalars(spark):
    df = spark.createDataFrame(
        [("9:00", " na ", "Yes ", "25-DEC-22", "2023-02-02T10:00"), (None,) * 5],
        "t string, n string, b string, d string, s string",
    )
    got = df.select(
        S.pad_time("t"), S.null_tokens("n"), S.truthy("b"), S.day_mon_yy("d"), S.date_part("s"),
        S.sentence_case(F.lit("hELLO wORLD")), S.is_json(F.lit("{bad")),
        S.key_value(F.lit(" 01"), "int") == S.key_value(F.lit(1), "int"),
    )
    first, second = [tuple(r) for r in got.collect()]
    assert first == (
        "09:00:00", "na", True, dt.date(2022, 12, 25), dt.date(2023, 2, 2), "Hello world", False,
        True,
    )
    assert second[:5] == (None,) * 5


def test_null_tokens(spark):
    df = spark.createDataFrame([("",), (" NA",), ("NULL",), ("null ",), ("x ",)], "v string")
    assert [r[0] for r in df.select(S.null_tokens("v")).collect()] == [None] * 4 + ["x"]


# -------------------------------------------------------------------------- sources


def test_tsv_short_rows_and_empty_fields(spark):
    path = folder(spark)
    lines = [("a\t\\N\tx",), ("b\t",), ("c",), ("d\t\t\\q",)]
    spark.createDataFrame(lines, "value string").coalesce(1).write.text(path)
    df = delimited.read_tsv(spark, path, ["p", "q", "r"])
    assert rows(df) == [("a", None, "x"), ("b", "", None), ("c", None, None), ("d", "", "\\q")]
    assert rows(delimited.backslash_fields(df)) == [("p", 0), ("q", 0), ("r", 1)]


def test_staged_csv_drops_blank_rows_and_fails_on_bad_casts(spark):
    path = folder(spark)
    text = 'id,name,price\n 1 ,"a, b", 2.50 \n,,\n2\n'
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)
    df = delimited.read_staged_csv(spark, path, "id int, name string, price decimal(8,2)")
    assert [(r.id, r.name, str(r.price)) for r in df.orderBy("id").collect()] == [
        (1, "a, b", "2.50"), (2, None, "None")
    ]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        delimited.read_staged_csv(spark, path, "id int, name int").collect()


DUMP = r"""-- a comment
INSERT INTO `book` (id, title, `price`, sold) VALUES
  (1, 'It''s (so), good', 9.5, 'yes'),
  (2, "say ""hi""; now", NULL, 0),
  (3, 'back\'s \\ slash', -1, 'no');
INSERT INTO other (id) VALUES (9);
/* a longer
   comment; */
# another

INSERT INTO book (title, id) VALUES ('', 4);
GO
insert into book values (5, 'positional', 2, 1);
"""


def test_dump_reader(spark):
    path = folder(spark)
    spark.createDataFrame([(DUMP,)], "value string").coalesce(1).write.text(path)
    df = dumps.read_inserts(
        spark, path, "book", "id int, title string, price double, sold boolean"
    )
    assert sorted((tuple(r) for r in df.collect())) == [
        (1, "It's (so), good", 9.5, True),
        (2, 'say "hi"; now', None, False),
        (3, "back's \\ slash", -1.0, False),
        (4, "", None, None),
        (5, "positional", 2.0, True),
    ]


@pytest.mark.parametrize("dialect", ["postgres", "mysql"])
def test_dump_round_trip_of_awkward_texts(spark, dialect):
    rng = random.Random(11)
    pool = "a'\"(),;\\é\t NULL%_"
    # Only the dialect that escapes a backslash can carry one through the reader.
    pool = pool if dialect == "mysql" else pool.replace("\\", "")
    data = [(i, "".join(rng.choice(pool) for _ in range(rng.randint(1, 30)))) for i in range(900)]
    data = [(i, f"<{v}>") for i, v in data] + [(900, "two\nlines; here"), (901, None)]
    df = spark.createDataFrame(data, "id int, v string").repartition(3)
    path = folder(spark)
    dumps.write_dump(df, path, "t", {"id": "int", "v": "text"}, dialect, batch=50)
    assert sorted(rows(dumps.read_inserts(spark, path, "t", "id int, v string"))) == sorted(data)


def test_dump_that_is_cut_inside_a_text_fails(spark):
    path = folder(spark)
    text = "INSERT INTO t (id, v) VALUES (1, 'x;\ny'), (2, 'z');\n"
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)
    with pytest.raises(Exception, match="not a list of tuples"):
        dumps.read_inserts(spark, path, "t", "id int, v string").collect()


def test_named_csv_with_line_breaks_and_missing_columns(spark):
    path = folder(spark)
    text = '\ufeffID, Name \n1,"two\nlines, ""quoted"""\n2, NA\n'
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)
    got = delimited.read_named_csv(spark, path, ["key", "name", "gone"], {"id": "key"}, True)
    assert rows(got) == [("1", 'two\nlines, "quoted"', None), ("2", None, None)]


KINDS = {"id": "int", "title": "text", "on_day": "date", "at": "time", "ok": "bool", "p": "dec(8,2)"}
VALUES = "(7, 'a''b\\c', '2023-02-02', '09:00:00', TRUE, 1.50)"


@pytest.mark.parametrize(
    ("dialect", "want"),
    [
        ("postgres", VALUES),
        ("mysql", VALUES.replace("\\", "\\\\").replace("TRUE", "1")),
        ("mssql", VALUES.replace("'a", "N'a").replace("TRUE", "1")),
        ("oracle", VALUES.replace("'2023-02-02'", "TO_DATE('2023-02-02','YYYY-MM-DD')").replace(
            "TRUE", "1")),
    ],
)
def test_dump_literals_per_dialect(spark, dialect, want):
    df = spark.createDataFrame(
        [(7, "a'b\\c", "2023-02-02 00:00:00", "9:00", "t", "1.50")],
        "id int, title string, on_day string, at string, ok string, p string",
    )
    text = dumps.insert_statements(df, "x", KINDS, dialect).first()[0]
    assert want in text


def test_dump_batches(spark):
    df = spark.range(1050).select("id", F.lit("").alias("note")).coalesce(1)
    made = dumps.insert_statements(df, "t", {"id": "int", "note": "text"}).collect()
    assert [r.value.count("\n  (") for r in made] == [500, 500, 50]
    assert "(0, NULL)" in made[0].value
    small = dumps.insert_statements(df, "t", {"id": "int"}, "oracle").collect()
    assert [r.value.count("INTO t") for r in small] == [100] * 10 + [50]


def test_line_rewrite_and_range(spark):
    lines = spark.createDataFrame(
        [(1, "keep a.b"), (2, "BEGIN x"), (3, "inner"), (4, "END x"), (5, "drop me")],
        "n int, value string",
    )
    cleaned = dumps.rewrite_lines(lines, [(r"a\.", "c.")], ["^drop"])
    assert [r.value for r in dumps.drop_line_range(cleaned, "n", "^BEGIN", "^END").collect()] == [
        "keep c.b"
    ]
    assert dumps.require_matches(lines, "inner") == 1
    with pytest.raises(ValueError, match="matches 0 lines"):
        dumps.require_matches(lines, "absent")


def test_period_bounds_are_half_open(spark):
    days = ["1996-12-31", "1997-01-01", "1997-06-30", "1997-07-01", "1998-04-01", "2000-12-31",
            "2001-01-01"]
    df = spark.createDataFrame([(d,) for d in days], "d string")
    period = sinks.period_column(
        F.col("d").cast("date"), sinks.year_half_quarter_bounds(1997, 2000)
    )
    assert [r[0] for r in df.select(period).collect()] == [
        "before_1997", "h1_1997", "h1_1997", "h2_1997", "q2_1998", "q4_2000", "OUT_OF_RANGE"
    ]


# -------------------------------------------------------------------------- quality


def test_orphans_null_keys_pass_and_types_meet(spark):
    parent = Q.Relation(spark.createDataFrame([(1,), (2,)], "id int"))
    child = Q.Relation(
        spark.createDataFrame([("1", 10), (" 2", 11), ("3", 12), (None, 13), ("", 14)],
                              "ref string, n int"),
        types={"ref": "int"},
    )
    kept, orphans = Q.split_orphans(child, ["ref"], parent, ["id"])
    assert sorted(r.n for r in kept.collect()) == [10, 11, 13, 14]
    assert [r.n for r in orphans.collect()] == [12]


def cycle(spark):
    """a -> b -> a: dropping one row makes another an orphan."""
    a = spark.createDataFrame([(1, 1), (2, 2), (3, None)], "id int, b_id int")
    b = spark.createDataFrame([(1, 3), (2, 9)], "id int, a_id int")
    return {
        "a": Q.Relation(a, ["id"], [(["b_id"], "b", ["id"])]),
        "b": Q.Relation(b, ["id"], [(["a_id"], "a", ["id"])]),
    }


def test_orphan_cycle_one_pass_and_until_stable(spark):
    once, _ = Q.drop_orphans(cycle(spark))
    assert sorted(r.id for r in once["a"].rows.collect()) == [1, 2, 3]
    assert [r.id for r in once["b"].rows.collect()] == [1]
    stable, _ = Q.drop_orphans(cycle(spark), until_stable=True)
    assert sorted(r.id for r in stable["a"].rows.collect()) == [1, 3]


def test_dedupe_first_wins(spark):
    df = spark.createDataFrame(
        [("1", 1, "a"), (" 01", 2, "b"), ("2", 3, "c"), (None, 4, "d"), (None, 5, "e")],
        "k string, pos int, v string",
    )
    kept, dropped = Q.dedupe_pk(Q.Relation(df, ["k"], types={"k": "int"}, position=["pos"]))
    assert sorted(r.v for r in kept.collect()) == ["a", "c", "d"]
    assert sorted((r.k, r.dropped) for r in dropped.filter("k IS NOT NULL").collect()) == [(1, 1)]


def test_checks_let_unknown_pass(spark):
    df = spark.createDataFrame([(1, 5), (2, None), (3, -1)], "id int, v int")
    assert [r.id for r in Q.violations(df, F.col("v") >= 0).collect()] == [3]
    ends = spark.createDataFrame([(1, "a", None), (2, "a", "b"), (3, None, None)],
                                 "id int, x string, y string")
    assert [r.id for r in Q.violations(ends, Q.at_most_one("x", "y")).collect()] == [2]


def test_unique_lets_null_repeat_but_primary_key_does_not(spark):
    df = spark.createDataFrame([(1,), (1,), (None,), (None,)], "k int")
    assert rows(Q.check_unique(df, ["k"])) == [(1, 2)]
    assert rows(Q.check_primary_key(df, ["k"])) == [(1, 2), (None, 2)]


def test_defaults_only_for_absent_columns(spark):
    df = spark.createDataFrame([(None,)], "a int")
    assert rows(Q.fill_defaults(df, {"a": 1, "b": 2})) == [(None, 2)]


def test_require_rows(spark):
    with pytest.raises(ValueError, match="no rows"):
        Q.require_rows(spark.createDataFrame([("x", 0)], "table_name string, n bigint"))
    with pytest.raises(ValueError, match="no tables"):
        Q.require_rows(spark.createDataFrame([], "table_name string, n bigint"))


def test_profile_sketch_agrees_with_exact(spark):
    df = spark.range(200).select((F.col("id") % 7).alias("a"), F.nullif(
        F.col("id") % 2, F.lit(1)).alias("b"))
    assert rows(Q.profile(df, exact=True)) == rows(Q.profile(df))


def test_missing_share_drops_sparse(spark):
    df = spark.createDataFrame([(1, None), (2, None), (3, 1)], "a int, b int")
    assert Q.drop_sparse(df, 0.5).columns == ["a"]


# -------------------------------------------------------------------------- changes


def test_delete_keeps_unknown(spark):
    df = spark.createDataFrame([(1,), (None,), (5,)], "v int")
    assert rows(H.delete_where(df, F.col("v") > 3)) == [(1,), (None,)]


def test_next_id_on_empty_target(spark):
    empty = spark.createDataFrame([], "id bigint, v string")
    new = spark.createDataFrame([(1, "a"), (2, "b")], "pos bigint, v string")
    assert rows(H.insert_next_id(empty, new, "id", "pos")) == [(1, "a"), (2, "b")]


def test_insert_if_missing_reads_target_once(spark):
    target = spark.createDataFrame([(1,)], "k int")
    new = spark.createDataFrame([(1,), (2,), (2,)], "k int")
    assert rows(H.insert_if_missing(target, new, ["k"])) == [(1,), (2,), (2,)]


def test_last_rule_wins(spark):
    df = spark.createDataFrame([("11112",), ("11110",), ("1abcde112",), ("x",)], "code string")
    df = df.withColumn("f", F.lit(9.0))
    rules = [("1%", 1.0), ("1111_%", 2.0), ("1_____112", 0.0)]
    got = H.update_rules(df, "f", "code", rules, F.lit(True))
    assert rows(got) == [("11110", 2.0), ("11112", 2.0), ("1abcde112", 0.0), ("x", 9.0)]


def test_update_pair_needs_both_sides(spark):
    a = spark.createDataFrame([(1, "x"), (2, "x")], "ka int, va string")
    b = spark.createDataFrame([(1, "q"), (2, "z")], "kb int, vb string")
    left, right = H.update_pair(
        a, b, "ka", "kb", F.col("va") == "x", F.col("vb") == "q",
        {"va": F.lit("new")}, {"vb": F.lit("new")},
    )
    assert rows(left) == [(1, "new"), (2, "x")]
    assert rows(right) == [(1, "new"), (2, "z")]


def test_merge(spark):
    target = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, v string")
    changes = spark.createDataFrame(
        [(1, "x", 1, "update"), (1, "y", 2, "update"), (2, None, 3, "delete"), (4, "n", 4, "insert")],
        "k int, v string, seq int, op string",
    )
    got = H.merge(target, changes, ["k"], [F.desc("seq")], "op")
    assert rows(got) == [(1, "y"), (3, "c"), (4, "n")]


# -------------------------------------------------------------------------- lookups


def test_current_department_has_none_or_several(spark):
    d = dt.date
    history = spark.createDataFrame(
        [
            (1, "a", d(2000, 1, 1), d(9999, 1, 1)), (1, "b", d(2001, 1, 1), d(2002, 1, 1)),
            (2, "a", d(2000, 1, 1), d(9999, 1, 1)), (2, "b", d(2000, 1, 1), d(9999, 1, 1)),
        ],
        "emp_no int, dept_no string, from_date date, to_date date",
    )
    assert [(r.emp_no, r.dept_no) for r in L.current_department(history).orderBy("dept_no").collect()
            ] == [(2, "a"), (2, "b")]
    assert rows(L.latest_department(history)) == [(1, "b"), (2, "a")]
    assert valid_on(history, "2001-06-01").count() == 4


def test_rewards_report_rejects_zero(spark):
    df = spark.createDataFrame([], "customer_id int, payment_date timestamp_ntz, amount double")
    with pytest.raises(ValueError, match="greater than zero"):
        L.rewards_report(df, df, 0, 1, "2024-01-01")


def test_balance(spark):
    ts = dt.datetime
    customers = spark.createDataFrame([(1,), (2,)], "customer_id int")
    rentals = spark.createDataFrame(
        [
            (1, ts(2024, 1, 1, 23), ts(2024, 1, 9, 1), 3, 4.0), (1, ts(2024, 1, 5), None, 3, 2.5),
            (1, ts(2024, 3, 1), ts(2024, 3, 2), 3, 100.0),
        ],
        "customer_id int, rental_date timestamp_ntz, return_date timestamp_ntz, duration int,"
        " rate double",
    )
    payments = spark.createDataFrame(
        [(1, ts(2024, 1, 2), 1.5)], "customer_id int, payment_date timestamp_ntz, amount double"
    )
    got = L.customer_balance(customers, rentals, payments, "2024-02-01")
    assert {r.customer_id: float(r.balance) for r in got.collect()} == {1: 10.0, 2: 0.0}


# ------------------------------------------------------------------ hierarchy and periods


def test_roots_of_a_long_chain_and_a_wide_root(spark):
    links = [(i, i - 1 if i else None) for i in range(100)]
    links += [(1000 + i, 0) for i in range(300)] + [(5000, 77777)]
    df = spark.createDataFrame(links, "n bigint, p bigint")
    got = {r.node: (r.root, r.depth) for r in resolve_roots(df, "n", "p").collect()}
    assert got[99] == (0, 99) and got[1007] == (0, 1) and got[0] == (0, 0)
    assert got[5000] == (77777, 1)
    assert len(got) == 401


def test_cycle_is_reported(spark):
    """Of three, and behind a long chain that ends: as soon as no open pointer ends."""
    chain = [(100 + i, 99 + i if i else None) for i in range(40)]
    for cycle in ([(1, 2), (2, 1)], [(1, 2), (2, 3), (3, 1), (4, 1)], [(1, 1)], [(1, 2), (2, 1), *chain]):
        df = spark.createDataFrame(cycle, "n bigint, p bigint")
        with pytest.raises(ValueError, match="cycle"):
            resolve_roots(df, "n", "p")


def test_rounds_write_open_nodes_only(spark, monkeypatch):
    written = []

    def counted(df, purpose):
        out = materialise(df, purpose)
        written.append(out.count())
        return out

    monkeypatch.setattr(hierarchy, "materialise", counted)
    links = [(i, i - 1 if i else None) for i in range(64)]
    got = hierarchy.resolve_roots(spark.createDataFrame(links, "n bigint, p bigint"), "n", "p")
    assert {r.node: r.depth for r in got.collect()} == {i: i for i in range(64)}
    assert written == [64, 63, 62, 60, 56, 48, 32]  # a cycle of three: one round
    written.clear()
    with pytest.raises(ValueError):
        hierarchy.resolve_roots(
            spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "n bigint, p bigint"), "n", "p"
        )
    assert written == [3, 3]


def test_periods_are_half_open_and_may_overlap(spark):
    d = dt.date
    facts = spark.createDataFrame([(d(2024, 1, 31),), (d(2024, 2, 1),), (d(2024, 5, 1),)], "d date")
    periods = spark.createDataFrame(
        [("a", d(2024, 1, 15), d(2024, 2, 1)), ("b", d(2024, 1, 1), d(2024, 5, 1)),
         ("empty", d(2024, 2, 1), d(2024, 2, 1))],
        "name string, from_date date, to_date date",
    )
    got = join_periods(facts, F.col("d"), periods).select("d", "name")
    assert rows(got) == sorted(
        [(d(2024, 1, 31), "a"), (d(2024, 1, 31), "b"), (d(2024, 2, 1), "b")], key=repr
    )


def test_rollup_levels_tell_null_from_total(spark):
    df = spark.createDataFrame([("r", "c", 1), ("r", None, 2)], "a string, b string, v int")
    got = rollup_along(df, ["a", "b"], {"t": F.sum("v")})
    assert rows(got) == sorted(
        [("r", "c", 2, 1), ("r", None, 2, 2), ("r", None, 1, 3), (None, None, 0, 3)], key=repr
    )


def test_determines(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a"), (2, None)], "k int, v string")
    assert rows(determines(df, "k", ["v"])) == [(2, 2)]


def test_fiscal_year(spark):
    days = spark.createDataFrame([(dt.date(2023, 10, 1),), (dt.date(2023, 9, 30),)], "d date")
    got = {r.time_id.month: r for r in time_dimension(days, "d", 3).collect()}
    assert len(got[10]) == 38
    assert (got[10].fiscal_year, got[10].fiscal_week_number) == (2024, 1)
    assert got[10].end_of_fis_year == dt.date(2024, 9, 30)
    assert (got[9].fiscal_year, got[9].days_in_fis_year) == (2023, 365)


# ------------------------------------------------------------------------ text, vectors


def test_search_agrees_with_index_and_respects_words(spark):
    docs = spark.createDataFrame(
        [(1, "Red fox; red-fox, été"), (2, "foxes are red"), (3, "FOX RED fox"), (4, "")],
        "id bigint, t string",
    )
    direct = search(docs, "id", "t", ["fox", "red"]).collect()
    stored = search_index(inverted_index(docs, "id", "t"), "id", ["fox", "red"]).collect()
    assert [tuple(r) for r in direct] == [tuple(r) for r in stored] == [(1, 4), (3, 3)]
    assert [r.id for r in search(docs, "id", "t", ["été"]).collect()] == [1]


def test_top_k_against_brute_force_in_blocks(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(5)
    data = rng.normal(size=(400, 8)).astype("float32")
    data[10] = data[20]
    df = spark.createDataFrame(
        [(i, [float(x) for x in v]) for i, v in enumerate(data)], "id bigint, v array<float>"
    ).repartition(5)
    queries = df.filter("id < 6").select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    unit = data.astype("float64")
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    for block in (500, 2):
        monkeypatch.setattr(vectors, "BLOCK_QUERIES", block)
        monkeypatch.setattr(vectors, "BLOCK_ROWS", block * 7)
        got = top_k(df, "id", "v", queries, 8, 5)
        found = {}
        for r in got.orderBy("query_id", F.desc(F.round("score", 9)), "id").collect():
            found.setdefault(r.query_id, []).append(r.id)
        for q in range(6):
            scores = np.round(unit @ unit[q], 9)
            assert found[q] == sorted(range(400), key=lambda i: (-scores[i], i))[:5]


def test_generated_values_do_not_depend_on_partitions(spark):
    make = lambda n: spark.range(0, 100, 1, n).select(
        "id", S.pseudo_random("id", 3, 50).alias("r")
    )
    assert rows(make(1)) == rows(make(7))
    assert all(0 <= r.r < 50 for r in make(3).collect())
