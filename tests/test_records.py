"""Dumps and CSV files whose texts hold record ends, cut at many byte ranges; all dump dialects."""

import random

import pytest

from lakemill.session import work_folder
from lakemill.sources import delimited, dumps
from lakemill.sources.records import Scanner, csv_grammar, read_records, sql_grammar

POOL = ["'", '"', ";\n", "\n", ";", ",", "(", ")", "--", "/*", "*/", "#", "a", "b c", "é", " ", "NULL", "`", "INSERT INTO t VALUES", "-", "/"]


def texts(seed, n, extra=()):
    rnd = random.Random(seed)
    pool = POOL + list(extra)
    return [(i, f"<{''.join(rnd.choice(pool) for _ in range(rnd.randint(0, 25)))}>") for i in range(n)]


@pytest.fixture
def small_ranges(spark):
    """Byte ranges of under a kilobyte, so that most records cross one."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]
    spark.conf.set(names[0], "900b")
    spark.conf.set(names[1], "0b")
    yield
    for n, b in zip(names, before, strict=True):
        spark.conf.set(n, b)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("dialect", ["postgres", "mysql", "mssql", "oracle"])
def test_dump_of_every_dialect_reads_back(spark, small_ranges, dialect):
    """Statement ends, quotes and comment marks in texts, over ranges smaller than a statement."""
    data = texts(3, 90, ["\\", "\\'"]) + [(90, None), (91, "x;\n" * 300 + "'")]
    full = [(i, v, f"2024-01-{i % 28 + 1:02d}", i % 2 == 0) for i, v in data]
    df = spark.createDataFrame(full, "id int, v string, day string, ok boolean").repartition(2)
    path = work_folder(spark, "dump")
    kinds = {"id": "int", "v": "text", "day": "date", "ok": "bool"}
    dumps.write_dump(df, path, "t", kinds, dialect, batch=20)
    assert spark.read.text(path).rdd.getNumPartitions() > 8
    schema = "id int, v string, day date, ok boolean"
    got = dumps.read_inserts(spark, path, "t", schema, None, dialect)
    assert [(a, b, str(c), d) for a, b, c, d in rows(got)] == sorted(full)


def test_forms_of_insert(spark):
    text = """
INSERT INTO [shop].[book] ([id], [name]) VALUES (1, N'it''s'), (2, N'N''x');
insert into shop.book values (3, TO_DATE('2024-01-02', 'YYYY-MM-DD'));
INSERT IGNORE INTO `book` (name, id) VALUES (DATE '2024-05-06', 4);
INSERT ALL
  INTO book (id, name) VALUES (5, 'INTO book VALUES (9, 1)')
  INTO other VALUES (6, 'no')
  INTO "book" VALUES (7, 'f(a, b)')
SELECT * FROM dual;
INSERT INTO books VALUES (8, 'another table');
UPDATE book SET id = 1;
"""
    for end in (";\n", None):
        path = work_folder(spark, "dump")
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)
        got = dumps.read_inserts(spark, path, "book", "id int, name string", end, "oracle")
        assert rows(got) == [
            (1, "it's"), (2, "N'x"), (3, "2024-01-02"), (4, "2024-05-06"),
            (5, "INTO book VALUES (9, 1)"), (7, "f(a, b)"),
        ]


@pytest.mark.parametrize(
    "text",
    ["INSERT INTO t SELECT * FROM u;", "INSERT t VALUES (1);", "INSERT ALL WHEN 1 = 1 THEN INTO t VALUES (1) SELECT 1;",
     "INSERT INTO t VALUES (1), 2;"],
)
def test_an_insert_that_is_not_read_fails(spark, text):
    path = work_folder(spark, "dump")
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)
    with pytest.raises(Exception, match="not a"):
        dumps.read_inserts(spark, path, "t", "id int", None).collect()


def test_csv_with_line_breaks_over_many_ranges(spark, small_ranges):
    data = [(str(i), v, f'5" {i}') for i, v in texts(5, 90)] + [("90", "y\n" * 900 + "z", None)]
    path = work_folder(spark, "csv")
    df = spark.createDataFrame(data, "id string, v string, w string")
    df.repartition(2).write.csv(path, header=True, escape='"')
    got = delimited.read_csv_records(spark, path)
    assert got.columns == ["id", "v", "w"]
    assert rows(got.na.fill("", ["w"])) == sorted((a, b, c or "") for a, b, c in data)


def test_a_stray_quote_opens_no_field(spark):
    path = work_folder(spark, "csv")
    text = 'id,size\n1,5" pipe\n2,"a\n""b"""\n\n3,x"y"\n'
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)
    assert rows(delimited.read_csv_records(spark, path)) == [
        ("1", '5" pipe'), ("2", 'a\n"b"'), ("3", 'x"y"'),
    ]


@pytest.mark.parametrize("escapes", [False, True])
def test_records_do_not_depend_on_ranges(spark, escapes):
    body = "".join(
        f"INSERT INTO t VALUES ({i}, '{v.replace(chr(92), chr(92) * 2).replace(chr(39), chr(39) * 2)}');\n-- it's; {i}\n/* ';\n*/"
        for i, v in texts(8, 30, ["\\"] if escapes else [])
    )
    path = work_folder(spark, "text")
    spark.createDataFrame([(body + "SELECT 1",)], "value string").coalesce(1).write.text(path)
    ends, state = Scanner(sql_grammar(escapes)).scan(body, 0)
    want = [body[a:b] for a, b in zip([0, *ends], ends, strict=False)] + [body[ends[-1] :] + "SELECT 1\n"]
    assert state == 0 and len(ends) == 30
    for size in ("128m", "900b", "301b"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "0b" if size != "128m" else "4m")
        try:
            got = read_records(spark, path, sql_grammar(escapes)).orderBy("no").collect()
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", "128m")
            spark.conf.set("spark.sql.files.openCostInBytes", "4m")
        assert [r.value for r in got] == want


def test_every_start_state_of_a_csv_line():
    scanner = Scanner(csv_grammar())
    assert scanner.scan('a,"b\n', 0) == ([], 1)
    assert scanner.scan('c"",d"\n', 1) == ([7], 0)
    assert scanner.scan('x,y\n"1","2"\n', 0) == ([4, 12], 0)
    assert scanner.scan("no quote\n", 1) == ([], 1)
    assert scanner.scan('end",z,"open\n', 1) == ([], 1)
