"""Quoted records read block by block, against the one-task reader and a character loop."""

import csv
import io
import random

import pytest

from affectlake.session import saved
from affectlake.sources import files, records

BLOCK_SIZE = "spark.sql.files.maxPartitionBytes"
SCHEMA = "a string, b string, c string"


@pytest.fixture
def small_blocks(spark):
    before, cost = spark.conf.get(BLOCK_SIZE), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield lambda size: spark.conf.set(BLOCK_SIZE, str(size))
    spark.conf.set(BLOCK_SIZE, before)
    spark.conf.set("spark.sql.files.openCostInBytes", cost)


def one_task(spark, path, sep=",", header=False, schema=SCHEMA):
    return spark.read.schema(schema).option("header", header).option("sep", sep).option("quote", '"').option(
        "escape", '"').option("multiLine", True).csv(path)


def content(r, rows, end="\n"):
    def cell():
        text = "".join(r.choice(["x", "é", ",", '"', "\n", "\n\n", "\r\n", " ", "日", "\\", "long " * 20]) for _ in range(r.randint(0, 9)))
        plain = not set(text) & set(',"\n\r')
        return text if plain and r.random() < 0.6 else '"' + text.replace('"', '""') + '"'

    return "".join(",".join(cell() for _ in range(3)) + end + (end if r.random() < 0.1 else "") for _ in range(rows))


@pytest.mark.parametrize("size", [40, 300, 5_000])
def test_blocks_of_any_size_as_one_task(spark, write, small_blocks, size):
    text = content(random.Random(size), 30).replace("\r", "")  # inside fields the one-task reader makes them line feeds
    path = write("rows.csv", text)
    want = [tuple(r) for r in one_task(spark, path).collect()]
    small_blocks(size)
    found = saved(records.read_quoted(spark, path, SCHEMA, header=False, places=True)).orderBy("row_no").collect()
    assert [tuple(r)[:3] for r in found] == want
    assert [r.row_no for r in found] == list(range(1, len(want) + 1)) and {r.file for r in found} == {"rows.csv"}
    tasks = records._pieces(spark.read.option("lineSep", "\n").text(path), ",", True).rdd.getNumPartitions()
    assert tasks >= min(8, len(text.encode()) // max(size, 4_000))


def test_records_as_the_standard_parser(spark, write, small_blocks):
    text = content(random.Random(3), 60)
    small_blocks(200)
    got = [r.record for r in records.quoted_records(spark, write("r.csv", text)).orderBy("row_no").collect()]
    want = [row for row in csv.reader(io.StringIO(text, newline="")) if row]
    assert [next(csv.reader(io.StringIO(x, newline=""))) for x in got] == want


def test_quotes_inside_plain_fields_do_not_open_one(spark, write, small_blocks):
    text = 'a 5" pipe,x,y\n"q ""z""\n,",b,c\n,"""",\n1,2,3\n"u",v 6",w"\n' * 4
    path = write("stray.csv", text)
    want = [tuple(r) for r in one_task(spark, path).collect()]
    assert len(want) == 20
    for size in (33, 10_000):
        small_blocks(size)
        got = records.read_quoted(spark, path, SCHEMA, header=False, places=True).orderBy("row_no").collect()
        assert [tuple(r)[:3] for r in got] == want


def test_headers_line_ends_and_open_fields(spark, write, small_blocks):
    for name, text in {"h/1.csv": "a,b,c\r\n1,\"x\r\ny\",3\r\n\r\n4,5,6", "h/2.csv": "\na,b,c\n7,8,\"9\n", "h/3.csv": "", "h/4.csv": "a,b,c\n"}.items():
        path = write(name, text)
    folder = path.rsplit("/", 1)[0]
    for size in (9, 10_000):
        small_blocks(size)
        got = sorted(tuple(r) for r in records.read_quoted(spark, folder, SCHEMA, places=True).collect())
        assert got == [("1", "x\r\ny", "3", "1.csv", 1), ("4", "5", "6", "1.csv", 2), ("7", "8", "9\n", "2.csv", 1)] or got == [
            ("1", "x\r\ny", "3", "1.csv", 1), ("4", "5", "6", "1.csv", 2), ("7", "8", "9", "2.csv", 1)]


def test_tabs_types_and_names(spark, write, small_blocks):
    small_blocks(30)
    path = write("s.csv", 'ID,SIT,EMOT,Field1\n1,"I, the ""one""\nwho",1.0,joy\n2,,2.0,fear\n')
    rows = files.read_statements(spark, path, places=True).orderBy("row_no").collect()
    assert [tuple(r) for r in rows] == [('I, the "one"\nwho', 1, "joy", "s.csv", 1), (None, 2, "fear", "s.csv", 2)]
    tabs = write("t.tsv", 'x\t"1\t\n2"\t3\ny\t,\t\n')
    assert [tuple(r) for r in files.delimited(spark, tabs, "a string, b string, c int", "\t", header=False).orderBy("a").collect()] == [
        ("x", "1\t\n2", 3), ("y", ",", None)]
    assert files.delimited(spark, write("e.csv", ""), SCHEMA).collect() == []
