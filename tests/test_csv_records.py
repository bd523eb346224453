"""The parallel CSV reader equals Spark's whole-file reader, row for row and in order."""

import random

import pytest
from pyspark.sql import functions as F

from mailsift.sources import csv as C
from mailsift.sources.csv_records import goes_on, read_records


def _spark_rows(spark, path, encoding="UTF-8"):
    df = (spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("encoding", encoding).csv(path))
    return [tuple(r) for r in C.na_to_null(df).collect()]


def _rows(df):
    return [tuple(r)[:-2] for r in df.orderBy("_row_ord").collect()]


def _written(tmp_path, name, rnd, n, end="\n", encoding="utf-8"):
    pieces = ["a", "é", ",", '""', "\n", "\r\n", " ", "x" * 40, "NA", "\t", "'", "1.0"]
    lines = ["id,subject,body,label"]
    for i in range(n):
        quoted = '"' + "".join(rnd.choices(pieces, k=rnd.randint(0, 12))) + '"'
        body = '"' + "".join(rnd.choices(pieces, k=rnd.randint(0, 40))) + '"'
        label = rnd.choice(["1", "0", "", '"spam"', 'a"b', '"x"y', " z ", "NULL"])
        lines.append(f"{i},{quoted},{body},{label}")
        if rnd.random() < 0.05:
            lines.append("")
    path = tmp_path / name
    path.write_bytes(end.join(lines).encode(encoding) + (end.encode() if rnd.random() < 0.5 else b""))
    return str(path)


@pytest.fixture()
def ranges(spark):
    """Splits of about 2 KB."""
    keys = {"spark.sql.files.maxPartitionBytes": "2000", "spark.sql.files.openCostInBytes": "1"}
    old = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("end", ["\n", "\r\n"])
@pytest.mark.parametrize("encoding", ["UTF-8", "ISO-8859-1"])
def test_equals_whole_file_reader(spark, tmp_path, ranges, end, encoding):
    path = _written(tmp_path, "mail.csv", random.Random(len(end) + len(encoding)), 600, end, encoding)
    got = C.read_csv(spark, path, encoding)
    assert _rows(got) == _spark_rows(spark, path, encoding)
    _, records = read_records(spark, path, encoding)
    scans = spark.read.text(path).rdd.getNumPartitions()
    assert scans > 10 and records.where("record >= 0").count() >= 601


def test_records_longer_than_a_range(spark, tmp_path, ranges):
    rnd = random.Random(5)
    long = "".join(rnd.choices(["word ", "\n", '""', ","], k=6000))
    path = tmp_path / "long.csv"
    path.write_text('id,body\n1,"' + long + '"\n2,short\n3,"' + long + '"\n4,"a\nb"\n', newline="")
    assert _rows(C.read_csv(spark, str(path))) == _spark_rows(spark, str(path))
    assert C.read_csv(spark, str(path)).count() == 4


def test_folder_keeps_file_order(spark, tmp_path, ranges):
    rnd = random.Random(9)
    paths = [_written(tmp_path, name, rnd, n) for name, n in (("a b.csv", 3), ("b.csv", 300), ("c%20.csv", 50))]
    want = [r for p in paths for r in _spark_rows(spark, p)]
    assert _rows(C.read_csv(spark, str(tmp_path))) == want
    assert _rows(C.read_csv(spark, paths)) == want


@pytest.mark.parametrize("text", ["id,body\n", "id,body", "﻿id,body\n1,x\n", "id,,id\n1,2,3\n4\n5,6,7,8\n"])
def test_odd_files(spark, tmp_path, text):
    path = tmp_path / "odd.csv"
    path.write_text(text, newline="")
    df = C.read_csv(spark, str(path))
    whole = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(str(path))
    assert df.columns[:-2] == whole.columns
    assert _rows(df) == [tuple(r) for r in whole.collect()]


def test_quote_never_closed_takes_the_rest(spark, tmp_path):
    (tmp_path / "open.csv").write_text('id,body\n1,"never closed\n2,x\n')
    assert _rows(C.read_csv(spark, str(tmp_path / "open.csv"))) == [("1", "never closed\n2,x")]


def test_empty_file_and_other_encodings_raise(spark, tmp_path):
    (tmp_path / "none.csv").write_text("")
    with pytest.raises(ValueError, match="header"):
        C.read_csv(spark, str(tmp_path / "none.csv"))
    with pytest.raises(ValueError, match="UTF-16"):
        C.read_csv(spark, str(tmp_path / "none.csv"), "UTF-16")


@pytest.mark.parametrize("line,inside,want", [
    (b"", False, False), (b"", True, True), (b"a,b", False, False), (b'a,"b', False, True), (b'a,"b"', False, False), (b'b",c', True, False),
    (b'b"",c', True, True), (b'b"x,"c', True, True), (b'a"b,c', False, False), (b'"a""', False, True), (b'"a"""', False, False), (b'""', False, False),
    (b'"', True, False), (b'","', True, True), (b'a,"b"x"y', False, False)])
def test_open_quotes(line, inside, want):
    assert goes_on(line, inside) is want
