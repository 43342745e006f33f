"""Record splitting and checks against Python's own csv rules and brute force."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewheel.operators.bad_rows import error_rows, find_errors, load_valid, split_record, valid_amount, valid_timestamp

SOUND = re.compile(r'(?:[^",]*|"(?:[^"]|"")*")(?:,(?:[^",]*|"(?:[^"]|"")*"))*', re.S)
RAW = "line_id bigint, file_name string, line string, row_id string, reason string"
GOOD = "2024-02-29 23:59:59,4366188798847636,Shop,food,2.19,abc,1709251199,28.5,-10.0,0"


def fields(line):
    line = line[:-1] if line.endswith("\r") else line
    if not SOUND.fullmatch(line):
        return None
    got = re.findall(r',("(?:[^"]|"")*"|[^",]*)', "," + line, re.S)
    return [f[1:-1].replace('""', '"') if f.startswith('"') else f for f in got]


@settings(max_examples=12, deadline=None)
@given(st.lists(st.text(alphabet='ab",\n\r é', max_size=14), min_size=30, max_size=60))
def test_split(spark, lines):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, line string")
    got = {r.i: r.f for r in df.select("i", split_record(F.col("line")).alias("f")).collect()}
    assert got == {i: fields(x) for i, x in enumerate(lines)}


@pytest.mark.parametrize(
    "value,good",
    [("2024-02-29 00:00:00", True), ("2023-02-29 00:00:00", False), ("2024-04-31 10:00:00", False), ("2024-01-01 24:00:00", False), ("2024-01-01 00:00:60", False), ("2024-01-01T00:00:00", False), (" 2024-01-01 00:00:00", False), ("2024-01-01 00:00:00\n", False), ("0000-01-01 00:00:00", False), ("٢٠٢٤-01-01 00:00:00", False), ("", False), (None, None)],
)
def test_timestamps(spark, value, good):
    assert spark.createDataFrame([(value,)], "v string").select(valid_timestamp(F.col("v"))).first()[0] in (good, False if good is None else good)


@pytest.mark.parametrize(
    "value,good",
    [("1", True), ("-1.", True), (".5", True), ("+1.5e-3", True), (" 7 ", True), (" 7\t", True), ("", True), ("  ", True), ("NULL", True), ("nUll", True), ("nan", False), ("inf", False), ("1e999", False), (".", False), ("1e", False), ("e5", False), ("1,5", False), ("0x1F", False), ("1_0", False), ("−5", False), ("٣", False), ("1.2.3", False), ("12 3", False), ("1d", False), ("1f", False)],
)
def test_amounts(spark, value, good):
    assert spark.createDataFrame([(value,)], "v string").select(valid_amount(F.col("v"))).first()[0] is good


def test_errors_and_loading(spark):
    rows = [
        (1, GOOD), (1, GOOD), (2, GOOD + "\r"), (3, GOOD.replace("Shop", '"A, ""B""\nC"')), (4, GOOD.replace("Shop", '"A')), (5, GOOD + ","), (6, ""), (7, None), (8, GOOD.replace("2024-02-29 23", "2024-02-30 23").replace("2.19", "x")), (9, GOOD.replace("2.19", "null").replace("28.5", "far")),
        (10, "x" * 300_000), (11, '"' + '""' * 50_000 + '",' + GOOD), (12, GOOD.replace("Shop", "")),
    ]
    raw = spark.createDataFrame([(i, "f", x, "c", "d") for i, x in rows], RAW)
    errors = find_errors(raw)
    got = {(r.row_id, r.reason) for r in errors.collect()}
    assert got == {(4, "quoting"), (5, "columns"), (6, "columns"), (7, "columns"), (8, "timestamp"), (8, "amount"), (10, "columns"), (11, "columns")}
    assert {r.row_id: r.reasons for r in error_rows(errors).where("row_id = 8").collect()} == {8: "amount,timestamp"}
    loaded = {r.row_id: r for r in load_valid(raw, errors).collect()}
    assert set(loaded) == {1, 2, 3, 9, 12}
    assert loaded[3].merchant == 'A, "B"\nC' and loaded[9].amt is None and loaded[9].merch_lat is None and loaded[1].amt == 2.19 and loaded[2].is_fraud == 0 and loaded[12].merchant == ""


def test_empty(spark):
    raw = spark.createDataFrame([], RAW)
    assert find_errors(raw).count() == 0 and load_valid(raw, find_errors(raw)).count() == 0
