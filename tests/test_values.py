"""Numbers, times and texts."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from runlake.functions.timing import hours_between, slot, slot_start, to_micros
from runlake.functions.values import fixed_text, short_text, stem_without, to_moment, to_number, whole_text
from runlake.operators.summaries import cadence_text


def column(spark, values, kind, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in df.select(expression(F.col("x")).alias("y"), "i").orderBy("i").select("y").collect()]


def test_only_plain_numbers_are_numbers(spark):
    texts = ["12", " 7.5 ", "+3", "-.5", "1e3", "1E-2", "inf", "-Infinity", "12d", "1f", "2D", "0x1p3", "NaN", "nan",
             "", " ", "n.d.", "1:10", "5 mg", "1_0", "1,5", None]
    expected = [12.0, 7.5, 3.0, -0.5, 1000.0, 0.01, float("inf"), float("-inf")] + [None] * 14
    assert column(spark, texts, "string", to_number) == expected


def test_times_in_both_forms_and_missing_ones(spark):
    texts = ["2026-03-02T08:00:00", "2026-03-02 08:00:00.25", "2026-03-02 08:00", "", "NaN", None]
    base = datetime(2026, 3, 2, 8)
    expected = [base, base + timedelta(milliseconds=250), base, None, None, None]
    assert column(spark, texts, "string", lambda c: to_moment(c, F.lit("f.csv"))) == expected


def test_an_unreadable_time_stops_the_job(spark):
    with pytest.raises(Exception, match="f.csv: cannot read a time from 'soon'"):
        column(spark, ["soon"], "string", lambda c: to_moment(c, F.lit("f.csv")))


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Tokyo"])
def test_time_arithmetic_ignores_the_session_zone(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        # 2024-03-10 02:30 does not exist in New York.
        df = spark.sql("select timestamp_ntz'2024-03-10 02:33:30.5' a, timestamp_ntz'2024-03-09 23:00:00' b")
        row = df.select(
            hours_between(F.col("a"), F.col("b")).alias("h"),
            slot_start(slot(F.col("a"), to_micros("5min")), to_micros("5min")).cast("string").alias("s"),
            slot_start(slot(F.col("a"), to_micros("100ms")), to_micros("100ms")).cast("string").alias("t"),
        ).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert row["h"] == pytest.approx(3 + 33.5 / 60 + 0.5 / 3600)
    assert row["s"] == "2024-03-10 02:30:00"
    assert row["t"] == "2024-03-10 02:33:30.5"


def test_durations():
    assert to_micros("5min") == to_micros(timedelta(minutes=5)) == 300_000_000
    assert to_micros("1D") == 86_400_000_000 and to_micros("h") == 3_600_000_000 and to_micros(7) == 7
    with pytest.raises(ValueError):
        to_micros("soon")
    with pytest.raises(ValueError):
        to_micros(-1)


def test_texts(spark):
    numbers = [720.0, 0.25, 37.583333, 5.0, 0.0, 1e7, 123456.7, None]
    assert column(spark, numbers, "double", short_text) == [
        "720", "0.25", "37.5833", "5", "0", "1e+07", "123457", None,
    ]
    assert column(spark, [2.5, 3.5, 2.4], "double", whole_text) == ["2", "4", "2"]
    assert column(spark, [2.0, 9.825], "double", lambda c: fixed_text(c, 2)) == ["2.00", "9.82"]


def test_cadence_in_words(spark):
    seconds = [None, 30.0, 89.9, 90.0, 5399.0, 5400.0, 36000.0]
    assert column(spark, seconds, "double", cadence_text) == [
        "single reading", "30 s", "90 s", "2 min", "90 min", "1.5 h", "10.0 h",
    ]


def test_run_id_from_file_name(spark):
    names = ["R1_offgas.csv", "A_B_offgas.csv", "R1.csv", "R1_offgas.txt"]
    assert column(spark, names, "string", lambda c: stem_without(c, "_offgas")) == ["R1", "A_B", None, None]


@pytest.mark.parametrize("text", ["2026-03-02T08:00:00+05:00", "2026-03-02T08:00:00Z", "2026", "2026-03", "08:00"])
def test_times_with_an_offset_or_without_a_day_are_refused(spark, text):
    frame = spark.createDataFrame([(text,)], "t string")
    with pytest.raises(Exception, match="cannot read a time"):
        frame.select(to_moment(F.col("t"), F.lit("x.csv"))).collect()


@pytest.mark.parametrize("text", ["2026-03-02", "2026-03-02 08:00", "2026-3-2 8:00:01.25", " 2026-03-02T08:00:00 "])
def test_plain_times_are_read(spark, text):
    frame = spark.createDataFrame([(text,)], "t string")
    assert frame.select(to_moment(F.col("t"), F.lit("x.csv")).alias("m")).first()["m"].day == 2
