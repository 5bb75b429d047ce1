from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from epochloom.operators.timestamps import COUNTER_START_S, normalise, parse


def us(*a, micro=0):
    return int(datetime(*a, tzinfo=timezone.utc).timestamp()) * 1_000_000 + micro


CASES = [
    ("2020-06-01T12:00:00Z", "Europe/Berlin", "de_DE", us(2020, 6, 1, 12)),
    ("2020-06-01 12:00:00", "Europe/Berlin", "de_DE", us(2020, 6, 1, 10)),
    ("2020-06-01T12:00:00.5", "UTC", "en_GB", us(2020, 6, 1, 12, micro=500_000)),
    ("2020-06-01T12:00:00.123456+05:45", "UTC", "en_GB", us(2020, 6, 1, 6, 15, micro=123_456)),
    ("2020-06-01 12:00:00 +0530", "UTC", "en_GB", us(2020, 6, 1, 6, 30)),
    ("2020-06-01T12:00:00-05:00[America/Chicago]", "UTC", "en_GB", us(2020, 6, 1, 17)),
    ("2020-06-01T12:00:00[America/Chicago]", "UTC", "en_GB", us(2020, 6, 1, 17)),
    ("20200601T120000Z", "Asia/Kolkata", "en_IN", us(2020, 6, 1, 12)),
    ("01-06-2020 12:00:00", "UTC", "en_GB", us(2020, 6, 1, 12)),
    ("06/01/2020 01:02:03 PM", "UTC", "en_US", us(2020, 6, 1, 13, 2, 3)),
    ("06/01/2020 12:02 AM", "UTC", "en_US", us(2020, 6, 1, 0, 2)),
    ("01.06.2020 12:00", "Europe/Berlin", None, us(2020, 6, 1, 10)),
    ("  1-Jun-2020 12:00:00 ", "UTC", "en_US", us(2020, 6, 1, 12)),
    ("2020-JUN-01 12:00:00", "UTC", "en_US", us(2020, 6, 1, 12)),
    ("Mon, 01 Jun 2020 12:00:00 -0300", "UTC", "en_US", us(2020, 6, 1, 15)),
    ("2020-06-01 12:00:00 BST", "Europe/London", "en_GB", us(2020, 6, 1, 11)),
    ("2020-06-01 12:00:00 IST", "Asia/Kolkata", "en_IN", us(2020, 6, 1, 6, 30)),
    ("2020-06-01 12:00:00 IST", "Europe/Dublin", "en_GB", us(2020, 6, 1, 11)),
    ("2020-12-01 12:00:00 CST", "America/Chicago", "en_US", us(2020, 12, 1, 18)),
    ("1591012800", "Asia/Kolkata", "en_IN", us(2020, 6, 1, 12)),
    ("1591012800123", None, None, us(2020, 6, 1, 12, micro=123_000)),
    ("2020-02-29 00:00:00", "UTC", "en_GB", us(2020, 2, 29)),
    ("2020-06-01", "UTC", "en_GB", us(2020, 6, 1)),
]
NOT = ["", " ", "--", "N/A", "NaT", "invalid", "no clock", "0000-00-00 00:00:00", "00/00/0000 00:00", "31-02-2021 10:00:00", "2020-13-45 99:99:99", "2021-02-29 00:00:00", "2020-06-01 24:00:00",
       "2020-06-01 12:60:00", "2020-06-01 12:00:00 QQQ", "13:00 PM", "06/01/2020 13:00 PM", "12345", "x2020-06-01", "2020-06-01 12:00:00 trailing", "é" * 100_000]


def test_every_form(spark):
    df = spark.createDataFrame([(i, t, z, loc) for i, (t, z, loc, _) in enumerate(CASES)], "i int, t string, tz string, locale string")
    got = {r.i: (r.early_us, r.late_us) for r in parse(df, "t", "tz", "locale").collect()}
    for i, (t, _, _, want) in enumerate(CASES):
        assert got[i] == (want, want), t


def test_texts_that_name_no_instant(spark):
    df = spark.createDataFrame([(t, "UTC", "en_US") for t in [*NOT, None]] + [("2020-06-01 12:00:00", None, "en_US")], "t string, tz string, locale string")
    assert parse(df, "t", "tz", "locale").where("early_us is not null").count() == 0
    odd = spark.createDataFrame([("2020-06-01 12:00:00", "Mars/Base", "x"), ("2020-06-01 12:00:00[Mars/Base]", "UTC", "x"), ("2020-06-01T12:00:00+01:00[Mars/Base]", "Mars/Base", "x")], "t string, tz string, locale string")
    assert [r.early_us for r in parse(odd, "t", "tz", "locale").collect()] == [None, None, us(2020, 6, 1, 11)]


def test_gap_and_repeated_hour(spark):
    df = spark.createDataFrame([("2021-03-28 02:30:00", "Europe/Berlin", "x"), ("2021-10-31 02:30:00", "Europe/Berlin", "x")], "t string, tz string, locale string")
    gap, twice = parse(df, "t", "tz", "locale").orderBy("t").collect()
    assert gap.early_us is None and gap.late_us is None
    assert (twice.early_us, twice.late_us) == (us(2021, 10, 31, 0, 30), us(2021, 10, 31, 1, 30))
    moved = parse(df, "t", "tz", "locale", nonexistent="shift").orderBy("t").first()
    assert moved.early_us == us(2021, 3, 28, 1, 30)
    with pytest.raises(ValueError):
        parse(df, "t", "tz", "locale", nonexistent="guess")


def lines(spark, rows):
    return spark.createDataFrame(rows, "row_id long, src long, line_no int, device_id int, t string, c int, tz_name string")


ZONES = [(1, "Europe/Berlin", "de_DE"), (2, "UTC", "en_GB")]


def test_repeated_hour_by_order(spark):
    hours = ["01:59:00", "02:10:00", "02:50:00", "02:05:00", "02:55:00", "03:00:00"]
    rows = [(k, 1, k, 1, f"31-10-2021 {h}", None, "clash") for k, h in enumerate(hours)]
    rows += [(10 + k, 2, k, 1, f"31-10-2021 {h}", None, "clash") for k, h in enumerate(["02:58:00", "03:01:00"])]  # only the second pass is there
    rows += [(20 + k, 3, k, 1, f"31-10-2021 {h}", None, "clash") for k, h in enumerate(["01:58:00", "02:01:00"])]  # only the first
    rows += [(30, None, 0, 1, "31-10-2021 02:30:00", None, "clash"), (31, 4, None, 1, "31-10-2021 02:30:00", None, "clash"), (32, 5, 1, 9, "31-10-2021 05:30:00", None, "clash")]
    zones = spark.createDataFrame(ZONES, "device_id int, tz_name string, locale string")
    got = {r.row_id: r.utc_us for r in normalise(lines(spark, rows), zones, text="t", source="src").collect()}
    assert [got[k] for k in range(6)] == [us(2021, 10, 30, 23, 59), us(2021, 10, 31, 0, 10), us(2021, 10, 31, 0, 50), us(2021, 10, 31, 1, 5), us(2021, 10, 31, 1, 55), us(2021, 10, 31, 2)]
    assert (got[10], got[21]) == (us(2021, 10, 31, 1, 58), us(2021, 10, 31, 0, 1))
    assert got[31] == us(2021, 10, 31, 0, 30) and 32 not in got


def test_repeated_hour_whose_step_is_hidden(spark):
    day = "31-10-2021"
    # only later fits: the line before is later than the earlier candidate
    rows = [(0, 1, 0, 1, f"{day} 00:59:00Z", None, "x"), (1, 1, 1, 1, f"{day} 02:20:00", None, "x"), (2, 1, 2, 1, f"{day} 02:21:00", None, "x")]
    rows += [(10, 2, 5, 1, f"{day} 02:20:00", None, "x"), (11, 2, 6, 1, f"{day} 00:30:00Z", None, "x")]  # only earlier fits
    rows += [(20, 3, 0, 1, f"{day} 01:59:00", None, "x"), (21, 3, 2, 1, f"{day} 02:01:00", None, "x"), (22, 3, 40, 1, f"{day} 02:39:00", None, "x"), (23, 3, 110, 1, f"{day} 02:49:00", None, "x"), (24, 3, 121, 1, f"{day} 03:00:00", None, "x")]
    zones = spark.createDataFrame(ZONES, "device_id int, tz_name string, locale string")
    got = {r.row_id: r.utc_us for r in normalise(lines(spark, rows), zones, text="t", source="src").collect()}
    assert [got[k] for k in (1, 2, 10)] == [us(2021, 10, 31, 1, 20), us(2021, 10, 31, 1, 21), us(2021, 10, 31, 0, 20)]
    assert [got[k] for k in (21, 22, 23)] == [us(2021, 10, 31, 0, 1), us(2021, 10, 31, 0, 39), us(2021, 10, 31, 1, 49)]


def test_repeated_hour_by_counter(spark):
    rows, want = [], {}
    for k, utc in enumerate((us(2021, 10, 31, 0, 20), us(2021, 10, 31, 1, 40))):
        s = utc // 1_000_000
        rows.append((10 * k, k, 1, 1, None, (s - 30 - COUNTER_START_S) % 65_536, "x"))
        rows += [(10 * k + j, k, 2, 1, f"31-10-2021 02:{20 + 20 * k}", None, "x") for j in (1, 2)]  # a repeated row
        want |= {10 * k + 1: utc, 10 * k + 2: utc}
    zones = spark.createDataFrame(ZONES, "device_id int, tz_name string, locale string")
    got = {r.row_id: r.utc_us for r in normalise(lines(spark, rows), zones, text="t", source="src", counter="c").collect()}
    assert got == want


def test_empty(spark):
    zones = spark.createDataFrame([], "device_id int, tz_name string, locale string")
    assert normalise(lines(spark, []), zones, text="t", source="src", counter="c").count() == 0


def test_session_time_zone_does_not_matter(spark):
    df = spark.createDataFrame([("2021-07-01 02:30:00", "America/New_York", "x")], "t string, tz string, locale string")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        assert parse(df, "t", "tz", "locale").select(F.col("early_us")).first()[0] == us(2021, 7, 1, 6, 30)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
