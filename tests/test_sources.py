import gzip
from datetime import datetime

import pytest

from epochloom.schema import HCHS, MESA, MMASH, EpochSchema, SourceConfig
from epochloom.sources import readers
from epochloom.streaming.daily import daily_stream


def test_patterns():
    assert readers.java_pattern("%Y-%b-%d %H:%M:%S") == "yyyy-MMM-dd HH:mm:ss" and readers.java_pattern("%m-%d-%Y %I:%M %p") == "MM-dd-yyyy hh:mm a" and readers.java_pattern("%YT%H") == "yyyy'T'HH"
    with pytest.raises(ValueError):
        readers.java_pattern("%Q")


def test_weekday_and_clock_file(spark, tmp_path):
    text = "mesaid,linetime,activity,interval,dayofweek\n" + "".join(f"1,{t},{a},{i},3\n" for t, a, i in (("23:59:00", "5", "ACTIVE"), ("23:59:30", "", "REST"), ("00:00:00", "7", "REST-S")))
    with gzip.open(tmp_path / "a.csv.gz", "wt") as f:
        f.write(text)
    x = readers.read_epochs(spark, str(tmp_path / "a.csv.gz"), MESA).orderBy("hyp_row").collect()
    assert [r.hyp_time_col for r in x] == [datetime(2017, 1, 3, 23, 59), datetime(2017, 1, 3, 23, 59, 30), datetime(2017, 1, 4)]
    assert [r.hyp_act_x for r in x] == [5, None, 7] and [r.hyp_annotation for r in x] == [False, True, True] and x[0].pid == "1"


def test_axes_and_heart_rate(spark):
    x = spark.createDataFrame([("7", "2020-Jan-02 03:04:05", "1", "NaN", "x", 60.0)], "pid string, time string, Axis1 string, Axis2 string, Axis3 string, HR double")
    r = readers.standardise(x, MMASH).first()
    assert (r.hyp_time_col, r.hyp_act_x, r.hyp_act_y, r.hyp_act_z, r.hyp_hr) == (datetime(2020, 1, 2, 3, 4, 5), 1, None, None, 60)


def test_constant_columns(spark):
    x = spark.createDataFrame([("7", "2020-01-02", 1.0, "left")], "pid string, at string, a double, place string")
    r = readers.standardise(x, SourceConfig(("a",), "at", pid="pid", strftime="%Y-%m-%d", extra={"place": "wrist", "counts": True})).first()
    assert (r.place, r.counts, r.hyp_act_x) == ("wrist", True, 1.0)


def test_errors(spark):
    x = spark.createDataFrame([("1", "t", 1.0)], "pid string, time string, activity double")
    for cfg, pid in ((SourceConfig((), "time", pid="pid", strftime="%Y"), None), (SourceConfig(("a", "b", "c", "d"), "time", pid="pid"), None), (SourceConfig(("activity",), "time", strftime="%Y"), None),
                     (SourceConfig(("activity",), "time", pid="zz", strftime="%Y"), None), (SourceConfig(("activity",), "time", pid="pid"), None), (SourceConfig(("nope",), "time", pid="pid", strftime="%Y"), None), (HCHS, None)):
        with pytest.raises(ValueError):
            readers.standardise(x, cfg, pid=pid)
    with pytest.raises(NotImplementedError):
        readers.read_file(spark, "x.cwa")


def test_round_trip(spark, tmp_path):
    s = EpochSchema(hr="h", activity=("a", "b"))
    x = spark.createDataFrame([("1", datetime(2020, 1, 1), 1.0), ("2", datetime(2020, 1, 1), None)], "pid string, hyp_time_col timestamp_ntz, h double")
    readers.write_epochs(x, s, str(tmp_path / "o"), buckets=2)
    y, t = readers.read_saved(spark, str(tmp_path / "o"))
    assert t == s and sorted(map(tuple, y.select(*x.columns).collect())) == sorted(map(tuple, x.collect()))


def test_glucose(spark, tmp_path):
    head = "Device,Serial Number,Device Timestamp,Record Type,Historic Glucose mg/dL,Scan Glucose mg/dL,Ketone mmol/L,Other"
    (tmp_path / "g.csv").write_text(f"Export of somebody\n{head}\nLibre,A1,03-04-2021 01:05 PM,0,100,,,x\nLibre,A1,03-04-2021 01:06 PM,1,,90,0.4,x\nLibre,A1,03-04-2021 01:07 PM,5,,,,x\n")
    x = readers.read_glucose(spark, str(tmp_path / "g.csv"), pid="9").orderBy("hyp_time_col").collect()
    assert [(r.pid, r.auto0_man1, r.gluc_mgdl, r.ket_mmol) for r in x] == [("9", 0, 100, None), ("9", 1, 90, 0.4), ("9", 5, 0, None)] and x[0].hyp_time_col == datetime(2021, 3, 4, 13, 5)


def test_glucose_header_with_commas_and_several_files(spark, tmp_path):
    head = 'Device,Serial Number,Device Timestamp,Record Type,Historic Glucose mg/dL,Scan Glucose mg/dL,Ketone mmol/L,"Other, free"'
    for k in (1, 2):
        (tmp_path / f"g{k}.csv").write_text(f"Export, of somebody\r\n{head}\r\nLibre,A{k},03-04-2021 01:05 PM,0,10{k},,,\"x, y\"\r\n")
    x = readers.read_glucose(spark, str(tmp_path / "*.csv")).orderBy("serial").collect()
    assert [(r.serial, r.gluc_mgdl) for r in x] == [("A1", 101), ("A2", 102)]
    (tmp_path / "g3.csv").write_text("Export\nAnother,Header\n1,2\n")
    with pytest.raises(ValueError):
        readers.read_glucose(spark, str(tmp_path / "*.csv"))


def test_rows_keep_the_order_of_files(spark, tmp_path):
    for name, lines in (("b", 3), ("a", 400)):  # the smaller file is read later in any scan that goes by size
        (tmp_path / f"{name}.csv").write_text("who,at,counts\n" + "".join(f"1,2020-01-01 00:00:00,{k}\n" for k in range(lines)))
    cfg = SourceConfig(("counts",), "at", pid="who", strftime="%Y-%m-%d %H:%M:%S")
    x = readers.read_epochs(spark, [str(tmp_path / "b.csv"), str(tmp_path / "a.csv")], cfg).orderBy("hyp_row").collect()
    assert [r.hyp_act_x for r in x] == [*range(400), *range(3)] and [r.hyp_row for r in x] == [*range(1, 404)]


def test_side_tables(spark):
    d = spark.createDataFrame([(1, "2020-01-01 22:00:00", ""), (2, None, "bad")], "pid int, sleep_onset string, sleep_offset string")
    assert [tuple(r) for r in readers.diary(d).collect()] == [("1", datetime(2020, 1, 1, 22), None), ("2", None, None)]
    p = spark.createDataFrame([(1, "22:30", "5", "x"), (2, "L", "x", "x")], "id int, bed string, age string, extra string")
    assert [tuple(r) for r in readers.demographics(p, pid="id", clocks=["bed"], columns=["bed", "age"]).collect()] == [("1", 81000.0, 5.0), ("2", None, None)]
    with pytest.raises(KeyError):
        readers.diary(d.drop("pid"))


def test_clean_watch(spark):
    rows = [(1, 1, "2020-01-01 00:00:30", None, None), (1, 2, None, 65500, 60), (1, 3, None, 24, 20), (1, 4, None, 84, 80), (1, 5, None, None, 9), (1, 6, None, 264, 70)]
    x = readers.clean_watch(spark.createDataFrame(rows, "f int, k int, timestamp string, timestamp_16 int, heart_rate int"), file="f", order="k").orderBy("minute_s").collect()
    assert [r.heart_rate for r in x] == [60, 60, 80, 80, 80, 70] and x[1].minute_s - x[0].minute_s == 60


def test_stream_and_batch_agree(spark, tmp_path):
    rows = [("1", datetime(2020, 1, 1, h), h % 2) for h in range(24)] + [("1", datetime(2020, 1, 1, 3), 1), ("2", datetime(2020, 1, 2), None)]
    x = spark.createDataFrame(rows, "pid string, hyp_time_col timestamp, v int")
    x.write.parquet(str(tmp_path / "in"))
    s = EpochSchema(freq_s=3600)
    stream = daily_stream(spark.readStream.schema(x.schema).parquet(str(tmp_path / "in")), s, label="v")
    q = stream.writeStream.format("memory").queryName("daily").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    q.awaitTermination(60)
    assert sorted(map(tuple, spark.table("daily").collect())) == sorted(map(tuple, daily_stream(x, s, label="v").collect()))
