"""Readers and writers of epoch files, diaries, glucose exports and demographics."""

from __future__ import annotations

import csv
import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from epochloom.operators.days import clock_seconds
from epochloom.schema import EpochSchema, SourceConfig

# Directives of strptime and the datetime pattern letters that mean the same.
_DIRECTIVES = {"Y": "yyyy", "y": "yy", "m": "MM", "d": "dd", "H": "HH", "I": "hh", "M": "mm", "S": "ss", "f": "SSSSSS", "p": "a", "b": "MMM", "B": "MMMM", "a": "EEE", "A": "EEEE", "j": "DDD", "%": "%"}


def java_pattern(strptime: str) -> str:
    """A strptime format as a datetime pattern; letters between directives are quoted."""
    out, i = "", 0
    while i < len(strptime):
        c = strptime[i]
        if c == "%":
            if i + 1 == len(strptime) or strptime[i + 1] not in _DIRECTIVES:
                raise ValueError(f"unsupported format {strptime!r}")
            out, i = out + _DIRECTIVES[strptime[i + 1]], i + 2
            continue
        out, i = out + (f"'{c}'" if c.isalpha() else c), i + 1
    return out


def read_file(spark: SparkSession, path: str | list[str], schema: str | T.StructType | None = None) -> DataFrame:
    """CSV files, also gzipped, with header. Binary device formats aren't supported."""
    names = [path] if isinstance(path, str) else path
    for n in names:
        if n.endswith((".cwa", ".bin", ".dat", ".fit")):
            raise NotImplementedError(f"binary device file {n!r}")
    reader = spark.read.option("header", True)
    return (reader.schema(schema) if schema else reader).csv(path)


def _number(c: str) -> Column:
    v = F.col(f"`{c}`").cast("string").try_cast("double")
    return F.when(~F.isnan(v), v)


def _clock_dates(df: DataFrame, cfg: SourceConfig, pid: Column) -> Column:
    """Date and time from a day of week and a time of day: January 2017, epochs equally spaced from the first row."""
    w = Window.partitionBy(pid).orderBy("hyp_row")
    all_rows = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sec = clock_seconds(F.col(cfg.datetime).cast("string"))
    first, second = F.first(sec).over(all_rows), F.nth_value(sec, 2).over(all_rows)
    step = F.pmod(second - first, F.lit(60))
    dow = F.first(F.col(cfg.day_of_week).cast("int")).over(all_rows)
    start = F.when(dow.between(1, 31) & step.between(1, 59), (F.unix_date(F.make_date(F.lit(2017), F.lit(1), dow)).cast("bigint") * 86_400 + first))
    return (F.expr("timestamp_ntz'1970-01-01 00:00:00'") + F.make_dt_interval(secs=(start + (F.row_number().over(w) - 1) * step).cast("decimal(18,6)"))).alias("t")


def standardise(df: DataFrame, cfg: SourceConfig, *, pid: str | None = None, order: str | None = None) -> DataFrame:
    """Add the canonical columns to the source's: ``pid``, ``hyp_time_col``, ``hyp_row``, ``hyp_act_x/y/z``, and where configured
    ``hyp_hr``, ``hyp_mets`` and ``hyp_annotation``, and ``cfg.extra`` (such as the place of the device) as constant columns. One table
    may hold many participants.

    A number that can't be read, or NaN, is null. ``order`` names a column in order of measuring; without one, rows keep
    the order of their file.
    """
    if not 1 <= len(cfg.activity) <= 3:
        raise ValueError("needs one to three activity columns")
    for c in (*cfg.activity, cfg.datetime, *([cfg.hr] if cfg.hr else []), *([cfg.mets] if cfg.mets else []), *([cfg.day_of_week] if cfg.day_of_week and not cfg.strftime else [])):
        if c not in df.columns:
            raise ValueError(f"no column {c!r}")
    if pid is None and cfg.pid is None:
        raise ValueError("needs a participant or a participant column")
    if pid is None and cfg.pid not in df.columns:
        raise ValueError(f"no participant column {cfg.pid!r}")
    if cfg.strftime is None and cfg.day_of_week is None:
        raise ValueError("dates can't be reconstructed without a format or a day of week")
    who = F.lit(pid) if pid is not None else F.col(cfg.pid).cast("string")
    x = df.withColumn("hyp_row", F.col(order) if order else F.monotonically_increasing_id())
    x = x.withColumn("__pid", who)
    time = F.to_timestamp_ntz(F.col(cfg.datetime).cast("string"), F.lit(java_pattern(cfg.strftime))) if cfg.strftime else _clock_dates(x, cfg, F.col("__pid"))
    cols = {"hyp_time_col": time, **{f"hyp_act_{k}": _number(c) for k, c in zip("xyz", cfg.activity)}}
    if cfg.hr:
        cols["hyp_hr"] = _number(cfg.hr)
    if cfg.mets:
        cols["hyp_mets"] = _number(cfg.mets)
    if cfg.annotation and cfg.annotation[0] in df.columns:
        cols["hyp_annotation"] = F.coalesce(F.col(cfg.annotation[0]).isin(list(cfg.annotation[1])), F.lit(False))
    cols |= {k: F.lit(v) for k, v in cfg.extra.items()}
    keep = [c for c in x.columns if c not in (*cols, "pid", "__pid")]
    return x.select(F.col("__pid").alias("pid"), *[F.col(f"`{c}`") for c in keep], *[v.alias(k) for k, v in cols.items()])


def read_epochs(spark: SparkSession, path: str | list[str], cfg: SourceConfig, *, schema=None, pid: str | None = None) -> DataFrame:
    """Read files (glob or list) of one format as one epoch table; ``hyp_row`` numbers a participant's rows by file and place in it."""
    x = read_file(spark, path, schema)
    if pid is None and cfg.pid not in x.columns:
        raise ValueError(f"no participant column {cfg.pid!r}")
    # within a part of a file, rows are numbered in order
    x = x.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__part"), F.monotonically_increasing_id().alias("__id"))
    w = Window.partitionBy(F.lit(0) if pid is not None else F.col(cfg.pid)).orderBy("__file", "__part", "__id")
    return standardise(x.withColumn("__order", F.row_number().over(w)), cfg, pid=pid, order="__order").drop("__file", "__part", "__id", "__order")


def write_epochs(df: DataFrame, s: EpochSchema, path: str, *, buckets: int = 64) -> None:
    """Parquet, partitioned by a hash of the participant (participants themselves would make tiny files), and the schema beside it."""
    bucketed = df.withColumn("pid_bucket", F.pmod(F.xxhash64(s.pid), F.lit(buckets)).cast("int"))
    bucketed.repartition("pid_bucket").write.mode("overwrite").partitionBy("pid_bucket").parquet(f"{path}/epochs")
    text = json.dumps({k: list(v) if isinstance(v, tuple) else v for k, v in s.__dict__.items()})
    df.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/schema")


def read_saved(spark: SparkSession, path: str) -> tuple[DataFrame, EpochSchema]:
    """What :func:`write_epochs` wrote."""
    kept = json.loads(spark.read.text(f"{path}/schema").first()["value"])
    kept |= {k: tuple(kept[k]) for k in ("activity", "blocks")}
    return spark.read.parquet(f"{path}/epochs").drop("pid_bucket"), EpochSchema(**kept)


def diary(df: DataFrame) -> DataFrame:
    """``pid``, ``sleep_onset``, ``sleep_offset`` with their types."""
    if "pid" not in df.columns:
        raise KeyError("pid")
    return df.select(F.col("pid").cast("string").alias("pid"), *[F.col(c).try_cast("timestamp_ntz").alias(c) for c in ("sleep_onset", "sleep_offset")])


def glucose(df: DataFrame, *, pid: str | None = None, pattern: str = "MM-dd-yyyy hh:mm a") -> DataFrame:
    """A glucose export as ``pid``, ``device``, ``serial``, ``hyp_time_col``, ``auto0_man1``, ``gluc_mgdl``, ``ket_mmol``.

    Historic and scanned values are added, a missing one counting as 0, so a record of neither is 0.
    """
    col = lambda c: F.col(f"`{c}`")
    value = lambda c: F.coalesce(col(c).cast("string").try_cast("double"), F.lit(0.0))
    return df.select(
        (F.lit(pid) if pid is not None else F.lit("-1")).alias("pid"), col("Device").alias("device"), col("Serial Number").alias("serial"),
        F.to_timestamp_ntz(col("Device Timestamp"), F.lit(pattern)).alias("hyp_time_col"), col("Record Type").cast("string").try_cast("int").alias("auto0_man1"),
        (value("Historic Glucose mg/dL") + value("Scan Glucose mg/dL")).alias("gluc_mgdl"), col("Ketone mmol/L").cast("string").try_cast("double").alias("ket_mmol"),
    )


def read_glucose(spark: SparkSession, path: str, **kwargs) -> DataFrame:
    """Glucose export files, whose header is the second line; files of one header are read together.

    Lines are told by their place in their file. A quoted field may hold commas, but no line break.
    """
    lines = spark.read.text(path).select(F.rtrim("value", F.lit("\r")).alias("value"), F.col("_metadata.file_path").alias("f"), F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("at"))
    first = lines.where("at.file_block_start = 0").groupBy("f").agg(F.min("at").alias("a"))
    second = lines.join(first, "f").where("at > a").groupBy("f").agg(F.min_by("value", "at").alias("header"), F.min("at").alias("b"))
    headers = [r["header"] for r in second.select("header").distinct().limit(2).collect()]
    if len(headers) != 1:
        raise ValueError("needs files with one and the same header")
    fields = ", ".join(f"`{h.strip()}` string" for h in next(csv.reader(headers)))
    parsed = lines.join(second, "f").where((F.col("at") > F.col("b")) & (F.trim("value") != "")).select(F.from_csv("value", fields).alias("r"))
    return glucose(parsed.select("r.*"), **kwargs)


def demographics(df: DataFrame, *, pid: str, clocks: list[str] = (), columns: list[str] | None = None, fill: float | None = None) -> DataFrame:
    """Attributes as numbers, clock texts as seconds since midnight; null if unreadable, or ``fill``."""
    if pid not in df.columns:
        raise KeyError(pid)
    names = [c for c in (columns or df.columns) if c != pid]
    cols = {c: (clock_seconds(F.col(c).cast("string")) if c in clocks else F.col(c).cast("string")).try_cast("double") for c in names}
    return df.select(F.col(pid).cast("string").alias(pid), *[(F.coalesce(v, F.lit(float(fill))) if fill is not None else v).alias(c) for c, v in cols.items()])


def clean_watch(df: DataFrame, *, file: str, order: str, low: float = 25) -> DataFrame:
    """Lines of one watch file format (first lines with a text time, then readings with a 16-bit counter) to one row a minute.

    Lines without either are dropped, rates below ``low`` are null, the one most negative step of the counter (its wrap) counts as
    60 s, and the running sum starts at the first text time. Minutes are means, gaps take the value before, else after. For
    files of many days, other time texts or several wraps use the operators of ``grid`` and ``timestamps``.
    """
    w = Window.partitionBy(file).orderBy(order)
    x = df.where(F.col("timestamp").isNotNull() | F.col("timestamp_16").isNotNull())
    start = F.first(F.col("timestamp").try_cast("timestamp_ntz"), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    x = x.withColumn("__start", start).where(F.col("timestamp_16").isNotNull())
    x = x.withColumn("__d", F.coalesce(F.col("timestamp_16") - F.lag("timestamp_16").over(w), F.lit(0)))
    x = x.withColumn("__min", F.min("__d").over(Window.partitionBy(file)))
    x = x.withColumn("__d", F.when((F.col("__d") == F.col("__min")) & (F.col("__min") < 0), 60).otherwise(F.col("__d")))
    at = EpochSchema(time="__start").seconds(x) + F.sum("__d").over(w.rowsBetween(Window.unboundedPreceding, 0))
    hr = F.when(F.col("heart_rate") >= low, F.col("heart_rate").cast("double"))
    m = x.select(F.col(file).alias("f"), F.floor(at / 60).alias("m"), hr.alias("v")).groupBy("f", "m").agg(F.avg("v").alias("v"))
    ends = m.where("m is not null").groupBy("f").agg(F.min("m").alias("a"), F.max("m").alias("b"))
    g = ends.select("f", F.explode(F.sequence("a", "b")).alias("m")).join(m, ["f", "m"], "left")
    wm = Window.partitionBy("f").orderBy("m")
    v = F.coalesce(F.last("v", ignorenulls=True).over(wm.rowsBetween(Window.unboundedPreceding, 0)), F.last("v", ignorenulls=True).over(Window.partitionBy("f").orderBy(F.desc("m")).rowsBetween(Window.unboundedPreceding, 0)))
    return g.select(F.col("f").alias(file), (F.col("m") * 60).alias("minute_s"), v.alias("heart_rate"))
