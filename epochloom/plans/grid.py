"""Queries of problem 4: irregular readings onto a regular grid."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epochloom.operators.grid import bucket, impute, resolve_counter
from epochloom.operators.spikes import ChartConfig
from epochloom.operators.timestamps import normalise
from epochloom.runtime import spill, table


def minute_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole minute of every file with its heart rate and whether it was filled."""
    lines = table(spark, sf_dir, "test_1")
    texts = normalise(lines, table(spark, sf_dir, "recorders"), text="timestamp", source="file_id", counter="timestamp_16")
    reads = lines.where(F.col("heart_rate").isNotNull()).select("file_id", "line_no", "row_id", "timestamp_16", "heart_rate")
    timed = resolve_counter(reads, spill(texts), source="file_id")
    # impossible values and spikes still tell that a reading fell into the minute, but must not shape the imputation
    charts = ChartConfig()
    sane = F.when(F.col("heart_rate").between(charts.low, charts.high), F.col("heart_rate"))
    return impute(spill(bucket(timed.withColumn("sane", sane), source="file_id", value="sane")), source="file_id", charts=charts)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole minutes between a file's first and last reading into which no reading falls."""
    return minute_grid(spark, sf_dir).where("filled").select("file_id", (F.col("bucket") * 60).alias("minute_s"))


def p4_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The regular series: one row per file and minute with value and marks."""
    return minute_grid(spark, sf_dir).select("file_id", (F.col("bucket") * 60).alias("minute_s"), F.round("value", 3).alias("heart_rate"), "filled", "converged")


QUERIES = {"p4_found": p4_found, "p4_grid": p4_grid}
ORACLE_SQL: dict[str, str] = {}
