"""Queries of problem 1: mixed timestamp formats and time zones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epochloom.operators.timestamps import normalise
from epochloom.runtime import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One UTC instant per readable text of both tables."""
    zones = table(spark, sf_dir, "recorders")
    watch = normalise(table(spark, sf_dir, "test_1"), zones, text="timestamp", source="file_id", counter="timestamp_16")
    epochs = normalise(table(spark, sf_dir, "small_collection_fenland_full"), zones, text="real_time", source="id")
    tagged = [d.select(F.lit(n).alias("tbl"), "row_id", "utc_us") for n, d in (("test_1", watch), ("small_collection_fenland_full", epochs))]
    return tagged[0].unionByName(tagged[1])


QUERIES = {"p1_found": p1_found}
ORACLE_SQL: dict[str, str] = {}
