"""Queries of problem 3: implausible spikes in measurements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epochloom.operators.spikes import flag
from epochloom.runtime import table


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with a reading that the wearer can't have had."""
    watch = flag(table(spark, sf_dir, "test_1"), value="heart_rate", source="file_id", counter="timestamp_16")
    epochs = flag(table(spark, sf_dir, "small_collection_fenland_full"), value="mean_hr", source="id")
    tagged = [d.select(F.lit(n).alias("tbl"), "row_id") for n, d in (("test_1", watch), ("small_collection_fenland_full", epochs))]
    return tagged[0].unionByName(tagged[1])


QUERIES = {"p3_found": p3_found}
ORACLE_SQL: dict[str, str] = {}
