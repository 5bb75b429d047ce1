"""An operator over a grid of parameters, in one query."""

from __future__ import annotations

import itertools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epochloom.schema import EpochSchema


def grid(spark: SparkSession, **values: list) -> DataFrame:
    """(``param_id``, one column a parameter): every combination, numbered in order."""
    rows = [(i, *c) for i, c in enumerate(itertools.product(*values.values()))]
    return spark.createDataFrame(rows, ["param_id", *values])


def sweep(df: DataFrame, params: list[dict], operator: Callable[..., DataFrame], s: EpochSchema) -> DataFrame:
    """Union of ``operator(df, s, **p)`` with ``param_id``: every branch has the same exchange below, which Spark reuses."""
    out = None
    for i, p in enumerate(params):
        one = operator(df, s, **p).withColumn("param_id", F.lit(i))
        out = one if out is None else out.unionByName(one)
    return out


def quantile_sweep(df: DataFrame, value: str, quantiles: list[float], s: EpochSchema) -> DataFrame:
    """(pid, day, ``param_id``, ``quantile``, ``threshold``): all quantiles of a day from one sort."""
    qs = F.array(*[F.lit(float(q)) for q in quantiles])
    per = df.groupBy(s.pid, s.day).agg(F.percentile(F.col(value).cast("double"), qs).alias("t"))
    return per.select(s.pid, s.day, F.posexplode(F.arrays_zip(qs.alias("quantile"), F.col("t").alias("threshold"))).alias("param_id", "z")).select(s.pid, s.day, "param_id", "z.quantile", "z.threshold")
