"""Runs of equal consecutive events, collapsed to one record each with count and duration.

Every event is compared with its predecessor in a lag window, changes are flagged, the running sum of flags numbers
the runs, and runs are aggregated. The window works on (source, block of time); a run that crosses blocks is put
together from its pieces afterwards. Only the first and last piece of a block take part in that, so no task holds
more of a source than one block, or two rows per block.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from epochloom.functions.time import epoch_seconds
from epochloom.runtime import spill


def collapse_runs(
    df: DataFrame, *, source: str, time: str, value: str, received: str, key: str, step: float | None = 0.5, max_gap_s: int = 300, epoch_s: int = 30, block_s: int = 86_400
) -> DataFrame:
    """One row per longest run: ``source``, ``value`` (level), ``run_start_s``, ``run_end_s``, ``n_epochs``, ``duration_s``.

    Rows of one source and time are one event; the one with the latest ``received`` counts, of equal ones that with the
    largest ``key`` (null counts as earliest). With ``step`` two values are equal if they round to the same multiple
    of it (half up), which becomes the level; without, if they are the same, whatever their type. A null or NaN event
    is in no run and ends the one before; so does a pause of more than ``max_gap_s``. Rows with null source or time
    are left out, rows repeated in full count once, an empty table gives an empty result.
    """
    at = epoch_seconds(F.col(f"`{time}`"), df.schema[time].dataType)
    v = F.col(f"`{value}`")
    if step:
        number = v.cast("double")
        v = F.when(~F.isnan(number), F.floor(number / step + 0.5) * F.lit(float(step)))
    rows = df.select(F.col(f"`{source}`").alias("s"), at.alias("t"), v.alias("v"), F.struct(F.col(f"`{received}`").alias("r"), F.col(f"`{key}`").alias("k")).alias("o"))
    rows = rows.where(F.col("s").isNotNull() & F.col("t").isNotNull()).withColumn("b", F.floor(F.col("t") / block_s)).repartition("s", "b")
    events = rows.groupBy("s", "b", "t").agg(F.max_by("v", "o").alias("v"))
    w = Window.partitionBy("s", "b").orderBy("t")
    same = (F.col("v") == F.lag("v").over(w)) & (F.col("t") - F.lag("t").over(w) <= max_gap_s)
    pieces = events.select("*", F.when(same, 0).otherwise(1).alias("f")).select("*", F.sum("f").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("run"))
    pieces = pieces.groupBy("s", "b", "run").agg(F.first("v").alias("v"), F.min("t").alias("t0"), F.max("t").alias("t1"), F.count("*").alias("n"))
    pieces = pieces.select("*", (F.col("run") == F.max("run").over(Window.partitionBy("s", "b"))).alias("last"))
    pieces = spill(pieces)  # two branches read them
    edge = (F.col("run") == 1) | F.col("last")
    inner = pieces.where(~edge).select("s", "v", "t0", "t1", "n")
    we = Window.partitionBy("s").orderBy("t0")
    joins = (F.col("run") == 1) & F.lag("last").over(we) & (F.lag("b").over(we) < F.col("b")) & (F.lag("v").over(we) == F.col("v")) & (F.col("t0") - F.lag("t1").over(we) <= max_gap_s)
    edges = pieces.where(edge).select("*", F.when(joins, 0).otherwise(1).alias("f")).select("*", F.sum("f").over(we.rowsBetween(Window.unboundedPreceding, 0)).alias("g"))
    outer = edges.groupBy("s", "g").agg(F.first("v").alias("v"), F.min("t0").alias("t0"), F.max("t1").alias("t1"), F.sum("n").alias("n")).drop("g")
    runs = inner.unionByName(outer).where(F.col("v").isNotNull())
    return runs.select(
        F.col("s").alias(source), F.col("v").alias(value), F.col("t0").alias("run_start_s"), F.col("t1").alias("run_end_s"),
        F.col("n").cast("int").alias("n_epochs"), (F.col("t1") - F.col("t0") + epoch_s).alias("duration_s"),
    )
