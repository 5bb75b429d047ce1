"""Window operators over participants of any length, in blocks.

A window over a participant puts all its epochs into one task. That is the fastest plan while no participant is large; where
one may hold a good part of all rows, these variants give the same result with tasks of bounded size:

* :func:`apply` for operators whose windows reach a known number of rows: epochs get their number (a prefix sum over
  pre-aggregated blocks of time), are cut into blocks of rows, and each block gets a halo of its neighbours' rows.
* :func:`run_lengths` for runs, which know no bound: runs are numbered and measured per block of time, and only the
  first and last run of every block are chained.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from epochloom.operators.islands import run_value
from epochloom.schema import EpochSchema

_PAST = (Window.unboundedPreceding, -1)


def numbered(df: DataFrame, s: EpochSchema, *, out: str = "__idx", block_s: int = 86_400) -> DataFrame:
    """Add the number (from 0) of each epoch of its participant, without a window over a participant."""
    x = df.withColumn("__tb", F.floor(s.seconds(df) / block_s))
    sizes = x.groupBy(s.pid, "__tb").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(s.pid).orderBy("__tb").rowsBetween(*_PAST)), F.lit(0))
    x = x.withColumn("__k", F.row_number().over(s.window("__tb")))
    x = x.join(sizes.select(s.pid, "__tb", before.alias("__b")), [s.pid, "__tb"])
    return x.withColumn(out, F.col("__b") + F.col("__k") - 1).drop("__tb", "__k", "__b")


def apply(df: DataFrame, s: EpochSchema, op: Callable[[DataFrame, EpochSchema], DataFrame], *, before: int, after: int, rows: int = 50_000, block_s: int = 86_400) -> DataFrame:
    """``op(df, schema)`` for an operator whose result at an epoch depends on ``before`` rows before and ``after`` after it.

    Chained windows add up their reaches. Participant and time must not be null.
    """
    if before >= rows or after >= rows:
        raise ValueError("a block must be longer than the reach")
    x = numbered(df, s, block_s=block_s)
    own = F.floor(F.col("__idx") / rows)
    at = F.col("__idx") - own * rows
    homes = F.array_compact(F.array(own, F.when((at < after) & (own > 0), own - 1), F.when(at >= rows - before, own + 1)))
    x = x.withColumn("__own", own).withColumn("__blk", F.explode(homes)).drop("__idx")
    return op(x, s.at(blocks=(*s.blocks, "__blk"))).where("__own = __blk").drop("__own", "__blk")


def run_lengths(df: DataFrame, col: str, s: EpochSchema, *, length: str = "hyp_seq_length", seq: str = "hyp_seq_id", block_s: int = 86_400) -> DataFrame:
    """As :func:`epochloom.operators.islands.run_lengths`, in blocks of time."""
    x = df.withColumn("__tb", F.floor(s.seconds(df) / block_s))
    w = s.window("__tb")
    v = run_value(df, col)
    x = x.withColumn("__v", v).withColumn("__new", (F.lag(F.lit(1)).over(w).isNull() | ~v.eqNullSafe(F.lag(v).over(w))).cast("int"))
    x = x.withColumn("__r", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    pieces = x.groupBy(s.pid, "__tb", "__r").agg(F.first("__v").alias("__v"), F.count("*").alias("__n"))
    pieces = pieces.withColumn("__last", F.max("__r").over(Window.partitionBy(s.pid, "__tb")))
    edges = pieces.where("__r = 1 or __r = __last")
    we = Window.partitionBy(s.pid).orderBy("__tb", "__r")
    joined = (F.col("__r") == 1) & F.lag("__v").over(we).eqNullSafe(F.col("__v")) & (F.lag("__tb").over(we) < F.col("__tb"))
    edges = edges.withColumn("__joined", F.coalesce(joined.cast("int"), F.lit(0)))
    edges = edges.withColumn("__chain", F.sum(1 - F.col("__joined")).over(we.rowsBetween(Window.unboundedPreceding, 0)))
    edges = edges.withColumn("__total", F.sum("__n").over(Window.partitionBy(s.pid, "__chain")))
    heads = edges.where("__r = 1")
    wb = Window.partitionBy(s.pid).orderBy("__tb")
    # runs of the blocks before, less those that go on in the next block
    heads = heads.withColumn("__base", F.coalesce(F.sum("__last").over(wb.rowsBetween(*_PAST)), F.lit(0)) - F.sum("__joined").over(wb.rowsBetween(Window.unboundedPreceding, 0)))
    per_block = heads.select(s.pid, "__tb", "__base")
    pieces = pieces.join(per_block, [s.pid, "__tb"]).join(edges.select(s.pid, "__tb", "__r", "__total"), [s.pid, "__tb", "__r"], "left")
    got = pieces.select(s.pid, "__tb", "__r", (F.col("__base") + F.col("__r") - 1).cast("int").alias(seq), F.coalesce("__total", "__n").cast("int").alias(length))
    return x.drop("__v", "__new").join(got, [s.pid, "__tb", "__r"]).drop("__tb", "__r")
