from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from epochloom.operators import blocks, features, islands, scoring
from epochloom.schema import EpochSchema

S = EpochSchema(activity=("v",), freq_s=60)
T0 = datetime(2024, 1, 1)


def frame(spark, n=2_000, seed=0):
    rng = np.random.default_rng(seed)
    rows, t = [], 0
    for k in range(n):
        t += int(rng.choice([60, 600, 40_000], p=[0.95, 0.04, 0.01]))
        rows.append(("p" if k % 3 else "q", T0 + timedelta(seconds=t), float(rng.choice([0, 30, 300])), bool(rng.random() < 0.5) if k > 400 else True, k))
    return spark.createDataFrame(rows, "pid string, hyp_time_col timestamp_ntz, v double, f boolean, k int")


def same(a, b):
    a, b = (x.orderBy("k").toPandas() for x in (a, b))
    pd.testing.assert_frame_equal(a[sorted(a.columns)], b[sorted(a.columns)])


@pytest.mark.parametrize("block_s", [3_600, 86_400, 10**9])
def test_run_lengths(spark, block_s):
    x = frame(spark)
    same(islands.run_lengths(x, "f", S), blocks.run_lengths(x, "f", S, block_s=block_s))
    nulls = x.withColumn("f", F.when(F.col("k") % 5 > 0, F.col("f")))
    same(islands.run_lengths(nulls, "f", S), blocks.run_lengths(nulls, "f", S, block_s=block_s))
    assert blocks.run_lengths(x.limit(0), "f", S).count() == 0


@pytest.mark.parametrize("rows", [41, 100, 5_000])
def test_scores(spark, rows):
    x = frame(spark)
    both = lambda df, s: scoring.score_all(df, s)
    same(both(x, S), blocks.apply(x, S, both, before=40, after=40, rows=rows, block_s=7_200))
    with pytest.raises(ValueError):
        blocks.apply(x, S, both, before=40, after=40, rows=40)


def test_numbers(spark):
    x = blocks.numbered(frame(spark), S, out="i", block_s=5_000).select("pid", "k", "i").toPandas().sort_values("k")
    assert all((g.i.to_numpy() == np.arange(len(g))).all() for _, g in x.groupby("pid"))


def test_small_features(spark):
    x = spark.createDataFrame([("a", 3, 1.0, None), ("b", None, 2.0, 4.0), ("c", 0, 3.0, 6.0), ("d", 5, 4.0, 8.0)], "p string, stage int, x double, y double")
    assert [r[0] for r in x.select(features.annotation_from(F.col("stage"), [3, 5])).collect()] == [True, False, False, True]
    assert [r[0] for r in x.select(features.annotation_from(F.col("stage"), negate=True)).collect()] == [False, False, True, False]
    assert [r.met_minutes for r in features.met_minutes(x, {"x": 3, "y": 6}).collect()] == [21, 210, 315, 420]
    assert features.melt(x, ["p"], ["x", "y"]).count() == 8
    assert x.select(features.pad_sequence(F.array(F.lit(1.0)), 3)).first()[0] == [1, 0, 0] and x.select(features.pad_sequence(F.lit(None).cast("array<double>"), 1)).first()[0] == [0]
    model = features.linear_fit(x, ["x"], "y")
    assert abs(model.coefficients[0] - 2) < 1e-6 and abs(model.intercept) < 1e-6
