from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from epochloom import plans
from epochloom.operators import activity, blocks, boundaries, circadian, days, features, islands, joins, metrics, nonwear, scoring, sweep, validate, views
from epochloom.schema import EpochSchema, InvCode

S = EpochSchema(freq_s=60)
T0 = datetime(2024, 1, 1)


def epochs(spark, values, col="v", kind="double", pid="p", step=60, start=T0):
    rows = [(pid, start + timedelta(seconds=step * k), v) for k, v in enumerate(values)]
    return spark.createDataFrame(rows, f"pid string, hyp_time_col timestamp_ntz, {col} {kind}")


def column(df, name):
    return [r[0] for r in df.orderBy("pid", "hyp_time_col").select(name).collect()]


def test_run_lengths(spark):
    x = islands.run_lengths(epochs(spark, [True, True, True, False, False], kind="boolean"), "v", S)
    assert column(x, "hyp_seq_length") == [3, 3, 3, 2, 2] and column(x, "hyp_seq_id") == [0, 0, 0, 1, 1]
    x = islands.run_lengths(epochs(spark, [None, False, True, None, None], kind="boolean"), "v", S)
    assert column(x, "hyp_seq_id") == [0, 0, 1, 2, 2]
    assert islands.run_lengths(epochs(spark, []), "v", S).count() == 0


@pytest.mark.parametrize(("minutes", "want"), [(3, [True] * 4), (2, [True, False, False, True]), (-1, [True] * 4), (0, [True, False, False, True])])
def test_merge_tolerance(spark, minutes, want):
    assert column(islands.merge_tolerance(epochs(spark, [True, False, False, True], kind="boolean"), "v", minutes, S), "v") == want


def test_merge_without_true(spark):
    assert column(islands.merge_tolerance(epochs(spark, [False, None], kind="boolean"), "v", 5, S), "v") == [False, False]


def test_largest_run_takes_the_first_of_equal_ones(spark):
    x = islands.largest_run(epochs(spark, [True] * 2 + [False] + [True] * 3 + [False] + [True] * 3, kind="boolean"), "v", S, out="o")
    assert column(x, "o") == [False] * 3 + [True] * 3 + [False] * 4
    assert column(islands.largest_run(epochs(spark, [False, None], kind="boolean"), "v", S, out="o"), "o") == [False, False]


def test_day_night_sequence(spark):
    x = epochs(spark, [True, False, False, True, False], kind="boolean")
    a, s = islands.day_night_sequence(x, "v", S)
    assert s.day == "ml_sequence" and column(a, "ml_sequence") == [-1, 0, 0, 0, 1]
    b, _ = islands.day_night_sequence(x, "v", S, start_by_awaken=False)
    assert column(b, "ml_sequence") == [0, 0, 0, 1, 1]
    with pytest.raises(ValueError):
        islands.day_night_sequence(epochs(spark, [1.0]), "v", S)


def test_day_starts_at_its_hour(spark):
    x = epochs(spark, [0.0, 0.0], start=datetime(2024, 1, 1, 17, 59, 30), step=30)
    assert column(days.with_day(x, S, 18), S.day) == [-1, 0] and column(days.with_day(x, S), S.day) == [0, 0]


def test_clock(spark):
    x = spark.createDataFrame([("09:30",), ("21:29:59",), ("H",), (None,), ("1:2:3:4",), ("",)], "c string").select(days.clock_seconds(F.col("c")))
    assert [r[0] for r in x.collect()] == [34200, 77399, None, None, None, None]


def test_frequency(spark):
    assert days.frequency(epochs(spark, [1.0] * 3), S).first().freq_s == 60 and EpochSchema().per_minute == 2 and EpochSchema().per_hour == 120
    uneven = epochs(spark, [1.0] * 3).where("hyp_time_col <> timestamp_ntz'2024-01-01 00:01:00'").unionByName(epochs(spark, [1.0], start=T0 + timedelta(hours=1)))
    assert days.frequency(uneven, S).first().freq_s is None
    with pytest.raises(ValueError):
        days.frequency(uneven, S, strict=True)


def brute_webster(labels, rules):
    s = pd.Series(labels, dtype=float)
    frames = {"a": [(-4, -1)], "b": [(-10 - k, -1 - k) for k in range(3)], "c": [(-15 - k, -1 - k) for k in range(4)], "d": [(-15, -6), (6, 15)], "e": [(-29, -10), (10, 29)]}
    for r in rules:
        keep = [all(sum(s[max(0, i + a) : max(0, i + b + 1)]) > 0 for a, b in frames[r]) for i in range(len(s))]
        s = s.where(pd.Series(keep), 0)
    return s.astype(int).tolist()


@pytest.mark.parametrize("rules", ["a", "abcde", "de", ""])
def test_webster(spark, rules):
    labels = np.random.default_rng(1).integers(0, 2, 200).tolist()
    x = scoring.rescore(epochs(spark, labels, kind="int"), "v", S, rules=rules, out="o")
    assert column(x, "o") == brute_webster(labels, rules)
    with pytest.raises(ValueError):
        scoring.rescore(x, "v", S, rules="z", out="o")


def test_scores_on_quiet_and_busy_data(spark):
    s = S.at(activity=("v",))
    for values, want in (([0.0] * 60, 1), ([500.0] * 60, 0)):
        x = scoring.score_all(epochs(spark, values), s)
        for name in ("ScrippsClinic", "Oakley", "Cole-Kripke", "Sazonov", "Sadeh"):
            assert set(column(x, name)[15:-15]) == {want}, name
    assert column(scoring.score(epochs(spark, [None, 0.0]), "saznov", s), "saznov") == [1, 1]
    for bad in (lambda: scoring.score(epochs(spark, [1.0]), "nope", s), lambda: scoring.score(epochs(spark, [1.0]), "sadeh", s, activity="zz")):
        with pytest.raises(ValueError):
            bad()


def test_nonwear(spark):
    s = S.at(activity=("v",))
    flat = nonwear.detect_nonwear(epochs(spark, [0.0] * 120 + [10.0] * 3), s)
    assert column(flat, s.wearing) == [0] * 122 + [1] or column(flat, s.wearing) == [0] * 120 + [1] * 3
    assert column(nonwear.detect_nonwear(epochs(spark, [10.0] * 3 + [0.0] * 120), s), s.wearing) == [1] * 123
    assert set(column(nonwear.detect_nonwear(epochs(spark, [None] * 100 + [5.0] * 40), s), s.wearing)[:90]) == {0}
    with pytest.raises(ValueError):
        nonwear.detect_nonwear(flat, s, strategy="x")
    with pytest.raises(ValueError):
        nonwear.combine(flat, ["v"], "o")


def brute_nonwear(a, spike, win, tol, least, per_min):
    out, start, count, i = [1] * len(a), None, 0, 0
    for i, v in enumerate(a):
        if start is None and v <= 0:
            start, count = i, 0
        if start is None:
            continue
        count = count + 1 if v > 0 else 0
        bad = v > 0 and (sum(x > 0 for x in a[i + spike : i + win + 1]) > tol or sum(x > 0 for x in a[max(0, i - win) : max(0, i - 1)]) > tol)
        if bad or count >= 2 * per_min + 1:
            if i - start >= least:
                out[start:i] = [0] * (i - start)
            start = None
    return out


def test_nonwear_against_state_machine(spark):
    rng = np.random.default_rng(2)
    s = S.at(activity=("v",))
    for p in (0.01, 0.05, 0.2):
        a = np.where(rng.random(600) < p, 5.0, 0.0).tolist()
        got = column(nonwear.detect_nonwear(epochs(spark, a), s, min_period_minutes=30, window_minutes=20), s.wearing)
        assert got == brute_nonwear(a, 2, 20, 2, 30, 1)


def test_sleep_metrics(spark):
    s = S.at(day="d")
    x = epochs(spark, [0, 0, 1, 1, 0, 0, 0, 1, 0], kind="int").withColumn("d", F.lit(0))
    value = lambda m, **k: metrics.sleep_quality(x, m, "v", s, out="o", **k).first()["o"]
    assert value("awakening") == 2 and value("arousals", ignore_minutes=1) == 1
    y = epochs(spark, [1, 1, 0, 1], kind="int").withColumn("d", F.lit(0))
    assert metrics.sleep_quality(y, "se", "v", s, out="o").first()["o"] == 75 and metrics.sleep_quality(y, "se", "v", s, ignore_minutes=1, out="o").first()["o"] == 100
    none = metrics.sleep_quality(x.withColumn("per", F.lit(False)), "se", "v", s, period="per", out="o").collect()
    assert [r["o"] for r in none] == [0.0]
    with pytest.raises(ValueError):
        value("nope")
    with pytest.raises(KeyError):
        metrics.sleep_quality(x, "se", "zz", s)


def test_agreement(spark):
    x = spark.createDataFrame([(1, 1)] * 4 + [(0, 1)] * 1 + [(1, 0)] * 2 + [(0, 0)] * 3, "t int, p int").agg(*metrics.agreement_columns(F.col("t"), F.col("p"))).first()
    assert (round(x.accuracy, 6), round(x.precision, 6), round(x.recall, 6), round(x.kappa, 6)) == (0.7, 0.8, round(4 / 6, 6), 0.4)
    one = spark.createDataFrame([(1, 1)] * 3, "t int, p int").agg(*metrics.agreement_columns(F.col("t"), F.col("p"))).first()
    assert one.roc_auc is None and one.kappa is None and one.f1 == 1


def test_bins_count_bounds_twice(spark):
    s = S.at(day="d")
    x = epochs(spark, [58.0, 399.0]).withColumn("d", F.lit(0))
    r = activity.binned(x, activity.Cutoffs((58, 399), ("a", "b", "c")), "v", s, resolution="day").first()
    assert (r.a, r.b, r.c) == (1, 2, 0)
    with pytest.raises(ValueError):
        activity.Cutoffs((3, 1), ("a", "b", "c"))


def test_skew_kurtosis_equal_pandas(spark):
    for v in ([1.0, 2.0, 2.5, 9.0, 4.0], [1.0, 5.0, 7.0], [1.0, 2.0], [3.0] * 5):
        a, b = activity.skew_kurtosis(F.col("v"))
        r = spark.createDataFrame([(x,) for x in v], "v double").agg(a.alias("a"), b.alias("b")).first()
        for got, want in ((r.a, pd.Series(v).skew()), (r.b, pd.Series(v).kurt())):
            assert (got is None and np.isnan(want)) or abs(got - want) < 1e-9


def test_raw_day_pads(spark):
    s = S.at(day="d")
    x = epochs(spark, [3.0, 1.0]).withColumn("d", F.lit(0))
    assert activity.raw_day(x, "v", s, length=4).first().raw_pa == [3.0, 1.0, 0.0, 0.0] and activity.raw_day(x, "v", s, length=1).first().raw_pa == [3.0]


def test_consecutive_days(spark):
    s = S.at(day="d")
    rows = [("p", datetime(2024, 1, 1 + d), d, 0 if d in (0, 1, 2, 5, 6, 7) else 1) for d in range(8)]
    x = spark.createDataFrame(rows, "pid string, hyp_time_col timestamp_ntz, d int, hyp_invalid int")
    kept = lambda k: [r.d for r in validate.flag_day_consecutive(x, s, 3, keep=k).where("hyp_invalid = 0").orderBy("d").collect()]
    assert kept("first") == [0, 1, 2] and kept("all") == [0, 1, 2, 5, 6, 7]
    assert {r.d for r in validate.invalid_days(x, s).collect()} == {3, 4} and validate.remove_flagged_days(x, s).count() == 6
    assert {r.flag: r.n_days for r in validate.report(x, s).collect()}["FLAG_DAY_SHORT_SLEEP"] == 0
    assert x.where(InvCode.has(F.col("hyp_invalid"), InvCode.FLAG_EPOCH_PA)).count() == 2


def test_diary_and_readings(spark):
    x = epochs(spark, [1.0] * 5)
    at = lambda m: T0 + timedelta(minutes=m)
    diary = spark.createDataFrame([("p", at(1), at(2)), ("p", at(2), at(3)), ("p", at(4), None), ("q", at(0), at(4)), ("p", None, None)], "pid string, sleep_onset timestamp_ntz, sleep_offset timestamp_ntz")
    y = joins.add_diary(x, diary, S)
    assert y.count() == 5 and column(y, S.diary_sleep) == [False, True, True, True, False] and column(y, S.diary_onset) == [False, True, True, False, True]
    assert column(joins.add_diary(x, diary.limit(0), S), S.diary_sleep) == [False] * 5
    with pytest.raises(KeyError):
        joins.add_diary(x, diary.drop("pid"), S)
    z = joins.add_readings(x, epochs(spark, [7.0], start=at(30)), S)
    assert z.count() == 6 and "v_cgm" in z.columns
    people = spark.createDataFrame([("p", 3, 5.0)], "who string, age int, v double")
    assert joins.add_demographics(x, people, S, pid="who", strict=True).first().age == 3
    with pytest.raises(KeyError):
        joins.add_demographics(x, people.limit(0), S, pid="who", strict=True)


def test_boundaries_contracts(spark):
    x = epochs(spark, [1.0] * 3)
    with pytest.raises(AttributeError):
        boundaries.detect(x, "hr", S)
    with pytest.raises(KeyError):
        boundaries.detect(x, "annotation", S)
    with pytest.raises(ValueError):
        boundaries.detect(x, "nope", S)
    assert boundaries.detect(x.limit(0), "hr", S.at(hr="v")).count() == 0


def test_heart_rate_boundary_finds_the_night(spark):
    hr = [80.0] * (8 * 60) + [50.0] * (7 * 60) + [80.0] * (9 * 60)
    x = boundaries.detect(epochs(spark, hr, start=T0 + timedelta(hours=15)), "hr", S.at(hr="v"), search=(15, 15), only_largest=True, quantile=0.2)
    asleep = [k for k, v in enumerate(column(x, "hyp_sleep_period")) if v]
    assert abs(asleep[0] - 8 * 60) < 10 and abs(asleep[-1] - 15 * 60) < 10


def test_angle_boundary(spark):
    rng = np.random.default_rng(0)
    a = np.concatenate([rng.normal(0, 40, 480), np.full(480, 3.0) + rng.normal(0, 0.01, 480), rng.normal(0, 40, 480)])
    x = boundaries.detect(epochs(spark, a.tolist(), start=T0 + timedelta(hours=15)), "angle", S, columns=("v",))
    asleep = [k for k, v in enumerate(column(x, "hyp_sleep_period")) if v]
    assert abs(asleep[0] - 480) < 15 and abs(asleep[-1] - 960) < 15


def test_z_angle(spark):
    x = spark.createDataFrame([(0.0, 0.0, 1.0), (0.0, 0.0, 0.0), (1.0, 0.0, 1.0), (None, 0.0, 1.0)], "x double, y double, z double").select(boundaries.z_angle(F.col("x"), F.col("y"), F.col("z")).alias("a"))
    assert [round(r.a, 6) for r in x.collect()] == [90.0, 0.0, 45.0, 0.0]


def test_cosinor(spark):
    s = S.at(day="d")
    h = np.arange(0, 24, 1 / 60)
    y = 50 + 20 * np.cos(2 * np.pi * (h - 15) / 24)
    x = epochs(spark, y.tolist()).withColumn("d", F.lit(0))
    r = circadian.cosinor(x, "v", s).first()
    assert abs(r.mesor - 50) < 1e-6 and abs(r.amplitude - 20) < 1e-3 and abs(r.acrophase - 15) < 0.02 and r.r2 > 0.999
    one = circadian.cosinor_single(x, "v", s).first()
    assert abs(one.mesor - 50) < 1e-6 and abs(one.amplitude - 20) < 1e-6
    assert circadian.cosinor(x.limit(3), "v", s).first().mesor is None
    parts, share = circadian.ssa_components(y - y.mean(), 400, 2)
    assert share.sum() > 0.99 and np.abs(parts.sum(axis=0) - (y - y.mean())).max() < 1.0
    assert abs(circadian.w_correlation(parts, 400)[0, 0] - 1) < 1e-9


def test_ssa_of_a_whole_series(spark):
    # 16 days over the 14-day mark 20160 * 1440 of minutes since 1970, which a cut at multiples of 20,160 steps would split
    rng, n, step, window = np.random.default_rng(2), 16 * 96, 900, 96
    first = 20_160 * 60 * 1440 - 8 * 86_400 + 6 * 3600
    y = 50 + 20 * np.sin(np.arange(n) / 96 * 2 * np.pi) + np.arange(n) / 100 + rng.normal(0, 2, n)
    epoch = datetime(1970, 1, 1)
    x = epochs(spark, y.tolist(), step=step, start=epoch + timedelta(seconds=first))
    for s in (step, 60):  # at 60 s the gaps are the mean
        z = y if s == step else np.full((n - 1) * 15 + 1, y.mean())
        if s == 60:
            z[::15] = y
        h = np.array([z[i : len(z) - window + 1 + i] for i in range(window)])
        u, d, v = np.linalg.svd(h, full_matrices=False)
        parts = []
        for r in range(2):
            m = np.outer(u[:, r] * d[r], v[r])[::-1]
            parts.append([np.mean(np.diagonal(m, o)) for o in range(1 - window, m.shape[1])])
        parts, share = np.array(parts), (d[:2] ** 2).sum() / (d**2).sum()
        at = first + np.arange(len(z)) * s
        want = {}
        for q in np.unique(at // 86_400):
            on, lit = at // 86_400 == q, (at // 86_400 == q) & (at % 86_400 >= 21_600) & (at % 86_400 <= 82_800)
            top = int(at[lit][parts.sum(axis=0)[lit].argmax()]) if lit.any() else None
            want[(epoch + timedelta(days=int(q))).date()] = (top, parts[0][on].mean())
        got = circadian.ssa(x, "v", S, step_s=s, window=window).orderBy("date").collect()
        assert [r.date for r in got] == sorted(want)  # one row a date
        tops = [want[r.date][0] for r in got]
        for i, r in enumerate(got):
            assert (r.acrophase and (r.acrophase - epoch).total_seconds()) == tops[i] and abs(r.trend - want[r.date][1]) < 1e-6 and abs(r.share - share) < 1e-9
            both = i and tops[i] is not None and tops[i - 1] is not None
            assert r.period_min == ((tops[i] - tops[i - 1]) / 60 if both else None)


def test_ssa_matrix(spark):
    n, window = 3000, 1440
    y = 50 + 20 * np.sin(np.arange(n) / 1440 * 2 * np.pi) + np.random.default_rng(4).normal(0, 3, n)
    x = epochs(spark, y.tolist()).unionByName(epochs(spark, [1.0] * 7, pid="short"))
    (r,) = circadian.ssa_matrix(x, "v", S).collect()
    u, d, v = np.linalg.svd(np.lib.stride_tricks.sliding_window_view(y, n - window + 1), full_matrices=False)
    w = np.minimum(np.minimum(np.arange(n) + 1, n - np.arange(n)), window)
    parts = np.array([np.convolve(u[:, k], d[k] * v[k]) / w for k in range(20)])
    g = (parts * w) @ parts.T
    want = g / np.sqrt(np.outer(np.diag(g), np.diag(g)))
    assert r.pid == "p" and np.abs(np.array(r.shares) - (d**2 / (d**2).sum())[:20]).max() < 1e-9
    assert np.array(r.w_correlation).shape == (20, 20) and np.abs(np.array(r.w_correlation) - want).max() < 1e-5


def test_features(spark):
    x = spark.createDataFrame([("p", k, float(k)) for k in (0, 1, 3)] + [("q", 0, None)], "pid string, ml_sequence int, v double")
    assert [tuple(r) for r in features.lag_features(x, ["v"], 1).orderBy("ml_sequence").select("ml_sequence", "`v-1d`").collect()] == [(1, 0.0), (3, 1.0)]
    assert {(r.pid, r.ml_sequence): r.next_v for r in features.next_day_target(x, "v").collect()} == {("p", 0): 1.0, ("p", 1): None, ("p", 3): None, ("q", 0): None}
    z = [r.v for r in features.standard_scale(x, ["v"]).orderBy("pid", "ml_sequence").collect()]
    assert abs(sum(z[:3])) < 1e-9 and z[3] is None
    c = spark.createDataFrame([(" S", "1.5"), ("Q", "x"), (None, "2")], "a string, b string")
    assert [tuple(r) for r in features.clean_sentinels(c, ["a", "b"]).collect()] == [(None, 1.5), (None, None), (None, 2.0)]
    ages = spark.createDataFrame([(5,), (6,), (12,), (18,), (60,), (64,), (65,), (None,)], "a int").select(features.recommended_hours(F.col("a")).alias("h"))
    assert [(r.h.lo, r.h.hi) if r.h else None for r in ages.collect()] == [(10, 14), (9, 12), (9, 12), (8, 10), (7, 12), (7, 9), (7, 8), None]
    assert features.join_features([x, x], ["pid", "ml_sequence"], ["", "_b"]).columns == ["pid", "ml_sequence", "v", "v_b"]


def test_views_and_sweep(spark):
    x = epochs(spark, [1.0, None, 3.0, 5.0]).withColumn("hyp_exp_day", F.lit(0))
    assert [tuple(r)[1:] for r in views.resample(x, ["v"], S, step_s=120).orderBy("bucket_s").collect()] == [(1704067200, 1.0), (1704067320, 4.0)]
    assert views.signals(x, ["v"], S, days=[0], hours=(0, 1)).count() == 4 and views.signals(x, ["v"], S, days=[1]).count() == 0
    assert sweep.grid(spark, q=[1, 2], g=["a"]).count() == 2
    assert views.top(x, "v", 2).count() == 2


def test_rows_in_any_order_and_partition(spark):
    rng = np.random.default_rng(5)
    x = epochs(spark, rng.integers(0, 400, 300).astype(float).tolist(), start=T0)
    s = S.at(activity=("v",))
    a = scoring.score_all(x, s, rescoring=True).orderBy("hyp_time_col").toPandas()
    b = scoring.score_all(x.orderBy(F.rand(1)).repartition(3), s, rescoring=True).orderBy("hyp_time_col").toPandas()
    pd.testing.assert_frame_equal(a, b)


def test_runs_of_any_type(spark):
    rows = [("1", k, v, i) for k, (v, i) in enumerate(zip(["ACTIVE", "ACTIVE", None, None, "REST", "ACTIVE"], [None, 0, 1, 1, None, 0]))]
    x = spark.createDataFrame(rows, "pid string, t long, v string, i int").withColumn("hyp_time_col", F.timestamp_seconds("t"))
    for op in (islands.run_lengths, blocks.run_lengths):
        for col, want in (("v", [(0, 2), (0, 2), (1, 2), (1, 2), (2, 1), (3, 1)]), ("i", [(0, 2), (0, 2), (1, 2), (1, 2), (2, 2), (2, 2)])):
            got = op(x, col, EpochSchema(), length="n", seq="q").orderBy("t").collect()
            assert [(r.q, r.n) for r in got] == want


def test_sweep_equals_single_detectors(spark):
    rng = np.random.default_rng(3)
    hr = 60 + 15 * (np.arange(2880) // 60 % 24 > 7) + rng.normal(0, 4, 2880)
    rows = [(p, int(k), float(v) + p if rng.random() > 0.02 else None) for p in (1, 2) for k, v in enumerate(hr)]
    x = spark.createDataFrame(rows, "pid int, k int, hr double").withColumn("hyp_time_col", F.expr("timestamp_ntz'2024-01-01 12:00:00' + make_dt_interval(0, 0, k)"))
    s = EpochSchema(hr="hr", freq_s=60)
    every = boundaries.sweep_heart_rate(x, s, quantiles=[0.3, 0.5], min_minutes=[20, 40], merge_minutes=[30, 240], volatilities=(4, 5)).toPandas()
    assert every["param_id"].nunique() == 16 and len(every) == 16 * len(rows)
    for p in (0, 6, 15):
        one = every[every.param_id == p]
        r = one.iloc[0]
        single = boundaries.by_heart_rate(x, s, quantile=r["quantile"], volatility=r.volatility, min_minutes=r.min_minutes, merge_minutes=r.merge_minutes).toPandas()
        key = ["pid", "k"]
        assert one.sort_values(key).hyp_sleep_period.tolist() == single.sort_values(key).hyp_sleep_period.tolist() and single.hyp_sleep_period.any()
    with pytest.raises(ValueError):
        boundaries.sweep_heart_rate(x, s, quantiles=[], min_minutes=[1], merge_minutes=[1])


def _recordings(spark, seed):
    """Two days of three participants with ties, gaps and missing values, one with 3 epochs, one without heart rate, rows without participant or time."""
    rng = np.random.default_rng(seed)
    rows = []
    for p in (1, 2, 3):
        at = np.sort(rng.choice(2 * 86_400 + 40_000, 1000, replace=False) // 30 * 30 + 1_704_110_400)
        hr = 60 + 12 * np.sin(at / 86_400 * 2 * np.pi) + rng.normal(0, 4, 1000) + rng.choice([0, 9], 1000, p=[0.97, 0.03])
        rows += [(p, k, float(v) if rng.random() > 0.01 else None, int(t)) for k, (v, t) in enumerate(zip(hr, at))]
    rows += [(4, k, 60.0 + k, 1_704_110_400 + 60 * k) for k in range(3)] + [(5, k, None, 1_704_110_400 + 60 * k) for k in range(90)]
    rows += [(None, 0, 60.0, 1_704_110_400), (1, 9000, 60.0, None)]
    return spark.createDataFrame(rows, "pid int, k int, hr double, at long").withColumn("hyp_time_col", F.timestamp_seconds("at").cast("timestamp_ntz")).drop("at")


@pytest.mark.parametrize(("seed", "more"), [(1, {}), (2, {"only_in_search": True, "search": (21, 11)}), (3, {"rolling_minutes": 6, "volatility_minutes": 4, "search": (0, 0)})])
def test_sweep_totals_equal_flagged_epochs(spark, seed, more):
    x, s = _recordings(spark, seed), EpochSchema(hr="hr", row="k", freq_s=60)
    grid = {"quantiles": [0.5, 0.3], "min_minutes": [0, 6], "merge_minutes": [0, 45], "volatilities": (7, 4.5)}
    keys = ["pid", "param_id", "quantile", "volatility", "min_minutes", "merge_minutes"]
    want = boundaries.sweep_heart_rate(x, s, **grid, **more).groupBy(*keys).agg(F.count_if("hyp_sleep_period").alias("n")).collect()
    got = boundaries.sweep_heart_rate_totals(x, s, **grid, **more, out="n").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) == 5 * 16
    assert len({r.n for r in got if r.pid == 1}) > 6
    with pytest.raises(ValueError):
        boundaries.sweep_heart_rate_totals(x, s, quantiles=[0.5], min_minutes=[1], merge_minutes=[-1])


def test_sweep_query_moves_no_repeated_epochs(spark, tmp_path):
    rows = [(i, i // 700, i % 700 + 1, 1.0, 60.0 + i % 700 // 60 % 9) for i in range(1400)]
    spark.createDataFrame(rows, "row_id long, id long, line_no int, stdmet_highic_branch double, mean_hr double").write.parquet(str(tmp_path / "small_collection_fenland_full.parquet"))
    assert plans.collect()[0]["boundary_hr_sweep"](spark, str(tmp_path)).count() == 125
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        steps = plans.collect()[0]["boundary_hr_sweep"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString().splitlines()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    # above the first repetition (the plan reads from its end) there is only the exchange of the totals
    first = max(i for i, line in enumerate(steps) if "Generate explode" in line)
    assert sum("Exchange hashpartitioning" in line for line in steps[:first]) == 1
