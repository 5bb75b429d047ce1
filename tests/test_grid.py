import os

import numpy as np
import pytest

from epochloom.operators.grid import SsaConfig, bucket, impute, resolve_counter, ssa_converge, ssa_fill
from epochloom.operators.spikes import ChartConfig, flag_series
from epochloom.operators.timestamps import COUNTER_START_S, normalise
from epochloom.runtime import table

T0 = 1_600_000_000


def watch(rng, n, src, first_row):
    """Lines of a file with gaps and late readings: readings (row, src, line, counter, rate), known (src, line, us), true instants."""
    t, line, reads, known, truth = T0 + src * 100_000, 0, [], [], {}
    events = []
    for k in range(n):
        t += int(rng.choice([60, 55, 300, 20_000], p=[0.8, 0.1, 0.09, 0.01]))
        events.append(t)
        if rng.random() < 0.2 or k in (0, n - 1):
            events.append(-t)
    for k in range(3, len(events), 17):
        if events[k] > 0 and all(e > 0 for e in events[k : k + 3]):
            events.insert(k + 2, events.pop(k))
    for e in events:
        if e < 0:
            known.append((src, line, -e * 1_000_000))
        else:
            truth[first_row + line] = e
            reads.append((first_row + line, src, line, (e - COUNTER_START_S) % 65_536, 70))
        line += 1
    return reads, known, truth


@pytest.mark.parametrize("block", [16, 4096])
def test_counter_against_truth(spark, block):
    rng = np.random.default_rng(3)
    reads, known, truth = [], [], {}
    for src in range(3):
        r, k, t = watch(rng, 150, src, src * 10_000)
        reads, known, truth = reads + r, known + k, truth | t
    extra = [(90_001, 0, None, 5, 1), (90_002, None, 3, 5, 1), (90_003, 0, 3, None, 1), (90_004, 77, 1, 9, 1)]
    df = spark.createDataFrame(reads + extra, "row_id long, src long, line_no int, timestamp_16 int, heart_rate int")
    anchors = spark.createDataFrame(known + [(5, None, 1), (5, 1, None)], "src long, line_no int, utc_us long")
    got = {r.row_id: r.utc_s for r in resolve_counter(df, anchors, source="src", block=block).collect()}
    assert got == truth


def test_ssa_recovers_a_rhythm():
    at = np.arange(600)
    y = 70 + 10 * np.sin(2 * np.pi * at / 120) + 3 * np.cos(2 * np.pi * at / 45)
    holed = y.copy()
    holed[100:130] = np.nan
    holed[400:405] = np.nan
    done = ssa_fill(holed, SsaConfig(window=150, rounds=200, tolerance=1e-4))
    assert np.array_equal(done[~np.isnan(holed)], y[~np.isnan(holed)])
    straight = np.interp(at, at[~np.isnan(holed)], y[~np.isnan(holed)])
    assert np.abs(done - y).max() < 0.5 * np.abs(straight - y).max()


def slow_series():
    """Restless heart rates with gaps: far from converged after a dozen rounds."""
    rng = np.random.default_rng(5)
    y = np.round(70 + 15 * np.sin(np.arange(1440) / 40) + np.cumsum(rng.normal(0, 1, 1440)) + rng.normal(0, 3, 1440))
    for at, n in ((100, 40), (400, 90), (700, 25), (1200, 60)):
        y[at : at + n] = np.nan
    return y


def one_round(y, x, cfg=SsaConfig()):
    """A round by its definition: Hankel matrix, SVD, weights of the leading vectors, means over the anti-diagonals."""
    missing, mean, window, rank = np.isnan(y), np.nanmean(y), cfg.window, cfg.rank
    z = x - mean
    h = np.array([z[i : i + len(z) - window + 1] for i in range(window)])
    u, s, v = np.linalg.svd(h, full_matrices=False)
    share = np.maximum(0, 1 - np.median(s[rank:] ** 2) / s[:rank] ** 2)
    low = (u[:, :rank] * (s[:rank] * share)) @ v[:rank]
    out = x.copy()
    for k in np.flatnonzero(missing):
        out[k] = np.mean([low[i, k - i] for i in range(window) if 0 <= k - i < low.shape[1]]) + mean
    return np.clip(out, np.nanmin(y), np.nanmax(y))


def test_production_imputation_converges():
    y = slow_series()
    missing = np.isnan(y)
    done, converged = ssa_converge(y)
    assert converged and np.array_equal(done[~missing], y[~missing])
    assert np.abs(one_round(y, done) - done).max() < SsaConfig().tolerance
    early, converged = ssa_converge(y, SsaConfig(rounds=3))
    assert not converged and np.abs(early - done).max() > SsaConfig().tolerance


def test_unconverged_stretches_are_marked(spark):
    y = slow_series()
    rows = [(1, k, float(v)) for k, v in enumerate(y) if v == v] + [(2, k, 70.0) for k in range(20) if k != 9]
    df = spark.createDataFrame(rows, "src long, bucket long, value double")
    for cfg, whole in ((SsaConfig(), True), (SsaConfig(rounds=3), False)):
        got = {(r.src, r.converged) for r in impute(df, source="src", cfg=cfg).collect()}
        assert got == {(1, whole), (2, True)}


def test_ssa_edges():
    assert np.isnan(ssa_fill(np.full(5, np.nan))).all()
    assert ssa_fill(np.array([1.0, np.nan, 3.0])).tolist() == [1.0, 2.0, 3.0]
    assert ssa_fill(np.array([])).size == 0
    assert ssa_fill(np.array([5.0])).tolist() == [5.0]


@pytest.mark.parametrize("block", [7, 1440])
def test_grid(spark, block):
    rows = [(1, 0, 60), (1, 30, 80), (1, 60, None), (1, 60 * 20, 70), (2, 90, 55), (None, 60, 60), (None, 180, 60), (3, None, 1), (4, 60, None)]
    df = spark.createDataFrame(rows, "src long, utc_s long, hr int")
    got = {(r.src, r.bucket): r for r in impute(bucket(df, source="src", value="hr"), source="src", block=block).collect()}
    assert {k[1] for k in got if k[0] == 1} == set(range(21)) and {k for k in got if k[0] == 2} == {(2, 1)}
    assert [k for k in sorted(got, key=str) if got[k].filled and k[0] == 1] == sorted([(1, k) for k in range(2, 20)], key=str)
    assert got[1, 0].value == 70 and not got[1, 1].filled
    assert {k[1] for k in got if k[0] is None} == {1, 2, 3} and got[None, 2].filled
    assert all((r.value is None) == (r.src == 4) for r in got.values())


def test_stretches_overlap(spark):
    """A long source in stretches gives about what it gives in one piece; empty stretches lie on the line between their neighbours."""
    at = np.arange(1499)
    y = np.round(70 + 10 * np.sin(at / 30) + np.random.default_rng(1).normal(0, 2, 1499), 1)
    rows = [(1, int(k) + 7, float(v)) for k, v in zip(at, y) if k % 11 not in (3, 4) and not 600 <= k < 900]
    df = spark.createDataFrame(rows, "src long, bucket long, value double")
    whole, parts = ({r.bucket: (r.value, r.filled) for r in impute(df, source="src", block=b, halo=60).collect()} for b in (2000, 100))
    assert set(whole) == set(parts) == set(range(7, 1506)) and all(whole[k][1] == parts[k][1] for k in whole)
    near = [k for k in whole if not 580 <= k <= 930]
    assert np.sqrt(np.mean([(whole[k][0] - parts[k][0]) ** 2 for k in near])) < 0.5
    a, b = y[599], y[900]
    assert abs(parts[757][0] - (a + (b - a) * (750 - 599) / 301)) < 1e-6


def test_flagged_values_do_not_shape_the_fill(spark):
    y = 70 + 5 * np.sin(np.arange(400) / 20)
    rows = [(1, k, float(v) + (100 if k == 203 else 0)) for k, v in enumerate(y) if not 200 <= k < 203]
    df = spark.createDataFrame(rows, "src long, bucket long, value double")
    got = {r.bucket: r for r in impute(df, source="src", charts=ChartConfig()).collect()}
    assert all(abs(got[k].value - y[k]) < 2 for k in range(199, 206)) and [k for k in got if got[k].filled] == [200, 201, 202]


def test_held_out_minutes_beat_a_straight_line(spark):
    """Production parameters on every file of a small table: single minutes held out, with several seeds."""
    folder = "/root/testdata/sf0.01"
    if not os.path.exists(f"{folder}/test_1.parquet"):
        pytest.skip("needs the test tables")
    lines = table(spark, folder, "test_1")
    texts = normalise(lines, table(spark, folder, "recorders"), text="timestamp", source="file_id", counter="timestamp_16")
    timed = resolve_counter(lines.where("heart_rate between 20 and 245").select("file_id", "line_no", "row_id", "timestamp_16", "heart_rate"), texts, source="file_id")
    pdf = bucket(timed, source="file_id", value="heart_rate").toPandas()
    files = []
    for _, f in pdf.groupby("file_id"):
        y = np.full(f["bucket"].max() - f["bucket"].min() + 1, np.nan)
        y[f["bucket"] - f["bucket"].min()] = f["value"]
        known = np.flatnonzero(~np.isnan(y))
        y[known[np.any(flag_series(y[known]), axis=0)]] = np.nan
        files.append(y)
    for seed in range(4):
        rng, ours, line = np.random.default_rng(seed), [], []
        for y in files:
            held = rng.choice(np.flatnonzero(~np.isnan(y))[1:-1], len(y) // 40, replace=False)
            holed = y.copy()
            holed[held] = np.nan
            known = np.flatnonzero(~np.isnan(holed))
            ours.append(ssa_fill(holed)[held] - y[held])
            line.append(np.interp(held, known, holed[known]) - y[held])
        assert np.sqrt(np.mean(np.concatenate(ours) ** 2)) < 0.97 * np.sqrt(np.mean(np.concatenate(line) ** 2))


def test_empty(spark):
    df = spark.createDataFrame([], "src long, utc_s long, hr int")
    assert impute(bucket(df, source="src", value="hr"), source="src").count() == 0
    reads = spark.createDataFrame([], "row_id long, src long, line_no int, timestamp_16 int, heart_rate int")
    assert resolve_counter(reads, spark.createDataFrame([], "src long, line_no int, utc_us long"), source="src").count() == 0
