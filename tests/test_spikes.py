import numpy as np

from epochloom.operators.spikes import ChartConfig, flag, flag_series


def level(n=400, seed=1, noise=2.0):
    rng = np.random.default_rng(seed)
    x = 70 + np.cumsum(rng.normal(0, 0.3, n)) + rng.normal(0, noise, n)
    return np.round(x)


def test_spikes_stuck_and_limits():
    x = level()
    x[50:52] += 80
    x[120] = 30
    x[200:240] = 66
    x[300], x[310], x[320] = 255, 0, -1
    limit, spike, stuck = flag_series(x)
    assert set(np.flatnonzero(limit)) == {300, 310, 320}
    assert set(np.flatnonzero(spike)) == {50, 51, 120}
    assert set(range(200, 240)) <= set(np.flatnonzero(stuck)) and stuck.sum() < 46


def test_spikes_beside_spikes():
    x = level()
    x[100:106] = [78, 84, 174, 79, 168, 83]
    x[200:206] = [70, 20, 72, 71, 22, 69]
    x[300:305] = [160, 70, 150, 71, 155]
    assert np.flatnonzero(flag_series(x)[1]).tolist() == [102, 104, 201, 204, 300, 302, 304]


def brute(x, flagged):
    """Readings that stand out by 40 from the middle of the five nearest unflagged readings on either side."""
    out = set()
    for k in range(len(x)):
        near = [j for j in range(k) if j not in flagged][-5:] + [j for j in range(k + 1, len(x)) if j not in flagged][:5]
        if abs(x[k] - np.median(x[near])) > 40:
            out.add(k)
    return out


def test_spikes_against_brute_force_that_skips_flagged_readings():
    pairs = 0
    for seed in range(4):
        rng = np.random.default_rng(seed)
        x = level(200, seed=seed)
        planted = set()
        for at in rng.choice(np.arange(8, 190, 12), 6, replace=False).tolist():
            size = 80 + int(rng.integers(20)) if rng.random() < 0.5 else -50
            for k in (at, at + 2)[: rng.integers(1, 3)]:
                x[k] += size
                planted.add(k)
        pairs += sum(k + 2 in planted for k in planted)
        limit, spike, _ = flag_series(x)
        got = set(np.flatnonzero(limit | spike).tolist())
        assert got == planted == brute(x, got)
    assert pairs > 5


def test_exercise_and_restless_sources_are_normal():
    x = level()
    x[100:160] += np.concatenate([np.linspace(0, 70, 5), np.full(50, 70), np.linspace(70, 0, 5)])  # exercise
    x[200:230] += 60  # sudden, but it stays
    assert not np.any(flag_series(x))
    assert not np.any(flag_series(np.round(level(seed=3, noise=8.0) / 5) * 5))
    assert not np.any(flag_series(np.round(level(seed=4, noise=1.5) * 0.5)))


def test_short_and_flat_series():
    for x in ([], [70.0], [70.0, 300.0], [70.0] * 6):
        limit, spike, stuck = flag_series(np.array(x, float))
        assert limit.tolist() == [v > 245 for v in x] and not spike.any() and not stuck.any()


def rows_of(x, src=1, first=0):
    return [(first + k, src, k, float(v), None) for k, v in enumerate(x)]


SCHEMA = "row_id long, src long, line_no int, v double, limit int"


def test_frame_with_copies_nulls_and_late_lines(spark):
    x = level()
    x[50] += 80
    rows = rows_of(x)
    rows += [(1000, 1, 50, float(x[50]), 3), (1001, 1, 50, None, 3), (1002, 1, 51, float("nan"), 3), (1003, None, 1, 400.0, 3), (1004, None, None, 70.0, 3)]
    got = {r.row_id: (r.limit, r.spike, r.stuck) for r in flag(spark.createDataFrame(rows, SCHEMA), value="v", source="src").collect()}
    assert got == {50: (False, True, False), 1000: (False, True, False), 1003: (True, False, False)}


def test_blocks_give_the_same_as_the_whole(spark):
    x = level(3000, seed=5)
    for k in (10, 511, 512, 1023, 1024, 2047):
        x[k] += 90
    x[1500:1560] = 71
    df = spark.createDataFrame(rows_of(x), SCHEMA)
    whole = {r.row_id for r in flag(df, value="v", source="src").collect()}
    parts = {r.row_id for r in flag(df, value="v", source="src", block=512, halo=128).collect()}
    assert whole == parts and {10, 511, 512, 1023, 1024, 2047, 1500, 1559} <= whole


def test_counter_puts_late_lines_in_place(spark):
    x = level(200)
    x[100:130] = 70
    order = list(range(200))
    order.insert(119, order.pop(95))  # a line that came late lands in the stuck stretch
    rows = [(k, 1, line, float(x[k]), (60 * k) % 65_536) for line, k in enumerate(order)]
    df = spark.createDataFrame(rows, "row_id long, src long, line_no int, v double, c int")
    got = {r.row_id for r in flag(df, value="v", source="src", counter="c").collect()}
    assert set(range(100, 130)) <= got and 95 not in got


def test_empty_and_parameters(spark):
    assert flag(spark.createDataFrame([], SCHEMA), value="v", source="src").count() == 0
    assert flag_series(np.array([30.0, 31.0]), ChartConfig(low=31))[0].tolist() == [True, False]
