from datetime import datetime, timedelta

import numpy as np
import pytest

from epochloom.llm.runs import collapse_runs

T0 = datetime(2020, 1, 1)
SCHEMA = "row_id long, pid long, at timestamp_ntz, v double, received timestamp_ntz, s int"


def runs(spark, rows, **kw):
    df = spark.createDataFrame(rows, SCHEMA)
    out = collapse_runs(df, source="pid", time="at", value="v", received="received", key="row_id", **kw).collect()
    return sorted((r.pid, r.run_start_s, r.v, r.n_epochs, r.duration_s) for r in out)


def brute(rows, step=0.5, gap=300):
    best = {}
    for k, p, t, v, rec, _ in rows:
        if p is None or t is None:
            continue
        rank = (rec is not None, rec or T0, k)
        if (p, t) not in best or rank > best[p, t][0]:
            best[p, t] = (rank, v)
    out, last = [], None
    for (p, t), (_, v) in sorted(best.items()):
        s = int((t - datetime(1970, 1, 1)).total_seconds())
        level = None if v is None or v != v else np.floor(v / step + 0.5) * step
        if level is not None and last and last[0] == p and last[2] == level and s - last[5] <= gap:
            last[3] += 1
            last[5] = s
        else:
            last = [p, s, level, 1, None, s] if level is not None else None
            if last:
                out.append(last)
    return sorted((p, s, v, n, e - s + 30) for p, s, v, n, _, e in out)


@pytest.mark.parametrize("block", [60, 3600, 86_400])
def test_against_brute_force(spark, block):
    rng = np.random.default_rng(4)
    rows = []
    for k in range(1500):
        t = T0 + timedelta(seconds=30 * int(rng.integers(0, 800)) + (6000 if k % 9 == 0 else 0))
        v = rng.choice([0.0, 1.0, 1.01, 0.5, None, float("nan"), -0.02], p=[0.4, 0.3, 0.1, 0.05, 0.05, 0.05, 0.05])
        rows.append((k, int(rng.choice([1, 1, 1, 2])), t, None if v is None else float(v), T0 + timedelta(minutes=int(rng.integers(0, 3))), 7))
    rows += [(5000, None, T0, 1.0, T0, 1), (5001, 1, None, 1.0, T0, 1), (5002, 9, T0, 1.0, None, 1), (5003, 9, T0, 0.0, T0, 1)]
    assert runs(spark, rows, block_s=block) == brute(rows)


def test_run_over_many_blocks(spark):
    rows = [(k, 1, T0 + timedelta(seconds=30 * k), 1.0, T0, 1) for k in range(1000)]
    assert [r[3] for r in runs(spark, rows, block_s=300)] == [1000]


def test_edges(spark):
    assert runs(spark, []) == []
    two = [(1, 1, T0, 1.0, T0, 1), (2, 1, T0 + timedelta(seconds=300), 1.2, T0, 1), (3, 1, T0 + timedelta(seconds=601), 1.0, T0, 1)]
    assert [r[3] for r in runs(spark, two)] == [2, 1]
    assert [r[3] for r in runs(spark, two, step=None)] == [1, 1, 1]
