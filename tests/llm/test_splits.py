from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from epochloom.llm.splits import assign_groups, components, spelled_number


def union_find(pairs):
    up = {}

    def top(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    by = defaultdict(list)
    for r, e in pairs:
        if r is not None and e is not None:
            by[r].append(e)
            top(e)
    for es in by.values():
        for e in es[1:]:
            a, b = sorted((top(es[0]), top(e)))
            up[b] = a
    return {e: top(e) for e in list(up)}


@pytest.mark.parametrize("shape", ["random", "chain", "star"])
def test_components(spark, shape):
    rng = np.random.default_rng(1)
    if shape == "random":
        pairs = [(f"r{int(r)}", int(e)) for r, e in zip(rng.integers(0, 120, 200), rng.integers(0, 150, 200))]
    elif shape == "chain":
        ids = rng.permutation(64).tolist()
        pairs = [(f"r{k}", e) for k in range(63) for e in (ids[k], ids[k + 1])]
    else:
        pairs = [(f"r{k}", e) for k in range(1, 80) for e in (500, k)]
    pairs += [pairs[0], (None, 5), ("x", None), ("alone", 999)]
    got = {r.entity: r.part for r in components(spark.createDataFrame(pairs, "record string, entity long")).collect()}
    assert got == union_find(pairs)


def test_components_of_nothing(spark):
    assert components(spark.createDataFrame([], "record string, entity long")).count() == 0


def test_spellings(spark):
    texts = ["1004", "0000001176", "p-1090", "P1385", "pid_1062", "1141.0", " 1422", "1422 ", "", "p", "12 34", None, "1141.5", "0", "9" * 19]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(spelled_number(F.col("t"))).collect()]
    assert got[:8] == [1004, 1176, 1090, 1385, 1062, 1141, 1422, 1422] and got[8:13] == [None] * 5 and got[13] in (0, None) and got[14] is None


def test_assignment_keeps_groups_and_labels(spark):
    rng = np.random.default_rng(2)
    rows = []
    for g in range(800):
        label = rng.choice(["a", "b", None], p=[0.6, 0.3, 0.1])
        rows += [(g, label)] * int(rng.integers(1, 12))
    rows += [(10_000, "a")] * 700 + [(None, "a")]
    df = spark.createDataFrame(rows, "g long, l string").withColumn("split", F.lit("clash"))
    got = {r.g: r.split for r in assign_groups(df, group="g", label="l", large=0.02, per_bucket=200).collect()}
    assert set(got) == {r[0] for r in rows} - {None}
    total, share = defaultdict(int), defaultdict(int)
    for g, label in rows:
        if g is not None:
            total[label] += 1
            share[label, got[g]] += 1
    for label, n in total.items():
        for name, p in (("train", 0.8), ("validation", 0.1), ("test", 0.1)):
            assert abs(share[label, name] / n - p) < 0.05, (label, name)
    again = {r.g: r.split for r in assign_groups(df.repartition(7), group="g", label="l", large=0.02, per_bucket=200).collect()}
    assert got == again


def test_one_group_and_none(spark):
    one = spark.createDataFrame([(1, "a")] * 10, "g long, l string")
    assert [r.split for r in assign_groups(one, group="g", label="l").collect()] == ["train"]
    assert assign_groups(one.limit(0), group="g", label="l").count() == 0
    with pytest.raises(ValueError):
        assign_groups(spark.createDataFrame([(1, str(k)) for k in range(5)], "g long, l string"), group="g", label="l", most_labels=3)
