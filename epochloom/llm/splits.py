"""Splits that keep related records together.

Records and the entities that they share form a bipartite graph. :func:`components` finds its connected parts by
iterative minimum-label propagation: records take the smallest label of their entities, entities the smallest label
of their records, and labels are shortened through each other until nothing changes. :func:`assign_groups` then
distributes the parts over the splits so that every label's share deviates as little as possible.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epochloom.runtime import spill


def spelled_number(text: Column) -> Column:
    """The number in a spelling such as ``0001176``, ``p-1090``, ``pid_1062`` or ``1141.0``; null if there is none.

    Leading zeros, blanks, letters around it and a fraction of zeros don't count. Two numbers, or more than 18
    digits, name nobody.
    """
    return F.nullif(F.regexp_extract(text, r"^\D*?0*(\d{1,18})(?:\.0*)?\D*$", 1), F.lit("")).try_cast("bigint")


def components(memberships: DataFrame, *, record: str = "record", entity: str = "entity", per_salt: int = 1_000_000) -> DataFrame:
    """(``entity``, ``part``) for every entity: ``part`` is the smallest entity of its connected part.

    ``memberships`` has a row per record and entity of it; null records or entities connect nothing and are left
    out, repeated rows do no harm. Records of one entity only give that entity by itself. Labels only get smaller, so
    the rounds end by themselves. Aggregations combine before the shuffle; in joins a hub (an entity of very many records,
    or a record of very many entities) is spread over one part per ``per_salt`` of its rows.
    """
    pairs = memberships.where(F.col(record).isNotNull() & F.col(entity).isNotNull()).select(F.col(record).alias("r"), F.col(entity).alias("e")).distinct()
    # a record of one entity can't pass on a label: only the others take part in the rounds
    parts = lambda n: F.ceil(n / per_salt).cast("int")
    several = pairs.groupBy("r").agg(F.min("e").alias("lo"), F.max("e").alias("hi"), parts(F.count("*")).alias("rk")).where("lo <> hi").select("r", "rk")
    rows = spill(pairs.join(several, "r"))
    salt = lambda by, k: F.pmod(F.xxhash64(by), F.col(k)).cast("int")
    sizes = rows.groupBy("e").agg(parts(F.count("*")).alias("ek"))
    links = spill(rows.join(sizes, "e").select("r", "e", salt("e", "rk").alias("rs"), salt("r", "ek").alias("es"), "rk", "ek"))
    spread = lambda df, k, s: df.withColumn(s, F.explode(F.sequence(F.lit(0), F.col(k) - 1)))
    labels = spill(links.groupBy("e").agg(F.first("ek").alias("ek"), F.min("e").alias("p")))
    while True:
        seen = links.select("r", "e", "es", "rk").join(spread(labels, "ek", "es"), ["e", "es"])
        by_record = seen.groupBy("r").agg(F.first("rk").alias("rk"), F.min("p").alias("q"))
        offered = links.select("r", "e", "rs").join(spread(by_record, "rk", "rs"), ["r", "rs"]).groupBy("e").agg(F.min("q").alias("q"))
        step = labels.join(offered, "e").select("e", "ek", F.col("p").alias("old"), F.least("p", "q").alias("p"))
        # shortening: the label's own label is in the same part and no larger
        of_label = step.select(F.col("e").alias("p"), F.col("p").alias("pp"))
        new = spill(step.join(of_label, "p", "left").select("e", "ek", "old", F.coalesce(F.least("pp", "p"), "p").alias("p")))
        labels = new.select("e", "ek", "p")
        if new.where("old <> p").isEmpty():
            break
    labels = labels.select("e", "p")
    alone = pairs.select("e").distinct().join(labels, "e", "left_anti").select("e", F.col("e").alias("p"))
    return labels.unionByName(alone).select(F.col("e").alias(entity), F.col("p").alias("part"))


def _greedy(groups: list[tuple[np.ndarray, np.ndarray]], targets: np.ndarray) -> np.ndarray:
    """Split of each group (labels and their counts), largest first, each to the split where it leaves the least deviation.

    ``targets``: what each split (rows) should still get of each label (columns); it is changed in place.
    """
    total = np.maximum(np.abs(targets).sum(axis=0), 1.0)
    whole, lacks = max(total.sum() ** 2, 1.0), targets.sum(axis=1)
    sizes = np.array([c.sum() for _, c in groups], float)
    out = np.empty(len(groups), np.int64)
    for i in np.argsort(-sizes, kind="stable"):
        at, g = groups[i]
        # squared deviation changes by ((t - g)^2 - t^2) in the split that gets the group, for each of its labels and over all
        change = ((g * (g - 2 * targets[:, at])) / (total[at] * total[at])).sum(axis=1) * len(total)
        change += sizes[i] * (sizes[i] - 2 * lacks) / whole
        k = int(np.argmin(np.round(change, 15)))
        out[i] = k
        targets[k, at] -= g
        lacks[k] -= sizes[i]
    return out


def assign_groups(
    records: DataFrame, *, group: str, label: str, proportions: tuple[tuple[str, float], ...] = (("train", 0.8), ("validation", 0.1), ("test", 0.1)),
    large: float = 0.001, per_bucket: int = 20_000, most_labels: int = 100_000,
) -> DataFrame:
    """(``group``, ``split``): every group in one split, labels distributed as in ``proportions``.

    Groups with more than ``large`` of all records, at most ``1 / large``, are placed first, on the driver. The others
    are spread by hash over buckets of about ``per_bucket`` groups; each bucket is placed by itself towards its share
    of what is still missing. Null labels are a label of their own; records without group are left out. The totals of the
    labels are held by the driver and every task; more than ``most_labels`` different ones are no strata any more and an
    error: pass a coarser label. The result depends on the rows only, not on their order.
    """
    names, shares = [n for n, _ in proportions], np.array([p for _, p in proportions], float)
    shares = shares / shares.sum()
    counts = records.where(F.col(group).isNotNull()).groupBy(F.col(group).alias("g"), F.coalesce(F.col(label).cast("string"), F.lit("\0")).alias("l")).agg(F.count("*").alias("n"))
    counts = spill(counts)
    labels = counts.groupBy("l").agg(F.sum("n").alias("n")).orderBy("l").limit(most_labels + 1).collect()
    if len(labels) > most_labels:
        raise ValueError(f"more than {most_labels} labels")
    place = {r["l"]: i for i, r in enumerate(labels)}
    totals = np.array([r["n"] for r in labels], float)
    size = counts.groupBy("g").agg(F.sum("n").alias("n"))
    big_ids = size.where(F.col("n") > large * float(totals.sum())).select("g")
    kind = counts.schema["g"].dataType.simpleString()
    big = counts.join(big_ids, "g", "left_semi").collect()  # at most 1 / large groups, each with its labels
    targets = shares[:, None] * totals[None, :] if len(labels) else np.zeros((len(names), 0))

    def rows_of(pdf: pd.DataFrame) -> tuple[list, list[tuple[np.ndarray, np.ndarray]]]:
        pdf = pdf.sort_values(["g", "l"], kind="stable")
        at, n, ids = pdf["l"].map(place).to_numpy(np.int64), pdf["n"].to_numpy(float), pdf["g"]
        cuts = np.flatnonzero(np.r_[True, ids.to_numpy()[1:] != ids.to_numpy()[:-1]])
        return ids.iloc[cuts].tolist(), [(at[a:b], n[a:b]) for a, b in zip(cuts, np.r_[cuts[1:], len(pdf)])]

    placed = []
    if big:
        ids, m = rows_of(pd.DataFrame([r.asDict() for r in big]))
        placed = [(g, names[k]) for g, k in zip(ids, _greedy(m, targets))]
    missing = np.maximum(targets, 0)
    per_label = missing / np.maximum(missing.sum(axis=0), 1e-9)  # what each split should get of the remaining records

    def place_bucket(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, m = rows_of(pdf)
        here = np.zeros(len(place))
        for at, n in m:
            here[at] += n
        k = _greedy(m, per_label * here[None, :])
        return pd.DataFrame({"g": ids, "split": [names[i] for i in k]})

    small = counts.join(big_ids, "g", "left_anti")
    buckets = max(1, -(-small.select("g").distinct().count() // per_bucket))
    done = small.withColumn("b", F.pmod(F.xxhash64("g"), F.lit(buckets))).groupBy("b").applyInPandas(place_bucket, f"g {kind}, split string")
    if placed:
        done = done.unionByName(records.sparkSession.createDataFrame(placed, f"g {kind}, split string"))
    return done.withColumnRenamed("g", group)
