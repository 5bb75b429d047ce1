"""Implausible readings per source: robust control charts, run counters and physical limits.

A reading is flagged by one of three rules, each judged by its own source:

``limit``
    The value lies outside what a living wearer can have.
``spike``
    One of at most ``few`` successive readings that leave the level around them. Two exponentially weighted
    charts follow the source, one forwards, one backwards in time. A suspected value is clipped before it updates
    mean and scale, so a spike hardly moves them; a reading is a spike if it is far from *both* charts on the same
    side. The start of exercise is far from the forward chart only, as the level doesn't come back at once. The
    nearest two readings on either side that aren't suspected on the same side must be back at the level. Sources with
    fewer than 8 possible readings get no spike test: they don't tell what is usual.
``stuck``
    A member of a stretch of equal successive readings that is longer than chance allows in this source: with
    ``p`` the chance that a reading repeats the one before, a stretch of ``1 + ln(n / alpha) / ln(1 / p)``
    readings or more.

What is usual (``n``, ``p`` and the movement from reading to reading) is counted over the whole source in one aggregation.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from epochloom.operators.grouped import whole_groups


@dataclass(frozen=True)
class ChartConfig:
    """Parameters of the charts; values are in the unit of the measurement.

    ``low``/``high``: physical limits, a reading outside is impossible. ``weight``/``scale_weight``: weights of a new
    reading in mean and scale. ``clip``: a deviation counts as at most so many scales in updates. ``base``/``factor``:
    a spike deviates by more than ``base + factor`` times the usual movement of its source, a step counting as
    ``most_step`` at most. ``few``: most readings of one spike. ``least_run``: no stretch below this is stuck. ``alpha``:
    expected false stretches per source.
    """

    low: float = 20.0
    high: float = 245.0
    weight: float = 0.35
    scale_weight: float = 0.1
    clip: float = 3.0
    least_scale: float = 1.0
    base: float = 15.0
    factor: float = 2.0
    most_step: float = 40.0
    few: int = 4
    least_run: int = 14
    alpha: float = 0.02


@dataclass(frozen=True)
class Usual:
    """What is usual in a source: possible readings, chance of a repeat, mean step."""

    n: int
    p: float
    move: float


def usual(x: np.ndarray, cfg: ChartConfig = ChartConfig()) -> Usual:
    """The same as :func:`usual_by_source`, of the successive readings of one source."""
    x = x[(x >= cfg.low) & (x <= cfg.high)].astype(float)
    step = np.abs(np.diff(x))
    first = np.r_[True, step[:-1] != 0] if len(step) else np.zeros(0, bool)  # the reading before is no repeat itself
    counted = step[first | (step != 0)]
    after = step[1:][step[:-1] != 0] if len(step) else step
    return Usual(len(x), ((after == 0).sum() + 1) / (len(after) + 2), float(np.minimum(counted, cfg.most_step).mean()) if len(counted) else 0.0)


def charts(series: list[np.ndarray], cfg: ChartConfig, scales: list[float]) -> list[np.ndarray]:
    """Deviation of every value from the exponentially weighted mean of those before it; all series move on together."""
    out: list[np.ndarray] = [np.zeros(0)] * len(series)
    order = sorted(range(len(series)), key=lambda i: -len(series[i]))
    order = [i for i in order if len(series[i])]
    if not order:
        return out
    longest = len(series[order[0]])
    y = np.zeros((longest, len(order)))
    lengths = np.array([len(series[i]) for i in order])
    for col, i in enumerate(order):
        y[: lengths[col], col] = series[i]
    mean = np.array([np.median(series[i][:7]) for i in order])
    scale = np.array([scales[i] for i in order], float)
    far = np.empty_like(y)
    live = np.searchsorted(-lengths, -np.arange(longest), side="left")  # the first columns are the longest
    for t, k in enumerate(live.tolist()):
        m, s = mean[:k], scale[:k]
        d = np.subtract(y[t, :k], m, out=far[t, :k])
        c = cfg.clip * s
        d = np.minimum(np.maximum(d, -c), c)
        m += cfg.weight * d
        s += cfg.scale_weight * (np.abs(d) - s)
        np.maximum(s, cfg.least_scale, out=s)
    for col, i in enumerate(order):
        out[i] = far[: lengths[col], col].copy()
    return out


def _lengths(same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Run number of every element and the runs' lengths; ``same[i]``: element i+1 continues the run of i."""
    run = np.concatenate([[0], np.cumsum(~same)])
    return run, np.bincount(run)


def flag_many(series: list[np.ndarray], cfg: ChartConfig = ChartConfig(), normal: list[Usual] | None = None) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(limit, spike, stuck) of each series of successive readings, in order and without nulls or repeats.

    ``normal`` tells what is usual in each source; without it, a series is a whole source.
    """
    normal = normal or [usual(x, cfg) for x in series]
    out, places, values = [], [], []
    for x, of in zip(series, normal):
        n = len(x)
        limit = (x < cfg.low) | (x > cfg.high)
        stuck, head = np.zeros(n, bool), np.ones(n, bool)
        if n > 1:
            same = x[1:] == x[:-1]
            enough = max(cfg.least_run, 1 + math.log(max(of.n, 2) / cfg.alpha) / -math.log(min(of.p, 0.95)))
            run, length = _lengths(same)
            stuck = length[run] >= enough
            head[1:] = ~(stuck[1:] & same)  # a stuck stretch is one reading to the charts, impossible values are none
        at = np.flatnonzero(~limit & head) if of.n >= 8 else np.zeros(0, np.int64)
        out.append((limit, np.zeros(n, bool), stuck))
        places.append(at)
        values.append(x[at].astype(float))
    scales = [max(of.move, cfg.least_scale) for of in normal]
    both = charts([*values, *(y[::-1] for y in values)], cfg, [*scales, *scales])
    for i, (at, y, of) in enumerate(zip(places, values, normal)):
        if not len(at):
            continue
        fwd, bwd, far = both[i], both[len(series) + i][::-1], cfg.base + cfg.factor * of.move
        side = np.where((fwd > far) & (bwd > far), 1, np.where((fwd < -far) & (bwd < -far), -1, 0))
        if not side.any():
            continue
        group, size = _lengths(side[1:] == side[:-1])
        hit = (side != 0) & (size[group] <= cfg.few)
        free = {s: np.flatnonzero(~hit | (side != s)) for s in (1, -1)}  # not themselves suspected on that side
        for g in np.unique(group[hit]):  # few: confirm that the nearest of those are back at the level
            a, b = np.searchsorted(group, [g, g + 1])
            others = free[int(side[a])]
            k = np.searchsorted(others, a)
            near = y[others[max(0, k - 2) : k + 2]] * side[a]
            hit[a:b] = len(near) > 0 and (y[a:b] * side[a]).min() - near.max() > cfg.base
        out[i][1][at] = hit
        out[i][1][out[i][2]] = False
    return out


def flag_series(x: np.ndarray, cfg: ChartConfig = ChartConfig(), normal: Usual | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """:func:`flag_many` of one series."""
    return flag_many([x], cfg, [normal] if normal else None)[0]


def _by_counter(group: np.ndarray, counter: np.ndarray) -> np.ndarray:
    """Order of measuring within each group by the unwrapped 16-bit counter, which puts late lines in place.

    Lines without a counter take that of the line before, else of the one after.
    """
    n, at = len(group), np.arange(len(group))
    starts = np.r_[True, group[1:] != group[:-1]]
    first = np.maximum.accumulate(np.where(starts, at, 0))
    known = np.isfinite(counter)
    back = np.maximum.accumulate(np.where(known, at, -1))
    ahead = np.minimum.accumulate(np.where(known, at, n)[::-1])[::-1]
    take = np.where(back >= first, back, ahead)
    inside = (take < n) & (group[np.minimum(take, n - 1)] == group)
    c = np.where(inside, counter[np.minimum(take, n - 1)], 0).astype(np.int64)
    step = np.r_[0, (np.diff(c) + 32_768) % 65_536 - 32_768]
    step[starts] = 0
    return np.lexsort((np.cumsum(step), group))


def usual_by_source(rows: DataFrame, cfg: ChartConfig, keys: tuple[str, str] = ("src", "own")) -> DataFrame:
    """(``src``, ``n``, ``p``, ``move``) from one aggregation a source over pre-aggregated blocks.

    Copies of a reading count once. A reading that repeats one that is a repeat itself doesn't count, so a stuck
    stretch of any length weighs no more than two readings. Steps over a block's border aren't seen.
    """
    once = rows.where(F.col("v").between(cfg.low, cfg.high)).select(*keys, "line", "v").repartition(*keys).distinct()
    w = Window.partitionBy(*keys).orderBy("line", "v")
    x = once.select(*keys, "v", F.lag("v").over(w).alias("a"), F.lag("v", 2).over(w).alias("b"))
    step, repeat, after = F.abs(F.col("v") - F.col("a")), F.col("v") == F.col("a"), F.col("a") != F.col("b")
    counted = F.when(~(repeat & F.coalesce(~after, F.lit(False))), F.least(step, F.lit(cfg.most_step)))
    sums = x.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(counted).alias("s"), F.count(counted).alias("k"), F.count_if(after).alias("c"), F.count_if(after & repeat).alias("r"))
    return sums.groupBy(keys[0]).agg(F.sum("n").alias("n"), ((F.sum("r") + 1) / (F.sum("c") + 2)).alias("p"), F.coalesce(F.try_divide(F.sum("s"), F.sum("k")), F.lit(0.0)).alias("move"))


def flag(
    df: DataFrame, *, value: str, source: str, order: str = "line_no", key: str = "row_id", counter: str | None = None,
    cfg: ChartConfig = ChartConfig(), block: int = 8192, halo: int = 256,
) -> DataFrame:
    """Rows with an implausible ``value``: ``key`` and the flags ``limit``, ``spike`` and ``stuck``.

    Readings are ordered by ``order``, or where ``counter`` names a 16-bit counter of seconds, by that. Rows of
    one source with equal order and value are copies of one reading and share its flags. Null and NaN values are no
    readings (never flagged; successive readings may have nulls between them). Rows with null source or order belong to
    no series; they are judged by the physical limits only.

    A source is cut into blocks of ``block`` lines, each with ``halo`` lines of its neighbours, so that a source
    of any size is spread over tasks; the charts forget within the halo. What is usual is that of the whole source.
    """
    v = F.col(f"`{value}`").cast("double")
    pos = F.col(f"`{order}`").cast("bigint")
    blk = F.greatest(F.floor(pos / block), F.lit(0))
    reads = df.where(v.isNotNull() & ~F.isnan(v)).select(
        F.col(f"`{source}`").alias("src"), pos.alias("line"), v.alias("v"),
        (F.col(f"`{counter}`").cast("double") if counter else F.lit(None).cast("double")).alias("c"), blk.alias("own"), F.col(f"`{key}`").alias("key"),
    )
    placed = F.col("src").isNotNull() & F.col("line").isNotNull()
    alone = reads.where(~placed & ~F.col("v").between(cfg.low, cfg.high)).select(F.col("key").alias(key), F.lit(True).alias("limit"), F.lit(False).alias("spike"), F.lit(False).alias("stuck"))
    reads = reads.where(placed)
    inside = F.col("line") - F.col("own") * block
    homes = F.array_compact(F.array("own", F.when((inside < halo) & (F.col("own") > 0), F.col("own") - 1), F.when(inside >= block - halo, F.col("own") + 1)))
    rows = reads.select("src", F.explode(homes).alias("blk"), "line", "v", "c", "own", "key")
    # one row a block that tells what is usual
    blocks = reads.select("src", F.col("own").alias("blk")).distinct().join(usual_by_source(reads, cfg), "src")
    told = blocks.select("src", "blk", F.lit(None).cast("bigint").alias("line"), "n", "p", "move")
    rows = rows.unionByName(told, allowMissingColumns=True).repartition("src", "blk").sortWithinPartitions("src", "blk", F.asc_nulls_first("line"), "v")
    rows = rows.select("src", "blk", "line", "v", "c", "own", "key", "n", "p", "move")
    key_type = df.schema[key].dataType.simpleString()
    with_counter = counter is not None

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_groups(batches, 2):
            col = lambda name: table.column(name).combine_chunks().to_numpy(zero_copy_only=False)
            group = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, table.num_rows]))
            line, x, n, p, move = (col(c) for c in ("line", "v", "n", "p", "move"))
            told = np.isfinite(n)
            normal = [Usual(0, 0.5, 0.0)] * len(starts)
            for i in np.flatnonzero(told):
                normal[group[i]] = Usual(int(n[i]), float(p[i]), float(move[i]))
            at = np.flatnonzero(~told)
            g, line, x = group[at], line[at], x[at]
            new = np.r_[True, (g[1:] != g[:-1]) | (line[1:] != line[:-1]) | (x[1:] != x[:-1])] if len(at) else np.zeros(0, bool)
            copy = np.cumsum(new) - 1  # the reading that a row is a copy of
            once = np.flatnonzero(new)
            gu, xu = g[once], x[once]
            ordered = _by_counter(gu, col("c")[at][once]) if with_counter and len(once) else np.arange(len(once))
            ends = np.searchsorted(gu, np.arange(len(starts) + 1))
            flags = flag_many([xu[ordered[a:b]] for a, b in zip(ends[:-1], ends[1:])], cfg, normal)
            done = [np.empty(len(once), bool) for _ in range(3)]
            for k in range(3):
                done[k][ordered] = np.concatenate([f[k] for f in flags]) if flags else np.zeros(0, bool)
            limit, spike, stuck = (f[copy] for f in done)
            own = col("own")[at] == col("blk")[at]
            hit = np.flatnonzero((limit | spike | stuck) & own)
            keys = table.column("key").take(pa.array(at[hit])).combine_chunks()
            yield pa.RecordBatch.from_arrays([keys, pa.array(limit[hit]), pa.array(spike[hit]), pa.array(stuck[hit])], ["key", "limit", "spike", "stuck"])

    flagged = rows.mapInArrow(judge, f"key {key_type}, limit boolean, spike boolean, stuck boolean")
    return flagged.withColumnRenamed("key", key).unionByName(alone)
