"""Irregular readings timed by a 16-bit counter onto a regular grid, with imputation and marks.

Three steps:

1. :func:`resolve_counter` turns the counter of every reading into an instant. Successive timed lines of a source
   (texts and readings) give signed counter steps, the running sum unwraps the counter, and the texts before and
   after fix the sum to an instant. A source is cut into blocks of lines; each block is unwrapped by itself and
   the blocks' totals are chained, so no task holds a whole source.
2. :func:`bucket` pre-aggregates readings to one row per (source, period).
3. :func:`impute` fills each source's grid by iterative singular-spectrum imputation: the bucketed series is embedded
   in a Hankel trajectory matrix, its leading singular vectors are kept, the missing entries are replaced by the
   reconstruction, until they no longer change. Filled periods are marked, and so are stretches that still changed
   when the safety bound ended the iteration.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from epochloom.operators.grouped import whole_groups
from epochloom.operators.spikes import ChartConfig, flag_many
from epochloom.operators.timestamps import COUNTER_START_S
from epochloom.runtime import spill


def _wrap(step):
    """A step of the 16-bit counter as the signed number nearest to zero."""
    return F.pmod(step + 32_768, F.lit(65_536)) - 32_768


def resolve_counter(
    readings: DataFrame, anchors: DataFrame, *, source: str, order: str = "line_no", key: str = "row_id", counter: str = "timestamp_16", block: int = 4096
) -> DataFrame:
    """Add ``utc_s`` (whole seconds since 1970 UTC) to rows with a counter; rows without one are left out.

    ``anchors`` has ``source``, ``order`` and ``utc_us`` of the lines whose instant is known. A reading takes the
    nearer (in lines) of the known lines before and after it. Sources without any known line have no instant and
    are left out. Null sources or orders are left out. Repeated rows get the same instant. ``anchors`` is read more than
    once, so it should be stored.
    """
    read = readings.where(F.col(counter).isNotNull() & F.col(source).isNotNull() & F.col(order).isNotNull())
    extra = [c for c in read.columns if c not in (source, order, counter, "utc_s")]
    blk = F.floor(F.col("__o") / block)
    rows = read.select(F.col(source).alias("__s"), F.col(order).cast("bigint").alias("__o"), F.col(counter).cast("bigint").alias("__c"), F.lit(None).cast("bigint").alias("__t"), *[F.col(f"`{c}`").alias(f"__x{i}") for i, c in enumerate(extra)]).withColumn("__b", blk)
    known = anchors.where(F.col("utc_us").isNotNull() & F.col(source).isNotNull() & F.col(order).isNotNull())
    at = F.floor(F.col("utc_us") / 1_000_000) - COUNTER_START_S
    texts = known.select(F.col(source).alias("__s"), F.col(order).cast("bigint").alias("__o"), F.pmod(at, F.lit(65_536)).alias("__c"), at.alias("__t")).withColumn("__b", blk)
    # sources that fit into one block need no chain; the list of the others is written first, so its real size decides how it is joined
    spans = read.groupBy(F.col(source).alias("__s")).agg(F.min(F.floor(F.col(order) / block)).alias("lo"), F.max(F.floor(F.col(order) / block)).alias("hi"))
    several = spans.unionByName(texts.groupBy("__s").agg(F.min("__b").alias("lo"), F.max("__b").alias("hi"))).groupBy("__s").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo < hi").select("__s")
    several = spill(several)
    names = [F.col("__s").alias(source), F.col("__o").alias(order), *[F.col(f"__x{i}").alias(c) for i, c in enumerate(extra)], F.col("utc_s")]
    whole = _unwrap(rows.join(several, "__s", "left_anti"), texts)
    chained = _unwrap(rows.join(several, "__s", "left_semi"), texts.join(several, "__s", "left_semi"), _chain)
    return whole.unionByName(chained).where(F.col("utc_s").isNotNull()).select(*names)


def _unwrap(rows: DataFrame, texts: DataFrame, chain: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``rows`` with ``utc_s``: the running sum of counter steps of a block, fixed by the nearer known line. One exchange, one sort."""
    lines = rows.unionByName(texts, allowMissingColumns=True)
    w = Window.partitionBy("__s", "__b").orderBy("__o", F.col("__t").isNull(), "__c")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("__u", F.coalesce(_wrap(F.col("__c") - F.lag("__c").over(w)), F.lit(0)))
    lines = lines.withColumn("__u", F.sum("__u").over(upto))
    # a known line as (line, true instant - unwrapped counter of this block)
    lines = lines.withColumn("__fix", F.when(F.col("__t").isNotNull(), F.struct(F.col("__o").alias("o"), (F.col("__t") - F.col("__u")).alias("k"))))
    seen = lines.select(
        "*", F.last("__fix", ignorenulls=True).over(upto).alias("__p"),
        # the next known line; this form is evaluated in linear time, a frame that ends at the last row isn't
        F.expr("lead(__fix) ignore nulls over (partition by __s, __b order by __o, __t is null, __c)").alias("__n"),
    ).where(F.col("__t").isNull())
    if chain is None:
        p, n, g = F.col("__p"), F.col("__n"), F.lit(0)
    else:
        seen, g = seen.join(chain(lines), ["__s", "__b"]), F.col("g")
        own = lambda f: F.when(F.col(f).isNotNull(), F.struct(F.col(f"{f}.o").alias("o"), (F.col(f"{f}.k") - g).alias("k")))
        p, n = F.coalesce(own("__p"), F.col("__before")), F.coalesce(own("__n"), F.col("__after"))
    k = F.when(n.isNull() | (F.col("__o") - p["o"] <= n["o"] - F.col("__o")), p["k"]).otherwise(n["k"])
    return seen.select(*rows.columns, (k + g + F.col("__u") + COUNTER_START_S).alias("utc_s"))


def _chain(lines: DataFrame) -> DataFrame:
    """One row per block: by how much its counter is ahead of the source's first block, and the known lines before and after it."""
    at = F.struct("__o", F.col("__t").isNull(), "__c")
    blocks = lines.groupBy("__s", "__b").agg(
        F.min_by("__c", at).alias("c0"), F.max_by("__c", at).alias("c1"), F.max_by("__u", at).alias("u1"), F.min("__fix").alias("f0"), F.max("__fix").alias("f1")
    )
    wb = Window.partitionBy("__s").orderBy("__b")
    blocks = blocks.withColumn("g", F.coalesce(F.lag("u1").over(wb) + _wrap(F.col("c0") - F.lag("c1").over(wb)), F.lit(0)))
    blocks = blocks.withColumn("g", F.sum("g").over(wb.rowsBetween(Window.unboundedPreceding, 0)))
    shifted = lambda f: F.when(F.col(f).isNotNull(), F.struct(F.col(f"{f}.o").alias("o"), (F.col(f"{f}.k") - F.col("g")).alias("k")))
    return blocks.select(
        "__s", "__b", "g",
        F.last(shifted("f1"), ignorenulls=True).over(wb.rowsBetween(Window.unboundedPreceding, -1)).alias("__before"),
        F.last(shifted("f0"), ignorenulls=True).over(Window.partitionBy("__s").orderBy(F.desc("__b")).rowsBetween(Window.unboundedPreceding, -1)).alias("__after"),
    )


def bucket(readings: DataFrame, *, source: str, value: str, period_s: int = 60) -> DataFrame:
    """One row per source and period with a reading: ``bucket`` (number of the period), ``value`` (mean), ``n``."""
    v = F.col(f"`{value}`").cast("double")
    return readings.groupBy(source, F.floor(F.col("utc_s") / period_s).alias("bucket")).agg(F.avg(v).alias("value"), F.count(v).alias("n"))


@dataclass(frozen=True)
class SsaConfig:
    """``window``: length of the embedded vectors; ``rank``: singular vectors kept; ``tolerance``: the iteration ends when no entry moves by as much; ``rounds``: safety bound, a series that reaches it is not converged."""

    window: int = 16
    rank: int = 4
    rounds: int = 2_000
    tolerance: float = 0.05


def ssa_fill(y: np.ndarray, cfg: SsaConfig = SsaConfig()) -> np.ndarray:
    """Series with its missing entries (NaN) imputed; observed entries are kept.

    Nothing observed gives NaN throughout; a series too short to embed is filled linearly.
    """
    return ssa_converge(y, cfg)[0]


def ssa_converge(y: np.ndarray, cfg: SsaConfig = SsaConfig()) -> tuple[np.ndarray, bool]:
    """The series of :func:`ssa_fill` and whether its iteration met the tolerance; True where nothing is iterated."""
    done, converged = ssa_converge_many([y], [_straight(y)], cfg)
    return done[0], bool(converged[0])


def _straight(y: np.ndarray, at: np.ndarray | None = None, seen: np.ndarray | None = None, values: np.ndarray | None = None) -> np.ndarray:
    """The series with its missing entries on straight lines between the known ones (``values`` at ``seen`` if given)."""
    at = np.arange(len(y)) if at is None else at
    if seen is None:
        seen, values = at[~np.isnan(y)], y[~np.isnan(y)]
    return np.where(np.isnan(y), np.interp(at, seen, values), y) if len(seen) else y.copy()


def ssa_converge_many(series: list[np.ndarray], begin: list[np.ndarray], cfg: SsaConfig = SsaConfig()) -> tuple[list[np.ndarray], np.ndarray]:
    """Each series with its missing entries imputed, starting from those of ``begin``, and whether it converged.

    A round embeds a series in its Hankel matrix, keeps the leading left singular vectors, weighs each by the share of its
    energy that isn't noise (the median of the other eigenvalues), and averages the anti-diagonals. The next round starts beyond the
    last step (Nesterov's momentum, restarted when it points away). Imputed values stay within the observed ones.
    Series with fewer than 4 observed entries or too short to embed keep the values of ``begin``.
    """
    out, converged = [b.copy() for b in begin], np.ones(len(series), bool)
    todo: dict[int, list[int]] = defaultdict(list)
    for i, y in enumerate(series):
        missing = np.isnan(y)
        length = min(cfg.window, len(y) // 2)
        if missing.any() and len(y) - missing.sum() >= 4 and length >= 2:
            todo[length].append(i)
    for length, which in todo.items():
        done, fine = _iterate([series[i] for i in which], [begin[i] for i in which], length, min(cfg.rank, length - 1), cfg)
        for i, x, ok in zip(which, done, fine):
            out[i], converged[i] = x, ok
    return out, converged


def _gram(x: np.ndarray, n: np.ndarray, length: int) -> np.ndarray:
    """Products of the rows of each series' Hankel matrix. ``x`` is padded with zeros: ``length - 1`` before, at least as many behind.

    A product is the series' autocorrelation less what falls off at either end, so the matrix is never built.
    """
    p, most = length - 1, x.shape[1] - 2 * (length - 1)
    body = x[:, p : p + most]
    ends = (n - p)[:, None] + np.arange(p) + p
    head, tail = body[:, :p], np.take_along_axis(x, ends, 1)
    r = np.stack([np.einsum("bt,bt->b", body, x[:, p + k : p + k + most]) for k in range(length)], 1)
    off = np.zeros((2, len(x), length, length))
    for k in range(length - 1):
        off[0, :, 1 : length - k, k] = np.cumsum(head[:, : p - k] * head[:, k:], 1)
        off[1, :, : p - k, k] = np.cumsum((tail[:, : p - k] * tail[:, k:])[:, ::-1], 1)[:, ::-1]
    i, j = np.triu_indices(length)
    g = np.empty((len(x), length, length))
    g[:, i, j] = r[:, j - i] - off[0][:, i, j - i] - off[1][:, i, j - i]
    g[:, j, i] = g[:, i, j]
    return g


def _iterate(series: list[np.ndarray], begin: list[np.ndarray], length: int, rank: int, cfg: SsaConfig) -> tuple[list[np.ndarray], np.ndarray]:
    """Rounds of all series together; a series that has converged leaves."""
    pad = length - 1
    n = np.array([len(y) for y in series])
    x = np.zeros((len(series), n.max() + 2 * pad))
    means, lo, hi = (np.empty(len(series)) for _ in range(3))
    holes = []
    for b, (y, start) in enumerate(zip(series, begin)):
        known = y[~np.isnan(y)]
        means[b], lo[b], hi[b] = known.mean(), known.min(), known.max()
        x[b, pad : pad + n[b]] = start - means[b]
        holes.append(np.flatnonzero(np.isnan(y)))
    lo, hi = lo - means, hi - means
    result, fine = [b.copy() for b in begin], np.zeros(len(series), bool)
    live = np.arange(len(series))  # rows of x are those of the series that go on
    z = [x[b, pad + h] for b, h in enumerate(holes)]
    last, speed = [v.copy() for v in z], np.ones(len(series))
    taps = np.arange(2 * length - 1)
    for _ in range(cfg.rounds):
        energy, vectors = np.linalg.eigh(_gram(x, n[live], length))
        energy = np.maximum(energy, 1e-9)
        u, noise = vectors[:, :, -rank:], np.median(energy[:, :-rank], 1)
        share = np.maximum(0, 1 - noise[:, None] / energy[:, -rank:])
        low = (u * share[:, None, :]) @ u.transpose(0, 2, 1)
        # sums[a, d]: weight of the entry d away, over the windows that begin at most a before an entry
        sums = np.zeros((len(live), length + 1, 2 * length - 1))
        for a in range(length):
            sums[:, a + 1, pad - a : pad - a + length] = low[:, a]
        sums = np.cumsum(sums, 1)
        stay = np.ones(len(live), bool)
        around = np.lib.stride_tricks.sliding_window_view(x, len(taps), axis=1)
        for row, b in enumerate(live.tolist()):
            h = holes[b]
            new = around[row, h] @ (sums[row, length] / length)
            edge = np.flatnonzero((h < pad) | (h > n[b] - length))
            if len(edge):
                most, least = np.minimum(pad, h[edge]), np.maximum(0, h[edge] - n[b] + length)
                new[edge] = ((sums[row, most + 1] - sums[row, least]) * around[row, h[edge]]).sum(1) / (most - least + 1)
            np.minimum(np.maximum(new, lo[b]), hi[b], out=new)
            if np.abs(new - z[b]).max() < cfg.tolerance:
                result[b][h], fine[b], stay[row] = new + means[b], True, False
                continue
            if ((z[b] - new) * (new - last[b])).sum() > 0:
                speed[b] = 1.0
            ahead = (1 + np.sqrt(1 + 4 * speed[b] ** 2)) / 2
            z[b] = new + (speed[b] - 1) / ahead * (new - last[b])
            last[b], speed[b] = new, ahead
            x[row, pad + h] = z[b]
        if not stay.all():
            live, x = live[stay], x[stay]
            if not len(live):
                break
            x = x[:, : n[live].max() + 2 * pad]
    for b in live.tolist():
        result[b][holes[b]] = last[b] + means[b]
    return result, fine


def impute(buckets: DataFrame, *, source: str, cfg: SsaConfig = SsaConfig(), block: int = 2880, halo: int = 120, charts: ChartConfig | None = None) -> DataFrame:
    """The full grid between each source's first and last bucket: ``bucket``, ``value``, ``filled`` and ``converged``.

    A bucket without row is filled and marked; one whose value is null is imputed, but not marked as filled, as
    readings fell into it. With ``charts`` values that :mod:`epochloom.operators.spikes` flags within their stretch count as null.

    A source is cut from its first bucket on into stretches of ``block`` buckets, each imputed together with ``halo``
    buckets of its neighbours, so a source of any length is spread over tasks. Every bucket of a source with any value gets one: in
    a stretch without values they lie on the line between the nearest values of the source. ``converged`` is False
    for all buckets of a stretch that still changed by the tolerance after ``cfg.rounds``. An empty table gives an empty result.
    """
    has = buckets.where(F.col("bucket").isNotNull()).select(F.col(source).alias("s"), "bucket", F.col("value").cast("double").alias("value"))
    span = has.groupBy("s").agg(F.min("bucket").alias("lo"), F.max("bucket").alias("hi"))
    placed = has.join(span.withColumnRenamed("s", "__s"), F.col("s").eqNullSafe(F.col("__s"))).withColumn("own", F.floor((F.col("bucket") - F.col("lo")) / block))
    inside = F.col("bucket") - F.col("lo") - F.col("own") * block
    last = F.floor((F.col("hi") - F.col("lo")) / block)
    homes = F.array_compact(F.array("own", F.when((inside < halo) & (F.col("own") > 0), F.col("own") - 1), F.when((inside >= block - halo) & (F.col("own") < last), F.col("own") + 1)))
    rows = placed.select("s", F.explode(homes).alias("blk"), "bucket", "value", "own").select("s", "blk", "bucket", F.when(F.col("blk") == F.col("own"), OWN).otherwise(HALO).cast("tinyint").alias("kind"), "value")
    # sources of several stretches: where each begins and ends, and the values next to it
    several = placed.where(last > 0)
    sums = several.where(F.col("value").isNotNull()).groupBy("s", F.col("own").alias("blk")).agg(F.min(F.struct("bucket", "value")).alias("first"), F.max(F.struct("bucket", "value")).alias("last"))
    parts = span.where(last > 0).select("s", "lo", "hi", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("blk")).alias("p")
    parts = parts.join(sums.alias("v"), F.col("p.s").eqNullSafe(F.col("v.s")) & (F.col("p.blk") == F.col("v.blk")), "left").select("p.*", "v.first", "v.last")
    w, back = Window.partitionBy("s").orderBy("blk"), Window.partitionBy("s").orderBy(F.desc("blk"))
    before, after = F.last("last", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.last("first", ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("s", "blk", "hi", before.alias("before"), after.alias("after"), (F.col("lo") + F.col("blk") * block).alias("begins"))
    begins, before, after = F.col("begins"), F.col("before"), F.col("after")
    marks = parts.select("s", "blk", F.explode(F.array(
        F.struct(begins.alias("bucket"), F.lit(MARK).cast("tinyint").alias("kind"), F.lit(None).cast("double").alias("value")),
        F.struct(F.least("hi", begins + block - 1).alias("bucket"), F.lit(MARK).cast("tinyint").alias("kind"), F.lit(None).cast("double").alias("value")),
        F.struct(before["bucket"].alias("bucket"), F.lit(NEAR).cast("tinyint").alias("kind"), before["value"].alias("value")),
        F.struct(after["bucket"].alias("bucket"), F.lit(NEAR).cast("tinyint").alias("kind"), after["value"].alias("value")),
    )).alias("m")).select("s", "blk", "m.*").where("bucket is not null")
    rows = rows.unionByName(marks).repartition("s", "blk").sortWithinPartitions("s", "blk", "bucket", "kind")
    kind_of = buckets.schema[source].dataType.simpleString()

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_groups(batches, 2, 100_000):
            at, kind = table.column("bucket").to_numpy(), table.column("kind").to_numpy()
            value = table.column("value").combine_chunks().to_numpy(zero_copy_only=False)
            pieces = [_stretch(at[a:b], kind[a:b], value[a:b]) for a, b in zip(starts, np.r_[starts[1:], len(at)])]
            if charts:
                known = [np.flatnonzero(~np.isnan(p.y)) for p in pieces]
                for p, k, flags in zip(pieces, known, flag_many([p.y[k] for p, k in zip(pieces, known)], charts)):
                    p.y[k[flags[0] | flags[1] | flags[2]]] = np.nan
            done, fine = ssa_converge_many([p.y for p in pieces], [p.straight() for p in pieces], cfg)
            sizes = [p.hi - p.lo + 1 for p in pieces]
            keys = table.column("s").combine_chunks().take(pa.array(np.repeat(starts, sizes)))
            bucket = np.concatenate([np.arange(p.lo, p.hi + 1) for p in pieces])
            values = np.concatenate([x[p.lo - p.start : p.hi - p.start + 1] for p, x in zip(pieces, done)])
            filled = np.concatenate([~p.read[p.lo - p.start : p.hi - p.start + 1] for p in pieces])
            yield pa.RecordBatch.from_arrays([keys, pa.array(bucket), pa.array(values, from_pandas=True), pa.array(filled), pa.array(np.repeat(fine, sizes))], ["s", "bucket", "value", "filled", "converged"])

    return rows.mapInArrow(fill, f"s {kind_of}, bucket bigint, value double, filled boolean, converged boolean").withColumnRenamed("s", source)


#: Kinds of rows that make a stretch: its buckets, those of its neighbours, its bounds, and the nearest values outside.
OWN, HALO, MARK, NEAR = range(4)


@dataclass
class _Piece:
    """A stretch: ``y`` from bucket ``start`` on, its own buckets ``lo`` to ``hi``, which were read, and values outside."""

    start: int
    lo: int
    hi: int
    y: np.ndarray
    read: np.ndarray
    near: np.ndarray
    near_values: np.ndarray

    def straight(self) -> np.ndarray:
        at = np.arange(self.start, self.start + len(self.y))
        known = ~np.isnan(self.y)
        seen, values = np.r_[at[known], self.near], np.r_[self.y[known], self.near_values]
        order = np.argsort(seen, kind="stable")
        return _straight(self.y, at, seen[order], values[order])


def _stretch(at: np.ndarray, kind: np.ndarray, value: np.ndarray) -> _Piece:
    inner, own, near = kind != NEAR, kind == OWN, kind == NEAR
    bounds = at[(kind == MARK) if (kind == MARK).any() else own]
    start, end = int(at[inner].min()), int(at[inner].max())
    y, read = np.full(end - start + 1, np.nan), np.zeros(end - start + 1, bool)
    data = inner & (kind != MARK)
    y[at[data] - start] = value[data]
    read[at[own] - start] = True
    return _Piece(start, int(bounds.min()), int(bounds.max()), y, read, at[near], value[near])
