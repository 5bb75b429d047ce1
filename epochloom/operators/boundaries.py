"""Sleep boundaries from annotations, heart rate or arm angle, and their evaluation."""

from __future__ import annotations

import functools
import itertools

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from epochloom.operators.days import with_day
from epochloom.operators.islands import largest_run, long_runs, merge_tolerance, run_lengths
from epochloom.operators.metrics import agreement_columns
from epochloom.schema import EpochSchema

_DAY = "__search_day"


def _pick(df: DataFrame, cand: str, s: EpochSchema, start_hour: int, only_largest: bool, out: str) -> DataFrame:
    """The candidate itself, or per day from ``start_hour`` its longest run."""
    if not only_largest:
        return df.withColumn(out, F.coalesce(F.col(cand), F.lit(False)))
    return largest_run(with_day(df, s, start_hour, out=_DAY), cand, s, by=(_DAY,), out=out).drop(_DAY)


def by_annotation(df: DataFrame, s: EpochSchema, *, annotation: str | None = None, merge_minutes: float = 20, start_hour: int = 18, only_largest: bool = True, out: str = "hyp_sleep_period") -> DataFrame:
    """Annotated epochs, merged over gaps of ``merge_minutes``; per day the longest stretch."""
    a = annotation or s.annotation
    s.need(df, a)
    x = merge_tolerance(df, a, merge_minutes, s, out="__cand")
    return _pick(x, "__cand", s, start_hour, only_largest, out).drop("__cand")


def _bins(t: Column, start_hour: int) -> Column:
    """Number of the 24-hour bin from ``start_hour``."""
    return F.floor((t - start_hour * 3600) / 86_400)


def _bin_quantile(df: DataFrame, value: Column, s: EpochSchema, start_hour: int, q: float | list[float], out: str) -> DataFrame:
    """Interpolated quantile of a column's values per participant and 24-hour bin, on every epoch; bins without values
    take the one before, else the one after."""
    x = df.withColumn("__bin", _bins(s.seconds(df), start_hour))
    per = x.groupBy(s.pid, "__bin").agg(F.percentile(value, F.array(*map(F.lit, q)) if isinstance(q, list) else F.lit(q)).alias("__q"))
    w = Window.partitionBy(s.pid).orderBy("__bin")
    filled = F.coalesce(F.last("__q", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.last("__q", ignorenulls=True).over(Window.partitionBy(s.pid).orderBy(F.desc("__bin")).rowsBetween(Window.unboundedPreceding, 0)))
    per = per.select(s.pid, "__bin", filled.alias(out))
    return x.join(per, [s.pid, "__bin"]).drop("__bin")


def _full(frame: Window, n: int, value: Column) -> Column:
    return F.when(F.count(F.lit(1)).over(frame) == n, value)


def by_heart_rate(
    df: DataFrame, s: EpochSchema, *, quantile: float = 0.4, volatility: float = 5, rolling_minutes: float = 5, search: tuple[int, int] = (20, 12), min_minutes: float = 40,
    volatility_minutes: float = 10, merge_minutes: float = 240, only_in_search: bool = False, only_largest: bool = False, out: str = "hyp_sleep_period",
) -> DataFrame:
    """Epochs whose heart rate stays below its daily quantile, smoothed, merged, and extended to volatile epochs nearby.

    Outside the search window (from its first to its second hour) heart rate counts as missing, and a missing value counts
    as below, unless ``only_in_search``. Parameters in minutes are turned to epochs.
    """
    if not s.hr or s.hr not in df.columns:
        raise AttributeError("needs a heart-rate column")
    start, end = search
    x = _searched(df, s, search)
    x = _bin_quantile(x, F.col("__hr"), s, start, quantile, "__thr")
    picked = _below(x, s, volatility=F.lit(volatility), rolling_minutes=rolling_minutes, start=start, min_minutes=F.lit(min_minutes), volatility_minutes=volatility_minutes, merge_minutes=merge_minutes, only_in_search=only_in_search, only_largest=only_largest, out=out)
    return picked.select(*[c for c in df.columns if c != out], out)


def sweep_heart_rate(
    df: DataFrame, s: EpochSchema, *, quantiles: list[float], min_minutes: list[float], merge_minutes: list[float], volatilities: tuple[float, ...] = (5,), rolling_minutes: float = 5, search: tuple[int, int] = (20, 12),
    volatility_minutes: float = 10, only_in_search: bool = False, only_largest: bool = False, out: str = "hyp_sleep_period",
) -> DataFrame:
    """:func:`by_heart_rate` for every combination of the lists, in one plan: (the table's columns, ``param_id``, ``quantile``, ``volatility``,
    ``min_minutes``, ``merge_minutes``, ``out``). ``merge_minutes`` mustn't be negative.

    A day's quantiles come from one aggregation; then every epoch is repeated for each combination, which is a further
    key of all windows, so a participant's combinations are spread over tasks.
    """
    if not s.hr or s.hr not in df.columns:
        raise AttributeError("needs a heart-rate column")
    grid = _grid(quantiles, volatilities, min_minutes, merge_minutes)
    x = _searched(df, s, search)
    x = _bin_quantile(x, F.col("__hr"), s, search[0], [float(q) for q in quantiles], "__all")
    names = ("param_id", "__qi", "volatility", "min_minutes", "merge_minutes")
    combos = F.array(*[F.struct(F.lit(i).alias(names[0]), F.lit(q).alias(names[1]), *[F.lit(float(v)).alias(n) for n, v in zip(names[2:], rest)]) for i, (q, *rest) in enumerate(grid)])
    x = x.withColumn("__p", F.explode(combos)).select("*", "__p.*").withColumn("__thr", F.get("__all", F.col("__qi"))).withColumn("quantile", F.get(F.array(*[F.lit(float(q)) for q in quantiles]), F.col("__qi")))
    keyed = s.at(blocks=(*s.blocks, "param_id"))
    picked = _below(x, keyed, volatility=F.col("volatility"), rolling_minutes=rolling_minutes, start=search[0], min_minutes=F.col("min_minutes"), volatility_minutes=volatility_minutes, merge_minutes=F.col("merge_minutes"), only_in_search=only_in_search, only_largest=only_largest, out=out)
    return picked.select(*[c for c in df.columns if c != out], "param_id", "quantile", "volatility", "min_minutes", "merge_minutes", out)


def _grid(quantiles: list[float], volatilities: tuple[float, ...], min_minutes: list[float], merge_minutes: list[float]) -> list[tuple]:
    """Every combination, with the place of its quantile in the list; the place in the result is ``param_id``."""
    grid = list(itertools.product(range(len(quantiles)), volatilities, min_minutes, merge_minutes))
    if not grid or min(merge_minutes) < 0:
        raise ValueError("needs values for every parameter, and no negative merge_minutes")
    return grid


def sweep_heart_rate_totals(
    df: DataFrame, s: EpochSchema, *, quantiles: list[float], min_minutes: list[float], merge_minutes: list[float], volatilities: tuple[float, ...] = (5,), rolling_minutes: float = 5, search: tuple[int, int] = (20, 12),
    volatility_minutes: float = 10, only_in_search: bool = False, out: str = "epochs_asleep",
) -> DataFrame:
    """How many epochs of a participant :func:`sweep_heart_rate` flags for each combination: (pid, ``param_id``, ``quantile``, ``volatility``,
    ``min_minutes``, ``merge_minutes``, ``out``).

    No epoch is repeated. All epochs are passed once, with one flag a quantile; the other parameters need only the first and last epochs
    of low stretches, and those alone are repeated for each combination. All windows share the participant's partitioning.
    """
    if not s.hr or s.hr not in df.columns:
        raise AttributeError("needs a heart-rate column")
    grid = _grid(quantiles, volatilities, min_minutes, merge_minutes)
    x = _low_edges(df, s, [float(q) for q in quantiles], volatilities, rolling_minutes, search, volatility_minutes, only_in_search)
    who, past = (s.pid, *s.blocks), (Window.unboundedPreceding, 0)

    # stretches that are low, cut where a day begins; one that isn't stands for a participant's first epoch, so that totals of 0 have their row
    x = x.withColumn("__e", F.explode("__edges")).select("*", "__e.*").drop("__edges", "__e")
    w = Window.partitionBy(*who, "__q").orderBy("__idx")
    end = F.struct("__idx", "__t", "__r2", "__hi")
    x = x.withColumn("__end", F.when(F.col("__on"), F.when(F.col("__last"), end).otherwise(F.lead(end).over(w)))).where("__first or __idx = 1")
    same = F.col("__on") & (F.col("__idx") == F.lag(F.col("__end.__idx")).over(w) + 1)
    x = x.withColumn("__run", F.sum(F.coalesce(same, F.lit(False)).cast("int") * -1 + 1).over(w.rowsBetween(*past)))
    x = x.withColumn("__len", F.sum(F.col("__end.__idx") - F.col("__idx") + 1).over(Window.partitionBy(*who, "__q", "__run")))

    params = ("param_id", "quantile", "volatility", "min_minutes", "merge_minutes")
    combos = [
        F.array(*[
            F.struct(F.lit(i).alias("param_id"), F.lit(float(quantiles[q])).alias("quantile"), *[F.lit(float(v)).alias(n) for n, v in zip(params[2:], rest)], F.lit(volatilities.index(rest[0])).alias("__v"))
            for i, (q, *rest) in enumerate(grid) if q == k
        ])
        for k in range(len(quantiles))
    ]
    x = x.withColumn("__p", F.explode(F.get(F.array(*combos), F.col("__q")))).select("*", "__p.*")
    long = F.col("__on") & (F.col("__len") > F.greatest(F.lit(1), F.rint(F.col("min_minutes") * s.per_minute)))
    x = x.withColumn("__cand", F.coalesce(long, F.lit(False))).where("__cand or __idx = 1")
    w = Window.partitionBy(*who, "param_id").orderBy("__idx")
    before = F.lag(F.struct("__cand", "__day", F.col("__end.__idx").alias("__i"), F.col("__end.__t").alias("__t"))).over(w)
    x = x.withColumn("__b", before)
    close = (F.col("__day") == F.col("__b.__day")) & (F.col("__t") - F.col("__b.__t") <= F.col("merge_minutes") * 60)
    merged = F.col("__cand") & F.col("__b.__cand") & ((F.col("__idx") == F.col("__b.__i") + 1) | close)
    x = x.withColumn("__run", F.sum(F.coalesce(merged, F.lit(False)).cast("int") * -1 + 1).over(w.rowsBetween(*past)))

    mine = lambda c: F.when(F.col("__cand"), c)
    runs = x.groupBy(*who, *params, "__run").agg(
        F.min(mine(F.col("__r1"))).alias("a"), F.min_by(mine(F.get("__lo", F.col("__v"))), "__idx").alias("lo"),
        F.max(mine(F.col("__end.__r2"))).alias("b"), F.max_by(mine(F.get("__end.__hi", F.col("__v"))), "__idx").alias("hi"),
    )
    runs = runs.select(*who, *params, F.least("a", "lo").alias("a"), F.greatest("b", "hi").alias("b"))
    # extended runs may overlap; each counts what lies past those begun before
    done = F.max("b").over(Window.partitionBy(*who, "param_id").orderBy("a", "b").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.withColumn("__n", F.greatest(F.lit(0), F.col("b") - F.greatest(F.col("a") - 1, done)))
    return runs.groupBy(s.pid, *params).agg(F.sum("__n").alias(out))


def _low_edges(df: DataFrame, s: EpochSchema, quantiles: list[float], volatilities: tuple[float, ...], rolling_minutes: float, search: tuple[int, int], volatility_minutes: float, only_in_search: bool) -> DataFrame:
    """A participant's first epoch and those at which a stretch of low heart rate begins or ends for any quantile: number (``__idx``), time,
    search day, numbers of the first and last epoch of the same time (``__r1``, ``__r2``), ``__edges`` (the quantiles for which it is one), and per volatility the
    number to which a run that begins here (``__lo``) or ends here (``__hi``) is extended, if it is."""
    start, epochs, every = search[0], lambda m: max(1, round(m * s.per_minute)), (Window.unboundedPreceding, Window.unboundedFollowing)
    who, n, k = (s.pid, *s.blocks), epochs(rolling_minutes), range(len(quantiles))
    x = _searched(df.where(F.col(s.pid).isNotNull() & F.col(s.time).isNotNull()), s, search).withColumn("__t", s.seconds(df))
    x = x.withColumn("__bin", _bins(F.col("__t"), start)).withColumn("__day", F.to_date(F.col(s.time) - F.expr(f"make_dt_interval(0, {int(start)})")))
    # bins and seconds rise with time, so this is the order of time; with it one sort serves all windows up to the bounds of runs
    order = ("__bin", "__t", s.time, *([s.row] if s.row else []))
    w, own = Window.partitionBy(*who).orderBy(*order), Window.partitionBy(s.pid).orderBy(*order)
    x = x.select(*who, *order, s.hr, "__out", "__hr", "__day", F.row_number().over(w).alias("__idx"), _volatility(w, epochs(volatility_minutes), s).alias("__vol"))
    x = x.withColumn("__q", F.percentile("__hr", F.array(*map(F.lit, quantiles))).over(Window.partitionBy(s.pid, "__bin")))
    x = x.withColumn("__thr", F.coalesce(F.last("__q", ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, 0)), F.first("__q", ignorenulls=True).over(own.rowsBetween(*every))))
    # low where most of the last n epochs are; the first epochs take the first full frame's value
    low = [F.when(F.col("__hr") - F.get("__thr", F.lit(i)) > 0, 0).otherwise(1) for i in k]
    whole, frame = w.rowsBetween(*every), w.rowsBetween(-(n - 1), 0)
    most = [F.when(F.col("__idx") < n, F.sum(F.when(F.col("__idx") <= n, v)).over(whole)).otherwise(F.sum(v).over(frame)) * 2 > n for v in low]
    inside = ~F.col("__out") if only_in_search else F.lit(True)
    x = x.select(*who, *order, "__day", "__idx", "__vol", *[((F.max("__idx").over(whole) >= n) & v & inside).alias(f"__on{i}") for i, v in enumerate(most)])
    ends = [F.col(f"__on{i}") & ~F.coalesce(f(f"__on{i}").over(w) & (f("__day").over(w) == F.col("__day")), F.lit(False)) for f in (F.lag, F.lead) for i in k]
    x = x.select("*", *[v.alias(f"__{'first' if j < len(k) else 'last'}{j % len(k)}") for j, v in enumerate(ends)])
    edges = [F.when(F.expr(f"__first{i} or __last{i} or __idx = 1"), F.struct(F.lit(i).alias("__q"), *[F.col(f"{c}{i}").alias(c) for c in ("__on", "__first", "__last")])) for i in k]
    peers = Window.partitionBy(*who).orderBy("__bin", "__t")
    x = x.select(*who, "__t", "__day", "__idx", "__vol", F.array_compact(F.array(*edges)).alias("__edges"), F.rank().over(peers).alias("__r1"), F.count(F.lit(1)).over(peers.rangeBetween(Window.unboundedPreceding, 0)).alias("__r2"))

    # seen from an epoch: the last volatile one up to 1 h later, no more than 4 h before; the first from 1 min before, no more than 2 h later
    x = x.where((F.size("__edges") > 0) | (F.col("__vol") > float(min(volatilities))))
    on = Window.partitionBy(*who).orderBy("__t").rangeBetween(Window.unboundedPreceding, 3600)
    back = Window.partitionBy(*who).orderBy(-F.col("__t")).rangeBetween(Window.unboundedPreceding, 60)
    wild = lambda v, c: F.when(F.col("__vol") > F.lit(float(v)), F.col(c))
    lo = [F.when(F.max(wild(v, "__t")).over(on) >= F.col("__t") - 4 * 3600, F.max(wild(v, "__r1")).over(on)) for v in volatilities]
    hi = [F.when(F.min(wild(v, "__t")).over(back) <= F.col("__t") + 2 * 3600, F.min(wild(v, "__r2")).over(back)) for v in volatilities]
    x = x.withColumn("__lo", F.array(*lo)).withColumn("__hi", F.array(*hi))
    return x.where(F.size("__edges") > 0).select(*who, "__t", "__day", "__idx", "__r1", "__r2", "__edges", "__lo", "__hi")


def _volatility(w: WindowSpec, n: int, s: EpochSchema) -> Column:
    """Standard deviation of the ``n`` heart rates around an epoch; 0 if one is missing."""
    around = w.rowsBetween(-(n - 1 - (n - 1) // 2), (n - 1) // 2)
    return F.coalesce(_full(around, n, F.when(F.count(s.hr).over(around) == n, F.stddev_samp(F.col(s.hr).cast("double")).over(around))), F.lit(0.0))


def _searched(df: DataFrame, s: EpochSchema, search: tuple[int, int]) -> DataFrame:
    """Add whether an epoch is outside the search window (``__out``) and its heart rate inside (``__hr``)."""
    start, end = search
    t = s.seconds(df)
    clock = t - F.floor(t / 86_400) * 86_400
    if start == end:
        outside = F.lit(False)
    else:
        lo, hi = end * 3600, start * 3600
        outside = (clock > lo) & (clock < hi) if lo < hi else (clock > lo) | (clock < hi)
    return df.withColumn("__out", outside).withColumn("__hr", F.when(~outside, F.col(s.hr).cast("double")))


def _below(
    x: DataFrame, s: EpochSchema, *, volatility: Column, rolling_minutes: float, start: int, min_minutes: Column, volatility_minutes: float, merge_minutes: float | Column, only_in_search: bool, only_largest: bool, out: str
) -> DataFrame:
    """The steps after the quantile (``__thr``) is known."""
    w, epochs = s.window(), lambda m: max(1, round(m * s.per_minute))
    x = x.withColumn("__low", F.when(F.col("__hr") - F.col("__thr") > 0, 0.0).otherwise(1.0))
    n = epochs(rolling_minutes)
    frame = w.rowsBetween(-(n - 1), 0)
    total = F.sum("__low").over(frame)  # the median of zeros and ones
    x = x.withColumn("__med", _full(frame, n, F.when(total * 2 > n, 1.0).when(total * 2 == n, 0.5).otherwise(0.0)))
    x = x.withColumn("__med", F.last("__med", ignorenulls=True).over(s.window_back().rowsBetween(Window.unboundedPreceding, 0)))
    if only_in_search:
        x = x.withColumn("__med", F.when(F.col("__out"), 0.0).otherwise(F.col("__med")))
    x = run_lengths(x.withColumn("__m2", (F.col("__med") * 2).cast("int")), "__m2", s, length="__len", seq="__seq")
    x = x.withColumn("__cand", (F.col("__med") == 1.0) & (F.col("__len") > F.greatest(F.lit(1), F.rint(min_minutes * s.per_minute))))
    x = x.withColumn("__vol", _volatility(w, epochs(volatility_minutes), s))
    x = with_day(x.drop("__len", "__seq"), s, start, out=_DAY)
    x = merge_tolerance(x, "__cand", merge_minutes, s, by=(_DAY,))
    x = _extend(x, s, volatility)
    return largest_run(x, "__cand", s, by=(_DAY,), out=out) if only_largest else x.withColumn(out, F.col("__cand"))


def _extend(x: DataFrame, s: EpochSchema, threshold: Column) -> DataFrame:
    """Extend runs of candidates back to the last volatile epoch of [start - 4 h, start + 1 h] and on to the first of
    [end - 1 min, end + 2 h]. Every run is judged from its own bounds; it never shrinks."""
    t = s.seconds(x)
    x = run_lengths(x.withColumn("__t", t), "__cand", s, length="__len", seq="__seq")
    who = [s.pid, *s.blocks]
    w = Window.partitionBy(*who).orderBy("__t")
    wild = F.when(F.col("__vol") > threshold, F.col("__t"))
    # seen from a run's first (last) epoch these frames hold the epochs that may move its bound
    x = x.withColumn("__lo", F.max(wild).over(w.rangeBetween(-4 * 3600, 3600))).withColumn("__hi", F.min(wild).over(w.rangeBetween(-60, 2 * 3600)))
    runs = x.where("__cand").groupBy(*who, "__seq").agg(
        F.min("__t").alias("a"), F.max("__t").alias("b"), F.min_by("__lo", "__t").alias("lo"), F.max_by("__hi", "__t").alias("hi")
    )
    runs = runs.select(*who, F.least("a", F.coalesce("lo", "a")).alias("a"), F.greatest("b", F.coalesce("hi", "b")).alias("b"))
    # an epoch is inside a run if the furthest end of the runs begun so far isn't past
    begun = runs.select(*who, F.col("a").alias("__t"), F.col("b").alias("__until"), F.lit(0).alias("__e"))
    both = x.withColumn("__e", F.lit(1)).unionByName(begun, allowMissingColumns=True)
    order = Window.partitionBy(*who).orderBy("__t", "__e").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("__cand", F.coalesce(F.max("__until").over(order) >= F.col("__t"), F.lit(False)))
    return both.where("__e = 1").drop("__e", "__until", "__t", "__lo", "__hi", "__len", "__seq")


def z_angle(x: Column, y: Column, z: Column) -> Column:
    """Arm angle to the horizontal in degrees; missing or undefined is 0, straight up or down +-90."""
    flat = F.sqrt(x * x + y * y)
    return F.coalesce(F.when(flat == 0, F.signum(z) * 90.0).otherwise(F.degrees(F.atan(z / F.nullif(flat, F.lit(0.0))))), F.lit(0.0))


def by_angle(
    df: DataFrame, s: EpochSchema, *, columns: tuple[str, ...] = (), triaxial: bool = False, start_hour: int = 15, quantile: float = 0.1, factor: float = 15, min_minutes: float = 30,
    merge_minutes: float = 180, only_largest: bool = True, operator: str = "or", out: str = "hyp_sleep_period",
) -> DataFrame:
    """Stretches in which angles hardly change: per column the rolling median (5 minutes) of absolute changes stays below
    ``factor`` times its daily quantile for more than ``min_minutes``; columns are combined by ``or`` or ``and``."""
    if operator not in ("or", "and") or not (columns or triaxial):
        raise ValueError("needs angle columns or triaxial activity, and operator 'or' or 'and'")
    s.need(df, *columns)
    w, x, cols = s.window(), df, list(columns)
    if triaxial:
        if len(s.activity) != 3:
            raise ValueError("needs three activity columns")
        five = Window.partitionBy(s.pid).orderBy("__t").rangeBetween(-4, 0)
        x = x.withColumn("__t", s.seconds(df))
        x = x.select("*", *[F.percentile(F.col(a).cast("double"), F.lit(0.5)).over(five).alias(f"__{k}") for k, a in zip("xyz", s.activity)])
        x = x.withColumn("__z_angle", F.avg(z_angle(F.col("__x"), F.col("__y"), F.col("__z"))).over(five)).drop("__x", "__y", "__z", "__t")
        cols.append("__z_angle")
    n = max(1, round(5 * s.per_minute))
    still = []
    for i, c in enumerate(cols):
        frame = w.rowsBetween(-(n - 1), 0)
        x = x.withColumn("__d", F.abs(F.col(c).cast("double") - F.lag(F.col(c).cast("double")).over(w)))
        full = F.count("__d").over(frame) == n
        x = x.withColumn("__m", F.coalesce(F.when(full, F.percentile("__d", F.lit(0.5)).over(frame)), F.lit(0.0)))
        x = _bin_quantile(x, F.col("__m"), s, start_hour, quantile, "__q")
        x = long_runs(x.withColumn("__calm", F.col("__m") - F.col("__q") * factor <= 0), "__calm", round(min_minutes * s.per_minute), s, out=f"__c{i}").drop("__d", "__m", "__q", "__calm")
        still.append(F.col(f"__c{i}"))
    x = x.withColumn("__cand", functools.reduce((lambda a, b: a | b) if operator == "or" else (lambda a, b: a & b), still))
    x = merge_tolerance(x, "__cand", merge_minutes, s)
    return _pick(x, "__cand", s, start_hour, only_largest, out).select(*[c for c in df.columns if c != out], out)


def detect(df: DataFrame, strategy: str, s: EpochSchema, **kwargs) -> DataFrame:
    """Dispatch by name: ``annotation``, ``hr``, ``angle`` (also ``adapted_van_hees``)."""
    known = {"annotation": by_annotation, "hr": by_heart_rate, "angle": by_angle, "adapted_van_hees": by_angle}
    if strategy.lower() not in known:
        raise ValueError(f"unknown strategy {strategy!r}")
    return known[strategy.lower()](df, s, **kwargs)


def evaluate_boundaries(df: DataFrame, truth: str, others: list[str], s: EpochSchema) -> DataFrame:
    """(pid, day) of the ground truth with onset, offset and minutes asleep of every label, and per participant the mean
    squared error and kappa of every pair; days without ground-truth sleep are left out."""
    labels = [truth, *others]
    s.need(df, *labels)
    asleep = {c: F.when(F.col(c).cast("int") == 1, F.col(s.time)) for c in labels}
    per_day = df.groupBy(s.pid, s.day).agg(
        *[f(v).alias(f"{n}_{c}") for c, v in asleep.items() for n, f in (("onset", F.min), ("offset", F.max))],
        *[(F.sum(F.coalesce(F.col(c).cast("int"), F.lit(0))) / F.lit(s.per_minute)).alias(f"tst_{c}") for c in labels],
    )
    aggs = []
    for a, b in itertools.combinations(labels, 2):
        cols = agreement_columns(F.col(a).cast("int"), F.col(b).cast("int"))
        aggs += [cols[6].alias(f"mse_{a}_{b}"), cols[5].alias(f"kappa_{a}_{b}")]
    return per_day.where(F.col(f"onset_{truth}").isNotNull()).join(df.groupBy(s.pid).agg(*aggs), s.pid)
