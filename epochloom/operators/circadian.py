"""Circadian rhythm: cosinor fit, singular-spectrum analysis, entropy. The first two need grouped Python functions."""

from __future__ import annotations

from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from epochloom.schema import EpochSchema


def cosinor(df: DataFrame, column: str, s: EpochSchema, *, components: int = 2, period_h: float = 24.0) -> DataFrame:
    """(pid, day, ``mesor``, ``amplitude``, ``acrophase``, ``r2``, ``n``) of a least-squares fit of cosines per day.

    Mesor is the fitted mean level, amplitude half the range of the fitted curve, acrophase the hour of its maximum. Days
    with fewer values than parameters have nulls. Sums of products are taken by Spark, so only the normal equations of a
    day, not its epochs, reach Python.
    """
    p = 2 * components + 1
    t = s.seconds(df) / 3600.0
    x = [F.lit(1.0)]
    for k in range(1, components + 1):
        turn = 2 * np.pi * k * t / period_h
        x += [F.cos(turn), F.sin(turn)]
    y = F.col(column).cast("double")
    rows = df.where(y.isNotNull()).select(s.pid, s.day, y.alias("__y"), *[c.alias(f"__x{i}") for i, c in enumerate(x)])
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    sums = rows.groupBy(s.pid, s.day).agg(
        F.count("*").alias("n"), F.sum(F.col("__y") * F.col("__y")).alias("yy"), *[F.sum(F.col(f"__x{i}") * F.col(f"__x{j}")).alias(f"a{i}_{j}") for i, j in pairs],
        *[F.sum(F.col(f"__x{i}") * F.col("__y")).alias(f"b{i}") for i in range(p)],
    )
    hours = np.arange(0, period_h, 1 / 60)
    curve = np.column_stack([np.ones_like(hours), *[f(2 * np.pi * k * hours / period_h) for k in range(1, components + 1) for f in (np.cos, np.sin)]])

    def solve(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                a = np.zeros((p, p))
                for i, j in pairs:
                    a[i, j] = a[j, i] = getattr(r, f"a{i}_{j}")
                b = np.array([getattr(r, f"b{i}") for i in range(p)])
                if r.n < p or np.linalg.matrix_rank(a) < p:
                    out.append((None, None, None, None))
                    continue
                beta = np.linalg.solve(a, b)
                fit = curve @ beta
                total = r.yy - b[0] ** 2 / r.n
                rest = r.yy - beta @ b
                out.append((float(beta[0]), float((fit.max() - fit.min()) / 2), float(hours[fit.argmax()]), float(1 - rest / total) if total > 1e-12 else None))
            cols = pd.DataFrame(out, columns=["mesor", "amplitude", "acrophase", "r2"], dtype=object)
            yield pd.concat([pdf[[s.pid, s.day]].reset_index(drop=True), cols, pdf[["n"]].reset_index(drop=True)], axis=1)

    types = dict(sums.dtypes)
    return sums.mapInPandas(solve, f"{s.pid} {types[s.pid]}, {s.day} {types[s.day]}, mesor double, amplitude double, acrophase double, r2 double, n bigint")


def cosinor_single(df: DataFrame, column: str, s: EpochSchema, *, period_h: float = 24.0) -> DataFrame:
    """(pid, day, ``mesor``, ``b_cos``, ``b_sin``, ``amplitude``) of one cosine, in closed form as an aggregation."""
    turn = 2 * np.pi * (s.seconds(df) / 3600.0) / period_h
    y = F.col(column).cast("double")
    rows = df.where(y.isNotNull()).select(s.pid, s.day, y.alias("y"), F.cos(turn).alias("c"), F.sin(turn).alias("z"))
    g = rows.groupBy(s.pid, s.day).agg(
        F.count("*").cast("double").alias("n"), F.avg("y").alias("my"), F.avg("c").alias("mc"), F.avg("z").alias("mz"), F.covar_pop("c", "y").alias("cy"), F.covar_pop("z", "y").alias("zy"),
        F.var_pop("c").alias("cc"), F.var_pop("z").alias("zz"), F.covar_pop("c", "z").alias("cz"),
    )
    det = F.col("cc") * F.col("zz") - F.col("cz") * F.col("cz")
    safe = F.when((F.col("n") >= 3) & (det > 1e-9), det)
    g = g.select("*", ((F.col("cy") * F.col("zz") - F.col("zy") * F.col("cz")) / safe).alias("b_cos"), ((F.col("zy") * F.col("cc") - F.col("cy") * F.col("cz")) / safe).alias("b_sin"))
    return g.select(s.pid, s.day, (F.col("my") - F.col("b_cos") * F.col("mc") - F.col("b_sin") * F.col("mz")).alias("mesor"), "b_cos", "b_sin", F.sqrt(F.col("b_cos") ** 2 + F.col("b_sin") ** 2).alias("amplitude"))


def ssa_components(y: np.ndarray, length: int, keep: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """Leading components of a series by singular-spectrum analysis (one a row) and their shares of variance.

    The trajectory matrix is never built: its products are correlations of the series, so memory is linear in the series.
    """
    n = len(y)
    k = n - length + 1
    # entry (i + 1, j + 1) of the matrix times its transpose is entry (i, j), less the products that leave, plus those that enter
    gram = np.zeros((length, length))
    gram[0] = np.correlate(y, y[:k], "valid")
    for i in range(length - 1):
        gram[i + 1, i + 1 :] = gram[i, i:-1] + y[k + i] * y[k + i : n] - y[i] * y[i : length - 1]
    values, vectors = np.linalg.eigh(gram, UPLO="U")
    order = np.argsort(values)[::-1][:keep]
    at = np.arange(n)
    ones = np.minimum(np.minimum(at + 1, n - at), min(length, n - length + 1)).astype(float)
    out = np.zeros((len(order), n))
    for r, k in enumerate(order):
        u = vectors[:, k]
        v = np.correlate(y, u, "valid")
        out[r] = np.convolve(u, v) / ones
    total = values.sum()
    return out, values[order] / total if total > 0 else np.zeros(len(order))


def w_correlation(parts: np.ndarray, length: int) -> np.ndarray:
    """Weighted correlation of components."""
    n = parts.shape[1]
    at = np.arange(n)
    w = np.minimum(np.minimum(at + 1, n - at), min(length, n - length + 1)).astype(float)
    g = (parts * w) @ parts.T
    d = np.sqrt(np.maximum(np.diag(g), 1e-300))
    return g / np.outer(d, d)


def _resampled(df: DataFrame, column: str, s: EpochSchema, step_s: int) -> DataFrame:
    """(pid, ``k``, ``v``): mean of every step with epochs."""
    return df.select(s.pid, F.floor(s.seconds(df) / step_s).alias("k"), F.col(column).cast("double").alias("v")).groupBy(s.pid, "k").agg(F.avg("v").alias("v"))


def _whole(pdf: pd.DataFrame) -> tuple[int, np.ndarray]:
    """First step and series of a participant, missing steps as the mean; empty if there is too little to decompose."""
    pdf = pdf.sort_values("k")
    k = pdf["k"].to_numpy()
    y = np.full(int(k[-1] - k[0]) + 1, np.nan)
    y[k - k[0]] = pdf["v"].to_numpy(dtype=float)
    if np.isnan(y).all() or len(y) < 8:
        return int(k[0]), np.zeros(0)
    return int(k[0]), np.where(np.isnan(y), np.nanmean(y), y)


def ssa_matrix(df: DataFrame, column: str, s: EpochSchema, *, step_s: int = 60, window: int = 1440, keep: int = 20) -> DataFrame:
    """(pid, ``shares``, ``w_correlation``): partial variances of the ``keep`` leading components of a participant's whole
    series, as :func:`ssa` decomposes it, and the matrix of their weighted correlations, a row a component.
    """
    kind = dict(df.dtypes)[s.pid]

    def run(key: tuple[Any, ...], pdf: pd.DataFrame) -> pd.DataFrame:
        _, y = _whole(pdf)
        names = ["pid", "shares", "w_correlation"]
        if not len(y):
            return pd.DataFrame(columns=names)
        length = min(window, len(y) // 2)
        parts, shares = ssa_components(y, length, keep)
        return pd.DataFrame([(key[0], shares.tolist(), w_correlation(parts, length).tolist())], columns=names)

    out = _resampled(df, column, s, step_s).groupBy(s.pid).applyInPandas(run, f"pid {kind}, shares array<double>, w_correlation array<array<double>>")
    return out.withColumnRenamed("pid", s.pid)


def ssa(df: DataFrame, column: str, s: EpochSchema, *, step_s: int = 60, window: int = 1440) -> DataFrame:
    """(pid, date, ``acrophase``, ``trend``, ``period_min``, ``share``) of a singular-spectrum analysis per participant.

    The series is resampled to ``step_s`` by Spark first (means; missing steps take the mean). Acrophase is the time between
    06:00 and 23:00 where the sum of the two leading components is largest, trend the day's mean of the first, period the
    minutes since the day before's acrophase, share the variance of the two. A participant's whole series is
    decomposed at once, in memory linear in its span: one task per participant.
    """
    grid = _resampled(df, column, s, step_s)
    kind = dict(df.dtypes)[s.pid]

    def run(key: tuple[Any, ...], pdf: pd.DataFrame) -> pd.DataFrame:
        first, y = _whole(pdf)
        names = ["pid", "date", "acrophase", "trend", "share"]
        if not len(y):
            return pd.DataFrame(columns=names)
        length = min(window, len(y) // 2)
        parts, shares = ssa_components(y, length, 2)
        at = (np.arange(len(y)) + first) * step_s
        date, clock = at // 86_400, at % 86_400
        trend = pd.Series(parts[0]).groupby(date).mean()
        day = (clock >= 6 * 3600) & (clock <= 23 * 3600)
        top = pd.Series(parts.sum(axis=0)[day], index=at[day]).groupby(date[day]).idxmax()
        when = lambda x: None if x is None else pd.Timestamp(int(x), unit="s")
        return pd.DataFrame([(key[0], when(d * 86_400).date(), when(top.get(d)), float(v), float(shares.sum())) for d, v in trend.items()], columns=names)

    out = grid.groupBy(s.pid).applyInPandas(run, f"pid {kind}, date date, acrophase timestamp_ntz, trend double, share double")
    at = EpochSchema(time="acrophase").seconds(out)
    since = at - F.lag(at).over(Window.partitionBy("pid").orderBy("date"))
    return out.select(F.col("pid").alias(s.pid), "date", "acrophase", "trend", (since / 60.0).alias("period_min"), "share")


def entropy(df: DataFrame, column: str, s: EpochSchema, *, bins: int = 20, by: tuple[str, ...] = ()) -> DataFrame:
    """(pid[, by], ``entropy``): natural-log entropy of the histogram of equally wide bins between minimum and maximum."""
    keys = [s.pid, *by]
    v = F.col(column).cast("double")
    rows = df.where(v.isNotNull()).select(*keys, v.alias("v"))
    w = Window.partitionBy(*keys)
    rows = rows.select(*keys, "v", F.min("v").over(w).alias("lo"), F.max("v").over(w).alias("hi"))
    b = F.when(F.col("hi") == F.col("lo"), 0).otherwise(F.least(F.floor((F.col("v") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)) * bins), F.lit(bins - 1)))
    counts = rows.groupBy(*keys, b.alias("b")).agg(F.count("*").cast("double").alias("n"))
    p = F.col("n") / F.sum("n").over(w)
    return counts.select(*keys, (-p * F.log(p)).alias("h")).groupBy(*keys).agg(F.sum("h").alias("entropy"))

