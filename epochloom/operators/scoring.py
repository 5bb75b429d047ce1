"""Sleep/wake scores: filters over neighbouring epochs. 1 is sleep, 0 is wake."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from epochloom.schema import EpochSchema

#: Fixed coefficients of the published linear filters by offset in epochs.
SCRIPPS = {-10: 0.0064, -9: 0.0074, -8: 0.0112, -7: 0.0112, -6: 0.0118, -5: 0.0118, -4: 0.0128, -3: 0.0188, -2: 0.0280, -1: 0.0664, 0: 0.0300, 1: 0.0112, 2: 0.0100}
OAKLEY = {-4: 0.08, -3: 0.08, -2: 0.40, -1: 0.20, 0: 2.0, 1: 0.20}
OAKLEY_SYMMETRIC = {-4: 0.04, -3: 0.04, -2: 0.20, -1: 0.20, 0: 2.0, 1: 0.20, 2: 0.20, 3: 0.04, 4: 0.04}
COLE_KRIPKE = {-4: 404, -3: 598, -2: 326, -1: 441, 0: 1408, 1: 508, 2: 350}
SAZONOV = (0.256, 0.154, 0.136, 0.140, 0.176)


def _linear(a: Column, w: WindowSpec, weights: dict[int, float]) -> Column:
    a, total = F.coalesce(a, F.lit(0.0)), None
    for k, c in weights.items():
        term = F.lit(c) * (a if k == 0 else F.lag(a, -k, 0.0).over(w) if k < 0 else F.lead(a, k, 0.0).over(w))
        total = term if total is None else total + term
    return total


def scripps(a: Column, w: WindowSpec, scaler: float = 0.204) -> Column:
    return (F.lit(scaler) * _linear(a, w, SCRIPPS) < 1).cast("int")


def oakley(a: Column, w: WindowSpec, threshold: float = 10.0, symmetric: bool = False) -> Column:
    return (_linear(a, w, OAKLEY_SYMMETRIC if symmetric else OAKLEY) <= threshold).cast("int")


def cole_kripke(a: Column, w: WindowSpec) -> Column:
    return (F.lit(0.00001) * _linear(a, w, COLE_KRIPKE) < 1).cast("int")


def sadeh(a: Column, w: WindowSpec, min_threshold: float = 0.0, min_nat: float = 50, max_nat: float = 100, past: int = 6, nat: int = 11, centred: int = 11) -> Column:
    """Activity within ``min_nat`` and ``max_nat``, mean, spread of the past and the present count; the first epoch is wake."""
    a = F.coalesce(a, F.lit(0.0))
    around = lambda n: w.rowsBetween(-(n // 2), n - 1 - n // 2)
    mean, spread = F.avg(a).over(around(centred)), F.stddev_samp(a).over(w.rowsBetween(-(past - 1), 0))
    count = F.sum(F.when(a.between(min_nat, max_nat), 1).otherwise(0)).over(around(nat))
    score = 7.601 - 0.065 * mean - 0.056 * spread - 0.0703 * F.log(a + 1) - 1.08 * count
    return F.coalesce((score > min_threshold).cast("int"), F.lit(0))


def sazonov(a: Column, w: WindowSpec) -> Column:
    """From the maxima of the last one to five epochs."""
    a, score = F.coalesce(a, F.lit(0.0)), F.lit(1.727)
    for k, c in enumerate(SAZONOV):
        score = score - F.lit(c) * F.max(a).over(w.rowsBetween(-k, 0))
    return (score >= 0.5).cast("int")


#: Names by which an algorithm may be asked for, lower case.
ALGORITHMS: dict[str, Callable[..., Column]] = {
    "scrippsclinic": scripps, "sadeh": sadeh, "oakley": oakley, "cole-kripke": cole_kripke, "colekripke": cole_kripke, "sazonov": sazonov, "saznov": sazonov,
}


def rescore(df: DataFrame, label: str, s: EpochSchema, *, rules: str = "abcde", out: str) -> DataFrame:
    """Webster's rescoring of sleep after long wake, rule by rule on the result of the one before; edges become wake.

    a: some of the last 4 epochs sleep; b, c: some of the last 10 (15) epochs, seen from this and the 2 (3) epochs before;
    d, e: some of 10 (20) epochs at distance 6-15 (10-29) on both sides.
    """
    w = s.window()
    unknown = set(rules.lower()) - set("abcde")
    if unknown:
        raise ValueError(f"unknown rules {sorted(unknown)}")
    df, prev = df.withColumn(out, F.col(label).cast("int")), F.col(out)

    def some(lo: int, hi: int) -> Column:
        return F.coalesce(F.sum(prev).over(w.rowsBetween(lo, hi)) > 0, F.lit(False))  # no epoch there: wake

    for rule in "abcde":
        if rule not in rules.lower():
            continue
        conditions = {
            "a": [(-4, -1)], "b": [(-10 - k, -1 - k) for k in range(3)], "c": [(-15 - k, -1 - k) for k in range(4)],
            "d": [(-15, -6), (6, 15)], "e": [(-29, -10), (10, 29)],
        }[rule]
        keep = None
        for lo, hi in conditions:
            keep = some(lo, hi) if keep is None else keep & some(lo, hi)
        df = df.withColumn("__next", F.when(keep, prev).otherwise(0)).drop(out).withColumnRenamed("__next", out)
    return df


def score(df: DataFrame, algorithm: str, s: EpochSchema, *, activity: str | None = None, rescoring: bool = False, rules: str = "abcde", **kwargs) -> DataFrame:
    """Add one score, named as asked for; ``rescoring`` also adds ``Rescored<name>``."""
    fn = ALGORITHMS.get(algorithm.lower())
    if fn is None:
        raise ValueError(f"unknown algorithm {algorithm!r}")
    a = activity or s.activity[0]
    if a not in df.columns:
        raise ValueError(f"no activity column {a!r}")
    out = df.withColumn(algorithm, fn(F.col(a).cast("double"), s.window(), **kwargs))
    return rescore(out, algorithm, s, rules=rules, out=f"Rescored{algorithm}") if rescoring else out


def score_all(df: DataFrame, s: EpochSchema, *, rescoring: bool = False, rules: str = "abcde") -> DataFrame:
    """All five scores in one projection, so they share one exchange and one sort."""
    w, a = s.window(), F.col(s.activity[0]).cast("double")
    names = {"ScrippsClinic": scripps, "Sadeh": sadeh, "Oakley": oakley, "Cole-Kripke": cole_kripke, "Sazonov": sazonov}
    out = df.select("*", *[f(a, w).alias(n) for n, f in names.items()])
    for n in names if rescoring else ():
        out = rescore(out, n, s, rules=rules, out=f"Rescored{n}")
    return out


