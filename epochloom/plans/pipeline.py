"""The feature pipeline: per-day, per-hour and per-participant tables from validated epochs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epochloom.operators import activity, boundaries, circadian, days, features, islands, metrics, validate
from epochloom.runtime import spill
from epochloom.schema import EpochSchema


def feature_tables(
    epochs: DataFrame, s: EpochSchema, cuts: activity.Cutoffs, *, label: str, lengths: tuple[float, ...] = (10, 20, 30), merge_minutes: float = 120, min_sleep: float = 0, people: DataFrame | None = None,
    people_pid: str = "pid",
) -> tuple[dict[str, DataFrame], dict[str, list[str]]]:
    """(``per_day``, ``per_hour``, ``per_pid``) and the names of the features of each family.

    The annotation gives sleep periods; days are wake and sleep runs from then on. Days with less sleep than
    ``min_sleep`` minutes are left out. The validated epochs are written once; the tables are lazy and read them.
    """
    value = s.activity[0]
    x = boundaries.by_annotation(epochs, s, merge_minutes=merge_minutes, only_largest=False)
    x, s = islands.day_night_sequence(x, "hyp_sleep_period", s)
    x = validate.remove_flagged_days(validate.flag_day_short_sleep(validate.init(x, s), s, "hyp_sleep_period", min_sleep), s)
    x = spill(activity.pa_levels(x, cuts, value))
    key = [s.pid, s.day]
    bouts = activity.bout_table(x, list(cuts.names), list(lengths), s, sleep="hyp_sleep_period")
    bins = activity.binned(x, cuts, value, s, resolution="day")
    stats = activity.stats(x, value, s, resolution="day")
    sleep = None
    for name in ("sleepEfficiency", "awakening", "totalSleepTime"):
        one = metrics.sleep_quality(x, name, label, s, period="hyp_sleep_period").select(*key, name)
        sleep = one if sleep is None else sleep.join(one, key)
    rhythm = circadian.cosinor(x, value, s).select(*key, "mesor", "amplitude", "acrophase")
    calendar = days.is_weekend(x, s)
    raw = activity.raw_day(x, value, s)
    per_day = features.join_features([bouts, bins, stats, sleep, rhythm, calendar, raw], key, ["", "_bins", "_stats", "_sleep", "_rhythm", "_calendar", "_raw"])
    hour = [*key, "hour"]
    per_hour = features.join_features([activity.bout_table(x, list(cuts.names), list(lengths), s, resolution="hour"), activity.binned(x, cuts, value, s), activity.stats(x, value, s)], hour, ["_bouts", "_bins", "_stats"])
    per_pid = x.groupBy(s.pid).agg(F.count_distinct(s.day).alias("n_days"), F.count("*").alias("n_epochs"))
    if people is not None:
        per_pid = per_pid.join(people.withColumnRenamed(people_pid, s.pid), s.pid, "left")
    names = {
        "bouts": [c for c in bouts.columns if c not in key], "bins": [c for c in bins.columns if c not in key], "stats": [c for c in stats.columns if c not in key],
        "sleep": ["sleepEfficiency", "awakening", "totalSleepTime"], "rhythm": ["mesor", "amplitude", "acrophase"], "calendar": ["hyp_weekday", "hyp_is_weekend"], "raw": ["raw_pa"],
    }
    return {"per_day": per_day, "per_hour": per_hour, "per_pid": per_pid}, names
