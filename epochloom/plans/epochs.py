"""Queries of the epoch operators, over two epoch views of ``events`` and over the wearable tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epochloom.operators import activity, blocks, boundaries, circadian, days, features, islands, joins, metrics, nonwear, scoring, sweep, validate, views
from epochloom.plans.pipeline import feature_tables
from epochloom.runtime import table
from epochloom.schema import MESA, EpochSchema, SourceConfig
from epochloom.sources import readers

S = EpochSchema(row="hyp_row", hr="hr", freq_s=3600, annotation="ann")
CUTS = activity.Cutoffs((40.0, 120.0, 250.0), ("sed", "light", "mod", "vig"))


def dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One event as one hourly epoch, users as participants."""
    e = table(spark, sf_dir, "events")
    w = EpochSchema(pid="user_id", time="ts", row="event_id").window()
    x = e.select("user_id", "event_type", "value", F.row_number().over(w).alias("rn"))
    x = x.select(
        F.col("user_id").cast("string").alias("pid"), F.col("rn").alias("hyp_row"), F.expr("timestamp_ntz'2024-01-01 09:00:00' + make_dt_interval(0, rn - 1)").alias("hyp_time_col"),
        F.col("value").alias("hyp_act_x"), (F.col("value") + 40).alias("hr"), F.col("event_type").isin("view", "signup").alias("ann"), F.col("event_type").isin("view", "click").alias("gt"),
        (F.col("value") < 60).alias("calm"),
    )
    return days.with_day(x, S)


DENSE = """
e0 as (select *, row_number() over (partition by user_id order by ts, event_id) as rn from events),
d0 as (select user_id::varchar as pid, rn::int as hyp_row, timestamp '2024-01-01 09:00:00' + to_hours((rn - 1)::int) as t, value as a, value + 40 as hr,
  event_type in ('view', 'signup') as ann, event_type in ('view', 'click') as gt, value < 60 as calm from e0),
d as (select *, date_diff('day', date '2024-01-01', t::date)::int as day, epoch(t)::bigint as s from d0)
"""
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def _query(sql: str | None = None, base: bool = True):
    """Register a function under its name; ``sql`` continues the common view ``d``."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = f"with {DENSE}{sql}" if base else sql
        return f

    return add


def _i(c: str, name: str | None = None):
    return F.col(c).cast("int").alias(name or c)


@_query("select pid, hyp_row, date_diff('day', date '2024-01-01', (t - interval 15 hour)::date)::int as day15 from d")
def exp_day(spark: SparkSession, sf: str) -> DataFrame:
    return days.with_day(dense(spark, sf), S, 15, out="day15").select("pid", "hyp_row", "day15")


_RUN = """, f as (select *, case when ann is distinct from lag(ann) over (partition by pid order by t) then 1 else 0 end as nw from d),
r as (select *, (sum(nw) over (partition by pid order by t rows unbounded preceding) - 1)::int as seq from f)"""


@_query(_RUN + " select pid, hyp_row, seq, count(*) over (partition by pid, seq)::int as len from r")
def run_lengths(spark: SparkSession, sf: str) -> DataFrame:
    return islands.run_lengths(dense(spark, sf), "ann", S, length="len", seq="seq").select("pid", "hyp_row", "seq", "len")


_MERGE = """, m0 as (select *, max(case when ann then s end) over (partition by pid order by t rows unbounded preceding) as p,
  min(case when ann then s end) over (partition by pid order by t rows between current row and unbounded following) as n from d),
m as (select *, ann or coalesce(n - p <= 3 * 3600, false) as merged from m0)"""


@_query(_MERGE + " select pid, hyp_row, merged::int as merged from m")
def merge_tolerance(spark: SparkSession, sf: str) -> DataFrame:
    return islands.merge_tolerance(dense(spark, sf), "ann", 180, S, out="merged").select("pid", "hyp_row", _i("merged"))


def _largest(flag: str, part: str, src: str) -> str:
    """SQL: the first longest run of ``flag`` in each group of ``part``."""
    return f""", lf as (select *, case when {flag} is distinct from lag({flag}) over (partition by pid, {part} order by t) then 1 else 0 end as lnw from {src}),
lr as (select *, sum(lnw) over (partition by pid, {part} order by t rows unbounded preceding) as lseq from lf),
ll as (select *, count(*) over (partition by pid, {part}, lseq) as llen from lr),
lb as (select *, max(case when {flag} then llen * 100000 - lseq end) over (partition by pid, {part}) as best from ll),
lx as (select *, coalesce({flag} and llen * 100000 - lseq = best, false) as largest from lb)"""


@_query(_largest("ann", "day", "d") + " select pid, hyp_row, largest::int as largest from lx")
def largest_run(spark: SparkSession, sf: str) -> DataFrame:
    return islands.largest_run(dense(spark, sf), "ann", S, by=(S.day,), out="largest").select("pid", "hyp_row", _i("largest"))


@_query(_RUN + ", n as (select *, first_value(ann) over (partition by pid order by t) as f0 from r) select pid, hyp_row, floor((seq - f0::int) / 2.0)::int as ml_sequence from n")
def day_night_sequence(spark: SparkSession, sf: str) -> DataFrame:
    x, s = islands.day_night_sequence(dense(spark, sf), "ann", S)
    return x.select("pid", "hyp_row", s.day)


def _lin(weights: dict) -> str:
    part = lambda k: "a" if k == 0 else f"lag(a, {-k}, 0) over w" if k < 0 else f"lead(a, {k}, 0) over w"
    return " + ".join(f"{c} * {part(k)}" for k, c in weights.items())


_W = " window w as (partition by pid order by t)"


@_query(f" select pid, hyp_row, (0.204 * ({_lin(scoring.SCRIPPS)}) < 1)::int as ScrippsClinic from d{_W}")
def scripps(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.score(dense(spark, sf), "ScrippsClinic", S).select("pid", "hyp_row", "ScrippsClinic")


@_query(f" select pid, hyp_row, ({_lin(scoring.OAKLEY)} <= 300)::int as Oakley from d{_W}")
def oakley(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.score(dense(spark, sf), "Oakley", S, threshold=300.0).select("pid", "hyp_row", "Oakley")


_CK = f", ck as (select *, (0.00001 * ({_lin(scoring.COLE_KRIPKE)}) < 1)::int as l from d{_W})"


@_query(_CK + " select pid, hyp_row, l as ColeKripke from ck")
def cole_kripke(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.score(dense(spark, sf), "ColeKripke", S).select("pid", "hyp_row", "ColeKripke")


@_query(""" select pid, hyp_row, coalesce((7.601 - 0.065 * avg(a) over (partition by pid order by t rows between 5 preceding and 5 following)
 - 0.056 * stddev_samp(a) over (partition by pid order by t rows between 5 preceding and current row) - 0.0703 * ln(a + 1)
 - 1.08 * sum(case when a between 50 and 100 then 1 else 0 end) over (partition by pid order by t rows between 5 preceding and 5 following) > 0)::int, 0) as Sadeh from d""")
def sadeh(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.score(dense(spark, sf), "Sadeh", S).select("pid", "hyp_row", "Sadeh")


@_query(" select pid, hyp_row, (1.727" + "".join(f" - {c} * max(a) over (partition by pid order by t rows between {k} preceding and current row)" for k, c in enumerate(scoring.SAZONOV)) + " >= 0.5)::int as Sazonov from d")
def sazonov(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.score(dense(spark, sf), "Sazonov", S).select("pid", "hyp_row", "Sazonov")


def _webster(rules: str, start: str = "select pid, hyp_row, t, calm::int as l from d", v: str = "w") -> str:
    frames = {"a": [(-4, -1)], "b": [(-10 - k, -1 - k) for k in range(3)], "c": [(-15 - k, -1 - k) for k in range(4)], "d": [(-15, -6), (6, 15)], "e": [(-29, -10), (10, 29)]}
    side = lambda k: f"{-k} preceding" if k < 0 else f"{k} following"
    sql, src = f", {v}0 as ({start})", f"{v}0"
    for r in rules:
        test = " and ".join(f"coalesce(sum(l) over (partition by pid order by t rows between {side(a)} and {side(b)}) > 0, false)" for a, b in frames[r])
        sql, src = sql + f", {v}_{r} as (select pid, hyp_row, t, case when {test} then l else 0 end as l from {src})", f"{v}_{r}"
    return sql + f" select pid, hyp_row, l::int as rescored from {src}"


def _rescored(rules: str):
    def f(spark: SparkSession, sf: str) -> DataFrame:
        x = dense(spark, sf).withColumn("label", _i("calm"))
        return scoring.rescore(x, "label", S, rules=rules, out="rescored").select("pid", "hyp_row", "rescored")

    f.__name__ = f"webster_{rules}"
    return f


for _rules in ("a", "b", "c", "d", "e", "abcde"):
    _query(_webster(_rules))(_rescored(_rules))


_RAW = f"""select pid, hyp_row, t, (0.204 * ({_lin(scoring.SCRIPPS)}) < 1)::int as ScrippsClinic, ({_lin(scoring.OAKLEY)} <= 10)::int as Oakley, (0.00001 * ({_lin(scoring.COLE_KRIPKE)}) < 1)::int as "Cole-Kripke",
 coalesce((7.601 - 0.065 * avg(a) over (partition by pid order by t rows between 5 preceding and 5 following) - 0.056 * stddev_samp(a) over (partition by pid order by t rows between 5 preceding and current row) - 0.0703 * ln(a + 1)
 - 1.08 * sum(case when a between 50 and 100 then 1 else 0 end) over (partition by pid order by t rows between 5 preceding and 5 following) > 0)::int, 0) as Sadeh,
 (1.727""" + "".join(f" - {c} * max(a) over (partition by pid order by t rows between {k} preceding and current row)" for k, c in enumerate(scoring.SAZONOV)) + f" >= 0.5)::int as Sazonov from d{_W}"
_ALL_SCORES = ", raw as (" + _RAW + ")" + "".join(_webster("abcde", f"select pid, hyp_row, t, {n} as l from raw", v).rsplit(" select pid, hyp_row", 1)[0] for n, v in (("ScrippsClinic", "c"), ("Sadeh", "h"), ("Oakley", "o"), ('"Cole-Kripke"', "k"), ("Sazonov", "z")))


@_query(_ALL_SCORES + """ select raw.* exclude (t), c_e.l::int as RescoredScrippsClinic, h_e.l::int as RescoredSadeh, o_e.l::int as RescoredOakley, k_e.l::int as "RescoredCole-Kripke", z_e.l::int as RescoredSazonov
 from raw join c_e using (pid, hyp_row) join h_e using (pid, hyp_row) join o_e using (pid, hyp_row) join k_e using (pid, hyp_row) join z_e using (pid, hyp_row)""")
def all_scores(spark: SparkSession, sf: str) -> DataFrame:
    names = ["ScrippsClinic", "Sadeh", "Oakley", "Cole-Kripke", "Sazonov"]
    return scoring.score_all(dense(spark, sf), S, rescoring=True).select("pid", "hyp_row", *names, *[f"Rescored{n}" for n in names])


@_query(""" select pid, day as hyp_exp_day, sum(ann::int) * 60.0::double as tst_min, min(case when ann then t end) as onset, max(case when ann then t end) as "offset" from d group by pid, day""")
def tst_onset_offset(spark: SparkSession, sf: str) -> DataFrame:
    x = dense(spark, sf)
    return metrics.total_sleep_time(x, "ann", S).join(metrics.sleep_onset_offset(x, "ann", S), ["pid", S.day])


@_query(""", p as (select pid, count(distinct day) as d, count(*) as e from d group by pid)
select count(*) as n_participants, sum(d)::bigint as total_days, avg(d) as mean_days, round(stddev_pop(d), 6) as std_days, max(d) as max_days, min(d) as min_days,
 sum(e)::bigint as total_epochs, round(avg(e), 6) as mean_epochs, round(stddev_pop(e), 6) as std_epochs, max(e) as max_epochs, min(e) as min_epochs from p""")
def overall_stats(spark: SparkSession, sf: str) -> DataFrame:
    x = metrics.overall_stats(dense(spark, sf), S)
    return x.withColumns({c: F.round(c, 6) for c in ("mean_epochs", "std_days", "std_epochs")})


# awake runs inside the annotated period of each day
_Q = """, q as (select *, not gt as awake from d where ann), dd as (select distinct pid, day from d),
qf as (select *, case when awake is distinct from lag(awake) over w then 1 else 0 end as nw, first_value(awake) over w as f0 from q window w as (partition by pid, day order by t)),
qr as (select *, sum(nw) over (partition by pid, day order by t rows unbounded preceding) - 1 as seq from qf),
ql as (select *, count(*) over (partition by pid, day, seq) as len from qr)"""


@_query(_Q + """, v as (select pid, day, 100.0 * sum(case when not awake or len <= 1 then 1 else 0 end) / count(*) as v from ql group by pid, day)
select dd.pid, dd.day as hyp_exp_day, round(coalesce(v, 0)::double, 6) as se from dd left join v using (pid, day)""")
def sleep_efficiency(spark: SparkSession, sf: str) -> DataFrame:
    x = metrics.sleep_quality(dense(spark, sf), "sleepEfficiency", "gt", S, period="ann", ignore_minutes=60, out="se")
    return x.select("pid", S.day, F.round("se", 6).alias("se"))


@_query(_Q + """, v as (select pid, day, count(distinct case when awake and not (f0 and seq = 0) and len > 0 then seq end) as v,
 sum(case when f0 and seq = 0 then 0 else 1 end) as rest from ql group by pid, day)
select dd.pid, dd.day as hyp_exp_day, coalesce(v, 0)::double as aw, round(coalesce(v / nullif(rest, 0), 0)::double, 6) as aw_per_hour from dd left join v using (pid, day)""")
def awakenings(spark: SparkSession, sf: str) -> DataFrame:
    x = dense(spark, sf)
    a = metrics.sleep_quality(x, "awakenings", "gt", S, period="ann", out="aw").select("pid", S.day, "aw")
    b = metrics.sleep_quality(x, "awakening", "gt", S, period="ann", per_hour=True, out="aw_per_hour").select("pid", S.day, F.round("aw_per_hour", 6).alias("aw_per_hour"))
    return a.join(b, ["pid", S.day])


@_query(""" select pid, day as hyp_exp_day, count(*)::double as tib, sum(gt::int)::double as tst, sum((not gt)::int)::double as twt from d group by pid, day""")
def time_in_bed(spark: SparkSession, sf: str) -> DataFrame:
    x = dense(spark, sf)
    parts = [metrics.sleep_quality(x, m, "gt", S, out=o).select("pid", S.day, o) for m, o in (("totalTimeInBed", "tib"), ("totalSleepTime", "tst"), ("totalWakeTime", "twt"))]
    return parts[0].join(parts[1], ["pid", S.day]).join(parts[2], ["pid", S.day])


@_query(""", k as (select pid, day, gt, row_number() over (partition by pid, day order by t) as k, count(*) over (partition by pid, day) as n from d),
r as (select pid, day, row_number() over (partition by pid order by day) as rk, n from (select distinct pid, day, n from k)),
j as (select a.pid, a.day, sum(case when x.gt = y.gt then 1 else 0 end) as same from r a join r b on a.pid = b.pid and a.rk = b.rk + 1
  join k x on x.pid = a.pid and x.day = a.day join k y on y.pid = b.pid and y.day = b.day and y.k = x.k group by a.pid, a.day)
select a.pid, a.day as hyp_exp_day, case when a.n = b.n then round(100.0 * same / a.n, 6)::double end as sri from r a join r b on a.pid = b.pid and a.rk = b.rk + 1 left join j on j.pid = a.pid and j.day = a.day""")
def sri(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.sleep_quality(dense(spark, sf), "sri", "gt", S, out="sri").select("pid", S.day, F.round("sri", 6).alias("sri"))


@_query(" select pid, hyp_row, (a <= 40)::int as sed, (a > 40)::int as light, (a > 120)::int as mod, (a > 250)::int as vig from d")
def pa_levels(spark: SparkSession, sf: str) -> DataFrame:
    x = activity.pa_levels(dense(spark, sf), CUTS, "hyp_act_x")
    return x.select("pid", "hyp_row", *[_i(n) for n in CUTS.names])


_BOUT = """, b0 as (select *, a > 40 as lvl from d), b1 as (select *, max(case when lvl then s end) over (partition by pid order by t rows unbounded preceding) as p,
 min(case when lvl then s end) over (partition by pid order by t rows between current row and unbounded following) as n from b0),
b2 as (select *, lvl or coalesce(n - p <= 7200, false) as g from b1), b3 as (select *, case when g is distinct from lag(g) over (partition by pid order by t) then 1 else 0 end as nw from b2),
b4 as (select *, sum(nw) over (partition by pid order by t rows unbounded preceding) as seq from b3), b5 as (select *, count(*) over (partition by pid, seq) as len from b4),
b6 as (select *, row_number() over (partition by pid, seq order by t) as k from b5 where g and len >= 3 and not calm)"""


@_query(_BOUT + " select pid, day as hyp_exp_day, count(*) as n_bouts from b6 where k = 1 group by pid, day")
def pa_bouts_day(spark: SparkSession, sf: str) -> DataFrame:
    x = activity.pa_levels(dense(spark, sf), CUTS, "hyp_act_x")
    return activity.bouts(x, "light", 180, S, allowance=120, sleep="calm")


@_query(_BOUT + " select pid, day as hyp_exp_day, hour(t)::int as hour, count(*) as n_bouts from b6 where k = 1 group by all")
def pa_bouts_hour(spark: SparkSession, sf: str) -> DataFrame:
    x = activity.pa_levels(dense(spark, sf), CUTS, "hyp_act_x")
    return activity.bouts(x, "light", 180, S, allowance=120, sleep="calm", resolution="hour")


_BINS = "sum((a <= 40)::int)::bigint as sed, sum((a between 40 and 120)::int)::bigint as light, sum((a between 120 and 250)::int)::bigint as mod, sum((a > 250)::int)::bigint as vig"


@_query(f" select pid, day as hyp_exp_day, hour(t)::int as hour, {_BINS} from d group by all")
def pa_bins(spark: SparkSession, sf: str) -> DataFrame:
    return activity.binned(dense(spark, sf), CUTS, "hyp_act_x", S)


@_query(""" select pid, day as hyp_exp_day, round(avg(a), 6) as mean, round(median(a), 6) as median, round(stddev_samp(a), 6) as std, min(a) as min, max(a) as max,
 round(case when count(*) >= 3 then skewness(a) end, 5) as skew, round(case when count(*) >= 4 then kurtosis(a) end, 5) as kurt, count(distinct a) as nunique from d group by pid, day""")
def pa_stats(spark: SparkSession, sf: str) -> DataFrame:
    x = activity.stats(dense(spark, sf), "hyp_act_x", S, resolution="day")
    return x.withColumns({c: F.round(c, 6) for c in ("mean", "median", "std")} | {c: F.round(c, 5) for c in ("skew", "kurt")})


@_query(" select pid, day as hyp_exp_day, list(a order by t) as raw_pa from d group by pid, day")
def raw_pa_day(spark: SparkSession, sf: str) -> DataFrame:
    return activity.raw_day(dense(spark, sf), "hyp_act_x", S)


@_query(" select pid, day as hyp_exp_day, hour(t)::int as hour, avg(a) as hyp_act_x_00_00 from d group by all")
def raw_pa_hour(spark: SparkSession, sf: str) -> DataFrame:
    return activity.raw_hour(dense(spark, sf), "hyp_act_x", S)


@_query(f", h as (select pid, day, hour(t)::int as hour, {_BINS} from d group by all) select pid, day as hyp_exp_day, " + ", ".join(f"coalesce(sum(light) filter (hour = {h}), 0)::bigint as light_{h:02d}" for h in range(24)) + " from h group by pid, day")
def hour_pivot(spark: SparkSession, sf: str) -> DataFrame:
    return activity.hour_pivot(activity.binned(dense(spark, sf), CUTS, "hyp_act_x", S), ["light"], S)


@_query(f", h as (select pid, day, hour(t)::int as hour, {_BINS} from d group by all), g as (select distinct pid, day, unnest(range(24))::int as hour from h) select pid, day as hyp_exp_day, hour, coalesce(sed, 0) as sed, coalesce(light, 0) as light, coalesce(mod, 0) as mod, coalesce(vig, 0) as vig from g left join h using (pid, day, hour)")
def complete_hours(spark: SparkSession, sf: str) -> DataFrame:
    return activity.complete_hours(activity.binned(dense(spark, sf), CUTS, "hyp_act_x", S), S, dict.fromkeys(CUTS.names, 0))


def _flagged(spark: SparkSession, sf: str) -> DataFrame:
    x = dense(spark, sf).withColumn("wear", F.when(F.col("gt"), 0).otherwise(1)).withColumn("maybe", F.when(F.col("hyp_act_x") < 300, F.col("hyp_act_x")))
    x = validate.flag_epoch_low_activity(validate.init(x, S), S, 20)
    return validate.flag_epoch_nonwearing(validate.flag_epoch_null(x, S, ["maybe"]), S, "wear")


_FLAG = ", fe as (select *, (case when a < 20 then 1 else 0 end) + (case when gt then 2 else 0 end) + (case when a >= 300 then 4 else 0 end) as inv from d)"


@_query(_FLAG + " select pid, hyp_row, inv::int as hyp_invalid from fe")
def flags_epoch(spark: SparkSession, sf: str) -> DataFrame:
    return _flagged(spark, sf).select("pid", "hyp_row", S.invalid)


def _day_flags(spark: SparkSession, sf: str) -> DataFrame:
    x = validate.flag_day_short_sleep(_flagged(spark, sf), S, "ann", 300)
    x = validate.flag_day_max_nonwearing(validate.flag_day_long_sleep(x, S, "ann", 600), S, 900)
    return validate.flag_day_many_invalid(validate.flag_day_few_valid(x, S, 120), S, 1_320)


_DAYS = _FLAG + """, f1 as (select *, inv | (case when 60 * sum(ann::int) over g < 300 then 8 else 0 end) | (case when 60 * sum(ann::int) over g > 600 then 16 else 0 end) as i1 from fe window g as (partition by pid, day)),
f2 as (select *, i1 | (case when 60 * sum(((i1 & 7) != 0)::int) over (partition by pid, day) >= 900 then 64 else 0 end) as i2 from f1),
f3 as (select *, i2 | (case when 60 * sum((i2 = 0)::int) over (partition by pid, day) <= 120 then 128 else 0 end) as i3 from f2),
f4 as (select *, i3 | (case when 60 * sum((i3 != 0)::int) over (partition by pid, day) >= 1320 then 512 else 0 end) as i4 from f3)"""


@_query(_DAYS + " select pid, hyp_row, i4::int as hyp_invalid from f4")
def flags_day(spark: SparkSession, sf: str) -> DataFrame:
    return _day_flags(spark, sf).select("pid", "hyp_row", S.invalid)


@_query(_DAYS + " select pid, day as hyp_exp_day, (not bool_and(i4 != 0))::int as valid from f4 group by pid, day")
def valid_days(spark: SparkSession, sf: str) -> DataFrame:
    return validate.days(_day_flags(spark, sf), S).select("pid", S.day, _i("valid"))


@_query(_FLAG + """, vd as (select pid, day from fe group by pid, day having not bool_and(inv != 0)), i as (select *, day - row_number() over (partition by pid order by day) as isle from vd),
k as (select *, count(*) over (partition by pid, isle) as n from i), z as (select pid, day, isle from k where n >= 2), y as (select pid, day from z qualify isle = min(isle) over (partition by pid))
select fe.pid, hyp_row, (inv | case when y.day is null then 256 else 0 end)::int as hyp_invalid from fe left join y on fe.pid = y.pid and fe.day = y.day""")
def consecutive_days(spark: SparkSession, sf: str) -> DataFrame:
    return validate.flag_day_consecutive(_flagged(spark, sf), S, 2).select("pid", "hyp_row", S.invalid)


@_query(_DAYS + " select pid, count(*) as n from f4 where (pid, day) in (select (pid, day) from f4 group by pid, day having not bool_and(i4 != 0)) group by pid")
def remove_flagged_days(spark: SparkSession, sf: str) -> DataFrame:
    return validate.remove_flagged_days(_day_flags(spark, sf), S).groupBy("pid").agg(F.count("*").alias("n"))


@_query(_DAYS + ", p as (select " + ", ".join(f"bool_and(i4 & {c} = {c})::int as b{c}" for c in (8, 16, 32, 64, 128, 256, 512)) + " from f4 group by pid, day) "
        + " union all ".join(f"select '{n}' as flag, sum(b{c})::bigint as n_days from p" for c, n in ((8, "FLAG_DAY_SHORT_SLEEP"), (16, "FLAG_DAY_LONG_SLEEP"), (32, "FLAG_DAY_WITHOUT_DIARY"), (64, "FLAG_DAY_NON_WEARING"), (128, "FLAG_DAY_NOT_ENOUGH_VALID_EPOCHS"), (256, "FLAG_DAY_NOT_ENOUGH_CONSECUTIVE_DAYS"), (512, "FLAG_DAY_TOO_MANY_INVALID_EPOCHS"))))
def validation_report(spark: SparkSession, sf: str) -> DataFrame:
    return validate.report(_day_flags(spark, sf), S)


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly grid per user between first and last event: sum of values, null without event."""
    e = table(spark, sf_dir, "events")
    e = e.withColumn("sec", EpochSchema(time="ts").seconds(e)).select(F.col("user_id").cast("string").alias("pid"), F.expr("timestamp_ntz'1970-01-01 00:00:00' + make_dt_interval(0, cast(sec div 3600 as int))").alias("h"), "value")
    per = e.groupBy("pid", "h").agg(F.sum("value").alias("hyp_act_x"))
    ends = per.groupBy("pid").agg(F.min("h").alias("a"), F.max("h").alias("b"))
    grid = ends.select("pid", F.explode(F.expr("sequence(a, b, interval 1 hour)")).alias("h"))
    return grid.join(per, ["pid", "h"], "left").withColumnRenamed("h", "hyp_time_col")


_GRID = """with per as (select user_id::varchar as pid, date_trunc('hour', ts) as t, sum(value) as a from events group by all), en as (select pid, min(t) as lo, max(t) as hi from per group by pid),
gr as (select pid, unnest(generate_series(lo, hi, interval 1 hour)) as t from en), g as (select gr.pid, gr.t, a from gr left join per using (pid, t))"""
G = EpochSchema(freq_s=3600)


@_query(_GRID + """, x as (select *, coalesce(a, -0.0001) as v, row_number() over w as rn from g window w as (partition by pid order by t)),
y as (select *, v > 0 and (coalesce(sum((v > 0)::int) over (partition by pid order by t rows between 2 following and 12 following) > 2, false) or coalesce(sum((v > 0)::int) over (partition by pid order by t rows between 12 preceding and 2 preceding) > 2, false)) as inv,
 coalesce(max(case when v <= 0 then rn end) over (partition by pid order by t rows unbounded preceding), 0) as calm from x),
z as (select *, inv or rn - calm >= 1 as e from y), k as (select *, coalesce(sum(e::int) over (partition by pid order by t rows between unbounded preceding and 1 preceding), 0) as grp from z),
m as (select *, min(case when v <= 0 then rn end) over (partition by pid, grp) as a0, max(case when e then rn end) over (partition by pid, grp) as a1 from k)
select pid, t as hyp_time_col, case when coalesce(rn >= a0 and rn < a1 and a1 - a0 >= 10, false) then 0 else 1 end as hyp_wearing from m""", base=False)
def nonwear_choi(spark: SparkSession, sf: str) -> DataFrame:
    return nonwear.detect_nonwear(hourly(spark, sf), G, min_period_minutes=600, spike_minutes=120, window_minutes=720).select("pid", "hyp_time_col", G.wearing)


@_query(" select pid, hyp_row, least(ann::int, gt::int) as both, greatest(ann::int, gt::int, calm::int) as any_of from d")
def nonwear_combine(spark: SparkSession, sf: str) -> DataFrame:
    x = dense(spark, sf).withColumns({c: _i(c) for c in ("ann", "gt", "calm")})
    x = nonwear.combine(nonwear.combine(x, ["ann", "gt"], "both"), ["ann", "gt", "calm"], "any_of", "or")
    return x.select("pid", "hyp_row", "both", "any_of")


def _diary(x: DataFrame) -> DataFrame:
    return x.where("ann").groupBy("pid", S.day).agg(F.min(S.time).alias("sleep_onset"), F.max(S.time).alias("sleep_offset")).select("pid", "sleep_onset", "sleep_offset")


@_query(""", di as (select pid, day, min(t) as t0, max(t) as t1 from d where ann group by pid, day)
select d.pid, hyp_row, bool_or(coalesce(t = t0, false))::int as hyp_diary_onset, bool_or(coalesce(t = t1, false))::int as hyp_diary_offset, bool_or(coalesce(t between t0 and t1, false))::int as hyp_diary_sleep from d left join di on d.pid = di.pid group by all""")
def diary_interval_join(spark: SparkSession, sf: str) -> DataFrame:
    x = dense(spark, sf)
    return joins.add_diary(x, _diary(x), S).select("pid", "hyp_row", _i(S.diary_onset), _i(S.diary_offset), _i(S.diary_sleep))


@_query(""", r as (select pid, t + case when hyp_row % 3 = 0 then interval 30 minute else interval 0 minute end as t, a / 2 as gluc, a as a2 from d where hyp_row % 2 = 0)
select coalesce(d.pid, r.pid) as pid, coalesce(d.t, r.t) as hyp_time_col, d.a as hyp_act_x, r.a2 as hyp_act_x_cgm, r.gluc from d full join r on d.pid = r.pid and d.t = r.t""")
def cgm_outer_join(spark: SparkSession, sf: str) -> DataFrame:
    x = dense(spark, sf)
    r = x.where("hyp_row % 2 = 0").select("pid", F.expr("hyp_time_col + make_dt_interval(0, 0, if(hyp_row % 3 = 0, 30, 0))").alias("hyp_time_col"), (F.col("hyp_act_x") / 2).alias("gluc"), "hyp_act_x")
    return joins.add_readings(x.select("pid", "hyp_time_col", "hyp_act_x"), r, S)


@_query(", p as (select c_custkey::varchar as pid, c_acctbal as age, c_mktsegment as seg from customer) select pid, hyp_row, age, seg from d left join p using (pid)")
def demographics_join(spark: SparkSession, sf: str) -> DataFrame:
    people = table(spark, sf, "customer").select("c_custkey", F.col("c_acctbal").alias("age"), F.col("c_mktsegment").alias("seg"))
    x = dense(spark, sf)
    return joins.add_demographics(x, joins.restrict_demographics(people, x, S, pid="c_custkey"), S, pid="c_custkey").select("pid", "hyp_row", "age", "seg")


@_query(_MERGE + ", m18 as (select *, date_diff('day', date '2024-01-01', (t - interval 18 hour)::date) as d18 from m)" + _largest("merged", "d18", "m18") + " select pid, hyp_row, largest::int as hyp_sleep_period from lx")
def boundary_annotation(spark: SparkSession, sf: str) -> DataFrame:
    return boundaries.detect(dense(spark, sf), "annotation", S, merge_minutes=180).select("pid", "hyp_row", _i("hyp_sleep_period"))


def _quantile_sql(value: str, src: str, hour: int, q: float, out: str) -> str:
    return f""", {out}b as (select *, floor((s - {hour * 3600}) / 86400.0) as {out}bin from {src}), {out}q as (select pid, {out}bin, quantile_cont({value}, {q}) as q0 from {out}b group by pid, {out}bin),
{out}f as (select pid, {out}bin, coalesce(last_value(q0 ignore nulls) over (partition by pid order by {out}bin rows unbounded preceding), first_value(q0 ignore nulls) over (partition by pid order by {out}bin rows between current row and unbounded following)) as {out} from {out}q),
{out}x as (select {out}b.*, {out} from {out}b join {out}f using (pid, {out}bin))"""


_HR = ", h0 as (select *, s % 86400 > 12 * 3600 and s % 86400 < 20 * 3600 as outw, case when not (s % 86400 > 12 * 3600 and s % 86400 < 20 * 3600) then hr end as h from d)" + _quantile_sql("h", "h0", 20, 0.4, "thr") + """,
h1 as (select *, case when h - thr > 0 then 0.0 else 1.0 end as low from thrx), h2 as (select *, sum(low) over r as sm, count(*) over r as cn from h1 window r as (partition by pid order by t rows between 2 preceding and current row)),
h3 as (select *, case when cn = 3 then case when sm * 2 > 3 then 1.0 else 0.0 end end as md0 from h2), h4 as (select *, first_value(md0 ignore nulls) over (partition by pid order by t rows between current row and unbounded following) as md from h3),
h5 as (select *, case when md is distinct from lag(md) over (partition by pid order by t) then 1 else 0 end as nw from h4), h6 as (select *, sum(nw) over (partition by pid order by t rows unbounded preceding) as seq from h5),
h7 as (select *, md = 1.0 and count(*) over (partition by pid, seq) > 2 as c0, case when count(*) over v = 4 then coalesce(stddev_samp(hr) over v, 0) else 0 end as vol, date_diff('day', date '2024-01-01', (t - interval 20 hour)::date) as sd from h6
  window v as (partition by pid order by t rows between 2 preceding and 1 following)),
h8 as (select *, max(case when c0 then s end) over (partition by pid, sd order by t rows unbounded preceding) as p, min(case when c0 then s end) over (partition by pid, sd order by t rows between current row and unbounded following) as n from h7),
h9 as (select *, coalesce(c0, false) or coalesce(n - p <= 240 * 60, false) as c1 from h8), ha as (select *, case when c1 is distinct from lag(c1) over (partition by pid order by t) then 1 else 0 end as nw2 from h9),
hb as (select *, sum(nw2) over (partition by pid order by t rows unbounded preceding) as seq2 from ha), hr0 as (select pid, seq2, min(s) as a0, max(s) as b0 from hb where c1 group by pid, seq2),
hr1 as (select r.pid, r.seq2, least(a0, coalesce(max(case when x.s between a0 - 14400 and a0 + 3600 then x.s end), a0)) as a1, greatest(b0, coalesce(min(case when x.s between b0 - 60 and b0 + 7200 then x.s end), b0)) as b1
  from hr0 r left join hb x on x.pid = r.pid and x.vol > 40 group by r.pid, r.seq2, a0, b0),
hc as (select hb.pid, hyp_row, bool_or(coalesce(hb.s between a1 and b1, false)) as period from hb left join hr1 on hb.pid = hr1.pid group by hb.pid, hyp_row)"""


@_query(_HR + " select pid, hyp_row, period::int as hyp_sleep_period from hc")
def boundary_hr(spark: SparkSession, sf: str) -> DataFrame:
    x = boundaries.detect(dense(spark, sf), "hr", S, quantile=0.4, volatility=40, rolling_minutes=180, min_minutes=120, volatility_minutes=240)
    return x.select("pid", "hyp_row", _i("hyp_sleep_period"))


_ANGLE = ", a0 as (select *, abs(a - lag(a) over (partition by pid order by t)) as df from d), a1 as (select *, coalesce(df, 0.0) as m from a0)" + _quantile_sql("m", "a1", 15, 0.1, "qa") + """,
a2 as (select *, m - qa * 15 <= 0 as calm2 from qax), a3 as (select *, case when calm2 is distinct from lag(calm2) over (partition by pid order by t) then 1 else 0 end as nw from a2),
a4 as (select *, sum(nw) over (partition by pid order by t rows unbounded preceding) as seq from a3), a5 as (select *, calm2 and count(*) over (partition by pid, seq) > 2 as c from a4),
a6 as (select *, max(case when c then s end) over (partition by pid order by t rows unbounded preceding) as p, min(case when c then s end) over (partition by pid order by t rows between current row and unbounded following) as n from a5),
a7 as (select *, c or coalesce(n - p <= 180 * 60, false) as cand, date_diff('day', date '2024-01-01', (t - interval 15 hour)::date) as d15 from a6)""" + _largest("cand", "d15", "a7")


@_query(_ANGLE + " select pid, hyp_row, largest::int as hyp_sleep_period from lx")
def boundary_angle(spark: SparkSession, sf: str) -> DataFrame:
    return boundaries.detect(dense(spark, sf), "angle", S, columns=("hyp_act_x",), min_minutes=120).select("pid", "hyp_row", _i("hyp_sleep_period"))


_AGREE = """round((tp + tn) / n, 6) as accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) as precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) as recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) as f1,
round(case when tp + fn > 0 and fp + tn > 0 then (tp / (tp + fn) + tn / (fp + tn)) / 2 end, 6) as roc_auc, round(((tp + tn) / n - ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / (n * n)) / nullif(1 - ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / (n * n), 0), 6) as kappa, round((fp + fn) / n, 6) as mse"""


@_query(f""", c as (select pid, day, sum((gt and ann)::int)::double as tp, sum((not gt and ann)::int)::double as fp, sum((gt and not ann)::int)::double as fn, sum((not gt and not ann)::int)::double as tn, count(*)::double as n from d group by pid, day)
select pid, day as hyp_exp_day, {_AGREE} from c""")
def agreement_metrics(spark: SparkSession, sf: str) -> DataFrame:
    x = metrics.evaluate_labels(dense(spark, sf), "gt", "ann", S)
    return x.select("pid", S.day, *[F.round(c, 6).alias(c) for c in ("accuracy", "precision", "recall", "f1", "roc_auc", "kappa", "mse")])


@_query(" select pid, round(avg((gt != ann)::int), 6) as mse_gt_ann, round(avg((gt != calm)::int), 6) as mse_gt_calm, round(avg((ann != calm)::int), 6) as mse_ann_calm from d group by pid")
def label_pairs(spark: SparkSession, sf: str) -> DataFrame:
    x = metrics.label_pairs(dense(spark, sf), ["gt", "ann", "calm"], S)
    return x.select("pid", *[F.round(c, 6).alias(c) for c in ("mse_gt_ann", "mse_gt_calm", "mse_ann_calm")])


def _kappa(a: str, b: str) -> str:
    """SQL: agreement of two labels of a participant beyond chance."""
    pe = f"(avg({b}::int) * avg({a}::int) + (1 - avg({a}::int)) * (1 - avg({b}::int)))"
    return f"round((avg(({a} = {b})::int) - {pe}) / nullif(1 - {pe}, 0), 6)"


_PAIRS = (("gt", "ann"), ("gt", "calm"), ("ann", "calm"))


@_query(", q as (select pid, day, " + ", ".join(f"min(case when {c} then t end) as onset_{c}, max(case when {c} then t end) as offset_{c}, sum({c}::int) * 60.0::double as tst_{c}" for c in ("gt", "ann", "calm")) + " from d group by pid, day), p as (select pid, "
        + ", ".join(f"round(avg(({a} != {b})::int), 6) as mse_{a}_{b}, {_kappa(a, b)} as kappa_{a}_{b}" for a, b in _PAIRS) + " from d group by pid) select q.* exclude (day), q.day as hyp_exp_day, p.* exclude (pid) from q join p on q.pid = p.pid where onset_gt is not null")
def boundary_evaluation(spark: SparkSession, sf: str) -> DataFrame:
    x = boundaries.evaluate_boundaries(dense(spark, sf), "gt", ["ann", "calm"], S)
    return x.withColumns({c: F.round(c, 6) for c in x.columns if c.startswith(("mse_", "kappa_"))})


_TST = ", v as (select pid, day, sum(gt::int)::double as g, sum(ann::int)::double as o from d group by pid, day)"


@_query(_TST + " select pid, day as hyp_exp_day, round(case when o > 0 then 100.0 * (g - o) / o else 0 end, 6) as value, 'totalSleepTime' as metric, 'gt' as alg1, 'ann' as alg2 from v")
def metric_compare(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.compare_metric(dense(spark, sf), "totalSleepTime", "gt", ["ann"], S).withColumn("value", F.round("value", 6))


@_query(_TST + " select round(corr(g, o), 6) as value, 'totalSleepTime' as metric, 'gt' as alg1, 'ann' as alg2 from v")
def metric_pearson(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.compare_metric(dense(spark, sf), "totalSleepTime", "gt", ["ann"], S, how="pearson").withColumn("value", F.round("value", 6))


@_query(""", v as (select least(floor(a / 100), 2)::int as x, least(floor(hr / 110), 2)::int as y from d), k as (select unnest([0, 1, 2]) as k),
z as (select k, sum((x = k)::int)::double as t, sum((y = k)::int)::double as p, sum((x = k and y = k)::int)::double as c from k, v group by k)
select round((sum(c) * sum(t) - sum(t * p)) / (sqrt(sum(t) * sum(t) - sum(p * p)) * sqrt(sum(t) * sum(t) - sum(t * t))), 6) as mcc, round(avg(2 * c / (t + p)), 6) as macro_f1, round(sum(c) / sum(t), 6) as micro_f1 from z""")
def class_scores(spark: SparkSession, sf: str) -> DataFrame:
    x = dense(spark, sf).select(F.least(F.floor(F.col("hyp_act_x") / 100), F.lit(2)).alias("x"), F.least(F.floor(F.col("hr") / 110), F.lit(2)).alias("y"))
    return metrics.class_scores(x, "x", "y").select(*[F.round(c, 6).alias(c) for c in ("mcc", "macro_f1", "micro_f1")])


@_query(", v as (select pid, day, (sum(gt::int) + sum(ann::int)) / 2.0 as average, (sum(gt::int) - sum(ann::int))::double as difference from d group by pid, day), m as (select avg(difference) as m, stddev_pop(difference) as s from v) select pid, day as hyp_exp_day, average::double as average, difference, round(m, 6) as mean, round(m - s, 6) as lower, round(m + s, 6) as upper from v, m")
def bland_altman(spark: SparkSession, sf: str) -> DataFrame:
    x = metrics.bland_altman(dense(spark, sf), "gt", "ann", S)
    return x.withColumns({c: F.round(c, 6) for c in ("mean", "lower", "upper")})


@_query(", v as (select pid, day, (isodow(t) - 1)::int as wd, count(*) as n from d group by all), x as (select * from v qualify row_number() over (partition by pid, day order by n desc, wd) = 1) select pid, day as hyp_exp_day, wd as hyp_weekday, (wd in (5, 6))::int as hyp_is_weekend from x")
def weekday_weekend(spark: SparkSession, sf: str) -> DataFrame:
    return days.is_weekend(dense(spark, sf), S).withColumn("hyp_is_weekend", _i("hyp_is_weekend"))


@_query(""" select pid, hyp_row, year(t)::int as t_year, """ + ", ".join(f"round(sin(2 * pi() * {v}), 6) + 0 as t_{n}_sin, round(cos(2 * pi() * {v}), 6) + 0 as t_{n}_cos" for n, v in (("month", "month(t) / 12"), ("day", "day(t) / day(last_day(t))"), ("hour", "hour(t) / 24"), ("minute", "minute(t) / 60"))) + " from d")
def encode_datetime(spark: SparkSession, sf: str) -> DataFrame:
    x = dense(spark, sf).select("pid", "hyp_row", *days.encode_datetime(F.col(S.time), "t"))
    return x.select("pid", "hyp_row", "t_year", *[(F.round(c, 6) + 0).alias(c) for c in x.columns[3:]])


@_query(" select pid, hyp_row, case when hyp_row % 5 = 0 then null else (hyp_row % 24) * 3600 + (hyp_row % 60) * 60 + case when hyp_row % 2 = 0 then hyp_row % 60 else 0 end end::int as clock_s from d")
def clock_to_seconds(spark: SparkSession, sf: str) -> DataFrame:
    r = F.col("hyp_row")
    text = F.when(r % 5 == 0, F.lit("H")).when(r % 2 == 0, F.format_string("%02d:%02d:%02d", r % 24, r % 60, r % 60)).otherwise(F.format_string("%02d:%02d", r % 24, r % 60))
    return dense(spark, sf).select("pid", "hyp_row", days.clock_seconds(text).alias("clock_s"))


@_query(", x as (select pid, s - lag(s) over (partition by pid order by t) as q from d) select pid, case when min(q) = max(q) then min(q) end as freq_s from x group by pid")
def frequency(spark: SparkSession, sf: str) -> DataFrame:
    return days.frequency(dense(spark, sf), S)


_ML = "with x as (select pid, ml_sequence, avg(totalsleeptime) as tst, avg(sleepefficiency) as se, avg(awakening) as aw from ml group by pid, ml_sequence)"


def _daily(spark: SparkSession, sf: str) -> DataFrame:
    aggs = [F.avg(c).alias(n) for c, n in (("totalsleeptime", "tst"), ("sleepefficiency", "se"), ("awakening", "aw"))]
    return table(spark, sf, "ml").groupBy("pid", "ml_sequence").agg(*aggs)


@_query(_ML + """, y as (select *, lag(tst, 1) over w as "tst-1d", lag(tst, 2) over w as "tst-2d", lag(se, 1) over w as "se-1d", lag(se, 2) over w as "se-2d" from x window w as (partition by pid order by ml_sequence))
select pid, ml_sequence, round(tst, 5) as tst, round("tst-1d", 5) as "tst-1d", round("tst-2d", 5) as "tst-2d", round("se-1d", 5) as "se-1d", round("se-2d", 5) as "se-2d" from y where "tst-1d" is not null and "tst-2d" is not null and "se-1d" is not null and "se-2d" is not null""", base=False)
def lag_features(spark: SparkSession, sf: str) -> DataFrame:
    x = features.lag_features(_daily(spark, sf), ["tst", "se"], 2)
    return x.select("pid", "ml_sequence", *[F.round(f"`{c}`", 5).alias(c) for c in ("tst", "tst-1d", "tst-2d", "se-1d", "se-2d")])


@_query(_ML + " select a.pid, a.ml_sequence, round(b.se, 5) as next_se from x a left join x b on a.pid = b.pid and b.ml_sequence = a.ml_sequence + 1", base=False)
def next_day_target(spark: SparkSession, sf: str) -> DataFrame:
    return features.next_day_target(_daily(spark, sf), "se").select("pid", "ml_sequence", F.round("next_se", 5).alias("next_se"))


_AGE = "(row_id % 90)::int"
_GRP = f"case when {_AGE} is null then null " + " ".join(f"when {_AGE} <= {b} then {i}" for i, b in enumerate(features.AGE_GROUPS)) + f" else {len(features.AGE_GROUPS)} end"


def _by_group(expr) -> str:
    return "case g " + " ".join(f"when {i} then {expr(i)}" for i in range(len(features.AGE_GROUPS) + 1)) + " end"


_CLS = f"""with x as (select row_id, {_AGE} as age, {_GRP} as g, awakening as aw, sleepefficiency as se, totalsleeptime / 60 as h from ml),
y as (select row_id, g, case when aw is not null then {_by_group(lambda i: f"case when aw <= {features.AWAKENINGS[i][0]} then 2 when aw <= {features.AWAKENINGS[i][1]} then 1 else 0 end")} end as aw,
case when se is not null then {_by_group(lambda i: f"case when se >= {features.EFFICIENCY[i][0]} then 2 when se >= {features.EFFICIENCY[i][1]} then 1 else 0 end")} end as se,
case when h is not null then {_by_group(lambda i: "case when h between {0} and {1} then 2 when h between {2} and {3} then 1 else 0 end".format(*features.SLEEP_HOURS[i]))} end as h from x)
select row_id, g as age_group, aw, se, h, case when aw + se + h <= 2 then 0 when aw + se + h <= 4 then 1 when aw + se + h is not null then 2 end as combined from y"""


@_query(_CLS, base=False)
def target_classes(spark: SparkSession, sf: str) -> DataFrame:
    x = table(spark, sf, "ml").select("row_id", (F.col("row_id") % 90).cast("int").alias("age"), F.col("awakening").alias("aw"), F.col("sleepefficiency").alias("se"), (F.col("totalsleeptime") / 60).alias("h"))
    x = features.target_classes(x, "age", "combined", awakening="aw", efficiency="se", hours="h", keep_others=True)
    return x.select("row_id", features.age_group(F.col("age")).alias("age_group"), "aw", "se", "h", "combined")


@_query("select row_id, case when fold = 10 then 'test' when fold = 9 then 'validation' when fold is not null then 'train' end as split from ml", base=False)
def fold_split(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "ml").select("row_id", features.split_of_fold(F.col("fold")).alias("split"))


@_query("select row_id, round((mesor - avg(mesor) over ()) / stddev_pop(mesor) over (), 5) as mesor, round((amplitude - avg(amplitude) over ()) / stddev_pop(amplitude) over (), 5) as amplitude from ml", base=False)
def standard_scale(spark: SparkSession, sf: str) -> DataFrame:
    x = features.standard_scale(table(spark, sf, "ml").select("row_id", "mesor", "amplitude"), ["mesor", "amplitude"])
    return x.select("row_id", F.round("mesor", 5).alias("mesor"), F.round("amplitude", 5).alias("amplitude"))


@_query("select row_id, " + ", ".join(f"coalesce((hyp_weekday = {i})::int, 0) as wd_{i}" for i in range(7)) + ", coalesce(fold, -1)::int as fold from ml", base=False)
def one_hot_categories(spark: SparkSession, sf: str) -> DataFrame:
    x = table(spark, sf, "ml").select("row_id", "hyp_weekday", "fold")
    return features.force_categories(features.one_hot(x, "hyp_weekday", list(range(7)), prefix="wd"), ["fold"]).drop("hyp_weekday")


@_query("select pid, ml_sequence, count(*) as n from ml group by all", base=False)
def sequence_lengths(spark: SparkSession, sf: str) -> DataFrame:
    return features.sequence_lengths(table(spark, sf, "ml"))


@_query("select row_id, round(weight / nullif(height * height, 0), 5) as bmi from small_collection_fenland_full", base=False)
def body_mass_index(spark: SparkSession, sf: str) -> DataFrame:
    x = features.body_mass_index(table(spark, sf, "small_collection_fenland_full").select("row_id", "weight", "height"))
    return x.select("row_id", F.round("bmi", 5).alias("bmi"))


@_query("select pid, epoch(time_bucket(interval 15 minute, hyp_time_col))::bigint as bucket_s, round(avg(hyp_sleep_bin), 5) + 0 as hyp_sleep_bin from hyp_epochs group by all", base=False)
def resample_mean(spark: SparkSession, sf: str) -> DataFrame:
    x = views.resample(table(spark, sf, "hyp_epochs").select("pid", "hyp_time_col", "hyp_sleep_bin"), ["hyp_sleep_bin"], EpochSchema(), step_s=900)
    return x.withColumn("hyp_sleep_bin", F.round("hyp_sleep_bin", 5) + 0)


@_query(_GRID + ", x as (select pid, floor(epoch(t) / 21600)::bigint * 21600 as bucket_s, median(a) as a from g group by all) select pid, bucket_s, a as hyp_act_x from x", base=False)
def resample_median(spark: SparkSession, sf: str) -> DataFrame:
    return views.resample(hourly(spark, sf), ["hyp_act_x"], G, step_s=21_600, how="median", grid=True)


@_query(_RUN + " select pid, seq, any_value(ann)::int as value, (min(s) + max(s)) / 2.0::double as mid_s, count(*) as n from r group by pid, seq")
def sequence_midpoints(spark: SparkSession, sf: str) -> DataFrame:
    return views.sequence_midpoints(dense(spark, sf), "ann", S).withColumn("value", _i("value"))


@_query(", v as (select pid, day, sum(gt::int)::double as g, sum(ann::int)::double as o, sum(calm::int)::double as c from d group by pid, day) select 'gt' as alg1, round(avg(case when o > 0 then 100 * (g - o) / o else 0 end), 5) as ann, round(avg(case when c > 0 then 100 * (g - c) / c else 0 end), 5) as calm from v")
def metric_heatmap(spark: SparkSession, sf: str) -> DataFrame:
    x = views.heatmap(metrics.compare_metric(dense(spark, sf), "totalSleepTime", "gt", ["ann", "calm"], S), ["ann", "calm"])
    return x.select("alg1", F.round("ann", 5).alias("ann"), F.round("calm", 5).alias("calm"))


@_query(" select pid, day as hyp_exp_day, i::int as param_id, q::double as quantile, round(t, 6) as threshold from (select pid, day, unnest([0, 1, 2]) as i, unnest([0.2, 0.35, 0.5]) as q, unnest(quantile_cont(hr, [0.2, 0.35, 0.5])) as t from d group by pid, day)")
def param_sweep(spark: SparkSession, sf: str) -> DataFrame:
    return sweep.quantile_sweep(dense(spark, sf), "hr", [0.2, 0.35, 0.5], S).withColumn("threshold", F.round("threshold", 6))


@_query(_MERGE + ", m2 as (select pid, hyp_row, ann or coalesce(n - p <= 2 * 3600, false) as f2, ann or coalesce(n - p <= 5 * 3600, false) as f5 from m0) select pid, hyp_row, f2::int as merged, 0 as param_id from m2 union all select pid, hyp_row, f5::int, 1 from m2")
def operator_sweep(spark: SparkSession, sf: str) -> DataFrame:
    run = lambda df, s, minutes: islands.merge_tolerance(df, "ann", minutes, s, out="merged")
    return sweep.sweep(dense(spark, sf), [{"minutes": 120}, {"minutes": 300}], run, S).select("pid", "hyp_row", _i("merged"), "param_id")


@_query(", x as (select pid, a, min(a) over (partition by pid) as lo, max(a) over (partition by pid) as hi from d), y as (select pid, case when hi = lo then 0 else least(floor((a - lo) / (hi - lo) * 20), 19) end as b, count(*) as n from x group by all), z as (select pid, n / sum(n) over (partition by pid) as p from y) select pid, round(-sum(p * ln(p)), 6) as entropy from z group by pid")
def entropy(spark: SparkSession, sf: str) -> DataFrame:
    return circadian.entropy(dense(spark, sf), "hyp_act_x", S).withColumn("entropy", F.round("entropy", 6))


@_query(""", x as (select pid, day, a as y, cos(2 * pi() * (s / 3600.0) / 24) as c, sin(2 * pi() * (s / 3600.0) / 24) as z from d),
g as (select pid, day, count(*) as n, avg(y) as my, avg(c) as mc, avg(z) as mz, covar_pop(c, y) as cy, covar_pop(z, y) as zy, var_pop(c) as cc, var_pop(z) as zz, covar_pop(c, z) as cz from x group by pid, day),
h as (select *, case when n >= 3 and cc * zz - cz * cz > 1e-9 then cc * zz - cz * cz end as det from g), b as (select *, (cy * zz - zy * cz) / det as bc, (zy * cc - cy * cz) / det as bz from h)
select pid, day as hyp_exp_day, round(my - bc * mc - bz * mz, 3) as mesor, round(sqrt(bc * bc + bz * bz), 3) as amplitude from b""")
def cosinor_single(spark: SparkSession, sf: str) -> DataFrame:
    return circadian.cosinor_single(dense(spark, sf), "hyp_act_x", S).select("pid", S.day, F.round("mesor", 3).alias("mesor"), F.round("amplitude", 3).alias("amplitude"))


@_query()
def cosinor(spark: SparkSession, sf: str) -> DataFrame:
    return circadian.cosinor(dense(spark, sf), "hyp_act_x", S)


@_query()
def ssa(spark: SparkSession, sf: str) -> DataFrame:
    return circadian.ssa(dense(spark, sf), "hyp_act_x", S, step_s=3600, window=24)


@_query()
def ssa_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return circadian.ssa_matrix(table(spark, sf, "hyp_epochs").select("pid", "hyp_time_col", "hyp_sleep_bin"), "hyp_sleep_bin", EpochSchema())


@_query("select pid, hyp_time_col from (select user_id::varchar as pid, ts as hyp_time_col, value from events) order by value desc, hyp_time_col limit 20", base=False)
def top_epochs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").orderBy(F.desc("value"), "ts").limit(20).select(F.col("user_id").cast("string").alias("pid"), F.col("ts").alias("hyp_time_col"))


@_query(_RUN + " select pid, hyp_row, seq, count(*) over (partition by pid, seq)::int as len from r")
def run_lengths_in_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return blocks.run_lengths(dense(spark, sf), "ann", S, length="len", seq="seq", block_s=43_200).select("pid", "hyp_row", "seq", "len")


def _blocked(name: str, op, before: int, after: int, cols: list[str], sql: str):
    def f(spark: SparkSession, sf: str) -> DataFrame:
        x = dense(spark, sf).withColumn("label", _i("calm"))
        return blocks.apply(x, S, op, before=before, after=after, rows=200).select("pid", "hyp_row", *cols)

    f.__name__ = name
    _query(sql)(f)


_blocked("scripps_in_blocks", lambda x, s: scoring.score(x, "ScrippsClinic", s), 10, 2, ["ScrippsClinic"], f" select pid, hyp_row, (0.204 * ({_lin(scoring.SCRIPPS)}) < 1)::int as ScrippsClinic from d{_W}")
_blocked("webster_in_blocks", lambda x, s: scoring.rescore(x, "label", s, out="rescored"), 81, 44, ["rescored"], _webster("abcde"))


_BT = ", ".join(f"coalesce(max(case when what = '{n}' then n end), 0)::bigint as \"{n}\"" for n in ("light_60", "light_180", "mod_60", "mod_180"))


@_query("".join(f""", {v}0 as (select pid, day, t, a > {c} as g from d), {v}1 as (select *, case when g is distinct from lag(g) over (partition by pid order by t) then 1 else 0 end as nw from {v}0),
{v}2 as (select *, sum(nw) over (partition by pid order by t rows unbounded preceding) as seq from {v}1), {v}3 as (select *, count(*) over (partition by pid, seq) as len, row_number() over (partition by pid, seq order by t) as k from {v}2 where g)""" for v, c in (("light", 40), ("mod", 120)))
        + ", u as (" + " union all ".join(f"select pid, day, '{v}_{m}' as what, count(*) as n from {v}3 where k = 1 and len >= {m // 60} group by pid, day" for v in ("light", "mod") for m in (60, 180)) + f") select dd.pid, dd.day as hyp_exp_day, {_BT} from (select distinct pid, day from d) dd left join u on u.pid = dd.pid and u.day = dd.day group by dd.pid, dd.day")
def pa_bout_table(spark: SparkSession, sf: str) -> DataFrame:
    return activity.bout_table(activity.pa_levels(dense(spark, sf), CUTS, "hyp_act_x"), ["light", "mod"], [60, 180], S)


@_query(", v as (select pid, day, sum(ann::int) * 60.0 as tst from d group by pid, day) select pid, count(*) as n_days, round(avg(tst), 5) as mean_tst, round(stddev_samp(tst), 5) as std_tst from v where tst > 150 group by pid")
def population_summary(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.population_summary(dense(spark, sf), "ann", S).withColumns({c: F.round(c, 5) for c in ("mean_tst", "std_tst")})


@_query("select row_id, 'mesor' as variable, mesor as value from ml union all select row_id, 'amplitude', amplitude from ml", base=False)
def melt_features(spark: SparkSession, sf: str) -> DataFrame:
    return features.melt(table(spark, sf, "ml"), ["row_id"], ["mesor", "amplitude"])


@_query()
def features_per_day(spark: SparkSession, sf: str) -> DataFrame:
    return feature_tables(dense(spark, sf), S, CUTS, label="gt", lengths=(60, 180))[0]["per_day"]


@_query()
def features_per_hour(spark: SparkSession, sf: str) -> DataFrame:
    return feature_tables(dense(spark, sf), S, CUTS, label="gt", lengths=(60, 180))[0]["per_hour"]


@_query(_GRID + " select pid, max((a is null)::int) as has_null from g group by pid", base=False)
def has_no_activity(spark: SparkSession, sf: str) -> DataFrame:
    return days.has_no_activity(hourly(spark, sf), G).select("pid", _i("has_null"))


@_query(_GRID + " select pid, count(*) as n, round(sum(coalesce(a, -1)), 4) as total from g group by pid", base=False)
def fill_no_activity(spark: SparkSession, sf: str) -> DataFrame:
    x = days.fill_no_activity(hourly(spark, sf), G, -1.0)
    return x.groupBy("pid").agg(F.count("*").alias("n"), F.round(F.sum("hyp_act_x"), 4).alias("total"))


@_query(" select distinct pid, day as hyp_exp_day from d")
def experiment_days(spark: SparkSession, sf: str) -> DataFrame:
    return days.experiment_days(dense(spark, sf), S)


@_query(""", di as (select pid, day, min(t) as t0, max(t) as t1 from d where ann and pid::int % 2 = 0 group by pid, day),
m as (select d.pid, d.day, bool_or(coalesce(t between t0 and t1, false)) as inside, d.hyp_row from d left join di on d.pid = di.pid group by all),
z as (select *, sum(inside::int) over (partition by pid, day) as k from m) select pid, hyp_row, (case when k = 0 then 32 else 0 end)::int as hyp_invalid from z""")
def flag_day_without_diary(spark: SparkSession, sf: str) -> DataFrame:
    x = dense(spark, sf)
    x = joins.add_diary(x, _diary(x.where("cast(pid as int) % 2 = 0")), S)
    return validate.flag_day_without_diary(validate.init(x, S), S).select("pid", "hyp_row", S.invalid)


@_query(_FLAG + ", k as (select pid from (select pid, day from fe group by pid, day having not bool_and(inv & 2 = 2)) group by pid having count(*) >= 1) select distinct pid from fe where pid in (select pid from k) and pid::int % 2 = 0 and pid <> '4'")
def remove_participants(spark: SparkSession, sf: str) -> DataFrame:
    x = _flagged(spark, sf).withColumn(S.invalid, F.col(S.invalid).bitwiseAND(2))
    x = validate.remove_participants(validate.remove_without_valid_days(x, S), S, ["4"])
    return validate.remove_without_diary(x, _diary(dense(spark, sf).where("cast(pid as int) % 2 = 0")), S).select("pid").distinct()


@_query(" select pid, day as hyp_exp_day, round(100.0 * avg(gt::int), 5) as se, sum(ann::int)::double as tst from d group by pid, day")
def two_metrics(spark: SparkSession, sf: str) -> DataFrame:
    x = dense(spark, sf)
    a, b = metrics.sleep_quality(x, "se", "gt", S, out="se"), metrics.sleep_quality(x, "totalSleepTime", "ann", S, out="tst")
    return views.two_metrics(a, b, S, "se", "tst").withColumn("se", F.round("se", 5))


@_query(" select pid, (s // 10800) * 10800 as bucket_s, round(avg(a), 5) as hyp_act_x, round(avg(hr), 5) as hr from d where day in (0, 1) and hour(t) between 8 and 19 group by all")
def signals_zoomed(spark: SparkSession, sf: str) -> DataFrame:
    x = views.signals(dense(spark, sf), ["hyp_act_x", "hr"], S, days=[0, 1], hours=(8, 20), step_s=10_800)
    return x.withColumns({c: F.round(c, 5) for c in ("hyp_act_x", "hr")})


@_query(" select user_id::varchar as pid, rn::int as hyp_row, (event_type in ('view', 'signup') or value < 60)::int as stage_sleep, (event_type <> 'error')::int as not_error from e0")
def annotation_from_values(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    x = e.select(F.col("user_id").cast("string").alias("pid"), "event_type", "value", F.row_number().over(EpochSchema(pid="user_id", time="ts", row="event_id").window()).alias("hyp_row"))
    stage = features.annotation_from(F.col("event_type"), ["view", "signup"]) | (F.col("value") < 60)
    return x.select("pid", "hyp_row", stage.cast("int").alias("stage_sleep"), features.annotation_from(F.col("event_type"), ["error"], negate=True).cast("int").alias("not_error"))


M = EpochSchema(pid="id", row="line_no", activity=("stdmet_highic_branch",), hr="mean_hr", freq_s=60)


def minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one-minute recordings at their own sampling: a participant's lines, once each, in minutes from a common start."""
    x = table(spark, sf_dir, "small_collection_fenland_full").where("id is not null and line_no is not null")
    x = x.groupBy("id", "line_no").agg(F.max_by("stdmet_highic_branch", "row_id").alias("stdmet_highic_branch"), F.max_by("mean_hr", "row_id").alias("mean_hr"))
    return x.withColumn("hyp_time_col", F.expr("timestamp_ntz'2024-01-01 12:00:00' + make_dt_interval(0, 0, line_no)"))


@_query()
def boundary_hr_minutes(spark: SparkSession, sf: str) -> DataFrame:
    """The heart-rate detector with its default parameters on one-minute epochs."""
    return boundaries.by_heart_rate(minutes(spark, sf), M).select("id", "line_no", _i("hyp_sleep_period"))


@_query()
def boundary_hr_sweep(spark: SparkSession, sf: str) -> DataFrame:
    """Minutes asleep per combination of 5 quantiles, 5 least lengths and 5 merge tolerances, all in one plan."""
    x = boundaries.sweep_heart_rate_totals(minutes(spark, sf), M, quantiles=[0.3, 0.35, 0.4, 0.45, 0.5], min_minutes=[20, 30, 40, 50, 60], merge_minutes=[60, 120, 180, 240, 300])
    return x.groupBy("param_id", "quantile", "volatility", "min_minutes", "merge_minutes").agg(F.sum("epochs_asleep").alias("minutes_asleep"))


_HYP = """with e as (select pid, hyp_time_col as t, arg_max(coalesce(hyp_sleep_bin, -99), (received_at, row_id)) as b from hyp_epochs where pid is not null and hyp_time_col is not null group by all),
v as (select pid, epoch(t)::bigint as s, case when b > -50 and not isnan(b) then floor(b + 0.5)::int end as l from e)"""


@_query(_HYP + """, f as (select *, case when coalesce(l, 0) is distinct from lag(coalesce(l, 0)) over (partition by pid order by s) then 1 else 0 end as nw from v),
r as (select *, (sum(nw) over (partition by pid order by s rows unbounded preceding) - 1)::int as seq from f)
select pid, seq, any_value(coalesce(l, 0)) as level, count(*)::int as len, min(s) as start_s from r group by pid, seq""", base=False)  # fmt: skip
def run_lengths_half_minutes(spark: SparkSession, sf: str) -> DataFrame:
    """Runs of the rounded label of the half-minute epochs, in blocks, as one participant holds a tenth of them."""
    e = table(spark, sf, "hyp_epochs").where("pid is not null and hyp_time_col is not null")
    e = e.groupBy("pid", "hyp_time_col").agg(F.max_by("hyp_sleep_bin", F.struct("received_at", "row_id")).alias("b"))
    x = e.select("pid", "hyp_time_col", F.when(~F.isnan("b"), F.floor(F.col("b") + 0.5).cast("int")).alias("level"))
    s = EpochSchema()
    runs = blocks.run_lengths(x, "level", s, length="len", seq="seq").withColumn("start_s", s.seconds(x))
    return runs.groupBy("pid", "seq").agg(F.first(F.coalesce("level", F.lit(0))).alias("level"), F.first("len").alias("len"), F.min("start_s").alias("start_s"))


@_query("select user_id::varchar as pid, event_id::bigint as hyp_row, date_trunc('second', ts) as hyp_time_col, value as hyp_act_x, value + 1 as hyp_hr, event_type in ('view', 'click') as hyp_annotation from events", base=False)
def source_epochs(spark: SparkSession, sf: str) -> DataFrame:
    """Epochs of a format with its own column names and time texts."""
    raw = table(spark, sf, "events").select(F.col("user_id").alias("who"), "event_id", F.date_format("ts", "yyyy-MMM-dd HH:mm:ss").alias("at"), F.col("value").cast("string").alias("counts"), (F.col("value") + 1).alias("rate"), "event_type")
    cfg = SourceConfig(("counts",), "at", pid="who", hr="rate", strftime="%Y-%b-%d %H:%M:%S", annotation=("event_type", ("view", "click")))
    return readers.standardise(raw, cfg, order="event_id").select("pid", "hyp_row", "hyp_time_col", "hyp_act_x", "hyp_hr", "hyp_annotation")


@_query(" select pid, hyp_row, timestamp '2017-01-03 09:00:00' + to_seconds(30 * (hyp_row - 1)) as hyp_time_col, a as hyp_act_x from d")
def source_weekday_clock(spark: SparkSession, sf: str) -> DataFrame:
    """Dates from a day of week and times of day alone."""
    clock = F.date_format(F.expr("timestamp_ntz'2017-01-03 09:00:00' + make_dt_interval(0, 0, 0, 30 * (hyp_row - 1))"), "HH:mm:ss")
    raw = dense(spark, sf).select(F.col("pid").alias("mesaid"), F.col("hyp_row").alias("line"), clock.alias("linetime"), F.col("hyp_act_x").alias("activity"), F.lit(3).alias("dayofweek"))
    return readers.standardise(raw, MESA, order="line").select("pid", "hyp_row", "hyp_time_col", "hyp_act_x")


@_query(", x as (select event_id % 6 as k, * from events) select '7' as pid, event_type as device, event_id::varchar as serial, date_trunc('minute', ts) as hyp_time_col, k::int as auto0_man1, case when k = 0 then value when k = 1 then value + 1 else 0 end as gluc_mgdl, case when k = 2 then value end as ket_mmol from x")
def source_glucose(spark: SparkSession, sf: str) -> DataFrame:
    """Records of a glucose export."""
    k, v = F.col("event_id") % 6, F.col("value")
    raw = table(spark, sf, "events").select(
        F.col("event_type").alias("Device"), F.col("event_id").cast("string").alias("Serial Number"), F.date_format("ts", "MM-dd-yyyy hh:mm a").alias("Device Timestamp"), k.cast("string").alias("Record Type"),
        F.when(k == 0, v.cast("string")).alias("Historic Glucose mg/dL"), F.when(k == 1, (v + 1).cast("string")).alias("Scan Glucose mg/dL"), F.when(k == 2, v.cast("string")).alias("Ketone mmol/L"),
    )
    return readers.glucose(raw, pid="7")


@_query("select c_custkey::varchar as id, case when c_custkey % 4 <> 0 then ((c_custkey % 24) * 3600 + (c_custkey % 60) * 60)::double end as bed, case when c_custkey % 3 <> 0 then c_acctbal end as score from customer", base=False)
def source_demographics(spark: SparkSession, sf: str) -> DataFrame:
    """Attributes with clock texts and sentinels."""
    k = F.col("c_custkey")
    raw = table(spark, sf, "customer").select(k.alias("id"), F.when(k % 4 == 0, "L").otherwise(F.format_string("%02d:%02d", k % 24, k % 60)).alias("bed"), F.when(k % 3 == 0, "S").otherwise(F.col("c_acctbal").cast("string")).alias("score"), "c_name")
    return readers.demographics(raw, pid="id", clocks=["bed"], columns=["bed", "score"])
