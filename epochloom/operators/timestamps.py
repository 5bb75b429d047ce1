"""Mixed timestamp texts to one UTC instant.

The operator is an ordered cascade of anchored patterns. The first pattern that matches the trimmed
text rewrites it to ``year|month|day|hour|minute|second|fraction|half|zone|region|order``; fields are
then range-checked one by one (strict parsing: 31 February or hour 24 name no instant). A text without
a zone is wall-clock time of the source's zone from a lookup table.

Policies:

* A wall-clock time that occurs twice has two candidate instants. :func:`settle` chooses by the 16-bit
  counter of a nearby line of the same source where there is one, else by the order of lines.
* A wall-clock time that doesn't exist (clocks put forward) names no instant and gives null, or with
  ``nonexistent="shift"`` the instant after moving it forward by the gap.

Everything is JVM-side; nothing depends on the session's time zone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from epochloom.runtime import spill

_TIME = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?(?:\s*([AaPp])\.?[Mm]\.?)?"
_ZONE = r"(?:\s*(Z|z|[+-]\d{2}(?::?\d{2})?|[A-Za-z]{2,5}))?(?:\s*\[([A-Za-z_/+\-0-9]+)\])?"
_CLOCK = rf"(?:(?:[T ]\s*|,\s*){_TIME}{_ZONE})?"


@dataclass(frozen=True)
class Pattern:
    """One step of the cascade: an anchored regular expression and its rewriting."""

    name: str
    regex: str
    rewrite: str


#: Ordered cascade. ``L`` as order means that month and day follow the locale.
CASCADE: tuple[Pattern, ...] = (
    Pattern("iso", rf"^(\d{{4}})[-/.](\d{{1,2}})[-/.](\d{{1,2}}){_CLOCK}$", "$1|$2|$3|$4|$5|$6|$7|$8|$9|$10|Y"),
    Pattern("numeric", rf"^(\d{{1,2}})[-/.](\d{{1,2}})[-/.](\d{{4}}){_CLOCK}$", "$3|$2|$1|$4|$5|$6|$7|$8|$9|$10|L"),
    Pattern("basic", r"^(\d{4})(\d{2})(\d{2})[Tt](\d{2})(\d{2})(?:(\d{2}))?(?:[.,](\d{1,9}))?(Z|z|[+-]\d{2}(?::?\d{2})?)?$", "$1|$2|$3|$4|$5|$6|$7||$8||Y"),
    Pattern("day_month_name", rf"^(?:[^\W\d]{{2,10}}\.?,\s*)?(\d{{1,2}})\.?[-/ ]\s*([^\W\d]{{3,9}})\.?,?[-/ ]\s*(\d{{4}}){_CLOCK}$", "$3|$2|$1|$4|$5|$6|$7|$8|$9|$10|Y"),
    Pattern("year_month_name", rf"^(\d{{4}})[-/ ]([^\W\d]{{3,9}})[-/ ](\d{{1,2}}){_CLOCK}$", "$1|$2|$3|$4|$5|$6|$7|$8|$9|$10|Y"),
    Pattern("month_name_day", rf"^(?:[^\W\d]{{2,10}}\.?,\s*)?([^\W\d]{{3,9}})\.?\s+(\d{{1,2}}),?\s+(\d{{4}}){_CLOCK}$", "$3|$1|$2|$4|$5|$6|$7|$8|$9|$10|Y"),
)
#: Counts since 1970 UTC by their number of digits: microseconds in one unit.
EPOCH_UNITS: dict[int, int] = {10: 1_000_000, 13: 1_000, 16: 1}
#: Month names by their first three letters, lower case (English, German, French).
MONTHS: dict[str, int] = {
    "jan": 1, "feb": 2, "mar": 3, "apr": 4, "may": 5, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "oct": 10, "nov": 11, "dec": 12,
    "mär": 3, "mai": 5, "okt": 10, "dez": 12, "fév": 2, "avr": 4, "aoû": 8, "déc": 12,
}
#: Offsets in minutes that an abbreviation can stand for; the source's zone decides between several.
ABBREVIATIONS: dict[str, tuple[int, ...]] = {
    "Z": (0,), "UTC": (0,), "UT": (0,), "GMT": (0,), "WET": (0,), "WEST": (60,),
    "BST": (60, 360), "CET": (60,), "CEST": (120,), "MEZ": (60,), "MESZ": (120,), "EET": (120,), "EEST": (180,), "MSK": (180,),
    "IST": (330, 60, 120), "NPT": (345,), "JST": (540,), "KST": (540,), "SGT": (480,), "HKT": (480,),
    "EST": (-300, 600), "EDT": (-240, 660), "CST": (-360, 480, -300), "CDT": (-300, -240), "MST": (-420,), "MDT": (-360,),
    "PST": (-480, 480), "PDT": (-420,), "AKST": (-540,), "AKDT": (-480,), "HST": (-600,), "AST": (-240, 180), "ADT": (-180,), "NST": (-210,), "NDT": (-150,),
    "AWST": (480,), "ACST": (570,), "ACDT": (630,), "AEST": (600,), "AEDT": (660,), "NZST": (720,), "NZDT": (780,), "BRT": (-180,), "SAST": (120,),
}

_S = 1_000_000
_DAY = 86_400 * _S
#: Seconds since 1970 of 1989-12-31 00:00:00 UTC, where the 16-bit counter starts.
COUNTER_START_S = 631_065_600
_FIELDS = ("y", "mo", "d", "h", "mi", "s", "frac", "half", "zone", "region", "order")


def offset_us(utc_us: Column, tz: Column) -> Column:
    """Microseconds by which wall clocks of ``tz`` are ahead of UTC at an instant."""
    return F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(utc_us), tz)) - utc_us


def parse(df: DataFrame, text: str, tz: str, locale: str, *, nonexistent: str = "null", prefix: str = "") -> DataFrame:
    """Add ``<prefix>early_us`` and ``<prefix>late_us``, the first and last instant a text can name.

    They are equal unless the wall-clock time occurs twice. Null text, text that no pattern matches,
    fields out of range, unknown zones and (by default) nonexistent wall-clock times give null, as does
    a text without zone where ``tz`` is null. A null ``locale`` counts as day first. Blanks around the
    text don't matter. Existing columns are kept, but for those two names, which are replaced.
    """
    if nonexistent not in ("null", "shift"):
        raise ValueError("nonexistent must be 'null' or 'shift'")
    out_early, out_late = f"{prefix}early_us", f"{prefix}late_us"
    keep = [c for c in df.columns if c not in (out_early, out_late)]
    raw = F.trim(F.col(f"`{text}`"))
    canon, number = F.lit(None).cast("string"), F.lit(None).cast("bigint")
    for p in reversed(CASCADE):
        canon = F.when(F.col("__t").rlike(p.regex), F.regexp_replace("__t", p.regex, p.rewrite)).otherwise(canon)
    for digits, unit in EPOCH_UNITS.items():
        number = F.when(F.col("__t").rlike(rf"^\d{{{digits}}}$"), F.col("__t").cast("bigint") * unit).otherwise(number)
    s1 = df.select(*[F.col(f"`{c}`") for c in keep], raw.alias("__t"))
    s2 = s1.select(*[F.col(f"`{c}`") for c in keep], number.alias("__n"), F.when(number.isNull(), F.split(canon, r"\|")).alias("__f"))
    f = {n: F.get("__f", F.lit(i)) for i, n in enumerate(_FIELDS)}
    num = lambda c: F.when(c == "", 0).otherwise(c.try_cast("int"))
    month_map = F.create_map(*[x for k, v in MONTHS.items() for x in (F.lit(k), F.lit(v))])
    month = F.when(f["mo"].rlike(r"^\d+$"), f["mo"].try_cast("int")).otherwise(F.try_element_at(month_map, F.lower(F.substring(f["mo"], 1, 3))))
    us_order = (f["order"] == "L") & F.coalesce(F.col(f"`{locale}`") == "en_US", F.lit(False))
    frac = F.when(f["frac"] == "", 0).otherwise(F.substring(F.rpad(f["frac"], 6, "0"), 1, 6).try_cast("bigint"))
    s3 = s2.select(
        *[F.col(f"`{c}`") for c in keep], "__n", f["y"].try_cast("int").alias("__y"),
        F.when(us_order, f["d"].try_cast("int")).otherwise(month).alias("__mo"),
        F.when(us_order, f["mo"].try_cast("int")).otherwise(f["d"].try_cast("int")).alias("__d"),
        num(f["h"]).alias("__h"), num(f["mi"]).alias("__mi"), num(f["s"]).alias("__s"), frac.alias("__us"),
        F.lower(f["half"]).alias("__half"), F.upper(f["zone"]).alias("__zone"), F.nullif(f["region"], F.lit("")).alias("__region"),
    )
    y, mo, d, h = (F.col(c) for c in ("__y", "__mo", "__d", "__h"))
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    days = F.when(mo.isin(4, 6, 9, 11), 30).when((mo == 2) & leap, 29).when(mo == 2, 28).otherwise(31)
    hour = F.when(F.col("__half") == "", h).when(h.between(1, 12), h % 12 + F.when(F.col("__half") == "p", 12).otherwise(0))
    ok = y.between(1, 9999) & mo.between(1, 12) & d.between(1, days) & hour.between(0, 23) & F.col("__mi").between(0, 59) & F.col("__s").between(0, 59)
    date = F.unix_date(F.make_date(y, mo, d)).cast("bigint")
    wall = F.when(ok, date * _DAY + ((hour * 60 + F.col("__mi")) * 60 + F.col("__s")).cast("bigint") * _S + F.col("__us"))
    s4 = s3.select(*[F.col(f"`{c}`") for c in keep], "__n", wall.alias("__w"), "__zone", F.when(F.col("__zone") == "", F.coalesce("__region", F.col(f"`{tz}`"))).otherwise(F.col(f"`{tz}`")).alias("__tz"), F.col("__zone").rlike(r"^[+-]").alias("__num"))
    # a zone that the JVM doesn't know would be an error
    known = [str(z) for z in df.sparkSession.sparkContext._jvm.java.time.ZoneId.getAvailableZoneIds().toArray()]
    s4 = s4.withColumn("__tz", F.when(F.col("__tz").isin(known), F.col("__tz")))
    zone, w = F.col("__zone"), F.col("__w")
    sign = F.when(zone.startswith("-"), -1).otherwise(1)
    digits = F.regexp_replace(zone, "[^0-9]", "")
    minutes = F.substring(digits, 1, 2).try_cast("int") * 60 + F.coalesce(F.substring(digits, 3, 2).try_cast("int"), F.lit(0))
    # offsets of the zone around the wall-clock time: the true instant has one of them
    off_a, off_b = (F.when(F.col("__tz").isNotNull() & w.isNotNull(), offset_us(w + k * _DAY, F.col("__tz"))) for k in (-1, 1))
    needs_zone = F.col("__n").isNull() & (zone == "")
    abbr_map = F.create_map(*[x for k, v in ABBREVIATIONS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    several = zone.isin([k for k, v in ABBREVIATIONS.items() if len(v) > 1])
    # an abbreviation of several meanings is the one that the zone uses in that year
    of_zone = F.array(off_a, off_b, offset_us(w + 182 * _DAY, F.col("__tz")))
    meanings = F.try_element_at(abbr_map, zone)
    fits = F.when(several & F.col("__tz").isNotNull() & w.isNotNull(), F.filter(meanings, lambda m: F.array_contains(of_zone, m.cast("bigint") * (60 * _S))))
    meaning = F.coalesce(F.get(fits, F.lit(0)), F.get(meanings, F.lit(0))).cast("bigint") * (60 * _S)
    fixed = F.when(F.col("__num"), F.when(minutes <= 18 * 60, (sign * minutes).cast("bigint") * (60 * _S))).when(zone != "", meaning)
    # The higher-order function above also keeps this step out of whole-stage code generation: together the steps would
    # make one method too long for the JVM to compile.
    s5 = s4.select(
        *[F.col(f"`{c}`") for c in keep], "__n", "__w", "__zone", "__tz", F.when(needs_zone, off_a).alias("__oa"), F.when(needs_zone, off_b).alias("__ob"), fixed.alias("__fixed"),
    )
    a, b, tzc = F.col("__oa"), F.col("__ob"), F.col("__tz")
    lo, hi = w - F.greatest(a, b), w - F.least(a, b)  # the larger offset gives the earlier instant
    lo_ok, hi_ok = offset_us(lo, tzc) == F.greatest(a, b), offset_us(hi, tzc) == F.least(a, b)
    gap = hi if nonexistent == "shift" else F.lit(None).cast("bigint")
    # most days have one offset only; the two checks then agree without another look at the zone
    early = F.when(a == b, w - a).when(lo_ok, lo).when(hi_ok, hi).otherwise(gap)
    late = F.when(a == b, w - a).when(hi_ok, hi).when(lo_ok, lo).otherwise(gap)
    pick = lambda x: F.coalesce(F.col("__n"), F.when(zone != "", w - F.col("__fixed")).otherwise(x))
    # one generated row: a fence, so that filters on the result aren't pushed into (and multiply) the cascade
    both = F.inline(F.array(F.struct(pick(early).alias(out_early), pick(late).alias(out_late))))
    return s5.select(*[F.col(f"`{c}`") for c in keep], both)


def counter_instant(near_us: Column, counter: Column) -> Column:
    """The instant nearest to ``near_us`` at which the 16-bit counter of seconds shows ``counter``."""
    near_s = F.floor(near_us / F.lit(_S)) - COUNTER_START_S
    ahead = F.pmod(counter.cast("bigint") - near_s + 32_768, F.lit(65_536)) - 32_768
    return (near_s + ahead + COUNTER_START_S) * _S


def settle(
    df: DataFrame, counters: DataFrame | None = None, *, source: str, order: str, key: str, counter: str | None = None, block: int = 2048, near_lines: int = 16, step_us: int = 90 * _S, join_us: int = 1_800 * _S
) -> DataFrame:
    """Choose between ``early_us`` and ``late_us``; returns ``key``, ``source``, ``order`` and ``utc_us`` of rows that name an instant.

    ``df`` holds the lines with a text, with ``early_us`` and ``late_us`` of :func:`parse`; it is read more than once,
    so it should be stored. ``counters`` has ``source``, ``order`` and ``counter`` of the lines with a counter. Only the blocks of
    lines around a repeated hour are looked at again (a few hours a source and year), so that a source of any
    length costs no more than its repeated hours: rows of one (source, repeated hour) share a task, not a source.

    An ambiguous line is settled, in this order, by

    1. the nearest line with a ``counter``, at most ``near_lines`` lines away: the candidate nearer to it;
    2. the lines before it within the hour: after wall-clock time has gone back by more than ``step_us``, later
       candidate, before it earlier candidate;
    3. where the hour shows no such step, the unambiguous neighbours: the whole stretch is later if it would otherwise begin
       before the one before it, and earlier if it would otherwise end after the one behind it. Where it joins both
       (within ``join_us``), the step is hidden by lines without a readable time; a line then takes the candidate nearer to the time
       that its place between the two neighbours tells. Else the stretch goes with the neighbour that it is nearer to;
       the earlier candidate if there is none.

    Ties in ``order`` count as one moment. Lines with null ``order`` are settled as the earlier candidate.
    """
    amb = F.col("early_us") != F.col("late_us")
    plain = df.where(F.col("early_us").isNotNull() & (~amb | F.col(order).isNull())).select(key, source, order, F.col("early_us").alias("utc_us"))
    blk = F.floor(F.col(order) / block)
    hours = (
        df.where(amb & F.col(order).isNotNull())
        .select(source, F.floor(F.col("early_us") / _DAY).alias("__hour"), F.explode(F.array(blk - 1, blk, blk + 1)).alias("__b"))
        .distinct()
    )
    lines = df.where(F.col("early_us").isNotNull()).select(source, order, key, "early_us", "late_us", *([F.lit(None).cast("int").alias(counter)] if counter else []))
    if counter:
        lines = lines.unionByName(counters.where(F.col(counter).isNotNull()).select(source, order, counter), allowMissingColumns=True)
    near = lines.withColumn("__b", blk).join(spill(hours), [source, "__b"])
    own = F.coalesce(amb & (F.floor(F.col("early_us") / _DAY) == F.col("__hour")), F.lit(False))
    w = Window.partitionBy(source, "__hour").orderBy(order)
    back_w = Window.partitionBy(source, "__hour").orderBy(F.desc(order))  # looking ahead in linear time
    before, after = w.rangeBetween(Window.unboundedPreceding, -1), back_w.rangeBetween(Window.unboundedPreceding, -1)
    to_now = w.rangeBetween(Window.unboundedPreceding, 0)
    from_now = back_w.rangeBetween(Window.unboundedPreceding, 0)
    e, ln = F.col("early_us"), F.col(order)
    fixed = F.when(F.col("early_us") == F.col("late_us"), F.struct(ln.alias("l"), F.col("early_us").alias("t")))
    near = near.withColumn("__own", own)
    marked = near.select(
        "*",
        F.max(F.when(F.col("__own"), e)).over(before).alias("__top"),
        F.last(fixed, ignorenulls=True).over(before).alias("__prev"),
        F.last(fixed, ignorenulls=True).over(after).alias("__next"),
        *(
            [
                F.last(F.when(F.col(counter).isNotNull(), F.struct(ln.alias("l"), F.col(counter).alias("c"))), ignorenulls=True).over(to_now).alias("__cp"),
                F.last(F.when(F.col(counter).isNotNull(), F.struct(ln.alias("l"), F.col(counter).alias("c"))), ignorenulls=True).over(from_now).alias("__cn"),
            ]
            if counter
            else []
        ),
    ).where(F.col("__own"))
    back = F.max(F.when(e < F.col("__top") - step_us, 1).otherwise(0)).over(to_now)
    whole = Window.partitionBy(source, "__hour")
    marked = marked.select("*", back.alias("__back"))
    marked = marked.select(
        "*",
        F.max("__back").over(whole).alias("__any"),
        F.min(F.struct(ln, e, F.col("__prev"))).over(whole).alias("__first"),
        F.max(F.struct(ln, F.col("late_us"), F.col("__next"))).over(whole).alias("__last"),
    )
    to_prev = F.col("__first.early_us") - F.col("__first.__prev.t")
    to_next = F.col("__last.__next.t") - F.col("__last.late_us")
    p, n = F.col("__prev"), F.col("__next")
    told = p["t"] + (n["t"] - p["t"]) * (ln - p["l"]) / (n["l"] - p["l"])
    by_order = (
        F.when(F.col("__any") == 1, F.col("__back") == 1)
        .when(to_prev < 0, True)
        .when(to_next < 0, False)
        .when((to_prev < join_us) & (to_next < join_us), F.abs(F.col("late_us") - told) < F.abs(e - told))
        .otherwise(F.coalesce(to_next < F.coalesce(to_prev, F.lit(join_us)), F.lit(False)))
    )
    late = by_order
    if counter:
        gap = lambda side: F.when(F.abs(F.col(f"{side}.l") - ln) <= near_lines, F.abs(F.col(f"{side}.l") - ln))
        pick = F.when(gap("__cn").isNull() | (gap("__cp") <= gap("__cn")), F.when(gap("__cp").isNotNull(), F.col("__cp.c"))).otherwise(F.col("__cn.c"))
        off = lambda cand: F.abs(counter_instant(cand, pick) - cand)
        late = F.when(pick.isNotNull(), off(F.col("late_us")) < off(e)).otherwise(by_order)
    return plain.unionByName(marked.select(key, source, order, F.when(late, F.col("late_us")).otherwise(e).alias("utc_us")))


def normalise(
    df: DataFrame, zones: DataFrame, *, text: str, source: str, order: str = "line_no", key: str = "row_id", device: str = "device_id",
    tz: str = "tz_name", locale: str = "locale", counter: str | None = None, nonexistent: str = "null",
) -> DataFrame:
    """One row (``key``, ``source``, ``order``, ``utc_us``) per row of ``df`` whose ``text`` names an instant.

    ``zones`` is the lookup (``device``, ``tz``, ``locale``), one row a device; it is joined without a hint, so
    Spark broadcasts it only while its measured size is below the session's threshold. Devices that it lacks
    have no zone: only texts that carry one are resolved. Further columns of either table are ignored, so
    clashing names do no harm. An empty table gives an empty result.
    """
    lookup = zones.select(F.col(device).alias("__dev"), F.col(tz).alias("__tz_name"), F.col(locale).alias("__locale"))
    lines = df.where(F.col(text).isNotNull()).select(key, source, order, device, text).join(lookup, F.col(device) == F.col("__dev"), "left")
    parsed = spill(parse(lines, text, "__tz_name", "__locale", nonexistent=nonexistent).select(key, source, order, "early_us", "late_us"))
    counters = df.select(source, order, counter) if counter else None
    return settle(parsed, counters, source=source, order=order, key=key, counter=counter)
