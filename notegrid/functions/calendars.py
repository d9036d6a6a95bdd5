"""Custom calendars: eras, months of any length, days of any number of hours.

A calendar is configuration (a handful of months and eras), so every function takes it as a
plain dict and compiles it into literal arrays inside the expression.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the written form "<era> <year>-<month>-<day> [<hour>:<minute>]".
WRITTEN = r"^(\S+)\s+(\d+)-(\d{1,2})-(\d{1,2})(?:\s+(\d+):(\d{2}))?$"


def _shape(calendar: dict):
    months = [m["days"] for m in calendar["months"]]
    hours = calendar.get("hours_in_day", 24)
    starts = [sum(months[:i]) for i in range(len(months))]
    return months, starts, hours, sum(months) * hours


def calendar_parse(c: Column, name: str, calendar: dict) -> Column:
    """struct(calendar, era, year, month, day, hour, minute, linear, error); linear is null and
    error set when a part lies outside the calendar."""
    months, starts, hours, year_hours = _shape(calendar)
    t = F.trim(c)
    part = lambda i: F.regexp_extract(t, WRITTEN, i)
    era = part(1)
    year, month, day = (part(i).try_cast("int") for i in (2, 3, 4))
    hour, minute = (F.coalesce(part(i).try_cast("int"), F.lit(0)) for i in (5, 6))
    eras = [e["short"] for e in calendar["eras"]]
    backwards = era.isin([e["short"] for e in calendar["eras"] if e.get("backwards")])
    in_month = F.try_element_at(F.array(*map(F.lit, months)), F.when(month > 0, month))
    offset = F.try_element_at(F.array(*map(F.lit, starts)), F.when(month > 0, month))
    within = (offset + day - 1) * hours + hour + minute / F.lit(60.0)
    linear = F.when(backwards, within - year * F.lit(float(year_hours))) \
        .otherwise((year - 1) * F.lit(float(year_hours)) + within)
    error = F.when(~F.coalesce(t.rlike(WRITTEN), F.lit(False)), "format") \
        .when(~era.isin(eras), "era").when(year < 1, "year") \
        .when(in_month.isNull(), "month").when((day < 1) | (day > in_month), "day") \
        .when(hour >= hours, "hour").when(minute > 59, "minute")
    return F.struct(F.lit(name).alias("calendar"), era.alias("era"), year.alias("year"),
                    month.alias("month"), day.alias("day"), hour.alias("hour"),
                    minute.alias("minute"), F.when(error.isNull(), linear).alias("linear"),
                    error.alias("error"))


def calendar_format(linear: Column, calendar: dict) -> Column:
    """Text of linear hours; the sign picks the first era of that direction."""
    months, starts, hours, year_hours = _shape(calendar)
    forward = next((e["short"] for e in calendar["eras"] if not e.get("backwards")), None)
    backward = next((e["short"] for e in calendar["eras"] if e.get("backwards")), None)
    # Whole minutes in integer arithmetic, so that no fraction of an hour drifts.
    total = F.round(linear * 60).cast("bigint")
    per_year, per_day = year_hours * 60, hours * 60
    past = total < 0
    year = F.when(past, F.ceil(-total / per_year)).otherwise(F.floor(total / per_year) + 1)
    start = F.when(past, -year * per_year).otherwise((year - 1) * per_year)
    inside = total - start
    day_index = F.floor(inside / per_day)
    rest = inside - day_index * per_day
    hour, minute = F.floor(rest / 60), rest % 60
    begun = F.filter(F.array(*map(F.lit, starts)), lambda s: s <= day_index)
    month = F.size(begun)
    day = day_index - F.array_max(begun) + 1
    era = F.when(past, F.lit(backward)).otherwise(F.lit(forward))
    date = F.format_string("%s %d-%02d-%02d", era, year.cast("int"), month.cast("int"),
                           day.cast("int"))
    clock = F.format_string(" %d:%02d", hour.cast("int"), minute.cast("int"))
    return F.when(era.isNotNull() & linear.isNotNull(),
                  F.when(rest > 0, F.concat(date, clock)).otherwise(date))


def calendar_compare(a: Column, b: Column) -> Column:
    """Difference in hours of two parsed dates; null for different calendars."""
    return F.when(a["calendar"] == b["calendar"], a["linear"] - b["linear"])
