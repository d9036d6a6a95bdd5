"""Dates as text: partial ISO dates, ambiguous formats, offsets. All Column in/out."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from notegrid.functions.values import DURATION_MS

# The accepted shapes of stored dates.
ISO_DAY = r"^\d{4}-\d{2}-\d{2}$"
ISO_TIME = r"^(\d{4}-\d{2}-\d{2})([ T]\d{2}:\d{2}(:\d{2})?)?$"
DAY_MONTH = r"^(\d{1,2})([/-])(\d{1,2})[/-](\d{4})$"
LOOSE_ISO = r"^(\d{4})([/.-])(\d{1,2})[/.-](\d{1,2})$"
DATE_DEFAULT = re.compile(
    r"^(?:(today|now)\(\)|@(today|now))\s*(?:([+-])\s*'?(\d+)(min|mon|h|d|w|m|y)'?)?$")
PRECISIONS = ["year", "month", "day"]


def ymd(year: Column, month: Column, day: Column) -> Column:
    """Date from integer parts, null when it is not on the calendar."""
    written = F.format_string("%04d-%02d-%02d", year.cast("int"), month.cast("int"),
                              day.cast("int"))
    return F.when(year.isNotNull() & month.isNotNull() & day.isNotNull() & (year >= 1),
                  F.try_to_date(written, "yyyy-MM-dd"))


def iso_day(c: Column) -> Column:
    return F.when(c.rlike(ISO_DAY), F.try_to_date(c, "yyyy-MM-dd"))


def partial_date(c: Column) -> Column:
    """struct(value, precision, first_day); null unless YYYY, YYYY-MM or YYYY-MM-DD is valid."""
    t = F.trim(c)
    precision = F.when(t.rlike(r"^\d{4}$"), "year").when(t.rlike(r"^\d{4}-\d{2}$"), "month") \
        .when(t.rlike(ISO_DAY), "day")
    first = F.try_to_date(F.concat(t, F.when(precision == "year", "-01-01")
                                   .when(precision == "month", "-01").otherwise("")),
                          "yyyy-MM-dd")
    return F.when(precision.isNotNull() & first.isNotNull(),
                  F.struct(t.alias("value"), precision.alias("precision"),
                           first.alias("first_day")))


def _rank(c: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, PRECISIONS)), c)


def acceptable_date(c: Column, granularity: Column) -> Column:
    """A full date always is; a partial one only down to the field's granularity."""
    return F.coalesce(_rank(partial_date(c)["precision"]) >= _rank(granularity), F.lit(False))


def suggest_date(c: Column) -> Column:
    """Padded ISO text for unambiguous year-first dates, null when there is nothing to say."""
    t = F.trim(c)
    y, sep = F.regexp_extract(t, LOOSE_ISO, 1), F.regexp_extract(t, LOOSE_ISO, 2)
    m = F.regexp_extract(t, LOOSE_ISO, 3).try_cast("int")
    d = F.regexp_extract(t, LOOSE_ISO, 4).try_cast("int")
    one_sep = F.instr(F.substring(t, 6, 10), sep) > 0
    padded = F.concat_ws("-", y, F.lpad(m.cast("string"), 2, "0"), F.lpad(d.cast("string"), 2, "0"))
    return F.when(t.rlike(ISO_DAY), t).when(
        (sep != "") & one_sep & m.between(1, 12) & d.between(1, 31), padded)


def parse_date(c: Column) -> Column:
    """struct(date, error). ISO first (a time part is ignored), then day and month in the order
    the numbers allow; both at most 12 is an error of its own."""
    t = F.trim(c)
    iso = F.regexp_extract(t, ISO_TIME, 1)
    a, b = F.regexp_extract(t, DAY_MONTH, 1).try_cast("int"), F.regexp_extract(t, DAY_MONTH, 3).try_cast("int")
    y, sep = F.regexp_extract(t, DAY_MONTH, 4).try_cast("int"), F.regexp_extract(t, DAY_MONTH, 2)
    mixed = (F.length(t) - F.length(F.replace(t, F.when(sep == "", "?").otherwise(sep), F.lit("")))) == 2
    found = F.when(iso != "", iso_day(iso)) \
        .when(y.isNotNull() & mixed, F.when(a > 12, ymd(y, b, a)).when(b > 12, ymd(y, a, b)))
    error = F.when(F.coalesce(c, F.lit("")) == "", "required") \
        .when(iso != "", F.when(found.isNull(), "invalid")) \
        .when(y.isNull() | ~mixed, "unrecognized") \
        .when((a <= 12) & (b <= 12), "ambiguous").when(found.isNull(), "invalid")
    return F.struct(found.alias("date"), error.alias("error"))


def parse_date_pattern(c: Column, pattern: str) -> Column:
    """Date by a configured pattern of YYYY, MM and DD with literal separators."""
    java = pattern.replace("YYYY", "yyyy").replace("DD", "dd")
    digits = {"YYYY": r"\d{4}", "MM": r"\d{2}", "DD": r"\d{2}"}
    shape, i = "", 0
    while i < len(pattern):
        for token, rx in digits.items():
            if pattern.startswith(token, i):
                shape, i = shape + rx, i + len(token)
                break
        else:
            shape, i = shape + "\\" + pattern[i] if not pattern[i].isalnum() else shape + pattern[i], i + 1
    return F.when(F.trim(c).rlike(f"^{shape}$"), F.try_to_date(F.trim(c), java))


def normalize_date(c: Column, granularity: Column, pattern: str | None = None) -> Column:
    """struct(value, error): stored ISO text for an authored date, or why there is none."""
    partial = partial_date(c)
    stamp = iso_day(F.regexp_extract(F.trim(c), r"^(\d{4}-\d{2}-\d{2})[ T]", 1))
    authored = parse_date(c)
    day, why = authored["date"], authored["error"]
    if pattern is not None:  # a configured pattern decides alone, there is no guessing beside it
        day = parse_date_pattern(c, pattern)
        why = F.when(day.isNull(), "pattern")
    coarse = partial.isNotNull() & ~acceptable_date(c, granularity)
    value = F.when(coarse, F.lit(None)).otherwise(F.coalesce(
        partial["value"], F.date_format(F.coalesce(stamp, day), "yyyy-MM-dd")))
    error = F.when(value.isNull(), F.when(coarse, "too-coarse")
                   .otherwise(F.coalesce(why, F.lit("invalid"))))
    return F.struct(value.alias("value"), error.alias("error"))


def add_offset(day: Column, amount: Column, unit: Column) -> Column:
    """Calendar-aware offset of a date. Month ends roll over: Jan 31 + 1 month is Mar 2 or 3."""
    months = F.when(unit == "y", amount * 12).otherwise(amount).cast("int")
    rolled = F.date_add(F.add_months(F.trunc(day, "month"), months), F.dayofmonth(day) - 1)
    days = F.when(unit == "w", amount * 7).otherwise(amount).cast("int")
    return F.when(unit.isin("mon", "y"), rolled).when(unit.isin("d", "w"), F.date_add(day, days))


def date_default(expression: str, asof: str) -> Column:
    """``today()``, ``now()``, ``@today``, ``@now``, optionally plus or minus a duration."""
    m = DATE_DEFAULT.match(expression.strip())
    if m is None:
        raise ValueError(f"not a date default: {expression}")
    today = "today" in (m[1], m[2])
    base = F.lit(asof).cast("timestamp") if today else F.current_timestamp()
    if m[3]:
        seconds = int(m[4]) * DURATION_MS["mon" if m[5] == "m" else m[5]] // 1000
        base = base + F.make_dt_interval(secs=F.lit(-seconds if m[3] == "-" else seconds))
    return F.date_format(base, "yyyy-MM-dd" if today else "yyyy-MM-dd HH:mm")
