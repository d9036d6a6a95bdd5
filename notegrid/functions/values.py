"""Scalar value functions: null-safe comparison, coercion, text helpers. All are Column in/out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Device names that may not be used as a file name.
RESERVED_NAMES = r"(?i)^(?:CON|PRN|AUX|NUL|COM[1-9]|LPT[1-9])(?:\..*)?$"
# Longest file name without its extension in bytes, digest length, separator.
NAME_MAX_BYTES, DIGEST_LENGTH, DIGEST_SEPARATOR = 189, 16, "--"
# Milliseconds per duration unit (a month is 30 days, a year 365).
DURATION_MS = {"min": 60_000, "h": 3_600_000, "d": 86_400_000, "w": 604_800_000,
               "mon": 2_592_000_000, "y": 31_536_000_000}
DURATION = r"^'?(\d+)(min|mon|h|d|w|y)'?$"


def text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def number(c: Column) -> Column:
    """Number of a loosely typed value; unparsable text counts as 0."""
    return F.coalesce(c.try_cast("double"), F.lit(0.0))


def is_empty(c: Column) -> Column:
    return c.isNull() | (c.cast("string") == "")


def is_empty_list(c: Column) -> Column:
    return c.isNull() | (F.size(c) == 0)


def truthy(c: Column, kind: str = "text") -> Column:
    """Empty text, zero, false and null are false; any list is true."""
    if kind == "list":
        return c.isNotNull()
    if kind == "number":
        return F.coalesce(c != 0, F.lit(False))
    if kind == "boolean":
        return F.coalesce(c, F.lit(False))
    return text(c) != ""


def _aligned(a: Column, b: Column, kind: str) -> tuple[Column, Column]:
    if kind == "number":
        return a.try_cast("double"), b.try_cast("double")
    if kind == "date":
        return a.try_cast("timestamp"), b.try_cast("timestamp")
    if kind == "duration":
        return duration_ms(a), duration_ms(b)
    return a.cast("string"), b.cast("string")


def eq(a: Column, b: Column, kind: str = "text") -> Column:
    left, right = _aligned(a, b, kind)
    return left.eqNullSafe(right)


def ne(a: Column, b: Column, kind: str = "text") -> Column:
    """Null-safe: a missing value differs from every present one."""
    return ~eq(a, b, kind)


def _ordered(a: Column, b: Column, kind: str, test) -> Column:
    left, right = _aligned(a, b, kind)
    return F.coalesce(test(left, right) & ~is_empty(a) & ~is_empty(b), F.lit(False))


def lt(a: Column, b: Column, kind: str = "text") -> Column:
    return _ordered(a, b, kind, lambda x, y: x < y)


def le(a: Column, b: Column, kind: str = "text") -> Column:
    return _ordered(a, b, kind, lambda x, y: x <= y)


def gt(a: Column, b: Column, kind: str = "text") -> Column:
    return _ordered(a, b, kind, lambda x, y: x > y)


def ge(a: Column, b: Column, kind: str = "text") -> Column:
    return _ordered(a, b, kind, lambda x, y: x >= y)


def regex_match(c: Column, pattern: str) -> Column:
    """Pattern as plain text or ``/body/flags``; the empty pattern matches nothing."""
    body, flags = pattern, ""
    if len(pattern) > 1 and pattern.startswith("/") and pattern.rfind("/") > 0:
        end = pattern.rfind("/")
        body, flags = pattern[1:end], pattern[end + 1:]
    if body == "":
        return F.lit(False)
    inline = "".join(f for f in flags if f in "ims")
    return F.coalesce(text(c).rlike(f"(?{inline}){body}" if inline else body), F.lit(False))


def contains(c: Column, item: Column, is_list: bool = False) -> Column:
    if is_list:
        return F.coalesce(F.array_contains(c, item), F.lit(False))
    return F.contains(text(c), text(item))


def starts_with(c: Column, prefix: Column) -> Column:
    return F.startswith(text(c), text(prefix))


def ends_with(c: Column, suffix: Column) -> Column:
    return F.endswith(text(c), text(suffix))


def lower(c: Column) -> Column:
    return F.lower(text(c))


def upper(c: Column) -> Column:
    return F.upper(text(c))


def trim(c: Column) -> Column:
    return F.trim(text(c))


def length(c: Column, is_list: bool = False) -> Column:
    return F.coalesce(F.size(c) if is_list else F.length(c), F.lit(0))


def replace_first(c: Column, old: Column, new: Column) -> Column:
    at = F.instr(c, old)
    return F.when(at > 0, F.overlay(c, new, at, F.length(old))).otherwise(text(c))


def has_tag(tags: Column, tag: Column) -> Column:
    return F.coalesce(F.array_contains(tags, tag), F.lit(False))


def in_folder(folder: Column, prefix: Column) -> Column:
    return starts_with(folder, prefix)


def duration_ms(c: Column) -> Column:
    amount = F.regexp_extract(c, DURATION, 1)
    unit = F.regexp_extract(c, DURATION, 2)
    factor = F.create_map(*[F.lit(x) for kv in DURATION_MS.items() for x in kv])
    return F.when(unit != "", amount.try_cast("bigint") * F.try_element_at(factor, unit))


def date_of(c: Column) -> Column:
    return c.try_cast("timestamp")


def year(c: Column) -> Column:
    return F.year(date_of(c))


def month(c: Column) -> Column:
    return F.month(date_of(c))


def day(c: Column) -> Column:
    return F.dayofmonth(date_of(c))


def _shift(moment: Column, ms: Column) -> Column:
    return moment + F.make_dt_interval(secs=(ms / 1000).cast("decimal(18,6)"))


def add(a: Column, b: Column, kinds: tuple[str, str] = ("number", "number")) -> Column:
    """date + duration, duration + duration, otherwise numbers."""
    if kinds == ("date", "duration"):
        return _shift(date_of(a), duration_ms(b))
    if kinds == ("duration", "duration"):
        return duration_ms(a) + duration_ms(b)
    return number(a) + number(b)


def subtract(a: Column, b: Column, kinds: tuple[str, str] = ("number", "number")) -> Column:
    if kinds == ("date", "duration"):
        return _shift(date_of(a), -duration_ms(b))
    if kinds == ("date", "date"):
        return F.unix_millis(date_of(a)) - F.unix_millis(date_of(b))
    if kinds == ("duration", "duration"):
        return duration_ms(a) - duration_ms(b)
    return number(a) - number(b)


def multiply(a: Column, b: Column) -> Column:
    return number(a) * number(b)


def divide(a: Column, b: Column) -> Column:
    return F.try_divide(number(a), number(b))


def negate(a: Column) -> Column:
    return F.lit(0.0) - number(a)


def safe_name(c: Column) -> Column:
    """A name every file system accepts; long names are cut at a byte bound and get a digest."""
    plain = F.regexp_replace(c, r'[/\\:*?"<>|\x00-\x1F]', "")
    plain = F.trim(F.regexp_replace(plain, r"\s+", " "))
    plain = F.regexp_replace(plain, r"[. ]+$", "")
    plain = F.when(plain.rlike(RESERVED_NAMES), F.concat(F.lit("_"), plain)).otherwise(plain)
    suffix = F.concat(F.lit(DIGEST_SEPARATOR), F.substring(F.sha2(c, 256), 1, DIGEST_LENGTH))
    room = NAME_MAX_BYTES - len(DIGEST_SEPARATOR) - DIGEST_LENGTH
    # Longest prefix whose UTF-8 size fits: keep characters while the running size allows.
    cut = F.aggregate(
        F.split(plain, ""),
        F.struct(F.lit("").alias("kept"), F.lit(True).alias("open")),
        lambda acc, ch: F.struct(
            F.when(acc["open"] & (F.octet_length(F.concat(acc["kept"], ch)) <= room),
                   F.concat(acc["kept"], ch)).otherwise(acc["kept"]).alias("kept"),
            (acc["open"] & (F.octet_length(F.concat(acc["kept"], ch)) <= room)).alias("open")),
        lambda acc: acc["kept"])
    return F.when(F.octet_length(plain) <= NAME_MAX_BYTES, plain).otherwise(F.concat(cut, suffix))


def display_value(c: Column, is_list: bool = False) -> Column:
    return F.array_join(c, ", ") if is_list else text(c)


def parse_literal(c: Column) -> Column:
    """Command text to a typed value: true/false, a number, other text; empty clears (null)."""
    boolean = F.lower(c).isin("true", "false")
    numeric = c.rlike(r"^-?\d+(\.\d+)?$")
    return F.when(is_empty(c), F.lit(None).cast("variant")) \
        .when(boolean, F.try_parse_json(F.lower(c))) \
        .when(numeric, F.try_parse_json(c)) \
        .otherwise(F.parse_json(F.to_json(F.array(c))).cast("array<variant>")[0])


def coerce_number(c: Column) -> Column:
    """Only integer or decimal literals become numbers."""
    return F.when(F.trim(c).rlike(r"^-?\d+(\.\d+)?$"), F.trim(c).try_cast("double"))


def coerce_boolean(c: Column) -> Column:
    word = F.lower(F.trim(c))
    return F.when(word == "true", F.lit(True)).when(word == "false", F.lit(False))


def list_to_scalar(c: Column) -> Column:
    return F.when(F.size(c) == 1, c[0])


def scalar_to_list(c: Column) -> Column:
    return F.when(c.isNotNull(), F.array(c))


def static_value(c: Column, now: Column, today: Column, actor: Column) -> Column:
    return F.when(c == "$NOW", now).when(c == "$TODAY", today).when(c == "$ACTOR", actor) \
        .otherwise(c)


def natural_key(c: Column) -> Column:
    """Sort key: case-folded text with digit runs padded, so "2" sorts before "10".

    Each run becomes its digit count, itself led by its own number of places, followed by
    its digits without leading zeros, which orders runs of any length.
    """
    pieces = F.regexp_extract_all(F.lower(c), F.lit(r"(\d+|\D+)"), F.lit(1))

    def keyed(p: Column) -> Column:
        bare = F.regexp_replace(p, r"^0+(?=\d)", "")
        return F.when(p.rlike(r"^\d"), F.concat(
            F.length(F.length(bare).cast("string")).cast("string"), F.length(bare).cast("string"), bare)).otherwise(p)

    return F.array_join(F.transform(pieces, keyed), "")
