import datetime

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from notegrid.functions import calendars as C
from notegrid.functions import dates as D
from notegrid.functions import links as L
from notegrid.functions import values as V


def column(spark, values, expression, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, c {kind}")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("c"))).collect()]


def test_safe_name_keeps_portable_names_and_mends_others(spark):
    got = column(spark, ["Plan", "a/b: c?", "  two   words ", "nul", "end. .", "é" * 120], V.safe_name)
    assert got[:5] == ["Plan", "ab c", "two words", "_nul", "end"]
    assert len(got[5].encode()) <= 189 and got[5].startswith("é") and "--" in got[5]


def test_natural_order(spark):
    names = ["Part 10", "part 2", "Part 02b", "Part 1", "Alpha", "Part 100000000000000000000"]
    keys = column(spark, names, V.natural_key)
    assert [n for _, n in sorted(zip(keys, names))] == ["Alpha", "Part 1", "part 2", "Part 02b", "Part 10",
                                                        "Part 100000000000000000000"]


def test_null_safe_inequality(spark):
    assert column(spark, ["x", None], lambda c: V.ne(c, F.lit("x"))) == [False, True]
    assert column(spark, ["", None, "5"], lambda c: V.lt(c, F.lit(7), "number")) == [False, False, True]


def test_link_targets(spark):
    got = column(spark, ["[[A/B#h|t]]", '"[[C]]"', "[D](x/D.md)", "plain", None], L.link_target)
    assert got == ["A/B", "C", "x/D", None, None]


def test_parse_date_reports_ambiguity(spark):
    rows = column(spark, ["2024-02-30", "03/04/2024", "31-12-2024", "12/31/2024", "2024-05-01T10:00", "x", ""], D.parse_date)
    assert [r["error"] for r in rows] == ["invalid", "ambiguous", None, None, None, "unrecognized", "required"]
    assert rows[2]["date"] == rows[3]["date"] == datetime.date(2024, 12, 31)


def test_configured_pattern_decides_alone(spark):
    shape = lambda c: D.normalize_date(c, F.lit("day"), "DD/MM/YYYY")["value"]
    assert column(spark, ["03/04/2024", "2024-04-03", "04-03-2024"], shape) == ["2024-04-03", "2024-04-03", None]


def test_month_offsets_roll_over(spark):
    got = column(spark, ["2024-01-31"], lambda c: D.add_offset(F.to_date(c), F.lit(1), F.lit("mon")))
    assert got == [datetime.date(2024, 3, 2)]


CAL = {"hours_in_day": 10, "months": [{"days": 3}, {"days": 5}], "eras": [{"short": "B", "backwards": True}, {"short": "A"}]}


@settings(max_examples=3, deadline=None)
@given(st.lists(st.integers(-4000, 4000), min_size=5, max_size=30))
def test_calendar_format_and_parse_are_inverse(spark, hours):
    df = spark.createDataFrame([(float(h),) for h in hours], "h double")
    text = C.calendar_format(F.col("h"), CAL)
    rows = df.select("h", C.calendar_parse(text, "x", CAL)["linear"].alias("back")).collect()
    assert all(r["h"] == r["back"] for r in rows)


def test_calendar_order_across_eras(spark):
    rows = column(spark, ["B 2-1-1", "B 1-2-5 9:59", "A 1-1-1"], lambda c: C.calendar_parse(c, "x", CAL)["linear"])
    assert rows == sorted(rows) and rows[0] == -160.0 and rows[2] == 0.0


def test_source_filter_treats_missing_as_empty(spark):
    from notegrid.operators.select import source_filter
    ask = lambda rule: column(spark, ["a", "", None], lambda c: source_filter({"c": rule}))
    keep = lambda xs: [bool(x) for x in xs]
    assert keep(ask({"equals": "a"})) == [True, False, False]
    assert keep(ask({"in": ["a", ""]})) == [True, True, True]
    assert keep(ask({"not_equals": "a"})) == [False, True, True]
    assert keep(ask({"not_in": ["", "b"]})) == [True, False, False]
