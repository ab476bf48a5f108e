"""Period arithmetic and quarter parsing against plain Python (hypothesis-generated)."""

import datetime

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from headroom.functions.clean import quarter_label
from headroom.functions.period import q_index_of_date, q_index_of_label, q_label, q_start_date

@settings(max_examples=5, deadline=None)
@given(st.lists(st.dates(min_value=datetime.date(1000, 1, 1), max_value=datetime.date(9999, 12, 31)),
                min_size=1, max_size=200))
def test_period_round_trip(spark, days):
    df = spark.createDataFrame([(d,) for d in days], "d date")
    out = df.select("d", q_index_of_date("d").alias("i")).select(
        "d", "i", q_label("i").alias("label")).select(
        "d", "i", "label", q_index_of_label("label").alias("back"), q_start_date("label").alias("start"))
    for r in out.collect():
        q = (r.d.month - 1) // 3 + 1
        assert r.i == r.d.year * 4 + q - 1
        assert r.label == f"{r.d.year}-Q{q}" and r.back == r.i
        assert r.start == datetime.date(r.d.year, (q - 1) * 3 + 1, 1)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 12), st.integers(1000, 9999)), min_size=1, max_size=100))
def test_month_year_quarters(spark, pairs):
    raw = [f"{m:02d}/{y}" for m, y in pairs] + [f"{y}-Q{(m - 1) // 3 + 1}" for m, y in pairs]
    got = [r.q for r in spark.createDataFrame([(x,) for x in raw], "x string")
           .select(quarter_label(F.col("x")).alias("q")).collect()]
    want = [f"{y}-Q{(m - 1) // 3 + 1}" for m, y in pairs] * 2
    assert got == want


def test_five_digit_years_and_day_counts(spark):
    """Labels of any year parse back; day counts hold past what a date column carries."""
    import datetime
    from headroom.functions.period import q_first_date, q_index_of_label, q_label, q_start_day
    rows = [(y * 4 + q,) for y in (1, 1600, 1899, 1900, 1970, 2000, 2023, 2024, 9999, 21687, 2 ** 50) for q in range(4)]
    df = spark.createDataFrame(rows, "i long").select("i", q_label("i").alias("label"), q_first_date("i").alias("d"),
                                                      q_start_day("i").alias("n"))
    for r in df.select("*", q_index_of_label("label").alias("back")).collect():
        year, q = divmod(r["i"], 4)
        assert r["back"] == r["i"] and r["label"] == f"{year}-Q{q + 1}"
        cycles = max(0, (year - 2000) // 400)                    # the calendar repeats every 400 years of 146097 days
        day = datetime.date(year - 400 * cycles, 3 * q + 1, 1)
        assert r["n"] == (day - datetime.date(1970, 1, 1)).days + cycles * 146097
        assert r["d"] == (datetime.date(year, 3 * q + 1, 1) if year < 10000 else None)
