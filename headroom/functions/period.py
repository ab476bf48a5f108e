"""Calendar-quarter arithmetic.

A period is kept as an integer index ``year * 4 + quarter - 1`` inside the
engine and rendered as the label ``'YYYY-Qn'`` at the edges.  Projected periods may lie
thousands of years ahead, so everything computed from a period (differences, day counts)
uses the index; labels are only parsed where nothing else exists, at the ``-Q``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def q_index_of_date(d) -> Column:
    d = _c(d)
    return F.year(d) * 4 + F.quarter(d) - 1


def q_index_of_label(label) -> Column:
    """The index of a label whose year may have any number of digits."""
    label = _c(label)
    return (F.substring_index(label, "-Q", 1).cast("long") * 4
            + F.substring_index(label, "-Q", -1).cast("long") - 1)


def _div(x: Column, n: int) -> Column:
    """Whole quotient, rounded down."""
    return F.call_function("div", x - F.pmod(x, F.lit(n)), F.lit(n))


def q_label(idx) -> Column:
    idx = _c(idx)
    return F.concat(_div(idx, 4).cast("string"), F.lit("-Q"), (F.pmod(idx, F.lit(4)) + 1).cast("string"))


def q_start_day(idx) -> Column:
    """Days from 1970-01-01 to the first day of a period, as a long: the Gregorian day
    count by arithmetic, for any year."""
    idx = _c(idx).cast("long")
    year, quarter = _div(idx, 4), F.pmod(idx, F.lit(4))
    before = year - 1
    leap = (F.pmod(year, F.lit(4)) == 0) & ((F.pmod(year, F.lit(100)) != 0) | (F.pmod(year, F.lit(400)) == 0))
    in_year = F.element_at(F.array(*[F.lit(d) for d in (0, 90, 181, 273)]), (quarter + 1).cast("int"))
    return (before * 365 + _div(before, 4) - _div(before, 100) + _div(before, 400) + in_year
            + F.when(leap & (quarter > 0), 1).otherwise(0) - 719162)


def q_start_date(label) -> Column:
    """First day of a period given as a label; see ``q_first_date``."""
    return q_first_date(q_index_of_label(label))


def q_first_date(idx) -> Column:
    """First day of a period; null from the year 10000 on, which a date column cannot hand to
    its readers (``q_start_day`` has the day count of any period)."""
    idx = _c(idx)
    near = F.when((idx >= 4) & (idx < 40000), idx)
    return F.make_date(_div(near, 4).cast("int"), (F.pmod(near, F.lit(4)) * 3 + 1).cast("int"), F.lit(1))
