"""Linear projection of demand to a planning wall (the engine's core).

``with_projection`` adds, for one constraint, utilisation now / in two
periods, whole periods to the wall, the dated breach period and a status band.
``with_binding`` picks, across any number of constraints, the one whose wall is
reached first.  Both add named columns in stages, so each intermediate value is
computed once per row (Catalyst keeps non-trivial expressions that are used
twice in their own projection) and generated code stays small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headroom.functions.numeric import round_half_up
from headroom.functions.period import q_label

# Planning wall share of capacity, ceiling fudge of the period
# count, and the status bands (periods to the wall).
WALL = 0.85
CEIL_FUDGE = 0.999999
WARNING_PERIODS = 2
# Beyond this many periods a double no longer tells neighbouring periods apart; the count stays there.
FARTHEST = 1 << 53
WATCH_PERIODS = 4
UNKNOWN_STATUS = "unknown — capacity data pending"
STABLE = "stable"
AT_WALL = "AT THE WALL NOW"
WARNING = "COLLISION WARNING"
WATCH = "watch"
OK = "ok"

OUTPUTS = ["util_pct", "util_2q_pct", "periods", "breach_q", "breach", "status"]


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def with_projection(df: DataFrame, prefix: str, capacity, last, growth, last_q,
                    known: Column | None = None) -> DataFrame:
    """Add ``{prefix}util_pct, {prefix}util_2q_pct, {prefix}periods (long),
    {prefix}breach_q (index), {prefix}breach (its label), {prefix}status`` for one constraint.

    ``known`` (optional) is an extra gate; when false the constraint is treated
    as having no usable capacity (util, periods and breach are null).
    """
    p = prefix
    cap = _c(capacity).cast("double")
    usable = cap.isNotNull() & (cap != 0)
    if known is not None:
        usable = usable & known
    df = df.select("*", F.when(usable, cap).alias(f"_{p}cap"), _c(last).cast("double").alias(f"_{p}last"),
                   _c(growth).cast("double").alias(f"_{p}g"), _c(last_q).alias(f"_{p}lq"))
    c, l, g = F.col(f"_{p}cap"), F.col(f"_{p}last"), F.col(f"_{p}g")
    wall = F.lit(WALL) * c
    df = df.select("*", ((wall - l) / F.when(g > 0, g)).alias(f"_{p}raw"))
    raw = F.col(f"_{p}raw")
    far = F.lit(float(FARTHEST))
    periods = (F.when(c.isNull() | (g <= 0), F.lit(None).cast("long"))
               .when(l >= wall, F.lit(0).cast("long"))
               .otherwise(F.least(raw + F.lit(CEIL_FUDGE), far).cast("long")))
    status = (F.when(c.isNull(), F.lit(UNKNOWN_STATUS))
              .when(g <= 0, F.lit(STABLE))
              .when(l >= wall, F.lit(AT_WALL))
              .when(raw <= WARNING_PERIODS, F.lit(WARNING))
              .when(raw <= WATCH_PERIODS, F.lit(WATCH))
              .otherwise(F.lit(OK)))
    df = df.select("*",
                   round_half_up(F.lit(100.0) * l / c, 1).alias(f"{p}util_pct"),
                   round_half_up(F.lit(100.0) * (l + 2 * g) / c, 1).alias(f"{p}util_2q_pct"),
                   periods.alias(f"{p}periods"), status.alias(f"{p}status"))
    df = df.select("*", (F.col(f"_{p}lq") + F.col(f"{p}periods")).alias(f"{p}breach_q"))
    df = df.select("*", q_label(f"{p}breach_q").alias(f"{p}breach"))
    return df.drop(f"_{p}cap", f"_{p}last", f"_{p}g", f"_{p}lq", f"_{p}raw")


def with_binding(df: DataFrame, constraints: list[tuple[str, str]], default: str, out: str) -> DataFrame:
    """Add ``{out}name, {out}periods, {out}breach_q, {out}breach, {out}status``: the constraint
    with the fewest periods to its wall (ties go to the one listed first).
    ``constraints`` are ``(name, prefix)`` pairs of ``with_projection``
    outputs.  With no projected breach the name is ``'none'`` and the status is
    the ``default`` constraint's."""
    pers = [F.col(f"{pre}periods") for _, pre in constraints]
    best = pers[0] if len(pers) == 1 else F.least(*pers)          # nulls are skipped
    df = df.select("*", best.alias(f"{out}periods"))
    b = F.col(f"{out}periods")

    def pick(field: str, fallback: Column) -> Column:
        expr = None
        for name, pre in constraints:
            cond = F.col(f"{pre}periods") == b
            val = F.lit(name) if field == "name" else F.col(f"{pre}{field}")
            expr = F.when(cond, val) if expr is None else expr.when(cond, val)
        return expr.otherwise(fallback)

    default_pre = dict(constraints)[default]
    return df.select("*", pick("name", F.lit("none")).alias(f"{out}name"),
                     pick("breach_q", F.lit(None).cast("long")).alias(f"{out}breach_q"),
                     pick("breach", F.lit(None).cast("string")).alias(f"{out}breach"),
                     pick("status", F.col(f"{default_pre}status")).alias(f"{out}status"))
