"""Distributed exact statistics.

``exact_median`` avoids the single final task of Spark's exact ``median`` (which merges
every distinct value in one buffer) and of a global window: equal values are first folded
to one row with a count, then the bracket that holds the middle ranks is cut into
sub-brackets whose counts are taken in one pass, until few distinct values are left.
"""

from __future__ import annotations

import bisect

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headroom.session import materialize

col = F.col

#: Sub-brackets per round, accuracy of the sketch that places their bounds, and the number of
#: distinct values that are ranked at once at the end.
PARTS = 64
ACCURACY = 10_000
FEW = 1024


def order_statistics(df: DataFrame, value: str, ranks, few: int = FEW) -> list[float | None]:
    """The values at ``ranks(n)`` (positions from 0 in ascending order of the ``n`` values that are neither null nor
    NaN); ``[]`` of ranks or no values give none.

    Each round asks an approximate sketch for ``PARTS`` bounds over the distinct values still in question and then
    counts exactly how many values lie below each bound, so a bad bound costs a round, never a wrong rank.  Only one row of counts
    per round and at most ``few`` distinct values at the end reach the driver; there are about
    ``log(distinct / few) / log(PARTS)`` rounds, each over what the last one left."""
    folded = materialize(df.select(col(value).cast("double").alias("v")).where(col("v").isNotNull() & ~F.isnan("v"))
                         .groupBy("v").agg(F.count(F.lit(1)).alias("c")))
    n = folded.agg(F.sum("c")).first()[0] or 0
    return [_at(folded, rank, few) for rank in ranks(n)] if n else []


def _at(folded: DataFrame, rank: int, few: int) -> float:
    below, inside = 0, folded
    while True:
        rows = inside.orderBy("v").limit(few + 1).collect()      # a top-k per task, then few + 1 rows
        if len(rows) <= few:
            for row in rows:
                below += row["c"]
                if rank < below:
                    return row["v"]
        steps = F.array(*[F.lit(k / PARTS) for k in range(1, PARTS)])
        bounds = sorted(set(inside.agg(F.percentile_approx("v", steps, ACCURACY)).first()[0]))
        counts = list(inside.agg(*[F.sum(F.when(col("v") < b, col("c")).otherwise(0)).alias(f"b{k}")
                                   for k, b in enumerate(bounds)]).first())
        # bounds[at - 1] <= the wanted value < bounds[at]
        at = bisect.bisect_right(counts, rank - below)
        if at:
            inside = inside.where(col("v") >= bounds[at - 1])
            below += counts[at - 1]
        if at < len(bounds):
            inside = inside.where(col("v") < bounds[at])


def exact_median(df: DataFrame, value: str, alias: str = "median") -> DataFrame:
    """One-row frame with the exact median of ``value`` (mean of the two middle
    values for an even count; null when there are no values)."""
    middle = order_statistics(df, value, lambda n: sorted({(n - 1) // 2, n // 2}))
    median = sum(middle) / len(middle) if middle else None
    return df.sparkSession.range(1).select(F.lit(median).cast("double").alias(alias))
