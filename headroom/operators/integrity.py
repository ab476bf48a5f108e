"""Key-constraint checks Spark does not enforce on Parquet."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

col = F.col


@dataclass
class PrimaryKey:
    table: str
    df: DataFrame
    keys: list[str]


@dataclass
class ForeignKey:
    table: str
    df: DataFrame
    cols: list[str]
    ref_table: str
    ref: DataFrame
    ref_cols: list[str]


@dataclass
class NotNull:
    table: str
    df: DataFrame
    column: str


def _row(kind: str, table: str, columns: list[str], counted: DataFrame) -> DataFrame:
    return counted.select(F.lit(kind).alias("check_kind"), F.lit(table).alias("table_name"),
                          F.lit(",".join(columns)).alias("columns"), col("violations").cast("long"))


def integrity_check(checks: list) -> DataFrame:
    """One row per check: (check_kind, table_name, columns, violations).
    PK: keys that occur more than once or are null; FK: non-null references
    with no target row (anti join); NOT NULL: null values."""
    out = None
    for c in checks:
        if isinstance(c, PrimaryKey):
            dup = (c.df.groupBy(*c.keys).agg(F.count(F.lit(1)).alias("n"))
                   .agg(F.sum(F.when(col("n") > 1, col("n")).otherwise(0)).alias("dups")))
            any_null = reduce(lambda a, b: a | b, [col(k).isNull() for k in c.keys])
            nulls = c.df.agg(F.count(F.when(any_null, 1))).scalar()
            counted = dup.select((F.coalesce("dups", F.lit(0)) + nulls).alias("violations"))
            row = _row("primary_key", c.table, c.keys, counted)
        elif isinstance(c, ForeignKey):
            ref = c.ref.select(*[col(r).alias(f"_fk{i}") for i, r in enumerate(c.ref_cols)]).distinct()
            src = c.df.select(*[col(x).alias(f"_fk{i}") for i, x in enumerate(c.cols)])
            for i in range(len(c.cols)):
                src = src.where(col(f"_fk{i}").isNotNull())
            counted = (src.join(ref, [f"_fk{i}" for i in range(len(c.cols))], "left_anti")
                       .agg(F.count(F.lit(1)).alias("violations")))
            row = _row("foreign_key", c.table, [f"{x}->{c.ref_table}.{r}" for x, r in zip(c.cols, c.ref_cols)], counted)
        elif isinstance(c, NotNull):
            counted = c.df.agg(F.count(F.when(col(c.column).isNull(), 1)).alias("violations"))
            row = _row("not_null", c.table, [c.column], counted)
        else:
            raise TypeError(f"unknown check {c!r}")
        out = row if out is None else out.unionByName(row)
    return out
