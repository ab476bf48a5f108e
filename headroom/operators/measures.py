"""Descriptive measures.

Facts are aggregated to (site[, period]) before they meet the site table, so
each join sees at most one row per site and period.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headroom.functions.numeric import pct, round_half_up, safe_ratio
from headroom.operators.stats import exact_median

col = F.col

HEALTH_FIELDS = ["sq_ft", "seat_capacity", "power_kw_capacity", "region", "site_type"]
INTEGRATION_FIELDS = ["sq_ft", "seat_capacity", "power_kw_capacity", "lease_expiration_date",
                      "lease_option_deadline"]
INTEGRATING = ["buildout", "acquired_integrating"]


def completeness(fields: list[str]) -> Column:
    """100 / k x the number of non-null fields."""
    present = sum((col(f).isNotNull().cast("int") for f in fields), F.lit(0))
    return F.lit(100.0 / len(fields)) * present


def quality_by_site_quarter(issues: DataFrame, sites: DataFrame) -> DataFrame:
    """Issues, mean severity, open and severity>=4 counts per site x quarter."""
    agg = (issues.groupBy("site_id", "quarter")
           .agg(F.count(F.lit(1)).alias("issue_count"),
                round_half_up(F.avg("severity"), 2).alias("avg_severity"),
                F.sum((col("status") == "open").cast("int")).alias("open_count"),
                F.sum((col("severity") >= 4).cast("int")).alias("critical_count")))
    return (agg.join(sites.select("site_id", "site_name", "region"), "site_id")
            .select("site_id", "site_name", "region", "quarter", "issue_count", "avg_severity",
                    "open_count", "critical_count"))


def quality_by_site(quality_sq: DataFrame) -> DataFrame:
    """Per site — open issues, mean of the quarterly mean severities, issues."""
    return (quality_sq.groupBy("site_id", "site_name")
            .agg(F.sum("open_count").alias("open_issues"),
                 # quarterly means are 2-dp values: average them as exact hundredths
                 round_half_up(F.sum(round_half_up(col("avg_severity") * 100, 0).cast("long"))
                               / (F.count(F.lit(1)) * 100.0), 2).alias("mean_quarter_severity"),
                 F.sum("issue_count").alias("issues"))
            .orderBy(col("open_issues").desc(), "site_id"))


def cost_per_sqft(sites: DataFrame, leases: DataFrame) -> DataFrame:
    """All-in annual cost per square foot (null when size is unknown or 0)."""
    total = (F.coalesce(col("annual_rent_usd"), F.lit(0)) + F.coalesce(col("opex_usd_yr"), F.lit(0))).cast("double")
    l = leases.select("site_id", "lease_type", "annual_rent_usd", "opex_usd_yr")
    return (sites.select("site_id", "site_name", "region", "site_type", "status", "sq_ft")
            .join(l, "site_id", "left")
            .select("site_id", "site_name", "region", "site_type", "status", "sq_ft", "lease_type",
                    round_half_up(total, 0).alias("total_annual_cost_usd"),
                    round_half_up(safe_ratio(total, "sq_ft"), 2).alias("cost_per_sqft_usd")))


def headcount_vs_seats(headcount: DataFrame, sites: DataFrame) -> DataFrame:
    """C4: staff vs seats per site x quarter with a capacity flag."""
    agg = headcount.groupBy("site_id", "quarter").agg(F.sum("headcount").alias("total_headcount"))
    seats = col("seat_capacity")
    unknown = seats.isNull() | (seats == 0)
    return (agg.join(sites.select("site_id", "site_name", "region", "seat_capacity"), "site_id")
            .select("site_id", "site_name", "region", "quarter", "seat_capacity", "total_headcount",
                    pct("total_headcount", "seat_capacity").alias("seat_utilization_pct"),
                    F.when(unknown, "unknown")
                    .when(col("total_headcount") > seats, "over capacity")
                    .when(col("total_headcount") < 0.6 * seats, "under-utilized")
                    .otherwise("healthy").alias("capacity_flag")))


def site_health(sites: DataFrame, quality_sq: DataFrame, collision: DataFrame,
                cost: DataFrame) -> DataFrame:
    """Mean of capacity, quality, cost and completeness scores (0-100)."""
    med = exact_median(cost, "cost_per_sqft_usd", "median_cost")
    q = quality_sq.groupBy("site_id").agg(F.sum("open_count").alias("open_issues"),
                                          F.sum("critical_count").alias("critical_open"))
    u = collision.select(
        "site_id",
        F.greatest(F.coalesce("current_util_pct", F.lit(0.0)), F.coalesce("power_util_pct", F.lit(0.0)))
        .alias("tightest_util"),
        (col("current_util_pct").isNull() & col("power_util_pct").isNull()).alias("util_unknown"))
    c = cost.select("site_id", "cost_per_sqft_usd")
    df = (sites.select("site_id", "site_name", "region", "site_status", *HEALTH_FIELDS,
                       med.scalar().alias("median_cost"))
          .join(q, "site_id", "left").join(u, "site_id", "left").join(c, "site_id", "left"))
    m = col("median_cost")
    cps = col("cost_per_sqft_usd")
    capacity = (F.when(col("util_unknown").isNull() | col("util_unknown"), F.lit(0.0))
                .otherwise(F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100.0 - col("tightest_util")))))
    quality = F.greatest(F.lit(0.0), 100.0 - (12.0 * F.coalesce("open_issues", F.lit(0))
                                              + 8.0 * F.coalesce("critical_open", F.lit(0))))
    costs = (F.when(cps.isNull() | m.isNull(), F.lit(0.0))
             .when(cps <= m, F.lit(100.0))
             .otherwise(F.greatest(F.lit(0.0), 100.0 - 100.0 * (cps - m) / F.when(m != 0, m))))
    compl = F.when(col("site_status").isin(*INTEGRATING), F.lit(100.0)).otherwise(completeness(HEALTH_FIELDS))
    df = df.select("site_id", "site_name", "region", capacity.alias("cap_s"), quality.alias("qual_s"),
                   costs.alias("cost_s"), compl.alias("comp_s"))
    return df.select("site_id", "site_name", "region",
                     round_half_up("cap_s", 1).alias("capacity_score"),
                     round_half_up("qual_s", 1).alias("quality_score"),
                     round_half_up("cost_s", 1).alias("cost_score"),
                     round_half_up("comp_s", 1).alias("completeness_score"),
                     round_half_up((col("cap_s") + col("qual_s") + col("cost_s") + col("comp_s")) / 4.0, 1)
                     .alias("health_score"))


def integration_pipeline(sites: DataFrame, as_of: str) -> DataFrame:
    """Sites being stood up or folded in; stalled = >365 days and <80 %."""
    nulls = sum((col(f).isNull().cast("int") for f in INTEGRATION_FIELDS), F.lit(0))
    pct_c = completeness(INTEGRATION_FIELDS)
    age = F.datediff(F.lit(as_of).cast("date"), col("integration_start_date"))
    return (sites.where(col("site_status").isin(*INTEGRATING))
            .select("site_id", "site_name", "site_status", "integration_start_date",
                    nulls.alias("null_critical_fields"), pct_c.alias("completeness_pct"),
                    F.when(col("integration_start_date").isNotNull() & (age > 365) & (pct_c < 80), 1)
                    .otherwise(0).alias("stalled_flag"))
            .orderBy("completeness_pct", "site_id"))


def integration_summary(pipeline: DataFrame) -> DataFrame:
    """One row — integrating sites, below 80 %, stalled."""
    return pipeline.agg(F.count(F.when(col("site_status") == "acquired_integrating", 1)).alias("integrating_sites"),
                        F.sum((col("completeness_pct") < 80).cast("int")).alias("below_80_pct"),
                        F.sum("stalled_flag").alias("stalled_sites"))


def reconciliation_status(sites: DataFrame, exceptions: DataFrame) -> DataFrame:
    """Acquired sites and open exceptions (one row)."""
    a = sites.agg(F.count(F.when(col("source_system") == "acquired_import", 1)).alias("acquired_sites"))
    e = exceptions.agg(F.count(F.lit(1))).scalar()
    return a.select("acquired_sites", e.alias("open_exceptions"))
