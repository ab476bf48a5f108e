"""Time-to-the-wall projection.

Cost shape: the only heavy step is the aggregation of demand facts to
(site, period) — a partial (map-side) aggregation, so a hot site collapses to
one row per map task before the shuffle.  Everything after works on the
site x period result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headroom.functions.numeric import pct, round_half_up
from headroom.functions.period import q_index_of_label, q_label, q_first_date, q_start_day
from headroom.functions.projection import OUTPUTS, with_binding, with_projection

col = F.col


def endpoint_trend(df: DataFrame, keys: list[str], period: str, values: list[str]) -> DataFrame:
    """Per key: first/last period, the value at each end and the endpoint growth
    ``(last - first) / (last_q - first_q)`` (0 for a single period).  One
    aggregation replaces the self-joins on the bounds."""
    aggs = [F.min(period).alias("first_q"), F.max(period).alias("last_q")]
    for v in values:
        aggs += [F.min_by(v, period).alias(f"first_{v}"), F.max_by(v, period).alias(f"last_{v}")]
    t = df.groupBy(*keys).agg(*aggs)
    span = col("last_q") - col("first_q")
    for v in values:
        t = t.withColumn(f"growth_{v}",
                         F.when(span == 0, F.lit(0.0))
                         .otherwise((col(f"last_{v}") - col(f"first_{v}")).cast("double")
                                    / F.when(span != 0, span)))
    return t


def demand_by_period(demand: DataFrame) -> DataFrame:
    """Σ units x per-unit footprint per (site, period) for floor and power."""
    return (demand.groupBy("site_id", "q_index")
            .agg(F.sum(col("units_planned") * col("sqft_per_unit")).alias("demanded_sqft"),
                 F.sum(col("units_planned") * col("kw_per_unit")).alias("demanded_kw")))


def collision_trend(sites: DataFrame, demand: DataFrame) -> DataFrame:
    """Unrounded per-site trend joined to capacities (inner: a site without a
    plan is absent)."""
    t = endpoint_trend(demand_by_period(demand), ["site_id"], "q_index", ["demanded_sqft", "demanded_kw"])
    s = sites.select("site_id", "site_name", "region", col("sq_ft").alias("available_sqft"),
                     col("power_kw_capacity").alias("available_kw"))
    return t.join(s, "site_id").select(
        "site_id", "site_name", "region", "available_sqft", "available_kw", "last_q",
        col("last_demanded_sqft").alias("last_sqft"), col("growth_demanded_sqft").alias("growth_sqft"),
        col("last_demanded_kw").alias("last_kw"), col("growth_demanded_kw").alias("growth_kw"))


def with_site_binding(t: DataFrame, multiplier=None, out: str = "b_", keep: bool = False) -> DataFrame:
    """Project floor and power of a collision-trend row at a growth factor and
    add the binding constraint as ``{out}name/periods/breach/status``."""
    m = F.lit(1.0) if multiplier is None else multiplier
    f, p = f"{out}f_", f"{out}p_"
    df = with_projection(t, f, "available_sqft", "last_sqft", col("growth_sqft") * m, "last_q")
    df = with_projection(df, p, "available_kw", "last_kw", col("growth_kw") * m, "last_q")
    df = with_binding(df, [("power", p), ("floor", f)], default="floor", out=out)
    return df if keep else df.drop(*[f"{x}{o}" for x in (f, p) for o in OUTPUTS])


def _project_sites(t: DataFrame, multiplier=None) -> DataFrame:
    df = with_site_binding(t, multiplier, out="b_", keep=True)
    f, p = "b_f_", "b_p_"
    return df.select(
        *t.columns,
        q_label("last_q").alias("latest_quarter"),
        round_half_up("last_sqft", 0).alias("latest_demanded_sqft"),
        round_half_up(col("growth_sqft"), 0).alias("growth_sqft_per_quarter"),
        col(f"{f}util_pct").alias("current_util_pct"),
        col(f"{f}util_2q_pct").alias("projected_util_2q_pct"),
        col(f"{f}periods").alias("quarters_to_wall"),
        col(f"{f}breach").alias("projected_breach_quarter"),
        col(f"{f}status").alias("collision_status"),
        round_half_up("last_kw", 0).alias("latest_demanded_kw"),
        round_half_up(col("growth_kw"), 0).alias("growth_kw_per_quarter"),
        col(f"{p}util_pct").alias("power_util_pct"),
        col(f"{p}util_2q_pct").alias("projected_power_util_2q_pct"),
        col(f"{p}periods").alias("power_quarters_to_wall"),
        col(f"{p}breach").alias("power_breach_quarter"),
        col(f"{p}status").alias("power_status"),
        col("b_name").alias("binding_constraint"),
        col("b_periods").alias("binding_quarters_to_wall"),
        col("b_breach").alias("binding_breach_quarter"),
        col("b_status").alias("binding_status"),
        col("b_breach_q").alias("binding_breach_q"),
    )


def breach_index(df: DataFrame, index: str, label: str):
    """The breach period's index: the engine's own integer column where the frame carries it,
    else read from the label (a stored or foreign table)."""
    return col(index) if index in df.columns else q_index_of_label(label)


COLLISION_COLUMNS = [
    "site_id", "site_name", "region", "available_sqft", "latest_quarter", "latest_demanded_sqft",
    "growth_sqft_per_quarter", "current_util_pct", "projected_util_2q_pct", "quarters_to_wall",
    "projected_breach_quarter", "collision_status", "available_kw", "latest_demanded_kw",
    "growth_kw_per_quarter", "power_util_pct", "projected_power_util_2q_pct", "power_quarters_to_wall",
    "power_breach_quarter", "power_status", "binding_constraint", "binding_quarters_to_wall",
    "binding_breach_quarter", "binding_status",
]


def capacity_collision(sites: DataFrame, demand: DataFrame) -> DataFrame:
    """Both constraints projected, the binding one chosen (24 columns, and the binding
    breach's period index for what is computed from it)."""
    return _project_sites(collision_trend(sites, demand)).select(*COLLISION_COLUMNS, "binding_breach_q")


def capacity_vs_demand(sites: DataFrame, demand: DataFrame) -> DataFrame:
    """Demanded floor and power per site x quarter vs the ceilings."""
    d = demand_by_period(demand)
    s = sites.select("site_id", "site_name", "sq_ft", "power_kw_capacity")
    return d.join(s, "site_id").select(
        "site_id", "site_name", q_label("q_index").alias("quarter"),
        col("sq_ft").alias("available_sqft"),
        round_half_up("demanded_sqft", 0).alias("demanded_sqft"),
        pct("demanded_sqft", "sq_ft").alias("floor_utilization_pct"),
        col("power_kw_capacity").alias("available_kw"),
        round_half_up("demanded_kw", 0).alias("demanded_kw"),
        pct("demanded_kw", "power_kw_capacity").alias("power_utilization_pct"))


def program_facility_risk(programs: DataFrame, sites: DataFrame, collision: DataFrame) -> DataFrame:
    """Programs at their primary site's binding constraint, most urgent first."""
    p = programs.select("program_name", "program_type", col("status").alias("program_status"),
                        col("primary_site_id").alias("site_id"),
                        "units_per_quarter_current", "units_per_quarter_target")
    c = collision.select("site_id", "binding_constraint", "binding_status", "binding_breach_quarter",
                         col("binding_quarters_to_wall").alias("quarters_to_constraint"))
    return (p.join(sites.select("site_id", "site_name"), "site_id")
            .join(c, "site_id", "left")
            .select("program_name", "program_type", "program_status", "site_id", "site_name",
                    "units_per_quarter_current", "units_per_quarter_target", "binding_constraint",
                    "binding_status", "binding_breach_quarter", "quarters_to_constraint")
            .orderBy(col("quarters_to_constraint").asc_nulls_last(), "program_name"))


def lease_cliff(sites: DataFrame, collision: DataFrame) -> DataFrame:
    """Days between the lease option deadline and the binding breach.  The window is a
    long counted from the period index, so it holds for a breach in any year; ``breach_date`` is
    null from the year 10000 on."""
    c = collision.select("site_id", "binding_constraint", "binding_breach_quarter",
                         breach_index(collision, "binding_breach_q", "binding_breach_quarter").alias("breach_q"))
    df = (sites.select("site_id", "site_name", "lease_expiration_date", "lease_option_deadline")
          .join(c, "site_id", "left")
          .withColumn("breach_date", q_first_date("breach_q")))
    window = q_start_day("breach_q") - F.unix_date("lease_option_deadline")
    return df.select(
        "site_id", "site_name", "lease_expiration_date", "lease_option_deadline", "binding_constraint",
        "binding_breach_quarter", "breach_date", window.alias("decision_window_days"),
        F.when(col("lease_option_deadline").isNull(), "no lease cliff")
        .when(col("breach_q").isNull(), "no breach projected")
        .when(window < 180, "AT RISK").otherwise("ok").alias("cliff_status"))


def cost_of_delay(actions: DataFrame, sites: DataFrame, collision: DataFrame) -> DataFrame:
    """Act now vs at the wall, for remedies on file at sites with a breach."""
    c = collision.where(col("binding_quarters_to_wall").isNotNull()).select(
        "site_id", col("binding_constraint").alias("constraint_type"),
        col("binding_breach_quarter").alias("breach_quarter"),
        col("binding_quarters_to_wall").alias("quarters_to_wall"))
    a = actions.where(col("est_remedy_cost_usd").isNotNull()).select(
        "action_id", "site_id", "title", "est_remedy_cost_usd", "est_delay_cost_usd_per_quarter")
    delay = col("est_delay_cost_usd_per_quarter") * col("quarters_to_wall")
    return (a.join(sites.select("site_id", "site_name"), "site_id").join(c, "site_id")
            .select("action_id", "site_id", "site_name", "title", "constraint_type", "breach_quarter",
                    "quarters_to_wall",
                    round_half_up("est_remedy_cost_usd", 0).alias("cost_act_now_usd"),
                    round_half_up(col("est_remedy_cost_usd") + delay, 0).alias("cost_act_at_wall_usd"),
                    round_half_up(delay, 0).alias("cost_of_delay_usd"),
                    col("est_delay_cost_usd_per_quarter").cast("double").alias("delay_cost_per_quarter_usd")))

