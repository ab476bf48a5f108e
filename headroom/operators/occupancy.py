"""Occupancy: N demand curves per space type.

``by`` adds leading grouping keys (e.g. a snapshot cut-off) so the same
operators evaluate several what-was-known-when runs in one pass over the facts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from headroom.functions.numeric import round_half_up, safe_ratio
from headroom.functions.period import q_label
from headroom.functions.projection import CEIL_FUDGE, WALL, with_projection
from headroom.operators.projection import endpoint_trend

col = F.col

DAYS_PER_QUARTER = 91.0
PENDING = "data pending — audit"
PLANNED = "planned supply"
STAGE_RANK = {"design_approval": 1, "construction": 2, "inspection": 3, "accreditation": 4}


def _stage_rank(c):
    expr = F.lit(5)
    for name, rank in reversed(list(STAGE_RANK.items())):
        expr = F.when(col(c) == name, F.lit(rank)).otherwise(expr)
    return expr


def space_demand(headcount: DataFrame, reqs: DataFrame, archetypes: DataFrame, ratio_map: DataFrame,
                 space_types: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Staff demand (carried forward) + pipeline demand (cumulative)
    per (site, space type, period)."""
    by = list(by or [])
    keys = by + ["site_id", "space_type_id"]
    m = F.broadcast(ratio_map.select("archetype_id", "space_type_id", "ratio"))   # config: bounded
    arch = F.broadcast(archetypes.select("archetype_id", col("name").alias("archetype")))
    hc = (headcount.join(arch, "archetype").join(m, "archetype_id")
          .select(*by, "site_id", "space_type_id", "q_index",
                  (col("headcount") * col("ratio")).alias("hc_units"), F.lit(None).cast("double").alias("pipe_units")))
    fill_q = (col("avg_time_to_fill_days") / DAYS_PER_QUARTER + CEIL_FUDGE).cast("int")
    pipe = (reqs.join(m, "archetype_id")
            .select(*by, "site_id", "space_type_id", (col("q_index") + fill_q).alias("q_index"),
                    F.lit(None).cast("double").alias("hc_units"), (col("open_reqs") * col("ratio")).alias("pipe_units")))
    # one aggregation builds the spine (E3) with both parts per period
    spine = (hc.unionByName(pipe).groupBy(*keys, "q_index")
             .agg(F.sum("hc_units").alias("hc_units"), F.sum("pipe_units").alias("pipe_units")))
    w = Window.partitionBy(*keys).orderBy("q_index").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = spine.select(*keys, "q_index",
                     F.coalesce(F.last("hc_units", ignorenulls=True).over(w), F.lit(0.0)).alias("dh"),
                     F.coalesce(F.sum("pipe_units").over(w), F.lit(0.0)).alias("dp"))
    st = F.broadcast(space_types.select("space_type_id", col("name").alias("space_type"), "unit_label",
                                        "restricted_sensing"))
    return d.join(st, "space_type_id").select(
        *by, "site_id", "space_type_id", "space_type", "unit_label", "restricted_sensing",
        q_label("q_index").alias("quarter"), "q_index",
        round_half_up("dh", 2).alias("demanded_from_headcount"),
        round_half_up("dp", 2).alias("demanded_from_pipeline"),
        round_half_up(col("dh") + col("dp"), 2).alias("demanded_units"))


def space_events(headcount: DataFrame, reqs: DataFrame, archetypes: DataFrame, ratio_map: DataFrame) -> DataFrame:
    """What is known when: units per (site, space type) by the period the fact was recorded in (``known_q``)
    and the one it counts from (``at_q``: the same for staff, fill time later for a requisition).

    Dealt by site once: the sums here, the running values of ``running_trend`` and the window over a site's
    spaces in ``project_spaces`` all find their rows together, so the history is not shuffled between them."""
    m = F.broadcast(ratio_map.select("archetype_id", "space_type_id", "ratio"))   # config: bounded
    arch = F.broadcast(archetypes.select("archetype_id", col("name").alias("archetype")))
    staff = (headcount.join(arch, "archetype").join(m, "archetype_id")
             .select("site_id", "space_type_id", col("q_index").alias("known_q"), col("q_index").alias("at_q"),
                     (col("headcount") * col("ratio")).alias("staff"), F.lit(None).cast("double").alias("hires")))
    fill_q = (col("avg_time_to_fill_days") / DAYS_PER_QUARTER + CEIL_FUDGE).cast("int")
    hires = (reqs.join(m, "archetype_id")
             .select("site_id", "space_type_id", col("q_index").alias("known_q"), (col("q_index") + fill_q).alias("at_q"),
                     F.lit(None).cast("double").alias("staff"), (col("open_reqs") * col("ratio")).alias("hires")))
    return (staff.unionByName(hires).repartition("site_id").groupBy("site_id", "space_type_id", "known_q", "at_q")
            .agg(F.sum("staff").alias("staff"), F.sum("hires").alias("hires")))


def running_trend(events: DataFrame, until_q: int) -> DataFrame:
    """The endpoint trend of every (site, space type) as it read at the start of every period up to ``until_q``
    (``cut_q``: facts recorded before it are known), with the columns of ``endpoint_trend`` over ``demanded_units``.

    One pass without a copy of the facts per cut-off.  The trend's two ends follow from running values over
    the periods in which a key learnt something: its last demand is the newest staff figure plus all hires so
    far, its last period the farthest reached; its first period is the running minimum, and the hires that count
    at it are the running sum of those that hit the minimum while it stood (a lower minimum starts a new sum).
    A state holds from the period after it was learnt to the next one that changes it, so each is spread over
    those cut-offs at the end: the output, one row per key and cut-off, is all that grows."""
    keys = ["site_id", "space_type_id"]
    step = (events.groupBy(*keys, "known_q")
            .agg(F.sum("staff").alias("staff"), F.sum("hires").alias("hires"),
                 F.min(F.when(col("hires").isNotNull(), F.struct("at_q", "hires"))).alias("near"),
                 F.max("at_q").alias("far"))
            .select(*keys, "known_q", "staff", "hires", "far", col("near.at_q").alias("near_q"),
                    col("near.hires").alias("near_units")))
    order = Window.partitionBy(*keys).orderBy("known_q")
    w = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    step = step.select(
        *keys, "known_q", "near_q", "near_units", F.lead("known_q").over(order).alias("next_q"),
        F.min("near_q").over(w).alias("hires_from"), F.max("far").over(w).alias("last_q"),
        F.coalesce(F.sum("hires").over(w), F.lit(0.0)).alias("all_hires"),
        F.last("staff", ignorenulls=True).over(w).alias("staff_now"),
        F.first("staff", ignorenulls=True).over(w).alias("staff_then"),
        F.min(F.when(col("staff").isNotNull(), col("known_q"))).over(w).alias("staff_from"))
    stood = (Window.partitionBy(*keys, "hires_from").orderBy("known_q")
             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    step = step.select("*", F.sum(F.when(col("near_q") == col("hires_from"), col("near_units"))).over(stood).alias("hires_then"))
    step = step.select("*", F.least("staff_from", "hires_from").alias("first_q"))
    step = step.select("*", round_half_up(F.coalesce("staff_now", F.lit(0.0)) + col("all_hires"), 2).alias("last_demanded_units"),
                       round_half_up(F.when(col("staff_from") == col("first_q"), col("staff_then")).otherwise(0.0)
                                     + F.when(col("hires_from") == col("first_q"), col("hires_then")).otherwise(0.0), 2)
                       .alias("first_demanded_units"))
    span = col("last_q") - col("first_q")
    growth = F.when(span == 0, F.lit(0.0)).otherwise((col("last_demanded_units") - col("first_demanded_units"))
                                                     / F.when(span != 0, span))
    cuts = F.sequence(col("known_q") + 1, F.least(F.coalesce(col("next_q"), F.lit(until_q)), F.lit(until_q)))
    return (step.where(col("known_q") < until_q)
            .select(*keys, "first_q", "last_q", "first_demanded_units", "last_demanded_units",
                    growth.alias("growth_demanded_units"), F.explode(cuts).alias("cut_q")))


def space_collision(demand: DataFrame, sites: DataFrame, space_types: DataFrame, capacity: DataFrame,
                    by: list[str] | None = None) -> DataFrame:
    """The projection per (site, space type) gated by capacity status;
    ``is_binding`` marks the space that reaches its wall first at each site."""
    by = list(by or [])
    keys = by + ["site_id", "space_type_id"]
    t = endpoint_trend(demand, keys, "q_index", ["demanded_units"])
    return project_spaces(t, sites, space_types, capacity, by)


def project_spaces(t: DataFrame, sites: DataFrame, space_types: DataFrame, capacity: DataFrame,
                   by: list[str] | None = None) -> DataFrame:
    """Trends per (``by``, site, space type) to their walls; see ``space_collision``."""
    by = list(by or [])
    st = F.broadcast(space_types.select("space_type_id", col("name").alias("space_type"), "unit_label",
                                        "lead_time_days", "restricted_sensing"))
    df = (t.join(sites.select("site_id", "site_name"), "site_id")
          .join(st, "space_type_id")
          .join(capacity.select("site_id", "space_type_id", "capacity", "capacity_status"),
                ["site_id", "space_type_id"]))
    cap, status = col("capacity"), col("capacity_status")
    last, growth = col("last_demanded_units"), col("growth_demanded_units")
    df = with_projection(df, "p_", cap, last, growth, "last_q", known=(status == "confirmed"))
    space_status = (F.when(cap.isNull() | (status == "audit_pending"), PENDING)
                    .when(status == "planned", PLANNED)
                    .when(cap == 0, PENDING)
                    .otherwise(col("p_status")))
    supportable = F.when(cap.isNull() | (cap == 0) | (status == "audit_pending"), F.lit(None)) \
        .otherwise(round_half_up(F.lit(WALL) * cap, 0))
    df = df.select(*by, "site_id", "site_name", "space_type_id", "space_type", "unit_label", "lead_time_days",
                   "restricted_sensing", "capacity", "capacity_status",
                   q_label("last_q").alias("latest_quarter"),
                   round_half_up(last, 1).alias("latest_demanded_units"),
                   round_half_up(growth, 2).alias("growth_per_quarter"),
                   col("p_util_pct").alias("current_util_pct"),
                   col("p_util_2q_pct").alias("projected_util_2q_pct"),
                   col("p_periods").alias("quarters_to_wall"),
                   col("p_breach").alias("breach_quarter"), col("p_breach_q").alias("breach_q"),
                   space_status.alias("space_status"),
                   supportable.alias("supportable_units"))
    # at most a handful of space types per site: a small window per site
    wb = Window.partitionBy(*by, "site_id").orderBy(col("quarters_to_wall").asc_nulls_last(), "space_type_id")
    return df.withColumn("is_binding", F.when(col("quarters_to_wall").isNotNull()
                                              & (F.row_number().over(wb) == 1), 1).otherwise(0))


def time_to_seat(reqs: DataFrame, archetypes: DataFrame, sites: DataFrame, collision: DataFrame,
                 ratio_map: DataFrame) -> DataFrame:
    """Newest requisition per (site, archetype; ties go to the highest ``req_id``, then the larger values) vs the lead time of the
    site's binding space."""
    order = F.struct("q_index", *(["req_id"] if "req_id" in reqs.columns else []), "open_reqs", "avg_time_to_fill_days")
    latest = (reqs.groupBy("site_id", "archetype_id")
              .agg(F.max_by(F.struct("avg_time_to_fill_days", "open_reqs"), order).alias("r"))
              .select("site_id", "archetype_id", col("r.open_reqs").alias("open_reqs"),
                      col("r.avg_time_to_fill_days").alias("time_to_fill_days")))
    b = collision.where(col("is_binding") == 1).select(
        "site_id", col("space_type_id").alias("b_space"), col("space_type").alias("binding_space_type"),
        col("lead_time_days").alias("time_to_seat_days"))
    uses = F.broadcast(ratio_map.where(col("ratio") > 0)
                       .select("archetype_id", col("space_type_id").alias("b_space"), F.lit(1).alias("uses")))
    arch = F.broadcast(archetypes.select("archetype_id", col("name").alias("archetype")))
    df = (latest.join(arch, "archetype_id").join(sites.select("site_id", "site_name"), "site_id")
          .join(b, "site_id", "left").join(uses, ["archetype_id", "b_space"], "left"))
    flag = (F.when(col("b_space").isNotNull() & (col("uses") == 1)
                   & (col("time_to_seat_days") > col("time_to_fill_days")), "facilities_bottleneck")
            .otherwise("ok"))
    return df.select("site_id", "site_name", "archetype", "open_reqs", "time_to_fill_days",
                     "binding_space_type", "time_to_seat_days", flag.alias("bottleneck_flag"))


def latest_period_total(df: DataFrame, value: str, alias: str) -> DataFrame:
    """Per site, Σ value over the site's latest period."""
    per = df.groupBy("site_id", "q_index").agg(F.sum(value).alias("v"))
    return per.groupBy("site_id").agg(F.max_by("v", "q_index").alias(alias))


def plan_reconciliation(headcount: DataFrame, reqs: DataFrame, sites: DataFrame,
                        collision: DataFrame) -> DataFrame:
    """Authorised vs pipeline-implied vs space-supportable headcount."""
    auth = latest_period_total(headcount, "headcount", "authorized_headcount")
    pipe = latest_period_total(reqs, "open_reqs", "open_reqs")
    b = collision.where(col("is_binding") == 1).select(
        "site_id", col("space_type").alias("binding_space_type"), "capacity", "latest_demanded_units")
    df = (auth.join(sites.select("site_id", "site_name"), "site_id")
          .join(pipe, "site_id", "left").join(b, "site_id", "left"))
    implied = col("authorized_headcount") + F.coalesce("open_reqs", F.lit(0))
    supportable = round_half_up(col("authorized_headcount") * safe_ratio(F.lit(WALL) * col("capacity"),
                                                                         "latest_demanded_units"), 0)
    return df.select("site_id", "site_name", "binding_space_type", "authorized_headcount",
                     implied.alias("pipeline_implied_headcount"),
                     supportable.alias("space_supportable_headcount"),
                     F.coalesce("open_reqs", F.lit(0)).alias("delta_pipeline_vs_authorized"),
                     (supportable - implied).alias("delta_supportable_vs_pipeline"))


def _accredited(milestones: DataFrame) -> DataFrame:
    return (milestones.where((col("milestone") == "accreditation") & col("actual_date").isNotNull())
            .select("site_id", "space_type_id").distinct().withColumn("acc", F.lit(1)))


def space_capacity_effective(capacity: DataFrame, space_types: DataFrame, milestones: DataFrame) -> DataFrame:
    """Planned / audit_pending count as confirmed once accredited."""
    st = F.broadcast(space_types.select("space_type_id", col("name").alias("space_type")))
    df = (capacity.join(st, "space_type_id")
          .join(_accredited(milestones), ["site_id", "space_type_id"], "left"))
    done = col("acc").isNotNull()
    return df.select("site_id", "space_type_id", "space_type", "capacity",
                     col("capacity_status").alias("raw_status"),
                     done.cast("int").alias("accreditation_complete"),
                     F.when(col("capacity_status").isin("planned", "audit_pending") & done, "confirmed")
                     .otherwise(col("capacity_status")).alias("effective_status"))


def accreditation_pipeline(milestones: DataFrame, sites: DataFrame, space_types: DataFrame) -> DataFrame:
    """Stage reached, next stage, worst slip and status per (site, space)."""
    met = col("actual_date").isNotNull()
    rank = _stage_rank("milestone")
    agg = (milestones.groupBy("site_id", "space_type_id")
           .agg(F.sum(met.cast("int")).alias("milestones_met"),
                F.count(F.lit(1)).alias("milestones_total"),
                F.max(F.when(met, F.datediff("actual_date", "planned_date"))).alias("slip"),
                F.max(F.when((col("milestone") == "accreditation") & met, 1).otherwise(0))
                .alias("accreditation_complete"),
                F.max(F.when(met, F.struct(rank.alias("r"), col("milestone").alias("m")))).alias("cur"),
                F.min(F.when(~met, F.struct(rank.alias("r"), col("milestone").alias("m")))).alias("nxt")))
    st = F.broadcast(space_types.select("space_type_id", col("name").alias("space_type")))
    return (agg.join(sites.select("site_id", "site_name"), "site_id").join(st, "space_type_id")
            .select("site_id", "site_name", "space_type_id", "space_type", "milestones_met", "milestones_total",
                    col("cur.m").alias("current_stage"), col("nxt.m").alias("next_stage"),
                    F.coalesce("slip", F.lit(0)).alias("max_slip_days"), "accreditation_complete",
                    F.when(col("accreditation_complete") == 1, "accredited — capacity confirmed")
                    .otherwise("in progress — capacity unconfirmed").alias("pipeline_status")))
