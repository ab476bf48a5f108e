"""What-if growth, sensitivity grid, relocation matching, change impact
(SURVEY §2.H).  All re-projections run on the unrounded per-site trend, so a
factor of 1 reproduces the capacity collision exactly."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headroom.functions.numeric import round_half_up
from headroom.functions.projection import WALL
from headroom.operators.projection import COLLISION_COLUMNS, _project_sites, with_site_binding

col = F.col

# Adjacency of the driver's five world regions, to rank relocation targets (symmetric).
WORLD_REGION_ADJACENCY = {
    "AFRICA": ["EUROPE", "MIDDLE EAST"],
    "AMERICA": ["ASIA", "EUROPE"],
    "ASIA": ["AMERICA", "MIDDLE EAST"],
    "EUROPE": ["AFRICA", "AMERICA", "MIDDLE EAST"],
    "MIDDLE EAST": ["AFRICA", "ASIA", "EUROPE"],
}
GRID_MAX = 3.0      # fixed values: the slider range 0..3 in steps of 0.25
GRID_STEP = 0.25


def adjacency_frame(spark, adjacency: dict[str, list[str]]) -> DataFrame:
    rows = [(a, b) for a, bs in adjacency.items() for b in bs]
    return spark.createDataFrame(rows, "region string, adjacent_region string")


def what_if(trend: DataFrame, multipliers: DataFrame | None = None) -> DataFrame:
    """H1: the collision re-projected with per-site growth factors (default 1)."""
    if multipliers is None:
        t = trend.withColumn("growth_multiplier", F.lit(1.0))
    else:
        t = (trend.join(multipliers.select("site_id", col("factor").cast("double").alias("f")), "site_id", "left")
             .withColumn("growth_multiplier", F.coalesce("f", F.lit(1.0))).drop("f"))
    out = _project_sites(t, col("growth_multiplier"))
    return out.select(*COLLISION_COLUMNS[:3], "growth_multiplier", *COLLISION_COLUMNS[3:], "binding_breach_q")


def scenario_grid(trend: DataFrame) -> DataFrame:
    """H2: every site at every slider factor 0..3 (step 0.25): a sensitivity table."""
    n = int(GRID_MAX / GRID_STEP)
    t = trend.select("*", F.explode(F.sequence(F.lit(0), F.lit(n))).alias("step")) \
        .withColumn("growth_multiplier", col("step") * F.lit(GRID_STEP))
    t = with_site_binding(t, col("growth_multiplier"), out="b_")
    return t.select("site_id", "site_name", "growth_multiplier",
                    col("b_name").alias("binding_constraint"), col("b_periods").alias("binding_quarters_to_wall"),
                    col("b_breach").alias("binding_breach_quarter"), col("b_status").alias("binding_status"))


def relocation(scenario_trend: DataFrame, adjacency: DataFrame) -> DataFrame:
    """H3: for each site with a binding constraint, the best site to absorb its
    two-period overflow on that constraint: same region, then adjacent, then
    any; within a tier the most slack (ties: lowest site id).

    Only a region's top-slack candidate can win inside that region and the
    slack threshold is monotone, so candidates reduce to one champion per
    (constraint, region) before they meet the at-risk sites.
    """
    t = scenario_trend
    m = col("growth_multiplier") if "growth_multiplier" in t.columns else F.lit(1.0)
    t = with_site_binding(t, m, out="b_").withColumnRenamed("b_name", "bind")
    units = {"floor": ("available_sqft", "last_sqft", "growth_sqft", "sq ft"),
             "power": ("available_kw", "last_kw", "growth_kw", "kW")}

    def per_constraint(name):
        cap, last, growth, unit = units[name]
        return F.struct(F.lit(name).alias("constraint"), F.lit(unit).alias("unit"),
                        col(cap).cast("double").alias("cap"), col(last).alias("last"),
                        (col(growth) * m).alias("growth"))

    # champions: non-binding sites with known capacity, best slack per (constraint, region)
    cand = (t.where(col("bind") == "none")
            .select("site_id", "site_name", "region",
                    F.explode(F.array(per_constraint("floor"), per_constraint("power"))).alias("c"))
            .where(col("c.cap").isNotNull() & col("c.last").isNotNull())
            .select(col("c.constraint").alias("constraint"), "region", "site_id", "site_name",
                    (F.lit(WALL) * col("c.cap") - col("c.last")).alias("slack")))
    champs = (cand.groupBy("constraint", "region")
              .agg(F.max(F.struct("slack", (-col("site_id")).alias("neg_id"), "site_id", "site_name")).alias("b"))
              .select("constraint", col("region").alias("c_region"), col("b.slack").alias("slack"),
                      col("b.site_id").alias("target_site_id"), col("b.site_name").alias("target_site_name")))
    risk = t.where(col("bind").isin("floor", "power"))
    pick = F.when(col("bind") == "power", per_constraint("power")).otherwise(per_constraint("floor"))
    risk = risk.select("site_id", "site_name", "region", pick.alias("c"))
    over = (col("c.last") + 2 * col("c.growth")) - F.lit(WALL) * col("c.cap")
    risk = risk.select("site_id", "region", col("c.constraint").alias("constraint"), col("c.unit").alias("unit"),
                       F.when(F.greatest(F.lit(0.0), over) <= 0, F.lit(1.0)).otherwise(over).alias("overflow"))
    adj = adjacency.select(col("region").alias("region"), col("adjacent_region").alias("c_region"),
                           F.lit(1).alias("adj"))
    # champions: one row per (constraint, region) — bounded, so broadcast; a
    # shuffle join on the 2-valued constraint key would put all at-risk sites
    # into two tasks.  The adjacency table is configuration.
    joined = (risk.join(F.broadcast(champs), "constraint").where(col("slack") >= col("overflow"))
              .join(F.broadcast(adj), ["region", "c_region"], "left"))
    tier = (F.when(col("c_region").eqNullSafe(col("region")), 0)
            .when(col("adj").isNotNull(), 1).otherwise(2))
    best = (joined.groupBy("site_id", "constraint", "unit", "overflow", "region")
            .agg(F.min(F.struct(tier.alias("tier"), (-col("slack")).alias("neg_slack"), "target_site_id",
                                "target_site_name", "c_region", "slack")).alias("b")))
    return best.select("site_id", col("b.target_site_id").alias("target_site_id"),
                       col("b.target_site_name").alias("target_site_name"),
                       col("b.c_region").alias("target_region"), "constraint", "unit",
                       round_half_up("overflow", 0).alias("overflow"),
                       round_half_up(col("b.slack"), 0).alias("slack"),
                       col("b.c_region").eqNullSafe(col("region")).alias("same_region"))


def change_impact(trend: DataFrame, programs: DataFrame, changes: DataFrame,
                  delay_by_site: DataFrame) -> DataFrame:
    """H4: per requested (program, new target): the primary site's binding
    constraint, breach and cost of delay before and after scaling its growth by
    new target / baseline target (baseline = target, else current output)."""
    base = F.coalesce(F.when(col("units_per_quarter_target") != 0, col("units_per_quarter_target")),
                      F.when(col("units_per_quarter_current") != 0, col("units_per_quarter_current")))
    ch = (changes.select("program_name", col("target").alias("new_target"))
          .join(programs.select("program_name", col("primary_site_id").alias("site_id"), base.alias("baseline")),
                "program_name")
          .where(col("baseline").isNotNull())
          .withColumn("growth_multiplier", col("new_target").cast("double") / col("baseline")))
    df = ch.join(trend, "site_id").join(delay_by_site, "site_id", "left")
    df = with_site_binding(df, None, out="bb_")
    df = with_site_binding(df, col("growth_multiplier"), out="ba_")
    dc = col("delay_cost_per_quarter_usd")
    df = df.select("*", round_half_up(dc * col("bb_periods"), 0).alias("cod_b"),
                   round_half_up(dc * col("ba_periods"), 0).alias("cod_a"))
    changed = ((~col("bb_name").eqNullSafe(col("ba_name"))) | (~col("bb_breach").eqNullSafe(col("ba_breach")))
               | (~col("cod_b").eqNullSafe(col("cod_a"))))
    return df.select("program_name", "new_target", "site_id", "site_name", "growth_multiplier",
                     col("bb_name").alias("constraint_before"), col("ba_name").alias("constraint_after"),
                     col("bb_breach").alias("breach_before"), col("ba_breach").alias("breach_after"),
                     col("cod_b").alias("cost_of_delay_before"), col("cod_a").alias("cost_of_delay_after"),
                     changed.alias("changed"))
