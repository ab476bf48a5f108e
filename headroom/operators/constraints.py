"""Any number of ceilings per site.

A constraint is data: a row of ``constraints`` (``constraint, priority, unit, is_default``), a capacity per site and an amount
per site and period.  Everything is projected once in long form, a row per (site, constraint); the binding constraint is the
minimum of (periods to the wall, priority) over a site's rows, so a further ceiling needs no code.  A site with no
projected breach binds on ``none`` and has the status of its default constraint.

The heavy step is the aggregation of facts to (site, period), done once for all constraints before their rows are spread; from there on
the tables have sites times constraints rows.  ``constraints`` is configuration and broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headroom.functions.numeric import round_half_up
from headroom.functions.period import q_label
from headroom.functions.projection import WALL, with_projection
from headroom.operators.projection import endpoint_trend

col = F.col

CONSTRAINTS = "constraint string, priority int, unit string, is_default int"


def spread(wide: DataFrame, keys: list[str], columns: dict[str, str], value: str) -> DataFrame:
    """``keys, constraint, value`` from one column per constraint."""
    pairs = F.array(*[F.struct(F.lit(name).alias("constraint"), col(c).cast("double").alias(value)) for name, c in columns.items()])
    return wide.select(*keys, F.explode(pairs).alias("x")).select(*keys, "x.*")


def trends(demand: DataFrame, capacity: DataFrame, sites: DataFrame, constraints: DataFrame) -> DataFrame:
    """Endpoint trend per (site, constraint) of ``demand`` (``site_id, q_index, constraint, amount``, a row per period) with
    its capacity (null: unknown).  Amounts and capacities of constraints that are not listed are an error of the caller's and left out."""
    known = F.broadcast(constraints.select("constraint", "priority", "unit", "is_default"))
    t = endpoint_trend(demand, ["site_id", "constraint"], "q_index", ["amount"])
    return (t.join(known, "constraint").join(sites.select("site_id", "site_name", "region"), "site_id")
            .join(capacity.select("site_id", "constraint", col("capacity").cast("double").alias("capacity")), ["site_id", "constraint"], "left")
            .select("site_id", "site_name", "region", "constraint", "priority", "unit", "is_default", "capacity", "last_q",
                    col("last_amount").alias("last"), col("growth_amount").alias("growth")))


def project(t: DataFrame, multiplier: Column | None = None) -> DataFrame:
    """Every row's ``util_pct, util_2q_pct, periods, breach_q, breach, status`` at a growth factor."""
    m = F.lit(1.0) if multiplier is None else multiplier
    return with_projection(t, "", "capacity", "last", col("growth") * m, "last_q")


def binding(projected: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Per site (or ``keys``): ``binding_constraint, binding_quarters_to_wall, binding_breach_q, binding_breach_quarter, binding_status``."""
    first = F.min(F.when(col("periods").isNotNull(), F.struct("periods", "priority", "constraint", "breach_q", "breach", "status")))
    b = projected.groupBy(*(keys or ["site_id"])).agg(first.alias("b"), F.max_by("status", "is_default").alias("otherwise"))
    return b.select(*(keys or ["site_id"]), F.coalesce("b.constraint", F.lit("none")).alias("binding_constraint"),
                    col("b.periods").alias("binding_quarters_to_wall"), col("b.breach_q").alias("binding_breach_q"),
                    col("b.breach").alias("binding_breach_quarter"), F.coalesce("b.status", "otherwise").alias("binding_status"))


def collision(t: DataFrame, multiplier: Column | None = None) -> DataFrame:
    """D8 in long form: a row per (site, constraint) with its projection, and whether it binds its site."""
    p = project(t, multiplier)
    b = binding(p).select("site_id", "binding_constraint", "binding_quarters_to_wall", "binding_breach_quarter", "binding_status")
    return p.join(b, "site_id").select(
        "site_id", "site_name", "region", "constraint", "capacity", q_label("last_q").alias("latest_quarter"),
        round_half_up("last", 0).alias("latest_demand"), round_half_up("growth", 0).alias("growth_per_quarter"),
        "util_pct", "util_2q_pct", col("periods").alias("quarters_to_wall"), col("breach").alias("breach_quarter"), "status",
        (col("constraint") == col("binding_constraint")).cast("int").alias("is_binding"), "binding_constraint",
        "binding_quarters_to_wall", "binding_breach_quarter", "binding_status")


def side_by_side(long: DataFrame, constraints: list[str], values: list[str]) -> DataFrame:
    """One row per site: ``<constraint>_<value>`` columns of a collision, and the binding constraint."""
    own = ["site_id", "site_name", "region", "binding_constraint", "binding_quarters_to_wall", "binding_breach_quarter", "binding_status"]
    return long.groupBy(*own).pivot("constraint", constraints).agg(*[F.first(v, ignorenulls=True).alias(v) for v in values])


def what_if(t: DataFrame, factors: DataFrame) -> DataFrame:
    """H1: the collision with growth times ``factor`` per site, or per (site, constraint) if ``factors`` names constraints (default 1)."""
    on = ["site_id"] + (["constraint"] if "constraint" in factors.columns else [])
    t = t.join(factors.select(*on, col("factor").cast("double").alias("f")), on, "left")
    return collision(t.withColumn("growth", col("growth") * F.coalesce("f", F.lit(1.0))).drop("f"))


def relocation(t: DataFrame, adjacency: DataFrame) -> DataFrame:
    """H3: for each site bound by a constraint, the best site to take its two-period overflow of that constraint: same region, then
    adjacent, then any; then the most slack (ties: lowest id).  Within a region only the top slack can win, so candidates shrink to one
    champion per (constraint, region) before they meet the sites at risk."""
    p = project(t)
    bound = p.join(binding(p).select("site_id", "binding_constraint"), "site_id")
    champions = (bound.where((col("binding_constraint") == "none") & col("capacity").isNotNull())
                 .select("constraint", "region", "site_id", "site_name", (F.lit(WALL) * col("capacity") - col("last")).alias("slack"))
                 .groupBy("constraint", "region").agg(F.max(F.struct("slack", (-col("site_id")).alias("o"), "site_id", "site_name")).alias("b"))
                 .select("constraint", col("region").alias("c_region"), col("b.slack").alias("slack"), col("b.site_id").alias("target_site_id"),
                         col("b.site_name").alias("target_site_name")))
    over = col("last") + 2 * col("growth") - F.lit(WALL) * col("capacity")
    risk = bound.where(col("constraint") == col("binding_constraint")).select(
        "site_id", "region", "constraint", "unit", F.when(over > 0, over).otherwise(1.0).alias("overflow"))
    adj = adjacency.select("region", col("adjacent_region").alias("c_region"), F.lit(1).alias("adjacent"))
    # champions: a row per configured constraint and region; a shuffle on the constraint would put all sites into a few tasks
    met = (risk.join(F.broadcast(champions), "constraint").where(col("slack") >= col("overflow"))
           .join(F.broadcast(adj), ["region", "c_region"], "left"))
    tier = F.when(col("c_region").eqNullSafe(col("region")), 0).when(col("adjacent").isNotNull(), 1).otherwise(2)
    best = met.groupBy("site_id", "region", "constraint", "unit", "overflow").agg(
        F.min(F.struct(tier.alias("tier"), (-col("slack")).alias("o"), "target_site_id", "target_site_name", "c_region", "slack")).alias("b"))
    return best.select("site_id", "b.target_site_id", "b.target_site_name", col("b.c_region").alias("target_region"), "constraint", "unit",
                       round_half_up("overflow", 0).alias("overflow"), round_half_up("b.slack", 0).alias("slack"),
                       col("b.c_region").eqNullSafe(col("region")).alias("same_region"))


def change_impact(t: DataFrame, programs: DataFrame, changes: DataFrame, delay_by_site: DataFrame) -> DataFrame:
    """H4: per (program, new target) the site's binding constraint, breach and cost of delay before and after its growth is
    scaled by new target / baseline (baseline: target, else current output; programs with neither are left out)."""
    base = F.coalesce(F.when(col("units_per_quarter_target") != 0, col("units_per_quarter_target")),
                      F.when(col("units_per_quarter_current") != 0, col("units_per_quarter_current")))
    ch = (changes.select("program_name", col("target").alias("new_target"))
          .join(programs.select("program_name", col("primary_site_id").alias("site_id"), base.alias("baseline")), "program_name")
          .where(col("baseline").isNotNull())
          .select("program_name", "new_target", "site_id", (col("new_target").cast("double") / col("baseline")).alias("growth_multiplier")))
    rows = ch.join(t, "site_id")
    keys = ["program_name", "new_target", "site_id", "site_name", "growth_multiplier"]

    def bound(p: DataFrame, when: str) -> DataFrame:
        b = binding(p, keys)
        return b.select(*keys, *[col(f"binding_{c}").alias(f"{c}_{when}") for c in ("constraint", "quarters_to_wall", "breach_quarter")])

    both = bound(project(rows), "before").join(bound(project(rows, col("growth_multiplier")), "after"), keys).join(
        delay_by_site.select("site_id", col("delay_cost_per_quarter_usd").alias("d")), "site_id", "left")
    cost = [round_half_up(col("d") * col(f"quarters_to_wall_{w}"), 0).alias(f"cost_of_delay_{w}") for w in ("before", "after")]
    out = both.select(*keys, "constraint_before", "constraint_after", col("breach_quarter_before").alias("breach_before"),
                      col("breach_quarter_after").alias("breach_after"), *cost)
    changed = None
    for what in ("constraint", "breach", "cost_of_delay"):
        differs = ~col(f"{what}_before").eqNullSafe(col(f"{what}_after"))
        changed = differs if changed is None else changed | differs
    return out.withColumn("changed", changed)
