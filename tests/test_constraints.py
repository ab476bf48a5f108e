"""Ceilings as data: two equal the wide projection, a third needs no code."""

from headroom.operators import constraints as K
from headroom.operators import projection as P
from headroom.operators import whatif as H

TREND = ("site_id long, site_name string, region string, constraint string, priority int, unit string, is_default int, capacity double, "
         "last_q int, last double, growth double")


def rows(site, region, *three):
    """(capacity, last, growth) of floor, power and a third constraint that no code names."""
    names = [("floor", 2, "sq ft", 1), ("power", 1, "kW", 0), ("water", 3, "l/s", 0)]
    return [(site, f"s{site}", region, *name, *map(lambda v: None if v is None else float(v), (cap,)), 8000, float(last), float(growth))
            for name, (cap, last, growth) in zip(names, three)]


def test_a_third_ceiling_is_data_only(spark):
    quiet = (1000, 10, 0)
    data = rows(1, "ASIA", (1000, 500, 10), (1000, 500, 10), (100, 80, 2))        # water: 3 periods
    data += rows(2, "ASIA", quiet, quiet, (1000, 10, 0))                            # room for water
    data += rows(3, "EUROPE", quiet, (None, 10, 5), quiet)                          # nothing breaks: the default's status
    data += rows(4, None, (1000, 800, 25), (1000, 800, 25), (1000, 800, 25))        # a tie: the lowest priority number
    t = spark.createDataFrame(data, TREND)
    got = {r.site_id: r for r in K.collision(t).where("constraint = 'water'").collect()}
    assert (got[1].binding_constraint, got[1].binding_quarters_to_wall, got[1].binding_status, got[1].is_binding) == ("water", 3, "watch", 1)
    assert (got[3].binding_constraint, got[3].binding_status) == ("none", "stable") and got[4].binding_constraint == "power"
    wide = {r.site_id: r for r in K.side_by_side(K.collision(t), ["floor", "water"], ["util_pct", "quarters_to_wall"]).collect()}
    assert wide[1].water_quarters_to_wall == 3 and wide[1].floor_util_pct == 50.0
    only_water = spark.createDataFrame([(1, "water", 0.0)], "site_id long, constraint string, factor double")
    assert K.what_if(t, only_water).where("site_id = 1 and is_binding = 1").first().constraint == "power"
    moved = {r.site_id: r for r in K.relocation(t, H.adjacency_frame(spark, H.WORLD_REGION_ADJACENCY)).collect()}
    assert (moved[1].constraint, moved[1].target_site_id, moved[1].unit, moved[1].same_region) == ("water", 2, "l/s", True)
    programs = spark.createDataFrame([("p", 1, 10, None), ("none", 1, None, 0)],
                                     "program_name string, primary_site_id long, units_per_quarter_current int, units_per_quarter_target int")
    changes = spark.createDataFrame([("p", 30), ("none", 5)], "program_name string, target int")
    delay = spark.createDataFrame([(1, 100.0)], "site_id long, delay_cost_per_quarter_usd double")
    hit = K.change_impact(t, programs, changes, delay).collect()
    assert len(hit) == 1 and (hit[0].constraint_before, hit[0].cost_of_delay_before, hit[0].cost_of_delay_after, hit[0].changed) == \
        ("water", 300.0, 100.0, True)


def test_two_constraints_equal_the_wide_projection(spark):
    from headroom.sources.driver import DriverCatalog
    cat = DriverCatalog(spark, "/root/testdata/sf0.01", materialize=False)
    two = cat.constraints.where("constraint <> 'dock'")
    long = K.collision(K.trends(cat.constraint_demand, cat.constraint_capacity, cat.sites, two))
    wide = P.capacity_collision(cat.sites, cat.production_demand)
    a = K.side_by_side(long, ["floor", "power"], ["util_pct", "quarters_to_wall", "status"])
    b = wide.select(*a.columns[:7], wide.current_util_pct.alias("floor_util_pct"), wide.quarters_to_wall.alias("floor_quarters_to_wall"),
                    wide.collision_status.alias("floor_status"), wide.power_util_pct, wide.power_quarters_to_wall, wide.power_status)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0 and a.count() == 100
