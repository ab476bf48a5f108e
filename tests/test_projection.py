"""Projection goldens on small in-code frames (time to the wall, binding)."""

import datetime

from pyspark.sql import functions as F

from headroom.operators import projection as P
from headroom.operators import whatif as H

SITES = "site_id long, site_name string, region string, sq_ft long, power_kw_capacity long"
DEMAND = "site_id long, q_index int, units_planned double, sqft_per_unit double, kw_per_unit double"


def q(y, n):
    return y * 4 + n - 1


def collision(spark, sites, demand):
    return {r.site_id: r for r in P.capacity_collision(spark.createDataFrame(sites, SITES),
                                                       spark.createDataFrame(demand, DEMAND)).collect()}


def test_two_constraints_bind_in_different_quarters(spark):
    # floor: 700 -> 800 of 1000 (wall 850), growth 50: (850-800)/50 = 1 quarter -> warning
    # power: 8000 -> 8400 of 10000 (wall 8500), growth 200: 0.5 -> 1 quarter; tie -> power
    sites = [(1, "a", "West", 1000, 10000)]
    demand = [(1, q(2026, 1), 1.0, 700.0, 8000.0), (1, q(2026, 2), 1.0, 750.0, 8200.0),
              (1, q(2026, 3), 1.0, 800.0, 8400.0)]
    r = collision(spark, sites, demand)[1]
    assert r.quarters_to_wall == 1 and r.collision_status == "COLLISION WARNING"
    assert r.projected_breach_quarter == "2026-Q4"
    assert r.binding_constraint == "power"            # tie goes to power
    assert r.binding_breach_quarter == r.power_breach_quarter


def test_floor_binds_first_when_earlier(spark):
    sites = [(1, "a", "West", 1000, 100000)]
    demand = [(1, q(2026, 1), 600.0, 1.0, 1.0), (1, q(2026, 3), 800.0, 1.0, 1.0)]
    r = collision(spark, sites, demand)[1]
    assert r.binding_constraint == "floor" and r.binding_quarters_to_wall == 1
    assert r.power_status == "ok"


def test_stable_pending_and_none(spark):
    sites = [(1, "flat", "West", 1000, 5000), (2, "pending", "West", None, None), (3, "over", "West", 100, 100)]
    demand = [(1, q(2026, 1), 10.0, 1.0, 1.0), (1, q(2026, 2), 10.0, 1.0, 1.0),
              (2, q(2026, 1), 10.0, 1.0, 1.0), (2, q(2026, 2), 20.0, 1.0, 1.0),
              (3, q(2026, 1), 200.0, 1.0, 1.0), (3, q(2026, 2), 150.0, 1.0, 1.0)]
    r = collision(spark, sites, demand)
    assert r[1].binding_constraint == "none" and r[1].binding_status == "stable"
    assert r[2].binding_constraint == "none" and r[2].binding_status.startswith("unknown")
    assert r[2].current_util_pct is None
    # over the wall but shrinking is 'stable' (status order), not 'AT THE WALL NOW'
    assert r[3].collision_status == "stable" and r[3].quarters_to_wall is None


def test_single_period_has_zero_growth(spark):
    r = collision(spark, [(1, "a", "West", 1000, 1000)], [(1, q(2026, 1), 500.0, 1.0, 1.0)])[1]
    assert r.growth_sqft_per_quarter == 0 and r.collision_status == "stable"


def test_at_the_wall_now(spark):
    r = collision(spark, [(1, "a", "West", 1000, None)],
                  [(1, q(2026, 1), 800.0, 1.0, 0.0), (1, q(2026, 2), 900.0, 1.0, 0.0)])[1]
    assert r.quarters_to_wall == 0 and r.collision_status == "AT THE WALL NOW"
    assert r.projected_breach_quarter == "2026-Q2"
    assert r.power_status.startswith("unknown")


def test_what_if_at_one_equals_collision(spark):
    from headroom.plans.registry import Plan
    from headroom.sources.driver import DriverCatalog
    p = Plan(DriverCatalog(spark, "/root/testdata/sf0.001"))
    base = p.collision
    wi = H.what_if(p.trend, None).drop("growth_multiplier")
    assert base.exceptAll(wi).count() == 0 and wi.exceptAll(base).count() == 0


def test_zero_multiplier_removes_breaches(spark):
    from headroom.plans.registry import Plan
    from headroom.sources.driver import DriverCatalog
    p = Plan(DriverCatalog(spark, "/root/testdata/sf0.001"))
    zero = p.cat.sites.select("site_id", F.lit(0.0).alias("factor"))
    out = H.what_if(p.trend, zero)
    assert out.where(F.col("binding_constraint") != "none").count() == 0


def test_lease_cliff_window(spark):
    sites = spark.createDataFrame(
        [(1, "a", datetime.date(2027, 1, 1), datetime.date(2026, 8, 3)),
         (2, "b", None, None), (3, "c", datetime.date(2030, 1, 1), datetime.date(2020, 1, 1))],
        "site_id long, site_name string, lease_expiration_date date, lease_option_deadline date")
    coll = spark.createDataFrame([(1, "floor", "2026-Q4"), (3, "none", None)],
                                 "site_id long, binding_constraint string, binding_breach_quarter string")
    r = {x.site_id: x for x in P.lease_cliff(sites, coll).collect()}
    assert r[1].decision_window_days == 59 and r[1].cliff_status == "AT RISK"
    assert r[2].cliff_status == "no lease cliff"
    assert r[3].cliff_status == "no breach projected"


def test_change_impact_isolates_the_program_site(spark):
    """A target equal to the baseline moves nothing; doubling it changes only
    the program's primary site (faster growth reaches the wall sooner)."""
    sites = spark.createDataFrame([(1, "a", "West", 1000, None), (2, "b", "West", 1000, None)], SITES)
    demand = spark.createDataFrame([(1, q(2026, 1), 1.0, 500.0, 0.0), (1, q(2026, 3), 1.0, 600.0, 0.0),
                                    (2, q(2026, 1), 1.0, 500.0, 0.0), (2, q(2026, 3), 1.0, 600.0, 0.0)], DEMAND)
    trend = P.collision_trend(sites, demand)
    programs = spark.createDataFrame([("Fury", 1, 10, 12)], "program_name string, primary_site_id long, "
                                                            "units_per_quarter_current int, units_per_quarter_target int")
    delay = spark.createDataFrame([(1, 1000.0)], "site_id long, delay_cost_per_quarter_usd double")
    same = H.change_impact(trend, programs, spark.createDataFrame([("Fury", 12)], "program_name string, target int"),
                           delay).collect()
    assert [(r.site_id, r.changed) for r in same] == [(1, False)]
    double = H.change_impact(trend, programs, spark.createDataFrame([("Fury", 24)], "program_name string, target int"),
                             delay).collect()[0]
    # growth 50/quarter -> 100/quarter: (850-600)/50 = 5 quarters -> 3 quarters
    assert (double.site_id, double.growth_multiplier) == (1, 2.0)
    assert (double.breach_before, double.breach_after) == ("2027-Q4", "2027-Q2")
    assert (double.cost_of_delay_before, double.cost_of_delay_after, double.changed) == (5000.0, 3000.0, True)


def test_breaches_thousands_of_years_ahead(spark):
    """A growth so small that the wall lies past the year 9999, and one with more than 2^31 (and 2^53) periods."""
    import datetime
    from headroom.functions.projection import FARTHEST
    from headroom.operators.projection import lease_cliff
    from headroom.operators.workflow import alert_feed, at_risk_sites
    from headroom.operators import whatif as H
    rows = [(1, "far", "ASIA", 1000, None, 8005, 50.0, 0.01, 1.0, 0.0), (2, "farther", "ASIA", 1000, None, 8005, 50.0, 1e-9, 1.0, 0.0),
            (3, "farthest", "ASIA", 1000, None, 8005, 50.0, 1e-300, 1.0, 0.0)]
    trend = spark.createDataFrame(rows, "site_id long, site_name string, region string, available_sqft long, available_kw long, "
                                        "last_q int, last_sqft double, growth_sqft double, last_kw double, growth_kw double")
    coll = H.what_if(trend)
    got = {r.site_id: r for r in coll.collect()}
    assert got[1].quarters_to_wall == 80000 and got[1].binding_breach_quarter == "22001-Q2"
    assert abs(got[2].quarters_to_wall - 800000000000) <= 1 and got[3].quarters_to_wall == FARTHEST
    sites = spark.createDataFrame([(k, r[1], datetime.date(2002, 1, 1), datetime.date(2001, 12, 1)) for k, r in enumerate(rows, 1)],
                                  "site_id long, site_name string, lease_expiration_date date, lease_option_deadline date")
    cliff = lease_cliff(sites, coll.drop("binding_breach_q"))          # the label is all this frame carries
    c = {r.site_id: r for r in cliff.collect()}
    assert all(r.cliff_status == "ok" and r.breach_date is None for r in c.values())
    cycles = (22001 - 2001) // 400
    assert c[1].decision_window_days == cycles * 146097 + (datetime.date(2001, 4, 1) - datetime.date(2001, 12, 1)).days
    assert alert_feed(at_risk_sites(coll, cliff), coll, cliff, H.relocation(trend, H.adjacency_frame(spark, {}))).count() == 0
