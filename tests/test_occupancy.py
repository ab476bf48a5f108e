"""Occupancy goldens: carry-forward, pipeline shift, capacity-status gate."""

from headroom.operators import occupancy as O
from headroom.sources.driver import ARCHETYPES, ARCHETYPE_SPACE_MAP, SPACE_TYPES


def frames(spark, hc_rows, req_rows, cap_rows):
    hc = spark.createDataFrame(hc_rows, "site_id long, q_index int, archetype string, headcount int")
    rq = spark.createDataFrame(req_rows, "site_id long, archetype_id int, q_index int, open_reqs int, "
                                         "avg_time_to_fill_days int")
    arch = spark.createDataFrame([(a, n, "") for a, n in ARCHETYPES], "archetype_id int, name string, description string")
    rmap = spark.createDataFrame(ARCHETYPE_SPACE_MAP, "archetype_id int, space_type_id int, ratio double")
    st = spark.createDataFrame(SPACE_TYPES, "space_type_id int, name string, unit_label string, lead_time_days int, "
                                            "restricted_sensing int, target_util_low int, target_util_high int")
    sites = spark.createDataFrame([(1, "one"), (2, "two")], "site_id long, site_name string")
    cap = spark.createDataFrame(cap_rows, "site_id long, space_type_id int, capacity int, capacity_status string")
    demand = O.space_demand(hc, rq, arch, rmap, st)
    return demand, O.space_collision(demand, sites, st, cap)


def test_carry_forward_and_pipeline(spark):
    # BUILDING staff use desks at 1.0; reqs filled 100 days later land 2 quarters on
    demand, _ = frames(spark, [(1, 8000, "BUILDING", 10), (1, 8002, "BUILDING", 14)],
                       [(1, 2, 8001, 4, 100)], [(1, 1, 100, "confirmed")])
    d = {r.q_index: r for r in demand.where("space_type_id = 1").collect()}
    assert sorted(d) == [8000, 8002, 8003]
    assert d[8000].demanded_units == 10.0
    assert d[8003].demanded_from_headcount == 14.0          # carried forward from 8002
    assert d[8003].demanded_from_pipeline == 4.0            # 8001 + ceil(100/91) = 8003
    assert d[8003].demanded_units == 18.0


def test_pending_and_planned_never_breach(spark):
    hc = [(1, 8000, "BUILDING", 10), (1, 8002, "BUILDING", 40), (2, 8000, "BUILDING", 10),
          (2, 8002, "BUILDING", 40)]
    caps = [(1, 1, None, "audit_pending"), (1, 4, 20, "planned"), (1, 5, 100, "confirmed"),
            (2, 1, 30, "confirmed"), (2, 4, 0, "confirmed")]
    _, coll = frames(spark, hc, [], caps)
    r = {(x.site_id, x.space_type_id): x for x in coll.collect()}
    assert r[(1, 1)].space_status == "data pending — audit" and r[(1, 1)].breach_quarter is None
    assert r[(1, 4)].space_status == "planned supply" and r[(1, 4)].supportable_units == 17.0
    assert r[(1, 4)].current_util_pct is None
    assert r[(2, 4)].space_status == "data pending — audit"
    assert r[(2, 1)].space_status == "AT THE WALL NOW" and r[(2, 1)].is_binding == 1
    assert sum(x.is_binding for x in r.values() if x.site_id == 1) <= 1


def test_new_entity_is_data_only(spark):
    # a site that appears only as rows flows through unchanged
    _, coll = frames(spark, [(2, 8000, "MACHINERY", 4), (2, 8001, "MACHINERY", 8)], [],
                     [(2, 2, 10, "confirmed"), (2, 3, 10, "confirmed")])
    rows = {x.space_type_id: x for x in coll.collect()}
    assert set(rows) == {2, 3}
    assert rows[2].quarters_to_wall == 1 and rows[2].is_binding == 1   # bench: 4 -> 8 of 10
