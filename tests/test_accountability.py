"""Accountability: accreditation flip, snapshot diffs, scorecard shape."""

import datetime

from headroom.operators import accountability as A
from headroom.operators import occupancy as O

ST = "space_type_id int, name string, unit_label string, lead_time_days int, restricted_sensing int, " \
     "target_util_low int, target_util_high int"


def test_accreditation_flip(spark):
    cap = spark.createDataFrame([(1, 3, 10, "planned"), (2, 3, 10, "planned"), (1, 1, 5, "confirmed")],
                                "site_id long, space_type_id int, capacity int, capacity_status string")
    d = datetime.date
    ms = spark.createDataFrame(
        [(1, 3, "design_approval", d(2025, 1, 1), d(2025, 1, 5)), (1, 3, "construction", d(2025, 3, 1), d(2025, 3, 1)),
         (1, 3, "inspection", d(2025, 6, 1), d(2025, 6, 30)), (1, 3, "accreditation", d(2025, 9, 1), d(2025, 9, 2)),
         (2, 3, "design_approval", d(2025, 1, 1), d(2025, 1, 1)), (2, 3, "construction", d(2025, 3, 1), None),
         (2, 3, "inspection", d(2025, 6, 1), None)],
        "site_id long, space_type_id int, milestone string, planned_date date, actual_date date")
    st = spark.createDataFrame([(1, "desk", "seat", 90, 0, 60, 85), (3, "scif_seat", "seat", 365, 1, 50, 80)], ST)
    eff = {r.site_id: r.effective_status for r in O.space_capacity_effective(cap, st, ms).where("space_type_id = 3")
           .collect()}
    assert eff == {1: "confirmed", 2: "planned"}
    sites = spark.createDataFrame([(1, "one"), (2, "two")], "site_id long, site_name string")
    pipe = {r.site_id: r for r in O.accreditation_pipeline(ms, sites, st).collect()}
    assert pipe[1].current_stage == "accreditation" and pipe[1].max_slip_days == 29
    assert pipe[2].current_stage == "design_approval" and pipe[2].next_stage == "construction"
    assert pipe[2].pipeline_status.startswith("in progress")


SNAP = "snapshot_id long, snapshot_date date, site_id long, space_type_id int, predicted_breach_quarter string, " \
       "predicted_util_pct double"


def _sites_st(spark):
    sites = spark.createDataFrame([(1, "one"), (2, "two"), (3, "three")], "site_id long, site_name string")
    st = spark.createDataFrame([(1, "desk", "seat", 90, 0, 60, 85)], ST)
    return sites, st


def test_one_snapshot_date_gives_no_changes(spark):
    sites, st = _sites_st(spark)
    s = spark.createDataFrame([(1, datetime.date(2026, 1, 1), 1, 1, "2026-Q4", 80.0)], SNAP)
    assert A.material_changes(s, sites, st).count() == 0


def test_material_changes_and_accuracy(spark):
    sites, st = _sites_st(spark)
    d1, d2 = datetime.date(2026, 1, 1), datetime.date(2026, 4, 1)
    s = spark.createDataFrame([
        (1, d1, 1, 1, "2027-Q1", 80.0), (2, d2, 1, 1, "2026-Q4", 82.0),     # moved earlier: worse
        (3, d1, 2, 1, "2026-Q3", 95.0), (4, d2, 2, 1, None, 70.0),          # cleared + back in band: better
        (5, d1, 3, 1, "2027-Q2", 70.0), (6, d2, 3, 1, "2027-Q2", 90.0),     # left the band: worse
    ], SNAP)
    got = sorted((r.site_id, r.what_changed, r.direction) for r in A.material_changes(s, sites, st).collect())
    assert got == [(1, "breach_quarter", "worse"), (2, "breach_cleared", "better"),
                   (2, "utilization_band", "better"), (3, "utilization_band", "worse")]
    acc = {r.site_id: r.outcome for r in A.forecast_accuracy(s, sites, st).collect()}
    assert acc == {1: "miss", 2: None, 3: "hit"}


def test_scorecard_shape(spark):
    from headroom.plans.registry import QUERIES
    rows = QUERIES["kpi_scorecard"](spark, "/root/testdata/sf0.001").collect()
    assert [r.sort_order for r in rows] == list(range(1, 8))
    assert all(r.value is not None and r.status in ("ok", "watch", "AT RISK") for r in rows)


def test_shared_history_equals_direct_projection(spark):
    from headroom.plans.registry import Plan
    from headroom.sources.driver import DriverCatalog
    shared = Plan(DriverCatalog(spark, "/root/testdata/sf0.01", materialize=True), share_history=True)
    direct = Plan(DriverCatalog(spark, "/root/testdata/sf0.01", materialize=False))
    assert shared._shared_history and not direct._shared_history
    a, b = shared.space_collision, direct.space_collision.select(*shared.space_collision.columns)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    s1, s2 = shared.snapshots, direct.snapshots
    assert s1.exceptAll(s2).count() == 0 and s2.exceptAll(s1).count() == 0


def test_running_trend_equals_a_fresh_run_at_every_cut_off(spark):
    """Every period's snapshot equals the projection over only the facts recorded before it."""
    import random
    from headroom.operators.projection import endpoint_trend
    rnd = random.Random(13)
    arch = spark.createDataFrame([(1, "a"), (2, "b")], "archetype_id int, name string")
    ratio = spark.createDataFrame([(1, 1, 0.5), (1, 2, 1.0), (2, 1, 0.25)], "archetype_id int, space_type_id int, ratio double")
    st = spark.createDataFrame([(k, f"t{k}", "seat", 90, 0, 60, 85) for k in (1, 2)], ST)
    hc = [(s, 8000 + q, a, rnd.randint(0, 40)) for s in range(1, 9) for q in range(12) for a in "ab" if rnd.random() < 0.4 and s != 4]
    rq = [(s, a, 8000 + q, rnd.randint(1, 9), rnd.choice([0, 1, 91, 300, 900])) for s in range(1, 9) for q in range(12) for a in (1, 2)
          if rnd.random() < 0.4 and s != 5]
    headcount = spark.createDataFrame(hc, "site_id long, q_index int, archetype string, headcount int")
    reqs = spark.createDataFrame(rq, "site_id long, archetype_id int, q_index int, open_reqs int, avg_time_to_fill_days int")
    until = 8014
    got = {(r.site_id, r.space_type_id, r.cut_q): (r.first_q, r.last_q, r.first_demanded_units, r.last_demanded_units,
                                                   r.growth_demanded_units)
           for r in O.running_trend(O.space_events(headcount, reqs, arch, ratio), until).collect()}
    want = {}
    for cut in range(8000, until + 1):
        d = O.space_demand(headcount.where(f"q_index < {cut}"), reqs.where(f"q_index < {cut}"), arch, ratio, st)
        for r in endpoint_trend(d, ["site_id", "space_type_id"], "q_index", ["demanded_units"]).collect():
            want[r.site_id, r.space_type_id, cut] = (r.first_q, r.last_q, r.first_demanded_units, r.last_demanded_units,
                                                     r.growth_demanded_units)
    assert got == want and len(got) > 100


def test_running_trend_deals_its_facts_once(spark):
    """The sums per period and the running values of a key need one shuffle together, by site."""
    arch = spark.createDataFrame([(1, "a")], "archetype_id int, name string")
    ratio = spark.createDataFrame([(1, 1, 0.5)], "archetype_id int, space_type_id int, ratio double")
    headcount = spark.createDataFrame([(1, 8000, "a", 4), (None, 8001, "a", 2), (1, 8001, "a", 8)],
                                      "site_id long, q_index int, archetype string, headcount int")
    reqs = spark.createDataFrame([(1, 1, 8000, 2, 91)], "site_id long, archetype_id int, q_index int, open_reqs int, avg_time_to_fill_days int")
    trend = O.running_trend(O.space_events(headcount, reqs, arch, ratio), 8003)
    assert trend._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(") == 1
    got = sorted((r.site_id or 0, r.cut_q, r.last_demanded_units) for r in trend.collect())
    assert got == [(0, 8002, 1.0), (0, 8003, 1.0), (1, 8001, 3.0), (1, 8002, 5.0), (1, 8003, 5.0)]


def test_history_has_every_quarter_and_reads_each_fact_once(spark):
    from headroom.plans.registry import Plan
    from headroom.sources.driver import DriverCatalog
    p = Plan(DriverCatalog(spark, "/root/testdata/sf0.001", materialize=False))
    plan = p.snapshots._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 2 * 3 + 4        # two fact pipelines of three tables, and sites and capacity
    days = [r[0] for r in p.snapshots.select("snapshot_date").distinct().orderBy("snapshot_date").collect()]
    assert len(days) > 20 and all((b - a).days in (90, 91, 92) for a, b in zip(days, days[1:]))
    assert p.snapshots.count() == p.snapshots.select("snapshot_id").distinct().count()
