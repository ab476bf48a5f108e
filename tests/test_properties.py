"""Randomised checks of the projection core against a plain-Python model of the
view semantics, plus integrity and saved-query validation."""

import math
import random

import pytest
from pyspark.sql import functions as F

from headroom.operators import integrity as I
from headroom.operators import ask as Q
from headroom.operators.projection import with_site_binding


def model_project(cap, last, growth, last_q):
    """Python model: periods to the 85 % wall, breach label and status band."""
    if cap is None or cap == 0:
        return None, None, "unknown — capacity data pending"
    wall = 0.85 * cap
    if growth <= 0:
        return None, None, "stable"
    if last >= wall:
        periods, status = 0, "AT THE WALL NOW"
    else:
        raw = (wall - last) / growth
        periods = math.trunc(raw + 0.999999)
        status = "COLLISION WARNING" if raw <= 2 else "watch" if raw <= 4 else "ok"
    q = last_q + periods
    return periods, f"{q // 4}-Q{q % 4 + 1}", status


def model_bind(floor, power):
    fq, pq = floor[0], power[0]
    if fq is None and pq is None:
        return "none", None, None, floor[2]
    if pq is None:
        return "floor", *floor
    if fq is None:
        return "power", *power
    return ("power", *power) if pq <= fq else ("floor", *floor)


def test_projection_matches_model(spark):
    rnd = random.Random(11)
    rows = []
    for i in range(600):
        cap_s = rnd.choice([None, 0, rnd.randint(100, 5000)])
        cap_k = rnd.choice([None, 0, rnd.randint(1000, 50000)])
        last_s = float(rnd.randint(0, 6000))
        last_k = float(rnd.randint(0, 60000))
        g_s = rnd.choice([0.0, -3.0, float(rnd.randint(1, 900)), rnd.uniform(0.1, 50)])
        g_k = rnd.choice([0.0, -10.0, float(rnd.randint(1, 9000)), rnd.uniform(0.1, 500)])
        if i % 7 == 0:                      # force exact ties between the constraints
            cap_k, last_k, g_k = cap_s, last_s, g_s
        rows.append((i, cap_s, cap_k, 8000 + i % 9, last_s, g_s, last_k, g_k))
    df = spark.createDataFrame(rows, "site_id long, available_sqft long, available_kw long, last_q int, "
                                     "last_sqft double, growth_sqft double, last_kw double, growth_kw double")
    got = {r.site_id: (r.b_name, r.b_periods, r.b_breach, r.b_status)
           for r in with_site_binding(df, None, "b_").collect()}
    for (i, cs, ck, lq, ls, gs, lk, gk) in rows:
        want = model_bind(model_project(cs, ls, gs, lq), model_project(ck, lk, gk, lq))
        assert got[i] == want, (i, got[i], want)


def test_integrity_finds_injected_violations(spark):
    parent = spark.createDataFrame([(1, "a"), (2, "b"), (2, "dup"), (None, "nokey")], "id long, name string")
    child = spark.createDataFrame([(10, 1), (11, 3), (12, None)], "cid long, pid long")
    out = {(r.check_kind, r.table_name): r.violations for r in I.integrity_check([
        I.PrimaryKey("parent", parent, ["id"]),
        I.ForeignKey("child", child, ["pid"], "parent", parent, ["id"]),
        I.NotNull("parent", parent.withColumn("name", F.when(F.col("id") == 1, None).otherwise(F.col("name"))),
                  "name"),
    ]).collect()}
    assert out == {("primary_key", "parent"): 3, ("foreign_key", "child"): 1, ("not_null", "parent"): 1}


def test_saved_query_validation_and_promotion(spark):
    df = spark.createDataFrame([(1, "ok"), (2, "AT THE WALL NOW")], "site_id long, collision_status string")
    views = {"collision": lambda: df}
    got = Q.saved_query(views, "collision", {"status": "AT THE WALL NOW"}, promote="at_wall_sites")
    assert [r.site_id for r in got.collect()] == [2]
    assert spark.table("at_wall_sites").count() == 1
    with pytest.raises(ValueError):
        Q.saved_query(views, "collision", {"quarter": "2026-Q1"})        # filter the domain lacks
    assert Q.saved_query(views, "collision", {"site": "1'; DROP"}).count() == 0   # not a site number
    assert Q.saved_query(views, "collision", {"status": "unknown — capacity data pending"}).count() == 0
    with pytest.raises(ValueError):
        Q.saved_query(views, "collision", {}, promote="Bad-Name")
    with pytest.raises(ValueError):
        Q.saved_query(views, "weather", {})
