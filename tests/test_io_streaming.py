"""Sinks (snapshot, publish, export read-back), the batch build and the intake stream."""

import glob
import os

from pyspark.sql import functions as F

from headroom.sources import io
from headroom.streaming import intake as S

SF = "/root/testdata/sf0.001"


def test_append_snapshot_idempotent(spark, scratch):
    from headroom.plans.registry import Plan
    from headroom.sources.driver import DriverCatalog
    p = Plan(DriverCatalog(spark, SF))
    path = os.path.join(scratch, "snap")
    n = io.append_snapshot(p.space_collision, "2026-07-01", path).count()
    io.append_snapshot(p.space_collision, "2026-07-01", path)
    io.append_snapshot(p.space_collision, "2026-08-01", path)
    snaps = io.read_snapshots(spark, path)
    counts = {r.snapshot_date.isoformat(): r["count"] for r in snaps.groupBy("snapshot_date").count().collect()}
    assert counts == {"2026-07-01": n, "2026-08-01": n}


def test_publish_and_read_export(spark, scratch):
    df = spark.createDataFrame([("a,b", "1"), ("c", None)], "name string, v string")
    empty = df.where("false")
    paths = io.publish({"one": df, "empty": empty}, scratch)
    back = io.read_export(spark, paths["one"], ["name", "v"])
    assert sorted((r.name, r.v) for r in back.collect()) == [("a,b", "1"), ("c", None)]
    assert back.select("seq").distinct().count() == 2
    many = os.path.join(scratch, "many")
    os.makedirs(many)
    for name, n in (("a", 3), ("b", 3000)):                                # the larger file is read first
        with open(os.path.join(many, f"{name}.csv"), "w") as f:
            f.write("name,v\n" + "".join(f"{name}{k:04d},{k}\n" for k in range(n)))
    ordered = [r.name for r in io.read_export(spark, many, ["name", "v"]).orderBy("seq").collect()]
    assert ordered == sorted(ordered) and len(ordered) == 3003
    parts = glob.glob(os.path.join(paths["empty"], "part-*.csv"))
    assert parts and open(parts[0]).read().splitlines() == ["name,v"]      # header kept when empty


def test_pipeline_build(spark, scratch):
    from headroom.plans.pipeline import build
    counts = build(spark, SF, scratch, publish=False)
    again = build(spark, SF, os.path.join(scratch, "second"), publish=False)
    assert counts["snapshot_rows"] == again["snapshot_rows"]
    dec = spark.read.parquet(os.path.join(scratch, "tables", "decisions"))
    assert dec.select("decision_id").distinct().count() == dec.count()


def test_intake_stream_matches_batch(spark, scratch):
    src = os.path.join(scratch, "events")
    spark.read.parquet(f"{SF}/events.parquet").repartition(3).write.parquet(src)
    from headroom.sources.driver import DriverCatalog
    sites = DriverCatalog(spark, SF).sites
    q = S.start_intake(spark, src, sites, os.path.join(scratch, "issues"), os.path.join(scratch, "quar"),
                       os.path.join(scratch, "ckpt"))
    q.awaitTermination(300)
    streamed = spark.read.parquet(os.path.join(scratch, "issues")).drop("batch_id")
    batch = S.valid_issues(S.intake_rows(spark.read.parquet(src), sites))
    assert streamed.count() == batch.count() > 0
    assert streamed.exceptAll(batch).count() == 0
    quar = spark.read.parquet(os.path.join(scratch, "quar"))
    assert quar.where(F.col("reason").startswith("unknown site")).count() == quar.count()
    assert glob.glob(os.path.join(scratch, "issues", "batch_id=*"))


def test_snapshot_history_scores_itself(spark, scratch):
    """Three runs append their predictions under their own dates; accuracy is
    scored from the written snapshot table (older runs vs the newest)."""
    from headroom.plans.pipeline import accuracy_from
    from headroom.plans.registry import Plan
    from headroom.sources.driver import DriverCatalog
    p = Plan(DriverCatalog(spark, SF))
    path = os.path.join(scratch, "snapshots")
    n = 0
    for day in ("2001-04-01", "2001-05-01", "2001-06-01"):
        n = io.append_snapshot(p.space_collision, day, path).count()
    acc = accuracy_from(spark, SF, path)
    rows = acc.collect()
    assert len(rows) == 2 * n                                  # two older runs scored per prediction
    assert all(r.actual_date.isoformat() == "2001-06-01" for r in rows)
    assert all(r.outcome in ("hit", None) for r in rows)       # same inputs: every dated forecast hits
