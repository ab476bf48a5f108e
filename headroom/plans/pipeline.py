"""The batch build: canonical tables -> views -> snapshot -> decisions -> extracts.

Stages hand over through Parquet tables written under the run folder (a
shared path on a cluster), which also cuts the lineage: a lost executor only
recomputes the current stage.  Order matters: the snapshot is taken before
decisions are queued, and both precede the published extracts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from headroom.operators import accountability as A
from headroom.operators import workflow as G
from headroom.plans.registry import QUERIES, Plan
from headroom.sources import io
from headroom.sources.driver import DriverCatalog
from headroom.sources.store import TableStore

PUBLISHED = [
    "quality_by_site_quarter", "cost_per_sqft", "headcount_vs_seats", "capacity_vs_demand", "capacity_collision",
    "reconciliation_status", "open_actions", "lease_cliff", "site_health", "program_facility_risk",
    "integration_pipeline", "space_demand", "space_collision", "time_to_seat", "plan_reconciliation",
    "space_capacity_effective", "accreditation_pipeline", "forecast_accuracy", "cost_of_delay",
    "incentive_compliance", "day_one_readiness", "kpi_scorecard", "material_changes",
    "last_responsible_moment", "decision_queue",
]


def build(spark: SparkSession, sf_dir: str, out_dir: str, run_date: str | None = None,
          publish: bool = True) -> dict[str, int]:
    """Run the whole build into ``out_dir``; returns row counts per stage."""
    out = out_dir.rstrip("/")
    cat = DriverCatalog(spark, sf_dir)
    run_date = run_date or cat.as_of
    tables = {
        "sites": cat.sites, "leases": cat.leases, "production_demand": cat.production_demand,
        "quality_issues": cat.quality_issues, "headcount_snapshots": cat.headcount_snapshots,
        "requisition_pipeline": cat.requisition_pipeline, "space_capacity": cat.space_capacity,
        "actions": cat.actions, "decisions": cat.decisions,
    }
    store = TableStore(spark, f"{out}/tables")
    store.rebuild(tables)
    plan = Plan(cat)
    # self-scoring: this run's predictions become a snapshot partition
    snap = io.append_snapshot(plan.space_collision, run_date, f"{out}/forecast_snapshots")
    counts = {"snapshot_rows": snap.count()}
    # decision queue: only what is missing, by key, in one commit (idempotent)
    counts["decisions_queued"] = G.commit_decisions(store, G.last_responsible_moment(plan.space_collision, cat.as_of), run_date)
    if publish:
        views = {name: QUERIES[name](spark, sf_dir) for name in PUBLISHED}
        io.publish(views, f"{out}/extracts")
        counts["published_views"] = len(views)
    return counts


def snapshots_from(spark: SparkSession, path: str) -> DataFrame:
    return io.read_snapshots(spark, path)


def accuracy_from(spark: SparkSession, sf_dir: str, snapshot_path: str) -> DataFrame:
    cat = DriverCatalog(spark, sf_dir)
    return A.forecast_accuracy(io.read_snapshots(spark, snapshot_path), cat.sites, cat.space_types)


__all__ = ["build", "snapshots_from", "accuracy_from", "PUBLISHED"]
