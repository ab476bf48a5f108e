"""One callable per operator: ``(spark, sf_dir) -> DataFrame`` over the driver tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headroom.operators import accountability as A
from headroom.operators import ask as Q
from headroom.operators import integrity as I
from headroom.operators import clean as B
from headroom.operators import constraints as K
from headroom.operators import measures as M
from headroom.operators import occupancy as O
from headroom.operators import projection as P
from headroom.operators import whatif as H
from headroom.operators import workflow as G
from headroom.functions.clean import blank_null, int_value, quarter_label
from headroom.sources.dirty import DirtyExports
from headroom.sources.driver import AS_OF, AS_OF_Q, DriverCatalog
from headroom.streaming import intake as S

col = F.col


class Plan:
    """Composed operators over one catalog.  Shared parents are built once per
    plan object as logical plans; identical sub-plans inside one query reuse
    their shuffle output (ReuseExchange)."""

    def __init__(self, cat: DriverCatalog, share_history: bool = False):
        self.cat = cat
        self.as_of = cat.as_of
        self.share_history = share_history

    # D ---------------------------------------------------------------------
    @cached_property
    def trend(self) -> DataFrame:
        return self.cat.keep(P.collision_trend(self.cat.sites, self.cat.production_demand), "trend")

    @cached_property
    def collision(self) -> DataFrame:
        return P._project_sites(self.trend).select(*P.COLLISION_COLUMNS, "binding_breach_q")

    @cached_property
    def cliff(self) -> DataFrame:
        return P.lease_cliff(self.cat.sites, self.collision)

    @cached_property
    def cost_of_delay(self) -> DataFrame:
        return P.cost_of_delay(self.cat.actions, self.cat.sites, self.collision)

    # C ---------------------------------------------------------------------
    @cached_property
    def quality_sq(self) -> DataFrame:
        return M.quality_by_site_quarter(self.cat.quality_issues, self.cat.sites)

    @cached_property
    def cost(self) -> DataFrame:
        return M.cost_per_sqft(self.cat.sites, self.cat.leases)

    @cached_property
    def integration(self) -> DataFrame:
        return M.integration_pipeline(self.cat.sites, self.as_of)

    # E ---------------------------------------------------------------------
    @cached_property
    def space_demand(self) -> DataFrame:
        c = self.cat
        return O.space_demand(c.headcount_snapshots, c.requisition_pipeline, c.archetypes,
                              c.archetype_space_map, c.space_types)

    @cached_property
    def space_collision(self) -> DataFrame:
        c = self.cat
        if self._shared_history:
            # the last cut-off is the as-of period itself: the current projection
            return self.space_history.where(col("cut_q") == AS_OF_Q).drop("cut_q", "snapshot_date")
        return O.space_collision(self.space_demand, c.sites, c.space_types, c.space_capacity)

    @property
    def _shared_history(self) -> bool:
        """Queries that need both the current projection and the backtest
        evaluate them in one occupancy pipeline (one pass over the aggregated
        facts, materialised once)."""
        return self.share_history and self.as_of == AS_OF

    @cached_property
    def space_history(self) -> DataFrame:
        c = self.cat
        return c.keep(A.forecast_history(c.headcount_snapshots, c.requisition_pipeline, c.archetypes,
                                         c.archetype_space_map, c.space_types, c.sites, c.space_capacity,
                                         AS_OF_Q), "space_history")

    @cached_property
    def time_to_seat(self) -> DataFrame:
        c = self.cat
        return O.time_to_seat(c.requisition_pipeline, c.archetypes, c.sites, self.space_collision,
                              c.archetype_space_map)

    @cached_property
    def plan_reconciliation(self) -> DataFrame:
        c = self.cat
        return O.plan_reconciliation(c.headcount_snapshots, c.requisition_pipeline, c.sites, self.space_collision)

    # F ---------------------------------------------------------------------
    @cached_property
    def snapshots(self) -> DataFrame:
        return self.cat.keep(A.snapshot_rows(self.space_history), "snapshots")

    @cached_property
    def accuracy(self) -> DataFrame:
        return A.forecast_accuracy(self.snapshots, self.cat.sites, self.cat.space_types)

    @cached_property
    def readiness(self) -> DataFrame:
        c = self.cat
        return A.day_one_readiness(c.onboarding_cohorts, c.headcount_snapshots, c.sites, c.archetypes)

    @cached_property
    def scorecard(self) -> DataFrame:
        c = self.cat
        return A.kpi_scorecard(self.time_to_seat, self.accuracy, c.actions, self.collision, self.space_collision,
                               c.space_types, self.readiness, self.plan_reconciliation, c.decisions, self.as_of)

    # G ---------------------------------------------------------------------
    @cached_property
    def lrm(self) -> DataFrame:
        return G.last_responsible_moment(self.space_collision, self.as_of)

    @cached_property
    def open_actions(self) -> DataFrame:
        return G.open_actions(self.cat.actions, self.cat.sites)

    @cached_property
    def at_risk(self) -> DataFrame:
        return G.at_risk_sites(self.collision, self.cliff)

    # any number of constraints ----------------------------------------------
    @cached_property
    def constraint_trends(self) -> DataFrame:
        c = self.cat
        return c.keep(K.trends(c.constraint_demand, c.constraint_capacity, c.sites, c.constraints), "constraint_trends")

    # H ---------------------------------------------------------------------
    @cached_property
    def adjacency(self) -> DataFrame:
        return H.adjacency_frame(self.cat.spark, H.WORLD_REGION_ADJACENCY)

    @cached_property
    def relocation(self) -> DataFrame:
        return H.relocation(self.trend, self.adjacency)

    @cached_property
    def program_changes(self) -> DataFrame:
        """Driver scenario: every program with a baseline asks for +10 units/period."""
        p = self.cat.programs
        base = F.coalesce(F.when(col("units_per_quarter_target") != 0, col("units_per_quarter_target")),
                          F.when(col("units_per_quarter_current") != 0, col("units_per_quarter_current")))
        return p.where(base.isNotNull()).select("program_name", (base + 10).alias("target"))

    @cached_property
    def growth_factors(self) -> DataFrame:
        """Driver scenario: regional growth factors by region (as data)."""
        return self.cat.sites.select("site_id", F.when(col("region") == "ASIA", 1.5)
                                     .when(col("region") == "EUROPE", 0.5).otherwise(1.0).alias("factor"))


class CleanPlan:
    """The cleaning pipeline over the raw exports of one catalog."""

    def __init__(self, plan: Plan):
        self.plan = plan
        self.raw = DirtyExports(plan.cat)

    @cached_property
    def codes(self) -> DataFrame:
        r = self.raw
        codes = r.hris.select(col("site_code").alias("c")).unionByName(
            r.acquired_dump.select(col("facility_code").alias("c")))
        return B.canonical_codes(codes, "c", r.aliases, r.known_codes)

    @cached_property
    def hris_split(self):
        r = self.raw
        res = B.resolve_codes(r.hris, "site_code", r.aliases, r.known_codes)
        return B.quarantine_split(res, B.HRIS_RAW_COLS, "hris_export.csv",
                                  F.concat(F.lit("unknown site code '"), col("site_code"), F.lit("'")))

    @cached_property
    def hris_dedupe(self):
        good = self.hris_split[0].select("seq", "site_id", quarter_label("quarter_raw").alias("quarter"), "program",
                                         "archetype", int_value("headcount_raw").alias("headcount"))
        return B.keep_last(good, ["site_id", "quarter", "program"], "seq", ["archetype", "headcount"], "headcount")

    @cached_property
    def clean_headcount(self) -> DataFrame:
        kept = self.hris_dedupe[0]
        return B.with_surrogate_ids(kept, ["seq"], "snapshot_id").select(
            "snapshot_id", "site_id", "quarter", "program", "archetype", "headcount")

    @cached_property
    def capacity_split(self):
        """B5 + B8: capacity rows of unknown sites are not loaded (and reported);
        a blank status means 'confirmed'."""
        r = self.raw
        res = B.resolve_codes(r.capacity_export, "site_code", r.aliases, r.known_codes)
        good, bad = B.semi_filter(res, B.CAPACITY_RAW_COLS, "space_capacity.csv")
        good = good.select("site_id", int_value("space_type_id").alias("space_type_id"),
                           int_value("capacity").alias("capacity"),
                           F.coalesce(blank_null("capacity_status"), F.lit("confirmed")).alias("capacity_status"))
        return good, bad

    @cached_property
    def acquired(self):
        r = self.raw
        res = B.resolve_codes(r.acquired_dump, "facility_code", r.aliases, r.known_codes)
        return B.merge_entities(res)

    @cached_property
    def exceptions(self) -> DataFrame:
        ex = self.hris_split[1].unionByName(self.acquired[1]).unionByName(self.capacity_split[1])
        return B.with_surrogate_ids(ex, ["source_file", "seq"], "exception_id").select(
            "exception_id", "source_file", "raw_row", "reason")

    @cached_property
    def reconciliation_log(self) -> DataFrame:
        """One typed log of everything reconciliation did."""
        d = self.hris_dedupe[1].select(
            F.lit("dedupe").alias("kind"), F.lit("hris_export.csv").alias("source"),
            F.concat_ws("|", col("site_id").cast("string"), "quarter", "program").alias("key"),
            F.concat(F.lit("kept "), col("kept_value").cast("string"), F.lit(" (dropped conflicting "),
                     col("dropped_value").cast("string"), F.lit(")")).alias("message"))
        e = self.exceptions.select(F.lit("exception").alias("kind"), col("source_file").alias("source"),
                                   col("exception_id").cast("string").alias("key"), col("reason").alias("message"))
        a = (B.resolve_codes(self.raw.acquired_dump, "facility_code", self.raw.aliases, self.raw.known_codes)
             .select(F.lit("acquired_code").alias("kind"), F.lit("acquired_site_dump.csv").alias("source"),
                     col("facility_code").alias("key"),
                     F.concat(F.lit("acquired code '"), col("facility_code"), F.lit("' -> site "),
                              F.coalesce(col("site_id").cast("string"), F.lit("(unresolved)"))).alias("message")))
        return d.unionByName(e).unionByName(a)


def driver_integrity(p: Plan) -> DataFrame:
    c = p.cat
    return I.integrity_check([
        I.PrimaryKey("sites", c.sites, ["site_id"]),
        I.PrimaryKey("space_capacity", c.space_capacity, ["site_id", "space_type_id"]),
        I.PrimaryKey("actions", c.actions, ["action_id"]),
        I.PrimaryKey("decisions", c.decisions, ["decision_id"]),
        I.PrimaryKey("archetype_space_map", c.archetype_space_map, ["archetype_id", "space_type_id"]),
        I.ForeignKey("headcount_snapshots", c.headcount_snapshots, ["site_id"], "sites", c.sites, ["site_id"]),
        I.ForeignKey("space_capacity", c.space_capacity, ["space_type_id"], "space_types", c.space_types,
                     ["space_type_id"]),
        I.ForeignKey("actions", c.actions, ["site_id"], "sites", c.sites, ["site_id"]),
        I.ForeignKey("decisions", c.decisions, ["site_id"], "sites", c.sites, ["site_id"]),
        I.ForeignKey("accreditation_milestones", c.accreditation_milestones, ["site_id", "space_type_id"],
                     "space_capacity", c.space_capacity, ["site_id", "space_type_id"]),
        I.NotNull("sites", c.sites, "site_name"),
        I.NotNull("actions", c.actions, "title"),
        I.NotNull("headcount_snapshots", c.headcount_snapshots, "headcount"),
    ])


def saved_views(p: Plan) -> dict:
    return {"quality_sq": lambda: p.quality_sq, "cost": lambda: p.cost,
            "headcount_vs_seats": lambda: M.headcount_vs_seats(p.cat.headcount_snapshots, p.cat.sites),
            "capacity_vs_demand": lambda: P.capacity_vs_demand(p.cat.sites, p.cat.production_demand),
            "collision": lambda: p.collision.drop("binding_breach_q")}


# Shared parents each query reads more than once: these are written once as
# tables under the checkpoint dir; every other parent streams straight through.
_CLEAN = {"headcount_snapshots"}                 # the HRIS export is resolved twice
_SCORECARD = {"space_history", "headcount_snapshots", "requisition_pipeline", "orders_with_site"}
REUSED: dict[str, set[str]] = {
    "site_health": {"leases"},
    "time_to_seat": {"requisition_pipeline"},
    "brief_bottlenecks": {"requisition_pipeline"},
    "plan_reconciliation": {"headcount_snapshots", "requisition_pipeline"},
    "forecast_accuracy": {"snapshots"},
    "material_changes": {"snapshots"},
    "kpi_scorecard": _SCORECARD,
    "scorecard_headline": _SCORECARD,
    "queue_decisions": {"orders_with_site"},
    "integrity_check": {"orders_with_site"},
    "relocation": {"trend"},
    "at_risk_sites": {"trend"},
    "alert_feed": {"trend"},
    "change_impact": {"trend"},
    "constraint_collision": {"constraint_trends"},
    "constraint_what_if": {"constraint_trends"},
    "constraint_relocation": {"constraint_trends"},
    "constraint_impact": {"constraint_trends"},
    "clean_headcount": _CLEAN,
    "dedupe_log": _CLEAN,
    "etl_exceptions": _CLEAN,
    "reconciliation_log": _CLEAN,
    "reconciliation_status": _CLEAN,
}

# Queries that read both the current space projection and the backtest snapshots.
SHARED_HISTORY = {"kpi_scorecard", "scorecard_headline"}


def _q(fn: Callable[[Plan], DataFrame], keep=frozenset(),
       share: bool = False) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(Plan(DriverCatalog(spark, sf_dir, materialize=set(keep)), share_history=share))
    run.__name__ = getattr(fn, "__name__", "query")
    return run


def _delay_by_site(p: Plan) -> DataFrame:
    return (p.cost_of_delay.groupBy("site_id")
            .agg(F.sum("delay_cost_per_quarter_usd").alias("delay_cost_per_quarter_usd")))


PLANS: dict[str, Callable[[Plan], DataFrame]] = {
    # D — projection
    "capacity_collision": (lambda p: p.collision.drop("binding_breach_q")),
    "program_facility_risk": (lambda p: P.program_facility_risk(p.cat.programs, p.cat.sites, p.collision)),
    "lease_cliff": (lambda p: p.cliff),
    "cost_of_delay": (lambda p: p.cost_of_delay),
    # C — measures
    "quality_by_site_quarter": (lambda p: p.quality_sq),
    "quality_by_site": (lambda p: M.quality_by_site(p.quality_sq)),
    "cost_per_sqft": (lambda p: p.cost),
    "headcount_vs_seats": (lambda p: M.headcount_vs_seats(p.cat.headcount_snapshots, p.cat.sites)),
    "capacity_vs_demand": (lambda p: P.capacity_vs_demand(p.cat.sites, p.cat.production_demand)),
    "site_health": (lambda p: M.site_health(p.cat.sites, p.quality_sq, p.collision, p.cost)),
    "integration_pipeline": (lambda p: p.integration),
    "integration_summary": (lambda p: M.integration_summary(p.integration)),
    # E — occupancy
    "space_demand": (lambda p: p.space_demand),
    "space_collision": (lambda p: p.space_collision.drop("breach_q")),
    "time_to_seat": (lambda p: p.time_to_seat),
    "plan_reconciliation": (lambda p: p.plan_reconciliation),
    "space_capacity_effective": (lambda p: O.space_capacity_effective(
        p.cat.space_capacity, p.cat.space_types, p.cat.accreditation_milestones)),
    "accreditation_pipeline": (lambda p: O.accreditation_pipeline(
        p.cat.accreditation_milestones, p.cat.sites, p.cat.space_types)),
    # F — accountability
    "forecast_snapshots": (lambda p: p.snapshots.drop("predicted_breach_q")),
    "forecast_accuracy": (lambda p: p.accuracy),
    "material_changes": (lambda p: A.material_changes(p.snapshots, p.cat.sites, p.cat.space_types)),
    "incentive_compliance": (lambda p: A.incentive_compliance(
        p.cat.incentive_agreements, p.cat.headcount_snapshots, p.cat.sites, p.as_of)),
    "day_one_readiness": (lambda p: p.readiness),
    "kpi_scorecard": (lambda p: p.scorecard),
    "scorecard_headline": (lambda p: A.scorecard_headline(p.scorecard)),
    # G — workflow
    "open_actions": (lambda p: p.open_actions),
    "actions_aged": (lambda p: G.with_age_band(p.open_actions, p.as_of)),
    "action_summary": (lambda p: G.action_summary(G.with_age_band(p.open_actions, p.as_of))),
    "last_responsible_moment": (lambda p: p.lrm),
    "decision_queue": (lambda p: G.decision_queue(p.cat.decisions, p.cat.sites, p.cat.space_types, p.as_of)),
    "queue_decisions": (lambda p: G.queue_decisions(p.cat.decisions, p.lrm, p.as_of)),
    "at_risk_sites": (lambda p: p.at_risk),
    "alert_feed": (lambda p: G.alert_feed(p.at_risk, p.collision, p.cliff, p.relocation)),
    "brief_at_risk": (lambda p: G.brief_at_risk(p.collision)),
    "brief_space_binding": (lambda p: G.brief_space_binding(p.space_collision)),
    "brief_bottlenecks": (lambda p: G.brief_bottlenecks(p.time_to_seat)),
    "brief_decisions": (lambda p: G.brief_decisions(
        G.decision_queue(p.cat.decisions, p.cat.sites, p.cat.space_types, p.as_of))),
    # H — what-if
    "what_if": (lambda p: H.what_if(p.trend, p.growth_factors).drop("binding_breach_q")),
    "scenario_grid": (lambda p: H.scenario_grid(p.trend)),
    "relocation": (lambda p: p.relocation),
    "change_impact": (lambda p: H.change_impact(p.trend, p.cat.programs, p.program_changes, _delay_by_site(p))),
    # D8, H1, H3, H4 over any number of constraints (three in the driver's data)
    "constraint_collision": (lambda p: K.collision(p.constraint_trends)),
    "constraint_what_if": (lambda p: K.what_if(p.constraint_trends, p.growth_factors)),
    "constraint_relocation": (lambda p: K.relocation(p.constraint_trends, p.adjacency)),
    "constraint_impact": (lambda p: K.change_impact(p.constraint_trends, p.cat.programs, p.program_changes, _delay_by_site(p))),
    # B — cleaning and reconciliation
    "canonical_codes": (lambda p: CleanPlan(p).codes),
    "clean_headcount": (lambda p: CleanPlan(p).clean_headcount),
    "dedupe_log": (lambda p: CleanPlan(p).hris_dedupe[1]),
    "etl_exceptions": (lambda p: CleanPlan(p).exceptions),
    "acquired_sites": (lambda p: CleanPlan(p).acquired[0]),
    "clean_space_capacity": (lambda p: CleanPlan(p).capacity_split[0]),
    "reconciliation_log": (lambda p: CleanPlan(p).reconciliation_log),
    # A — sources, sinks, integrity
    "integrity_check": driver_integrity,
    "saved_query_collision": (lambda p: Q.saved_query(saved_views(p), "collision",
                                                        {"status": "AT THE WALL NOW"})),
    "saved_query_quality": (lambda p: Q.saved_query(saved_views(p), "quality", {"quarter": "2001-Q1"})),
    "intake_issues": (lambda p: S.valid_issues(S.intake_rows(p.cat.raw("events"), p.cat.sites))),
    "intake_quarantine": (lambda p: S.quarantined(S.intake_rows(p.cat.raw("events"), p.cat.sites))),
    "reconciliation_status": (lambda p: M.reconciliation_status(p.cat.sites, CleanPlan(p).exceptions)),
}



QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    name: _q(fn, keep=REUSED.get(name, frozenset()), share=name in SHARED_HISTORY) for name, fn in PLANS.items()
}
